import pytest

import corpus_pipeline as P
from textkiln.llm import poisson_mix
from textkiln.llm.common import cut, table

from .conftest import ODD
from .test_decontamination import by_hand as leaks_by_hand
from .test_hilbert_shards import check_rows_law
from .test_poisson_mix import copies_by_hand
from .test_simhash import components_by_hand


def test_stages_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    rows = {}
    frames = [docs]
    for name, stage in P.STAGES:
        frames.append(cut(stage(spark, frames[-1], sf), "test"))
        rows[name] = frames[-1].collect()
    assert all(f.columns == docs.columns for f in frames[:-1])
    lang = {r.doc_id for r in rows["language_id"]}
    assert lang == {r.doc_id for r in docs.collect()}  # all are prose: clean documents stay (foreign ones: below)
    own = [(r.doc_id, r.text) for r in rows["language_id"]]
    kept = {r.doc_id for r in rows["simhash_near_dedup"]}
    assert kept == {d for d, _, c in components_by_hand(own) if d == c}
    leaked = {d for d, *_ in leaks_by_hand([(d, t) for d, t in own if d in kept], items)}
    assert leaked and {r.doc_id for r in rows["decontamination"]} == kept - leaked
    rates = {r.source: r.rate for r in poisson_mix.source_rates(frames[3]).collect()}
    want = sorted(r.doc_id for r in rows["decontamination"] for _ in range(copies_by_hand(r.doc_id, rates[r.source])))
    assert sorted(r.doc_id for r in rows["mixing"]) == want
    check_rows_law(rows["sharding"])
    assert sorted(r.doc_id for r in rows["sharding"]) == want
    whole = P.run(spark, sf).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in whole) == sorted((r.doc_id, r.shard, r.slot) for r in rows["sharding"])


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, sf, frame, rows):
    docs = frame(rows)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert set(docs.columns) <= set(out.columns) if name == "sharding" else out.columns == docs.columns
        out.collect()


def test_foreign_text_and_noise_go_and_clean_documents_stay(spark, sf):
    docs = table(spark, sf, "documents")
    foreign = ["Это простой русский текст о погоде и о жизни в большом городе. ", "これは日本語の文章です。天気と生活について。 ", "asdfkj qwpoeiru zxmcnvb qwoeiruty alskdjfh zmxncbv qpwoeir ghjkl "]
    new = spark.createDataFrame([(10**6 + i, t * (1 + i % 7), None, "s", 9) for i, t in enumerate(foreign * 7)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.language(spark, docs.unionByName(new), sf).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_languages_that_are_not_recognised_go(spark, sf, frame):
    rows = [(i, "the dog and the cat are running here", "en", "a") for i in range(30)] + [(100, "123 456", "en", "a"), (101, None, "en", "a"), (102, "", "en", "a")]
    assert sorted(r.doc_id for r in P.language(spark, frame(rows), sf).collect()) == list(range(30))
