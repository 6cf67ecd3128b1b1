from textkiln.llm import license_scan as L

PROSE = "some words about nothing in particular\nand a second line"


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "1 AS score", "'b' AS block", "'t' AS term", "'l' AS license", "'d' AS dir")
    return {(r.doc_id, r.path): (r.own_license, r.license, r.licensed_by) for r in L.scan(df, **how).collect()}


def test_headers_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "r/LICENSE", "Title\n" + mit),
        (2, "r/a/b/c.txt", PROSE),
        (3, "r/a/COPYING.txt", gpl),
        (4, "r/a/own.txt", PROSE + "\nLicensed under the Apache License, Version 2.0."),
        (5, "r/x.txt", PROSE),
        (6, "s/x.txt", PROSE + "\nA licence to kill is no licence at all, said nobody, ever, in this long line"),
        (7, "r2/y.txt", PROSE),
        (8, "s/t/NOTICE", "nothing to see"),
        (9, "s/t/z.txt", PROSE),
    ]
    got = {k[0]: v for k, v in run(spark, rows).items()}
    assert got[1] == ("MIT", "MIT", "own") and got[2] == (None, "GPL-3.0", "r/a") and got[4] == ("Apache-2.0", "Apache-2.0", "own")
    assert got[5] == (None, "MIT", "r") and got[6] == got[7] == got[9] == (None, None, None)


def test_near_statements_and_the_top(spark):
    rows = [(1, "LICENSE", "This work is LICENSED under GNU General Public License version 3!"), (2, "deep/er/file", PROSE), (3, "file", "")]
    got = {k[0]: v for k, v in run(spark, rows).items()}
    assert got[1][0] == "GPL-3.0" and got[2] == got[3] == (None, "GPL-3.0", "")


def test_odd_rows(spark):
    line = "Released under the MIT License."
    rows = [(1, None, line), (1, None, line), (2, None, None), (None, "d/LICENSE", line), (3, "d/x", None), (4, "d/x", ""), (4, "d/x", ""), (5, "d/y", "word " * 50_000 + "\n" + line), (6, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    out = L.scan(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.own_license, r.license, r.licensed_by) for r in out}
    assert got[1] == got[5] == got[None] == ("MIT", "MIT", "own") and got[2] == got[6] == (None, None, None) and got[3] == got[4] == (None, "MIT", "d")
    assert L.scan(df.where("false")).count() == 0
    assert {r.license for r in L.scan(df.where("text is null")).collect()} == {None}


def test_ties_go_to_the_first_name(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."), (2, "a/x", PROSE)]
    got = {k[0]: v for k, v in run(spark, rows).items()}
    assert got[1][0] == got[2][1] == "Apache-2.0"


def test_wrapped_headers_and_files_without_a_marker(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one. */\nint main() { return 0; }"
    gpl = "#!/usr/bin/python\n#\n# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os\n"
    lgpl = "; This library is free software; you can redistribute it\n; under the terms of the GNU Lesser General Public\n; License version 2.1.\n(define x 1)"
    inside = "A first sentence. Redistribution and use in source and binary\nforms, with or without modification, are permitted provided that the\nfollowing conditions are met. " + "More prose comes here and goes on. " * 30
    rows = [(1, "b/LICENSE", bsd.replace("\n", " ")), (2, "b/x", PROSE), (3, "m.c", mpl), (4, "g.py", gpl), (5, "l.scm", lgpl), (6, "h", "// " + bsd.replace("\n", "\r\n// ", 1)), (7, "i", inside), (8, "b2/LICENSE", "nothing but words")]
    got = {k[0]: v for k, v in run(spark, rows).items()}
    assert got[1] == ("BSD-3-Clause", "BSD-3-Clause", "own") and got[2] == (None, "BSD-3-Clause", "b")
    assert [got[k][0] for k in (3, 4, 5, 6, 7, 8)] == ["MPL-2.0", "GPL-3.0", "LGPL-2.1", "BSD-3-Clause", "BSD-3-Clause", None]


def test_versions_and_kinds_are_told_apart(spark):
    said = {
        "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "// SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
        "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0",
        "SPDX-License-Identifier: ISC": "ISC",
        "# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "SPDX-License-Identifier: MIT OR Apache-2.0": None,
        "This program is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0",
        "                    GNU GENERAL PUBLIC LICENSE": None,
        "Eclipse Public License - v 2.0": "EPL-2.0",
        "Eclipse Public License - v 1.0": "EPL-1.0",
        "Apache License, Version 1.1": None,
        "Mozilla Public License Version 1.1": None,
        "This work is licensed under the European Union Public License, version 3.": None,
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
        "Licensed under CC BY 3.0.": None,
        "All rights reserved.": None,
    }
    rows = [(i, f"d{i}/LICENSE", text + "\n\n" + PROSE) for i, text in enumerate(said)]
    got = {k[0]: v[0] for k, v in run(spark, rows).items()}
    assert [got[i] for i in range(len(said))] == list(said.values())


def test_whole_texts_with_their_own_wording(spark):
    whole = {name: max((t for n, t in L.TEMPLATES if n == name), key=len) for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC")}
    wrap = lambda t: "\n".join(t[i : i + 78] for i in range(0, len(t), 78))
    rows = [(i, f"d{i}/LICENSE", "Copyright (c) 2020 A. Nobody and others\n\n" + wrap(t)) for i, t in enumerate(whole.values())]
    got = {k[0]: v[0] for k, v in run(spark, rows).items()}
    assert [got[i] for i in range(len(whole))] == list(whole)


def stated_by_hand(files, least=L.LEAST_COSINE):
    """(doc_id, path) -> licence, with every block compared to every template."""
    import math
    import re
    from collections import Counter

    terms = lambda t: re.findall(L.TERM, t.lower())
    speaks, blocks = [], []
    for doc, path, text in files:
        if text is None:
            continue
        direct = [x for x in text.split("\n") if re.search(L.MARKER, x)]
        if path is not None and re.search(L.LICENCE_FILE, path.rsplit("/", 1)[-1]):
            direct.append(text)
        direct = list(dict.fromkeys(direct))
        speaks += [x for x in direct if re.search(L.MARKER, x)]
        runs, last = [], "start"
        for line in re.split(r"\r\n|[\r\n\f]", text):
            kind = 0 if not re.search("[A-Za-z0-9]", line) else None if re.search(L.OPENER, line) else 1 if re.search(L.COMMENT, line) else 2
            if last == "start" or (kind is not None and last is not None and kind != last):
                runs.append([])
            runs[-1].append(re.sub(L.LEAD, "", line, count=1))
            last = kind
        runs = [" ".join(r) for r in runs]
        blocks += [((doc, path), b) for b in {*direct, *runs, *(x for r in runs for x in re.split(r"(?<=[.!?])[ \t]+", r))}]
    df = Counter(t for b in [*speaks, *(t for _, t in L.TEMPLATES)] for t in set(terms(b)))
    n = len(speaks) + len(L.TEMPLATES)
    weights = lambda t: {x: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[x])) + 1) for x, c in Counter(terms(t)).items()}
    size = lambda w: math.sqrt(sum(x * x for x in w.values()))
    known = [(name, weights(t), *rule) for (name, t), rule in zip(L.TEMPLATES, L.rules(), strict=True)]
    best = {}
    for key, block in blocks:
        w = weights(block)
        for name, v, needs, bars, weak in known:
            dot = sum(w.get(x, 0) * y for x, y in v.items())
            cos = round(dot / (size(w) * size(v)), 6) if dot else 0
            if cos >= least and all(set(g) & w.keys() for g in needs) and not set(bars) & w.keys():
                best[key] = min(best.get(key, (9, 0, "")), (weak, -cos, name))
    return {k: b[2] for k, b in best.items()}


def test_blocks_match_brute_force(spark):
    import random

    rnd = random.Random(3)
    words = "license licensed under the of version public general gnu mit apache software this is a file code terms 2.0 3 and free copyright".split()
    rows = []
    for i in range(60):
        name, text = rnd.choice(L.TEMPLATES)
        said = text.split()
        for _ in range(rnd.randrange(4)):
            said.insert(rnd.randrange(len(said) + 1), rnd.choice(words))
        lead = rnd.choice(["", "# ", " * ", "// "])
        lines = [PROSE, ""] + [lead + " ".join(said[j : j + 9]) for j in range(0, len(said), 9)] + ["", " ".join(rnd.choices(words, k=12)) + "."]
        rows.append((i, rnd.choice([f"d{i}/LICENSE", f"d{i}/x.c"]), rnd.choice(["\n", "\r\n"]).join(lines)))
    got = {k: v[0] for k, v in run(spark, rows).items() if v[0]}
    assert len(got) > 30 and got == stated_by_hand(rows)
