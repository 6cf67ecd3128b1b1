"""Licence scan: sparse TF-IDF cosine to templates, then nearest-ancestor inheritance, built-in functions only.

Header blocks of every file (its lines that speak of a licence, its runs of
adjacent lines and their sentences, however wrapped) and the whole text of every
licence file are compared with templates. A file that states no licence takes
that of the nearest ancestor directory with a licence file.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textkiln.llm.common import checked_broadcast, cut

#: Cosine from which a block states a template's licence.
LEAST_COSINE = 0.6
#: Lines that hold one of these are header blocks, and the blocks that document frequencies count.
MARKER = r"(?i)licen[cs]|copyright|spdx|public domain|all rights reserved|permission is hereby"
#: Names of licence files.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
#: Terms of a text: runs of letters, and numbers with their dots.
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"

#: Line beginnings of comments, and those that open one (its next lines may have any form).
COMMENT = r"^\s*(?:\*|//|#|;|--|%|(?i:dnl|rem)\s)"
OPENER = r"^\s*(?:/\*|<!--)"
#: What is taken off a line's beginning.
LEAD = r"^\s*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|(?i:dnl|rem)\s)?\s*"
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce "
    "the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
    "notice appear in all copies."
)
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
_LIBRARY = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
_PLAIN, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
_CC = "This work is licensed under a Creative Commons {kind} 4.0 International License."

#: What files say to name a licence: the granting paragraphs of short texts, titles and standard headers of long ones, and short statements.
STATEMENTS = [
    ("MIT", ["Released under the MIT License.", "Licensed under the MIT license. See LICENSE in the project root for license information.", "MIT License", _MIT]),
    (
        "Apache-2.0",
        [
            "Licensed under the Apache License, Version 2.0.",
            "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
            "Apache License Version 2.0, January 2004",
        ],
    ),
    ("GPL-3.0", ["This work is licensed under the GNU General Public License, version 3.", _GPL.format(kind=_PLAIN, v=3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]),
    (
        "GPL-2.0",
        [
            "This work is licensed under the GNU General Public License, version 2.",
            "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2.",
            _GPL.format(kind=_PLAIN, v=2),
            "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        ],
    ),
    (
        "LGPL-2.1",
        [
            "This work is licensed under the GNU Lesser General Public License, version 2.1.",
            "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License version 2.1.",
            _LIBRARY.format(kind=_LESSER, v=2.1),
            "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        ],
    ),
    ("LGPL-3.0", ["This work is licensed under the GNU Lesser General Public License, version 3.", _LIBRARY.format(kind=_LESSER, v=3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]),
    ("AGPL-3.0", ["This work is licensed under the GNU Affero General Public License, version 3.", _GPL.format(kind=_AFFERO, v=3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"]),
    ("BSD-2-Clause", ["Licensed under the BSD 2-Clause License.", f"{_BSD}: {_BSD_2}", _BSD_2]),
    (
        "BSD-3-Clause",
        [
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            _BSD,
            "Licensed under the BSD 3-Clause License.",
            f"{_BSD}: {_BSD_2} {_BSD_3}",
            _BSD_3,
        ],
    ),
    ("ISC", ["Licensed under the ISC License.", "ISC License", _ISC]),
    (
        "MPL-2.0",
        [
            "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
            "Mozilla Public License Version 2.0",
        ],
    ),
    ("EPL-2.0", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Eclipse Public License - v 2.0"]),
    ("EPL-1.0", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0.", "Eclipse Public License - v 1.0"]),
    ("BSL-1.0", ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"]),
    ("Unlicense", ["This is free and unencumbered software released into the public domain."]),
    ("CC-BY-4.0", ["Licensed under CC BY 4.0.", _CC.format(kind="Attribution")]),
    ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0.", _CC.format(kind="Attribution-NonCommercial")]),
    ("CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0.", _CC.format(kind="Attribution-ShareAlike")]),
    ("CC-BY-ND-4.0", ["Licensed under CC BY-ND 4.0.", _CC.format(kind="Attribution-NoDerivatives")]),
    ("CC-BY-NC-SA-4.0", ["Licensed under CC BY-NC-SA 4.0.", _CC.format(kind="Attribution-NonCommercial-ShareAlike")]),
    ("CC-BY-NC-ND-4.0", ["Licensed under CC BY-NC-ND 4.0.", _CC.format(kind="Attribution-NonCommercial-NoDerivatives")]),
    ("CC0-1.0", ["Dedicated to the public domain under CC0 1.0 Universal."]),
]
#: GNU licences have identifiers that say whether later versions count.
_LATER = ("", "-only", "-or-later")
TEMPLATES = [(name, text) for name, texts in STATEMENTS for text in texts] + [
    (name, f"SPDX-License-Identifier: {name}{more}") for name, _ in STATEMENTS for more in (_LATER if "GPL" in name else _LATER[:1])
]

#: Terms that tell licences and their kinds apart.
NAMES = "mit apache gnu gpl lgpl agpl lesser affero mozilla mpl eclipse epl bsl boost bsd isc creative commons cc cc0 nc noncommercial sa sharealike nd noderivatives unlicense".split()
#: A block states a licence only with one of the key terms of the template (spellings of licence count as one).
SPELLINGS = "license licensed licence licenced licenses licences".split()
KEYS = [*SPELLINGS, "spdx", "permission", "redistribution", "redistributions", "endorse", "unencumbered", "domain"]
#: Texts without this hold no key term.
KEY = "(?i)licen[cs]|spdx|permission|redistribution|endorse|unencumbered|domain"


def rules() -> list[tuple[list[list[str]], list[str], int]]:
    """What a block must hold to state each template: (terms, one of each list; terms it must not hold; weak).

    Needed are a key term, the template's names and the numbers of its
    licence's name (a version 2.0 may be written 2); barred are the names that no template of the
    licence has. So a licence is not taken for another one whose statements
    read alike. A template that stands inside one of another licence is weak:
    it counts only where no other template is stated.
    """
    terms = [set(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    own: dict[str, set[str]] = {}
    for (name, _), found in zip(TEMPLATES, terms, strict=True):
        own.setdefault(name, set()).update(found & set(NAMES))
    out = []
    for (name, text), found in zip(TEMPLATES, terms, strict=True):
        numbers = [{x, re.sub(r"\.0$", "", x), x if "." in x else f"{x}.0"} for x in re.findall(r"[0-9]+(?:\.[0-9]+)*", name)]
        keys = found & set(KEYS) | (set(SPELLINGS) if found & set(SPELLINGS) else set())
        needs = [sorted(keys)] + [[x] for x in sorted(found & set(NAMES))] + [sorted(x) for x in numbers if found & x]
        weak = any(text in other and name != whose for whose, other in TEMPLATES)
        out.append((needs, sorted(set(NAMES) - own[name]), int(weak)))
    return out


def templates(spark: SparkSession) -> DataFrame:
    """(template, license, text, needs, bars, weak), from the fixed list."""
    rows = [{"template": i, "license": name, "text": text, "needs": n, "bars": b, "weak": w} for i, ((name, text), (n, b, w)) in enumerate(zip(TEMPLATES, rules(), strict=True))]
    fixed = F.from_json(F.lit(json.dumps(rows)), "array<struct<template: int, license: string, text: string, needs: array<array<string>>, bars: array<string>, weak: int>>")
    return spark.range(1).select(F.inline(fixed))


def _terms(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf) with tf = 1 + ln(count)."""
    each = df.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0))).alias("term"))
    return each.groupBy(key, "term").agg((1 + F.log(F.count(F.lit(1)).cast("double"))).alias("tf"))


def parent(path: Column) -> Column:
    """Directory of a path ('' for the top)."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def header_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, path, text): the runs of adjacent lines of ``files``, each as one line without comment signs.

    A line without a term ends a run, and so does the change between comment
    lines and others.
    """
    kind = lambda x: F.when(~x.rlike("[A-Za-z0-9]"), 0).when(x.rlike(OPENER), F.lit(None)).when(x.rlike(COMMENT), 1).otherwise(2)
    rows = files.select("doc_id", "path", F.split("text", "\\r\\n|[\\r\\n\\f]").alias("_lines"))
    rows = rows.withColumn("_kinds", F.transform("_lines", kind))
    # looks at the line before in a column of its own: an expression would be computed anew for every line
    breaks = lambda x, i: F.concat(F.when((i > 0) & (F.get("_kinds", i) != F.get("_kinds", i - 1)), "\f").otherwise(""), F.regexp_replace(x, LEAD, ""))
    return rows.select("doc_id", "path", F.explode_outer(F.split(F.array_join(F.transform("_lines", breaks), " "), "\f")).alias("text"))


def _tests(t: list, least: float) -> list[tuple[list[tuple[str, float]], float]]:
    """Each template's squared term weights, with the least sum that a block must share.

    A block's cosine to a template is at most |v of shared terms| / |v|.
    """
    by: dict[int, list[tuple[str, float]]] = {}
    for r in t:
        by.setdefault(r["template"], []).append((r["term"], r["v"] ** 2))
    return [(sorted(terms), (least - 1e-6) ** 2 * sum(v for _, v in terms)) for terms in by.values()]


def _reaches(terms: Column, tests: list) -> Column:
    """Whether a block's terms share enough weight with one of the templates to reach the least cosine."""
    # one literal each, so the plan stays small
    rows = F.from_json(F.lit(json.dumps([{"ts": [{"t": t, "v": v} for t, v in ts], "bound": bound} for ts, bound in tests])), "array<struct<ts: array<struct<t: string, v: double>>, bound: double>>")
    shared = lambda x: F.aggregate(x["ts"], F.lit(0.0), lambda s, y: s + F.when(F.array_contains(terms, y["t"]), y["v"]).otherwise(0.0))
    return F.exists(rows, lambda x: shared(x) >= x["bound"])


def _near(rows: DataFrame, blocks: Column, tests: list) -> DataFrame:
    """(doc_id, path, text): the blocks of every row that hold a key term and could reach a template.

    Terms leave the generator with their block: a filter on a plain column
    would compute them anew for every template term.
    """
    words = lambda x: F.split(F.lit(" ".join(sorted(x))), " ")
    looked = words({term for ts, _ in tests for term, _ in ts} | set(KEYS))
    with_terms = F.transform(F.filter(blocks, lambda x: x.rlike(KEY)), lambda x: F.struct(x.alias("text"), F.array_intersect(F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0)), looked).alias("terms")))
    each = rows.select("doc_id", "path", F.explode_outer(with_terms).alias("p"))  # the inner form computes its array twice
    return each.where(F.arrays_overlap("p.terms", words(KEYS))).where(_reaches(F.col("p.terms"), tests)).select("doc_id", "path", "p.text")


def _idf(speaks: DataFrame, known: DataFrame) -> tuple[DataFrame, float]:
    """(term, idf) of the blocks (text) that speak of a licence and the templates, and the idf of any other term.

    Document frequencies count every such block of the corpus; idf =
    ln((1 + N) / (1 + df)) + 1. Blocks are counted where they lie (the empty
    term counts the blocks), so only sums by term are shuffled.
    """
    every = F.concat(F.array(F.lit("")), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))))
    counts = speaks.select("text").unionByName(known.select("text")).select(F.explode(every).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counts = cut(counts, "license-df")
    total = counts.where("term = ''").first()["df"]
    return counts.where("term <> ''").select("term", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf")), math.log(1.0 + total) + 1


def block_licenses(blocks: DataFrame, t: DataFrame, known: DataFrame, idf: DataFrame, rare: float, least: float = LEAST_COSINE) -> DataFrame:
    """(block, license, score) of the distinct blocks (block, text) that state a licence.

    ``t`` holds the weights of the templates' terms, ``rare`` the idf of a term
    that ``idf`` lacks. A template must agree in its names and version (see
    ``rules``). Ties go to the first licence by name, weak templates last.
    """
    w = F.col("tf") * F.coalesce("idf", F.lit(rare))
    weighted = cut(_terms(blocks, "block").join(checked_broadcast(idf), "term", "left").select("block", "term", w.alias("w")), "license-weights")
    # as many rows as the fixed templates have terms
    size_t = F.broadcast(t.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("tn")))
    told = {x for needs, bars, _ in rules() for x in [*bars, *(y for n in needs for y in n)]}
    size_b = weighted.groupBy("block").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("bn"), F.collect_set(F.when(F.col("term").isin(sorted(told)), F.col("term"))).alias("told"))
    dots = weighted.join(F.broadcast(t), "term").groupBy("block", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(size_t, "template").join(F.broadcast(known.drop("text")), "template").join(size_b, "block")
    agrees = F.forall("needs", lambda n: F.arrays_overlap(n, F.col("told"))) & ~F.arrays_overlap("bars", "told")
    scored = scored.where(agrees).select("block", "license", "weak", F.round(F.col("dot") / (F.col("tn") * F.col("bn")), 6).alias("score"))
    best = scored.where(F.col("score") >= least).groupBy("block").agg(F.min(_rank("score", "weak", "license")).alias("b"))
    return best.select("block", "b.license", "b.weak", (-F.col("b.s")).alias("score"))


def _rank(score: str, weak: str, name: str) -> Column:
    """Sorts statements: weak ones last, then larger scores, then names."""
    return F.struct(F.col(weak).alias("weak"), (-F.col(score)).alias("s"), F.col(name).alias("license"))


def scan(files: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """doc_id, path, own_license, own_score, license and licensed_by of every row of ``files`` (doc_id, path, text).

    ``license`` is the file's own or that of the nearest ancestor directory
    with a stated licence file (its best block; ties: first licence by name);
    ``licensed_by`` is ``own`` or the directory ('' is the top; null: no
    licence). Null and empty texts state nothing, null paths inherit nothing;
    rows that share id and path share their blocks. Equal blocks are scored
    once. An empty table gives an empty result.

    A block states a licence only with a key term, the names and the version
    of the template (see ``rules``). Its cosine is at most the length of the
    template's terms that it holds over that template's whole length; blocks
    without a key term and blocks that cannot reach ``least`` by that are left
    out where they lie, so no term of theirs is ever a row.
    """
    name = F.regexp_extract("path", "[^/]*$", 0)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(MARKER))
    none = F.array().cast("array<string>")
    whole = F.when(F.coalesce(name.rlike(LICENCE_FILE), F.lit(False)), F.array("text")).otherwise(none)
    given = files.where("text is not null")
    marked = F.filter(F.array_distinct(F.concat(lines, whole)), lambda x: x.rlike(MARKER))
    known = templates(files.sparkSession)
    idf, rare = _idf(given.where(F.col("text").rlike(MARKER)).select(F.explode(marked).alias("text")), known)
    t = _terms(known, "template").join(idf, "term").select("template", "term", (F.col("tf") * F.col("idf")).alias("v"))
    t = cut(t, "license-templates")
    tests = _tests(t.collect(), least)
    # lines, licence files, header blocks and their sentences that could reach a template
    key = given.where(F.col("text").rlike(KEY))
    direct = key.select("doc_id", "path", F.array_distinct(F.concat(lines, whole)).alias("parts")).where(F.size("parts") > 0)
    runs = _near(header_blocks(key), F.array("text"), tests)
    parts = _near(runs, F.array_distinct(F.concat(F.array("text"), F.split("text", r"(?<=[.!?])[ \t]+"))), tests)
    found = cut(_near(direct, F.col("parts"), tests).unionByName(parts).select("doc_id", "path", F.md5("text").alias("block"), "text"), "license-blocks")
    blocks = found.groupBy("block").agg(F.first("text").alias("text"))
    stated = found.select("doc_id", "path", "block").join(block_licenses(blocks, t, known, idf, rare, least), "block")
    best = stated.groupBy("doc_id", "path").agg(F.min(_rank("score", "weak", "license")).alias("b"))
    own = cut(best.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), F.col("b.license").alias("own_license"), F.col("b.weak").alias("_weak"), (-F.col("b.s")).alias("own_score")), "license-own")
    files = files.select("doc_id", "path").join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left").drop("_id", "_path", "_weak")
    files = cut(files.withColumn("dir", parent(F.col("path"))), "license-files")
    declared = own.where(F.regexp_extract("_path", "[^/]*$", 0).rlike(LICENCE_FILE)).groupBy(parent(F.col("_path")).alias("_from")).agg(F.min(_rank("own_score", "_weak", "own_license")).alias("b"))
    declared = declared.select("_from", F.col("b.license").alias("dir_license"))
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = files.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    above = above.withColumn("_anc", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(declared, F.col("_anc") == F.col("_from")).groupBy("dir").agg(F.max(F.struct("depth", "_from", "dir_license")).alias("b"))
    nearest = nearest.select(F.col("dir").alias("_dir"), F.col("b._from").alias("_from"), F.col("b.dir_license").alias("dir_license"))
    out = files.join(nearest, F.col("dir") == F.col("_dir"), "left")
    by = F.when(F.col("own_license").isNotNull(), "own").otherwise(F.col("_from"))
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "dir_license").alias("license"), by.alias("licensed_by"))
