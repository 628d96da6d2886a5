"""Operator 13 against every rule on every text, without keywords or order."""

import re

import pytest
from pyspark.sql import functions as F

from casebook.llm import licenses, signatures
from casebook.llm.queries import op13_license_scan

SF = "/root/testdata/sf0.001"
RULES = signatures.rules()
COMPILED = ([(re.compile(x), label, p, i) for _, x, label, p, i in RULES]
            + [(re.compile(rf"(?<= )(?:{p})(?= )"), label, 0, -1 - i) for i, (p, label) in enumerate(signatures.BASE)])
WEIGHT = {0: licenses.BASE_WEIGHT} | licenses.WEIGHT


def plain(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    norm = " " + " ".join(words) + " "
    hits = []
    for x, label, p, i in COMPILED:
        for m in x.finditer(norm):
            s = norm[:m.start()].count(" ") - 1
            hits.append((s, s + 1 + m[0].count(" "), label, p, i))

    def covered(h):
        return any(o[3] > 0 and o[3] <= h[3] and o[0] <= h[0] and o[1] >= h[1] and ((o[:2] != h[:2]) or o[3:] < h[3:]) for o in hits)

    kept = [h for h in hits if h[3] == 0 or not covered(h)]
    base = [h for h in hits if h[3] == 0]
    starts = [h[0] for h in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({h[2] for h in base})),
            ",".join(sorted({h[2] for h in kept})), max((WEIGHT[h[3]] for h in kept), default=0.0), sorted(h[:4] for h in kept))


LINES = [
    "SPDX-License-Identifier: Apache-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "All rights reserved.",
    "Licensed under CC BY-NC 4.0.", "CC BY-SA 4.0 and CC-BY 3.0; cc by", "Permission is hereby granted, free of charge, to any person obtaining a copy "
    "of this software and associated documentation files", "GNU Lesser General Public License v2.1", "Mozilla Public License Version 2.0 (MPL 2.0)",
    "https://creativecommons.org/licenses/by-sa/4.0/", "See the LICENSE file for details.", "Copyright (c) 2021 2022 Somebody. All rights reserved.",
    "either version 2 of the License, or (at your option) any later version", "general public license general public license", "GPLv3 or GPL-2.0+",
    "BSD 3-Clause License; 2-clause BSD", "no license here, nothing general, public", "public domain", "released into the public domain",
    "general public licen\u212ae \u212a cc by", "CC\u212a by ALL RIGHTS RESERVED İ general publİc license", "Q Public License, Qt Public License",
    "proprietary and confidential: unauthorized copying of this file is strictly prohibited", "rights reserved all rights", "all rights", "x" * 5,
]


@pytest.fixture(scope="module")
def rows():
    some = [(i, t) for i, t in enumerate(LINES)] + [(100, "\n".join(LINES)), (101, None), (102, ""), (103, " .,;"), (207, "MIT license"), (207, "MIT license"),
                                                   (None, "apache license"), (104, "word " * 60000 + "cc by " * 4000), (105, "cc by 4.0\u0001 x")]
    return some


def test_every_line_against_plain(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("row", "norm", "hits", "present", "tried", "n_words", "label")])
    got = [
        (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"],
         [tuple(d) for d in r["detections"]]) for r in licenses.detect(docs.repartition(3)).collect()]
    want = [(i, *plain(t)) for i, t in rows]
    order = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=order) == sorted(want, key=order)
    labels = {r[0]: r[6] for r in got}
    assert labels[0] == "spdx-apache-2.0" and "gpl-3.0" in labels[3] and labels[18] == ""


def test_every_rule_has_its_keyword():
    """A match without the rule's keyword among its words would be lost by the gate."""
    assert len(RULES) >= 200 and len({r[4] for r in RULES}) == len(RULES)
    for keyword, x, label, priority, _ in RULES:
        body = re.sub(r"\(\?(?:[^()]|\([^()]*\))*\)[?*]", "", x[6:-5]).replace("licen[cs]e", "license")
        assert re.search(rf"(?<![a-z0-9]){re.escape(keyword)}(?![a-z0-9])", body), (keyword, x)
        assert 1 <= priority <= 5 and label


def test_query_against_plain(spark):
    got = {r["doc_id"]: r for r in op13_license_scan(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d["doc_id"]]
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == plain(d["text"])[:7]


def test_empty_table_and_own_rules(spark):
    docs = spark.createDataFrame([(1, "beer for all, more beer")], "doc_id long, text string")
    assert licenses.detect(docs.limit(0)).collect() == []
    own = [("beer", "(?<= )(?:more )?beer(?= )", "beer", 2, 0)]
    r = licenses.detect(docs, rules=own, base=()).first()
    assert r["labels"] == "beer" and [tuple(x) for x in r["detections"]] == [(0, 1, "beer", 2), (3, 5, "beer", 2)] and r["n_base"] == 0
