import re
from re import _parser

import pytest

from quarrylight.llm import licenses
from quarrylight.llm.license_rules import BASE, CONFIDENCE, rules

SCHEMA = "doc_id long, text string, label string, row int"
TEXTS = [
    None, "", "...", "MIT License mit license", "no words of interest here", "cc-by cc by-nc", "gnu general public licence", "mitlicense",
    "Licensed under the Apache License, Version 2.0; SPDX-License-Identifier: GPL-3.0-or-later (GNU General Public License v3 or later) CC BY-SA 4.0 all rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "LGPL v2.1+ and lgpl 3.0, agpl-3.0 only",
    "see the LICENSE file for details. Copyright (c) 2019 Somebody", "licensed under the terms of the Foo Bar license", "İMIT LICENSE KMIT license",
    "BSD-3-Clause or the two clause BSD license", "mit license " * 3000, "über MIT License ß GNU General Public License", "released into the public domain CC0 1.0 Universal",
]


def naive(text):
    text = text or ""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    plain = " ".join(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text))
    places = sorted((i, label) for p, label in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    found = [(m.start(), m.end(), r) for r in rules() if r.keyword in plain.lower() for m in re.finditer(r.regex, plain, re.ASCII)]

    def stays(a):
        for b in found:
            if b[2].grade < a[2].grade and b[0] < a[1] and b[1] > a[0]:
                return False
            if b is not a and b[2].grade == a[2].grade and b[0] <= a[0] and b[1] >= a[1] and (b[1] - b[0] > a[1] - a[0] or b[2].number < a[2].number):
                return False
        return True

    kept = [a for a in found if stays(a)] if len(found) < 500 else found[:1]
    base = sorted({label for _, label in places})
    return (
        len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base),
        ",".join(sorted({*base, *(k[2].label for k in kept)})), max((CONFIDENCE[k[2].grade] for k in kept), default=0.0),
    )


def test_scan_equals_naive_scan(spark):
    docs = [(i % 13 if i else None, t, "x", i) for i, t in enumerate(TEXTS + TEXTS[3:5])]
    got = licenses.scan(spark.createDataFrame(docs, SCHEMA).repartition(3)).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *naive(t)) for d, t, *_ in docs), key=str)


def test_spans_and_suppression(spark):
    text = "Under the GNU Lesser General Public License version 2.1 or later."
    row = licenses.scan(spark.createDataFrame([(1, text, "", 0)], SCHEMA)).first()
    assert [tuple(s) for s in row["spans"]] == [(10, 64, "lgpl-2.1-or-later")]
    assert row["base_labels"] == "" and row["score"] == 1.0


def test_no_text_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_dataframe_functions(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "MIT License", "", 0)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text, label", [
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("Mozilla Public License, version 2.0", "mpl-2.0"),
    ("http://creativecommons.org/licenses/by-nc-nd/2.5/", "cc-by-nc-nd-2.5"), ("the Boost Software License", "bsl-1.0"),
    ("Eclipse Public License 1.0", "epl-1.0"), ("GPLv2", "gpl-2.0"), ("AGPL-3.0-or-later", "agpl-3.0-or-later"), ("OFL 1.1", "ofl-1.1"),
])
def test_labels_of_the_rules(spark, text, label):
    assert label in licenses.scan(spark.createDataFrame([(1, text, "", 0)], SCHEMA)).first()["labels"].split(",")


def samples(tree):
    """Texts of every alternative of a parsed pattern; of a class each of its first signs."""
    out = [""]
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            new = [chr(value)]
        elif kind == "NOT_LITERAL":
            new = ["q"]
        elif kind == "IN":
            new = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value if str(k) in ("LITERAL", "RANGE")] or ["q"]
        elif kind == "SUBPATTERN":
            new = samples(value[3])
        elif kind == "BRANCH":
            new = [x for branch in value[1] for x in samples(branch)]
        else:
            assert kind == "MAX_REPEAT", kind
            low, high, inner = value
            new = [x * n for n in {low, max(low, 1)} for x in samples(inner)]
        out = [a + b for a in out for b in dict.fromkeys(new)]
    return out


def test_every_alternative_holds_its_keyword():
    texts = {}
    for rule in rules():
        for text in samples(_parser.parse(rule.pattern)):
            assert re.fullmatch(rule.pattern, text), (rule, text)
            assert rule.keyword in text, (rule, text)
            texts.setdefault(rule.number, text)
    assert len(texts) == len(rules())


SPLIT = [
    ("Q Public License 1.0", "qpl-1.0"), ("Q Public Licence", "qpl"), ("QPL 1.0", "qpl-1.0"), ("Licence Ouverte 2.0", "etalab-2.0"),
    ("Licence Ouverte", "etalab"), ("Etalab 2.0", "etalab-2.0"), ("see the licence for details", "unknown-license"),
]


def test_labels_of_split_rules(spark):
    got = licenses.scan(spark.createDataFrame([(n, text, "", 0) for n, (text, _) in enumerate(SPLIT)], SCHEMA)).collect()
    assert {r["doc_id"]: SPLIT[r["doc_id"]][1] in r["labels"].split(",") for r in got} == dict.fromkeys(range(len(SPLIT)), True)


def test_many_places_in_one_text(spark):
    text = "mit license, cc by; " * 4000
    row = licenses.scan(spark.createDataFrame([(1, text, "", 0)], SCHEMA)).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (8000, 0, 15_998, "cc-by,mit")
