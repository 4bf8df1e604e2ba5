"""Licence rules: a check by all rules without their gates, and literal texts."""

import re

import pytest

from chirrup.llm import license_scan as ls
from chirrup.llm.license_rules import BASE, RULES
from helpers_llm import documents, real

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
    "the Software without restriction, including without limitation the rights to use, copy, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
TEXTS = [
    ("", ""),
    ("Nothing to see here, the mit of committing.", ""),
    ("Released under the MIT License.", "mit"),
    ("under-the--MIT (license)", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("// SPDX-License-Identifier: Foo-1.0", "other-tagged"),
    (MIT, "mit"),
    ("GPLv3 and MIT licence", "gpl-3.0,mit"),
]


def brute(text):
    """Words by a pattern, all rules at every place, all pairs compared."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    line = " " + " ".join(words) + " "
    found = []
    for r in RULES:
        for m in re.finditer("(?<= )(?:" + r.pattern + ")(?= )", line):
            a = line[: m.start()].count(" ") - 1
            found.append((-r.priority, -(m.end() - m.start()), a, r.number, r.label, a + m.group().count(" ")))
    kept = [d for d in found if not any(e < d and e[2] <= d[2] and d[5] <= e[5] for e in found)]
    base = [(k, label) for p, label in BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    labels = {d[4] for d in kept} | {label for _, label in base}
    score = max([-d[0] for d in kept] + ([80] if base else []) + [0]) / 100
    places = [k for k, _ in base]
    return (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), score)


def test_literal_texts(spark):
    got = {r["doc_id"]: r["labels"] for r in ls.report(documents(spark, [(k, t) for k, (t, _) in enumerate(TEXTS)])).collect()}
    assert got == {k: labels for k, (_, labels) in enumerate(TEXTS)}


def test_equals_all_rules_without_gates(spark):
    texts = [t for t, _ in TEXTS] + [r[1] for r in real("documents")] + ["cc by nc " * 40, "caféMIT license", " the MIT license ", "a\x00MIT\x00license"]
    texts += [r.pattern.split("(")[0] for r in RULES] + [MIT * 300]
    got = ls.report(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [tuple(r)[1:8] for r in got] == [brute(t) for t in texts]


def test_nulls_repeats_and_empty_tables(spark):
    docs = documents(spark, [(None, None), (1, "MIT License"), (1, "MIT License"), (None, "MIT License")])
    rows = [tuple(r)[:8] for r in ls.report(docs).collect()]
    assert sorted(rows, key=repr) == sorted([(None, 0, 0, None, None, "", "", 0.0)] + [(i, 2, 0, None, None, "", "mit", 0.5) for i in (1, 1, None)], key=repr)
    assert ls.report(docs.limit(0)).collect() == []


def test_rules():
    assert len(RULES) >= 200 and all(r.keyword == r.keyword.lower() for r in RULES)
    assert ls.settled([(50, 0, 5, 9), (80, 0, 5, 3), (80, 3, 8, 1), (50, 4, 8, 0)]) == [(80, 0, 5, 3), (80, 3, 8, 1)]


@pytest.mark.parametrize("text,places", [("under the MIT license", [0]), ("x cc by nc cc by nc", [1, 4]), ("apache license version 20", [])])
def test_places_of_base_phrases(spark, text, places):
    (r,) = ls.scan(documents(spark, [(1, text)])).collect()
    assert [b["first"] for b in r["base"]] == places
