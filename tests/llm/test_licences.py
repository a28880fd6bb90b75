"""The licence classifier on notices, variations of them, and ordinary text."""

import math
import re

import pytest
from hedonica.llm import licences as Z
from pyspark.sql import functions as F

PLAIN = [f"the {a} of {b} is not {c} at all in this year of {a}" for a in ("house", "garden", "river") for b in ("my friend", "a cat") for c in ("big", "red", "old")]
LICENCED = [
    (1, "intro words here\nReleased under the MIT License.\nmore words", "mit", 0),
    (2, "Licensed under the Apache License, Version 2.0 (the License)", "apache-2.0", 0),
    (3, "x\n\nThis work is licensed under the GNU General Public License, version 2.", "gpl", 1),
    (4, "Copyright 2020 Somebody. All rights reserved.", "proprietary", 0),
    (5, "Licensed under CC BY-NC 4.0.", "cc-by-nc", 0),
    (6, "  LICENSED UNDER CC BY 4.0  ", "cc-by", 0),
    (7, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd", 0),
    (8, "words " * 100_000 + "\nSPDX-License-Identifier: MPL-2.0", "mpl-2.0", 0),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(100 + i, t) for i, t in enumerate(PLAIN * 3)] + [(i, t) for i, t, _, _ in LICENCED]
    rows += [(9, None), (10, ""), (11, "\n\n"), (12, "license"), (13, "he rights the boat with all of it"), (1, LICENCED[0][1]), (None, "Released under the MIT License.")]
    rows += [(14, "the public is free to use the software house of any kind without a permit for the garden")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(0) for c in ("family", "p", "terms", "pairs", "features")})
    return Z.scan(df).collect()


def test_notices_are_found(found):
    got = sorted((r.doc_id, r.family, r.paragraph) for r in found if r.doc_id is not None)
    assert got == sorted([(i, f, p) for i, _, f, p in LICENCED] + [(1, "mit", 0)])
    assert [r.family for r in found if r.doc_id is None] == ["mit"]
    assert all(0.5 <= r.probability <= 1 and r.similarity >= Z.SHARED for r in found)


def test_every_notice_is_recognised(spark, documents):
    texts = [(f, t) for f, ts in Z.FAMILIES.items() for t in ts]
    got = Z.scan(documents([(i, t) for i, (_, t) in enumerate(texts)])).collect()
    right = sum(texts[r.doc_id][0] == r.family for r in got)
    assert right >= 0.95 * len(texts) and right >= 0.97 * len(got)


@pytest.mark.parametrize("around", [50, 100, 300])
def test_notices_inside_long_lines_are_found(spark, documents, around):
    texts = [(f, t) for f, ts in Z.FAMILIES.items() for t in ts[:2]]
    plain = " and so ".join(PLAIN * 5).split()
    assert len(plain) >= 300
    rows = [(i, " ".join([*plain[: around // 2], t, *plain[-(around // 2) :]])) for i, (_, t) in enumerate(texts)]
    got = Z.scan(documents(rows + [(100 + i, t) for i, t in enumerate(PLAIN)])).collect()
    right = {r.doc_id for r in got if r.doc_id < 100 and texts[r.doc_id][0] == r.family}
    assert len(right) >= 0.95 * len(texts)
    assert not [r for r in got if r.doc_id >= 100]


def test_notices_of_two_families_in_one_line(spark, documents):
    plain = " ".join(PLAIN * 2)
    line = f"{plain} Released under the MIT License. {plain} Licensed under CC BY-NC 4.0. {plain}"
    got = Z.scan(documents([(1, line), (1, line)] + [(100 + i, t) for i, t in enumerate(PLAIN)])).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == [(1, 0, "cc-by-nc")] * 2 + [(1, 0, "mit")] * 2


# None of these is a sentence of ``licence_texts``.
WORDINGS = [
    ("mit", "This software is released under the MIT license."),
    ("mit", "The code in this repository is licensed under the MIT License, see LICENSE."),
    ("mit", "Copyright 2019 Jane Doe. Licensed under the terms of the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this tool"),
    ("apache-2.0", "Distributed under the Apache License, Version 2.0"),
    ("apache-2.0", "This package is released under the Apache 2.0 license."),
    ("apache-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0.txt"),
    ("gpl", "This package is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This software is licensed under the GNU General Public License, version 2."),
    ("gpl", "It is distributed in the hope that it will be useful, but without any warranty"),
    ("bsd", "Redistribution and use in source and binary forms are permitted provided that the following conditions are met"),
    ("bsd", "Use of this code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("mpl-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "Licensed under the Mozilla Public License, v. 2.0"),
    ("cc-by", "The text is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Content licensed under CC BY 4.0 unless noted"),
    ("cc-by-nc", "This dataset is licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Images are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("public-domain", "The author has waived all copyright and related or neighboring rights to this work"),
    ("public-domain", "Dedicated to the public domain under CC0 1.0"),
    ("proprietary", "Copyright 2021 Example Corp. All rights reserved worldwide."),
    ("proprietary", "Unauthorized copying of this software via any medium is strictly prohibited"),
]
UNKNOWN = [
    "Licensed under the X11 License. See LICENSE file in the project root for full license information.",
    "Licensed under the Zlib License. See LICENSE file in the project root for full license information.",
    "Released under the WTFPL License.", "Licensed under the Ruby License, Version 2.0.",
    "SPDX-License-Identifier: PostgreSQL", "This work is licensed under the Open Database License, version 1.0.",
    "The following conditions are met by all applicants of the school",
    "The public is free to use the software of the house without a licence for the garden",
]
APACHE = """/*
 * Licensed under the Apache License,
 * Version 2.0 (the "License"); you may not
 * use this file except in compliance with
 * the License.
 */
int main() {}
"""
LAID_OUT = [
    ("Released under the\nMIT License.", [("mit", 0)]),
    ("# This program is free software: you can\n# redistribute it and/or modify it under the terms\r\n# of the GNU General Public\n# License\n", [("gpl", 0)]),
    (APACHE, [("apache-2.0", 0)]),
    ("one\n\n \n--\ntwo\n//\n// Released under the MIT\n// License.\n", [("mit", 2)]),
    ("This is free and unencumbered software\nreleased into the public\ndomain.", [("public-domain", 0)]),
    ("Released under\n\nthe MIT License.", []),
]


@pytest.fixture(scope="module")
def judged(spark):
    """All of the texts above in one table with ordinary ones."""
    texts = [t for _, t in WORDINGS] + UNKNOWN + [t for t, _ in LAID_OUT]
    df = spark.createDataFrame([*enumerate(texts), *[(1000 + i, t) for i, t in enumerate(PLAIN)]], "doc_id long, text string")
    got = {}
    for r in Z.scan(df).collect():
        got.setdefault(r.doc_id, []).append((r.family, r.paragraph))
    return got


def test_unseen_wordings(judged):
    got = [{f for f, _ in judged.get(i, [])} for i in range(len(WORDINGS))]
    right = sum(family in found for found, (family, _) in zip(got, WORDINGS))
    wrong = sum(len(found - {family}) for found, (family, _) in zip(got, WORDINGS))
    assert right >= 0.9 * len(WORDINGS) and wrong <= 0.05 * len(WORDINGS), [
        (w, g) for w, g in zip(WORDINGS, got) if g != {w[0]}
    ]


def test_near_notices_are_unknown(judged):
    assert {UNKNOWN[i]: judged[n] for i, n in enumerate(range(len(WORDINGS), len(WORDINGS) + len(UNKNOWN))) if n in judged} == {}
    assert not [i for i in judged if i >= 1000]


def test_wrapped_notices(judged):
    first = len(WORDINGS) + len(UNKNOWN)
    assert [judged.get(first + i, []) for i in range(len(LAID_OUT))] == [w for _, w in LAID_OUT]


def brute(text):
    """(paragraph, word, words, best share of each family) of every window of a text."""

    def tokens(t):
        return [w.lower() for w in re.findall(r"[^\W_]+", t)]

    def both(w):
        return set(zip(w, w[1:]))

    for p, part in enumerate(re.split(r"\n[\W_]*\n", text)):
        w = tokens(part)
        for at in range(0, len(w), Z.WINDOW_STEP):
            mine = w[at : at + 16]
            share = {
                f: max(len(both(mine) & both(tokens(n))) / min(15, len(both(tokens(n)))) for n in ns)
                for f, ns in Z.FAMILIES.items()
            }
            yield p, at, mine, share


def test_windows_and_shares_as_by_brute_force(spark):
    some = [t for ns in Z.FAMILIES.values() for t in ns]
    texts = [f"{' '.join(PLAIN[: i % 4])}\n{a}\n{'-' * (i % 3)}\n{b}" for i, (a, b) in enumerate(zip(some, some[5:]))]
    texts += [" ".join(t.split()[i::2]) for i in range(2) for t in some] + [a[: len(a) // 2] + b for a, b in zip(some, some[3:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = Z.Anchors.of(spark)
    found = Z.windows(Z.paragraphs(df).where(known.among(F.col("text"))), known)
    shares = found.crossJoin(F.broadcast(Z.notices(spark)))  # a fixture: every window with every family
    shares = shares.withColumn("share", Z.best_share(Z.let(F.col("words"), Z.pairs), F.col("pairs")))
    got = {(r.doc_id, r.paragraph, r.word, r.family): r.share for r in shares.collect()}
    near = 0
    for i, text in enumerate(texts):
        for p, at, _, share in brute(text):
            for family, s in share.items():
                if s >= Z.NEAR:
                    near += 1
                    assert got[i, p, at, family] == pytest.approx(s), (text, p, at, family)
    assert near > 200


def test_anchors_are_as_many_as_exactness_needs(spark):
    for row in Z.notices(spark).collect():
        for n in row.pairs:
            assert len(Z.anchors(n)) == len(n) - math.ceil(Z.NEAR * min(len(n), 15)) + 1
            assert len(set(n) - set(Z.anchors(n))) < Z.NEAR * min(len(n), 15)


def test_score_that_few_exceed(spark):
    some = spark.createDataFrame([(i / 1000,) for i in range(1000)], "score double")
    assert 0.993 <= Z.reached(some) <= 0.996
    assert Z.reached(some.limit(0)) == 0
    assert Z.reached(spark.createDataFrame([(0.25,)] * 3, "score double")) == 0.25


def test_empty_table_and_plan(spark, documents):
    df = Z.scan(documents(["x"], extra=True).limit(0))
    assert df.collect() == []
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
