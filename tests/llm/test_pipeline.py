"""The pipeline against its stages in plain Python."""

from collections import defaultdict

import __spark_entry__ as entry
import corpus_pipeline as P
import numpy as np
from hedonica import session
from hedonica.llm.common import table
from hedonica.llm.word_ids import word_ids
from hedonica.session import written
from test_decontaminate import brute as contamination
from test_pii import PATTERNS, holds
from test_quality import brute as measures
from test_simhash import brute_fingerprint, parts


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert [n for n, _ in P.STAGES] == [
        "quality rules", "SimHash near-dedup", "benchmark decontamination", "PII", "packing",
    ]


def test_stages(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    items = [tuple(r) for r in table(spark, small_dir, "benchmark").select("item_id", "text").collect()]
    at, seen = docs, []
    for name, stage in P.STAGES:
        out = written(stage(spark, at, small_dir), name.replace(" ", "-"))
        if name != "packing":
            assert out.columns == docs.columns, name
        seen.append([r.asDict() for r in out.collect()])
        at = out
    rows = [r.asDict() for r in docs.collect()]
    kept = {r["doc_id"] for r in seen[0]}
    failed = {r["doc_id"] for r in rows if measures(r["text"])[5]}
    assert not kept & failed and len(kept) > 0.6 * len(rows)

    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in seen[0]}
    root, least = parts(fps.values()), {}
    for d, fp in fps.items():
        least[root[fp]] = min(d, least.get(root[fp], d))
    assert sorted(r["doc_id"] for r in seen[1]) == sorted(least.values())

    clean = [r for r in seen[1] if not ((c := contamination(r["text"], items))[1] and 20 * c[1] >= c[0])]
    assert sorted(r["doc_id"] for r in seen[2]) == sorted(r["doc_id"] for r in clean)

    import re

    before = {r["doc_id"]: r["text"] for r in seen[2]}
    assert before.keys() == {r["doc_id"] for r in seen[3]}
    for r in seen[3]:
        assert r["n_chars"] == len(r["text"])
        spots = [m.span() for k, p in PATTERNS.items() for m in re.finditer(p, before[r["doc_id"]]) if holds(k, m[0])]
        if not spots:
            assert r["text"] == before[r["doc_id"]] or re.search("<(IBAN|SSN|LOCAL_PHONE)>", r["text"])
        for a, b in spots:
            assert before[r["doc_id"]][a:b] not in r["text"]

    ids = {r["doc_id"]: len(np.frombuffer(word_ids().of(r["text"]), "<u4")) + 1 for r in seen[3]}
    packed = defaultdict(int)
    for r in seen[4]:
        packed[r["doc_id"]] += r["length"]
    assert packed == ids


def test_run_leaves_only_its_result(spark, small_dir):
    known = set(session.paths)
    got = P.run(spark, small_dir)
    assert got.columns[:2] == ["doc_id", "start"] and got.count() > 0
    assert len(set(session.paths) - known) == 1
