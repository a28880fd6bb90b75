"""Personal data against plain Python over the contract's own patterns."""

import hashlib
import re

import pytest
from hedonica.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    found = {k: [m.span() for m in re.finditer(p, text or "") if holds(k, m[0])] for k, p in PATTERNS.items()}
    joined = ",".join(f"{k}:{a}:{b}" for k, s in found.items() for a, b in s)
    return [len(s) for s in found.values()], hashlib.sha256(joined.encode()).hexdigest(), joined


TEXTS = [
    None, "", "nothing", "a@b.c_d@e.f", "a@b@c.d..e@f", "x.y+z@host-1.example.com, ü@é.de ab@c", "a@b.c" * 50,
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 1..2.3.4", "00000000300.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111", "1 4111111111111111", "12345678901234567890123",
    "+1 (383) 555-6083 +49-30.123456 +1 +12 +123456789 +(1) 2", "😀 +1 (383) 555-6083 😀 a@b.co",
    "+" * 50 + "1 2", "call +1 2 3 4 5 6 7 8 9 0", "5500 0000 0000 0004 10.0.0.1 me@x.org " * 200,
    "a" * 100_000, "a." * 50_000 + "@", "1." * 50_000, "a@" + "b." * 30_000, "1 " * 60_000, "+1" + "(" * 50_000,
]


def test_base_spans(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "a@b.c")]
    got = pii.digests(documents(rows, extra=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "a@b.c"
        counts, sha, joined = brute(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, r.doc_id
        assert r.base_sha256 == sha
        assert r.spans[: len(joined)] == joined


MORE = [
    ("pay to GB82 WEST 1234 5698 7654 32 today", "iban:7:34"),
    ("pay to GB82 WEST 1234 5698 7654 33 today", ""),
    ("DE89370400440532013000", "iban:0:22"),
    ("my SSN is 123-45-6789", "ssn:10:21"),
    ("part 123-45-6789", ""),
    ("SSN 000-45-6789", ""),
    ("Phone: (555) 123-4567", "local_phone:7:21"),
    ("invoice 555 123-4567", ""),
    ("phone order 555 123-4567", ""),
    ("Invoice 123-45-6789 SSN", "ssn:8:19"),
    ("order 555-123-4567 phone", "local_phone:6:18"),
    ("order 555-123-4567 (phone)", "local_phone:6:18"),
    ("order 555-123-4567, phone ahead", ""),
    ("Social-Security-Nr. 111-22-3333", "ssn:20:31"),
]


@pytest.mark.parametrize("text, want", MORE)
def test_added_spans(spark, documents, text, want):
    assert pii.digests(documents([text])).first().spans == want


FOLLOWED = [
    ("DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "iban:0:27"),
    ("DE89370400440532013000 BIC COBADEFF", "iban:0:22"),
    ("GB82 WEST 1234 5698 7654 32 2024 paid", "iban:0:27"),
    ("AB12 CDEF GHIJ KLMN DE89 3704 0044 0532 0130 00", "iban:20:47"),
    ("GB82 WEST 1234 5698 7654 32 DE89370400440532013000", "iban:0:27,iban:28:50"),
]


@pytest.mark.parametrize("text, want", FOLLOWED)
def test_account_numbers_before_other_words(spark, documents, text, want):
    assert pii.digests(documents([text])).first().spans == want


LISTS = [
    ("SSNs: 111-22-3333, 222-33-4444", "ssn:6:17,ssn:19:30"),
    ("SSNs: 111-22-3333, 222-33-4444 and 333-44-5555", "ssn:6:17,ssn:19:30,ssn:35:46"),
    ("Tel: (555) 123-4567 / (555) 987-6543", "local_phone:5:19,local_phone:22:36"),
    ("123-45-6789 (SSN)", "ssn:0:11"),
    ("invoice 555 123-4567, phone 555 987-6543, order 555 222-3333", None),
]


def test_context_in_lists_and_after(spark, documents):
    got = {r.doc_id: r.spans for r in pii.digests(documents([t for t, _ in LISTS])).collect()}
    assert [got[i] for i in range(4)] == [w for _, w in LISTS[:4]]
    assert "local_phone:28:40" in got[4] and "local_phone:48:60" not in got[4]


def test_redaction(spark, documents):
    rows = [
        (1, "mail a@b.co or call +1 (383) 555-6083."), (2, None), (3, ""), (4, "none"), (5, "1.2.3.4@x.com!"),
        (6, "😀 me@x.org and 10.0.0.1 é" * 300), (7, "a@b.c"),
    ]
    docs = documents(rows, extra=True).withColumnRenamed("key", "personal")
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1] == "mail <EMAIL> or call <PHONE>."
    assert texts[2] is None and texts[3] == "" and texts[4] == "none" and texts[7] == "<EMAIL>"
    assert "1.2.3.4" not in texts[5] and texts[5].endswith("!") and "x.com" not in texts[5]
    assert texts[6] == "😀 <EMAIL> and <IP> é" * 300


def test_overlapping_spans_are_one_place(spark):
    from pyspark.sql import functions as F

    found = ", ".join(
        f"array({'named_struct' + str((('start', a, 'end', b, 'score', 1.0))) if n in ('email', 'ip', 'card') else ''}) {n}"
        for n, a, b in [("email", 2, 5), ("ip", 4, 8), ("card", 2, 3), ("phone", 0, 0), ("iban", 0, 0), ("ssn", 0, 0), ("local_phone", 0, 0)]
    )
    df = spark.sql(f"select '0123456789' as text, {found}")
    kinds = [k.name for k in pii.KINDS]
    df = df.select("text", F.struct(*[F.col(k).cast(f"array<{pii.SPAN}>").alias(k) for k in kinds]).alias("f"))
    assert df.select(pii.without_spans(F.col("text"), F.col("f"))).first()[0] == "01<CARD>89"


def test_empty_table_and_plan(spark, documents):
    none = documents(["x"]).limit(0)
    assert pii.digests(none).collect() == [] and pii.redacted(none).collect() == []
    plan = pii.redacted(documents(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
