"""Token counts by a two-tier lookup, without a shuffle of what the texts are cut into.

Texts are cut before every space that a character other than white space follows. A
byte-level vocabulary of this kind always starts a pre-token there, so parts are encoded
apart; a run of white space of any kind stays in one part. The first tier is a compact table of the corpus's frequent parts and their lengths in tokens, broadcast to
all tasks: parts joined into one string, and one byte a length. The second tier is the
worker's cache of what the first one misses, filled by the library.

Which parts are frequent is a mergeable summary of all texts: a task counts its parts and
keeps the ``SUMMARY`` most frequent whenever its counter is full (the count of the last one is
then taken off all, so no part in more than 1/SUMMARY of its parts is lost). Only summaries
are shuffled. The table never changes a result, only its cost.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedonica.llm.common import CACHED_CHARS, Remembered, tokenizer

BYTE_BPE = "byte_bpe_50k.json"
LIMIT = 1024
# Bounds of the first tier: entries of one task's summary, and of the table.
SUMMARY = 4_096
TABLE = 32_768
# Misses that a worker remembers, twice at most: about 150 MB.
CACHED_PARTS = 400_000
PART = re.compile(r" ?(?:[^ ]+| +(?!\S))+")
JOIN = "\x00"


class PartLengths:
    """Numbers of tokens, from the table first, then from what the library said before."""

    def __init__(self, name: str, parts: str, lengths: np.ndarray):
        tok = tokenizer(name)
        first = dict(zip(parts.split(JOIN), lengths.tolist())) if len(lengths) else {}

        def library(part: str) -> int:
            return len(tok.encode(part, add_special_tokens=False).ids)

        second = Remembered(library, CACHED_PARTS)

        def length(part: str) -> int:
            n = first.get(part)
            return second[part] if n is None else n

        self.library, self.length = library, length
        added = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)").search

    def of(self, text: str | None) -> int:
        """Tokens of a whole text. One that holds a special string is encoded as a whole."""
        if not text:
            return 0
        if self.special(text):
            return self.library(text)
        return sum(map(self.length, PART.findall(text)))


@lru_cache(maxsize=2)
def part_lengths(name: str, parts: str, lengths: bytes) -> PartLengths:
    return PartLengths(name, parts, np.frombuffer(lengths, dtype=np.uint8))


def frequent_parts(docs: DataFrame, text: str = "text", size: int = TABLE) -> list[str]:
    """The corpus's most frequent short parts, at most ``size``, from summaries of all texts."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                counts.update(PART.findall(value.as_py() or ""))
                if len(counts) > 32 * SUMMARY:
                    counts = _reduced(counts)
        kept = [(p, n) for p, n in _reduced(counts).items() if len(p) <= CACHED_CHARS and JOIN not in p]
        parts, numbers = zip(*kept) if kept else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.string()), pa.array(numbers, pa.int64())], ["part", "n"]
        )

    top = (
        docs.select(text)
        .mapInArrow(summaries, "part string, n bigint")
        .groupBy("part")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "part")
        .limit(size)
    )
    return [r["part"] for r in top.select("part").toLocalIterator()]


def _reduced(counts: Counter) -> Counter:
    top = counts.most_common(SUMMARY + 1)
    off = top[-1][1] if len(top) > SUMMARY else 0
    return Counter({p: n - off for p, n in top[:SUMMARY] if n > off})


def length_table(parts: list[str], vocabulary: str = BYTE_BPE) -> tuple[str, bytes]:
    """The compact table; parts of more than 255 tokens are left to the second tier."""
    encoded = tokenizer(vocabulary).encode_batch(parts, add_special_tokens=False)
    kept = [(p, len(e.ids)) for p, e in zip(parts, encoded) if len(e.ids) < 256]
    return JOIN.join(p for p, _ in kept), bytes(n for _, n in kept)


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """``docs`` without its text: ``doc_id, n_bytes, n_tokens`` for every row.

    NULL and empty texts have none; repeated rows stay; an empty table gives no rows; any
    other columns of ``docs`` are left out.
    """
    table = docs.sparkSession.sparkContext.broadcast(
        length_table(frequent_parts(docs, text), vocabulary)
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = part_lengths(vocabulary, *table.value).of
        for batch in batches:
            n = [tokens_of(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, text)
    return rows.mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint")
