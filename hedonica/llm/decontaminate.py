"""Benchmark passages in documents, found by Wu-Manber search over words.

The patterns are all windows of 13 consecutive words of an item (an item of fewer words is
one window). For each length of window, a block is two words (one, for windows of one word);
the shift table says how far the search may move on when it sees a block: the least distance
from the block to the end of any window, or the whole window but one word for a block that
no window holds. Most blocks of a clean text are of that kind, so about one word in twelve
is looked at. A block that ends windows leads to its bucket, where the words before are
compared directly.

Items are broadcast in slices of at most ``SLICE_BYTES`` of text (a single longer item is a
slice of its own); each slice is a pass over all documents, and what earlier ones found is
carried on in a written table, so every item is searched for, however many there are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from hedonica.llm.common import fresh
from hedonica.session import written

WINDOW = 13
BLOCK = 2
SLICE_BYTES = 4 << 20
# ASCII letters to lower case, other ASCII but digits to spaces; all else belongs to words.
_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


class WuManber:
    """Windows of one length; ``windows`` gives for each the items that hold it."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.length = len(next(iter(windows)))
        self.block = min(BLOCK, self.length)
        self.far = self.length - self.block + 1
        self.shifts: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.block, self.length + 1):
                block = window[end - self.block : end]
                shift = self.length - end
                if shift < self.shifts.get(block, self.far):
                    self.shifts[block] = shift
            self.buckets[window[-self.block :]][window] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Start of every occurrence, ascending, with the items."""
        at, block, length, far, shifts = self.length, self.block, self.length, self.far, self.shifts
        while at <= len(words):
            seen = tuple(words[at - block : at])
            shift = shifts.get(seen, far)
            if shift:
                at += shift
                continue
            items = self.buckets[seen].get(tuple(words[at - length : at]))
            if items is not None:
                yield at - length, items
            at += 1


class Searcher:
    def __init__(self, items: list[tuple[str | None, bytes | None]]):
        by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            words = words_of(text)
            length = min(WINDOW, len(words))
            for i in range(len(words) - length + 1 if words else 0):
                by_length[length][tuple(words[i : i + length])].add(item_id)
        self.tables = [WuManber(dict(w)) for _, w in sorted(by_length.items())]

    def ranges(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of hit words (they may overlap), and the items found."""
        found, items = [], set()
        for table in self.tables:
            for start, held in table.search(words):
                if found and found[-1][0] <= start <= found[-1][1]:
                    found[-1] = (found[-1][0], max(found[-1][1], start + table.length))
                else:
                    found.append((start, start + table.length))
                items |= held
        return found, items


def covered(ranges: list[tuple[int, int]]) -> int:
    """Words in at least one range."""
    n, upto = 0, 0
    for start, end in sorted(ranges):
        n += max(0, end - max(start, upto))
        upto = max(upto, end)
    return n


@lru_cache(maxsize=1)
def _searcher(name: str, items: tuple) -> Searcher:
    """A worker builds the tables of a slice once."""
    return Searcher(list(items))


def slices(benchmark: DataFrame, limit: int) -> Iterator[tuple]:
    """Items with words, in slices of bounded size; read a partition at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    for item_id, text in rows.where("text is not null").toLocalIterator():
        text = bytes(text)
        if held and size + len(text) > limit:
            yield tuple(held)
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    yield tuple(held)


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> tuple[DataFrame, str]:
    """``docs`` (or its columns ``keep``) and a struct ``n_words, n_hit, items``; its name.

    ``items`` are the distinct ids of the items that occur, as text, sorted. NULL and empty
    texts have no words and no hits; an item without words occurs nowhere, one without an id
    counts as hit words but is not listed; repeated rows and items change nothing else. An
    empty benchmark finds nothing; an empty table gives no rows.
    """
    name, source = fresh(docs, "found"), fresh(docs, "_source")
    state = StructType.fromDDL(
        "n_words bigint, n_hit bigint, items array<string>, ranges array<bigint>"
    )
    df = docs.withColumn(source, F.col("text").cast("binary"))
    df = df.select(*(docs.columns if keep is None else keep), source)
    columns = [f for f in df.schema if f.name != source]
    following = slices(benchmark, slice_bytes)
    part, first = next(following), True
    while part is not None:
        later = next(following, None)
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, part))
        carried = [] if later is None else [StructField(source, BinaryType())]
        schema = StructType([*columns, *carried, StructField(name, state)])
        df = df.mapInArrow(_marked(sent, source, None if first else name, schema), schema)
        if later is not None:
            df = written(df, "decontaminate")
        part, first = later, False
    return df.withColumn(name, F.col(name).dropFields("ranges")), name


def _marked(sent, source: str, before: str | None, schema: StructType):
    """One pass over the documents with one slice of the items."""
    arrow = to_arrow_schema(schema)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(*sent.value)
        for batch in batches:
            earlier = batch.column(before) if before else pa.nulls(batch.num_rows)
            rows = []
            for text, old in zip(batch.column(source), earlier):
                words = words_of(text.as_py())
                ranges, items = searcher.ranges(words)
                if old := old.as_py():
                    bounds = old["ranges"]
                    ranges += zip(bounds[::2], bounds[1::2])
                    items.update(old["items"])
                listed = sorted(i for i in items if i is not None)
                bounds = [b for r in sorted(ranges) for b in r]
                rows.append((len(words), covered(ranges), listed, bounds))
            columns = [batch.column(f.name) for f in arrow if f.name != arrow.names[-1]]
            found = [dict(zip(("n_words", "n_hit", "items", "ranges"), r)) for r in rows]
            columns.append(pa.array(found, arrow[-1].type))
            yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return marked


def contaminated(found) -> Column:
    """A twentieth of the words, or more, lies in benchmark passages."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    marked, name = mark(docs, benchmark)
    return marked.where(~contaminated(F.col(name))).drop(name)
