"""Packing by Karmarkar-Karp multiway differencing.

Documents are cut into pieces of exactly one window where they are that long; what is left
of each is shorter than a window. Rests that fill ``BATCH_WINDOWS`` windows but for ``SLACK``
ids each are packed at a time (the last one is cut to fit): every piece begins as a partial partition (itself, and empty windows), and the two
partial partitions of largest spread are merged, the fullest windows of one with the emptiest
of the other, until one is left. If its fullest window exceeds the capacity, the number of
windows rises by one and the batch is packed anew.

Differencing needs small pieces to level what large ones leave, so a ``LEVEL_SHARE`` of the
rests, the longest, is cut into graded pieces first. Nothing is shuffled: a task packs the
documents it reads, and keeps one batch in memory. NULL and empty texts are pieces of the end
id alone; repeated documents are packed like others; a NULL ``doc_id`` stays NULL; an empty
table gives no rows; extra columns are left out. A very long text only gives more full windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedonica.llm.word_ids import ID, WORD_BPE, word_ids

CAPACITY = 2048
BATCH_WINDOWS = 64
LEVEL_SHARE = 0.2
SLACK = 6
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Sizes dealt to windows of near-equal sums; every window lists its sizes' indexes."""
    heap = []  # spread, tie-breaker, ascending sums, and the merge that led to them
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, dtype=np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, order, sums, one = heapq.heappop(heap)
        _, _, other, two = heap[0]
        sums = sums + other[::-1]  # opposing imbalances: ascending against descending
        by = sums.argsort(kind="stable")
        sums = sums[by]
        sums -= sums[0]
        heapq.heapreplace(heap, (-int(sums[-1]), order, sums, (one, two, by)))
    held: list[list[int]] = [[] for _ in range(windows)]
    todo = [(heap[0][3], np.arange(windows))] if heap else []
    while todo:  # from the last merge back: which window each partial one became
        made, at = todo.pop()
        if isinstance(made, int):
            held[at[-1]].append(made)
        else:
            one, two, by = made
            before = np.empty_like(at)
            before[by] = at
            todo += [(one, before), (two, before[::-1])]
    return held if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The least number of windows, from the sum of sizes on, that differencing can fill."""
    if max(sizes, default=0) > capacity:
        raise ValueError("a size exceeds the capacity")
    windows = -(-sum(sizes) // capacity)
    while True:
        dealt = differencing(sizes, windows)
        if all(sum(sizes[i] for i in held) <= capacity for held in dealt):
            return dealt
        windows += 1


def graded(size: int) -> list[int]:
    """Pieces of decreasing size: a quarter of what is left each time, 8 ids at least."""
    parts = []
    while size > 8:
        parts.append(max(8, size // 4))
        size -= parts[-1]
    return parts + [size] if size else parts


def rests_to_pieces(rests: list[int], share: float = LEVEL_SHARE) -> list[tuple[int, int, int]]:
    """Rest number, start and size of the pieces to pack; the longest rests are graded."""
    wanted, cut = share * sum(rests), set()
    for i in sorted(range(len(rests)), key=lambda i: -rests[i]):
        if wanted <= 0:
            break
        cut.add(i)
        wanted -= rests[i]
    pieces = []
    for i, size in enumerate(rests):
        at = 0
        for part in graded(size) if i in cut else [size]:
            pieces.append((i, at, part))
            at += part
    return pieces


def pack_documents(
    docs: DataFrame, end_id: int, capacity: int = CAPACITY, vocabulary: str = WORD_BPE
) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence."""
    names = [c.split()[0] for c in PIECES.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(vocabulary), np.array([end_id], dtype=ID).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        full = BATCH_WINDOWS * max(1, capacity - SLACK)
        rests, waiting = [], 0  # (doc_id, start, ids, ids of the document)
        out: list[tuple] = []

        def emit(doc_id, start, ids, total, offset):
            out.append((doc_id, start, len(ids), zlib.crc32(ids), total, sequence, offset))

        def flush():
            nonlocal sequence, rests, waiting
            pieces = rests_to_pieces([len(ids) for _, _, ids, _ in rests])
            for held in pack([size for _, _, size in pieces], capacity):
                offset = 0
                for i, at, size in (pieces[j] for j in held):
                    doc_id, start, ids, total = rests[i]
                    emit(doc_id, start + at, ids[at : at + size], total, offset)
                    offset += size
                sequence += 1
            rests, waiting = [], 0

        def batch_out() -> pa.RecordBatch:
            rows, out[:] = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in rows], names)

        for batch in batches:
            coded = encoder.of_column(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded):
                ids = np.frombuffer(ids + end, dtype=ID)
                whole = len(ids) // capacity * capacity
                for at in range(0, whole, capacity):
                    emit(doc_id, at, ids[at : at + capacity], len(ids), 0)
                    sequence += 1
                at = whole
                while at < len(ids):
                    part = ids[at : min(len(ids), at + full - waiting)].copy()
                    rests.append((doc_id, at, part, len(ids)))
                    at, waiting = at + len(part), waiting + len(part)
                    if waiting == full:
                        flush()
                if len(out) >= 10_000:
                    yield batch_out()
        flush()
        if out:
            yield batch_out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, PIECES)
