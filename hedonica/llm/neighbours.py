"""Approximate nearest neighbours by inner product with an inverted multi-index.

A vector is cut into two halves, and each half goes to the nearest of ``k`` centroids of its own
codebook: a pair of centroids is a cell, and the index is the list of entries of every cell. A
query takes the pairs in descending order of the summed inner products of its halves with the two
centroids, from a heap, and the entries of the pairs it reaches are reranked by their exact inner
product. It does so twice:

1. the first ``FIRST`` entries; the score of the wanted last neighbour among them is a lower
   bound of what it will be in the end;
2. all pairs whose sum may still hold a better entry. An entry scores the pair's sum and what
   the quantisation lost. If both were normal, a neighbour at the wanted place would have lost
   less than ``z`` deviations with probability ``recall``; the search ends where the sum is that
   far below the bound. ``exact=True`` adds what a member of each cell can score at most
   (the query's norm times the radius of the centroid's members) to the sums instead, and the
   search ends where these are below the bound: no neighbour is lost.

The codebooks are fitted on about ``SAMPLE_BYTES`` of vectors, chosen by hash; all else (cells,
spread, radii) covers every vector. Equal vectors are one entry with the ``top + 1`` smallest
ids, all that can be among the nearest; so a vector that a third of all rows hold costs one
row, and it is cut down map-side. Cells lie in blocks of at most about ``BLOCK`` entries; larger
cells are dealt to several. Queries meet the blocks they reach; a block that very many queries
reach is copied, and they are dealt to the copies.

Vectors that are NULL, zero, empty, or have NULL, NaN or infinite components, and rows without
an id, take no part; nor do those of another length than most have (of equally frequent lengths
the smaller), as an inner product needs equal lengths. Rows equal in id and vector count once;
rows of one id with unlike vectors are queries and candidates apart, never of each other. Equal
scores go to the smaller id. An empty table, or no query in it, gives no rows. Extra columns are
left out. Scores are correctly rounded sums of the double products.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedonica.session import literal_rows, lookup, settled, written

SAMPLE_BYTES = 16 << 20
# Wanted entries in a cell; beyond ``LARGEST_BOOK`` centroids a half, cells grow instead.
CELL, LARGEST_BOOK = 12, 256
ROUNDS = 10
FIRST = 4096
BLOCK = 4096
# Queries that meet one copy of a block, about.
BLOCK_QUERIES = 16_384
# Share of a score by which rounding may move it.
ROUNDING = 1e-9
FOUND = "query bigint, query_id bigint, vec_id bigint, score double"


def taking_part(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id, vector`` (doubles) of the rows that can be queries or candidates."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(id_column).isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_column).cast("long").alias("id"), v.cast("array<double>").alias("vector"))


# --- codebooks and index ----------------------------------------------------------------


def lloyd(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of the rows of x; they start as evenly spaced rows."""
    middle = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = nearest(x, middle)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(middle)
        np.add.at(sums, at, x)
        middle[n > 0] = sums[n > 0] / n[n > 0, None]
    return middle


def nearest(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return ((middle**2).sum(axis=1) - 2 * x @ middle.T).argmin(axis=1)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


@dataclass(frozen=True)
class Index:
    """What a search must know of the index's entries."""

    books: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray  # entries in each cell
    blocks: np.ndarray  # first block of each cell
    parts: np.ndarray  # blocks over which the cell is dealt
    losses: tuple[float, float]  # mean squared distance to the centroid, by half
    shares: tuple[float, float]  # ... as a share of the squared distance to the mean
    radii: tuple[np.ndarray, np.ndarray]  # largest distance to each centroid

    @property
    def dims(self) -> int:
        return sum(b.shape[1] for b in self.books)


def codebooks(rows: DataFrame, n: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1, SAMPLE_BYTES // (8 * dims))
    chosen = F.pmod(F.xxhash64("vector"), F.lit(max(1, n))) < size
    sample = rows.where(chosen).select("vector").distinct().toArrow().column(0).combine_chunks()
    x = matrix(sample, dims)
    x = x[np.lexsort(x.T)]
    k = max(1, min(LARGEST_BOOK, round(math.sqrt(n / CELL)), len(x) // 16))
    # without any vector there are no queries either
    return tuple(lloyd(h, k) if len(h) else np.zeros((1, h.shape[1])) for h in (x[:, : dims // 2], x[:, dims // 2 :]))


def dealt(counts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell: neighbouring cells share a block."""
    first, parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    at, held = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > block:
            at, held = at + 1, 0
        first[cell] = at
        if n > block:
            parts[cell] = -(-n // block)
            at, n = at + parts[cell], 0
        held += n
    return first, parts


def build(rows: DataFrame, n: int, dims: int, top: int) -> tuple[DataFrame, Index]:
    """Entries ``cell, block, vector, ids`` of ``id, vector`` rows, all of ``dims`` components,
    and the index; n is the number of rows."""
    books = codebooks(rows, n, dims)
    k = len(books[0])
    smallest = Window.partitionBy("vector").orderBy("id")
    distinct = (
        rows.dropDuplicates(["vector", "id"])
        .withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= top + 1)
        .groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = dims // 2
        for batch in batches:
            x = matrix(batch.column(0), dims)
            i, j = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
            lost = [((h - b[at]) ** 2).sum(axis=1) for h, b, at in
                    ((x[:, :half], books[0], i), (x[:, half:], books[1], j))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i * k + j, pa.int32()), *map(pa.array, lost), batch.column(0), batch.column(1)],
                names=["cell", "lost1", "lost2", "vector", "ids"],
            )

    schema = "cell int, lost1 double, lost2 double, vector array<double>, ids array<bigint>"
    listed = written(distinct.select("vector", "ids").mapInArrow(coded, schema), "index")
    sums = [F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("lost1", "lost2") for f in (F.sum, F.max)]]
    found = listed.groupBy("cell").agg(*sums).toArrow().to_pydict()  # a row for each pair at most
    cells = np.array(found["cell"], dtype=np.int64)
    counts = np.zeros(k * k, dtype=np.int64)
    counts[cells] = found["n"]
    losses, shares, radii = [], [], []
    for h, (book, at) in enumerate(zip(books, (cells // k, cells % k)), start=1):
        held = np.bincount(at, weights=found["n"], minlength=k)
        total = max(held.sum(), 1)
        lost = sum(found[f"sum_lost{h}"]) / total
        between = (((book - held @ book / total) ** 2).sum(axis=1) * held).sum() / total
        losses.append(lost)
        shares.append(lost / (lost + between) if lost + between else 0.0)
        radius = np.zeros(k)
        np.maximum.at(radius, at, found[f"max_lost{h}"])
        radii.append(np.sqrt(radius))
    blocks, parts = dealt(counts, BLOCK)
    places = literal_rows(
        rows.sparkSession,
        pa.table({"cell": pa.array(np.arange(k * k), pa.int32()), "block": pa.array(blocks), "parts": pa.array(parts)}),
        "cell int, block bigint, parts bigint",
    )  # at most LARGEST_BOOK ** 2 rows of 20 bytes
    part = F.pmod(F.xxhash64("vector"), "parts")
    entries = listed.join(F.broadcast(places), "cell").select(
        "cell", (F.col("block") + part).alias("block"), "vector", "ids"
    )
    return entries, Index(books, counts, blocks, parts, tuple(losses), tuple(shares), tuple(radii))


# --- traversal --------------------------------------------------------------------------


def pairs_by_sum(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs of an element of a and one of b with their sum, the largest sum first."""
    by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(-(a[by_a[0]] + b[by_b[0]]), 0, 0)]
    while heap:
        total, x, y = heapq.heappop(heap)
        yield -total, by_a[x], by_b[y]
        if y + 1 < len(by_b):
            heapq.heappush(heap, (-(a[by_a[x]] + b[by_b[y + 1]]), x, y + 1))
        if y == 0 and x + 1 < len(by_a):
            heapq.heappush(heap, (-(a[by_a[x + 1]] + b[by_b[0]]), x + 1, 0))


def reached(index: Index, query: np.ndarray, least: float, first: int | None, z: float | None) -> list[int]:
    """Cells with entries that a query takes: those of the ``first`` entries, or all that may
    hold an entry of score ``least`` (``z`` None: that can hold one)."""
    half = index.dims // 2
    halves = (query[:half], query[half:])
    sums = [b @ q for b, q in zip(index.books, halves)]
    norms = [math.sqrt(float(q @ q)) for q in halves]
    stop = least - ROUNDING * sum(norms) * max(1.0, *(float(np.abs(s).max()) for s in sums))
    if z is None:
        sums = [s + norm * r for s, norm, r in zip(sums, norms, index.radii)]
    else:
        dims = [max(1, len(q)) for q in halves]
        stop -= z * math.sqrt(sum(n * n * m / d for n, m, d in zip(norms, index.losses, dims)))
    k, seen, out = len(index.books[0]), 0, []
    for total, i, j in pairs_by_sum(*sums):
        if first is None and total < stop or first is not None and seen >= first:
            break
        n = index.counts[i * k + j]
        if n:
            seen += n
            out.append(i * k + j)
    return out


def deviations(index: Index, n: int, top: int, recall: float) -> float:
    """How many deviations the quantisation may have taken from the score of a neighbour at
    place ``top`` of ``n``, but for a share of 1 - recall: the normal model of the docstring."""
    lost = sum(index.losses)
    share = sum(s * m for s, m in zip(index.shares, index.losses)) / lost if lost else 0.0
    normal = NormalDist()
    place = max(0.0, normal.inv_cdf(min(max(1 - top / max(n, 1), 0.5), 1 - 1e-15)))
    return math.sqrt(share) * place + normal.inv_cdf(recall) * math.sqrt(1 - share)


def visits(index: Index, queries: DataFrame, first: int | None, z: float | None) -> DataFrame:
    """A row for each block that a query (``query, query_id, vector, least``) reaches."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x, least = matrix(part.column(2), index.dims), part.column(3).to_pylist()
                of, block, cells = [], [], []
                for row, q in enumerate(x):
                    by_block: dict[int, list[int]] = {}
                    for cell in reached(index, q, least[row], first, z):
                        start = int(index.blocks[cell])
                        for b in range(start, start + int(index.parts[cell])):
                            by_block.setdefault(b, []).append(cell)
                    of += [row] * len(by_block)
                    block += by_block
                    cells += by_block.values()
                rows = part.take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(block, pa.int64()), pa.array(cells, pa.list_(pa.int32()))],
                    names=["query", "query_id", "vector", "least", "block", "cells"],
                )

    schema = "query bigint, query_id bigint, vector array<double>, least double, block bigint, cells array<int>"
    # few small rows, each a long walk: a number that adaptive execution doesn't lower
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select("query", "query_id", "vector", "least").repartition(tasks, "query")
    return asked.mapInArrow(walked, schema)


# --- reranking --------------------------------------------------------------------------


def reranked(dims: int, top: int):
    """The best ``top`` entries of a block for each query among the cells it reaches there."""

    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if queries.num_rows and entries.num_rows:
            x = matrix(entries["vector"].combine_chunks(), dims)
            ids = entries["ids"].combine_chunks()
            names, local = np.unique(entries["cell"].to_numpy(), return_inverse=True)
            norms = np.sqrt((x * x).sum(axis=1)).max()
            for at in range(0, queries.num_rows, 256):
                part = queries.slice(at, 256)
                q = matrix(part["vector"].combine_chunks(), dims)
                cells = part["cells"].combine_chunks()
                open_ = np.zeros((len(q), len(names)), dtype=bool)
                row = np.repeat(np.arange(len(q)), np.diff(cells.offsets.to_numpy()))
                listed = cells.flatten().to_numpy()
                place = np.searchsorted(names, listed)
                place[place == len(names)] = 0
                held = names[place] == listed
                open_[row[held], place[held]] = True
                scores = np.where(open_[:, local], q @ x.T, -math.inf)
                slack = ROUNDING * norms * np.sqrt((q * q).sum(axis=1))
                least = part["least"].to_numpy() - slack
                if len(x) > top + 1:
                    last = np.partition(scores, len(x) - top - 1, axis=1)[:, len(x) - top - 1]
                    least = np.maximum(least, last - slack)
                for r, (query, query_id) in enumerate(zip(part["query"].to_pylist(), part["query_id"].to_pylist())):
                    near = []
                    for e in np.flatnonzero((scores[r] >= least[r]) & (scores[r] > -math.inf)):
                        exact = math.fsum(x[e] * q[r])
                        near += [(-exact, i) for i in ids[e].as_py() if i != query_id]
                    for score, i in sorted(near)[:top]:
                        for column, v in zip(out, (query, query_id, i, -score)):
                            column.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def search_blocks(entries: DataFrame, met: DataFrame, dims: int, top: int) -> DataFrame:
    """``query, query_id, vec_id, score``: what the visits of blocks find, ``top`` of each."""
    met, block_queries = written(met, "visits"), BLOCK_QUERIES
    crowded = met.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_queries)
    copies, small = settled(
        crowded.select(F.col("block").alias("_block"), F.ceil(F.col("n") / block_queries).cast("int").alias("copies")),
        "copies",
    )

    def with_copies(df: DataFrame) -> DataFrame:
        return lookup(df, copies, {"block": "_block"}, small).withColumn("copies", F.coalesce("copies", F.lit(1)))

    left = with_copies(met).withColumn("copy", F.pmod(F.xxhash64("query"), "copies").cast("int"))
    right = with_copies(entries).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    left = left.select("block", "copy", "query", "query_id", "vector", "least", "cells")
    right = right.select("block", "copy", "cell", "vector", "ids")
    return (
        left.groupBy("block", "copy").cogroup(right.groupBy("block", "copy"))
        .applyInArrow(reranked(dims, top), FOUND)
    )


def best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    df: DataFrame, every: int = 20, top: int = 20, id_column: str = "vec_id",
    vector: str = "embedding", recall: float = 0.9, exact: bool = False,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of every row whose id is divisible by
    ``every``, among all other rows."""
    rows = taking_part(df, id_column, vector)
    lengths = rows.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.col("n").desc(), "dims").first()
    if most is None:
        return literal_rows(df.sparkSession, [], "query_id bigint, rank int, vec_id bigint, score double")
    n, dims = most["n"], most["dims"]
    rows = rows.where(F.size("vector") == dims)
    entries, index = build(rows, n, dims, top)
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "vector"])
    queries = written(
        asked.select(F.monotonically_increasing_id().alias("query"), F.col("id").alias("query_id"), "vector"),
        "queries",
    )
    none = F.lit(-math.inf)
    start = visits(index, queries.withColumn("least", none), FIRST, 0.0)
    first = written(best(search_blocks(entries, start, dims, top), top), "first-found")
    bound = first.where(F.col("rank") == top).select("query", F.col("score").alias("least"))
    bounded = queries.join(bound, "query", "left").withColumn("least", F.coalesce("least", none))
    z = None if exact else deviations(index, n, top, recall)
    rest = search_blocks(entries, visits(index, bounded, None, z), dims, top)
    both = first.select(*[c.split()[0] for c in FOUND.split(", ")]).union(rest).distinct()
    return best(both, top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
