"""SimHash near-duplicates, compared bit plane by bit plane.

Fingerprints of 64 bits come from 3-word shingles. Two of them are linked if they differ in
at most ``RADIUS`` = 2 bits. Of eight bytes at least six are then equal, so each distinct
fingerprint is sent to 28 keys, one for every choice of six bytes; linked fingerprints meet
under at least one key. Sixteen bits are free under a key: a group never has more than 65,536
fingerprints, whatever the corpus, and copies are one fingerprint.

Inside a group the fingerprints lie vertically: bit plane p holds bit p of all, 64 in a word.
A fingerprint is compared with 64 others at a time; carry-save counters (ones, twos, more)
add up the differing planes, and a word is abandoned once all its lanes exceed the radius.
Only a spanning star of each connected part leaves a group, never all pairs. Connected
components over all groups are found by star contraction, each round a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from hedonica.llm.common import fresh
from hedonica.session import written

SHINGLE = 3
RADIUS = 2
SEED = 42
BYTES = 8
# Groups of up to a word are compared side by side, larger ones one after the other.
WORD = 64
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned; zero for NULL and for texts without words."""
    words = text.lower().split() if text else []  # bytes: ASCII letters and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    spots = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spots], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) and the fingerprint of the text, as a long."""
    kept = docs.columns if keep is None else keep
    # A text that is kept is sent once: with a copy, a batch would be twice as large.
    rows = docs.select(*kept) if "text" in kept else docs.select(*kept, "text")
    at = kept.index("text") if "text" in kept else len(kept)
    schema = StructType([*rows.schema.fields[: len(kept)], StructField(name, LongType())])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(v.as_py()) for v in batch.column(at).cast(pa.binary())]
            found = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            columns = batch.columns[: len(kept)]
            yield pa.RecordBatch.from_arrays([*columns, found], names=schema.names)

    return rows.mapInArrow(marked, schema)


# --- comparison inside groups --------------------------------------------------------------


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit p of value i is bit i % 64 of word i // 64 in plane p."""
    n = -(-len(values) // WORD) * WORD
    padded = np.zeros(n, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(
    planes: np.ndarray, queries: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int = RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """Compare query k with the ``lanes`` of plane word ``word[k]``.

    Returns the comparisons that were not abandoned, and their lanes within the radius.
    """
    if radius != 2:
        raise ValueError("the counters are made for a radius of two bits")
    left = np.arange(len(queries))
    ones, twos = np.zeros(len(left), dtype=np.uint64), np.zeros(len(left), dtype=np.uint64)
    live = lanes.copy()
    for p in range(64):
        wanted = -((queries >> np.uint64(p)) & np.uint64(1))  # all bits of the query's bit
        differs = planes[p, word] ^ wanted
        carry = ones & differs
        ones ^= differs
        twos_carry = twos & carry
        twos ^= carry
        live &= ~((ones & twos) | twos_carry)  # three or more
        if p % 8 == 7:
            kept = live != 0
            if not kept.all():
                left, ones, twos, live = left[kept], ones[kept], twos[kept], live[kept]
                queries, word = queries[kept], word[kept]
            if not len(left):
                break
    return left, live


def lanes_of(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit number of every set bit."""
    bits = np.unpackbits(hits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def linked_small(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the parts of many groups of at most 64 values; groups lie together."""
    planes, n = bit_planes(values), len(values)
    first = np.searchsorted(group, group, side="left")
    end = np.searchsorted(group, group, side="right")
    query = np.repeat(np.arange(n), 2)
    word = np.stack([first // WORD, first // WORD + 1], axis=1).ravel()
    low, high = first[query] - word * WORD, end[query] - word * WORD
    lanes = _ones(np.clip(high, 0, WORD)) & ~_ones(np.clip(low, 0, WORD))
    used = (lanes != 0) & (word < planes.shape[1])
    query, word, lanes = query[used], word[used], lanes[used]
    left, hits = near(planes, values[query], word, lanes)
    row, bit = lanes_of(hits)
    a, b = query[left][row], word[left][row] * WORD + bit
    label = np.arange(n)
    while True:  # smallest neighbour until nothing changes; a part has at most 64 members
        new = label.copy()
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(n))
    return values[child], values[label[child]]


def _ones(count: np.ndarray) -> np.ndarray:
    """Words with the lowest ``count`` bits set, for counts from 0 to 64."""
    count = count.astype(np.uint64)
    some = (np.uint64(1) << np.minimum(count, np.uint64(63))) - np.uint64(1)
    return np.where(count >= 64, ~np.uint64(0), some)


def linked_large(values: np.ndarray, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the parts of one group: a search that looks only at lanes not yet reached."""
    planes = bit_planes(values)
    free = _ones(np.clip(len(values) - WORD * np.arange(planes.shape[1]), 0, WORD))
    children, roots = [], []
    for seed in range(len(values)):
        w, b = divmod(seed, WORD)
        if not (free[w] >> np.uint64(b)) & np.uint64(1):
            continue
        free[w] &= ~(np.uint64(1) << np.uint64(b))
        waiting = np.array([seed])
        while len(waiting):
            query, waiting = waiting[:at_once], waiting[at_once:]
            words = np.flatnonzero(free)
            if not len(words):
                break
            left, hits = near(
                planes, np.repeat(values[query], len(words)), np.tile(words, len(query)),
                np.tile(free[words], len(query)),
            )
            reached = np.zeros(len(free), dtype=np.uint64)
            np.bitwise_or.at(reached, np.tile(words, len(query))[left], hits)
            free &= ~reached
            row, bit = lanes_of(reached)
            found = row * WORD + bit
            children.append(found)
            roots.append(np.full(len(found), seed))
            waiting = np.concatenate([waiting, found])
    none = [np.zeros(0, dtype=np.int64)]
    return values[np.concatenate(none + children)], values[np.concatenate(none + roots)]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (choice, key, fingerprint), sorted, to stars (fingerprint, least of its part)."""

    def stars(choice, key, values):
        turns = np.flatnonzero((np.diff(choice) != 0) | (np.diff(key) != 0)) + 1
        starts = np.concatenate([[0], turns])
        sizes = np.diff(np.append(starts, len(key)))
        member = np.repeat(sizes, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = (member > 1) & (member <= WORD)
        out = [linked_small(values[small], group[small])] if small.any() else []
        out += [linked_large(values[a : a + n]) for a, n in zip(starts, sizes) if n > WORD]
        for child, root in out:
            if len(child):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), pa.array(root.view(np.int64))], ["u", "v"]
                )

    held = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new[2] = new[2].view(np.uint64)
        held = new if held is None else [np.concatenate(p) for p in zip(held, new)]
        if not len(held[0]):
            continue
        last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
        cut = int(np.argmax(last))  # the last group may go on in the next batch
        if cut:
            yield from stars(*[c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield from stars(*held)


def links(fingerprints: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Distinct stars ``u, v`` whose parts are those of all links; ``fingerprints`` is distinct."""
    fp = F.col(name)
    masks = []
    for i, j in combinations(range(BYTES), 2):
        mask = (1 << 64) - 1 - (0xFF << 8 * i) - (0xFF << 8 * j)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    choices = F.array(*[
        F.struct(F.lit(t).alias("choice"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key"))
        for t, m in enumerate(masks)
    ])
    spread = fingerprints.select(fp.alias("fp"), F.explode(choices).alias("to"))
    return (
        spread.select(F.col("to.choice").alias("choice"), F.col("to.key").alias("key"), "fp")
        .repartition("choice", "key")
        .sortWithinPartitions("choice", "key", "fp")
        .mapInArrow(_linked, "u bigint, v bigint")
        .distinct()
    )


# --- components ----------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``u, v``: every node that has a link and is not the least of its component, and the least.

    Large-star and small-star contraction: each round joins every node to the least of its
    neighbours, by a minimum (combined before the shuffle) and a join (whose hot nodes Spark
    splits). A round is a written table, so that a lost executor costs one round at most.
    """
    edges, before = written(edges, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state
        both = edges.union(edges.select("v", "u"))
        large = _to_least(both).where("n > u").select(F.col("n").alias("u"), "least")
        large = large.where("u <> least").distinct()
        down = large.select(F.greatest("u", "least").alias("u"), F.least("u", "least").alias("v"))
        small = _to_least(down)
        small = small.select(F.col("n").alias("u"), F.col("least").alias("v")).union(
            small.select("u", F.col("least").alias("v"))
        )
        edges = written(small.where("u <> v").distinct(), "links")


def _to_least(edges: DataFrame) -> DataFrame:
    """``u, n, least``: every edge, with the least of u and its neighbours."""
    edges = edges.toDF("u", "n")
    least = edges.groupBy("u").agg(F.least("u", F.min("n")).alias("least"))
    return edges.join(least, "u")


def component_ids(rows: DataFrame, name: str, doc_id: str = "doc_id") -> DataFrame:
    """``name, component_id``: for each distinct fingerprint, the least id of its component.

    NULL ids count only where a component has no other; then the component's id is NULL.
    """
    distinct = written(rows.groupBy(name).agg(F.min(doc_id).alias("least_id")), "fingerprints")
    stars = components(links(distinct, name)).toDF(name, "root")
    rooted = distinct.join(stars, name, "left").withColumn("root", F.coalesce("root", name))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(least, "root").select(name, "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row, the fingerprint as a long.

    NULL and empty texts have fingerprint zero and are linked like others; repeated rows stay,
    in one component; an empty table gives no rows; extra columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(with_fingerprint(rows, "fingerprint", ["doc_id"]), "simhash")
    return rows.join(component_ids(rows, "fingerprint"), "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one of least ``doc_id``.

    Of rows that share that id, one stays; a NULL id is taken only where there is no other.
    """
    name, row = fresh(docs, "fingerprint"), fresh(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    rows = written(with_fingerprint(numbered, name), "simhash")
    ids = rows.select(name, F.col("doc_id").alias("_id"), F.col(row).alias("_row"))
    distinct = ids.groupBy(name).agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")
    )
    distinct = written(distinct, "fingerprints")
    stars = components(links(distinct, name)).toDF(name, "root")
    rooted = distinct.join(stars, name, "left").withColumn("root", F.coalesce("root", name))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first._row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
