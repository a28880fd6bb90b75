"""Spelling variants: words one edit apart, found by pivotal grams.

Two words are near if one inserted, deleted or replaced code point turns one into the other. All
bigrams are ordered from the rarest to the most frequent (by the words that hold them). The
prefix of a word is its three rarest bigrams, and further ones equal to the third. Two of them
that don't overlap are its pivots, chosen by dynamic programming for the smallest sum of
frequencies. An edit destroys at most one of two disjoint bigrams, so of two near words the one
whose prefix ends earlier in the order has a pivot that lies in the other's prefix, at the same
place or one further, as the lengths say. Pivots are therefore joined to prefixes on bigram,
place and length, and only pairs that pass the comparison of the words leave the join.

Only counts by word are shuffled, added up map-side first, so a word that holds a third of all
occurrences costs a task one row. The order of bigrams is collected: an alphabet of ``a`` letters
has ``a * a`` of them at most (8,100 for the runs read here). Where many words share a bigram at
one place and length, the pivots of that key are dealt to several parts, and its prefixes are
copied to each of them.

NULL and empty texts have no words; a NULL ``doc_id`` counts as an empty one in the hash.
Repeated rows count each. Very long texts are read whole; very long runs are words like others.
An empty table gives no rows. Equal counts go to the word smaller in code-point order. Extra
columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedonica.session import settled, written

GRAM, EDITS = 2, 1
PREFIX = GRAM * EDITS + 1
LETTERS = "A-Za-zÀ-ÿ"
# One code point of a run is left out where this divides the run's hash.
HASH_SHARE = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
FORM_FACTOR = 5
# Rows of a (bigram, place, length) that one part compares at most, about.
KEY_ROWS = 2_000
KEYS = "word string, size int, gram int, place int, last int, pivot boolean"


# --- words ------------------------------------------------------------------------------


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id`` (as text) and ``run``: every maximal run of letters of at least that many.

    A shorter run can't give a word that is long enough. Only A-Z are lower-cased.
    """
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(found).alias("run"),
    ).withColumn("run", F.translate("run", capitals, capitals.lower()))


def as_read(doc_id: Column, run: Column) -> Column:
    """The run, or the run without one code point where its hash says so."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, 1, at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(HASH_SHARE)) == 0, shorter).otherwise(run)


def words(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of at least ``least`` code points that occur ``count`` times."""
    read = runs(docs, least).select(as_read(F.col("doc_id"), F.col("run")).alias("word"))
    counted = read.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least) & (F.col("n") >= count))


# --- prefixes and pivots ----------------------------------------------------------------


def grams(word: str) -> list[str]:
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def prefix_of(ranks: list[int]) -> list[int]:
    """Places of the rarest grams of a word, in ascending order; ties with the last included."""
    last = sorted(ranks)[min(PREFIX, len(ranks)) - 1]
    return [place for place, rank in enumerate(ranks) if rank <= last]


def pivots_of(places: list[int], cost: list[int]) -> list[int]:
    """The cheapest ``EDITS + 1`` grams that don't overlap, of grams at ascending places.

    ``best[m]`` holds the cheapest choice of m of the grams seen so far; ``done[m]`` is the
    same for the grams that end before the one looked at begins.
    """
    wanted = EDITS + 1
    none = (math.inf, ())
    best: list[list[tuple]] = []
    for i, place in enumerate(places):
        clear = next((best[j] for j in range(i - 1, -1, -1) if places[j] + GRAM <= place), None)
        done = clear or [(0, ()), *[none] * wanted]
        row = list(best[-1]) if best else [(0, ()), *[none] * wanted]
        for m in range(1, wanted + 1):
            total, chosen = done[m - 1]
            row[m] = min(row[m], (total + cost[i], (*chosen, place)))
        best.append(row)
    return list(best[-1][wanted][1])


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank and frequency of every bigram, from the rarest on."""
    each = F.transform(
        F.sequence(F.lit(1), F.length("word") - (GRAM - 1)),
        lambda i: F.substring(F.col("word"), i, F.lit(GRAM)),
    )
    counted = words.select(F.explode(F.array_distinct(each)).alias("gram"))
    rows = counted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    ordered = sorted((r["n"], r["gram"]) for r in rows)
    return {gram: (rank, n) for rank, (n, gram) in enumerate(ordered)}


def keys(words: DataFrame) -> DataFrame:
    """A row for each gram of each word's prefix; ``last`` is where the prefix ends."""
    order = gram_order(words)

    def rows_of(word: str) -> list[tuple]:
        found = [order[g] for g in grams(word)]
        places = prefix_of([rank for rank, _ in found])
        pivots = pivots_of(places, [found[p][1] for p in places])
        last = max(found[p][0] for p in places)
        return [(word, len(word), found[p][0], p, last, p in pivots) for p in places]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        names = [c.split()[0] for c in KEYS.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                rows = [r for w in batch.column(0).slice(at, 2_000) for r in rows_of(w.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names
                )

    return words.select("word").mapInArrow(prefixes, KEYS)


# --- near words -------------------------------------------------------------------------


def wanted_keys(pivots: DataFrame) -> DataFrame:
    """Each pivot once for every place and length that a near word may hold it at."""
    moves = [(0, 0), (0, 1), (1, 1), (0, -1), (-1, -1)]
    at = F.array(*[
        F.struct((F.col("place") + p).alias("place"), (F.col("size") + s).alias("size"))
        for p, s in moves
    ])
    return pivots.select("word", "gram", "last", F.explode(at).alias("at")).select(
        "word", "gram", "last", "at.place", "at.size"
    )


def near_pairs(words: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """``word, near``: all ordered pairs of near words of a table of distinct words.

    Words need ``PREFIX`` grams at least, four code points.
    """
    key = ["gram", "place", "size"]
    grams = written(keys(words), "grams")
    pivots, prefixes = wanted_keys(grams.where("pivot")), grams.select("word", "last", *key)
    # Keys with many pivots and prefixes: their pivots are dealt to parts, prefixes copied.
    counts = (
        pivots.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        .join(prefixes.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), key)
        .where((F.col("n") > key_rows) & (F.col("m") > 1))
        .select(*[F.col(k).alias(f"_{k}") for k in key], F.ceil(F.col("n") / key_rows).cast("int").alias("parts"))
    )
    hot, small = settled(counts, "hot-grams")

    def with_parts(df: DataFrame) -> DataFrame:
        on = reduce(lambda a, b: a & b, [df[k] == hot[f"_{k}"] for k in key])
        joined = df.join(F.broadcast(hot) if small else hot, on, "left")
        return joined.select(*df.columns, F.coalesce("parts", F.lit(1)).alias("parts"))

    dealt = with_parts(pivots).withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    copied = with_parts(prefixes).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    a, b = dealt.drop("parts").alias("a"), copied.drop("parts").alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*key, "part"]])
    on &= (F.col("a.last") <= F.col("b.last")) & (F.col("a.word") != F.col("b.word"))
    on &= F.levenshtein("a.word", "b.word", EDITS) == EDITS
    found = a.join(b, on).select(F.col("a.word").alias("word"), F.col("b.word").alias("near"))
    both = F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))
    return found.select(F.inline(both)).distinct()


def roots(forms: DataFrame, most: int, factor: int = FORM_FACTOR) -> DataFrame:
    """``word, root`` of ``word, form``: the last form that is reached.

    A form is ``factor`` times as frequent as its word, so a chain has at most log(most) steps
    to that base; every round doubles the steps taken.
    """
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(math.log(max(most, 2), factor) + 1)))):
        found = written(found, "roots")
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = found.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root")
        )
    return found


def variants(docs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``docs`` (doc_id, text)."""
    known = written(words(docs), "words")
    most = known.agg(F.max("n")).first()[0] or 0
    counts = known.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # The most frequent near word; of equal counts the smaller word (bytes order as code points).
    pairs = near_pairs(known).join(counts, "near")
    top = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("top"),
    )
    enough = F.col("top.near_n") >= FORM_FACTOR * F.col("n")
    judged = written(
        known.join(top, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("top.near")).alias("form"),
            F.when(enough, F.col("top.near_n")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(judged.where("form IS NOT NULL"), most)
    return judged.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
