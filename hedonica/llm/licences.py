"""Licence notices in documents, by a trained classifier of paragraphs.

A paragraph is a run of lines with words, up to a line without any. Only letters and digits
count, so comment marks and line breaks inside a notice don't matter. A paragraph is judged in
windows of ``WINDOW`` words, one every ``WINDOW_STEP``. A multinomial logistic regression over
hashed words and word pairs (sparse) tells licence families from each other and from
``unknown``. It is trained here: on windows of the notices of ``licence_texts``, alone and
among other words; for ``unknown`` on half of the near-notices (licences that are no family
here) and on windows of a bounded sample of the documents: the distinct texts of about
``SAMPLE_DOCS`` rows, of which ``SAMPLE_WINDOWS`` windows at most.

A prediction is confirmed by comparison with the family's notices: of a notice's distinct word
pairs, at most ``WINDOW - 1`` of them, ``SHARED`` at least must stand in the window. Any such
window has one of the notice's *anchors*: all its pairs but the commonest, as many as may be
missing, and one more. So only windows with an anchor are classified, which loses none.

The score of a window is its probability times the share of pairs. What is unknown is
calibrated on what could be taken for a family: the other half of the near-notices, and in all
documents the paragraphs that resemble a notice (``NEAR`` to ``SHARED``) without one that is
confirmed. The least score is such that of neither more than ``FALSE_SHARE`` exceed it. Scores
are counted by ten-thousandths, over all rows.

One row for each paragraph and family found in it, with its best window: ``word`` is the
place of the window's first word, ``text`` the window as it stands. The texts are read once;
windows that resemble a notice are written. No Python.

NULL and empty texts have no paragraphs; very long texts are cut into windows, only those with
an anchor leave the row; of equal windows the greater text counts; repeated rows are found alike; an empty
table gives no rows and is trained on the notices alone; extra columns are left out.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedonica.llm.licence_texts import FAMILIES, NEAR_NOTICES
from hedonica.llm.quality import let
from hedonica.session import written

FEATURES = 1 << 13
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 3_000
FALSE_SHARE = 0.005
LEAST_SCORE = 0.5
SCORES = 10_000
# Groups of words that each notice is put among in training.
CONTEXTS = 6
SHARED, NEAR = 0.6, 0.4
UNKNOWN = "unknown"
NAMES = [UNKNOWN, *FAMILIES]
TABLE_BITS = 1 << 17
# Words of a window, and from one start to the next.
WINDOW, WINDOW_STEP = 16, 4
NO_WORD = "[^\\p{L}\\p{N}]"
# From the end of a line over lines without words to the next one.
BREAK = f"\n{NO_WORD}*\n"
# Pairs of these say little; any order of the pairs is right, this one makes anchors rare.
COMMON = set("a an and any are as be by can for if in is it may not of on or that the this to under use with you".split())


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), f"{NO_WORD}+"), "")


def pairs(w: Column) -> Column:
    """Distinct pairs of neighbouring words, as text."""
    each = F.transform(
        F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))
    )
    return F.when(F.size(w) > 1, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _place(first: Column, second: Column) -> Column:
    return F.pmod(F.xxhash64(first, second), F.lit(TABLE_BITS))


def notices(spark: SparkSession) -> DataFrame:
    """``family, pairs``: one row a family, with the pairs of each notice."""
    rows = [(family, texts) for family, texts in FAMILIES.items()]
    df = spark.createDataFrame(rows, "family string, texts array<string>")
    return df.select("family", F.transform("texts", lambda t: let(words(t), pairs)).alias("pairs"))


def anchors(notice: list[str]) -> list[str]:
    """Pairs of which any window that resembles the notice has one at least."""

    def rarity(pair: str) -> tuple[int, str]:
        return sum(len(w) for w in pair.split(" ") if w not in COMMON), pair

    needed = math.ceil(NEAR * min(len(notice), WINDOW - 1))
    return sorted(notice, key=rarity, reverse=True)[: len(notice) - needed + 1]


@dataclass(frozen=True)
class Anchors:
    """The anchors of all notices, as constants of the plan."""

    words: Column  # of each the longer word
    table: Column  # bits of their hashes, 64 in a number

    @staticmethod
    def of(spark: SparkSession) -> Anchors:
        every = {a for row in notices(spark).collect() for n in row["pairs"] for a in anchors(n)}  # bounded by the notices
        pair = F.split("pair", " ")
        places = spark.createDataFrame([(a,) for a in sorted(every)], "pair string")
        bits = [0] * (TABLE_BITS // 64)
        for (at,) in places.select(_place(pair[0], pair[1])).collect():
            bits[at // 64] |= 1 << at % 64
        signed = [b - (1 << 64) if b >> 63 else b for b in bits]
        rare = sorted({max(a.split(" "), key=lambda w: (w not in COMMON, len(w), w)) for a in every})
        return Anchors(
            F.array(*[F.lit(w) for w in rare]), F.from_json(F.lit(json.dumps(signed)), "array<bigint>")
        )

    def at(self, w: Column, i: Column) -> Column:
        """Whether words ``i - 1`` and ``i`` may be an anchor."""
        place = _place(F.get(w, i - 1), F.get(w, i))
        bits = F.get(self.table, (place / 64).cast("int"))
        return F.call_function("shiftright", bits, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    def among(self, text: Column) -> Column:
        """Whether some pair of neighbouring words may be an anchor."""

        def some(w: Column) -> Column:
            found = F.exists(F.sequence(F.lit(1), F.size(w) - 1), lambda i: self.at(w, i))
            return F.when((F.size(w) > 1) & F.arrays_overlap(w, self.words), found).otherwise(False)

        return let(words(text), some)


def paragraphs(docs: DataFrame) -> DataFrame:
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, F.posexplode(F.split("text", BREAK, -1)).alias("paragraph", "text"))


def windows(rows: DataFrame, known: Anchors | None = None) -> DataFrame:
    """``rows`` once for each window of their ``text`` (with an anchor): ``word, words, text``."""

    def starts(w: Column) -> Column:
        if known is None:
            return F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - WINDOW) / WINDOW_STEP), F.lit(0)).cast("int"))
        seen = F.filter(F.sequence(F.lit(1), F.size(w) - 1), lambda i: known.at(w, i))
        last = F.transform(seen, lambda i: F.floor((i - 1) / WINDOW_STEP).cast("int"))
        over = F.transform(last, lambda k: F.sequence(F.greatest(k - WINDOW // WINDOW_STEP + 1, F.lit(0)), k))
        return F.array_distinct(F.flatten(over))

    def parts(x: Column) -> Column:
        def part(k: Column) -> Column:
            at = k * WINDOW_STEP
            text = F.array_join(F.slice(x["tokens"], at + 1, WINDOW), "")
            return F.struct(at.alias("word"), F.slice(x["words"], at + 1, WINDOW).alias("words"), text.alias("text"))

        cut = F.transform(let(x["words"], starts), part)
        return F.when(F.size(x["words"]) > 1, F.filter(cut, lambda p: F.size(p["words"]) > 1))

    def plain(tokens: Column) -> Column:
        low = F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, f"{NO_WORD}+$", "")))
        return let(F.struct(tokens.alias("tokens"), low.alias("words")), parts)

    others = [c for c in rows.columns if c != "text"]
    tokens = F.regexp_extract_all("text", F.lit(f"[\\p{{L}}\\p{{N}}]++{NO_WORD}*+"), F.lit(0))
    return rows.select(*others, F.explode(let(tokens, plain)).alias("_")).select(*others, "_.*")


def best_share(mine: Column, notice_pairs: Column) -> Column:
    """Greatest share of a notice's pairs, or of as many as a window holds, among ``mine``."""

    def share(theirs: Column) -> Column:
        both = F.size(F.array_intersect(mine, theirs))
        return F.try_divide(both, F.least(F.size(theirs), F.lit(WINDOW - 1)))

    return F.coalesce(F.array_max(F.transform(notice_pairs, share)), F.lit(0.0))


def _features(rows: DataFrame) -> DataFrame:
    terms = let(F.col("words"), lambda w: F.concat(w, pairs(w)))
    hashing = HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True)
    return hashing.transform(rows.withColumn("terms", terms))


def predicted(classifier: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Windows with ``family`` (the likeliest but unknown), ``probability, similarity, score``."""
    found = classifier.transform(_features(rows))
    p = F.slice(vector_to_array("probability"), F.lit(2), len(FAMILIES))
    found = found.withColumn("p", p).withColumn("probability", F.array_max("p"))
    at = F.array_position("p", F.col("probability")).cast("int")
    found = found.withColumn("family", F.array(*[F.lit(f) for f in FAMILIES])[at - 1])
    found = found.select(*rows.columns, "family", "probability")
    found = found.join(F.broadcast(notices(rows.sparkSession)), "family")
    found = found.withColumn("similarity", best_share(let(F.col("words"), pairs), F.col("pairs"))).drop("pairs")
    return found.withColumn("score", F.col("probability") * F.col("similarity"))


def background(docs: DataFrame) -> DataFrame:
    """Windows of the sample that resemble no notice: ``words, text``."""
    spark = docs.sparkSession
    one_in = max(1, docs.count() // SAMPLE_DOCS)
    chosen = F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    texts = docs.where(chosen).select("text").distinct()
    # by number, so that the texts stay in several tasks
    texts = texts.repartition(2 * spark.sparkContext.defaultParallelism, "text")
    found = windows(texts).select("words", "text").distinct()
    found = found.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_WINDOWS)
    every = [pair for row in notices(spark).collect() for pair in row["pairs"]]  # bounded by the notices
    every = F.from_json(F.lit(json.dumps(every)), "array<array<string>>")
    # half of what resembles a notice: ends of real ones are no examples of the unknown
    return found.where(best_share(let(F.col("words"), pairs), every) < NEAR / 2)


def _texts(spark: SparkSession, half: int) -> list[tuple[float, str]]:
    """Label and text of all notices, and of every second near-notice."""
    known = [(float(i), t) for i, name in enumerate(NAMES) for t in FAMILIES.get(name, [])]
    return known + [(0.0, t) for t in NEAR_NOTICES[half::2]]


def examples(spark: SparkSession, texts: list[tuple[float, str]], other: list[str]) -> DataFrame:
    """``label, words, text``: windows of texts alone, and of texts among words of others."""
    around, rows = " ".join(other).split(), []
    for label, text in texts:
        rows += [(label, text)] * 2
        n = WINDOW - len(text.split())
        if 0 < n <= len(around):
            # the same words around every text, so that they tell nothing about it
            for k in range(CONTEXTS):
                at, before = 997 * k % (len(around) - n + 1), k * n // (CONTEXTS - 1)
                rows.append((label, " ".join([*around[at : at + before], text, *around[at + before : at + n]])))
    df = spark.createDataFrame(rows, "label double, text string")
    return windows(df).select("label", "words", "text")


def train(docs: DataFrame) -> tuple[LogisticRegressionModel, list[str]]:
    """The classifier, and some windows of documents to put near-notices among."""
    spark = docs.sparkSession
    unknown = written(background(docs), "licence-sample")
    between = unknown.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_DOCS).collect()
    between = [r["text"] for r in between]
    rows = examples(spark, _texts(spark, 0), between)
    rows = rows.union(unknown.select(F.lit(0.0), "words", "text"))
    fit = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, tol=1e-5)
    return fit.fit(_features(rows).select("label", "features").coalesce(1)), between


def reached(rows: DataFrame) -> float:
    """The score that at most ``FALSE_SHARE`` of the rows exceed; 0 without rows."""
    at = F.ceil(F.col("score") * SCORES).alias("at")
    counts = sorted(rows.groupBy(at).count().collect(), reverse=True)  # at most 10,001 rows
    allowed = FALSE_SHARE * sum(n for _, n in counts)
    for place, n in counts:
        allowed -= n
        if allowed < 0:
            return place / SCORES
    return 0.0


def threshold(classifier: LogisticRegressionModel, between: list[str], found: DataFrame) -> float:
    """The score above which a family is believed."""
    spark = found.sparkSession
    held = [(label, text) for label, text in _texts(spark, 1) if label == 0]
    held = predicted(classifier, examples(spark, held, between)).where(F.col("similarity") >= SHARED)
    best = [F.max("similarity").alias("similarity"), F.max("score").alias("score")]
    near = found.groupBy("doc_id", "paragraph").agg(*best).where(F.col("similarity") < SHARED)
    return max(LEAST_SCORE, reached(held), reached(near))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, word, family, probability, similarity, text`` of notices found."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    classifier, between = train(docs)
    known = Anchors.of(spark)
    # repeated rows are told apart by a number
    rows = paragraphs(docs.withColumn("doc_id", F.struct("doc_id", F.monotonically_increasing_id().alias("row"))))
    found = predicted(classifier, windows(rows.where(known.among(F.col("text"))), known))
    found = written(found.where(F.col("similarity") >= NEAR).drop("words"), "licence-windows")
    least = threshold(classifier, between, found)
    sure = (F.col("similarity") >= SHARED) & (F.col("score") > least)
    best = F.max(F.struct("score", "similarity", "probability", "text", "word")).alias("best")
    found = found.where(sure).groupBy("doc_id", "paragraph", "family").agg(best)
    return found.select(
        "doc_id.doc_id", "paragraph", "best.word", "family", "best.probability", "best.similarity", "best.text"
    )
