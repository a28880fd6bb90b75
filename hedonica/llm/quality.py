"""Quality rules whose thresholds follow from the corpus, by language and source.

Four signs are measured on each text as whole numbers (millionths): symbols a word, upper-case
letters a character, repeated lines a line, characters a word. Their quantiles are kept in a
mergeable sketch: values fall into log-linear bins (eight leading bits, a relative error below
1/256), and the sketch of a (language, source) is its bin counts, combined before the shuffle.
Sketches merge by adding: sources merge to languages, languages to the corpus, and a pair with
fewer than ``MIN_DOCS`` documents takes the limits of the first larger group that has enough.

A document is rejected if a sign lies beyond its group's limit: the upper quartile and a multiple
of the distance from the median to it, both from the group's sketch. Upper-case share and word
length vary in every group, and their limits follow that spread; their least spread is of the
size of rounding. Symbols and repeated lines are zero in three quarters of most groups, so no
quantile there tells an odd document from the first with a single symbol: their least spread
is a share that a reader would notice. Documents are then joined with the limits of their group.
Two scans of the documents, no shuffle of texts, no Python.

NULL and empty texts have no words and fail the base rule. A NULL language or source is a
value like others. Repeated rows count as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedonica.llm.common import fresh
from hedonica.session import settled

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
MIN_DOCS = 200
BITS = 8
UNIT = 1_000_000
BLANKS = "[ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]+"
# Signs, the multiple of the spread that is allowed, and the least spread, in millionths.
SIGNS = {"symbols": (10, 20_000), "upper": (20, 600), "repeated": (10, 60_000), "length": (15, 20_000)}


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once a row however often it is used."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS + "+"), "")


def repeated_lines(text: Column) -> Column:
    """``n`` lines with a word, and how many of them equal an earlier one."""

    def counted(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("again"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return let(lines, counted)


def repeated_words(w: Column) -> Column:
    """Words inside 5-word windows found twice or more.

    A hash of every window shows whether any repeats; only then are windows compared as text.
    """
    n = F.size(w) - WINDOW + 1
    starts = F.sequence(F.lit(1), n)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def covered(spots: Column) -> Column:
        gaps = F.zip_with(
            spots, F.slice(spots, F.lit(2), F.size(spots)),
            lambda a, b: F.when(b.isNull() | (b - a > WINDOW), WINDOW).otherwise(b - a),
        )
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def exact(w: Column) -> Column:
        spots = F.transform(
            starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("t"), i.alias("i"))
        )
        return let(F.array_sort(spots), lambda s: covered(F.array_sort(_repeats(s))))

    some = F.size(F.array_distinct(hashes)) < n
    return F.when(n < 2, 0).when(some, exact(w)).otherwise(0)


def _repeats(s: Column) -> Column:
    """Places ``i`` of entries whose text a neighbour has too; ``s`` is sorted by text."""
    last = F.size(s)

    def place(k: Column) -> Column:
        here, before = F.element_at(s, k), F.element_at(s, F.greatest(k - 1, F.lit(1)))
        after = F.element_at(s, F.least(k + 1, last))
        same = ((k > 1) & (before["t"] == here["t"])) | ((k < last) & (after["t"] == here["t"]))
        return F.when(same, here["i"])

    return F.array_compact(F.transform(F.sequence(F.lit(1), last), place))


def measures(text: Column, repeats: bool) -> Column:
    """A struct of whole numbers; ``repeats`` adds the repeated words."""
    t = F.coalesce(text, F.lit(""))

    def counted(w: Column) -> Column:
        out = [F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars")]
        return F.struct(*out, *([repeated_words(w).alias("n_repeat_words")] if repeats else []))

    lines = repeated_lines(t)
    return F.struct(
        let(words(t), counted).alias("w"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).alias("n_symbols"),
        F.length(F.regexp_replace(t, "\\P{Lu}+", "")).alias("n_upper"),
        lines.alias("lines"),
    )


def sign_values(m: Column) -> dict[str, Column]:
    """The signs of a document with words, in millionths."""
    n, chars = m["w"]["n_words"], m["w"]["word_chars"]
    return {
        "symbols": _ratio(m["n_symbols"], n),
        "upper": _ratio(m["n_upper"], chars),
        "repeated": _ratio(m["lines"]["again"], m["lines"]["n"]),
        "length": _ratio(chars, n),
    }


def _ratio(a: Column, b: Column) -> Column:
    """Millionths, by whole-number division."""
    scaled = a.cast("long") * UNIT
    return F.when(b > 0, F.call_function("div", scaled, b.cast("long")))


def bin_of(value: Column) -> Column:
    """Lower end of the value's bin: its leading bits."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def limits(docs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source`` and the greatest value allowed of each sign, one row a group."""
    m = docs.select(
        F.col(lang).alias("lang"), F.col(source).alias("source"),
        measures(F.col("text"), False).alias("m"),
    )
    signs = sign_values(F.col("m"))
    enough = m.where(F.col("m.w.n_words") >= MIN_WORDS)
    rows = enough.select(
        "lang", "source",
        F.posexplode(F.array(*[bin_of(v) for v in signs.values()])).alias("sign", "bin"),
    )
    sketch = rows.groupBy("lang", "source", "sign", "bin").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    levels = [("lang", "source"), ("lang", None), (None, None)]
    groups = F.array(*[
        F.struct(
            F.lit(level).alias("level"), (F.col(by) if by else none).cast("string").alias("lang"),
            (F.col(of) if of else none).cast("string").alias("source"),
        )
        for level, (by, of) in enumerate(levels)
    ])
    # the sketches are small: their rows are copied for each level, so texts are read once
    merged = sketch.select(F.explode(groups).alias("group"), "sign", "bin", "n")
    merged = merged.select("group.*", "sign", "bin", "n")
    merged = merged.groupBy("level", "lang", "source", "sign", "bin").agg(F.sum("n").alias("n"))
    key = ["level", "lang", "source", "sign"]
    upto = Window.partitionBy(*key).orderBy("bin")
    ranked = merged.withColumns({
        "upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy(*key)),
    })
    quartiles = ranked.groupBy(*key).agg(
        F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("bin"))).alias("q2"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"),
        F.first("total").alias("total"),
    )
    reach, least = (F.array(*map(F.lit, column))[F.col("sign")] for column in zip(*SIGNS.values()))
    fence = F.col("q3") + reach * F.greatest(F.col("q3") - F.col("q2"), least)
    wide = quartiles.withColumn("fence", fence).groupBy("level", "lang", "source").agg(
        F.max("total").alias("docs"),
        *[F.max(F.when(F.col("sign") == i, F.col("fence"))).alias(s) for i, s in enumerate(SIGNS)],
    )
    return _finest(wide)


def _finest(wide: DataFrame) -> DataFrame:
    """For each language and source: the limits of the smallest group with enough documents."""
    wide, _ = settled(wide, "quality-groups")
    corpus = wide.where(F.col("level") == 2).first()
    corpus = corpus.asDict() if corpus else {}

    def at(level: int, *names: str) -> DataFrame:
        held = F.struct("docs", *SIGNS).alias(f"at{level}")
        return wide.where(F.col("level") == level).select(*names, held)

    pairs = at(0, "lang", "source")
    langs = at(1, F.col("lang").alias("_lang"))
    joined = pairs.join(langs, pairs["lang"].eqNullSafe(F.col("_lang")))
    whole = F.struct(*[F.lit(corpus.get(c)).cast("bigint").alias(c) for c in ("docs", *SIGNS)])
    use = F.when(F.col("at0.docs") >= MIN_DOCS, F.col("at0"))
    use = use.when(F.col("at1.docs") >= MIN_DOCS, F.col("at1")).otherwise(whole)
    return joined.select("lang", "source", use.alias("use")).select(
        "lang", "source", *[F.col(f"use.{s}").alias(s) for s in SIGNS]
    )


def judged(docs: DataFrame, lang: str = "lang", source: str = "source") -> tuple[DataFrame, str]:
    """``docs`` and a struct of its measures, ``base_failed`` and ``kept``; the struct's name."""
    name, key_lang, key_source, fence = (fresh(docs, c) for c in ("quality", "lang_", "source_", "fence"))
    found, small = settled(limits(docs, lang, source), "quality-limits")
    found = found.select(
        F.col("lang").alias(key_lang), F.col("source").alias(key_source),
        F.struct(*SIGNS).alias(fence),
    )
    measured = docs.withColumn(name, measures(F.col("text"), True))
    measured = measured.join(
        F.broadcast(found) if small else found,
        F.col(lang).eqNullSafe(F.col(key_lang)) & F.col(source).eqNullSafe(F.col(key_source)),
        "left",
    )
    m, n, again = F.col(name), F.col(f"{name}.w.n_words"), F.col(f"{name}.w.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * again > MAX_REPEATED_PERCENT * n)
    beyond = F.lit(False)
    for sign, value in sign_values(m).items():
        beyond = beyond | F.coalesce(value > F.col(fence)[sign], F.lit(False))
    verdict = F.struct(
        n.cast("long").alias("n_words"),
        m["w"]["word_chars"].cast("long").alias("word_chars"),
        m["n_symbols"].cast("long").alias("n_symbols"),
        m["lines"]["again"].cast("long").alias("n_dup_lines"),
        again.cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        # a sum, which a filter can't split and so compute in part again before the join
        (failed.cast("int") + beyond.cast("int") == 0).alias("kept"),
    )
    return measured.withColumn(name, verdict).drop(key_lang, key_source, fence), name


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    df, name = judged(docs)
    return df.where(F.col(name)["kept"]).drop(name)
