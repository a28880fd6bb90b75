"""Personal data in texts: patterns propose, checksums confirm, context words adjust.

For each kind a regular expression proposes leftmost non-overlapping spans. A text is split
at them, so their places follow from the lengths of the pieces, and the words around a span
are the ends of the pieces beside it; where these have no word that counts, words further on
are read across neighbouring spans, and entries of a list share theirs. Card numbers must pass Luhn, account numbers (IBAN)
mod-97; both then count as certain. The kinds without a checksum start from a lower score,
which words like ``phone`` or ``ssn`` just before or after raise and words like ``invoice`` before it lower,
unless one of the first names the span directly after it (``order 555-123-4567 phone``); a
span is taken from a score of ``ACCEPT`` on. The four base kinds are taken whenever their own
check holds; their score only tells how sure it is.

Patterns are possessive and start only where a match can: their time is proportional to the
text, also for very long runs. Everything is columns of built-in functions: no shuffle, no
Python. NULL and empty texts have no spans; repeated rows are judged alike; an empty table
gives no rows; extra columns are kept by ``redacted`` and by ``with_spans``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedonica.llm.common import fresh
from hedonica.llm.quality import let

ACCEPT = 0.5
CONTEXT_CHARS = 40
CONTEXT_WEIGHT = 0.3
# Spans that are added up, or cut out, at a time: keeps a text with many spans linear.
AT_ONCE = 128
SPAN = "struct<start:int,end:int,score:double>"
PLACED = "struct<start:int,size:int,text:string,before:string,after:string>"
# What may stand between the entries of a list: they share the words around the list.
BETWEEN = "(?i)^[^\\p{L}]*+(?:(?:and|or)\\b[^\\p{L}]*+)?$"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def n_digits_between(text: Column, low: int, high: int) -> Column:
    return F.length(digits(text)).between(low, high)


def luhn(text: Column) -> Column:
    """The digits of ``text``, from the right, every second one doubled, add up to tens."""
    doubled = F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)])

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, doubled[d]).otherwise(d)

    each = F.transform(F.split(F.reverse(digits(text)), ""), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """An account number whose first four characters, moved to the end, leave a rest of one."""
    plain = F.regexp_replace(text, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        letter = (rest * 100 + F.ascii(c) - 55) % 97
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise(letter)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _byte_parts(text: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return text.rlike(f"^{part}(?:\\.{part}){{3}}$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a text without it has no span of this kind
    holds: Callable[[Column], Column]
    score: float
    context: str  # words that raise the score
    base: bool = False


# Lengths of account numbers by country, as registered, and those in use beside the register.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST AO CV GW MZ",
    26: "IS TR DZ IR", 27: "FR GR IT MC MR SM BI CF CG CM DJ GA GQ KM MG TD", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV BF BJ CI MA ML NE SN TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_KNOWN = "(?:" + "|".join(" ".join(IBAN_COUNTRIES.values()).split()) + ")[0-9]{2}"
# The country tells the length; of other codes as much as there is, up to a known country's number.
_IBAN = "|".join(
    [f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items()]
    + [f"(?!{_IBAN_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?! {_IBAN_KNOWN}) ?[A-Z0-9]){{11,30}}"]
)
_LOCAL = "A-Za-z0-9._%+-"
# The first four are fixed by contract: patterns match what those of the contract match.
KINDS = [
    Kind(
        "email",
        f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
        "@", lambda m: F.lit(True), 0.7, "mail|contact|write", base=True,
    ),
    Kind(
        "ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
        "[0-9]\\.[0-9]", _byte_parts, 0.6, "\\bip\\b|address|host|server", base=True,
    ),
    Kind(
        "card", "[0-9](?:[ -]?[0-9])++",
        "[0-9](?:[ -]?[0-9]){12}", lambda m: n_digits_between(m, 13, 19) & luhn(m), 0.7,
        "card|visa|credit|payment", base=True,
    ),
    Kind(
        "phone", "\\+[0-9][ ().0-9-]+[0-9]",
        "\\+[0-9]", lambda m: n_digits_between(m, 9, 15), 0.6, "phone|tel|call|fax|mobile", base=True,
    ),
    Kind(
        "iban", f"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}", mod97, 0.7, "iban|account|bank|konto",
    ),
    Kind(
        "ssn", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "[0-9]-[0-9]{2}-[0-9]", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3,
        "ssn|social[ -]security|taxpayer",
    ),
    Kind(
        "local_phone", "(?<![0-9+.-])\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
        "[0-9]{3}[ .-][0-9]{4}", lambda m: F.lit(True), 0.3, "phone|tel|call|fax|mobile",
    ),
]
DOUBT = "invoice|order|isbn|version|serial"


def running(items: Column, item_type: str, step, emit, total: str = "int") -> Column:
    """``emit(total before, item)`` for each item; ``step`` gives the next total.

    Arrays are copied when they grow, so items are taken ``AT_ONCE`` at a time.
    """

    def one(a: Column, x: Column) -> Column:
        out = F.concat(a["out"], F.array(emit(a["at"], x)))
        return F.struct(step(a["at"], x).cast(total).alias("at"), out.alias("out"))

    def some(a: Column, k: Column) -> Column:
        zero = F.struct(a["at"].alias("at"), F.array().cast(f"array<{item_type}>").alias("out"))
        part = F.aggregate(F.slice(items, k * AT_ONCE + 1, AT_ONCE), zero, one)
        joined = lambda p: F.struct(p["at"].alias("at"), F.concat(a["out"], F.array(p["out"])).alias("out"))
        return let(part, joined)

    first = F.lit("" if total == "string" else 0).cast(total)
    zero = F.struct(first.alias("at"), F.array().cast(f"array<array<{item_type}>>").alias("out"))
    parts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / AT_ONCE).cast("int"))
    every = F.aggregate(parts, zero, some, lambda a: F.flatten(a["out"]))
    return F.when(F.size(items) == 0, F.array().cast(f"array<{item_type}>")).otherwise(every)


def proposed(text: Column, pattern: str) -> Column:
    """Matches with their places in code points and the text just before and after them."""

    def placed(found: Column) -> Column:
        matches = found["matches"]
        pieces = F.slice(found["pieces"], F.lit(1), F.size(matches))
        beside = F.arrays_zip(
            F.transform(pieces, lambda p: F.struct(
                F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT_CHARS)).alias("before"),
            )).alias("p"),
            F.transform(
                F.slice(found["pieces"], F.lit(2), F.size(matches)), lambda p: F.left(p, F.lit(CONTEXT_CHARS))
            ).alias("after"),
        )
        items = F.zip_with(beside, matches, lambda b, m: F.struct(
            b["p"]["gap"].alias("gap"), F.length(m).alias("size"), m.alias("text"),
            b["p"]["before"].alias("before"), b["after"].alias("after"),
        ))
        return let(items, lambda items: running(
            items, PLACED,
            lambda at, x: at + x["gap"] + x["size"],
            lambda at, x: F.struct(
                (at + x["gap"]).alias("start"), x["size"].alias("size"), x["text"].alias("text"),
                x["before"].alias("before"), x["after"].alias("after"),
            ),
        ))

    found = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
    )
    return let(found, placed)


def carried(own: Column, counts: str, before: bool) -> Column:
    """For each of ``own`` the words that reach it, across spans if its own have none that counts."""

    def seen(at: Column, x: Column) -> Column:
        both = F.right(F.concat_ws(" ", at, x), F.lit(CONTEXT_CHARS))
        if not before:
            both = F.left(F.concat_ws(" ", x, at), F.lit(CONTEXT_CHARS))
        joins = (F.length(x) < CONTEXT_CHARS) & x.rlike(BETWEEN)
        return F.when(x.rlike(counts), x).when(joins, at).when(F.length(x) < CONTEXT_CHARS, both).otherwise(x)

    return running(own, "string", seen, seen, "string")


def spans(text: Column, kind: Kind) -> Column:
    """Accepted spans of one kind, ascending: start, end (exclusive) and score."""

    context, doubt = f"(?i){kind.context}", f"(?i)\\b(?:{DOUBT})"
    names = f"(?i)^ ?\\(?(?:{kind.context})"

    def scored(x: Column, words: Column) -> Column:
        # words across spans count only if they raise: a doubt stays with the span it is beside
        near = words["before"].rlike(context)
        raised = F.when(near | words["after"].rlike(context), CONTEXT_WEIGHT).otherwise(0.0)
        doubted = F.when(near, words["before"]).otherwise(x["before"]).rlike(doubt) & ~x["after"].rlike(names)
        score = F.least(F.lit(1.0), F.lit(kind.score) + raised - F.when(doubted, CONTEXT_WEIGHT).otherwise(0.0))
        return F.struct(
            x["start"].alias("start"), (x["start"] + x["size"]).alias("end"), score.alias("score"),
            x["text"].alias("text"),
        )

    def judged(items: Column) -> Column:
        before = carried(F.transform(items, lambda x: x["before"]), f"{context}|\\b(?:{DOUBT})", True)
        after = F.reverse(carried(F.reverse(F.transform(items, lambda x: x["after"])), context, False))
        words = F.arrays_zip(before.alias("before"), after.alias("after"))
        held = F.filter(F.zip_with(items, words, scored), lambda x: kind.holds(x["text"]))
        return F.transform(held, lambda x: F.struct(x["start"], x["end"], x["score"]))

    found = let(proposed(text, kind.pattern), judged)
    if not kind.base:
        found = F.filter(found, lambda x: x["score"] >= ACCEPT)
    return F.when(text.rlike(kind.hint), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a struct of the spans of every kind; the struct's name."""
    name = fresh(docs, "personal")
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn(name, F.struct(*[spans(text, k).alias(k.name) for k in KINDS])), name


def listed(found: Column, kinds: list[Kind]) -> Column:
    """``kind:start:end`` of all spans, by kind and start, comma-joined."""

    def lines(kind: Kind) -> Column:
        return F.transform(found[kind.name], lambda x: F.concat_ws(":", F.lit(kind.name), x["start"], x["end"]))

    return F.array_join(F.concat(*[lines(k) for k in kinds]), ",")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, a hash of the base spans, and all spans."""
    df, name = with_spans(docs.select("doc_id", "text"))
    base, found = [k for k in KINDS if k.base], F.col(name)
    return df.select(
        "doc_id",
        *[F.size(found[k.name]).cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(listed(found, base), 256).alias("base_sha256"),
        listed(found, KINDS).alias("spans"),
    )


def without_spans(text: Column, found: Column) -> Column:
    """The text with ``<KIND>`` in place of each span; overlapping spans are one place."""

    def named(kind: Kind) -> Column:
        return F.transform(found[kind.name], lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(f"<{kind.name.upper()}>").alias("mark")
        ))

    every = F.array_sort(F.concat(*[named(k) for k in KINDS]))

    def cut(items: Column) -> Column:
        # per span: where the text before it starts, its own start and end, and its mark
        kind = "struct<since:int,start:int,end:int,mark:string>"
        joined = running(
            items, kind,
            lambda at, x: F.greatest(at, x["end"]),
            lambda at, x: F.struct(
                at.alias("since"), x["start"].alias("start"), x["end"].alias("end"),
                F.when(x["start"] >= at, x["mark"]).otherwise("").alias("mark"),
            ),
        )
        return let(joined, lambda s: pasted(text, s))

    return F.when(F.size(every) == 0, text).otherwise(let(every, cut))


def pasted(text: Column, s: Column) -> Column:
    """Texts between spans and the marks, ``AT_ONCE`` spans of the text at a time."""

    def some(k: Column) -> Column:
        part = F.slice(s, k * AT_ONCE + 1, AT_ONCE)

        def of(part: Column) -> Column:
            since = part[0]["since"]
            upto = F.greatest(since, F.element_at(part, -1)["start"])
            here = F.substring(text, since + 1, upto - since)
            return let(here, lambda here: F.array_join(F.transform(part, lambda x: F.concat(
                F.substring(here, x["since"] - since + 1, F.greatest(x["start"] - x["since"], F.lit(0))),
                x["mark"],
            )), ""))

        return let(part, of)

    parts = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / AT_ONCE).cast("int"))
    end = F.array_max(F.transform(s, lambda x: x["end"]))
    rest = F.substring(text, end + 1, F.length(text))
    return F.concat(F.array_join(F.transform(parts, some), ""), rest)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; NULL stays NULL."""
    df, name = with_spans(docs)
    return df.withColumn("text", without_spans(F.col("text"), F.col(name))).drop(name)
