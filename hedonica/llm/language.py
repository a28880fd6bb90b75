"""Language of texts by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, words padded
by a blank), most frequent first. That of a language is counted over all its texts to learn
from; a text is given the language whose profile has the least out-of-place distance to its
own: the sum, over the text's n-grams, of how far their ranks lie apart, or ``RANKS`` where
the language's profile lacks one.

Counting adds up n-grams in each task, and only these sums are shuffled. Profiles have
``RANKS`` entries a language, and at most ``MAX_LANGUAGES`` languages (16 bytes an entry) are
broadcast at a time. More are taken in slices by name, one pass over the texts for each, that
keeps the nearest so far; texts and passes are written in between.

A very long text is counted in chunks, all of it. NULL texts and texts without a letter are ``und``, with score 0, as all are if there is
nothing to learn from. Equal distances go to the first language by name. Texts of NULL
language or NULL ``doc_id`` are not learned from. Repeated rows are judged alike; an empty
table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedonica.llm.common import fresh
from hedonica.session import written

RANKS = 300
MAX_LANGUAGES = 4_000
UNKNOWN = "und"
CHUNK = 1 << 20  # letters counted at a time
NO_LETTERS = re.compile(r"[\W\d_]+")
_BLANK = ord(" ")
_SHIFT = 21  # bits of a code point


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, as ascending numbers, and their counts, over the whole text."""
    text = f" {NO_LETTERS.sub(' ', text.lower()).strip()} "
    codes, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(text) < 3:
        return codes, counts
    for at in range(0, len(text) - 1, CHUNK):
        part = np.frombuffer(text[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        first = part.astype(np.int64)
        second, third = first[1:] << _SHIFT, first[2:] << 2 * _SHIFT
        own = min(CHUNK, len(part))  # the two after it are counted as first letters next time
        one = first[:own]
        two = first[: len(second)][:own] | second[:own]
        three = first[: len(third)] | second[: len(third)] | third
        inner = first[1 : len(third) + 1] != _BLANK
        found = np.concatenate([one[one != _BLANK], two, three[inner][:]])
        codes, counts = added(codes, counts, *np.unique(found, return_counts=True))
    return codes, counts


def added(codes: np.ndarray, counts: np.ndarray, more: np.ndarray, n: np.ndarray):
    """Two sorted lists of counts as one."""
    if not len(codes):
        return more, n
    merged, where = np.unique(np.concatenate([codes, more]), return_inverse=True)
    return merged, np.bincount(where, np.concatenate([counts, n])).astype(np.int64)


def profile(text: str) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first; ties by number."""
    codes, counts = ngrams(text)
    return codes[np.argsort(-counts, kind="stable")[:RANKS]]


def ranked(known: DataFrame) -> DataFrame:
    """``lang, code, rank``: the profiles learned from ``lang, text``, without NULLs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                texts.setdefault(lang, []).append(text.as_py())
            for lang, held in texts.items():
                more = ngrams(" ".join(held))
                totals[lang] = added(*totals[lang], *more) if lang in totals else more
        for lang, (codes, counts) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                ["lang", "code", "n"],
            )

    sums = known.mapInArrow(counted, "lang string, code bigint, n bigint").groupBy("lang", "code")
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    order = sums.agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(by) - 1)
    return order.where(F.col("rank") < RANKS).select("lang", "code", "rank")


def arrays(top: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, and n-gram, language number and rank of the entries, by n-gram."""
    names = sorted(set(top["lang"].to_pylist()))
    number = {lang: i for i, lang in enumerate(names)}
    code, rank = top["code"].to_numpy(), top["rank"].to_numpy().astype(np.int32)
    lang = np.array([number[x] for x in top["lang"].to_pylist()], dtype=np.int32)
    order = np.argsort(code, kind="stable")
    return names, code[order], lang[order], rank[order]


def profiles(docs: DataFrame, at_once: int = MAX_LANGUAGES) -> Iterator[tuple]:
    """The ``arrays`` of all languages in ``lang, text``, ``at_once`` languages at a time."""

    def first(langs: DataFrame) -> list[str]:
        return [r["lang"] for r in langs.distinct().orderBy("lang").limit(at_once + 1).collect()]

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    names = first(known.select("lang"))
    if len(names) <= at_once:
        yield arrays(ranked(known).toArrow())
        return
    top = written(ranked(known), "language-profiles")
    while names:
        last = names[:at_once][-1]
        yield arrays(top.where(F.col("lang").between(names[0], last)).toArrow())
        names = first(top.select("lang").where(F.col("lang") > last))


class Classifier:
    def __init__(self, names: list[str], code: np.ndarray, lang: np.ndarray, rank: np.ndarray):
        self.names, self.code, self.lang, self.rank = names, code, lang, rank

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a text's profile to that of every language."""
        low = np.searchsorted(self.code, top, "left")
        n = np.searchsorted(self.code, top, "right") - low
        entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        apart = np.abs(self.rank[entry] - np.repeat(np.arange(len(top)), n))
        near = np.bincount(self.lang[entry], RANKS - apart, len(self.names))
        return RANKS * len(top) - near

    def of(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        top = profile(text)
        if not len(top):
            return UNKNOWN, 0.0
        far = self.distances(top)
        best = int(np.argmin(far))
        return self.names[best], float(1 - far[best] / (RANKS * len(top)))


@lru_cache(maxsize=1)
def _classifier(key: str, sent) -> Classifier:
    return Classifier(*sent.value)


def identified(
    docs: DataFrame, learn_from: DataFrame, keep: list[str], at_once: int = MAX_LANGUAGES
) -> DataFrame:
    """The columns ``keep`` of ``docs``, and ``lang_pred, score`` of its ``text``."""
    best, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    rows = docs.select(
        *keep, F.col("text").alias("text"), F.lit(UNKNOWN).alias(best), F.lit(0.0).alias(score)
    )
    slices = profiles(learn_from, at_once)
    sent = next(slices)
    while sent is not None:
        more = next(slices, None)
        rows = _nearer(rows, sent, len(keep))
        if more is not None:
            rows = written(rows, "languages-so-far")
        sent = more
    return rows.drop(rows.columns[len(keep)]).withColumnsRenamed({best: "lang_pred", score: "score"})


def _nearer(rows: DataFrame, learned: tuple, at: int) -> DataFrame:
    """``rows``, whose columns from ``at`` on are text, language and score so far, after one
    more slice of languages. Between slices the earlier one wins ties."""
    sent, key, schema = rows.sparkSession.sparkContext.broadcast(learned), uuid.uuid4().hex, rows.schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = _classifier(key, sent)
        for batch in batches:
            so_far = zip(batch.column(at + 1).to_pylist(), batch.column(at + 2).to_pylist())
            found = []
            for text, old in zip(batch.column(at), so_far):
                new = classifier.of(text.as_py())
                found.append(new if new[1] > old[1] or old[0] == UNKNOWN else old)
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], *new], schema.names)

    return rows.mapInArrow(judged, schema)


def fold(doc_id: str = "doc_id"):
    """0 to 3, from the id's text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out_predictions(docs: DataFrame, fold_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; the fold held out is not learned from."""
    out = F.coalesce(fold() == fold_out, F.lit(False))
    learn = docs.where(fold() != fold_out).select("lang", "text")
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    return identified(rows, learn, ["doc_id", "held_out"])
