"""What the operators of this subpackage share: input tables, names, tokenizers."""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Longer words are encoded each time, so that a cache entry has a bounded size.
CACHED_CHARS = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it came with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tokenizer_path(name: str) -> str:
    """Where this machine has a public vocabulary; ``name`` may also be a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(name: str):
    """The tokenizer of one worker process, loaded once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


class Remembered(dict):
    """Results of ``find`` for short texts: those of the last ``size`` to ``2 * size`` asked for.

    A full generation becomes the old one; what is asked for again moves to the new one.
    """

    def __init__(self, find, size: int):
        super().__init__()
        self.find, self.size, self.old = find, size, {}

    def __missing__(self, text: str):
        value = self.old.get(text)
        if value is None:
            value = self.find(text)
        if len(text) <= CACHED_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[text] = value
        return value
