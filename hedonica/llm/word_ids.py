"""Token ids of whole texts, for a vocabulary whose tokens never hold white space.

The library needs about 15 microseconds a word, most of it around the merges themselves. Such a
tokenizer treats the parts between spaces apart from each other (normalisation does not reach
across a space), so a worker remembers the ids of each part. Parts of Latin letters are cut
further, as the vocabulary's own pattern cuts them, so that ``Word`` and ``word,`` are merged
once, by the library's merges alone: nothing else of its pipeline changes such a piece but the
alphabet of bytes. All other parts go through the whole library. A part is looked up once: a
known one by the dict itself, a new one by the call that the dict makes for it. Of a column of
texts Arrow cuts the parts, numbers them and puts their ids in place, a slice of the texts at a
time, so that what Python does is done once for each unlike part of a slice.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hedonica.llm.common import Remembered, tokenizer

WORD_BPE = "word_bpe_49k.json"
ID = np.dtype("<u4")
assert sys.byteorder == "little" and array("I").itemsize == ID.itemsize
# What a worker remembers, twice as many at most: about 15 and 75 MB a generation. Parts are looked
# up once a slice, so that few need to be remembered; pre-tokens save the merges.
PARTS, PRE_TOKENS = 100_000, 400_000
# Bytes of text whose parts are numbered together; a longer text is a slice by itself.
SLICE = 8 << 20
# Texts whose ids are put in place together.
TAKEN = 256
# The vocabulary's pattern over lower-case Latin-1; letters, numbers and blanks as it has them.
_LETTERS, _NUMBERS, _BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PRE_TOKENS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
).findall

# The alphabet of bytes: printable Latin-1 stands for itself, all others follow 255 in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class WordIds:
    """Texts -> their ids, as little-endian bytes; bounded in memory."""

    def __init__(self, name: str):
        tok = tokenizer(name)
        self.encode, self.merges = tok.encode, tok.model.tokenize
        self.pre_tokens = Remembered(self.pre_token, PRE_TOKENS)
        self.parts = Remembered(self.part, PARTS)
        # Bound methods of dict: what is known is looked up without any Python code.
        self.ids_of_pre_token = self.pre_tokens.__getitem__
        self.ids_of_part = self.parts.__getitem__

    def library(self, text: str) -> bytes:
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()

    def pre_token(self, text: str) -> bytes:
        if not (text.isascii() and text.isprintable()):
            text = text.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.merges(text)]).tobytes()

    def part(self, text: str) -> bytes:
        """A part in Latin letters by its pre-tokens; special strings are the library's."""
        if text.isascii():
            if text.isalpha():
                return self.ids_of_pre_token(text.lower())
        else:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.library(text)
        if "<|" in text:
            return self.library(text)
        return b"".join(map(self.ids_of_pre_token, _PRE_TOKENS(text.lower())))

    def of(self, text: str | None) -> bytes:
        """The ids of a whole text; none for NULL."""
        if not text:
            return b""
        return b"".join(map(self.ids_of_part, text.replace("\n", " ").split(" ")))

    def of_column(self, texts: pa.Array) -> Iterator[bytes]:
        """What ``of`` gives for each text of a column."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + SLICE, side="right")) - 1)
            yield from self.of_slice(texts.slice(first, last - first))
            first = last

    def of_slice(self, texts: pa.Array) -> Iterator[bytes]:
        lines = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        parts = pc.split_pattern(lines, " ")
        del lines
        numbered = parts.flatten().dictionary_encode()
        begins = np.array(parts.offsets)
        del parts
        known = [self.ids_of_part(part) for part in numbered.dictionary.to_pylist()]
        known, numbers = pa.array(known, pa.large_binary()), numbered.indices
        del numbered
        pa.default_memory_pool().release_unused()  # else a worker keeps it while others need it
        for first in range(0, len(texts), TAKEN):
            at = begins[first : first + TAKEN + 1]
            ids = known.take(numbers.slice(at[0], at[-1] - at[0]))
            _, ends, data = ids.buffers()
            ends = np.frombuffer(ends, np.int64)[at - at[0]].tolist()
            data = memoryview(b"" if data is None else data)
            yield from (bytes(data[a:b]) for a, b in zip(ends, ends[1:]))


@lru_cache(maxsize=2)
def word_ids(name: str = WORD_BPE) -> WordIds:
    """The worker's own cache; it lives as long as the worker process."""
    return WordIds(name)
