"""Public tokenizers applied chunk by chunk, with a bounded memory of chunks already encoded.

The tokenizers here never join text across certain white space, so a text's ids are
the concatenated ids of its chunks and every distinct chunk is encoded once per
worker. ``CHUNKING`` states the rule for each file; any other file gets whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

MEMORY = 300_000
LONGEST = 64

_PAIR = re.compile(r"\s\s")
_CONTROL = re.compile("[\x1c-\x1f]")  # white space to Python, not to the tokenizers
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def leading_space(text: str) -> list[str]:
    """Chunks that begin with the space before them, for byte-level BPE with that word pattern."""
    if "<|" in text or _CONTROL.search(text):  # white space before a special token stays together
        return [text]
    if _PAIR.search(text):
        return _SPACED.findall(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def _latin(text: str) -> bool:
    """Has a text only characters whose lower case is one character, and that have one form."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def no_space(text: str) -> list[str]:
    """Chunks between spaces and line feeds, for tokenizers that drop white space and fold case."""
    if "<|" not in text and _latin(text):  # not to make a special token of other text
        text = text.lower()
    return text.replace("\n", " ").split(" ")


CHUNKING: dict[str, Callable[[str], list[str]]] = {
    "byte_bpe_50k.json": leading_space,
    "word_bpe_49k.json": no_space,
}
_MARKS = ".,;:!?#$%&*"


def one_word(chunk: str) -> bool:
    """Is a chunk one word of ASCII letters, which no pattern splits and no normaliser changes."""
    word = chunk.removeprefix(" ")
    return word.isascii() and word.isalpha()


class _Memory(dict):
    """What ``make`` gives for a chunk; the first ``MEMORY`` short chunks are remembered.

    Marks after a word are a chunk of their own to every tokenizer in ``CHUNKING``;
    for others ``part`` is false.
    """

    def __init__(self, make: Callable[[str], object], part: bool):
        super().__init__()
        self.make, self.part = make, part

    def __missing__(self, chunk: str):
        word = chunk.rstrip(_MARKS)
        parted = self.part and word != chunk and one_word(word)
        made = self[word] + self[chunk[len(word) :]] if parted else self.make(chunk)
        if len(self) < MEMORY and len(chunk) <= LONGEST:
            self[chunk] = made
        return made


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _ids(path: str) -> Callable[[str], list[int]]:
    """Ids of a chunk; one word goes straight to the tokenizer's model, in the form that model knows."""
    tokenizer = _tokenizer(path)
    model, rule = tokenizer.model, CHUNKING.get(os.path.basename(path))

    def ids(chunk: str) -> list[int]:
        if rule and one_word(chunk) and (rule is leading_space or chunk.islower()):
            return [token.id for token in model.tokenize(chunk.replace(" ", "Ġ"))]
        return tokenizer.encode(chunk, add_special_tokens=False).ids if chunk else []

    return ids


@lru_cache(maxsize=4)
def _counts(path: str) -> _Memory:
    ids = _ids(path)
    return _Memory(lambda chunk: len(ids(chunk)), os.path.basename(path) in CHUNKING)


@lru_cache(maxsize=4)
def _packed(path: str) -> _Memory:
    ids = _ids(path)
    return _Memory(lambda chunk: np.asarray(ids(chunk), dtype="<u4").tobytes(), os.path.basename(path) in CHUNKING)


def _chunks(path: str) -> Callable[[str], list[str]]:
    return CHUNKING.get(os.path.basename(path), lambda text: [text])


def count_ids(path: str, texts: Iterable[str | None]) -> Iterator[int]:
    """Number of ids of each text; a null counts as empty."""
    known, chunks = _counts(path), _chunks(path)
    return (sum(map(known.__getitem__, chunks(text or ""))) for text in texts)


def packed_ids(path: str, text: str | None) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit numbers; a null counts as empty."""
    return b"".join(map(_packed(path).__getitem__, _chunks(path)(text or "")))
