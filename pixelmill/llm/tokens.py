"""A byte-level BPE encoder that asks the tokenizers library once per distinct pre-token.

Byte-level BPE merges within a pre-token only, so a text's ids are its pre-tokens' ids in a row. Texts of common characters
are cut into pre-tokens by WORDS, and the ids of each are remembered; new ones go to the library many at a time, already
split, with a byte between them that no such text holds. Other texts go to the library whole. Equality with the library on
whole texts is tested.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np

from pixelmill.llm.common import remembered

#: Same matches as the vocabulary's own splitting pattern on texts without an ODD character.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = re.compile("[^\n\x20-\x7eÀ-ɏ]")
_WORKER = remembered("tokens")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Two generations of words are remembered, each of at most max_words, and of 80 bytes a word (and one call's): a full one
    becomes the old one, whose words move up when they are met again. Python's objects take some 250 bytes a word.
    """

    def __init__(self, path: str, max_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import pre_tokenizers

        self.path, self.library = path, None
        self.split = self._load()
        self.split.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # for words as WORDS finds them
        (self.gap,) = self.split.encode("\0", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.max_words, self.max_bytes, self.bytes = max_words, 80 * max_words, 0

    def _load(self):
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True  # their strings in a text are ordinary text
        return out

    def _whole(self, text: str) -> bytes:
        if self.library is None:
            self.library = self._load()
        (found,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return array("I", found.ids).tobytes()

    def _learn(self, words: list[str], at_once: int = 1000) -> None:
        """Ids of new words, each a match of WORDS."""
        for i in range(0, len(words), at_once):
            part = words[i : i + at_once]
            given = [x for w in part for x in (w, "\0")]
            (found,) = self.split.encode_batch_fast([given], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self.gap)).tolist()
            data = ids.tobytes()
            self.bytes += len(data) + sum(map(len, part))
            self.known.update((w, data[lo:hi]) for w, lo, hi in zip(part, [0, *(x + 4 for x in ends[:-1])], ends, strict=True))

    def _recall(self, words: set[str]) -> set[str]:
        """Moves up what the old generation knows; the rest."""
        for w in words & self.old.keys():
            self.known[w] = x = self.old[w]
            self.bytes += len(w) + len(x)
        return words - self.known.keys()

    def encode(self, texts: list[str]) -> list[bytes]:
        on = gc.isenabled()
        gc.disable()  # many strings and no cycles: collections would walk everything remembered
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if ODD.search(x) else WORDS.findall(x) for x in texts]
        new = self._recall(set().union(*(c for c in cut if c is not None)).difference(self.known))
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) if c is not None else self._whole(x) for x, c in zip(texts, cut, strict=True)]
        if len(self.known) > self.max_words or self.bytes > self.max_bytes:
            self.old, self.known, self.bytes = self.known, {}, 0
        return out


def encoder(path: str, remember: int) -> Encoder:
    """The worker's own encoder, kept between tasks."""
    if _WORKER.get("of") != (path, remember):
        _WORKER.update(of=(path, remember), encoder=Encoder(path, remember))
    return _WORKER["encoder"]


def some(texts: list[str], most: int = 4 << 20):
    """(first, last) of runs of texts of about so many characters, so that a batch of long texts stays small."""
    first = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
