"""Token ids of whole texts with a vocabulary file of the tokenizers library.

The pre-tokens of a text are independent of each other, and most of them occur again
and again, so each distinct pre-token is encoded once per Python worker and texts are
put together from the stored ids. The cut below is the pre-tokenizer's own for Latin
text; a text with any other character is handed to the library whole, so the ids are
always the library's.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
from tokenizers import Tokenizer

# Letters and numbers among the code points up to U+024F.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
# Characters whose class every library agrees on, and the only white space among them.
UNUSUAL = re.compile("[^\n\x20-\x7e¡-įı-ɏ‐-‧]")
BYTE_LEVEL = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
SPECIAL = "<|"  # texts with it go to the library whole: special tokens are its matter


class _Seen(dict):
    """Numbers pre-tokens in the order they turn up."""

    def __init__(self, *known):
        super().__init__(*known)
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number


class Encoder:
    """Ids of texts; keeps about ``limit`` pre-tokens at most, the more frequent half when full."""

    def __init__(self, path: str, limit: int = 400_000):
        self.library = Tokenizer.from_file(path)
        pre = str(self.library.pre_tokenizer)
        self.cut = WORD_LEVEL if "Split" in pre else BYTE_LEVEL
        self.limit = limit
        # How byte-level vocabularies write bytes: visible Latin-1 characters as they are, the rest from U+0100 on.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
        self.shown = {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.seen = _Seen()
        self.pool = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        names = list(self.seen)
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.limit // 2])
        count = self.count[kept].astype(np.int64)
        upto = np.cumsum(count)
        self.pool = self.pool[np.repeat(self.first[kept] - upto + count, count) + np.arange(upto[-1])]
        self.first, self.count, self.uses = upto - count, self.count[kept], self.uses[kept] // 2
        self.seen = _Seen((names[i], k) for k, i in enumerate(kept.tolist()))

    def _learn(self) -> None:
        fresh, self.seen.fresh = self.seen.fresh, []
        if not fresh:
            return
        # A pre-token needs no cutting any more: its bytes, written as characters, go to the merges. Of the usual
        # ASCII characters only the blanks are written as others.
        merge, shown, space, newline = self.library.model.tokenize, self.shown, self.shown[32], self.shown[10]
        found = [[t.id for t in merge(
            p.replace(" ", space).replace("\n", newline) if p.isascii()
            else p.encode().decode("latin-1").translate(shown))] for p in fresh]
        count = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(count.sum()))
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(count, dtype=np.int64) - count])
        self.count = np.concatenate([self.count, count])
        self.uses = np.concatenate([self.uses, np.zeros(len(count), np.int32)])
        self.pool = np.concatenate([self.pool, flat])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One uint32 array of ids per text."""
        if len(self.seen) > self.limit:
            self._shrink()
        # Lower case first, as that vocabulary does, leaves fewer distinct pre-tokens. Some lower-case letters
        # stand far from their capitals, so it is the text to be cut that must have usual characters.
        shaped = [t.lower() for t in texts] if self.cut is WORD_LEVEL else texts
        plain = [not (UNUSUAL.search(t) or SPECIAL in t) for t in shaped]
        pieces: list[str] = []
        ends = []
        for text, easy in zip(shaped, plain):
            if easy:
                pieces += self.cut.findall(text)
            ends.append(len(pieces))
        which = np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        self.uses += np.bincount(which, minlength=len(self.uses)).astype(np.int32)
        count, first = self.count[which], self.first[which]
        upto = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        flat = self.pool[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])]
        bounds = upto[np.asarray([0, *ends])]
        out = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        whole = [i for i, easy in enumerate(plain) if not easy]
        if whole:
            done = self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
            for i, e in zip(whole, done):
                out[i] = np.asarray(e.ids, np.uint32)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
