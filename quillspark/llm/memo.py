"""Tokens of pieces of text, kept for pieces that come again."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import compress, count, repeat
from operator import is_

import numpy as np

#: A space before a character that isn't white space. In byte-level BPE a token starts at each such space, whatever stands
#: before it: no token holds a space after its first character, and a run of spaces leaves its last one to what follows.
STABLE = re.compile(r" (?=\S)")


class Memo:
    """What ``make`` gives for pieces, in ``known``. ``limit`` bounds what is kept, never what is encoded: when it is reached,
    all is forgotten but what the texts at hand have new."""

    def __init__(self, path: str, limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.checked(json.loads(self.tokenizer.to_str()))

    def checked(self, definition: dict) -> None:
        """An error unless texts come apart as ``make`` takes for granted."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def make(self, pieces: list[str]) -> None:
        """Adds to ``known``, from which nothing of ``pieces`` may be missing then."""
        raise NotImplementedError

    def values(self, texts: list[list[str]]) -> list[list]:
        """What is known of each piece of each text. Each piece is looked up once; only those that are new are made."""
        found = [list(map(self.known.get, pieces)) for pieces in texts]
        wanted: set[str] = set()
        for pieces, values in zip(texts, found, strict=True):
            wanted.update(compress(pieces, map(is_, values, repeat(None))))
        if len(self.known) + len(wanted) > self.limit:
            self.known.clear()
        new = list(wanted)
        for i in range(0, len(new), 20_000):
            self.make(new[i : i + 20_000])
        for pieces, values in zip(texts, found, strict=True):
            for i in list(compress(count(), map(is_, values, repeat(None)))):
                values[i] = self.known[pieces[i]]
        return found


class SpacedCounts(Memo):
    """Number of tokens of a space and the piece, for byte-level BPE that leaves texts as they are."""

    def checked(self, definition: dict) -> None:
        pre = definition["pre_tokenizer"] or {}
        if definition["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            raise ValueError("pieces are counted apart only for byte-level BPE with its own pattern, no normaliser and no added space")

    def make(self, pieces: list[str]) -> None:
        self.known.update(zip(pieces, (len(e.ids) for e in self.encode([f" {p}" for p in pieces])), strict=True))


class WordIds(Memo):
    """Ids, as little-endian 32-bit bytes, of pieces without the white space around them.

    For tokenizers that lower-case, split at white space and drop it, and part letters from punctuation. Words are encoded
    many at a time with MARK between them. Punctuation that ends a word is encoded apart from it, so that a word is encoded
    once with all its endings; a word of small Latin letters is in normal form and needs no normaliser.
    """

    MARK, TOGETHER = "\x01", 64
    #: Small letters of Latin-1, which normalisers leave alone, then ASCII punctuation but the apostrophe, which may begin a token.
    ENDED = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def checked(self, definition: dict) -> None:
        steps = [s.get("type") for s in (definition["normalizer"] or {}).get("normalizers", [])]
        first = ((definition["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        if "Lowercase" not in steps or (first.get("type"), first.get("behavior"), first.get("invert")) != ("Split", "Removed", True):
            raise ValueError("words are encoded apart only for tokenizers that lower-case and drop white space")

    def __init__(self, path: str, limit: int = 800_000):
        super().__init__(path, limit)
        (self.mark_id,) = self.encode([self.MARK])[0].ids
        self.plain = type(self.tokenizer).from_file(path)
        self.plain.normalizer = None

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    @staticmethod
    def split(text: str) -> list[str]:
        """Parts of a text that are encoded alike each on its own. Special tokens are told by case, so where there may be one
        case is left to the tokenizer."""
        if "<|" not in text:
            text = text.encode().lower().decode()  # A-Z only
        return text.replace("\n", " ").split(" ")

    def _together(self, tokenizer, words: list[str]) -> None:
        groups = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([f" {self.MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (np.append(np.flatnonzero(ids == self.mark_id), len(ids)) * ids.itemsize).tolist()
            raw, starts = ids.tobytes(), [0, *(e + ids.itemsize for e in ends)]
            self.known.update(zip(group, [raw[a:b] for a, b in zip(starts, ends, strict=False)], strict=True))

    def make(self, pieces: list[str]) -> None:
        known = self.known
        parts = [(p, m[1], m[2]) for p in pieces if (m := self.ENDED.fullmatch(p))]
        whole = set(pieces).difference(p for p, *_ in parts).union(tail for *_, tail in parts).difference(known)
        odd = [w for w in whole if self.MARK in w]
        known.update((w, self._bytes(e.ids)) for w, e in zip(odd, self.encode(odd), strict=True))
        self._together(self.tokenizer, list(whole.difference(odd)))
        self._together(self.plain, list({stem for _, stem, _ in parts}.difference(known)))
        known.update([(p, known[stem] + known[tail]) for p, stem, tail in parts if tail])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One memo for all tasks that a Python worker runs, so that a task needn't learn again what the one before it knew."""
    return WordIds(path)
