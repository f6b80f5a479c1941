"""Pre-split of a byte-level BPE tokenizer with the usual English pattern.

The pattern's whitespace rules make every space that precedes a non-space, and every
newline between two non-spaces, a token border. So a text with single separators is cut
with str.split, and what a chunk gives can be kept by chunk; any other text takes the
whole pattern.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import regex
from tokenizers import Tokenizer

# The pre-tokenizer's pattern, and the printable bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))

#: From here on, versions of Unicode differ on which code points are letters; the library then says what it takes them for.
UNSURE = "\u0530"

#: Chunks in each half of what a worker remembers, and the longest that it remembers.
KEPT, LONGEST = 250_000, 64


def byte_of_char() -> dict[str, int]:
    """The byte for which each character of the vocabulary file stands."""
    shown = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Labels' ids, merges in order of rank, and the added tokens' ids, of a tokenizers file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    table = byte_of_char()
    raw = lambda s: bytes(table[c] for c in s)
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in added}
    pairs = (x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"])
    return ids, [(raw(a), raw(b)) for a, b in pairs], added


class Presplit:
    """Applies `of_word` (bytes of a pre-split word -> result) to a text, chunk by chunk.

    results(text) lists the results in order; added tokens give `of_added(token)`.
    """

    def __init__(self, path: str, of_word: Callable[[bytes], object], of_added: Callable[[str], object], added, join: Callable[[list], object]):
        self.find = regex.compile(PATTERN).findall
        self.library, self.table = Tokenizer.from_file(path).pre_tokenizer, byte_of_char()
        self.of_word, self.of_added, self.join = of_word, of_added, join
        self.added = list(added)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in self.added) + ")") if self.added else None
        self.first, self.later = _Kept(self, ""), _Kept(self, " ")
        self.newline = of_word(b"\n")

    def words(self, text: str) -> list[bytes]:
        """The pre-split words as bytes."""
        if max(text) < UNSURE:
            return [x.encode() for x in self.find(text)]
        table = self.table
        return [bytes(map(table.__getitem__, x)) for x, _ in self.library.pre_tokenize_str(text)]

    def chunk(self, text: str):
        return self.join([self.of_word(x) for x in self.words(text)])

    def results(self, text: str) -> list:
        if self.cut is not None and any(x in text for x in self.added):
            out: list = []
            for part in self.cut.split(text):
                out += [self.of_added(part)] if part in self.added else self.plain(part) if part else []
            return out
        return self.plain(text)

    def plain(self, text: str) -> list:
        if not text:
            return []
        lines = text.split("\n")
        if text.split() != [x for line in lines for x in line.split(" ")]:
            return [self.of_word(x) for x in self.words(text)]
        out: list = []
        first, later, newline = self.first, self.later, self.newline
        for line in lines:
            head, *rest = line.split(" ")
            out.append(first[head])
            out += map(later.__getitem__, rest)
            out.append(newline)
        out.pop()
        return out


class _Kept(dict):
    """Results by chunk, for chunks that follow `lead`.

    When full, it becomes the older half; what is asked for again returns from there.
    """

    def __init__(self, split: Presplit, lead: str):
        self.split, self.lead, self.older = split, lead, {}

    def __missing__(self, chunk: str):
        got = self.older.get(chunk)
        if got is None:
            got = self.split.chunk(self.lead + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[chunk] = got
        return got
