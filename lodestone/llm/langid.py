"""Language identification by rank-order n-gram profiles.

A profile lists a language's most frequent n-grams (1 to 3 letters, words padded with a
blank) by rank. A document's own list is compared with each profile by the out-of-place
distance: for each of its n-grams the difference of ranks, or the largest distance where
the profile lacks it. The nearest profile names the language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, in_shares, map_rows

#: N-grams in a profile, and characters of a long text that are read at a time.
PROFILE, PART = 400, 1 << 18
#: Languages whose profiles one pass over the texts holds (3 MB of them); more are compared in further passes.
LANGUAGES = 512
UNKNOWN = "und"
#: Texts that a task holds as Python objects at a time.
SHARE = 200

#: Bits of a letter in an n-gram's number.
BITS = 21
_SPACE = 32


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """All n-grams of a text as numbers.

    Letters are lower-cased, words (runs of letters) stand between single blanks, and
    n-grams are a letter, or two or three characters with a blank at an end at most.
    """
    return _codes(text.lower())[0]


def codes_of_many(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of several chunks, and the number of the chunk that each is in."""
    chunks = [x.lower() for x in chunks]
    grams, place = _codes(" ".join(chunks))
    ends = np.cumsum([len(x) + 1 for x in chunks])
    return grams, np.minimum(np.searchsorted(ends, place, side="right"), len(chunks) - 1)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams, and the place of a letter in each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.concatenate([[_SPACE], np.where(_is_letter()[c], c, _SPACE), [_SPACE]]).astype(np.int64)
    blank = c == _SPACE
    kept = np.flatnonzero(np.append(True, ~(blank[1:] & blank[:-1])))
    c = c[kept]
    letter = c != _SPACE
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = kept - 1
    two = c[:-1] << BITS | c[1:]
    inner = np.flatnonzero(letter[1:-1])
    three = (two[:-1] << BITS | c[2:])[inner]
    return np.concatenate([c[letter], two, three]), np.concatenate([place[letter], np.where(letter[:-1], place[:-1], place[1:]), place[1:-1][inner]])


def profiles(df: DataFrame, text: str, lang: str, size: int = PROFILE) -> DataFrame:
    """lang, gram, rank: the `size` most frequent n-grams of each language, over all rows with text and label, ties by number."""

    def count(batch: pa.RecordBatch) -> dict:
        words: dict[str, Counter] = {}
        for x, name in zip(chain.from_iterable(in_shares(batch.column(0), SHARE)), batch.column(1).to_pylist(), strict=True):
            words.setdefault(name, Counter()).update(x.split())
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for name, seen in words.items():
            # each distinct chunk once, by its number of occurrences
            total: Counter = Counter()
            chunks = list(seen)
            for i in range(0, len(chunks), 50_000):
                part = chunks[i : i + 50_000]
                grams, owner = codes_of_many(part)
                found, at = np.unique(grams, return_inverse=True)
                sums = np.bincount(at, np.array([seen[x] for x in part])[owner])
                total.update(dict(zip(found.tolist(), sums.astype(np.int64).tolist(), strict=True)))
            out["lang"] += [name] * len(total)
            out["gram"] += total.keys()
            out["n"] += total.values()
        return out

    rows = df.where(df[text].isNotNull() & df[lang].isNotNull()).select(df[text].alias("text"), df[lang].alias("lang"))
    counted = map_rows(rows, count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size).select("lang", "gram", "rank")


def in_blocks(ranked: DataFrame, languages: int) -> Iterator[dict[str, list[int]]]:
    """Profiles of about so many languages at a time, dealt by hash of their names; the driver holds one block."""
    ranked = checkpointed(ranked)
    blocks = -(-ranked.where("rank = 1").count() // languages)
    for i in range(blocks):
        block: dict[str, list[int]] = {}
        for r in sorted(ranked.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == i).collect(), key=lambda r: (r["lang"], r["rank"])):
            block.setdefault(r["lang"], []).append(r["gram"])
        if block:
            yield block


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text and their counts; a long text is read in parts, cut at blanks where there are any."""
    if len(text) <= PART:
        return np.unique(codes(text), return_counts=True)
    grams, n, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
    while at < len(text):
        end = at + PART
        cut = text.rfind(" ", at + 1, end) if end < len(text) else -1
        end = cut if cut > 0 else end
        more, m = np.unique(codes(text[at:end]), return_counts=True)
        both, where = np.unique(np.concatenate([grams, more]), return_inverse=True)
        n = np.bincount(where, np.concatenate([n, m]), len(both)).astype(np.int64)
        grams, at = both, end
    return grams, n


class Identifier:
    """Compares texts with profiles.

    The profiles are one list of (n-gram, language, rank), sorted by n-gram: it grows with
    their number, not with that of languages times all n-grams.
    """

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(ranked), size
        grams = np.array([g for x in self.names for g in ranked[x]], np.int64)
        lang = np.repeat(np.arange(len(self.names)), [len(ranked[x]) for x in self.names])
        rank = np.array([i for x in self.names for i in range(len(ranked[x]))], np.int64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.lang, self.rank = grams[order], lang[order], rank[order]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score: one less the mean distance over the largest one."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        grams, n = counted(text)
        if not len(grams):
            return UNKNOWN, 0.0
        if len(grams) > self.size:  # all that may be among the first
            enough = np.partition(n, len(n) - self.size)[-self.size]
            grams, n = grams[n >= enough], n[n >= enough]
        top = grams[np.lexsort((grams, -n))][: self.size]
        low, high = np.searchsorted(self.grams, top), np.searchsorted(self.grams, top, side="right")
        own = np.repeat(np.arange(len(top)), high - low)
        at = np.arange(len(own)) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)
        # an n-gram that a profile has is nearer than the largest distance by this
        nearer = np.bincount(self.lang[at], self.size - np.abs(self.rank[at] - own), len(self.names))
        best, most = int(nearer.argmax()), self.size * len(top)
        return self.names[best], float(1 - (most - nearer[best]) / most)


_made: dict[str, Identifier] = {}


def identifier(ranked: dict[str, list[int]], size: int) -> Identifier:
    key = repr((ranked, size))
    if key not in _made:
        _made.clear()
        _made[key] = Identifier(ranked, size)
    return _made[key]


def identify(df: DataFrame, train: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id", size: int = PROFILE, carry: list[str] | None = None, languages: int = LANGUAGES) -> DataFrame:
    """The language of every row's whole text, by profiles of the rows for which `train` holds.

    Returns id_col, lang_pred, score (0 to 1), and the columns in `carry`. A text that is
    null or has no letter gives `und` with score 0, as does everything if no row has a
    label; rows without text or label aren't learned from. Null ids and repeated rows stay
    as they are; an empty table gives an empty table; ties go to the name first in order.
    Labels may name any number of languages: with more than `languages`, a pass for each so
    many keeps the nearer of its own and what was found before.
    """
    carry = carry or []
    kept = {f"c{i}": name for i, name in enumerate([id_col, *carry])}
    kinds = ", ".join(f"{k} {df.schema[name].dataType.simpleString()}" for k, name in kept.items())
    none = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")]
    out = df.select(df[text].alias("text"), *[df[name].alias(k) for k, name in kept.items()])

    def nearest(ranked: dict[str, list[int]], again: bool):
        def run(batch: pa.RecordBatch) -> dict:
            predict = identifier(ranked, size).predict
            texts, n = batch.column(0), len(kept)
            got = [predict(x) for share in in_shares(texts, SHARE) for x in share]
            if again:
                found = zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True)
                got = [min(x, y, key=lambda z: (-z[1], z[0])) for x, y in zip(got, found, strict=True)]
            return {"text": texts} | {k: batch.column(i + 1) for i, k in enumerate(kept)} | {"lang_pred": [x for x, _ in got], "score": [x for _, x in got]}

        return run

    result = f"{kinds}, lang_pred string, score double"
    blocks = in_blocks(profiles(df.where(train), text, lang, size), languages)
    ranked, again = next(blocks, None), False
    if ranked is None:
        out = out.select(*kept, *none)
    while ranked:
        following = next(blocks, None)
        if following:  # from files, so that no task holds two blocks
            out = checkpointed(map_rows(out, nearest(ranked, again), f"text string, {result}"))
        else:
            out = map_rows(out, nearest(ranked, again), result)
        ranked, again = following, True
    return out.select(*[F.col(k).alias(name) for k, name in kept.items()], "lang_pred", "score")
