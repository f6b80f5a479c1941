"""Literal search for a stated set of phrases in all texts.

A window of a phrase, its first characters, is known by the least hash of its n-grams. A
text that has the phrase has that window, and so the same least hash. Phrases and texts
are joined on it, and what meets is searched for literally. Phrases stay in Spark; tasks
carry only a bit map of the phrases' hashes, of fixed size, that keeps a text's other hashes
out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import written

#: Characters of the longest window; shorter phrases have the largest power of two that fits.
LONGEST_WINDOW = 64
#: Bits of the map of phrases' hashes: 2 MB.
BITS = 1 << 24
#: Pairs of a text and a phrase up to which the texts' keys are sent to all executors.
BROADCAST = 1_000_000

U64 = np.uint64


class _Lower(dict):
    """Lower case by character, where that is one character too."""

    def __missing__(self, code: int) -> int:
        low = chr(code).lower()
        self[code] = ord(low) if len(low) == 1 else code
        return self[code]


_lower = _Lower()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def window_of(phrase: str) -> int:
    """Characters of a phrase's window."""
    return min(LONGEST_WINDOW, 1 << (len(phrase).bit_length() - 1))


def least_hashes(codes: np.ndarray, window: int) -> np.ndarray:
    """The least hash of the n-grams in each window: n is half a long window, and the whole of one below 16."""
    if len(codes) < window:
        return np.empty(0, np.int64)
    gram = window // 2 if window >= 16 else window
    h, size = (codes + U64(1)) * U64(0x9E3779B97F4A7C15), 1
    while size < gram:
        h = (h[:-size] ^ (h[:-size] >> U64(29))) * U64(0xD6E8FEB86659FD93) + h[size:]
        size *= 2
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    width, size = window - gram + 1, 1
    while size < width:
        step = min(size, width - size)
        h = np.minimum(h[:-step], h[step:])
        size += step
    return np.unique(h.view(np.int64))


def _anchors(fold: bool, p_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [x.translate(_lower) if fold else x for x in batch.column(1).to_pylist()]
            windows = [window_of(x) for x in said]
            found = [int(least_hashes(_codes(x[:n]), n)[0]) for x, n in zip(said, windows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(p_kind), pa.array(said, pa.string()), pa.array(windows, pa.int32()), pa.array(found, pa.int64())], names=["p", "s", "size", "anchor"])

    return run


def _candidates(windows: list[int], bits: np.ndarray, fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, size, found = [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                codes = _codes(body.translate(_lower) if fold else body)
                for n in windows:
                    h = least_hashes(codes, n)
                    at = h & (BITS - 1)
                    h = h[(bits[at >> 6] >> (at & 63).astype(np.uint64)) & U64(1) == 1]
                    if len(h):
                        row.append(np.full(len(h), i))
                        size.append(np.full(len(h), n, np.int32))
                        found.append(h)
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(size)), pa.array(np.concatenate(found))], names=["key", "size", "anchor"])

    return run


def _places(names: list[str], most: int | None, fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, position = [], []
            for i, (body, said) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                body = body.translate(_lower) if fold else body
                at, k = body.find(said), 0
                while at >= 0 and (most is None or k < most):
                    row.append(i)
                    position.append(at)
                    at, k = body.find(said, at + 1), k + 1
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[2:]), pa.array(position, pa.int64())], names=[*names, "position"])

    return run


def find_phrases(texts: DataFrame, phrases: DataFrame, id_col: str, phrase_id: str, phrase: str = "phrase", text: str = "text", most: int | None = None, fold: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Places (from 0, in characters) of phrases in texts: id_col, carry, phrase_id, position.

    Matches may overlap; `most` keeps the first ones of each phrase in a text. fold ignores
    case where lower-casing keeps lengths. Null or empty phrases match nothing; texts and
    phrases may be of any length and number. Repeated rows of texts are each searched;
    a phrase that is stated twice under one id is searched for once.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {x: texts.schema[x].dataType.simpleString() for x in (id_col, *carry)}
    p_kind = phrases.schema[phrase_id].dataType
    stated = phrases.where(F.length(phrase) > 0).select(F.col(phrase_id).alias("p"), F.col(phrase).alias("s")).distinct()
    anchors = stated.mapInArrow(_anchors(fold, to_arrow_type(p_kind)), f"p {p_kind.simpleString()}, s string, size int, anchor bigint")

    place = F.pmod("anchor", F.lit(BITS))
    word = anchors.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(anchor, {BITS}) % 64))")).alias("bits"), F.bit_or("size").alias("sizes"))
    bits, sizes = np.zeros(BITS // 64, np.int64), 0
    for r in word.collect():  # at most BITS / 64 rows
        bits[r["word"]] = r["bits"]
        sizes |= r["sizes"]
    windows = [1 << i for i in range(sizes.bit_length()) if sizes >> i & 1]

    source = texts.where(F.length(text) > 0).select(F.col(text).alias("body"), *[F.col(x).alias(f"c{i}") for i, x in enumerate(kinds)])
    # rows that share a key only have more candidates, of which each row is searched for all
    source = source.withColumn("key", F.xxhash64("c0", "body"))
    met = source.select("key", "body").mapInArrow(_candidates(windows, bits.view(np.uint64), fold), "key bigint, size int, anchor bigint")
    pairs = written(met.join(anchors, ["size", "anchor"]).select("key", "p", "s").distinct())
    if pairs.count() <= BROADCAST:  # texts without a candidate need not travel
        source = source.join(F.broadcast(pairs.select("key").distinct()), "key", "left_semi")
    names = [f"c{i}" for i in range(len(kinds))]
    both = source.join(pairs, "key").select("body", "s", *names, "p")
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds.values())) + f", p {p_kind.simpleString()}, position long"
    out = both.mapInArrow(_places([*names, "p"], most, fold), schema)
    return out.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(kinds)], F.col("p").alias(phrase_id), "position")
