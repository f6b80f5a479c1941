"""Quality rules with compression bands.

Base rules count words, symbols, repeated lines and repeated 8-word windows. The verdict
on the rest is by compression: the zstandard ratio (bytes / compressed bytes) of the whole
text and of each of its fixed chunks, within limits that depend on length and script. Above the
upper limit a text repeats itself, below the lower one it is noise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_shares, map_rows

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8
LEVEL = 3
#: Texts that a task holds as Python objects at a time.
SHARE = 200
CHUNK = 2048
#: From so many bytes on, the least ratio of a whole text; of a chunk CHUNK_LEAST is enough.
LEAST = ((0, 0.5), (200, 1.05), (400, 1.15), (800, 1.3), (1600, 1.45), (3200, 1.6), (6400, 1.7), (12800, 1.75), (51200, 1.8))
CHUNK_LEAST = 1.3
#: The largest ratio of a text of 256 characters, and how much it rises when the length
#: doubles. Prose of any subject has to stay below, legal texts and manuals too: they reach
#: 2.8 at 8 KB and 3.0 at 17 KB.
MOST, RISE = 2.4, 0.2


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of 8 words that the text has twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    # a window's number among the distinct ones, by doubling: of 2, 4 and 8 words
    for step in (1, 2, 4):
        _, ids = np.unique(ids[:-step] * (n + 1) + ids[step:], return_inverse=True)
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((edges.cumsum() > 0).sum())


def ratio(compress, data: bytes) -> float:
    return len(data) / len(compress(data))


def limits(data: bytes) -> tuple[float, float]:
    """The least and the largest ratio of so many bytes.

    The upper one goes by characters and rises with the square root of their bytes, as the
    lead bytes of a script say little.
    """
    n = len(data)
    chars = max(1, n - int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 == 0x80)))
    least = next(x for at, x in reversed(LEAST) if n >= at)
    return least, (MOST + RISE * math.log2(chars / 256)) * math.sqrt(n / chars)


def in_bands(data: bytes, compress, chunk: int = CHUNK) -> tuple[bool, float]:
    """Whether the whole and each chunk, the last partial one too, are within their limits; the whole's ratio."""
    if not data:
        return False, 0.0
    whole = ratio(compress, data)
    least, most = limits(data)
    if not least <= whole <= most:
        return False, whole
    # a rest too short for limits of its own belongs to the chunk before it
    starts = range(0, max(1, len(data) - LEAST[1][0] + 1), chunk) if len(data) > chunk else ()
    for i in starts:
        part = data[i : i + chunk if i != starts[-1] else len(data)]
        least, most = limits(part)
        if not min(least, CHUNK_LEAST) <= ratio(compress, part) <= most:
            return False, whole
    return True, whole


def measure(text: str | None, compress) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    seen, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.strip(SPACES):
                seen.add(line)
    repeat = repeated_words(words)
    failed = n < 20 or 100 * repeat > 30 * n
    good, whole = in_bands(data, compress)
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat, failed, good and not failed, whole


def quality(df: DataFrame, text: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and verdict for every row's whole text.

    Returns id_col, the columns in `carry`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean) and ratio (double). A null or empty text has no words and
    fails; null ids and repeated rows stay as they are; an empty table gives an empty
    table; other columns may have any name. Texts may be of any length.
    """
    kept = {f"c{i}": name for i, name in enumerate([id_col, *carry])}
    kinds = ", ".join(f"{k} {df.schema[name].dataType.simpleString()}" for k, name in kept.items())
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")

    def run(batch: pa.RecordBatch) -> dict:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        rows = [measure(x, compress) for share in in_shares(batch.column(0), SHARE) for x in share]
        return {k: batch.column(i + 1) for i, k in enumerate(kept)} | {k: list(x) for k, x in zip(names, zip(*rows, strict=True), strict=True)}

    schema = f"{kinds}, " + ", ".join(f"{x} bigint" for x in names[:5]) + ", base_failed boolean, kept boolean, ratio double"
    out = map_rows(df.select(df[text].alias("text"), *[df[name].alias(k) for k, name in kept.items()]), run, schema)
    return out.select(*[F.col(k).alias(name) for k, name in kept.items()], *names)
