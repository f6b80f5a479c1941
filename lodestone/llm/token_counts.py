"""Token counts of byte-pair encoding, without the tokens.

A word's symbols form a linked list. A heap holds its adjacent pairs by rank, then place;
the lowest is popped and merged again and again. The count is the number of symbols at the
start less the merges. No identifier leaves the loop.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows
from .presplit import Presplit, load


class Counter:
    """Counts tokens of texts for one vocabulary file."""

    def __init__(self, path: str):
        _, merges, added = load(path)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(merges):
            self.rank.setdefault(pair, rank)
        self.split = Presplit(path, self.of_word, lambda _: 1, added, sum)

    def of_word(self, word: bytes) -> int:
        n = len(word)
        if n < 2:
            return n
        rank = self.rank.get
        symbol: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank((symbol[i], symbol[i + 1]))) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            merges += 1
            symbol[i], symbol[j] = (whole := a + b), None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((whole, symbol[k]))) is not None:
                    heappush(heap, (r, i, whole, symbol[k]))
            if (k := before[i]) >= 0 and (r := rank((symbol[k], whole))) is not None:
                heappush(heap, (r, k, symbol[k], whole))
        return n - merges

    def count(self, text: str | None) -> int:
        return sum(self.split.results(text or ""))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, limit: int = 512, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tokens of every row's whole text: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows stay as
    they are; an empty table gives an empty table; other columns are not carried and may
    have any name. A text may be of any length.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> dict:
        count, texts = counter(path).count, batch.column(1).to_pylist()
        n = [count(x) for x in texts]
        return {"id": batch.column(0), "n_bytes": [len((x or "").encode()) for x in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_rows(df.select(df[id_col].alias("id"), df[text].alias("text")), run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
