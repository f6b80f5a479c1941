"""Best-fit packing of documents into sequences, with large-item matching.

A document's tokens are its ids and one end id; only longer ones are cut, into full
sequences and a rest. How pieces go together depends on their lengths alone, of which there
are as many as a sequence has tokens. So the plan is made from the count of pieces of each
length: pieces above a third of the capacity are matched, two in a sequence at most, each
large one with the largest that still fits; then smaller ones, by falling length, go where
the gap is tightest. The plan is a list of runs (the next m pieces of this length go t to a
sequence into these sequences at this place), whose number is bounded by the capacity, not
by the data. Pieces are numbered within their length and looked up in it.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, give_back, held, in_shares

#: Chunks in each half of what a worker remembers, and the longest that it remembers.
KEPT, LONGEST = 250_000, 64
#: Signs that end a word before them, whatever follows; an apostrophe doesn't. More than so many at once stay with their word.
SIGNS, SIGNS_LONGEST = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 8
#: Texts whose new chunks are learned together.
SHARE = 200


def simple(text: str) -> bool:
    """Whether a text is Latin-1: there lower-casing goes letter by letter, and nothing is composed."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def word(chunk: str) -> str | None:
    """The word of a chunk that is one of Latin-1 letters and signs after it; other letters may be lower-cased to a letter and a sign."""
    w = chunk.rstrip(SIGNS)
    return w if 0 < len(chunk) - len(w) <= SIGNS_LONGEST and w.isalpha() and simple(w) else None


class ChunkEncoder:
    """Ids of texts by the tokenizers library, kept by chunk between spaces and newlines.

    For vocabularies that lower-case, drop white space, part letters from other signs and
    end words with </w>: no token then reaches over a space, a newline or the end of a run
    of letters. Signs after a word are known apart from it. New words go to the library
    together, and are told apart by their ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # of this encoder only: a cache of the class would keep every encoder alive
        encode = self.library.encode
        self.signs = lru_cache(maxsize=4096)(lambda c: np.asarray(encode(c, add_special_tokens=False).ids, "<u4").tobytes())

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that aren't known."""
        out = self.spelled([c for c in chunks if c.isalpha() and (c.isascii() or c.lower().isalpha())])
        if rest := [c for c in chunks if c not in out]:
            got = self.library.encode_batch_fast(rest, add_special_tokens=False)
            out.update((c, np.asarray(e.ids, "<u4").tobytes()) for c, e in zip(rest, got, strict=True))
        return out

    def spelled(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters only.

        Every character but white space is in some word of the library's, so each of these
        holds one of those at least; ends as many as these then are one for each.
        """
        ids = np.asarray(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # a word that isn't one for the library
            return {}
        packed, out, a = ids.tobytes(), {}, 0
        for w, b in zip(words, (4 * stops).tolist(), strict=True):
            out[w] = packed[a:b]
            a = b
        return out

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list) -> Iterator[bytes]:
        """Packed ids of each text; what is new in all of them is learned at once."""
        cut = []
        for x in texts:
            x = x or ""
            if simple(x):
                x = x.lower()
            cut.append(x.replace("\n", " ").split(" "))
        kept, older = self.kept, self.older
        chunks = set().union(*cut)
        ended = {c: w for c in chunks.difference(kept) if (w := word(c)) is not None}
        chunks = chunks.difference(ended).union(ended.values())
        new = chunks.difference(kept)
        again = {c: older[c] for c in new if c in older}
        again |= self.learn([c for c in new if c not in again])
        found = {c: kept[c] for c in chunks.difference(again)} | again
        if len(kept) + len(again) > KEPT:
            self.older, self.kept = kept, found.copy()
        else:
            kept.update(again)
        for c in [c for c in again if len(c) > LONGEST]:
            del self.kept[c]
        for c, w in ended.items():
            found[c] = found[w] + self.signs(c[len(w) :])
        for x in cut:
            yield b"".join(map(found.__getitem__, x))


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, text: str, id_col: str, with_ids: bool) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32 and, if asked for, ids): each text's tokens, cut where it must be."""
    kind = df.schema[id_col].dataType
    end = np.asarray([end_id], "<u4").tobytes()
    schema = f"id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(ChunkEncoder, path).encode_all
        for batch in batches:
            at, piece, length, crc, ids = [], [], [], [], []
            for i, packed in enumerate(chain.from_iterable(map(encode, in_shares(batch.column(1), SHARE)))):
                packed += end
                for j, a in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[a : a + 4 * capacity]
                    at.append(i)
                    piece.append(j)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            numbers = np.asarray(piece, np.int32)
            arrays = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(numbers), pa.array(numbers.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(df[id_col].alias("id"), df[text].alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, pieces in a sequence, place of its first piece), and the number of sequences.

    The pieces of a length from the run's first rank up to the next run's go to sequences
    from the first one on, so many to each, side by side.
    """
    left = {s: n for s, n in sorted(counts.items()) if n > 0}
    ranks = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, how many)]
    order: list[int] = []  # the gaps there are, rising
    total = 0

    def put(size: int, first: int, n: int, each: int, at: int) -> None:
        """n sequences from `first` on get `each` pieces of this size at `at`."""
        runs.append((size, ranks[size], first, each, at))
        ranks[size] += n * each
        left[size] -= n * each
        opened(first, n, capacity - at - each * size)

    def opened(first: int, n: int, gap: int) -> None:
        if gap > 0 and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    large = [s for s in left if 3 * s > capacity]
    for size in reversed(large):
        while left[size]:
            # the largest other piece that fits beside it, at most as large
            fits = [s for s in large[: bisect_left(large, min(size, capacity - size) + 1)] if left[s]]
            mate = fits[-1] if fits else 0
            if not mate or mate == size and left[size] == 1:
                mate = next((s for s in reversed(fits) if s != size), 0)
            first = total
            if not mate:
                n = left[size]
                put(size, first, n, 1, 0)
            elif mate == size:
                n = left[size] // 2
                put(size, first, n, 2, 0)
            else:
                n = min(left[size], left[mate])
                runs.append((size, ranks[size], first, 1, 0))
                ranks[size] += n
                left[size] -= n
                put(mate, first, n, 1, size)
            total += n
    for size in [s for s in reversed(left) if 3 * s <= capacity]:
        while left[size]:
            at = bisect_left(order, size)
            if at == len(order):  # no gap is left: fresh sequences
                each = capacity // size
                full, rest = divmod(left[size], each)
                first, total = total, total + full + (rest > 0)
                if full:
                    put(size, first, full, each, 0)
                if rest:
                    put(size, first + full, 1, rest, 0)
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // size
            full, rest = min(n, left[size] // each), 0
            if full < n:
                rest = left[size] - full * each
            used = full + (rest > 0)
            opened(first + used, n - used, gap)
            if full:
                put(size, first, full, each, capacity - gap)
            if rest:
                put(size, first + full, 1, rest, capacity - gap)
    return runs, total


def pack(spark: SparkSession, df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Packs every row's whole text into sequences of at most `capacity` tokens.

    Returns per piece: id_col, piece (from 0), start, length, ids_crc32, sequence_id and
    offset, gapless from 0 in each sequence; with_ids adds the ids. A null or empty text is
    one piece of the end id alone; null ids and repeated rows are packed like others; an
    empty table gives no rows; other columns are not carried and may have any name. A text
    of any length is cut into full sequences and a rest.
    """
    cut = checkpointed(pieces(df, path, capacity, end_id, text, id_col, with_ids))
    # at most `capacity` rows come here
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs, _ = plan(counts, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    key = (table[:, 0] << 48) + table[:, 1]

    # numbers within a length: within (length, share) first, as a third of all may be of one length
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut.withColumn("share", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shares)).cast("int"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "share").agg(F.count("*").alias("n")).select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("id", "piece", "ids_crc32")) - 1).join(base, ["length", "share"])
    carried = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = df.schema[id_col].dataType

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # all texts are encoded
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            run = table[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            columns = [batch.column(x) for x in carried]
            columns += [pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "sequence_id", "offset"])

    schema = f"id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint{', ids array<int>' * with_ids}, sequence_id bigint, offset bigint"
    placed = ranked.select(*carried, (F.col("base") + F.col("rank")).alias("rank")).mapInArrow(place, schema)
    return placed.withColumnRenamed("id", id_col)
