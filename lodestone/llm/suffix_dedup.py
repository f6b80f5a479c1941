"""Removal of repeated passages by interval expansion on a Burrows-Wheeler transform.

Every byte that lies in a string of `length` bytes which also starts in a document with a
smaller id is removed. Texts are bytes; matches never cross documents.

1. Texts are dealt to shards by id, compressed, and kept in files; every later step reads
   them there.
2. Candidate search. A window of `length` bytes is keyed by the smallest hash of the 16-byte
   strings in it. Equal windows have equal keys, and neighbours mostly share one, so a text
   falls into runs of windows of one key. Of a shard's equal runs the smallest document
   stands for all; a run is dealt out by key as the key, a hash of its content and that
   document. The answer is a few bits: copies of a run of a smaller document are gone
   (key and content agree in some 100 bits), and the first of unlike runs are asked for.
3. The bytes of unlike runs of one key are dealt out by key and joined to one string. On its
   Burrows-Wheeler transform, breadth-first backward extension takes the intervals of all
   strings of 1, 2, 3 ... bytes: it finds the borders between suffixes whose common prefix
   has just that length, and stops at `length`. Suffixes without a border between them
   share `length` bytes or more; of such a class all but the smallest document lose the
   bytes.
4. A key with more than `hot` unlike runs is split by longer keys before step 3: by the
   smaller hash of the two strings of `length` - 1 bytes in each of its windows. Such a key
   has no more unlike windows than two bytes have values, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, dealt, give_back, tasks_for, total_bytes

#: Bytes of the hashed strings within a window, of those that re-check a run, and windows in a run at most.
GRAM, LONG_GRAM, RUN = 16, 33, 48
#: Unlike runs of a key above which it is split by longer keys.
HOT = 1 << 13
#: Bytes hashed at a time, and bytes of one transform, which takes some 150 times as much memory.
SLICE, JOINED = 1 << 18, 1 << 19
#: Bytes of text for each partition, and shards and groups of keys in one.
TASK_BYTES, SPREAD = 16 << 20, 2

U64 = np.uint64
_TABLE = np.random.default_rng(11).integers(1, 2**64, 256, dtype=np.uint64)
_ODD = {1 << i: U64(x | 1) for i, x in enumerate(np.random.default_rng(12).integers(1, 2**64, 16, dtype=np.uint64).tolist())}
_MUL = U64(0xD6E8FEB86659FD93)
_KEY = U64(2**32 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x *= _MUL
    x ^= x >> U64(29)
    return x


def gram_hashes(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length, a number for the string of so many bytes that starts at each place.

    Numbers of strings of 2, 4, 8 ... bytes are made from those of their halves; other
    lengths are put together from these.
    """
    part, size = _TABLE[data], 1
    out: list[np.ndarray | None] = [None] * len(lengths)
    while True:
        for i, k in enumerate(lengths):
            if k & size:
                n = max(0, len(data) - k + 1)
                if out[i] is None:
                    out[i] = part[k & ~(2 * size - 1) :][:n].copy()
                else:
                    out[i] *= _ODD[size]
                    out[i] += part[k & ~(2 * size - 1) :][:n]
        if 2 * size > max(lengths):
            return out
        m = max(0, len(part) - size)
        nxt = part[:m] * _ODD[size]
        nxt += part[size : size + m]
        part, size = nxt, 2 * size


def _order(x: np.ndarray) -> np.ndarray:
    """Numbers of strings made into hashes, so that the smallest is any of them."""
    x = x ^ (x >> U64(32))
    x *= _MUL
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one key in joined texts that end at `ends`: first window, windows, key, hash of all the run's bytes."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram, whole = gram_hashes(data, GRAM, length)
    key = sliding_min(_order(gram), length - GRAM + 1)
    n = len(key)
    inside = np.ones(n, bool)  # windows that don't reach over a text's end
    for back in range(1, length):
        at = ends - back
        inside[at[(at >= 0) & (at < n)]] = False
    fresh = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    fresh |= ~inside
    fresh[1:] |= ~inside[:-1]
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, n))
    fine = inside[first]
    first, size = first[fine], size[fine]
    if len(size) and size.max() > RUN:  # longer ones are cut, so that first and last window cover a run
        parts = -(-size // RUN)
        owner = np.repeat(np.arange(len(first)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = first[owner] + nth * RUN, np.minimum(size[owner] - nth * RUN, RUN)
    content = _mix(_mix(whole[first] * U64(3) + size.astype(np.uint64)) + whole[first + size - 1] * _ODD[64])
    return first, size, key[first], content


# -- columns of numbers as bytes, compressed


def _planes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplanes(raw: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((raw.size // n, 8), np.uint8)
    out[:, :n] = raw.reshape(n, -1).T
    return out.view("<u8").ravel()


#: Bytes of the key within its group, the content's hash and the document.
_WIDTHS = (4, 8, 8)


def _pack(zipped, key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> bytes:
    low = doc.min()
    parts = (np.diff(key, prepend=U64(0)), content, doc - low)
    return zipped(np.int64(low).tobytes() + b"".join(_planes(x, n) for x, n in zip(parts, _WIDTHS, strict=True)))


def _unpack(blob: bytes) -> list[np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    raw, out, at = np.frombuffer(blob, np.uint8, offset=8), [], 0
    n = len(raw) // sum(_WIDTHS)
    for width in _WIDTHS:
        out.append(_unplanes(raw[at : at + n * width], width))
        at += n * width
    out[0] = out[0].cumsum(dtype=np.uint64)
    out[2] = out[2].view(np.int64) + np.frombuffer(blob[:8], "<i8")
    return out


def _packed(zipped, *columns: np.ndarray) -> bytes:
    return zipped(np.stack(columns).astype("<i8").tobytes())


def _unpacked(blobs: list[bytes], n: int) -> np.ndarray:
    unzip = zstandard.ZstdDecompressor().decompress
    return np.concatenate([np.frombuffer(unzip(x), "<i8").reshape(n, -1) for x in blobs], axis=1) if blobs else np.empty((n, 0), np.int64)


def _zipper():
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(x, t) for x, t in zip(columns, schema.values(), strict=True)], names=list(schema))


_DEALT = {"group": pa.int32(), "shard": pa.int32(), "blob": pa.binary()}
_FOUND = {"group": pa.int32(), "shard": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
_GONE = {"shard": pa.int32(), "blob": pa.binary()}


def _ddl(schema: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {'binary' if t == pa.binary() else 'int'}" for k, t in schema.items())


class _Shard:
    """Distinct texts of a shard by id and bytes, and how its rows refer to them."""

    def __init__(self, table: pa.Table, length: int):
        unzip = zstandard.ZstdDecompressor().decompress
        self.row_ids = table.column("id").to_pylist()
        self.row_texts = [unzip(x) for x in table.column("packed").to_pylist()]
        self.least: dict[bytes, int] = {}  # of equal texts the first document stands for all
        for i, x in zip(self.row_ids, self.row_texts, strict=True):
            if i is not None and len(x) >= length and i <= self.least.get(x, i):
                self.least[x] = i
        both = sorted((i, x) for x, i in self.least.items())
        self.ids, self.texts = np.array([i for i, _ in both], np.int64), [x for _, x in both]

    def segments(self, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
        """Groups of (number of the text, place, bytes) of about SLICE bytes; long texts are cut so that each window is in one part."""
        group, size = [], 0
        for i, x in enumerate(self.texts):
            for a in range(0, len(x) - length + 1, SLICE):
                part = x[a : a + SLICE + length - 1]
                group.append((i, a, part))
                size += len(part)
                if size >= SLICE:
                    yield group
                    group, size = [], 0
        if group:
            yield group


class _Runs:
    """All runs of a shard in order of text and place, and its entries: unlike (group, key, content) with the smallest document."""

    def __init__(self, shard: _Shard, length: int, groups: int):
        kept: list[list] = [[np.empty(0, np.uint64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3]]
        for part in shard.segments(length):
            ends = np.cumsum([len(x) for *_, x in part])
            first, size, key, content = runs(np.frombuffer(b"".join([x for *_, x in part]), np.uint8), ends, length)
            at = np.searchsorted(ends, first, side="right")
            text, start = (np.array([x[k] for x in part])[at] for k in (0, 1))
            kept.append([key, content, text, start + first - np.append(0, ends)[at], size])
        key, content, self.text, self.place, self.size = (np.concatenate(x) for x in zip(*kept, strict=True))
        self.doc = shard.ids[self.text]
        # the group above the key's other bits: entries of a group lie together
        where = (key % U64(groups)) << U64(32) | (key // U64(groups)) & _KEY
        order = np.argsort(where)
        ordered = where[order]
        same = np.append(ordered[1:] == ordered[:-1], False)
        same[1:] |= same[:-1]
        tied = np.flatnonzero(same)
        few = order[tied]
        order[tied] = few[np.lexsort((self.doc[few], content[few], where[few]))]
        ordered, content = where[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (ordered[1:] != ordered[:-1]) | (content[1:] != content[:-1])
        head = np.flatnonzero(new)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.where, self.content, self.first_doc = ordered[head], content[head], self.doc[order][head]
        self.starts = np.searchsorted(self.where, np.arange(groups + 1, dtype=np.uint64) << U64(32))


def _find(length: int, groups: int):
    """The entries of a shard, by group."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        number, zipped = table.column("shard")[0].as_py(), _zipper()
        found = _Runs(_Shard(table, length), length, groups)
        rows = []
        for g in np.flatnonzero(np.diff(found.starts)).tolist():
            part = slice(found.starts[g], found.starts[g + 1])
            rows.append((g, number, _pack(zipped, found.where[part] & _KEY, found.content[part], found.first_doc[part])))
        return _table(_DEALT, rows)

    return run


#: What becomes of an entry: nothing, its runs are gone, they are asked for, they are asked for window by window.
GONE, ASK, SPLIT = 1, 2, 3


def _compare(hot: int):
    """Of each key in several documents: which entries are copies of earlier ones, and which must be looked at."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        group, zipped = table.column("group")[0].as_py(), _zipper()
        parts = [_unpack(x) for x in table.column("blob").to_pylist()]
        key, content, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.cumsum([len(x[0]) for x in parts])
        del parts
        # most keys have one entry; the others are sorted by key, content and document
        order = np.argsort(key)
        same = np.append(key[order][1:] == key[order][:-1], False)
        same[1:] |= same[:-1]
        order = order[same]
        codes = np.zeros(len(key), np.uint8)
        if len(order):
            order = order[np.lexsort((doc[order], content[order], key[order]))]
            key, content, doc = (x[order] for x in (key, content, doc))
            new_key = np.append(True, key[1:] != key[:-1])
            new = new_key | np.append(True, content[1:] != content[:-1])
            at = np.cumsum(new_key) - 1
            leads = doc[new]  # the first document of each content
            of_key = np.flatnonzero(new_key[new])
            shared = (np.minimum.reduceat(leads, of_key) != np.maximum.reduceat(leads, of_key))[at]
            unlike = np.bincount(at, weights=new)[at]
            code = np.where(doc > leads[np.cumsum(new) - 1], GONE, 0)
            code[(code == 0) & shared & (unlike > 1)] = ASK
            code[(code == ASK) & (unlike > hot)] = SPLIT
            codes[order] = code
        rows = [(group, s, zipped(x.tobytes())) for s, x in zip(table.column("shard").to_pylist(), np.split(codes, ends[:-1]), strict=True) if x.any()]
        return _table(_DEALT, rows)

    return run


def _spans(text: np.ndarray, place: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs in order of text and place, those that touch put together: text, start, end."""
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1] + size[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(text)) - 1
    return text[first], place[first], place[last] + size[last] - 1 + length


def _fetch(length: int, groups: int, spread: int):
    """The runs that are gone, and the bytes of those asked for, dealt out by key."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        if not table.num_rows:
            return _table(_FOUND, [])
        number, zipped, unzip = table.column("shard")[0].as_py(), _zipper(), zstandard.ZstdDecompressor().decompress
        shard = _Shard(table, length)
        found = _Runs(shard, length, groups)
        codes = np.zeros(len(found.where), np.uint8)
        for g, blob in zip(replies.column("group").to_pylist(), replies.column("blob").to_pylist(), strict=True):
            codes[found.starts[g] : found.starts[g + 1]] = np.frombuffer(unzip(blob), np.uint8)
        code = codes[found.entry]
        gone = (code == GONE) | (found.doc > found.first_doc[found.entry])
        rows = []
        if gone.any():
            rows.append((number % spread, number, 1, _packed(zipped, *_spans(found.text[gone], found.place[gone], found.size[gone], length))))
        by: dict[int, list] = {}
        some = np.flatnonzero((code == ASK) & ~gone)
        for t, p, n, d, k in zip(*(x[some].tolist() for x in (found.text, found.place, found.size, found.doc, found.where[found.entry])), strict=True):
            by.setdefault((k >> 32) % spread, []).append((k & 0x7FFFFFFF, d, t, p, shard.texts[t][p : p + n + length - 1]))
        some = np.flatnonzero((code == SPLIT) & ~gone)
        if len(some):
            # each window of these runs once, by its bytes; in other documents of this shard it is gone
            text, size = np.repeat(found.text[some], found.size[some]), found.size[some]
            place = np.repeat(found.place[some], size) + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
            first: dict[bytes, int] = {}
            late: list[tuple[int, int]] = []
            for t, p in zip(text.tolist(), place.tolist(), strict=True):
                window, d = shard.texts[t][p : p + length], int(shard.ids[t])
                if first.setdefault(window, d) < d:  # texts come by rising document
                    late.append((t, p))
                    continue
                halves = gram_hashes(np.frombuffer(window, np.uint8), length - 1)[0]
                k = int(_mix(halves).min())
                by.setdefault(k % spread, []).append((k >> 33, d, t, p, window))
            if late:
                t, p = np.array(late, np.int64).T
                rows.append((number % spread, number, 1, _packed(zipped, *_spans(t, p, np.ones(len(t), np.int64), length))))
        for g, asked in by.items():
            asked.sort(key=lambda x: x[0])  # runs of a key look alike
            head = np.array([[k, d, t, p, len(x)] for k, d, t, p, x in asked], "<i8")
            rows.append((g, number, 0, zipped(np.int64(len(asked)).tobytes() + head.T.tobytes() + b"".join([x for *_, x in asked]))))
        return _table(_FOUND, rows)

    return run


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Burrows-Wheeler order of a string's suffixes by `depth` symbols or more, the first symbol of each, and where in
    the order each suffix goes on without it (the way back along the transform's last-to-first map)."""
    n = len(text)
    wide = np.zeros(n + 7, np.int64)
    wide[:n] = text
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key << 9 | wide[j : j + n]
    known = 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        if known >= depth or rank[order[-1]] == n - 1:
            break
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - known)] = rank[known:] + 1
        key = rank * (n + 1) + behind
        known *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, text[order], place[(order + 1) % n]


def classes(text: np.ndarray, length: int) -> np.ndarray:
    """A number for each place of a byte string (0: a separator), equal if and only if the next `length` symbols are.

    borders[j] says that the common prefix of suffixes j - 1 and j is shorter than the
    current depth. Extended backward by a common first symbol, two neighbours' prefix is one
    longer than that of the suffixes behind it; it is cut if a border lies between those.
    The order of the transform alone says nothing of where borders lie: the expansion finds
    them, by increasing common prefix.
    """
    order, first, behind = transform(text, length)
    borders = np.append(True, first[1:] != first[:-1])
    open_ = np.flatnonzero(~borders)
    after, before = behind[open_], behind[open_ - 1]
    for _ in range(1, length):
        level = np.cumsum(borders, dtype=np.int32)
        cut = level[after] != level[before]
        if not cut.any():
            break
        borders[open_[cut]] = True
        stay = ~cut
        open_, after, before = open_[stay], after[stay], before[stay]
    out = np.empty(len(text), np.int64)
    out[order] = np.cumsum(borders) - 1
    return out


def _expand(length: int):
    """Of runs of one key that aren't alike: which windows start in a smaller document too."""

    def solve(head: np.ndarray, shard: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """Shard, text, start and end of what is gone."""
        _, doc, text_number, place, size = head
        end = np.cumsum(size)
        start = end - size
        # a second, stricter key leaves out runs that share only a few bytes by chance
        windows = size - length + 1
        owner = np.repeat(np.arange(len(size)), windows)
        at = np.repeat(start, windows) + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        key = sliding_min(_order(gram_hashes(body, LONG_GRAM)[0]), length - LONG_GRAM + 1)[at]
        order = np.argsort(key)
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        by_key = doc[owner[order]]
        several = np.minimum.reduceat(by_key, first) != np.maximum.reduceat(by_key, first)
        live = np.zeros(len(key), bool)
        live[order] = np.repeat(several, np.diff(np.append(first, len(key))))
        if not live.any():
            return None
        keep = np.zeros(len(body) + 1, np.int64)
        np.add.at(keep, at[live], 1)
        np.add.at(keep, at[live] + length, -1)
        keep = keep.cumsum()[:-1] > 0
        # what is kept, with a separator after each stretch and each run
        last = np.zeros(len(body), bool)
        last[end - 1] = True
        last[:-1] |= keep[:-1] & ~keep[1:]
        chosen = np.flatnonzero(keep)
        text = np.zeros(len(chosen) + int(last[chosen].sum()), np.int64)
        to = np.arange(len(chosen)) + np.append(0, np.cumsum(last[chosen])[:-1])
        text[to] = body[chosen].astype(np.int64) + 1
        where = np.zeros(len(body), np.int64)
        where[chosen] = to
        number = classes(text, length)[where[at[live]]]
        owner, at = owner[live], at[live]
        low = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, number, doc[owner])
        gone = low[number] < doc[owner]
        if not gone.any():
            return None
        owner, at = owner[gone], at[gone]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)))
        size, owner = np.diff(np.append(first, len(at))), owner[first]
        begin = place[owner] + at[first] - start[owner]
        return shard[owner], text_number[owner], begin, begin + size - 1 + length

    def run(table: pa.Table) -> pa.Table:
        give_back()
        unzip, zipped = zstandard.ZstdDecompressor().decompress, _zipper()
        rows, heads, shards, bodies = [], [], [], []
        for s, kind, blob in zip(*(table.column(x).to_pylist() for x in ("shard", "kind", "blob")), strict=True):
            if kind:
                rows.append((s, blob))
                continue
            blob = unzip(blob)
            n = int(np.frombuffer(blob[:8], "<i8")[0])
            heads.append(np.frombuffer(blob, "<i8", 5 * n, 8).reshape(5, n))
            shards.append(np.full(n, s))
            bodies.append(np.frombuffer(blob, np.uint8, offset=8 + 40 * n))
        if heads:
            head, shard, body = np.concatenate(heads, axis=1), np.concatenate(shards), np.concatenate(bodies)
            start = np.cumsum(head[4]) - head[4]
            order = np.argsort(head[0], kind="stable")
            key, total = head[0][order], np.cumsum(head[4][order])
            # whole keys, as many as make up a transform
            borders = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            share = (total - head[4][order])[borders] // JOINED
            cuts = borders[np.flatnonzero(np.append(True, share[1:] != share[:-1]))]
            gone = []
            for part in np.split(order, cuts[1:]):
                size = head[4][part]
                at = np.repeat(start[part], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                if (out := solve(head[:, part], shard[part], body[at])) is not None:
                    gone.append(out)
            if gone:
                columns = [np.concatenate(x) for x in zip(*gone, strict=True)]
                order = np.argsort(columns[0], kind="stable")
                columns = [x[order] for x in columns]
                first = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
                for part in np.split(np.arange(len(order)), first[1:]):
                    rows.append((int(columns[0][part[0]]), _packed(zipped, *(x[part] for x in columns[1:]))))
        return _table(_GONE, rows)

    return run


def _cut(length: int, characters: bool):
    """What is left of each row's text."""

    def left(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
        edges = np.zeros(len(text) + 1, np.int64)
        np.add.at(edges, start, 1)
        np.add.at(edges, end, -1)
        gone = edges.cumsum()[:-1] > 0
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
        data, removed = np.frombuffer(text, np.uint8), int(gone.sum())
        if characters:  # what is left of a character that was cut goes too
            char = np.cumsum(data & 0xC0 != 0x80)
            gone = (np.bincount(char, gone) > 0)[char]
        return len(text), removed, spans, data[~gone].tobytes()

    def run(table: pa.Table, spans: pa.Table) -> pa.Table:
        give_back()
        shard = _Shard(table, length)
        text, start, end = _unpacked(spans.column("blob").to_pylist(), 3)
        order = np.argsort(text, kind="stable")
        text, start, end = text[order], start[order], end[order]
        done: dict[bytes, tuple] = {}
        for t in np.unique(text).tolist():
            part = slice(*np.searchsorted(text, [t, t + 1]))
            done[shard.texts[t]] = left(shard.texts[t], start[part], end[part])
        rows = []
        for i, x in zip(shard.row_ids, shard.row_texts, strict=True):
            n = len(x)
            if i is None or n < length:
                rows.append((n, 0, 0, x))
            elif i > shard.least[x]:
                rows.append((n, n, 1, b""))
            else:
                rows.append(done.get(x) or (n, 0, 0, x))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        out = pa.table([table.column("id"), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])
        return out.append_column("carried", table.column("carried")) if "carried" in table.column_names else out

    return run


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = _zipper()
    for batch in batches:
        texts = [pack((x or "").encode("utf-8", "surrogatepass")) for x in batch.column("packed").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("packed"), "packed", pa.array(texts, pa.binary()))


def dedup(
    spark: SparkSession, df: DataFrame, length: int = 50, text: str = "text", id_col: str = "doc_id", carry: tuple[str, ...] = (), characters: bool = False, hot: int = HOT
) -> DataFrame:
    """What is left of every row's whole text, as bytes, once repeated strings are removed.

    Returns id_col (long), n_bytes, n_removed, n_spans (maximal removed runs), kept (binary,
    which may cut a character in two, unless `characters` drops what is left of such) and,
    if there are columns to carry, the struct carried. A null text is empty; a text shorter
    than `length` loses nothing. Rows that repeat an id and text all get the same result;
    unlike texts under one id lose nothing to each other. A row with a null id is compared
    with nothing and keeps its text. An empty table gives no rows; columns may have any
    name. Results are the same for any `hot`, the number of unlike runs above which a key is
    split by longer keys.
    """
    if length <= RUN:
        raise ValueError(f"strings of at least {RUN + 1} bytes are looked for")
    partitions = tasks_for(spark, total_bytes(df, text), TASK_BYTES)
    groups = shards = partitions * SPREAD
    named = df.select(df[id_col].cast("long").alias("id"), df[text].alias("packed"), *[F.struct(*[df[x] for x in carry]).alias("carried")] * bool(carry))
    shard = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("packed")).otherwise(F.xxhash64("id")), F.lit(shards)).cast("int")
    kind = f", carried {named.schema['carried'].dataType.simpleString()}" if carry else ""
    columns = ["shard", "id", "packed", *["carried"] * bool(carry)]
    texts = named.withColumn("shard", shard).select(*columns).mapInArrow(_zip, f"shard int, id bigint, packed binary{kind}")
    texts = dealt(texts, partitions, "shard")

    bare = texts.where("id is not null").select("shard", "id", "packed")
    found = bare.groupBy("shard").applyInArrow(_find(length, groups), _ddl(_DEALT))
    replies = checkpointed(found.repartition(partitions, "group").groupBy("group").applyInArrow(_compare(hot), _ddl(_DEALT)))
    asked = bare.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(_fetch(length, groups, partitions), _ddl(_FOUND))
    gone = asked.repartition(partitions, "group").groupBy("group").applyInArrow(_expand(length), _ddl(_GONE))
    schema = f"id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary{kind}"
    out = texts.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(_cut(length, characters), schema)
    return out.withColumnRenamed("id", id_col)
