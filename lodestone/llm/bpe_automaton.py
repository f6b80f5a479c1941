"""Byte-pair encoding and decoding with a deterministic automaton over token labels.

The automaton starts as one state with an arc for each byte, all leading back. Each merge
(u, v), in order of rank, is a gadget: the state that u-arcs lead to is split, the copy
loses its v-arc, u-arcs are led to the copy, and each state with a u-arc gets an arc uv to
the place where v led. A sequence of labels is a correct encoding if and only if the
automaton has that path, and each string has one such path.

All arcs of a label lead to the same state, and a copy differs from the state that it was
made of by one arc. So a state is kept as the label whose arcs were led to it and the rank
of its gadget; what it lost goes by label and rank. Transitions (state, label) -> state are
resolved from these on first use and then stay in the transition table. A word is read by
its bytes: at each place, of the labels that end there, the one is taken that has a
transition from the state in which it starts, and its state is the place's.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows
from .presplit import Presplit, load


#: Arcs and ways that a worker remembers.
ARCS = 3_000_000


class Automaton:
    """The automaton of a merge list, with string encoding and label decoding."""

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: x for x, i in ids.items()}
        self.ids = dict(ids)
        size = max(self.label) + 1
        #: The state that a label's arcs lead to, now and before the first gadget that split it.
        self.target, self.base = [0] * size, [0] * size
        #: Of each state: the label whose arcs were led to it, and the rank of the gadget that made it.
        self.owner, self.made = [-1], [-1]
        #: (label whose arcs lead there, label lost) -> rank of the gadget.
        self.lost: dict[tuple[int, int], int] = {}
        #: Labels in front of a merged label, outermost first, with the rank up to which each was a whole label.
        self.born = [-1] * size
        self.left, self.right = [-1] * size, [-1] * size
        dead = set()
        for rank, (a, b) in enumerate(merges):
            u, v, uv = ids[a], ids[b], ids[a + b]
            if u in dead or v in dead or self.born[uv] >= 0 or not self._arc(self.target[u], v, rank):
                dead.add(uv)  # no string is encoded with it
                continue
            self._gadget(u, v, uv, rank)
        for x in dead:
            if self.born[x] < 0:
                self.ids.pop(self.label[x], None)
        #: (state, label) -> the next state, or -1: as far as it was used.
        self.table: dict[int, int] = {}
        self._suffixes()
        self.jump = dict(self.to)  # and, as they are used, the ways that lead back

    def _suffixes(self) -> None:
        """A table from (place, byte) to the place after it, where a place names the longest end of what was read that begins some label."""
        self.to: dict[int, int] = {}
        whole, depth = [-1], [0]
        for x, i in self.ids.items():
            at = 0
            for b in x:
                nxt = self.to.get(at << 8 | b)
                if nxt is None:
                    nxt = self.to[at << 8 | b] = len(whole)
                    whole.append(-1)
                    depth.append(depth[at] + 1)
                at = nxt
            whole[at] = i
        self.back = [0] * len(whole)
        #: The longest label that ends at a place; the next shorter label that ends a label; its bytes.
        self.ends = whole[:]
        self.shorter, self.size = [-1] * len(self.born), [0] * len(self.born)
        for key, at in sorted(self.to.items(), key=lambda x: depth[x[1]]):
            if depth[at] > 1:
                self.back[at] = self._next(self.back[key >> 8], key & 255)
            behind = self.ends[self.back[at]] if self.back[at] else -1
            if whole[at] < 0:
                self.ends[at] = behind
            else:
                self.shorter[whole[at]], self.size[whole[at]] = behind, depth[at]

    def _next(self, at: int, b: int) -> int:
        if (got := self.to.get(at << 8 | b)) is not None:
            return got
        return self._next(self.back[at], b) if at else 0

    def _gadget(self, u: int, v: int, uv: int, rank: int) -> None:
        self.base[uv] = self.target[uv] = self.target[v]
        self.owner.append(u)
        self.made.append(rank)
        self.target[u] = len(self.owner) - 1
        self.lost[u, v] = rank
        self.born[uv], self.left[uv], self.right[uv] = rank, u, v

    def _arc(self, state: int, label: int, now: int) -> bool:
        """Whether a state has an arc of this label, before the gadget of rank `now`.

        A state lacks what it or a state before it lost; and as arc uv came to states with
        an arc u, what lost u before that lacks uv.
        """
        x, until = label, now
        while x >= 0:
            at = state
            while at:
                rank = self.lost.get((self.owner[at], x))
                if rank is not None and rank <= self.made[at] and (rank < until or x != label and rank == until):
                    return False
                at = self.base[self.owner[at]]
            until, x = self.born[x], self.left[x]
        return True

    def next(self, state: int, label: int) -> int:
        """The transition from a state by a label; -1 if there is none."""
        key = state << 20 | label
        got = self.table.get(key)
        if got is None:
            if len(self.table) > ARCS:
                self.table.clear()
            got = self.table[key] = self.target[label] if self._arc(state, label, 1 << 60) else -1
        return got

    def encode(self, word: bytes) -> list[int]:
        """Labels of the one path that spells the word."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        if len(self.jump) > ARCS:
            self.jump = dict(self.to)
        to, ends, shorter, size, table = self.jump, self.ends, self.shorter, self.size, self.table
        # the label that the path of the first n bytes ends with, and the state that it ends in
        last, states, at, n = [-1], [0], 0, 0
        for b in word:
            n += 1
            key = at << 8 | b
            at = to.get(key)
            if at is None:
                at = to[key] = self._next(key >> 8, b)
            label = ends[at]
            while True:
                state = states[n - size[label]]
                nxt = table.get(state << 20 | label)
                if nxt is None:
                    nxt = self.next(state, label)
                if nxt >= 0:
                    break
                label = shorter[label]
            last.append(label)
            states.append(nxt)
        out = []
        while n:
            out.append(last[n])
            n -= size[last[n]]
        out.reverse()
        return out


class Codec:
    """Encodes texts to ids as little-endian 32-bit bytes, and decodes those."""

    def __init__(self, path: str):
        ids, merges, added = load(path)
        self.automaton = Automaton(ids, merges)
        self.emit = [b""] * (max([*ids.values(), *added.values()]) + 1)
        for x, i in ids.items():
            self.emit[i] = x
        for x, i in added.items():
            self.emit[i] = x.encode()
        packed = [i.to_bytes(4, "little") for i in range(len(self.emit))]
        encode = self.automaton.encode
        self.split = Presplit(path, lambda w: b"".join([packed[i] for i in encode(w)]), lambda x: packed[added[x]], added, b"".join)

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.split.results(text or ""))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        emit = self.emit
        return b"".join([emit[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, text: str = "text", id_col: str = "doc_id", ids: bool = True, digests: bool = False) -> DataFrame:
    """Token ids of every row's whole text.

    Returns id_col, n_tokens and, as asked for, `ids` (array of int) and the digests of
    ids and of the text decoded from them. A null text counts as empty (no tokens); null
    ids and repeated rows stay as they are; an empty table gives an empty table; other
    columns are not carried and may have any name. A text may be of any length.
    """
    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, n_tokens bigint" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batch: pa.RecordBatch) -> dict:
        coder = codec(path)
        packed = [coder.encode(x) for x in batch.column(1).to_pylist()]
        out = {"id": batch.column(0), "n_tokens": [len(x) // 4 for x in packed]}
        if ids:
            out["ids"] = [np.frombuffer(x, "<u4").astype(np.int32) for x in packed]
        if digests:
            out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in packed]
            out["decoded_sha256"] = [hashlib.sha256(coder.decode(x).encode("utf-8")).hexdigest() for x in packed]
        return out

    return map_rows(df.select(df[id_col].alias("id"), df[text].alias("text")), run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Texts of arrays of token ids: the labels along the automaton's path, one after another.

    Returns id_col and text. Null ids give a null text, an empty array an empty text.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> dict:
        coder = codec(path)
        return {"id": batch.column(0), "text": [None if x is None else coder.decode(np.asarray(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]}

    return map_rows(df.select(df[id_col].alias("id"), df[ids].alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)
