"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Documents are sets of word shingles, linked where the Jaccard similarity reaches a
threshold; the groups are the connected components of the links.

1. Equal sets are pre-aggregated: one document stands for all.
2. Banding. Signatures are cut into bands; documents that agree on a band are candidates.
   A group of n near copies would give n * n pairs, so a band's documents are first compared
   with one of them only: the one that meets most others over all its bands, which is the
   most typical of its group. What that links is one component, and needs no more pairs.
3. Bands that still hold several components have the pairs between components compared,
   block by block inside the tasks, each pair in the first band that both documents share.
   Of the pairs that survive step 4 a block pair gives, the most alike first, those that
   would join components if they were links: one fewer than its components at most. It says
   whether there are others. Once those are verified, the block pairs with others between
   components that are still apart are sent the full sets, verify them in place, and give
   just the links that join components there. So documents that are much alike give no more
   pairs than there are of them in a block, linked or not, and none is left out.
4. Verification. A pair's signatures are compared batch by batch. After each, the posterior
   of its similarity (uniform prior, m of n hashes equal) says how likely it is to reach the
   threshold; below the chosen miss probability the pair is dropped. Every survivor is
   verified on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, give_back, held, in_shares, words_of

#: Words in a shingle, least similarity (as a fraction of whole numbers), bands and hashes in a band.
#: At the threshold 32 bands of 4 miss a pair once in 190,000 times.
SHINGLE, THRESHOLD, BANDS, ROWS = 5, (75, 100), 32, 4
#: Hashes (of a byte each) for verification, compared so many at a time, and the miss probability.
CHECKS, BATCH, MISS = 512, 64, 1e-6
#: Documents of a band in a block, and bytes of their sets; bytes of sets in a block for verification, and least blocks.
BLOCK, BLOCK_BYTES, SET_BYTES, SET_BLOCKS = 2048, 32 << 20, 16 << 20, 4
#: Shingles hashed at a time, which bounds memory for very long texts.
STRIDE = 4096
#: Texts whose words or shingles a task holds at a time.
SHARE = 200
#: Rows of links in a partition, and least partitions: few links in many partitions are mostly files of a few bytes.
LINKS, LINK_PARTS = 100_000, 8
#: Words whose hashes a task remembers.
KEPT = 300_000

U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(29))


def _word(word: bytes, kept: dict[bytes, int]) -> int:
    got = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    if len(word) <= 64:
        if len(kept) >= KEPT:
            kept.clear()
        kept[word] = got
    return got


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes; of fewer words, all of them as one; without words, empty."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    # hashes of words are let go of when a task ends
    kept = held(dict)
    known = kept.get
    h = np.array([x if (x := known(w)) is not None else _word(w, kept) for w in words], np.uint64)
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mix(out * U64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


@lru_cache(maxsize=4)
def _factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, dtype=np.uint64)[:, None] | U64(1), rng.integers(0, 2**64, n, dtype=np.uint64)[:, None]


def signature(members: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The least of n hashes over a set."""
    a, b = _factors(n, seed)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), STRIDE):
        h = members[None, i : i + STRIDE] * a
        h += b
        np.minimum(out, h.min(1), out=out)
    return out


def band_keys(members: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for column in signature(members, bands * rows, 1).reshape(bands, rows).T:
        h = _mix(h * U64(0x9E3779B97F4A7C15) + column)
    return h


def check_bytes(members: np.ndarray) -> bytes:
    # mixed first, as the top bits of a minimum are mostly 0
    return (_mix(signature(members, CHECKS, 2)) >> U64(56)).astype(np.uint8).tobytes()


@lru_cache(maxsize=4)
def least_matches(threshold: tuple[int, int], miss: float) -> np.ndarray:
    """By batches seen: with fewer equal hashes, the posterior of reaching the threshold is below the miss probability.

    A hash of one byte is equal by chance once in 256 times, so that a similarity s is seen
    as s + (1 - s) / 256. The posterior of s is summed on a grid.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    reach = s >= threshold[0] / threshold[1]
    out = []
    for n in range(BATCH, CHECKS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[reach].sum() / w.sum() >= miss:
                break
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int], miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs (rows of a and b: signatures for verification) that aren't dropped in any batch, and their equal hashes."""
    live, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(least_matches(threshold, miss)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal = equal + (a[live, part] == b[live, part]).sum(1)
        fine = equal >= least
        live, equal = live[fine], equal[fine]
    return live, equal


def linked(x: np.ndarray, y: np.ndarray, threshold: tuple[int, int]) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return threshold[1] * both >= threshold[0] * (len(x) + len(y) - both)


def _shares(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, SHARE) for i in range(0, batch.num_rows, SHARE))


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, bands, seen = [], [], [], {}
            for x in chain.from_iterable(in_shares(batch.column(1), SHARE)):
                s = shingles(x, size)
                n.append(len(s))
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                key.append(digest)
                # of equal sets in a batch one carries the bands
                bands.append(None if digest is None or digest in seen else band_keys(s).view(np.int64))
                seen[digest] = 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "key", "bands"])
        give_back()

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(_shares, batches)):
            sets = [shingles(x, size) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([check_bytes(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "checks", "members"])
        give_back()

    return run


def _verify(threshold: tuple[int, int], miss: float):
    """Of the pairs of two blocks of documents, those that are linked: some text of one with some text of the other."""

    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        out = np.empty((2, 0), np.int64)
        if sets.num_rows and pairs.num_rows:
            ids = sets.column("id").to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            both = [pairs.column(x).to_numpy() for x in ("a", "b")]
            low = [np.searchsorted(ids, x) for x in both]
            n = [np.searchsorted(ids, x, side="right") - y for x, y in zip(both, low, strict=True)]
            # an id has one set, unless it names several texts
            pair = np.repeat(np.arange(pairs.num_rows), n[0] * n[1])
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(n[0] * n[1]) - n[0] * n[1], n[0] * n[1])
            at = [order[low[0][pair] + nth // n[1][pair]], order[low[1][pair] + nth % n[1][pair]]]
            checks = np.frombuffer(b"".join(sets.column("checks").to_pylist()), np.uint8).reshape(-1, CHECKS)
            members = [np.frombuffer(x, np.uint64) for x in sets.column("members").to_pylist()]
            live = np.concatenate([k + survivors(checks[at[0][k : k + STRIDE]], checks[at[1][k : k + STRIDE]], threshold, miss)[0] for k in range(0, len(pair), STRIDE)])
            yes = np.unique(pair[[i for i in live.tolist() if linked(members[at[0][i]], members[at[1][i]], threshold)]])
            out = np.stack([x[yes] for x in both]) if len(yes) else out
        return pa.table({"a": out[0], "b": out[1]})

    return run


#: Columns by which a pair of blocks is known: the band, the two blocks, whether both are of the lesser components.
PLACE = ("band", "i", "j", "inner")


class Joins:
    """Components that pairs join, by union and find."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def apart(self, x: int, y: int) -> bool:
        return self.root(x) != self.root(y)

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def _between(table: pa.Table, threshold: tuple[int, int], miss: float) -> tuple:
    """Documents, components and sets of a pair of blocks; its surviving pairs between components, the most alike first.

    A pair that shares an earlier band is left to that band.
    """
    sides, before = [], []
    for side in (False, True):
        part = table.filter(pc.equal(table.column("right"), side))
        checks = np.frombuffer(b"".join(part.column("checks").to_pylist()), np.uint8).reshape(-1, CHECKS)
        sides.append((part.column("id").to_numpy(), part.column("comp").to_numpy(), checks, part.column("members").to_pylist() if "members" in part.column_names else None))
        before.append([set(x) for x in part.column("before").to_pylist()])
    (_, ca, sa, _), (_, cb, sb, _) = sides
    kept = [np.empty((3, 0), np.int64)]
    for k in range(0, len(ca), STRIDE // 64):
        ia, ib = np.nonzero(ca[k : k + STRIDE // 64, None] != cb[None, :])
        ia += k
        for n in range(0, len(ia), 1 << 15):
            part = slice(n, n + (1 << 15))
            live, equal = survivors(sa[ia[part]], sb[ib[part]], threshold, miss)
            i, j = ia[part][live], ib[part][live]
            here = np.array([before[0][x].isdisjoint(before[1][y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
            kept.append(np.stack([i[here], j[here], equal[here]]))
    a, b, equal = np.concatenate(kept, axis=1)
    order = np.argsort(-equal, kind="stable")
    return *sides, a[order], b[order]


def _across(threshold: tuple[int, int], miss: float):
    """Of the surviving pairs (a, b) of a pair of blocks those that would join components; a row without pair if there are others."""

    def run(table: pa.Table) -> pa.Table:
        left, right, a, b = _between(table, threshold, miss)
        place = [table.column(x)[0].as_py() for x in PLACE]
        joins, out = Joins(), []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = int(left[1][i]), int(right[1][j])
            if joins.apart(x, y):
                joins.join(x, y)
                out.append([*sorted((int(left[0][i]), int(right[0][j]))), *place])
        if len(out) < len(a):
            out.append([None, None, *place])
        return _rows(out, ("a", "b", *PLACE))

    return run


def _apart(threshold: tuple[int, int], miss: float):
    """A row for a pair of blocks that has surviving pairs between components."""

    def run(table: pa.Table) -> pa.Table:
        survive = len(_between(table, threshold, miss)[2])
        return _rows([[table.column(x)[0].as_py() for x in PLACE]] if survive else [], PLACE)

    return run


def _joining(threshold: tuple[int, int], miss: float):
    """Of a pair of blocks, with full sets, links that join all its components that links between the blocks join."""

    def run(table: pa.Table) -> pa.Table:
        left, right, a, b = _between(table, threshold, miss)
        joins, out = Joins(), []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = int(left[1][i]), int(right[1][j])
            if joins.apart(x, y) and linked(np.frombuffer(left[3][i], np.uint64), np.frombuffer(right[3][j], np.uint64), threshold):
                joins.join(x, y)
                out.append(sorted((int(left[0][i]), int(right[0][j]))))
        return _rows(out, ("a", "b"))

    return run


def _rows(rows: list[list], names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.table([pa.array(x, pa.bool_() if n == "inner" else pa.int64()) for x, n in zip(columns, names, strict=True)], names=list(names))


def parted(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many short rows, in no more partitions than those fill."""
    return df.coalesce(max(LINK_PARTS, -(-rows // LINKS)))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows (id, comp) of the connected components of links (a, b): comp is the smallest id.

    Large-star and small-star steps in turn: each joins a node's neighbours to the smallest
    one around. A few rounds, each from files, until their number and the sum of their
    hashes no longer change. `rows` is the number of links, counted if it isn't given; each
    step has at most as many rows, so that they lie in as many partitions as those fill.
    """
    rows = links.count() if rows is None else rows
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    edges, seen = parted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), rows), None
    while True:
        both = edges.select(F.explode(F.array(pair(F.col("u"), F.col("v")), pair(F.col("v"), F.col("u")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = parted(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), rows)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = parted(large.join(least, "u"), rows).select(F.explode(F.array(pair(F.col("v"), F.col("m")), pair(F.col("u"), F.col("m")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = checkpointed(parted(small, rows))
        # decimal, as a sum of hashes overflows a long
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots)


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components once more links (a, b) are known: those of the components, then each row's."""
    rows, known = links.count(), comps.count()
    links, comps = parted(links, rows), parted(comps, known)
    of = lambda df, x: parted(df.join(comps.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")), x, "left"), rows).withColumn(x, F.coalesce(f"c{x}", x))
    above = checkpointed(parted(components(of(of(links, "a"), "b").select("a", "b"), rows), rows))
    up = comps.join(above.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
    return checkpointed(parted(up.unionByName(above.join(comps.select("id"), "id", "left_anti")), known + rows))


def _linked_pairs(edges: DataFrame, sets: DataFrame, blocks: int, threshold: tuple[int, int], miss: float) -> DataFrame:
    """The edges (a, b) that are links.

    Documents fall into blocks. A pair is verified with its two blocks, to which each of
    their documents' sets is sent once, however many of its pairs are there.
    """
    block = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks))
    i, j = block("a"), block("b")
    pairs = edges.select("a", "b", (F.least(i, j) * blocks + F.greatest(i, j)).alias("pair"))
    needed = pairs.select("pair", F.explode(F.array("a", "b")).alias("id")).distinct()
    sent = needed.join(sets, "id").select(F.col("pair").alias("to"), "id", "checks", "members")
    return sent.groupBy("to").cogroup(pairs.groupBy("pair")).applyInArrow(_verify(threshold, miss), "a bigint, b bigint")


def near_duplicates(spark: SparkSession, df: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, miss: float = MISS) -> DataFrame:
    """Groups of near-duplicate texts: id_col (long), n_shingles, component_id, kept.

    Words are separated by \\x20 and \\x09-\\x0D, A-Z are lower-cased. Documents are linked
    where intersection / union of their shingle sets reaches the threshold; component_id is
    the smallest id that links reach, kept says that it is the row's own. A null text, or
    one without words, has no shingles and is linked with nothing; rows with a null id are
    linked with nothing, have a null component_id and are kept. Rows that repeat an id come
    back as often as they occur; unlike texts under one id all belong to its component. An empty table gives no rows; other columns are not
    carried and may have any name. Texts may be of any length.
    """
    docs = df.select(df[id_col].cast("long").alias("id"), df[text].alias("text"))
    sketched = checkpointed(docs.mapInArrow(_sketch(size), "id bigint, n bigint, key binary, bands array<bigint>"))
    named = sketched.where("id is not null and key is not null")
    leaders = named.groupBy("key").agg(F.min("id").alias("leader"), F.first("n").alias("n"), F.first("bands", ignorenulls=True).alias("bands"))
    leaders = checkpointed(leaders)

    rows = leaders.select(F.col("leader").alias("id"), "n", F.explode("bands").alias("band"))
    counts = rows.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    rows = checkpointed(rows.join(counts, "band"))
    weight = rows.groupBy("id").agg(F.sum("size").alias("weight"))
    centre = rows.join(weight, "id").groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top")).select("band", (-F.col("top.id")).alias("centre"))
    star = rows.join(centre, "band").where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()

    texts = docs.join(rows.select("id").distinct(), "id").dropDuplicates(["id", "text"])
    sets = checkpointed(texts.mapInArrow(_sets(size), "id bigint, checks binary, members binary"))
    set_blocks = max(SET_BLOCKS, -(-(sets.agg(F.sum(F.length("members"))).first()[0] or 0) // SET_BYTES))
    # all texts of an id belong together
    several = named.groupBy("id").agg(F.min("key").alias("one"), F.max("key").alias("other")).where("one <> other").select("id")
    same = named.join(several, "id").select("id", "key").distinct().join(leaders.select("key", "leader"), "key").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    links = checkpointed(_linked_pairs(star, sets, set_blocks, threshold, miss).unionByName(same))
    rows_of_links = links.count()
    comps = checkpointed(parted(components(links, rows_of_links), rows_of_links))

    # bands that hold several components: the largest, in blocks, meets the others, and these each other
    labelled = rows.join(comps, "id", "left").select("band", "id", "n", F.coalesce("comp", "id").alias("comp"))
    parts = labelled.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum(F.col("n") * 8).alias("bytes"))
    split = parts.groupBy("band").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "comp", "bytes")).alias("big")).where("comps > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES))
    split = split.select("band", F.col("big.comp").alias("main"), blocks(F.col("big.n"), F.col("big.bytes")).alias("mains"), blocks(F.col("n") - F.col("big.n"), F.col("bytes") - F.col("big.bytes")).alias("others"))
    block: Column = F.xxhash64("id", "band")
    lesser = F.col("comp") != F.col("main")
    parts = labelled.join(split, "band").select("band", "id", "mains", "others", lesser.alias("lesser"), F.pmod(block, F.when(lesser, F.col("others")).otherwise(F.col("mains"))).alias("at"))
    # a document has at most as many rows as there are bands
    each = parts.groupBy("id").agg(F.collect_list(F.struct("band", "mains", "others", "lesser", "at")).alias("all")).select("id", F.col("all.band").alias("keys"), F.explode("all").alias("p"))
    parts = checkpointed(each.select("id", "p.*", F.filter("keys", lambda x: x < F.col("p.band")).alias("before")))
    parts = parted(parts, parts.count())
    to = lambda low, most: F.explode(F.sequence(low.cast("long"), F.col(most).cast("long") - 1))
    at = F.col("at").cast("long")
    placed = lambda df, i, j, inner, right: df.select("band", i.alias("i"), j.alias("j"), F.lit(inner).alias("inner"), F.lit(right).alias("right"), "id", "before")
    large, small = parts.where("not lesser"), parts.where("lesser")
    places = placed(large, at, to(F.lit(0), "others"), False, False)
    places = places.unionByName(placed(small, to(F.lit(0), "mains"), at, False, True))
    places = places.unionByName(placed(small, at, to(at, "others"), True, False))
    places = places.unionByName(placed(small, F.explode(F.sequence(F.lit(0).cast("long"), at)), at, True, True))

    def met(places: DataFrame, comps: DataFrame, fn, schema: str, *columns: str) -> DataFrame:
        """fn of each pair of blocks with the documents of both, as it returns."""
        full = places.join(comps, "id", "left").join(sets.select("id", *columns), "id").withColumn("comp", F.coalesce("comp", "id"))
        return checkpointed(full.groupBy(*PLACE).applyInArrow(fn(threshold, miss), schema))

    schema = "a bigint, b bigint, band bigint, i bigint, j bigint, inner boolean"
    found = met(places, comps, _across, schema, "checks")
    more = checkpointed(_linked_pairs(found.where("a is not null").select("a", "b").distinct(), sets, set_blocks, threshold, miss))
    if not more.isEmpty():
        comps = joined(comps, more)
    rest = found.where("a is null").select(*PLACE)
    if not rest.isEmpty():
        apart = met(places.join(rest, list(PLACE)), comps, _apart, "band bigint, i bigint, j bigint, inner boolean", "checks")
        if not apart.isEmpty():
            last = met(places.join(apart, list(PLACE)), comps, _joining, "a bigint, b bigint", "checks", "members")
            comps = comps if last.isEmpty() else joined(comps, last)

    groups = leaders.select("key", "leader").join(comps.withColumnRenamed("id", "leader"), "leader", "left").select("key", F.coalesce("comp", "leader").alias("comp"))
    out = sketched.select("id", "n", "key").join(groups, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
