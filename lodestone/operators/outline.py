"""The outline of documents: which headings a node stands under, and what each section holds.

A heading ends those of its level and below. What a run of nodes does to the open headings
is that it ends all of some level and below and opens some of its own; two such effects in a
row are one again. So a document is cut into parts of a bounded number of nodes: each part's
effect is found alone, the effects of a document are combined in order, and each part is
then walked once more from the headings that are open where it begins. A book of any length
is many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import written

#: Nodes of a part, at most.
PART = 20_000

#: An open heading: level, where it stands, its title, nodes and characters before it.
OPEN = "array<struct<level:int,ordinal:bigint,title:string,nodes:bigint,chars:bigint>>"
_OPEN = pa.list_(pa.struct([("level", pa.int32()), ("ordinal", pa.int64()), ("title", pa.string()), ("nodes", pa.int64()), ("chars", pa.int64())]))


def _walk(table: pa.Table, opened: list[dict], nodes: int, chars: int):
    """Each node in order with the headings open at it and those it ends: (row, open, ended, nodes before, characters before)."""
    opened = list(opened)
    for row in sorted(table.select(["ordinal", "level", "title", "chars"]).to_pylist(), key=lambda r: r["ordinal"]):
        ended = []
        if row["level"] is not None:
            while opened and opened[-1]["level"] >= row["level"]:
                ended.append(opened.pop())
            opened.append({"level": row["level"], "ordinal": row["ordinal"], "title": row["title"], "nodes": nodes, "chars": chars})
        yield row, opened, ended, nodes, chars
        nodes, chars = nodes + 1, chars + (row["chars"] or 0)


def _effect(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What a part does: the least level of its headings (ended are all open ones of that level and below), the headings it leaves open, its nodes and characters."""
    opened, levels = [], [x for x in table["level"].to_pylist() if x is not None]
    for _, opened, _, _, _ in _walk(table, [], 0, 0):  # noqa: B007  the last is what is left
        pass
    size = sum(x or 0 for x in table["chars"].to_pylist())
    return pa.table({"doc": pa.array([key[0].as_py()], table["doc"].type), "part": pa.array([key[1].as_py()], pa.int64()), "least": pa.array([min(levels, default=None)], pa.int32()), "opened": pa.array([opened], _OPEN), "nodes": pa.array([table.num_rows], pa.int64()), "chars": pa.array([size], pa.int64())})


def _carry(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """From the effects of a document's parts in order: what each part begins with, and which is the last."""
    opened, nodes, chars, out = [], 0, 0, []
    parts = sorted(table.select(["part", "least", "opened", "nodes", "chars"]).to_pylist(), key=lambda r: r["part"])
    for i, p in enumerate(parts):
        out.append((p["part"], opened, nodes, chars, i + 1 == len(parts)))
        kept = opened if p["least"] is None else [h for h in opened if h["level"] < p["least"]]
        opened = kept + [h | {"nodes": h["nodes"] + nodes, "chars": h["chars"] + chars} for h in p["opened"]]
        nodes, chars = nodes + p["nodes"], chars + p["chars"]
    columns = list(zip(*out, strict=True))
    kinds = (pa.int64(), _OPEN, pa.int64(), pa.int64(), pa.bool_())
    return pa.table({"doc": pa.array([key[0].as_py()] * len(out), table["doc"].type)} | {n: pa.array(list(c), t) for n, c, t in zip(("part", "opened", "nodes", "chars", "last"), columns, kinds, strict=True)})


def _parts(nodes: DataFrame, doc: str, ordinal: str, level: str, title: str, chars: str, part: int) -> tuple[DataFrame, DataFrame, str]:
    kind = dict(nodes.dtypes)[doc]
    rows = nodes.where(nodes[ordinal].isNotNull()).select(nodes[doc].alias("doc"), nodes[ordinal].cast("long").alias("ordinal"), nodes[level].cast("int").alias("level"), nodes[title].cast("string").alias("title"), nodes[chars].cast("long").alias("chars"))
    rows = rows.withColumn("part", F.floor(F.col("ordinal") / part))
    # a document of one part begins with nothing open: only the others have effects to combine
    long = rows.where("part > 0").select(F.col("doc").alias("doc_")).distinct()
    several = rows.join(long, F.col("doc").eqNullSafe(F.col("doc_")), "left_semi")
    effects = several.groupBy("doc", "part").applyInArrow(_effect, f"doc {kind}, part bigint, least int, opened {OPEN}, nodes bigint, chars bigint")
    carried = effects.groupBy("doc").applyInArrow(_carry, f"doc {kind}, part bigint, opened {OPEN}, nodes bigint, chars bigint, last boolean")
    return rows, written(carried.select(F.col("doc").alias("doc_"), F.col("part").alias("part_"), "opened", "nodes", "chars", "last")), kind


def _begin(carried: pa.Table) -> dict:
    return carried.to_pylist()[0] if carried.num_rows else {"opened": [], "nodes": 0, "chars": 0, "last": True}


def heading_paths(nodes: DataFrame, doc: str, ordinal: str, level: str, title: str, chars: str, part: int | None = None) -> DataFrame:
    """doc, ordinal, path (ordinals of the headings a node stands under, its own included), titles.

    A null level is no heading; levels are any whole numbers, smaller ones above. Nodes of a
    null ordinal are left out; ordinals of a document are unlike each other.
    """
    rows, carried, kind = _parts(nodes, doc, ordinal, level, title, chars, part or PART)

    def run(key, table: pa.Table, start: pa.Table) -> pa.Table:
        s = _begin(start)
        out = [(row["ordinal"], [h["ordinal"] for h in opened], [h["title"] for h in opened]) for row, opened, _, _, _ in _walk(table, s["opened"], s["nodes"], s["chars"])]
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
        return pa.table({"doc": pa.array([key[0].as_py()] * len(out), table["doc"].type)} | {n: pa.array(list(c), t) for n, c, t in zip(("ordinal", "path", "titles"), columns, kinds, strict=True)})

    out = rows.groupBy("doc", "part").cogroup(carried.groupBy("doc_", "part_")).applyInArrow(run, f"doc {kind}, ordinal bigint, path array<bigint>, titles array<string>")
    return out.select(F.col("doc").alias(doc), F.col("ordinal").alias(ordinal), "path", "titles")


def sections(nodes: DataFrame, doc: str, ordinal: str, level: str, title: str, chars: str, part: int | None = None) -> DataFrame:
    """doc, start (the heading's ordinal), level, title, n_nodes and n_chars of each section, those within it included.

    A section is written by the part that ends it, the last ones of a document by its last part.
    """
    rows, carried, kind = _parts(nodes, doc, ordinal, level, title, chars, part or PART)

    def run(key, table: pa.Table, start: pa.Table) -> pa.Table:
        s = _begin(start)
        done, opened, nodes, chars = [], s["opened"], s["nodes"], s["chars"]
        for row, opened, ended, nodes, chars in _walk(table, s["opened"], s["nodes"], s["chars"]):  # noqa: B007
            done += [(h, nodes, chars) for h in ended]
            last = row["chars"] or 0
        if s["last"]:
            done += [(h, nodes + 1, chars + last) for h in opened]
        data = [(h["ordinal"], h["level"], h["title"], n - h["nodes"], c - h["chars"]) for h, n, c in done]
        columns = list(zip(*data, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        return pa.table({"doc": pa.array([key[0].as_py()] * len(data), table["doc"].type)} | {n: pa.array(list(c), t) for n, c, t in zip(("start", "level", "title", "n_nodes", "n_chars"), columns, kinds, strict=True)})

    out = rows.groupBy("doc", "part").cogroup(carried.groupBy("doc_", "part_")).applyInArrow(run, f"doc {kind}, start bigint, level int, title string, n_nodes bigint, n_chars bigint")
    return out.withColumnRenamed("doc", doc)
