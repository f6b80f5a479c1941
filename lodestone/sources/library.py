"""File discovery, node files and content-addressed paths."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One node of a document, as node files hold it.
NODE = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("spine_index", T.IntegerType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("heading_path", T.ArrayType(T.StringType())),
        T.StructField("linear", T.BooleanType()),
        T.StructField("has_image", T.BooleanType()),
    ]
)

# The kinds of node that belong to the text of a document.
CORPUS_TYPES = ("heading", "paragraph", "blockquote", "list_item", "code", "table", "caption", "footnote", "figure")


def discover(spark: SparkSession, root: str, suffix: str = ".epub") -> DataFrame:
    """Files below root whose name ends in suffix, any case: path, relative, length, modified.

    Only the listing is read, not the contents.
    """
    pattern = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").lstrip("/").replace(".", r"\.") + "/", "")
    return files.select("path", relative.alias("relative"), "length", F.col("modificationTime").alias("modified"))


def after_cursor(files: DataFrame, cursor: str | None) -> DataFrame:
    """Files past a resume cursor, compared segment by segment."""
    if cursor is None:
        return files
    return files.where(F.split("relative", "/") > F.array(*[F.lit(x) for x in cursor.split("/")]))


def path_hints(relative: Column) -> tuple[Column, Column]:
    """Author and title from a path of three segments or more: its first and second."""
    parts = F.split(relative, "/")
    deep = F.size(parts) >= 3
    return F.when(deep, parts[0]).alias("author_hint"), F.when(deep, parts[1]).alias("title_hint")


def shard_path(sha: Column) -> Column:
    """Where content of a hash is stored: two levels of two characters, then the hash."""
    return F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha)


def fresh(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Insert-or-ignore: rows whose key isn't known, once each."""
    return found.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node files (one JSON object a line) with a fixed schema; order is in the columns."""
    return spark.read.schema(NODE).json(path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(path)


def in_corpus() -> Column:
    """Whether a node belongs to the text that is fingerprinted and searched."""
    image = (F.col("type") == "figure") & F.coalesce("has_image", F.lit(False))
    return F.coalesce("linear", F.lit(True)) & F.col("type").isin(*CORPUS_TYPES) & ~image


def fingerprints(nodes: DataFrame, asset: str) -> DataFrame:
    """The content fingerprint of each asset: the hash of its corpus nodes' texts in order."""
    kept = nodes.where(in_corpus()).groupBy(asset).agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("n"))
    return kept.select(asset, F.sha2(F.array_join(F.transform("n", lambda x: x["text"]), "\n"), 256).alias("fingerprint"))


def replace_assets(fresh: DataFrame, path: str, asset: str = "asset", buckets: int = 64) -> None:
    """Chunk rows of some assets in place of all that were stored of them, in this generation; others stay.

    Rows lie by generation and a hash of the asset. Only folders that hold an asset of `fresh`
    are written anew; a second run with the same rows changes nothing. Assets without rows
    are not touched. `fresh` has columns generation and asset, and the same others as before.
    """
    spark = fresh.sparkSession
    keyed = fresh.withColumn("bucket", F.pmod(F.xxhash64(asset), F.lit(buckets)))
    keys = ["generation", "bucket", asset]
    try:
        stored = spark.read.schema(keyed.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = keyed
    else:
        new = keyed.select(*keys).distinct()
        kept = stored.join(new.select("generation", "bucket").distinct(), ["generation", "bucket"], "left_semi").join(new, keys, "left_anti")
        rows = kept.unionByName(keyed)
    # salted, so that a large folder is written by several tasks
    salt = F.pmod(F.xxhash64(*[c for c in keyed.columns if c not in keys]), F.lit(8))
    rows.repartition("generation", "bucket", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation", "bucket").parquet(path)
