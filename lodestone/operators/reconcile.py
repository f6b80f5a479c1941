"""Reconciliation in arrival order: each asset joins an edition that earlier assets made, or makes one.

An asset sees only what came before it. It adopts the edition of an earlier asset of the same
content if title, creators and language agree and nothing conflicts; else the first of its
identifiers that an earlier asset has names one edition, which it joins if the title agrees
and nothing conflicts; else it founds a provisional work and edition. Nothing is merged
later, and no two editions become one through a third record.

It is done in rounds. All members of an edition have its founder's title, so assets wait for
each other only within a title: a round decides every asset whose answer can no longer
change, whatever the ones still open turn out to be. The result is that of one asset after
another, for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evidence
from lodestone.session import written

TWIN, LINKED, FOUNDED = "content_fingerprint_with_bibliographic_agreement", "identifier_and_title", "provisional_creation"
CONFIDENCE = {TWIN: "high_confidence", LINKED: "high_confidence", FOUNDED: "unresolved"}
DIMENSIONS = ("title", "creator", "language", "identifier", "publisher", "year")
_KEPT = ("title", "creators", "language", "publisher", "year", "identifiers")


def _dimensions(a: str, b: str) -> dict[str, Column]:
    same = lambda x: evidence.equal_dimension(F.col(f"{a}.{x}"), F.col(f"{b}.{x}"))
    lists = lambda x: evidence.overlap_dimension(F.col(f"{a}.{x}"), F.col(f"{b}.{x}"))
    return {"title": same("title"), "creator": lists("creators"), "language": same("language"), "identifier": lists("identifiers"), "publisher": same("publisher"), "year": same("year")}


def _clear(a: str, b: str, agree: tuple[str, ...]) -> Column:
    """Whether these dimensions agree and none conflicts."""
    d = _dimensions(a, b)
    out = ~evidence.any_conflict(*d.values())
    for name in agree:
        out = out & (d[name] == evidence.AGREE)
    return out


def _named(assets: DataFrame) -> DataFrame:
    """id and target: the first asset that has the first of an asset's identifiers which an earlier one has."""
    each = assets.select("id", F.posexplode("record.identifiers").alias("at", "identifier")).where("identifier IS NOT NULL")
    first = each.groupBy("identifier").agg(F.min("id").alias("target"))
    return each.join(first, "identifier").where("target < id").groupBy("id").agg(F.min(F.struct("at", "target"))["target"].alias("target"))


def reconcile(assets: DataFrame) -> tuple[DataFrame, int]:
    """id, edition (its founder's id), method, confidence, conflicts_with (an edition named by an identifier that was not joined); and the rounds it took.

    assets: id (whole numbers in order of arrival, no two alike), content (a hash), title,
    creators, language, publisher, year, identifiers (canonical ones, in order). Null or empty
    values are absent and agree with nothing. Assets of a null id are left out. An edition's
    record is its founder's; identifiers that members bring name it, but don't change it.
    """
    cleaned = assets.where("id IS NOT NULL").select("id", "content", F.struct(*(F.nullif(F.col(c), F.lit("")).alias(c) if c == "title" else F.col(c) for c in _KEPT)).alias("record"))
    cleaned = written(cleaned)
    records = cleaned.select("id", "record")
    titles = cleaned.select(F.col("id").alias("target"), F.col("record.title").alias("target_title"))
    target = _named(cleaned).join(titles, "target", "left")
    grouped = F.col("content").isNotNull() & F.col("record.title").isNotNull()
    can_adopt = grouped & (F.size("record.creators") > 0) & F.col("record.language").isNotNull()
    left = cleaned.join(target, "id", "left").select(
        "id", "record", "target", F.coalesce(F.col("target_title") == F.col("record.title"), F.lit(False)).alias("may_join"),
        F.when(grouped, F.struct("content", F.col("record.title").alias("title"))).alias("key"), F.coalesce(can_adopt, F.lit(False)).alias("may_adopt"),
    )
    left = written(left)
    kind = dict(left.dtypes)["id"]
    decided = left.where("false").select("id", "key", "target", F.col("id").alias("edition"), F.lit("").alias("method"))
    settled_before = left.where("key IS NOT NULL").groupBy("key").agg(F.lit(None).cast(kind).alias("before")).where("false")
    rounds = 0
    while not left.isEmpty():
        rounds += 1
        front = left.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("front"))
        # editions in order of their first member: those before the first open asset stay in that order
        editions = decided.where("key IS NOT NULL").groupBy("key", "edition").agg(F.min("id").alias("member"))
        editions = editions.join(front, "key").join(settled_before, "key", "left")
        fresh = editions.where("member < front AND (before IS NULL OR member >= before)").select("key", "edition", "member")
        founders = records.select(F.col("id").alias("edition"), F.col("record").alias("founder"))
        met = left.where("may_adopt").join(fresh, "key").where("member < id").join(founders, "edition")
        adopted = met.where(_clear("record", "founder", ("title", "creator", "language"))).groupBy("id").agg(F.min(F.struct("member", "edition"))["edition"].alias("edition"))
        adopted = written(adopted.select("id", "edition", F.lit(TWIN).alias("method")))
        rest = left.join(adopted, "id", "left_anti").join(front, "key", "left")
        free = rest.where(~F.col("may_adopt") | (F.col("id") == F.col("front")))
        known = decided.select(F.col("id").alias("target"), F.col("edition"))
        asking = free.where("may_join").join(known, "target").join(founders, "edition")
        joined = F.when(_clear("record", "founder", ("title",)), F.struct("edition", F.lit(LINKED).alias("method"))).otherwise(F.struct(F.col("id").alias("edition"), F.lit(FOUNDED).alias("method")))
        asked = asking.select("id", joined.alias("x")).select("id", "x.edition", "x.method")
        founding = free.where("NOT may_join").select("id", F.col("id").alias("edition"), F.lit(FOUNDED).alias("method"))
        new = written(adopted.unionByName(asked).unionByName(founding))
        settled_before = written(front.select("key", F.col("front").alias("before")))
        decided = written(decided.unionByName(left.join(new, "id").select("id", "key", "target", "edition", "method")))
        left = written(left.join(new, "id", "left_anti"))
    named = decided.select(F.col("id").alias("target"), F.col("edition").alias("named"))
    out = decided.join(named, "target", "left").select(
        "id", "edition", "method", F.when(F.col("method") == FOUNDED, "unresolved").otherwise("high_confidence").alias("confidence"),
        F.when(F.col("method") == FOUNDED, F.col("named")).alias("conflicts_with"),
    )
    return out, rounds


def provisional(assets: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The works and editions that were founded, and their credits: ids follow from the founder, so that a second run makes the same."""
    founded = decided.where(F.col("method") == FOUNDED).select("id").join(assets, "id")
    name = lambda what: F.sha2(F.concat(F.lit(f"{what}:"), F.col("id").cast("string")), 256)
    rows = founded.withColumn("edition_id", name("edition")).withColumn("work_id", name("work"))
    editions = rows.select("edition_id", "work_id", "id", "title", "language", "publisher", "year", F.lit("provisional").alias("status"))
    credits = rows.select("edition_id", F.posexplode("creators").alias("position", "name"))
    return editions, credits.where("trim(name) <> ''").withColumn("contributor_id", F.sha2(F.concat_ws(":", "edition_id", F.col("position").cast("string")), 256))
