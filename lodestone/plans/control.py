"""Control-plane analytics: runs, stages, attempts, warnings, pages of listings, lifecycle.

The tables stand in for the control plane: customers submit orders (runs), line items are
stage attempts, events are the append-only log. Times are compared with a stated moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.session import table

from .catalog import query

#: The moment that stands for now.
AS_OF = "1998-08-01 00:00:00"
#: Stage of an attempt by line number, and the weight of each stage in a run's progress.
STAGES = ("hash", "validate", "parse", "normalize", "structure")
WEIGHTS = (10, 15, 25, 25, 25)

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'queued' ELSE 'running' END"
STAGE_SQL = "CASE l_linenumber % 5 WHEN 0 THEN 'hash' WHEN 1 THEN 'validate' WHEN 2 THEN 'parse' WHEN 3 THEN 'normalize' ELSE 'structure' END"


def stage(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in STAGES]), (c % 5 + 1).cast("int"))


@query(f"SELECT {STATUS} AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def runs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.expr(STATUS).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT 'ingestion-' || lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS queue, count(*)::BIGINT AS depth FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def queue_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = F.concat(F.lit("ingestion-"), F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "")))
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(queue.alias("queue")).groupBy("queue").agg(F.count("*").alias("depth"))


@query(f"SELECT {STAGE_SQL} AS stage, count(*)::BIGINT AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def stage_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(stage(F.col("l_linenumber")).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@query(f"""SELECT {STAGE_SQL} AS stage, trunc(avg(l_quantity * 100))::BIGINT AS avg_ms, count(*)::BIGINT AS samples
    FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1""")
def stage_duration_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean duration of finished attempts since a moment, cut to whole milliseconds."""
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' and l_shipdate >= timestamp '1995-01-01'")
    return done.groupBy(stage(F.col("l_linenumber")).alias("stage")).agg(F.avg(F.col("l_quantity") * 100).cast("long").alias("avg_ms"), F.count("*").alias("samples"))


@query("""SELECT o_orderpriority AS priority, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / nullif(count(*) FILTER (o_orderstatus IN ('F', 'P')), 0), 1)::DOUBLE AS error_rate
    FROM orders GROUP BY 1""")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of failures among finished runs, in percent; null where none is finished."""
    failed, finished = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus").isin("F", "P"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.try_divide(failed * 100.0, F.nullif(finished, F.lit(0))), 1).cast("double").alias("error_rate"))


@query(f"""WITH s AS (SELECT {STAGE_SQL} AS stage, ceil(avg(l_quantity))::BIGINT AS secs FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O')::BIGINT AS queued,
    CASE WHEN count(*) = 5 THEN ceil((SELECT count(*) FROM orders WHERE o_orderstatus = 'O') * sum(secs) / 4.0)::BIGINT END AS eta_seconds FROM s""")
def backlog_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds until the queue is empty with four workers; null unless every stage has samples."""
    each = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").groupBy(stage(F.col("l_linenumber"))).agg(F.ceil(F.avg("l_quantity")).alias("secs"))
    sums = each.agg(F.count("*").alias("stages"), F.sum("secs").alias("secs"))
    queued = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").agg(F.count("*").alias("queued"))
    eta = F.when(F.col("stages") == len(STAGES), F.ceil(F.col("queued") * F.col("secs") / 4.0).cast("long"))
    return queued.withColumn("one", F.lit(1)).join(sums.withColumn("one", F.lit(1)), "one").select("queued", eta.alias("eta_seconds"))


@query(f"""SELECT count(*) FILTER (l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)::BIGINT AS retries,
    count(*) FILTER (l_linestatus = 'F' AND l_shipdate >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY)::BIGINT AS completed,
    count(*) FILTER (l_linestatus = 'O' AND l_shipdate < TIMESTAMP '{AS_OF}')::BIGINT AS stale FROM lineitem""")
def rolling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several windows over one scan."""
    at, by = F.lit(AS_OF).cast("timestamp_ntz"), F.col("l_shipdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").agg(
        F.count_if((F.col("l_returnflag") == "R") & (by >= at - F.expr("interval 30 days"))).alias("retries"),
        F.count_if((F.col("l_linestatus") == "F") & (by >= at - F.expr("interval 90 days"))).alias("completed"),
        F.count_if((F.col("l_linestatus") == "O") & (by < at)).alias("stale"),
    )


@query("SELECT p_partkey, coalesce(n, 0)::BIGINT AS editions FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def editions_per_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n"))
    parts = table(spark, sf_dir, "part").select("p_partkey")
    return parts.join(n, parts.p_partkey == n.l_partkey, "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("editions"))


@query("""WITH e AS (SELECT *, (props->>'$.k')::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE (props->>'$.k')::INT < 50)
    SELECT user_id, event_type AS code, count(*)::BIGINT AS occurrences, arg_min(k, event_id)::INTEGER AS first_detail,
    array_to_string(list_sort(list_distinct(list(k)))[1:20], ',') AS details FROM e WHERE r <= 500 GROUP BY ALL""")
def warnings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of each run by code, over its first 500: count, first detail, distinct details capped at 20."""
    k = F.get_json_object("props", "$.k").cast("int")
    first = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", k.alias("k")).where("k < 50").withColumn("r", F.row_number().over(first)).where("r <= 500")
    details = F.array_join(F.slice(F.sort_array(F.collect_set("k")), 1, 20), ",")
    return e.groupBy("user_id", F.col("event_type").alias("code")).agg(F.count("*").alias("occurrences"), F.min_by("k", "event_id").alias("first_detail"), details.alias("details"))


@query("SELECT o_orderkey, coalesce(max(l_linenumber), 0)::INTEGER + 1 AS next_attempt FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def next_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(last, orders.o_orderkey == last.l_orderkey, "left").select("o_orderkey", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("next_attempt"))


@query(f"""WITH a AS (SELECT l_orderkey, {STAGE_SQL} AS stage, count(*)::BIGINT AS attempts, max(struct_pack(d := l_shipdate, q := l_quantity, p := l_partkey, s := l_linestatus)).s AS last FROM lineitem GROUP BY 1, 2),
    s AS (SELECT unnest(['hash', 'validate', 'parse', 'normalize', 'structure']) AS stage)
    SELECT o_orderkey, s.stage, coalesce(attempts, 0)::BIGINT AS attempts, CASE WHEN last IS NOT NULL THEN last WHEN o_orderstatus = 'F' THEN 'not_executed' ELSE 'pending' END AS outcome
    FROM orders CROSS JOIN s LEFT JOIN a ON a.l_orderkey = o_orderkey AND a.stage = s.stage""")
def pipeline_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage of every run: its attempts and the latest one's outcome."""
    key = F.struct("l_shipdate", "l_quantity", "l_partkey", "l_linestatus")
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), stage(F.col("l_linenumber")).alias("stage")).agg(F.count("*").alias("attempts"), F.max(key).alias("last"))
    runs = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.explode(F.array(*[F.lit(x) for x in STAGES])).alias("stage"))
    outcome = F.coalesce("last.l_linestatus", F.when(F.col("o_orderstatus") == "F", "not_executed").otherwise("pending"))
    return runs.join(a, ["o_orderkey", "stage"], "left").select("o_orderkey", "stage", F.coalesce("attempts", F.lit(0)).alias("attempts"), outcome.alias("outcome"))


@query("""SELECT source, count(*) FILTER (quality = 1)::BIGINT AS ready, count(*) FILTER (quality = 0)::BIGINT AS failed, count(*) FILTER (quality IS NULL)::BIGINT AS pending
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def generation_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("ready"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("quality").isNull()).alias("pending"))


@query(f"""WITH w AS (SELECT * FROM (VALUES ('hash', 10), ('validate', 15), ('parse', 25), ('normalize', 25), ('structure', 25)) t(stage, weight))
    SELECT l_orderkey AS o_orderkey, sum(weight)::BIGINT AS progress FROM (SELECT DISTINCT l_orderkey, {STAGE_SQL} AS stage FROM lineitem WHERE l_linestatus = 'F') JOIN w USING (stage) GROUP BY 1""")
def progress_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each run: the weights of the stages it has finished."""
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 5).alias("stage"), weight.alias("weight")).distinct()
    return done.groupBy("o_orderkey").agg(F.sum("weight").alias("progress"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC LIMIT 10")
def recent_failures_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate").orderBy(F.desc_nulls_first("o_orderdate"), F.desc("o_orderkey")).limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) // 2 FROM orders) ORDER BY o_orderkey DESC LIMIT 50")
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    cursor = (orders.agg(F.max("o_orderkey")).first()[0] or 0) // 2
    return orders.where(F.col("o_orderkey") < cursor).orderBy(F.desc("o_orderkey")).limit(50)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(50).limit(25)


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[\\p{P}\\p{S}]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title_key FROM part
    WHERE contains(trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[\\p{P}\\p{S}]+', ' ', 'g'), '\\s+', ' ', 'g')), 're')""")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.title_key(F.col("p_name")).alias("title_key")).where(F.col("title_key").contains("re"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_run_per_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer: an aggregate with map-side combining, not a window."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderkey", "o_orderstatus")).alias("m"))
    return last.select("o_custkey", "m.o_orderkey", "m.o_orderstatus")


@query("""SELECT c_custkey, CASE WHEN o_orderstatus IS NULL THEN 'submitted' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'approved' END AS status
    FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def submission_status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("s"))
    status = F.when(F.col("s").isNull(), "submitted").when(F.col("s") == "F", "failed").when(F.col("s") == "P", "processing").otherwise("approved")
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("SELECT l_orderkey, max(l_linenumber)::INTEGER AS attempt, CASE WHEN max(l_linenumber) <= 1 THEN 30 WHEN max(l_linenumber) = 2 THEN 120 ELSE 600 END::INTEGER AS wait_s, least(600, 30 * 2 ** (max(l_linenumber) - 1))::INTEGER AS index_wait_s FROM lineitem GROUP BY 1")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("int").alias("attempt"))
    return last.withColumn("wait_s", T.backoff_seconds(F.col("attempt"))).withColumn("index_wait_s", T.index_backoff_seconds(F.col("attempt")))




@query("""SELECT user_id, CASE max(CASE WHEN (props->>'$.k')::INT >= 95 THEN 3 WHEN (props->>'$.k')::INT >= 90 AND event_type = 'click' THEN 2 WHEN (props->>'$.k')::INT >= 80 THEN 1 ELSE 0 END)
    WHEN 3 THEN 'failed' WHEN 2 THEN 'needs_review' WHEN 1 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM events GROUP BY user_id, date_trunc('day', ts), event_type""")
def status_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest issue of a run decides: hard block, reviewable, warning, none."""
    k = F.get_json_object("props", "$.k").cast("int")
    rank = F.when(k >= 95, 3).when((k >= 90) & (F.col("event_type") == "click"), 2).when(k >= 80, 1).otherwise(0)
    worst = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.max(rank).alias("w"))
    return worst.select("user_id", F.element_at(F.array(*[F.lit(x) for x in ("passed", "passed_with_warnings", "needs_review", "failed")]), F.col("w") + 1).alias("status"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id)::BIGINT AS last_event, count(*)::BIGINT AS transitions FROM events GROUP BY 1""")
def run_state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each run by replaying its log: the last event decides."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("last_event"), F.count("*").alias("transitions"))


@query("""SELECT user_id, max(ts) AS heartbeat FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 23:30:00' AND arg_max(event_type, event_id) <> 'purchase'""")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose heartbeat is older than half an hour at a stated moment, unless they ended."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("heartbeat"), F.max_by("event_type", "event_id").alias("state"))
    old = F.col("heartbeat").cast("timestamp_ntz") < F.lit("2024-01-30 23:30:00").cast("timestamp_ntz")
    return last.where(old & (F.col("state") != "purchase")).select("user_id", "heartbeat")


@query("""WITH s AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1)
    SELECT event_type, count(*)::BIGINT AS dropped FROM events JOIN s USING (user_id) WHERE event_id < last GROUP BY 1""")
def superseded_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that a later one of the same run supersedes: all but the last, by type."""
    e = table(spark, sf_dir, "events")
    every = e.groupBy("event_type").agg(F.count("*").alias("n"))
    last = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type")).groupBy("event_type").agg(F.count("*").alias("kept"))
    return every.join(last, "event_type", "left").select("event_type", (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped")).where("dropped > 0")


@query("""SELECT o_custkey, count(*)::BIGINT AS active FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1 HAVING count(*) > 1""")
def invariant_one_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with several active runs, where there should be one at most."""
    return table(spark, sf_dir, "orders").where("o_orderstatus in ('O', 'P')").groupBy("o_custkey").agg(F.count("*").alias("active")).where("active > 1")


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums: the batch form of streaming.rolling."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh, event_id FROM events),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, ended by two hours without an event."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.max("ts").cast("timestamp_ntz").alias("last_event"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "last_event", "n")
