"""Streams over the events table, run to their end, and structures of sources; with DuckDB SQL where rows are decided.

A stream's rows are written below the shared folder and read again.  What a watermark has not passed yet is not in them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.plans.lineage import shared_dir
from tallyward.plans.queries import query, stamp, table
from tallyward.sources import formats, sinks
from tallyward.streaming import events as ev


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def ended(stream: DataFrame) -> DataFrame:
    """The rows of a stream, read to the end of what is there."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    started = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


_CLOSED = "(SELECT max(ts) - INTERVAL 6 HOURS FROM events)"


@query(f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_tumbling(spark, d):
    return ended(ev.tumbling(event_stream(spark, d), "ts", "1 hour", "6 hours", "event_type")).select(stamp("window.start").alias("hour"), "event_type", "n")


@query(f"SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS hour FROM events, range(0, 6) AS r(k)) GROUP BY hour HAVING hour + INTERVAL 6 HOURS <= {_CLOSED}")
def stream_sliding(spark, d):
    return ended(ev.sliding(event_stream(spark, d))).select(stamp("window.start").alias("hour"), "n")


@query(f"WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begun, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOURS <= {_CLOSED}")
def stream_sessions(spark, d):
    return ended(ev.sessions(event_stream(spark, d), "user_id")).select("user_id", stamp("session_window.start").alias("begun"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    return ended(ev.first_seen(event_stream(spark, d), ["user_id", "event_type"], late="3650 days")).select("user_id", "event_type")


_SHA = "md5(CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR))"


@query(f"WITH e AS (SELECT user_id AS repo, event_type AS tag, {_SHA} AS sha, ts FROM events), f AS (SELECT repo, tag, arg_min(sha, (ts, sha)) AS first_sha FROM e GROUP BY ALL) SELECT repo, tag, first_sha, sha, count(*) AS n, first_sha <> sha AS moved FROM e JOIN f USING (repo, tag) GROUP BY ALL")
def stream_tag_sightings(spark, d):
    e = event_stream(spark, d).select(F.col("user_id").alias("repo"), F.col("event_type").alias("tag"), F.md5((F.floor("value").cast("long") % 3).cast("string")).alias("sha"), F.col("ts").alias("at"))
    return ended(ev.tag_sightings(e, "3650 days")).groupBy("repo", "tag", "first_sha", "sha", "moved").agg(F.count("*").alias("n"))


@query()
def state_recheck_stream(spark, d):
    """Waiting, rechecked, scanned and dropped users; the rows depend on how the stream is dealt into batches."""
    e = event_stream(spark, d).withColumn("ready", F.col("event_type") == "purchase")
    return ended(ev.recheck(e)).select("user_id", "state", "checks", "at")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def call_budget(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.within_budget(e, "user_id", "ts", 2, "1 hour", "event_id").select("event_id", "allowed")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 25 HOURS")
def resumed_events(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cursor = e.agg(F.max("ts").cast("string").alias("c")).select((F.col("c").cast("timestamp") - F.expr("interval 24 hours")).cast("string")).first()[0]
    return ev.resumed(e, "ts", cursor).select("event_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def upserted_state(spark, d):
    """The newest event of each user, kept in a table by three merges that write the touched buckets only."""
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("version"))
    for k in range(3):
        sinks.upsert_buckets(spark, path, e.filter(F.col("version.event_id") % 3 == k), ["user_id"], "version", buckets=8)
    return sinks.current_buckets(spark, path).select("user_id", "event_type")


# --- structures of sources -------------------------------------------------------------------------------------------

_SOURCES = ["x = input()\nos.system(x)\n", "import os, json\neval(\"1\")\nsubprocess.run(cmd)\n", "def broken(:\n", "from ..pkg import a\nx = int(input())\nexec(x)\n"]
_SIGNS = [(0, 2, "sink", "os.system CMD computed"), (0, 2, "taint", ""), (1, 1, "import", "json"), (1, 1, "import", "os"), (1, 2, "sink", "eval CODE"), (1, 3, "sink", "subprocess.run CMD computed"), (3, 1, "import", "..pkg"), (3, 3, "sink", "exec CODE computed")]


@query("SELECT 'f' || p_partkey || '.py' AS path, CAST(line_no AS BIGINT) AS line_no, sign, detail FROM part JOIN (VALUES " + ", ".join(map(str, _SIGNS)) + ") AS s(kind, line_no, sign, detail) ON p_partkey % 4 = kind")
def py_ast_sinks(spark, d):
    """Sinks, taint and imports of Python sources by their syntax trees; a source that does not parse has none."""
    k = F.col("p_partkey")
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (k % 4 + 1).cast("int"))
    return formats.read_code_signs(table(spark, d, "part").select(F.concat(F.lit("f"), k, F.lit(".py")).alias("path"), source.alias("text")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'document type' END AS refused, CASE WHEN p_partkey % 3 <> 1 THEN p_name END AS name FROM part")
def xml_packages(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 3 == 1, "<!DOCTYPE x [<!ENTITY a 'b'>]>").otherwise(""), F.lit("<package><name>"), "p_name", F.lit("</name></package>"))
    found = formats.xml_values(table(spark, d, "part").select(k.alias("p_partkey"), text.alias("text")), "/package/name/text()", "p_partkey")
    return found.select("p_partkey", "refused", F.try_element_at("values", F.lit(1)).alias("name"))


@query("SELECT source, count(*) AS results FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE contains(line, '@') AND regexp_matches(line, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+') GROUP BY source")
def sarif_reports(spark, d):
    """How many results the SARIF texts of each source's mail findings have, in all their parts."""
    from tallyward.operators import findings as fd

    found = fd.scan_lines(table(spark, d, "documents"), [r for r in fd.RULES if r.id == "S-MAIL"])
    texts = sinks.sarif(found, "tallyward", most=50).withColumn("n", F.size(F.from_json(F.get_json_object("sarif", "$.runs[0].results"), "array<struct<ruleId:string>>")))
    return texts.groupBy("source").agg(F.sum("n").alias("results"))
