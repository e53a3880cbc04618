"""Writers: reports, bundles and keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SARIF = "https://json.schemastore.org/sarif-2.1.0.json"


def write_json_report(findings: DataFrame, path: str) -> None:
    """A new folder of JSON lines; an existing one is never overwritten, and the committer makes it whole or nothing."""
    findings.write.mode("errorifexists").json(path)


#: Results in one SARIF text at most; a source with more gets several, each a run of its own.
SARIF_RESULTS = 5000


def sarif(findings: DataFrame, tool: str, by: str = "source", most: int = SARIF_RESULTS) -> DataFrame:
    """(by, part, sarif): SARIF 2.1 texts over (by, doc_id, line_no, rule, severity), each of about ``most`` results at
    most: a value of ``by`` with more findings is dealt into parts by document and line."""
    level = F.when(F.col("severity").isin("BLOCKER", "CRITICAL"), "error").when(F.col("severity") == "MAJOR", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("doc_id").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_no").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct("line_no", "doc_id", F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("rule").alias("text")).alias("message"), F.array(place).alias("locations")).alias("r"))
    parts = findings.groupBy(by).agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = findings.join(parts, by).withColumn("part", F.pmod(F.xxhash64("doc_id", "line_no", "rule"), F.col("parts")))
    grouped = dealt.groupBy(by, "part").agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.array_sort(F.collect_list(result)).alias("results"))
    driver = F.struct(F.lit(tool).alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("results", lambda x: x["r"]).alias("results"))
    return grouped.select(by, "part", F.to_json(F.struct(F.lit(SARIF).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_rows(findings: DataFrame, *keep: str) -> DataFrame:
    """(row, and kept columns with the place): a table row for each finding with its text escaped."""
    cells = [F.concat(F.lit("<td>"), _escaped(F.col(c).cast("string")), F.lit("</td>")) for c in ("severity", "rule", "doc_id", "line_no", "line")]
    row = F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row")
    return findings.select(*keep, "doc_id", "line_no", row) if keep else findings.select(row)


def html_report(findings: DataFrame, title: str, path: str) -> None:
    """A new folder with a whole page: a head, the findings' rows in order of severity and place, and an end."""
    from tallyward.operators.findings import severity_order

    spark = findings.sparkSession
    ordered = findings.withColumn("o_", severity_order())
    body = html_rows(ordered.select("o_", "severity", "rule", "doc_id", "line_no", "line"), "o_")
    ends = spark.createDataFrame([(-1, f"<!doctype html><meta charset=utf-8><title>{title}</title><table>"), (99, "</table>")], "o_ long, row string")
    # One partition after another: each is sorted on its own and their names keep the order.
    body.unionByName(ends, allowMissingColumns=True).repartitionByRange("o_", "doc_id", "line_no").sortWithinPartitions("o_", "doc_id", "line_no").select("row").write.mode("errorifexists").text(path)


def terminal_rows(findings: DataFrame) -> DataFrame:
    """(doc_id, line_no, row): a line of plain text for each finding, with control characters replaced."""
    from tallyward.functions.text import terminal_safe

    row = F.format_string("%-8s %s:%d %s  %s", "severity", F.col("doc_id").cast("string"), "line_no", "rule", terminal_safe(F.substring("line", 1, 120)))
    return findings.select("doc_id", "line_no", row.alias("row"))


def write_bundle(affected: DataFrame, path: str) -> None:
    """Advisories in folders by ecosystem, sorted by name within files, so that a lookup prunes folders and row groups."""
    affected.repartition("ecosystem", "name_key").sortWithinPartitions("ecosystem", "name_key").write.mode("errorifexists").partitionBy("ecosystem").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key of both; new rows win among equal versions."""
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("new_"))
    return both.withColumn("rn_", F.row_number().over(w)).filter("rn_ = 1").drop("rn_", "new_")


def upsert_buckets(spark, path: str, new: DataFrame, keys: list[str], version: str, buckets: int = 64) -> int:
    """Merges rows into a table of files by bucket of the key; returns how many buckets were written.

    Only buckets that new rows fall in are read and written again, under a new generation; the newest generation of a
    bucket is the table's.  A bucket's folder appears whole or not at all.
    """
    from pyspark.sql.utils import AnalysisException

    number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = new.withColumn("bucket_", number)
    touched = sorted(r[0] for r in new.select("bucket_").distinct().collect())
    try:
        old = current_buckets(spark, path)
    except AnalysisException:
        old = None
    generation = 0 if old is None else old.agg(F.max("gen_")).first()[0] + 1
    mine = new if old is None else upserted(old.filter(F.col("bucket_").isin(touched)).drop("gen_"), new, keys, version)
    mine = mine if old is not None else upserted(new.limit(0), new, keys, version)
    mine.repartition("bucket_").write.mode("errorifexists").partitionBy("bucket_").parquet(f"{path}/gen_={generation}")
    return len(touched)


def current_buckets(spark, path: str) -> DataFrame:
    """The rows of a table kept by upsert_buckets: of each bucket those of its newest generation."""
    every = spark.read.option("basePath", path).parquet(f"{path}/gen_=*")
    newest = every.groupBy("bucket_").agg(F.max("gen_").alias("gen_"))
    return every.join(F.broadcast(newest), ["bucket_", "gen_"], "left_semi")  # a row for each bucket


def write_database(df: DataFrame, url: str, name: str, batch: int = 10_000, **properties: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=batch, **properties).mode("append").save()
