"""Line metrics, duplication, ratings and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.text import lines
from tallyward.operators.findings import severity_order

TYPES = ["VULN", "HOTSPOT", "BUG", "SMELL"]
DUPLICATE_LINES = 6


def line_metrics(docs: DataFrame, comment: str = r"^\s*(#|//|--)", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, n_lines, ncloc, comments), in one row-wise pass: no line is exploded."""
    parts = F.split("text", "\n")
    code = F.filter(parts, lambda x: F.trim(x) != "")
    noted = F.filter(code, lambda x: x.rlike(comment))
    return docs.select("doc_id", *keep, F.size(parts).cast("long").alias("n_lines"), (F.size(code) - F.size(noted)).cast("long").alias("ncloc"), F.size(noted).cast("long").alias("comments"))


def duplication(docs: DataFrame, size: int = DUPLICATE_LINES) -> DataFrame:
    """(doc_id, measured, duplicated): lines that some window of ``size`` lines covers which occurs twice or more.

    Windows are made row-wise; only their digests are shuffled, and sums of them join back, so no window text moves.
    """
    kept = docs.select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("c")).withColumn("n", F.size("c"))
    starts = F.when(F.col("n") >= size, F.sequence(F.lit(1), F.col("n") - size + 1)).otherwise(F.array().cast("array<int>"))
    windows = kept.select("doc_id", "n", F.explode(F.transform(starts, lambda k: F.struct(k.alias("at"), F.md5(F.array_join(F.slice("c", k, F.lit(size)), "\n")).alias("h")))).alias("w")).select("doc_id", "n", "w.*")
    again = windows.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").select("h")
    covered = windows.join(again, "h", "left_semi").select("doc_id", F.explode(F.sequence(F.col("at"), F.col("at") + size - 1)).alias("line")).distinct().groupBy("doc_id").agg(F.count("*").alias("duplicated"))
    return kept.select("doc_id", F.col("n").cast("long").alias("measured")).join(covered, "doc_id", "left").select("doc_id", "measured", F.coalesce("duplicated", F.lit(0)).alias("duplicated"))


def type_counts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("type") == t).alias(f"n_{t.lower()}") for t in TYPES], F.min(F.when(F.col("type") == "VULN", severity_order())).alias("worst_vuln"), F.min(F.when(F.col("type") == "BUG", severity_order())).alias("worst_bug"))


def rating(worst: str) -> F.Column:
    """E for a blocker down to A for nothing worse than INFO."""
    return F.when(F.col(worst) == 1, "E").when(F.col(worst) == 2, "D").when(F.col(worst) == 3, "C").when(F.col(worst) == 4, "B").otherwise("A")


def grade(findings: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Counts, ratings and the gate's conditions for each key of ``metrics`` (key, ncloc)."""
    counts = type_counts(findings, key)
    sized = metrics.groupBy(key).agg(F.sum("ncloc").alias("ncloc"))
    g = sized.join(counts, key, "left").na.fill(0, [f"n_{t.lower()}" for t in TYPES])
    per_hundred = F.when(F.col("ncloc") > 0, F.col("n_smell") * 100 / F.col("ncloc")).otherwise(0.0)
    g = g.withColumns({"security": rating("worst_vuln"), "reliability": rating("worst_bug"), "maintainability": F.when(per_hundred <= 5, "A").when(per_hundred <= 10, "B").when(per_hundred <= 20, "C").when(per_hundred <= 40, "D").otherwise("E")})
    return g.withColumn("gate", F.col("security").isin("A", "B") & F.col("reliability").isin("A", "B", "C") & F.col("maintainability").isin("A", "B", "C")).drop("worst_vuln", "worst_bug")


def gate(findings: DataFrame, metrics: DataFrame, copies: DataFrame, key: str, supply_chain: str) -> DataFrame:
    """The six conditions of the full gate for each key of metrics (key, ncloc), and whether all hold.

    No vulnerability of MAJOR or more, no bug of CRITICAL or more, at most 20 smells for 100 lines, less than a tenth of the
    lines duplicated (copies: key, measured, duplicated), no hotspot of CRITICAL or more, no blocker of the supply chain.
    """
    worst = lambda kind: F.min(F.when(F.col("type") == kind, severity_order()))
    high = F.col("severity").isin("BLOCKER", "CRITICAL")
    counts = findings.groupBy(key).agg(worst("VULN").alias("vuln"), worst("BUG").alias("bug"), F.count_if(F.col("type") == "SMELL").alias("smells"), F.count_if((F.col("type") == "HOTSPOT") & high).alias("hot"), F.count_if(F.col("rule").rlike(supply_chain) & (F.col("severity") == "BLOCKER")).alias("chain"))
    sized = metrics.groupBy(key).agg(F.sum("ncloc").alias("ncloc"))
    doubled = copies.groupBy(key).agg(F.sum("measured").alias("measured"), F.sum("duplicated").alias("duplicated"))
    g = sized.join(counts, key, "left").join(doubled, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    conditions = {
        "secure": F.coalesce(F.col("vuln"), F.lit(6)) > 3, "reliable": F.coalesce(F.col("bug"), F.lit(6)) > 2, "maintainable": zero("smells") * 100 <= 20 * F.col("ncloc"),
        "unduplicated": F.col("duplicated") * 10 < F.col("measured"), "reviewed": zero("hot") == 0, "chain_clean": zero("chain") == 0,
    }
    named = g.select(key, *[c.alias(n) for n, c in conditions.items()])
    return named.withColumn("passed", F.forall(F.array(*conditions), lambda x: x))


def maintainability(findings: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """(key, smells, rating): smells for 100 lines, A to E at 5, 10, 20 and 40; what a cap left out counts (``omitted``)."""
    smells = findings.groupBy(key).agg(F.sum(F.when(F.col("type") == "SMELL", 1).otherwise(0) + F.coalesce("omitted", F.lit(0))).alias("smells"))
    g = metrics.groupBy(key).agg(F.sum("ncloc").alias("ncloc")).join(smells, key, "left").withColumn("smells", F.coalesce("smells", F.lit(0)))
    share = F.when(F.col("ncloc") > 0, F.col("smells") * 100 / F.col("ncloc")).otherwise(0.0)
    rated = F.when(share <= 5, "A").when(share <= 10, "B").when(share <= 20, "C").when(share <= 40, "D").otherwise("E")
    return g.select(key, "smells", rated.alias("rating"))


def per_file_counts(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return findings.groupBy(key).agg(F.count("*").alias("n"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("rule", F.lit(1))))).alias("rules"))


def share_of(df: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Counts by keys and their percentage within the counts of fewer keys."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(*within)), 6))


def duplicate_share(docs: DataFrame) -> DataFrame:
    d = duplication(docs).agg(F.sum("measured").alias("measured"), F.sum("duplicated").alias("duplicated"))
    return d.withColumn("percent", F.round(100 * F.col("duplicated") / F.col("measured"), 6))


def document_lines(docs: DataFrame) -> DataFrame:
    return lines(docs.select("doc_id", "text"))
