"""Rules on lines and texts, and the algebra of their findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.text import lines

SEVERITIES = ["BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO"]


@dataclass(frozen=True)
class Rule:
    """A pattern on a line; ``gate`` is a literal that every match holds (a cheap test before the pattern)."""

    id: str
    type: str
    severity: str
    pattern: str
    gate: str = ""
    need: str = ""
    skip: str = ""
    langs: tuple[str, ...] = ()


#: Our own rule values; patterns keep to what Java and RE2 read alike.
RULES = [
    Rule("S-SECRET", "VULN", "BLOCKER", r'(token|api_key|password|secret) = "[0-9A-Za-z_-]{8,}', ' = "'),
    Rule("S-AWS", "VULN", "BLOCKER", r"AKIA[0-9A-Z]{16}", "AKIA"),
    Rule("S-MAIL", "HOTSPOT", "MAJOR", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "@"),
    Rule("S-IP", "HOTSPOT", "MINOR", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    Rule("S-CARD", "VULN", "CRITICAL", r"\b[0-9]{16}\b"),
    Rule("S-PHONE", "HOTSPOT", "MINOR", r"\+[0-9]{1,2} \(?[0-9]{3}\)?", "+"),
    Rule("Q-LICENSE", "SMELL", "INFO", r"Licensed under|Released under|All rights reserved"),
    Rule("Q-SHOUT", "SMELL", "MINOR", r"[A-Z]{4,}!!", "!!"),
    Rule("Q-TABLE", "SMELL", "INFO", r" \| [^|]+ \| ", " | "),
    Rule("B-NOISE", "BUG", "MINOR", r"[%&$#*]{3}"),
]


def matches(rule: Rule, line: Column, lang: Column | None = None) -> Column:
    hit = line.rlike(rule.pattern)
    if rule.gate:
        hit = line.contains(rule.gate) & hit
    if rule.need:
        hit = hit & line.rlike(rule.need)
    if rule.skip:
        hit = hit & ~line.rlike(rule.skip)
    return hit & lang.isin(*rule.langs) if rule.langs and lang is not None else hit


def scan_lines(docs: DataFrame, rules: list[Rule] = RULES, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """(kept columns, line_no, line, rule, type, severity): one pass over the texts, all rules at once.

    A rule is first tried on the whole text, by its literal alone where it has one, so most texts lose most rules before
    their lines are made; lines are tested in the row, and only hits are exploded.
    """
    text = F.col("text")
    tried = [F.coalesce(text.contains(r.gate) if r.gate else text.rlike(r.pattern), F.lit(False)) for r in rules]
    some = docs.select(*keep, "text", F.array(*tried).alias("tried")).filter(F.exists("tried", lambda x: x))
    hit = lambda line: F.array_compact(F.array(*[F.when(F.element_at(F.col("tried"), n + 1) & matches(r, line), F.lit(n)) for n, r in enumerate(rules)]))
    tested = F.transform(F.split("text", "\n"), lambda line, k: F.transform(hit(line), lambda n: F.struct((k + 1).cast("long").alias("line_no"), line.alias("line"), n.alias("n"))))
    hits = some.select(*keep, F.explode(F.flatten(tested)).alias("h"))
    named = lambda of: F.element_at(F.array(*[F.lit(getattr(r, of)) for r in rules]), F.col("h.n") + 1)
    return hits.select(*keep, "h.line_no", "h.line", named("id").alias("rule"), named("type").alias("type"), named("severity").alias("severity"))


def scan_whole_text(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, n): how often a pattern occurs in a text, where it does."""
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).cast("long").alias("n")).filter("n > 0")


def severity_order(column: str = "severity") -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(column)).cast("long")


def dedupe(findings: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row by ``seq`` of each key."""
    return findings.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).filter("rn_ = 1").drop("rn_")


def cap(findings: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key by order; ``omitted`` on the last one says how many more there were.

    Counts are aggregated on their own: a row number alone lets each task drop what is beyond the limit before the
    shuffle, so a key with very many findings is never sorted whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = findings.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= most)
    over = findings.groupBy(*keys).agg(F.count("*").alias("n_")).filter(F.col("n_") > most)
    return first.join(over, keys, "left").withColumn("omitted", F.when((F.col("place") == most) & F.col("n_").isNotNull(), F.col("n_") - most).otherwise(0)).drop("n_")


def capped(findings: DataFrame, keys: list[str], rule: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` findings of each key and rule, and a row of rule Q-CAPPED for each that had more.

    A summary row has the rule it stands for in ``of`` and how many are left out in ``omitted``; other rows have neither.
    """
    w = Window.partitionBy(*keys, rule).orderBy(*order)
    first = findings.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= most).drop("n_").withColumns({"of": F.lit(None).cast("string"), "omitted": F.lit(0).cast("long")})
    over = findings.groupBy(*keys, rule).agg(F.count("*").alias("n_")).filter(F.col("n_") > most)
    summary = over.select(*keys, F.lit("Q-CAPPED").alias(rule), F.col(rule).alias("of"), (F.col("n_") - most).alias("omitted"))
    return first.unionByName(summary, allowMissingColumns=True)


def suppress(findings: DataFrame, all_lines: DataFrame, marker: str, keys: list[str], never: str = r"^(SC|X)-") -> DataFrame:
    """Without findings whose line or the one above holds the marker; those of ``never`` rules stay."""
    marked = all_lines.filter(F.col("line").contains(marker)).select(*keys, F.explode(F.array("line_no", F.col("line_no") + 1)).alias("line_no")).distinct()
    return findings.filter(F.col("rule").rlike(never)).unionByName(findings.filter(~F.col("rule").rlike(never)).join(marked, [*keys, "line_no"], "left_anti"))


def demote(findings: DataFrame, path: Column, reachable: DataFrame, key: str) -> DataFrame:
    """Severity INFO for findings in test paths that nothing reaches."""
    reached = reachable.select(key).distinct().withColumn("reached_", F.lit(True))
    test = path.rlike(r"(^|/)(tests?|docs|examples)(/|$)")
    return findings.join(reached, key, "left").withColumn("severity", F.when(test & F.col("reached_").isNull(), "INFO").otherwise(F.col("severity"))).drop("reached_")


def ranked(findings: DataFrame, n: int, *then: str) -> DataFrame:
    """The n first findings by severity, then by the given columns."""
    return findings.orderBy(severity_order(), *then).limit(n)


def shown(findings: DataFrame) -> DataFrame:
    """What a gate shows: SC- findings unless INFO, all X-, and VULN of MAJOR or more."""
    return findings.filter((F.col("rule").startswith("SC-") & (F.col("severity") != "INFO")) | F.col("rule").startswith("X-") | ((F.col("type") == "VULN") & (severity_order() <= 3)))
