"""Matching an inventory with advisories, and merging advisory feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.cvss import label_rank
from tallyward.functions.versions import keyed, unbounded, within
from tallyward.operators.graph import connected_components

#: Kinds of advisory ids from the preferred one on.
ID_ORDER = ["CVE", "GHSA", "PYSEC", "MAL", "GO", "RUSTSEC"]


def match_inventory(inventory: DataFrame, affected: DataFrame) -> DataFrame:
    """(cve, ecosystem, name, version, verdict): AFFECTED, UNKNOWN or CLEAR, the strongest of all ranges.

    inventory (ecosystem, name_key, name, version); affected (cve, ecosystem, name_key, low_version, low_included,
    high_version, high_included), a row for each range; an open bound is null, "" or "*".  A range that is open on both
    sides affects any version, also an unknown one.  A version or a bound that can't be compared is UNKNOWN, never
    CLEAR.  Keys are made before the join, once for each side; rows of one advisory for several spellings of a name meet
    in the aggregation, so the result does not depend on the order of rows.
    """
    have = inventory.select("ecosystem", "name_key", "name", "version", keyed(F.col("version")).alias("v"))
    ranges = affected.select("cve", "ecosystem", "name_key", "low_included", "high_included", keyed(F.coalesce("low_version", F.lit("*"))).alias("low"), keyed(F.coalesce("high_version", F.lit("*"))).alias("high"))
    joined = have.join(ranges, ["ecosystem", "name_key"])
    every = unbounded(F.col("low.text")) & unbounded(F.col("high.text"))
    hit = within(F.col("v"), F.col("ecosystem"), F.col("low"), F.col("low_included"), F.col("high"), F.col("high_included"))
    rank = F.when(every | hit, 2).when(hit.isNull(), 1).otherwise(0)
    best = joined.groupBy("cve", "ecosystem", "name", "version").agg(F.max(rank).alias("r"))
    return best.select("cve", "ecosystem", "name", "version", F.element_at(F.array(*map(F.lit, ("CLEAR", "UNKNOWN", "AFFECTED"))), F.col("r") + 1).alias("verdict"))


def advisories_for(inventory: DataFrame, exact: DataFrame, loose: DataFrame) -> DataFrame:
    """Distinct (name, cve) by exact or by loose key: two equi-joins and a union, never an OR in a join."""
    a = inventory.join(exact, ["ecosystem", "name_key"]).select("name", "cve")
    b = inventory.join(loose, "loose_key").select("name", "cve")
    return a.unionByName(b).distinct()


def fix_hint(matched: DataFrame, inventory: DataFrame, affected: DataFrame) -> DataFrame:
    """(cve, ecosystem, name, fixed_in): the highest excluded upper bound of an affected package's own ranges.

    Bounds are ordered by the first scheme of their ecosystem, or where it has no key for one by the other.
    """
    excluded = affected.filter(~F.col("high_included") & ~unbounded(F.col("high_version"))).select("cve", "ecosystem", "name_key", "high_version").distinct()
    v, eco = keyed(F.col("high_version")), F.col("ecosystem")
    first = F.when(eco.isin("npm", "go", "crates"), v["sem"]).otherwise(F.coalesce(v["pep"], v["sem"]))
    bounds = excluded.withColumn("key", first).filter("key is not null")
    named = inventory.select("ecosystem", "name_key", "name").distinct()
    hit = matched.filter("verdict = 'AFFECTED'").select("cve", "ecosystem", "name").distinct().join(named, ["ecosystem", "name"])
    return hit.join(bounds, ["cve", "ecosystem", "name_key"]).groupBy("cve", "ecosystem", "name").agg(F.max_by("high_version", F.struct("key", "high_version")).alias("fixed_in"))


def known_only(inventory: DataFrame) -> DataFrame:
    """Without rows of unknown version whose package has a known one."""
    known = inventory.filter("version is not null").select("ecosystem", "name").distinct()
    return inventory.filter("version is not null").unionByName(inventory.filter("version is null").join(known, ["ecosystem", "name"], "left_anti"))


def alias_components(edges: DataFrame) -> DataFrame:
    """(id, component) from pairs (id, alias)."""
    return connected_components(edges, "id", "alias").select(F.col("node").alias("id"), "component")


def merge_feeds(records: DataFrame, kev: DataFrame, epss: DataFrame, components: DataFrame) -> DataFrame:
    """One row for each component of records: best id, greatest score, earliest date, any KEV, greatest EPSS."""
    named = records.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rank = F.coalesce(*[F.when(F.col("label").startswith(k + "-"), F.lit(i)) for i, k in enumerate(ID_ORDER)], F.lit(len(ID_ORDER)))
    base = named.groupBy("component").agg(F.min_by("label", F.struct(rank, F.col("label"))).alias("best_id"), F.max("cvss").alias("cvss"), F.min("published").alias("published"), F.count("*").alias("n_records"))
    extra = named.select("component", "id").join(kev, "id", "left").join(epss, "id", "left").groupBy("component").agg(F.count_if(F.col("due").isNotNull()).alias("n_kev"), F.min("due").alias("due"), F.max("epss").alias("epss"))
    return base.join(extra, "component").withColumn("known_exploited", F.col("n_kev") > 0).drop("n_kev")


#: Ids, references and packages of a merged record at most, in their order.
MOST_IDS, MOST_REFERENCES, MOST_PACKAGES = 20, 10, 6


def merged_sets(records: DataFrame, components: DataFrame) -> DataFrame:
    """(component, label, ids, references, packages): the greatest severity label and capped unions of a component's sets.

    records: (id, label, ids, references, packages), the last three arrays.  Elements are made distinct before they are
    gathered, so a component with many records gathers its different elements only.
    """
    named = records.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    base = named.groupBy("component").agg(F.max_by("label", F.struct(label_rank(F.col("label")), F.col("label"))).alias("label"))
    for name, most in (("ids", MOST_IDS), ("references", MOST_REFERENCES), ("packages", MOST_PACKAGES)):
        items = named.select("component", F.explode(name).alias("x")).distinct()
        place = F.row_number().over(Window.partitionBy("component").orderBy("x"))
        first = items.withColumn("n", place).filter(F.col("n") <= most).groupBy("component").agg(F.array_sort(F.collect_list("x")).alias(name))
        base = base.join(first, "component", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return base


def intervals(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Events (kind introduced or fixed) folded to half-open intervals (from_at, to_at); to_at is null while open."""
    w = Window.partitionBy(*keys).orderBy(*order)
    turns = events.withColumn("last_", F.lag("kind").over(w)).filter("last_ is null and kind = 'introduced' or last_ != kind").drop("last_")
    # An interval that ends where it begins holds nothing.
    return turns.withColumn("to_at", F.lead("at").over(w)).filter("kind = 'introduced' and (to_at is null or to_at > at)").select(*keys, F.col("at").alias("from_at"), "to_at")


def uncovered(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, at) in none of the spans of their key."""
    s = spans.withColumnsRenamed({k: f"{k}_" for k in keys})
    inside = [points[k] == s[f"{k}_"] for k in keys] + [points["at"] >= s["from_at"], s["to_at"].isNull() | (points["at"] < s["to_at"])]
    return points.join(s, inside, "left_anti")
