"""Names: look-alikes, unused dependencies and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_TARGET, LONGEST_NAME = 5, 214


def neighbourhood(name: Column) -> Column:
    """The name and all names that lack one of its characters: two names within one edit share one of these."""
    places = F.sequence(F.lit(1), F.length(name))
    less = F.transform(places, lambda k: F.concat(F.substring(name, F.lit(1), k - 1), name.substr(k + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), less))


def swapped(a: Column, b: Column) -> Column:
    """b is a with two neighbouring characters swapped."""
    places = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    return (F.length(a) == F.length(b)) & F.exists(places, lambda k: F.concat(a.substr(F.lit(1), k - 1), a.substr(k + 1, F.lit(1)), a.substr(k, F.lit(1)), a.substr(k + 2, F.length(a))) == b)


def lookalikes(names: DataFrame, targets: DataFrame) -> DataFrame:
    """(name, target): names one edit (or swap) away from a target, the target of the best rank each.

    Blocking by deletion neighbourhoods makes it an equi-join; only names that share a neighbour are compared.
    """
    sized = names.filter(F.length("name").between(1, LONGEST_NAME)).select("name").distinct()
    a = sized.select("name", F.explode(neighbourhood(F.col("name"))).alias("key"))
    b = targets.filter(F.length("target") >= LEAST_TARGET).select("target", "rank", F.explode(neighbourhood(F.col("target"))).alias("key"))
    near = (F.levenshtein("name", "target", 1) == 1) | swapped(F.col("name"), F.col("target"))
    return a.join(b, "key").filter((F.col("name") != F.col("target")) & near).groupBy("name").agg(F.min_by("target", F.struct("rank", "target")).alias("target"))


def unused(declared: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    return declared.select(*keys).distinct().join(used.select(*keys).distinct(), keys, "left_anti")


#: Affixes that a distribution's name has and its module lacks, or the other way round.
PREFIXES, SUFFIXES = ("python-", "py-", "lib"), ("-python", "-py", "-js", "js")


def import_keys(name: Column) -> Column:
    """The forms under which a declared name may be imported: folded, with and without each affix."""
    folded = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    cut = [F.when(folded.startswith(p) & (F.length(folded) > len(p)), F.substring(folded, len(p) + 1, 10_000)) for p in PREFIXES]
    cut += [F.when(folded.endswith(x) & (F.length(folded) > len(x)), folded.substr(F.lit(1), F.length(folded) - len(x))) for x in SUFFIXES]
    return F.array_distinct(F.array_compact(F.array(folded, *cut)))


def unused_by_import(declared: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Declared (key, name) of which no form is among the imported (key, module)."""
    forms = declared.select(key, "name", F.explode(import_keys(F.col("name"))).alias("form"))
    have = imported.select(key, F.regexp_replace(F.lower("module"), "[^a-z0-9]+", "-").alias("form")).distinct()
    return declared.join(forms.join(have, [key, "form"]).select(key, "name").distinct(), [key, "name"], "left_anti")


def compare_runs(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Full outer join of (key, verdict, rules): what is new, gone, changed or the same, and which rules were gained."""
    a = before.select(key, F.col("verdict").alias("verdict_a"), F.col("rules").alias("rules_a"))
    b = after.select(key, F.col("verdict").alias("verdict_b"), F.col("rules").alias("rules_b"))
    j = a.join(b, key, "full_outer")
    state = F.when(F.col("verdict_a").isNull(), "new").when(F.col("verdict_b").isNull(), "gone").when(F.col("verdict_a") != F.col("verdict_b"), "changed").otherwise("same")
    return j.withColumn("state", state).withColumn("gained", F.size(F.array_except(F.coalesce("rules_b", F.array().cast("array<string>")), F.coalesce("rules_a", F.array().cast("array<string>")))).cast("long"))
