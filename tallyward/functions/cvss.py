"""CVSS 3.x base scores and severity labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the CVSS 3.1 specification.
WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "CIA": {"H": 0.56, "L": 0.22, "N": 0.0},
    "PR_U": {"N": 0.85, "L": 0.62, "H": 0.27},
    "PR_C": {"N": 0.85, "L": 0.68, "H": 0.5},
}


def _pick(value: Column, table: dict[str, float]) -> Column:
    chosen = F.lit(None).cast("double")
    for k, v in table.items():
        chosen = F.when(value == k, F.lit(v)).otherwise(chosen)
    return chosen


def base_score(vector: Column) -> Column:
    """The base score of a vector such as CVSS:3.1/AV:N/AC:L/...; null where it has another head than CVSS:3, lacks a
    metric, gives one twice, or has a scope other than U and C."""
    parts = F.split(vector, "/")
    get = lambda k: F.regexp_extract(vector, f"/{k}:([A-Z])(?:/|$)", 1)
    names = F.transform(parts, lambda x: F.substring_index(x, ":", 1))
    sound = vector.rlike("^CVSS:3[.][01]/") & (F.size(F.array_distinct(names)) == F.size(names)) & get("S").isin("U", "C")
    changed = get("S") == "C"
    c, i, a = (_pick(get(k), WEIGHTS["CIA"]) for k in "CIA")
    iss = 1 - (1 - c) * (1 - i) * (1 - a)
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    privileges = F.when(changed, _pick(get("PR"), WEIGHTS["PR_C"])).otherwise(_pick(get("PR"), WEIGHTS["PR_U"]))
    exploit = 8.22 * _pick(get("AV"), WEIGHTS["AV"]) * _pick(get("AC"), WEIGHTS["AC"]) * privileges * _pick(get("UI"), WEIGHTS["UI"])
    raw = F.least(F.when(changed, 1.08 * (impact + exploit)).otherwise(impact + exploit), F.lit(10.0))
    return F.when(~F.coalesce(sound, F.lit(False)) | iss.isNull() | exploit.isNull(), None).when(impact <= 0, 0.0).otherwise(roundup(raw))


def roundup(x: Column) -> Column:
    """The least number with one decimal place that is not below x (as the specification computes it)."""
    whole = F.round(x * 100_000).cast("long")
    return F.when(whole % 10_000 == 0, whole / 100_000).otherwise((F.floor(whole / 10_000) + 1) / 10)


#: Severity labels from the least to the greatest.
LABELS = ["LOW", "MODERATE", "HIGH", "CRITICAL"]


def label_rank(label: Column) -> Column:
    """1 for LOW to 4 for CRITICAL (MEDIUM is MODERATE); 0 for any other label or none."""
    up = F.upper(F.trim(label))
    return F.coalesce(F.array_position(F.array(*map(F.lit, LABELS)), F.when(up == "MEDIUM", "MODERATE").otherwise(up)), F.lit(0)).cast("int")


def max_score(vectors: Column) -> Column:
    """The greatest base score of an array of vectors; null without a sound one."""
    return F.array_max(F.transform(vectors, base_score))


def severity(known_exploited: Column, malicious: Column, cvss: Column, label: Column) -> Column:
    """BLOCKER if exploited or malicious, else by score from 7 on, else by label, else MINOR."""
    by_label = F.when(label_rank(label) == 4, "CRITICAL").when(label_rank(label) == 3, "MAJOR").otherwise("MINOR")
    return F.when(F.coalesce(known_exploited, F.lit(False)) | F.coalesce(malicious, F.lit(False)), "BLOCKER").when(cvss >= 9, "CRITICAL").when(cvss >= 7, "MAJOR").otherwise(by_label)
