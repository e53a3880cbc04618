"""What a user calls: named scalar calls on texts, and scans of folders, files, snippets and packages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions import cvss, text, versions
from tallyward.operators import detectors, discovery, findings, names, sca
from tallyward.sources import formats, readers

#: Named calls: each gives a column from one column.
CALLS: dict[str, Callable[[Column], Column]] = {
    "entropy": text.entropy, "redact": text.redact, "fold_lookalikes": text.fold_lookalikes, "normalise_name": text.normalise_name, "terminal_safe": text.terminal_safe,
    "nfc": text.unicode_nfc, "nfd": text.unicode_nfd, "nfkc": text.unicode_nfkc, "nfkd": text.unicode_nfkd, "wallet_address": text.wallet_address, "identifier_like": text.identifier_like,
    "sequence_run": text.sequence_run, "looks_secret": text.looks_secret, "embedded_data": text.embedded_data, "address_class": text.address_class, "iso_time": text.iso_time, "hour_name": text.hour_name, "hour_of_name": text.hour_of_name,
    "hex_escapes": text.hex_escapes, "character_codes": text.character_codes, "fnv1a": text.fnv1a, "json_leaves": text.json_leaves, "json_depth": text.json_depth, "sha256": lambda c: F.sha2(c, 256), "crc32": F.crc32,
    "pep440_key": versions.pep440, "semver_key": versions.semantic, "release_key": versions.release_key, "major": versions.major, "is_prerelease": versions.is_prerelease, "unbounded": versions.unbounded,
    "cvss_base_score": cvss.base_score, "severity_label_rank": cvss.label_rank, "import_keys": names.import_keys, "edit_neighbourhood": names.neighbourhood, "refused_pattern": detectors.refused_pattern,
    "in_use": discovery.in_use, "parse_array": discovery.parse_array, "encode_array": discovery.encode_array, "json_without_comments": readers.json_without_comments, "xml_refused": formats.xml_refused, "invisible": lambda c: c.rlike(text.INVISIBLE),
}


def call(df: DataFrame, name: str, column: str, to: str | None = None) -> DataFrame:
    """Adds the result of a named call on a column."""
    return df.withColumn(to or name, CALLS[name](F.col(column)))


def scan_files(files: DataFrame, pack=detectors.PACK, key: str = "path") -> DataFrame:
    """(key, line_no, rule, family, type, severity): findings of line rules and of rules on whole files, (path, lang, text)
    rows in, with what is suppressed left out and what is not in use demoted to INFO."""
    named = files.withColumn("file_id", F.col(key))
    found = detectors.suppressed(detectors.detect(named, pack), text.lines(named.filter("text is not null").select("file_id", "text")))
    whole = detectors.together(named).select("file_id", F.lit(None).cast("long").alias("line_no"), "rule", F.lit("together").alias("family"), F.lit("VULN").alias("type"), F.lit("CRITICAL").alias("severity"))
    every = found.select("file_id", "line_no", "rule", "family", "type", "severity").unionByName(whole)
    quiet = ~discovery.in_use(F.col("file_id")) & ~F.col("rule").rlike("^(SIGN|RUN)-")
    return every.withColumn("severity", F.when(quiet, "INFO").otherwise(F.col("severity"))).withColumnRenamed("file_id", key)


def scan_directory(spark: SparkSession, path: str, pack=detectors.PACK) -> DataFrame:
    """Findings of all text files below a folder."""
    tree = readers.read_tree(spark, path).filter("kind = 'text'")
    short = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return scan_files(tree.select("path", short.alias("lang"), readers.decoded(F.col("content")).alias("text")), pack)


def scan_snippet(spark: SparkSession, code: str, lang: str = "") -> DataFrame:
    """Findings of one text."""
    return scan_files(spark.createDataFrame([("snippet", lang, code)], "path string, lang string, text string"))


def scan_package(spark: SparkSession, archive: str, pack=detectors.PACK) -> DataFrame:
    """Findings of the members of an archive, and a row SC-UNREAD for each that can't be read."""
    members = readers.read_archives(spark.read.format("binaryFile").load(archive))
    short = F.regexp_extract("member", r"\.([A-Za-z0-9]+)$", 1)
    read = members.filter("content is not null").select(F.col("member").alias("path"), short.alias("lang"), readers.decoded(F.col("content")).alias("text"))
    unread = members.filter("content is null").select(F.col("member").alias("path"), F.lit(None).cast("long").alias("line_no"), F.lit("SC-UNREAD").alias("rule"), F.lit("archive").alias("family"), F.lit("VULN").alias("type"), F.lit("MAJOR").alias("severity"))
    return scan_files(read, pack).unionByName(unread)


def match_dependencies(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """Verdicts of the dependencies that manifests and locks among (path, text) files name, against advisories."""
    have = readers.read_inventory(files).unionByName(formats.read_more_inventory(files).select("ecosystem", "name", "version", "path"))
    keyed = have.select("ecosystem", text.normalise_name(F.col("name")).alias("name_key"), "name", "version").distinct()
    return sca.match_inventory(sca.known_only(keyed), advisories)


__all__ = ["CALLS", "call", "findings", "match_dependencies", "scan_directory", "scan_files", "scan_package", "scan_snippet"]
