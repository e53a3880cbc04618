"""Queries on discovery, code in use, code without comments, and arrays, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyward import api
from tallyward.operators import discovery as ds
from tallyward.plans import detector_queries as dq
from tallyward.plans.queries import query, table

_FILTERS = ds.Filters.read("# names and descriptions\nalways: ^a\nexclude: green|red\ninclude: ^[a-m]\nmarker: (?i)brand#1\n")


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^a') THEN 'always' WHEN regexp_matches(p_brand, '(?i)brand#1') THEN 'marker' ELSE 'include' END AS why FROM part WHERE regexp_matches(p_name, '^a') OR (NOT regexp_matches(p_name, 'green|red') AND NOT regexp_matches(p_brand, 'green|red') AND (regexp_matches(p_brand, '(?i)brand#1') OR regexp_matches(p_name, '^[a-m]')))")
def discovery_filters(spark, d):
    return ds.discovered(table(spark, d, "part"), _FILTERS, "p_name", "p_brand").select("p_partkey", "why")


@query(f"SELECT file_id, path NOT LIKE 'tests/%' AS used FROM {dq._FILES}")
def code_in_use(spark, d):
    return dq.files(spark, d).select("file_id", ds.in_use(F.col("path")).alias("used"))


_CODE = "concat('x = \"a # b\" # c', p_partkey, chr(10), '# only', chr(10), 'y = ''it''')"


@query(f"SELECT p_partkey, 'x = \"a # b\" ' || chr(10) || chr(10) || 'y = ''it''' AS bare, 'x = \"\" ' || chr(10) || chr(10) || 'y = \"\"' AS empty, ['\"a # b\"', '''it'''] AS strings FROM part")
def code_without_comments(spark, d):
    code = F.concat(F.lit('x = "a # b" # c'), "p_partkey", F.lit("\n# only\ny = 'it'"))
    c, lang = F.col("code"), F.lit("py")
    return table(spark, d, "part").select("p_partkey", code.alias("code")).select("p_partkey", ds.without_comments(c, lang).alias("bare"), ds.without_strings(c, lang).alias("empty"), ds.string_literals(c, lang).alias("strings"))


@query("SELECT p_partkey, [p_name, 'q\"' || p_size, NULL, ''] AS items, '{' || (CASE WHEN contains(p_name, ' ') THEN '\"' || p_name || '\"' ELSE p_name END) || ',\"q\\\"' || p_size || '\",NULL,\"\"}' AS text FROM part")
def database_arrays(spark, d):
    items = F.array("p_name", F.concat(F.lit('q"'), "p_size"), F.lit(None), F.lit(""))
    made = table(spark, d, "part").select("p_partkey", ds.encode_array(items).alias("text"))
    return made.select("p_partkey", ds.parse_array(F.col("text")).alias("items"), "text")


@query("SELECT p_partkey, CAST(p_partkey AS BIGINT) AS id, p_partkey % 2 = 0 AS even, [p_brand, p_type] AS tags FROM part")
def decoded_types(spark, d):
    k = F.col("p_partkey")
    raw = table(spark, d, "part").select(k, k.cast("string").alias("id"), F.when(k % 2 == 0, "t").otherwise("f").alias("even"), ds.encode_array(F.array("p_brand", "p_type")).alias("tags"))
    return ds.decoded_columns(raw, {"id": "int8", "even": "bool", "tags": "text[]"})


@query("SELECT p_partkey, sha256(p_name) AS digest, CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS rank FROM part")
def named_calls(spark, d):
    label = F.when(F.col("p_size") % 3 == 0, "high").when(F.col("p_size") % 3 == 1, "Medium").otherwise("?")
    p = table(spark, d, "part").select("p_partkey", "p_name", label.alias("label"))
    return api.call(api.call(p, "sha256", "p_name", "digest"), "severity_label_rank", "label", "rank").select("p_partkey", "digest", "rank")


@query(f"""SELECT path, rule, count(*) AS n FROM (SELECT path, rule, CASE WHEN path LIKE 'tests/%' AND NOT regexp_matches(rule, '^(SIGN|RUN)-') THEN 'INFO' ELSE severity END AS severity FROM {dq._NOT_SUPPRESSED}
  UNION ALL SELECT path, rule, CASE WHEN path LIKE 'tests/%' THEN 'INFO' ELSE 'CRITICAL' END FROM ({" UNION ALL ".join(f"SELECT path, '{rule}' AS rule FROM {dq._FILES} WHERE {' AND '.join(f'regexp_matches(text, {dq._quoted(p)})' for p in patterns)}" for rule, patterns in dq.dt.TOGETHER.items())})) WHERE severity <> 'INFO' GROUP BY path, rule""")
def scan_of_files(spark, d):
    return api.scan_files(dq.files(spark, d)).filter("severity != 'INFO'").groupBy("path", "rule").agg(F.count("*").alias("n"))
