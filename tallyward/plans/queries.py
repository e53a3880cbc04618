"""The queries on the relational and text tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyward.functions import cvss, text, versions
from tallyward.operators import findings as fd
from tallyward.operators import grade as gr
from tallyward.operators import history, names, sca

#: Bytes of a table that a query sends to all tasks at most; with more the join is left to Spark.
BROADCAST_BYTES = 64 << 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- SQL pieces of the oracles -------------------------------------------------------------------------------------

_LINES = "(SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)"
_RULES = " UNION ALL ".join(f"SELECT '{r.id}' AS rule, '{r.type}' AS type, '{r.severity}' AS severity, '{r.pattern}' AS pattern" for r in fd.RULES)
_FOUND = f"(SELECT doc_id, source, lang, line_no, line, rule, type, severity FROM {_LINES} l JOIN ({_RULES}) r ON regexp_matches(line, pattern))"
_SEV = "list_position(['BLOCKER','CRITICAL','MAJOR','MINOR','INFO'], severity)"


def _findings(spark, d, *keep):
    return fd.scan_lines(table(spark, d, "documents"), keep=("doc_id", "source", *keep))


# --- findings ------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, source, CAST(line_no AS BIGINT) AS line_no, rule, type, severity FROM {_FOUND}")
def scan_rules_lines(spark, d):
    return _findings(spark, d).drop("line")


@query(f"SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, rule, severity, round(list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)) * log2(len(list_filter(string_split(token, ''), lambda x: x = c)) / length(token)))), 6) AS entropy FROM (SELECT *, regexp_extract(line, '= \"([0-9A-Za-z_-]{{8,}})', 1) AS token FROM {_FOUND} WHERE rule = 'S-SECRET') WHERE token <> ''")
def scan_secrets(spark, d):
    rules = [r for r in fd.RULES if r.id == "S-SECRET"]
    token = F.regexp_extract("line", '= "([0-9A-Za-z_-]{8,})', 1)
    return fd.scan_lines(table(spark, d, "documents"), rules).withColumn("token", token).filter("token != ''").select("doc_id", "line_no", "rule", "severity", F.round(text.entropy(F.col("token")), 6).alias("entropy"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, 'Licensed under|Released under|All rights reserved')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, 'Licensed under|Released under|All rights reserved')")
def scan_whole_text(spark, d):
    return fd.scan_whole_text(table(spark, d, "documents"), "Licensed under|Released under|All rights reserved")


@query(f"WITH f AS (SELECT source, rule, doc_id, line_no FROM {_FOUND}), n AS (SELECT *, row_number() OVER (PARTITION BY source, rule ORDER BY doc_id, line_no) AS place, count(*) OVER (PARTITION BY source, rule) AS c FROM f) SELECT source, rule, doc_id, CAST(line_no AS BIGINT) AS line_no, place, CASE WHEN place = 5 AND c > 5 THEN c - 5 ELSE 0 END AS omitted FROM n WHERE place <= 5")
def findings_dedupe_cap(spark, d):
    one = _findings(spark, d).dropDuplicates(["doc_id", "line_no", "rule"])
    return fd.cap(one, ["source", "rule"], ["doc_id", "line_no"], 5).select("source", "rule", "doc_id", "line_no", "place", "omitted")


@query(f"SELECT severity, source, doc_id, CAST(line_no AS BIGINT) AS line_no, rule FROM {_FOUND} ORDER BY {_SEV}, source, doc_id, line_no, rule LIMIT 100")
def findings_ranked_topk(spark, d):
    return fd.ranked(_findings(spark, d), 100, "source", "doc_id", "line_no", "rule").select("severity", "source", "doc_id", "line_no", "rule")


@query(f"WITH f AS (SELECT * FROM {_FOUND} WHERE rule <> 'Q-SHOUT'), m AS (SELECT DISTINCT doc_id, l AS line_no FROM (SELECT doc_id, unnest([line_no, line_no + 1]) AS l FROM {_LINES} WHERE contains(line, 'License'))) SELECT rule, count(*) AS n FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = f.doc_id AND m.line_no = f.line_no) GROUP BY rule")
def findings_suppressed(spark, d):
    found = _findings(spark, d).filter("rule != 'Q-SHOUT'").drop("line")
    return fd.suppress(found, gr.document_lines(table(spark, d, "documents")), "License", ["doc_id"]).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"SELECT rule, severity, count(*) AS n FROM (SELECT rule, CASE WHEN lang <> 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id) THEN 'INFO' ELSE severity END AS severity FROM {_FOUND} f) GROUP BY ALL")
def findings_demoted(spark, d):
    found = _findings(spark, d, "lang")
    path = F.when(F.col("lang") != "en", F.lit("src/tests/x")).otherwise(F.lit("src/x"))
    return fd.demote(found, path, table(spark, d, "labels"), "doc_id").groupBy("rule", "severity").agg(F.count("*").alias("n"))


_METRICS = "(SELECT doc_id, source, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(l, lambda x: trim(x, ' ') <> '' AND NOT regexp_matches(x, '^\\s*(#|//|--)'))) AS BIGINT) AS ncloc, CAST(len(list_filter(l, lambda x: trim(x, ' ') <> '' AND regexp_matches(x, '^\\s*(#|//|--)'))) AS BIGINT) AS comments FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"


@query(f"SELECT doc_id, n_lines, ncloc, comments FROM {_METRICS}")
def line_metrics(spark, d):
    return gr.line_metrics(table(spark, d, "documents"))


_COUNTS = "count(*) FILTER (type = 'VULN') AS n_vuln, count(*) FILTER (type = 'HOTSPOT') AS n_hotspot, count(*) FILTER (type = 'BUG') AS n_bug, count(*) FILTER (type = 'SMELL') AS n_smell"
_RATE = "CASE min(CASE WHEN type = '{}' THEN " + _SEV + " END) WHEN 1 THEN 'E' WHEN 2 THEN 'D' WHEN 3 THEN 'C' WHEN 4 THEN 'B' ELSE 'A' END"
_GRADE = f"""(SELECT *, security IN ('A','B') AND reliability IN ('A','B','C') AND maintainability IN ('A','B','C') AS gate FROM (
    SELECT s.source, s.ncloc, coalesce(n_vuln, 0) AS n_vuln, coalesce(n_hotspot, 0) AS n_hotspot, coalesce(n_bug, 0) AS n_bug, coalesce(n_smell, 0) AS n_smell,
      coalesce(security, 'A') AS security, coalesce(reliability, 'A') AS reliability,
      CASE WHEN s.ncloc = 0 OR coalesce(n_smell, 0) * 100 / s.ncloc <= 5 THEN 'A' WHEN n_smell * 100 / s.ncloc <= 10 THEN 'B' WHEN n_smell * 100 / s.ncloc <= 20 THEN 'C' WHEN n_smell * 100 / s.ncloc <= 40 THEN 'D' ELSE 'E' END AS maintainability
    FROM (SELECT source, CAST(sum(ncloc) AS BIGINT) AS ncloc FROM {_METRICS} GROUP BY source) s
    LEFT JOIN (SELECT source, {_COUNTS}, {_RATE.format("VULN")} AS security, {_RATE.format("BUG")} AS reliability FROM {_FOUND} GROUP BY source) c USING (source)))"""


@query(f"SELECT source, ncloc, n_vuln, n_hotspot, n_bug, n_smell, security, reliability, maintainability, gate FROM {_GRADE}")
def grade_by_source(spark, d):
    return gr.grade(_findings(spark, d), gr.line_metrics(table(spark, d, "documents"), keep=("source",)), "source")


@query(f"SELECT source, CAST(security IN ('A','B') AS INTEGER) AS secure, CAST(reliability IN ('A','B','C') AS INTEGER) AS reliable, CAST(maintainability IN ('A','B','C') AS INTEGER) AS maintainable, gate FROM {_GRADE}")
def gate_conditions(spark, d):
    g = grade_by_source(spark, d)
    return g.select("source", F.col("security").isin("A", "B").cast("int").alias("secure"), F.col("reliability").isin("A", "B", "C").cast("int").alias("reliable"), F.col("maintainability").isin("A", "B", "C").cast("int").alias("maintainable"), "gate")


@query(f"SELECT doc_id, count(*) AS n, count(DISTINCT rule) AS n_rules FROM {_FOUND} GROUP BY doc_id")
def per_file_counts(spark, d):
    return gr.per_file_counts(_findings(spark, d)).select("doc_id", "n", F.size("rules").cast("long").alias("n_rules"))


@query("""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS c FROM documents),
  w AS (SELECT doc_id, k, md5(array_to_string(c[k:k+5], chr(10))) AS h FROM (SELECT doc_id, c, unnest(range(1, len(c) - 4)) AS k FROM c)),
  a AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
  v AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + 6)) AS line FROM w WHERE h IN (SELECT h FROM a)) GROUP BY doc_id)
  SELECT doc_id, CAST(len(c) AS BIGINT) AS measured, coalesce(n, 0) AS duplicated FROM c LEFT JOIN v USING (doc_id)""")
def duplicate_windows(spark, d):
    return gr.duplication(table(spark, d, "documents"))


@query("""WITH c AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL)
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_chars, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY doc_id""")
def char_entropy(spark, d):
    return text.document_entropy(table(spark, d, "documents")).select("doc_id", "n_chars", F.round("entropy", 6).alias("entropy"))


_PRINTS = f"(SELECT source, sha256(rule || '|' || line) AS print FROM {_FOUND})"


@query(f"SELECT source, count(DISTINCT print) AS n FROM {_PRINTS} f WHERE source <> 'src0' AND print NOT IN (SELECT print FROM {_PRINTS} WHERE source = 'src0') GROUP BY source")
def baseline_new_findings(spark, d):
    prints = _findings(spark, d).select("source", F.sha2(F.concat_ws("|", "rule", "line"), 256).alias("print"))
    new = prints.filter("source != 'src0'").join(prints.filter("source = 'src0'").select("print").distinct(), "print", "left_anti")
    return new.groupBy("source").agg(F.count_distinct("print").alias("n"))


_RUN = "(SELECT doc_id, CASE WHEN max(CASE WHEN type = 'VULN' THEN 1 ELSE 0 END) = 1 THEN 'SUSPICIOUS' ELSE 'WARN' END AS verdict, list_sort(list(DISTINCT rule)) AS rules FROM (SELECT * FROM " + _FOUND + ") WHERE {} GROUP BY doc_id)"


def _run_sql(condition: str) -> str:
    return _RUN.replace("{}", condition)


def _run(found):
    return found.groupBy("doc_id").agg(F.when(F.count_if(F.col("type") == "VULN") > 0, "SUSPICIOUS").otherwise("WARN").alias("verdict"), F.array_sort(F.collect_set("rule")).alias("rules"))


@query(f"SELECT doc_id, a.verdict AS verdict_a, b.verdict AS verdict_b, CASE WHEN a.verdict IS NULL THEN 'new' WHEN b.verdict IS NULL THEN 'gone' WHEN a.verdict <> b.verdict THEN 'changed' ELSE 'same' END AS state, CAST(len(list_filter(coalesce(b.rules, []), lambda x: NOT list_contains(coalesce(a.rules, []), x))) AS BIGINT) AS gained FROM {_run_sql("rule NOT IN ('S-CARD','S-PHONE')")} a FULL JOIN {_run_sql("rule <> 'Q-TABLE'")} b USING (doc_id)")
def run_compare(spark, d):
    found = _findings(spark, d)
    return names.compare_runs(_run(found.filter(~F.col("rule").isin("S-CARD", "S-PHONE"))), _run(found.filter("rule != 'Q-TABLE'")), "doc_id").select("doc_id", "verdict_a", "verdict_b", "state", "gained")


@query(f"WITH v AS (SELECT toxic, coalesce(verdict, 'OK') AS verdict FROM labels LEFT JOIN {_run_sql('true')} r USING (doc_id)), n AS (SELECT toxic, verdict, count(*) AS n FROM v GROUP BY ALL) SELECT toxic, verdict, n, round(100 * n / sum(n) OVER (PARTITION BY toxic), 6) AS percent FROM n")
def verdict_confusion(spark, d):
    v = table(spark, d, "labels").select("doc_id", "toxic").join(_run(_findings(spark, d)), "doc_id", "left").select("toxic", F.coalesce("verdict", F.lit("OK")).alias("verdict"))
    return gr.share_of(v, ["toxic", "verdict"], ["toxic"])


@query(f"SELECT before, after, count(*) AS n FROM (SELECT coalesce(a.verdict, 'OK') AS before, coalesce(b.verdict, 'OK') AS after FROM {_run_sql("rule NOT IN ('S-CARD','S-PHONE')")} a FULL JOIN {_run_sql("rule <> 'Q-TABLE'")} b USING (doc_id)) GROUP BY ALL")
def verdict_transitions(spark, d):
    r = run_compare(spark, d)
    return r.select(F.coalesce("verdict_a", F.lit("OK")).alias("before"), F.coalesce("verdict_b", F.lit("OK")).alias("after")).groupBy("before", "after").agg(F.count("*").alias("n"))


@query(f"SELECT source, lang, rule FROM (SELECT DISTINCT source, lang, rule FROM {_FOUND}) f WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM {_FOUND} p WHERE p.source = f.source AND p.lang = 'en' AND p.rule = f.rule)")
def new_indicators(spark, d):
    rules = _findings(spark, d, "lang").select("source", "lang", "rule").distinct()
    return rules.filter("lang != 'en'").join(rules.filter("lang = 'en'").select("source", "rule"), ["source", "rule"], "left_anti").select("source", "lang", "rule")


@query("SELECT doc_id, md5(" + "regexp_replace(" * len(text.REDACTIONS) + "text" + "".join(", '" + p.replace("'", "''") + "', '" + t.replace("$1", "\\1") + "', 'g')" for p, t in text.REDACTIONS) + ") AS redacted FROM documents")
def redact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted"))


@query("SELECT doc_id, regexp_matches(text, '[​-‏‪-‮⁠⁦-⁩﻿]') AS invisible, md5(translate(text, '" + text.LOOKALIKE_FROM + "', '" + text.LOOKALIKE_TO + "')) AS folded FROM documents")
def lookalike_letters(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.rlike(text.INVISIBLE).alias("invisible"), F.md5(text.fold_lookalikes(t)).alias("folded"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, CAST(len(regexp_extract_all(html, '<script')) AS BIGINT) AS n_scripts, CAST(len(list_distinct(regexp_extract_all(html, 'href="[^"]*"'))) AS BIGINT) AS n_links,
  regexp_matches(html, '\\S[ ]{80,}\\S') AS off_screen, CAST(len(list_distinct(regexp_extract_all(html, '\\b_0x[0-9a-f]{4,}\\b'))) AS BIGINT) AS n_obfuscated, regexp_matches(html, '["''][A-Za-z0-9+/]{200,}={0,2}["'']') AS blob FROM pages""")
def page_signs(spark, d):
    h = F.col("html")
    every = lambda p: F.regexp_extract_all(h, F.lit(p), F.lit(0))
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)", 1).alias("title"), F.size(every("<script")).cast("long").alias("n_scripts"), F.size(F.array_distinct(every('href="[^"]*"'))).cast("long").alias("n_links"), h.rlike(r"\S[ ]{80,}\S").alias("off_screen"), F.size(F.array_distinct(every(r"\b_0x[0-9a-f]{4,}\b"))).cast("long").alias("n_obfuscated"), h.rlike("[\"'][A-Za-z0-9+/]{200,}={0,2}[\"']").alias("blob"))


@query("SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), 'ignore (all|previous)|api_key|password|token')) AS n_signs, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations GROUP BY role")
def agent_text_signs(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.lower("text").rlike("ignore (all|previous)|api_key|password|token")).alias("n_signs"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def content_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1")


def _grams(df, key, n=8):
    # The words become a column before they are used, or each gram would split the text again.
    words = df.select(key, F.split(F.lower("text"), " ").alias("w")).filter(F.size("w") >= n).select(key, "w", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("k"))
    return words.select(key, F.array_join(F.slice("w", F.col("k"), n), " ").alias("g"))


_GRAM = "(SELECT DISTINCT {k}, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {k}, string_split(lower(text), ' ') AS w FROM {t})))"


@query(f"SELECT doc_id, item_id, count(*) AS shared FROM {_GRAM.format(k='doc_id', t='documents')} d JOIN {_GRAM.format(k='item_id', t='benchmark')} b USING (g) GROUP BY ALL")
def benchmark_contamination(spark, d):
    """A document's grams meet the benchmark's before anything is shuffled, if those are few enough to be sent out."""
    items = _grams(table(spark, d, "benchmark"), "item_id").distinct()
    size = items.agg(F.sum(F.octet_length("g") + 16)).first()[0] or 0
    found = _grams(table(spark, d, "documents"), "doc_id").join(F.broadcast(items) if size <= BROADCAST_BYTES else items, "g")
    return found.groupBy("doc_id", "item_id").agg(F.count_distinct("g").alias("shared"))


# --- inventory and advisories --------------------------------------------------------------------------------------

def _digits_sql(x: str) -> str:
    t = f"coalesce(nullif(ltrim({x}, '0'), ''), '0')"
    return f"(lpad(CAST(length({t}) AS VARCHAR), 3, '0') || {t})"


def _release_sql(x: str) -> str:
    return f"(array_to_string(list_transform(string_split(regexp_replace({x}, '([.]0+)+$', ''), '.'), lambda p: {_digits_sql('p')}), '.') || '.')"


def _pep_sql(v: str, local: bool) -> str:
    low = f"lower(trim({v}, ' '))"
    g = lambda k: f"regexp_extract({low}, '{versions._PEP_FORM}', {k})" if k < 10 else f"split_part({low}, '+', 2)"
    pre = f"CASE WHEN {g(3)} IN ('a', 'alpha') THEN 'a' || {_digits_sql(g(4))} WHEN {g(3)} IN ('b', 'beta') THEN 'b' || {_digits_sql(g(4))} WHEN {g(3)} <> '' THEN 'c' || {_digits_sql(g(4))} WHEN {g(8)} <> '' AND {g(5)} = '' AND {g(6)} = '' THEN '0' ELSE 'z' END"
    post = f"CASE WHEN {g(5)} <> '' THEN '1' || {_digits_sql(g(5))} WHEN {g(6)} <> '' THEN '1' || {_digits_sql(g(7))} ELSE '0' END"
    dev = f"CASE WHEN {g(8)} <> '' THEN '0' || {_digits_sql(g(9))} ELSE '1' END"
    end = f" || '!' || CASE WHEN {g(10)} <> '' THEN array_to_string(list_transform(string_split_regex({g(10)}, '[-_.]'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN '1' || {_digits_sql('p')} ELSE '0' || p END), '!') ELSE '' END" if local else ""
    return f"CASE WHEN length({v}) <= 128 AND regexp_matches({low}, '{versions._PEP_FORM}') THEN concat_ws('!', {_digits_sql(g(1))}, {_release_sql(g(2))}, {pre}, {post}, {dev}){end} END"


def _sem_sql(v: str) -> str:
    g = lambda k: f"regexp_extract(trim({v}, ' '), '{versions._SEM_FORM}', {k})"
    pre = f"CASE WHEN {g(2)} = '' THEN 'z' ELSE '0' || array_to_string(list_transform(string_split({g(2)}, '.'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN '0' || {_digits_sql('p')} ELSE '1' || p END), '!') END"
    return f"CASE WHEN length({v}) <= 128 AND regexp_matches(trim({v}, ' '), '{versions._SEM_FORM}') THEN concat_ws('!', {_release_sql(g(1))}, {pre}) END"


def _keys_sql(v: str, p: str) -> str:
    return f"{_pep_sql(v, True)} AS {p}pep, {_pep_sql(v, False)} AS {p}plain, {_sem_sql(v)} AS {p}sem"


def _scheme_sql(eco: str, dashed: str, pep: str, sem: str) -> str:
    return f"CASE WHEN {eco} IN ('go', 'crates') THEN {sem} WHEN {eco} = 'npm' OR ({eco} <> 'pypi' AND {dashed}) THEN coalesce({sem}, {pep}) ELSE coalesce({pep}, {sem}) END"


def _compared_sql(b: str) -> str:
    sign = lambda x, y: f"CASE WHEN {x} < {y} THEN -1 WHEN {x} = {y} THEN 0 WHEN {x} > {y} THEN 1 END"
    pep = f"CASE WHEN contains({b}_version, '+') THEN {sign('v_pep', f'{b}_pep')} ELSE {sign('v_plain', f'{b}_plain')} END"
    return _scheme_sql("ecosystem", f"(contains(version, '-') OR contains({b}_version, '-'))", pep, sign("v_sem", f"{b}_sem"))


_ECO = "(['pypi','npm','go','other'])[{0} % 4 + 1]"
_FORMS = ("CASE {k} % 13 WHEN 0 THEN NULL WHEN 1 THEN 'latest' WHEN 2 THEN concat({a}, '.', {b}, 'rc', {c}) WHEN 3 THEN concat('v', {a}, '.', {b}, '.', {c}, '-beta.', {b}) WHEN 4 THEN concat({a}, '.', {b}, '.0') WHEN 5 THEN concat({a}, '.', {b}, '.post', {c}) WHEN 6 THEN concat({a}, '.', {b}, '.dev', {c})"
          " WHEN 7 THEN concat({a}, '.', {b}, '+local.', {c}) WHEN 8 THEN concat('1!', {a}, '.', {b}) WHEN 9 THEN concat({a}, '.', {b}, '.', {c}, '-alpha') WHEN 10 THEN '2.*' ELSE concat({a}, '.', {b}, '.', {c}) END")  # fmt: skip
_VERSION = _FORMS.format(k="p_partkey", a="p_partkey % 5", b="p_size % 9", c="p_partkey % 3")
_LOW = "CASE s_suppkey % 6 WHEN 0 THEN '*' ELSE " + _FORMS.format(k="(s_suppkey + s_nationkey)", a="s_suppkey % 3", b="s_nationkey % 7", c="s_suppkey % 2") + " END"
_HIGH = "CASE s_suppkey % 7 WHEN 0 THEN NULL ELSE " + _FORMS.format(k="(s_suppkey + 2 * s_nationkey + 5)", a="(s_suppkey % 3 + s_nationkey % 3)", b="s_nationkey % 8", c="s_suppkey % 2") + " END"
_NAME = "concat('pkg-', p_partkey % 40)"
_INVENTORY = f"(SELECT DISTINCT {_ECO.format('(p_partkey % 40)')} AS ecosystem, {_NAME} AS name_key, {_NAME} AS name, {_VERSION} AS version FROM part)"
# Two packages of each advisory, with ranges of their own.
_AFFECTED = f"""(SELECT concat('CVE-2024-', s_suppkey) AS cve, {_ECO.format('((s_suppkey + j) % 40)')} AS ecosystem, concat('pkg-', (s_suppkey + j) % 40) AS name_key, low_version, s_suppkey % 2 = 0 AS low_included,
  CASE WHEN j = 0 THEN high_version ELSE concat(s_nationkey % 6 + 1, '.', s_suppkey % 4, '.0') END AS high_version, s_suppkey % 5 = 0 AS high_included FROM (SELECT s_suppkey, s_nationkey, {_LOW} AS low_version, {_HIGH} AS high_version FROM supplier), range(0, 2) AS r(j))"""
_RANGED = f"""(SELECT cve, name_key, name, ecosystem, version, CASE WHEN low_open AND high_open THEN 2 WHEN {_scheme_sql("ecosystem", "false", "v_pep", "v_sem")} IS NULL THEN 1 WHEN NOT low_open AND lo IS NULL THEN 1
  WHEN NOT (low_open OR lo > 0 OR (low_included AND lo = 0)) THEN 0 WHEN NOT high_open AND hi IS NULL THEN 1 WHEN high_open OR hi < 0 OR (high_included AND hi = 0) THEN 2 ELSE 0 END AS r FROM (
  SELECT *, {_compared_sql("low")} AS lo, {_compared_sql("high")} AS hi, low_version IN ('', '*') AS low_open, high_version IN ('', '*') AS high_open FROM
  (SELECT *, {_keys_sql("version", "v_")} FROM {_INVENTORY}) i JOIN (SELECT *, {_keys_sql("low_version", "low_")}, {_keys_sql("high_version", "high_")} FROM (SELECT * REPLACE (coalesce(low_version, '*') AS low_version, coalesce(high_version, '*') AS high_version) FROM {_AFFECTED})) a USING (ecosystem, name_key)))"""
_MATCH = f"(SELECT cve, ecosystem, name, version, (['CLEAR','UNKNOWN','AFFECTED'])[max(r) + 1] AS verdict FROM {_RANGED} GROUP BY ALL)"


def _forms(k, a, b, c):
    t = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, F.Column) else F.lit(x) for x in parts])
    made = [None, F.lit("latest"), t(a, ".", b, "rc", c), t("v", a, ".", b, ".", c, "-beta.", b), t(a, ".", b, ".0"), t(a, ".", b, ".post", c), t(a, ".", b, ".dev", c), t(a, ".", b, "+local.", c), t("1!", a, ".", b), t(a, ".", b, ".", c, "-alpha"), F.lit("2.*")]
    chosen = t(a, ".", b, ".", c)
    for n, form in enumerate(made):
        chosen = F.when(k % 13 == n, form).otherwise(chosen)
    return chosen


def _eco(k):
    return F.element_at(F.array(*map(F.lit, ("pypi", "npm", "go", "other"))), (k % 4 + 1).cast("int"))


def _inventory(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("pkg-"), k % 40)
    return table(spark, d, "part").select(_eco(k % 40).alias("ecosystem"), name.alias("name_key"), name.alias("name"), _forms(k, k % 5, F.col("p_size") % 9, k % 3).alias("version")).distinct()


def _affected(spark, d):
    k, n, j = F.col("s_suppkey"), F.col("s_nationkey"), F.col("j")
    s = table(spark, d, "supplier").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    low = F.when(k % 6 == 0, "*").otherwise(_forms(k + n, k % 3, n % 7, k % 2))
    high = F.when(j == 1, F.concat_ws(".", (n % 6 + 1).cast("string"), (k % 4).cast("string"), F.lit("0"))).when(k % 7 == 0, None).otherwise(_forms(k + 2 * n + 5, k % 3 + n % 3, n % 8, k % 2))
    return s.select(F.concat(F.lit("CVE-2024-"), k).alias("cve"), _eco((k + j) % 40).alias("ecosystem"), F.concat(F.lit("pkg-"), (k + j) % 40).alias("name_key"), low.alias("low_version"), (k % 2 == 0).alias("low_included"), high.alias("high_version"), (k % 5 == 0).alias("high_included"))


@query(f"SELECT cve, ecosystem, name, version, verdict FROM {_MATCH}")
def sca_match(spark, d):
    return sca.match_inventory(_inventory(spark, d), _affected(spark, d))


@query(f"""WITH b AS (SELECT DISTINCT cve, ecosystem, name_key, high_version, CASE WHEN ecosystem IN ('npm', 'go', 'crates') THEN {_sem_sql("high_version")} ELSE coalesce({_pep_sql("high_version", True)}, {_sem_sql("high_version")}) END AS key FROM {_AFFECTED} WHERE NOT high_included AND high_version NOT IN ('', '*'))
  SELECT m.cve, m.ecosystem, m.name, arg_max(high_version, (key, high_version)) AS fixed_in FROM (SELECT DISTINCT cve, ecosystem, name FROM {_MATCH} WHERE verdict = 'AFFECTED') m JOIN b ON b.cve = m.cve AND b.ecosystem = m.ecosystem AND b.name_key = m.name WHERE key IS NOT NULL GROUP BY ALL""")
def sca_fix_hint(spark, d):
    return sca.fix_hint(sca_match(spark, d), _inventory(spark, d), _affected(spark, d))


@query(f"SELECT p_partkey, version, {_pep_sql('version', True)} AS pep, {_sem_sql('version')} AS sem FROM (SELECT p_partkey, {_VERSION} AS version FROM part)")
def version_keys(spark, d):
    k = F.col("p_partkey")
    v = table(spark, d, "part").select(k, _forms(k, k % 5, F.col("p_size") % 9, k % 3).alias("version"))
    return v.select("p_partkey", "version", versions.pep440(F.col("version")).alias("pep"), versions.semantic(F.col("version")).alias("sem"))


@query(f"SELECT DISTINCT cve, name_key, CASE WHEN lo IS NULL AND hi IS NULL THEN 'all versions' ELSE concat_ws(' ', lo, hi) END AS ranges FROM (SELECT *, CASE WHEN low_version NOT IN ('', '*') THEN concat(CASE WHEN low_included THEN '>=' ELSE '>' END, low_version) END AS lo, CASE WHEN high_version NOT IN ('', '*') THEN concat(CASE WHEN high_included THEN '<=' ELSE '<' END, high_version) END AS hi FROM {_AFFECTED})")
def version_ranges_text(spark, d):
    c = F.col
    return _affected(spark, d).select("cve", "name_key", versions.format_range(c("low_version"), c("low_included"), c("high_version"), c("high_included")).alias("ranges")).distinct()


@query(f"SELECT ecosystem, name, version FROM {_INVENTORY} i WHERE version IS NOT NULL OR name NOT IN (SELECT name FROM {_INVENTORY} WHERE version IS NOT NULL)")
def inventory_known(spark, d):
    return sca.known_only(_inventory(spark, d)).select("ecosystem", "name", "version")


_VECTOR = "concat('CVSS:3.1/AV:', (['N','A','L','P'])[c_custkey % 4 + 1], '/AC:', (['L','H'])[c_custkey % 2 + 1], '/PR:', (['N','L','H'])[c_custkey % 3 + 1], '/UI:', (['N','R'])[CAST(floor(c_custkey / 2) AS BIGINT) % 2 + 1], '/S:', (['U','C'])[CAST(floor(c_custkey / 4) AS BIGINT) % 2 + 1], '/C:', (['H','L','N'])[CAST(floor(c_custkey / 3) AS BIGINT) % 3 + 1], '/I:', (['H','L','N'])[CAST(floor(c_custkey / 9) AS BIGINT) % 3 + 1], '/A:', (['H','L','N'])[CAST(floor(c_custkey / 27) AS BIGINT) % 3 + 1])"
_PART = "CASE regexp_extract(v, '/{0}:([A-Z])', 1) {1} END"
_case = lambda m, t: _PART.format(m, " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in t.items()))
_SCORE = f"""(SELECT c_custkey, v, CASE WHEN impact <= 0 THEN 0.0 ELSE (CASE WHEN w % 10000 = 0 THEN w / 100000 ELSE (floor(w / 10000) + 1) / 10 END) END AS score FROM (
  SELECT *, CAST(round(least(CASE WHEN s THEN 1.08::DOUBLE * (impact + exploit) ELSE impact + exploit END, 10.0::DOUBLE) * 100000) AS BIGINT) AS w FROM (
  SELECT *, CASE WHEN s THEN 7.52::DOUBLE * (iss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(iss - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * iss END AS impact, 8.22::DOUBLE * av * ac * (CASE WHEN s THEN prc ELSE pru END) * ui AS exploit FROM (
  SELECT c_custkey, v, regexp_extract(v, '/S:([A-Z])', 1) = 'C' AS s, 1 - (1 - {_case("C", cvss.WEIGHTS["CIA"])}) * (1 - {_case("I", cvss.WEIGHTS["CIA"])}) * (1 - {_case("A", cvss.WEIGHTS["CIA"])}) AS iss,
    {_case("AV", cvss.WEIGHTS["AV"])} AS av, {_case("AC", cvss.WEIGHTS["AC"])} AS ac, {_case("UI", cvss.WEIGHTS["UI"])} AS ui, {_case("PR", cvss.WEIGHTS["PR_U"])} AS pru, {_case("PR", cvss.WEIGHTS["PR_C"])} AS prc
  FROM (SELECT c_custkey, {_VECTOR} AS v FROM customer)))))"""


def _vectors(spark, d, *keep):
    k = F.col("c_custkey")
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", *keep, F.concat(F.lit("CVSS:3.1/AV:"), at("NALP", k % 4), F.lit("/AC:"), at("LH", k % 2), F.lit("/PR:"), at("NLH", k % 3), F.lit("/UI:"), at("NR", F.floor(k / 2) % 2), F.lit("/S:"), at("UC", F.floor(k / 4) % 2), F.lit("/C:"), at("HLN", F.floor(k / 3) % 3), F.lit("/I:"), at("HLN", F.floor(k / 9) % 3), F.lit("/A:"), at("HLN", F.floor(k / 27) % 3)).alias("v"))


@query(f"SELECT c_custkey, v AS vector, round(score, 1) AS score FROM {_SCORE}")
def cvss_score(spark, d):
    return _vectors(spark, d).select("c_custkey", F.col("v").alias("vector"), F.round(cvss.base_score(F.col("v")), 1).alias("score"))


@query(f"SELECT severity, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN 'BLOCKER' WHEN c_custkey % 5 <> 0 AND score >= 9 THEN 'CRITICAL' WHEN c_custkey % 5 <> 0 AND score >= 7 THEN 'MAJOR' WHEN c_mktsegment = 'BUILDING' THEN 'CRITICAL' WHEN c_mktsegment = 'MACHINERY' THEN 'MAJOR' ELSE 'MINOR' END AS severity FROM {_SCORE} JOIN customer USING (c_custkey)) GROUP BY severity")
def sca_severity(spark, d):
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    v = _vectors(spark, d, "c_mktsegment").withColumn("score", F.when(k % 5 != 0, cvss.base_score(F.col("v"))))
    label = F.when(segment == "BUILDING", "critical").when(segment == "MACHINERY", "High").when(segment == "FURNITURE", "medium")
    return v.select(cvss.severity(k % 13 == 0, k % 17 == 0, F.col("score"), label).alias("severity")).groupBy("severity").agg(F.count("*").alias("n"))


_EDGES = "(SELECT s_suppkey AS id, s_suppkey + 1 AS alias FROM supplier WHERE s_nationkey % 3 = 0)"
_COMPONENTS = f"(WITH RECURSIVE e AS (SELECT id, alias FROM {_EDGES} UNION SELECT alias, id FROM {_EDGES}), r AS (SELECT id, id AS component FROM e UNION SELECT e.alias, r.component FROM r JOIN e ON e.id = r.id) SELECT id, min(component) AS component FROM r GROUP BY id)"


def _edges(spark, d):
    return table(spark, d, "supplier").filter("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + 1).alias("alias"))


@query(f"SELECT id, component FROM {_COMPONENTS}")
def alias_components(spark, d):
    return sca.alias_components(_edges(spark, d))


@query(f"""WITH r AS (SELECT s_suppkey AS id, concat(CASE s_suppkey % 3 WHEN 0 THEN 'CVE-' WHEN 1 THEN 'GHSA-' ELSE 'GO-' END, s_suppkey) AS label, round(s_acctbal / 1000, 1) AS cvss, s_nationkey AS published FROM supplier),
  n AS (SELECT r.*, coalesce(component, r.id) AS component, CASE WHEN label LIKE 'CVE-%' THEN 0 WHEN label LIKE 'GHSA-%' THEN 1 ELSE 4 END AS rank FROM r LEFT JOIN {_COMPONENTS} c USING (id))
  SELECT component, arg_min(label, (rank, label)) AS best_id, max(cvss) AS cvss, min(published) AS published, count(*) AS n_records, count(*) FILTER (id % 5 = 0) > 0 AS known_exploited, min(CASE WHEN id % 5 = 0 THEN id END) AS due, max(CASE WHEN id % 2 = 0 THEN id / 1000.0::DOUBLE END) AS epss FROM n GROUP BY component""")
def feed_merge(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    records = s.select(k.alias("id"), F.concat(F.when(k % 3 == 0, "CVE-").when(k % 3 == 1, "GHSA-").otherwise("GO-"), k).alias("label"), F.round(F.col("s_acctbal") / 1000, 1).alias("cvss"), F.col("s_nationkey").alias("published"))
    kev = s.filter("s_suppkey % 5 = 0").select(k.alias("id"), k.alias("due"))
    epss = s.filter("s_suppkey % 2 = 0").select(k.alias("id"), (k / 1000.0).alias("epss"))
    return sca.merge_feeds(records, kev, epss, alias_components(spark, d))


_OSV = "(SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'fixed' ELSE 'introduced' END AS kind, o_orderkey AS pos FROM orders)"


@query(f"WITH t AS (SELECT *, lag(kind) OVER (PARTITION BY o_custkey ORDER BY pos) AS last FROM {_OSV}), u AS (SELECT * FROM t WHERE (last IS NULL AND kind = 'introduced') OR last <> kind), v AS (SELECT o_custkey, kind, pos AS from_at, lead(pos) OVER (PARTITION BY o_custkey ORDER BY pos) AS to_at FROM u) SELECT o_custkey, from_at, to_at FROM v WHERE kind = 'introduced'")
def osv_intervals(spark, d):
    e = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "fixed").otherwise("introduced").alias("kind"), F.col("o_orderkey").alias("at"))
    return sca.intervals(e, ["o_custkey"], ["at"])


# --- histories -----------------------------------------------------------------------------------------------------

_MAJOR = "CASE WHEN o_orderkey % 37 = 0 THEN 100 + o_orderkey % 300 WHEN o_orderkey % 41 = 0 THEN 2024 ELSE o_orderkey % 9 END"


@query(f"WITH r AS (SELECT o_custkey, o_orderkey, {_MAJOR} AS major, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS p FROM orders), w AS (SELECT *, max(major) OVER (PARTITION BY o_custkey ORDER BY p ASC NULLS FIRST, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_before FROM r) SELECT o_orderkey, major, high_before, NOT (high_before IS NOT NULL AND major - high_before < 50) AS new_inflation FROM w WHERE major >= 99 AND NOT (major BETWEEN 1990 AND 2100 OR major BETWEEN 19900101 AND 21001231)")
def inflated_version(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select("o_custkey", k, F.when(k % 37 == 0, 100 + k % 300).when(k % 41 == 0, 2024).otherwise(k % 9).alias("major"), F.when(k % 17 != 0, F.col("o_orderdate")).alias("published_at"), k.alias("pos"))
    return history.inflated(r, "o_custkey").filter("inflated").select("o_orderkey", "major", "high_before", "new_inflation")


@query("WITH a AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOURS FOLLOWING) AS ahead FROM events) SELECT event_id, max(ahead) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS most, max(ahead) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) > 5 AS flood FROM a")
def release_flood(spark, d):
    return history.flood(table(spark, d, "events"), "user_id", "ts", 5).select("event_id", "most", "flood")


@query("SELECT o_orderkey, (SELECT p.o_orderkey FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate <= o.o_orderdate - INTERVAL 7 DAYS ORDER BY p.o_orderdate DESC, p.o_orderkey DESC LIMIT 1) AS prior_id FROM orders o")
def prior_release_asof(spark, d):
    return history.prior(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "prior_id")


@query("SELECT p.event_id, count(*) AS yanks FROM events p JOIN events y ON p.user_id = y.user_id AND p.event_type = 'purchase' AND y.event_type = 'error' AND abs(epoch_us(p.ts) - epoch_us(y.ts)) <= 86400000000 GROUP BY p.event_id HAVING count(*) >= 2")
def yank_to_push(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    pushed = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("us").alias("l_us"))
    yanked = e.filter("event_type = 'error'").select("user_id", F.col("us").alias("r_us"))
    return history.near_in_time(pushed, yanked, "user_id", 86_400).groupBy("event_id").agg(F.count("*").alias("yanks")).filter("yanks >= 2")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS action FROM events GROUP BY user_id")
def last_state(spark, d):
    return history.last_state(table(spark, d, "events").withColumnRenamed("event_type", "action"), ["user_id"], ["ts", "event_id"])


@query("WITH b AS (SELECT *, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, count(*) FILTER (n > 1 AND (s <> o_orderstatus OR p <> o_orderpriority)) AS changes FROM b GROUP BY o_custkey")
def identity_changes(spark, d):
    c = history.changed_identity(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return c.groupBy("o_custkey").agg(F.count_if("changed").alias("changes"))


@query("SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_at, count(*) AS n_versions, date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '1997-01-01') > 365 AND count(*) >= 3 AS established FROM orders GROUP BY o_custkey")
def established_history(spark, d):
    return history.established(table(spark, d, "orders"), "o_custkey", "o_orderdate", "1997-01-01").withColumn("first_at", stamp("first_at"))


# --- names ---------------------------------------------------------------------------------------------------------

_ALTERED = "CASE p_partkey % 5 WHEN 0 THEN concat(substr(p_name, 1, 1), substr(p_name, 3)) WHEN 1 THEN concat(substr(p_name, 1, 3), substr(p_name, 3)) WHEN 2 THEN concat(substr(p_name, 1, 1), substr(p_name, 3, 1), substr(p_name, 2, 1), substr(p_name, 4)) WHEN 3 THEN concat('x', substr(p_name, 2)) ELSE p_name END"
_TARGETS = "(SELECT p_name AS target, row_number() OVER (ORDER BY count(*) DESC, p_name) AS rank FROM part GROUP BY p_name)"


@query(f"SELECT name, arg_min(target, (rank, target)) AS target FROM (SELECT DISTINCT {_ALTERED} AS name FROM part) n JOIN {_TARGETS} t ON length(target) >= 5 AND name <> target AND damerau_levenshtein(name, target) = 1 GROUP BY name")
def lookalike_names(spark, d):
    p = table(spark, d, "part")
    s = lambda a, n=1000: F.substring("p_name", a, n)
    k = F.col("p_partkey") % 5
    altered = F.when(k == 0, F.concat(s(1, 1), s(3))).when(k == 1, F.concat(s(1, 3), s(3))).when(k == 2, F.concat(s(1, 1), s(3, 1), s(2, 1), s(4))).when(k == 3, F.concat(F.lit("x"), s(2))).otherwise(F.col("p_name"))
    targets = p.groupBy(F.col("p_name").alias("target")).agg((-F.count("*")).alias("rank"))
    return names.lookalikes(p.select(altered.alias("name")), targets)


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') AS name_key FROM supplier")
def name_normalize(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.normalise_name(F.col("s_name")).alias("name_key"))


_DECLARED = "(SELECT DISTINCT l_suppkey, concat((['', 'python-', ''])[l_partkey % 3 + 1], p_name, (['', '', '-python'])[l_partkey % 3 + 1]) AS name, l_partkey % 3 AS kind, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)"
_IMPORTED = "(SELECT DISTINCT l_suppkey, replace(p_name, ' ', '_') AS module FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' AND l_linenumber < 3)"


@query(f"SELECT l_suppkey, name, row_number() OVER (PARTITION BY l_suppkey ORDER BY name) AS place FROM {_DECLARED} d WHERE NOT EXISTS (SELECT 1 FROM {_IMPORTED} i WHERE i.l_suppkey = d.l_suppkey AND i.module = replace(d.p_name, ' ', '_'))")
def unused_dependencies(spark, d):
    """Declared names, some with an affix that the module lacks, of which no form is imported; in their order."""
    used = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    k = F.col("l_partkey") % 3
    declared = used.select("l_suppkey", F.when(k == 1, F.concat(F.lit("python-"), "p_name")).when(k == 2, F.concat("p_name", F.lit("-python"))).otherwise(F.col("p_name")).alias("name")).distinct()
    imported = used.filter("l_returnflag != 'N' and l_linenumber < 3").select("l_suppkey", F.regexp_replace("p_name", " ", "_").alias("module"))
    left = names.unused_by_import(declared, imported, "l_suppkey")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("name")).cast("long"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('7:', event_id)), event_id) AS n FROM events) WHERE n <= 25")
def stratified_sample(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.md5(F.concat(F.lit("7:"), F.col("event_id"))), "event_id")
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).filter("n <= 25").select("event_type", "event_id")


@query("SELECT l_suppkey, l_partkey, qty, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey) AS n FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) GROUP BY l_suppkey, l_partkey)) WHERE n <= 3")
def top_parts_less_excluded(spark, d):
    out = table(spark, d, "part").filter("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    q = table(spark, d, "lineitem").join(out, "l_partkey", "left_anti").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return q.withColumn("place", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("qty"), "l_partkey"))).filter("place <= 3").select("l_suppkey", "l_partkey", "qty", "place")


@query("WITH q AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS new FROM events WHERE event_type <> 'view') SELECT user_id, event_id, CASE WHEN old <= 3 THEN 'late' ELSE 'fresh' END AS share FROM q WHERE old <= 3 OR new <= 9")
def late_quota(spark, d):
    """A quarter of a budget of twelve goes to the oldest, the rest to the newest."""
    e = table(spark, d, "events").filter("event_type != 'view'")
    w = Window.partitionBy("user_id")
    q = e.withColumn("old", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("new", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))))
    return q.filter("old <= 3 or new <= 9").select("user_id", "event_id", F.when(F.col("old") <= 3, "late").otherwise("fresh").alias("share"))


# --- events as streams (their batch form) ------------------------------------------------------------------------------


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(stamp("w.start").alias("hour"), "event_type", "n", "total")


@query("SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n FROM events, range(0, 6) AS r(k) GROUP BY ALL")
def event_sliding(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "6 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(stamp("w.start").alias("hour"), "n")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begun, count(*) AS n FROM s GROUP BY user_id, k")
def event_session(spark, d):
    return table(spark, d, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", stamp("w.start").alias("begun"), "n")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def event_first_seen(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), a AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour) SELECT strftime(a.hour, '%Y-%m-%d %H:%M:%S') AS hour, coalesce(n, 0) AS n, n IS NULL AS missing FROM a LEFT JOIN h USING (hour) WHERE coalesce(n, 0) < 10")
def thin_hours(spark, d):
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"))
    every = h.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return every.join(h, "hour", "left").select(stamp("hour").alias("hour"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing")).filter("n < 10")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def event_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k > 50")


@query("SELECT r_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, o_orderpriority)")
def revenue_rollup(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query()
def normalize_unicode(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.unicode_nfkc("text")).alias("nfkc"))
