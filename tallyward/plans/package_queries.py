"""Queries on packages, sets, ranks and histories, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyward.functions import text, versions
from tallyward.operators import findings as fd
from tallyward.operators import packages as pk
from tallyward.operators import sca
from tallyward.plans import queries as base
from tallyward.plans.queries import _AFFECTED, _FOUND, _INVENTORY, query, table

# --- sets ----------------------------------------------------------------------------------------------------------


@query("WITH u AS (SELECT s_nationkey AS nation, s_name AS name, s_acctbal AS balance, 0 AS part FROM supplier UNION ALL SELECT c_nationkey, replace(c_name, 'Customer', 'Supplier'), c_acctbal, 1 FROM customer) SELECT nation, name, arg_min(balance, (part, balance)) AS balance FROM u GROUP BY nation, name")
def inventories_united(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.regexp_replace("c_name", "Customer", "Supplier").alias("name"), F.col("c_acctbal").alias("balance"))
    return pk.united([s, c], ["nation", "name"])


@query(f"SELECT DISTINCT doc_id, rule, severity FROM (SELECT doc_id, rule, severity FROM {_FOUND} UNION ALL SELECT doc_id, 'T-LICENSE', 'INFO' FROM documents WHERE regexp_matches(text, 'Licensed under|Released under') UNION ALL SELECT doc_id, 'T-LONG', 'MINOR' FROM documents WHERE length(text) > 5000)")
def findings_of_all_passes(spark, d):
    docs = table(spark, d, "documents")
    lines = fd.scan_lines(docs).select("doc_id", "rule", "severity")
    whole = fd.scan_whole_text(docs, "Licensed under|Released under").select("doc_id", F.lit("T-LICENSE").alias("rule"), F.lit("INFO").alias("severity"))
    long = docs.filter(F.length("text") > 5000).select("doc_id", F.lit("T-LONG").alias("rule"), F.lit("MINOR").alias("severity"))
    return lines.unionByName(whole).unionByName(long).distinct()


@query("SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def ids_in_common(spark, d):
    l = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "part")  # noqa: E741
    return pk.common(l.filter("l_returnflag = 'R'"), l.filter("l_linestatus = 'F'"), ["part"])


@query("WITH a AS (SELECT DISTINCT l_suppkey AS supplier, l_partkey AS part FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_suppkey AS supplier, l_partkey AS part FROM lineitem WHERE l_linenumber = 2), j AS (SELECT coalesce(a.supplier, b.supplier) AS supplier, a.part AS x, b.part AS y FROM a FULL JOIN b ON a.supplier = b.supplier AND a.part = b.part) SELECT supplier, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS in_both FROM j GROUP BY supplier")
def symmetric_difference(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), "l_linenumber")  # noqa: E741
    return pk.difference_counts(l.filter("l_linenumber = 1"), l.filter("l_linenumber = 2"), ["part"], "supplier")


@query("WITH r AS (SELECT l_suppkey AS supplier, l_partkey % 500 AS low, l_partkey % 500 + CAST(l_quantity AS BIGINT) % 9 AS high FROM lineitem), o AS (SELECT *, max(high) OVER (PARTITION BY supplier ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE low < high), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR low > reach THEN 1 ELSE 0 END) OVER (PARTITION BY supplier ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS grp FROM o) SELECT supplier, min(low) AS low, max(high) AS high FROM g GROUP BY supplier, grp")
def ranges_merged(spark, d):
    p = F.col("l_partkey") % 500
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), p.alias("low"), (p + F.col("l_quantity").cast("long") % 9).alias("high"))
    return pk.merged_ranges(r, ["supplier"])


# --- ranks and limits ----------------------------------------------------------------------------------------------


@query("WITH u AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM u), f AS (SELECT user_id, min((rank, event_type)) AS turn FROM r GROUP BY user_id), t AS (SELECT *, row_number() OVER (ORDER BY turn, user_id) AS place FROM f) SELECT CAST(place AS INTEGER) AS place, user_id FROM t WHERE place <= 40")
def lists_by_turns(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")
    r = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w))
    return pk.round_robin(r, "event_type", "rank", "user_id", 40)


@query("SELECT o_custkey, n, first_at FROM (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_at FROM orders GROUP BY o_custkey) ORDER BY n DESC, first_at LIMIT 50")
def ranked_targets(spark, d):
    """The fifty customers with most orders, each once, those seen first before others."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_at")).orderBy(F.desc("n"), "first_at").limit(50)


@query(f"SELECT source, doc_id, CAST(line_no AS BIGINT) AS line_no, rule FROM {_FOUND} ORDER BY source, doc_id, line_no, rule LIMIT 200")
def terminal_order(spark, d):
    return fd.scan_lines(table(spark, d, "documents")).select("source", "doc_id", "line_no", "rule").orderBy("source", "doc_id", "line_no", "rule").limit(200)


@query("SELECT o_custkey, o_orderkey, CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(percent_rank() OVER w, 6) AS part, round(cume_dist() OVER w, 6) AS share, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, CAST(dense_rank() OVER w AS INTEGER) AS dense FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def rank_functions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("part"), F.round(F.cume_dist().over(w), 6).alias("share"), F.nth_value("o_orderkey", 2).over(whole).alias("second"), F.dense_rank().over(w).alias("dense"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(grouping(o_orderpriority) AS INTEGER) AS every_priority, CAST(grouping(o_orderstatus) AS INTEGER) AS every_status FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def order_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping("o_orderpriority").cast("int").alias("every_priority"), F.grouping("o_orderstatus").cast("int").alias("every_status"))


@query("SELECT event_type, count(*) AS n, true AS close FROM events GROUP BY event_type")
def approximate_users(spark, d):
    """Whether an approximate count of users is within a twentieth of the exact one, by kind of event."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.01).alias("about"), F.count_distinct("user_id").alias("exact"))
    return e.select("event_type", "n", (F.abs(F.col("about") - F.col("exact")) * 20 <= F.col("exact")).alias("close"))


# --- counts --------------------------------------------------------------------------------------------------------


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN version IS NULL THEN 'no version' WHEN version LIKE '%*%' THEN 'wildcard' WHEN NOT regexp_matches(version, '[0-9]') THEN 'tag' WHEN ecosystem = 'go' AND NOT starts_with(version, 'v') THEN 'go without v' END AS kind FROM {_INVENTORY}) WHERE kind IS NOT NULL GROUP BY kind")
def warnings_by_kind(spark, d):
    v = F.col("version")
    kind = F.when(v.isNull(), "no version").when(v.contains("*"), "wildcard").when(~v.rlike("[0-9]"), "tag").when((F.col("ecosystem") == "go") & ~v.startswith("v"), "go without v")
    return base._inventory(spark, d).select(kind.alias("kind")).filter("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT ecosystem, name, max(list_position(['CLEAR','UNKNOWN','AFFECTED'], verdict)) AS worst, count(DISTINCT cve) FILTER (verdict = 'AFFECTED') AS cves FROM {base._MATCH} GROUP BY ecosystem, name), i AS (SELECT ecosystem, name, count(*) AS versions FROM {_INVENTORY} GROUP BY ALL)
  SELECT ecosystem, count(*) AS packages, CAST(sum(versions) AS BIGINT) AS rows_, count(*) FILTER (worst = 3) AS affected, count(*) FILTER (worst = 2) AS undecided, CAST(coalesce(sum(cves), 0) AS BIGINT) AS advisories, count(*) FILTER (worst = 3) = 0 AS passed FROM i LEFT JOIN m USING (ecosystem, name) GROUP BY ecosystem""")
def sca_result(spark, d):
    m = base.sca_match(spark, d).groupBy("ecosystem", "name").agg(F.max(F.array_position(F.array(*map(F.lit, ("CLEAR", "UNKNOWN", "AFFECTED"))), F.col("verdict"))).alias("worst"), F.count_distinct(F.when(F.col("verdict") == "AFFECTED", F.col("cve"))).alias("cves"))
    i = base._inventory(spark, d).groupBy("ecosystem", "name").agg(F.count("*").alias("versions"))
    affected = F.count_if(F.col("worst") == 3)
    return i.join(m, ["ecosystem", "name"], "left").groupBy("ecosystem").agg(F.count("*").alias("packages"), F.sum("versions").alias("rows_"), affected.alias("affected"), F.count_if(F.col("worst") == 2).alias("undecided"), F.coalesce(F.sum("cves"), F.lit(0)).alias("advisories"), (affected == 0).alias("passed"))


@query("SELECT o_orderpriority AS before, CASE WHEN l_returnflag = 'R' THEN 'found' WHEN l_linestatus = 'F' THEN 'kept' ELSE 'new' END AS outcome, count(*) AS n, count(DISTINCT o_custkey) AS packages FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def outcome_counts(spark, d):
    outcome = F.when(F.col("l_returnflag") == "R", "found").when(F.col("l_linestatus") == "F", "kept").otherwise("new")
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy(F.col("o_orderpriority").alias("before"), outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("packages"))


@query(f"SELECT * FROM (SELECT source, doc_id, CAST(line_no AS BIGINT) AS line_no, CASE WHEN rule LIKE 'S-%' THEN 'SC-' || rule ELSE rule END AS rule, type, severity FROM {_FOUND}) WHERE (rule LIKE 'SC-%' AND severity <> 'INFO') OR rule LIKE 'X-%' OR (type = 'VULN' AND severity IN ('BLOCKER','CRITICAL','MAJOR'))")
def findings_shown(spark, d):
    f = fd.scan_lines(table(spark, d, "documents")).select("source", "doc_id", "line_no", F.when(F.col("rule").startswith("S-"), F.concat(F.lit("SC-"), "rule")).otherwise(F.col("rule")).alias("rule"), "type", "severity")
    return fd.shown(f)


# --- joins ---------------------------------------------------------------------------------------------------------


@query(f"WITH i AS (SELECT DISTINCT ecosystem, name_key, name, replace(name_key, '-', '') AS loose FROM {_INVENTORY}), a AS (SELECT DISTINCT cve, ecosystem, name_key, replace(name_key, '-', '') AS loose FROM {_AFFECTED}) SELECT name, cve FROM i JOIN a USING (ecosystem, name_key) UNION SELECT name, cve FROM i JOIN a USING (loose)")
def advisories_of_packages(spark, d):
    loose = F.regexp_replace("name_key", "-", "").alias("loose_key")
    i = base._inventory(spark, d).select("ecosystem", "name_key", "name", loose).distinct()
    a = base._affected(spark, d).select("cve", "ecosystem", "name_key", loose).distinct()
    return sca.advisories_for(i, a.select("cve", "ecosystem", "name_key"), a.select("cve", "loose_key"))


@query("WITH p AS (SELECT o_custkey, o_orderkey AS at FROM orders), s AS (SELECT o_custkey, o_orderkey - 40 AS from_at, CASE WHEN o_orderstatus = 'O' THEN o_orderkey + 60 ELSE o_orderkey - 10 END AS to_at FROM orders WHERE o_orderkey % 3 = 0) SELECT o_custkey, p.at AS point FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = p.o_custkey AND p.at >= from_at AND p.at < to_at)")
def uncovered_points(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    spans = o.filter(k % 3 == 0).select("o_custkey", (k - 40).alias("from_at"), F.when(F.col("o_orderstatus") == "O", k + 60).otherwise(k - 10).alias("to_at"))
    return sca.uncovered(o.select("o_custkey", k.alias("at")), spans, ["o_custkey"]).withColumnRenamed("at", "point")


_REPOS = "(SELECT p_partkey AS id, 'owner' || p_partkey % 7 AS owner, p_type AS name, concat(p_brand, ' - ', p_size % 5, '!') AS about, p_size * 100 + p_partkey % 100 AS created FROM part)"


@query(f"WITH k AS (SELECT *, lower(name) AS n, trim(regexp_replace(lower(about), '[^a-z0-9]+', ' ', 'g'), ' ') AS a FROM {_REPOS}), f AS (SELECT n, a, min((created, id, owner)) AS first FROM k GROUP BY n, a) SELECT name, id, first[2] AS copy_of FROM k JOIN f USING (n, a) WHERE owner <> first[3]")
def copied_repositories(spark, d):
    k = F.col("p_partkey")
    return pk.copies(table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("owner"), k % 7).alias("owner"), F.col("p_type").alias("name"), F.concat("p_brand", F.lit(" - "), F.col("p_size") % 5, F.lit("!")).alias("about"), (F.col("p_size") * 100 + k % 100).alias("created")))


_OWNERS = "(['google','gogle','googel','gooogle','mozilla','mozila','apache'])"


@query(f"WITH n AS (SELECT DISTINCT {_OWNERS}[p_partkey % 7 + 1] AS owner, p_brand AS name FROM part), k AS (SELECT DISTINCT owner AS target, name FROM n WHERE owner IN ('google','mozilla','apache')) SELECT DISTINCT owner, name, target FROM n JOIN k USING (name) WHERE owner <> target AND damerau_levenshtein(owner, target) = 1")
def owner_lookalikes(spark, d):
    owner = F.element_at(F.array(*map(F.lit, ("google", "gogle", "googel", "gooogle", "mozilla", "mozila", "apache"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    n = table(spark, d, "part").select(owner.alias("owner"), F.col("p_brand").alias("name"))
    return pk.owner_lookalikes(n, n.filter(F.col("owner").isin("google", "mozilla", "apache")))


@query("WITH n AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '-') ELSE upper(replace(p_name, ' ', '_')) END AS name FROM (SELECT p_partkey, (SELECT min(q.p_name) FROM part q WHERE q.p_partkey % 40 = p.p_partkey % 40) AS p_name FROM part p)), k AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key FROM n), t AS (SELECT key, min(name) AS twin FROM k GROUP BY key HAVING count(*) > 1) SELECT name, twin FROM k JOIN t USING (key) WHERE name <> twin")
def separator_twins(spark, d):
    p = table(spark, d, "part")
    least = p.groupBy((F.col("p_partkey") % 40).alias("g")).agg(F.min("p_name").alias("p_name"))
    k = F.col("p_partkey") % 3
    n = p.select("p_partkey", (F.col("p_partkey") % 40).alias("g")).join(least, "g").select(F.when(k == 0, F.col("p_name")).when(k == 1, F.regexp_replace("p_name", " ", "-")).otherwise(F.upper(F.regexp_replace("p_name", " ", "_"))).alias("name"))
    return pk.separator_twins(n)


_SIGHTINGS = "(SELECT user_id AS repo, event_type AS tag, md5(CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR)) AS sha, epoch_us(ts) * 1000 + event_id % 1000 AS seen FROM events)"


@query(f"WITH l AS (SELECT *, lag(sha) OVER (PARTITION BY repo, tag ORDER BY seen, sha) AS before FROM {_SIGHTINGS}) SELECT repo, tag, arg_min(sha, (seen, sha)) AS first_sha, arg_max(sha, (seen, sha)) AS last_sha, count(*) FILTER (before <> sha) AS moves FROM l GROUP BY repo, tag HAVING count(*) FILTER (before <> sha) > 0")
def tags_moved(spark, d):
    sha = F.md5((F.floor("value").cast("long") % 3).cast("string"))
    e = table(spark, d, "events").select(F.col("user_id").alias("repo"), F.col("event_type").alias("tag"), sha.alias("sha"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("at"))
    return pk.moved_tags(e, ["repo", "tag"])


_SHA = "substr(sha256(CAST({0} AS VARCHAR)), 1, 40)"


@query(f"""WITH u AS (SELECT p_partkey AS id, p_size % 10 AS repo, CASE p_partkey % 4 WHEN 0 THEN 'v4' WHEN 1 THEN {_SHA.format('(p_size % 10)')} WHEN 2 THEN {_SHA.format('(p_size % 10 + 100)')} ELSE {_SHA.format('(p_partkey + 7000)')} END AS ref, 'v' || (p_partkey % 3) AS comment FROM part)
  SELECT id, CASE WHEN ref = 'v4' THEN 'unpinned' WHEN ref NOT IN ({_SHA.format('repo')}, {_SHA.format('(repo + 100)')}) THEN 'impostor' WHEN comment = 'v1' AND ref <> {_SHA.format('repo')} THEN 'mismatch' WHEN comment = 'v2' AND ref <> {_SHA.format('(repo + 100)')} THEN 'mismatch' ELSE 'pinned' END AS state FROM u""")
def action_pins(spark, d):
    k, repo = F.col("p_partkey"), F.col("p_size") % 10
    sha = lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 40)
    uses = table(spark, d, "part").select(k.alias("id"), repo.alias("repo"), F.when(k % 4 == 0, "v4").when(k % 4 == 1, sha(repo)).when(k % 4 == 2, sha(repo + 100)).otherwise(sha(k + 7000)).alias("ref"), F.concat(F.lit("v"), k % 3).alias("comment"))
    ten = spark.range(10).select(F.col("id").alias("repo"))
    commits = ten.select("repo", F.explode(F.array(sha(F.col("repo")), sha(F.col("repo") + 100))).alias("sha"))
    tags = ten.select("repo", F.explode(F.array(F.struct(F.lit("v1").alias("tag"), sha(F.col("repo")).alias("sha")), F.struct(F.lit("v2").alias("tag"), sha(F.col("repo") + 100).alias("sha")))).alias("t")).select("repo", "t.*")
    return pk.pin_states(uses, tags, commits)


_WHEEL = "concat('pkg', p_partkey % 5, '-1.', p_size, (['','-1'])[p_partkey % 2 + 1], '-', (['py3','cp312','cp311'])[p_partkey % 3 + 1], '-', (['none','abi3'])[p_partkey % 2 + 1], '-', (['any','manylinux_2_17_x86_64','win_amd64'])[p_size % 3 + 1], (['.whl','.zip'])[CAST(p_partkey % 7 = 0 AS INTEGER) + 1])"


@query(f"WITH f AS (SELECT p_partkey, {_WHEEL} AS f FROM part), s AS (SELECT p_partkey, f, string_split(regexp_replace(f, '[.]whl$', ''), '-') AS p FROM f) SELECT p_partkey, CASE WHEN f LIKE '%.whl' THEN p[2] END AS version, CASE WHEN f LIKE '%.whl' THEN p[-3] END AS python, CASE WHEN f LIKE '%.whl' THEN p[-1] END AS platform, CASE WHEN f LIKE '%.whl' AND len(p) = 6 THEN p[3] END AS build FROM s")
def wheel_files(spark, d):
    k = F.col("p_partkey")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    f = F.concat(F.lit("pkg"), k % 5, F.lit("-1."), "p_size", at(("", "-1"), k % 2), F.lit("-"), at(("py3", "cp312", "cp311"), k % 3), F.lit("-"), at(("none", "abi3"), k % 2), F.lit("-"), at(("any", "manylinux_2_17_x86_64", "win_amd64"), F.col("p_size") % 3), F.when(k % 7 == 0, ".zip").otherwise(".whl"))
    return table(spark, d, "part").select(k, pk.wheel_tags(f).alias("w")).select("p_partkey", "w.version", "w.python", "w.platform", "w.build")


# Packages are customers' numbers; file 0 of each is run by its hook, and files import others of theirs.
_STEPS = "(SELECT o_custkey % 200 AS package, o_orderkey % 23 AS a, (o_orderkey * 7 + o_custkey) % 23 AS b FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"WITH RECURSIVE s AS (SELECT DISTINCT package, a, b FROM {_STEPS}), r AS (SELECT DISTINCT package, 0 AS f FROM s UNION SELECT s.package, s.b FROM r JOIN s ON s.package = r.package AND s.a = r.f) SELECT package, concat('f', f, '.js') AS file FROM r")
def dependency_run_plan(spark, d):
    """Which files of a package run when its hook does: those that the hook's file reaches by imports."""
    o, file = table(spark, d, "orders").filter("o_orderkey % 3 = 0"), lambda c: F.concat(F.lit("f"), c, F.lit(".js"))
    package = F.col("o_custkey") % 200
    imports = o.select(package.alias("package"), file(F.col("o_orderkey") % 23).alias("file"), F.concat(F.lit("./f"), (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 23).alias("module"))
    files = imports.select("package", "file").unionByName(imports.select("package", F.concat(F.substring("module", 3, 9), F.lit(".js")).alias("file"))).distinct()
    hooks = imports.select("package").distinct().withColumn("command", F.lit("echo start && node ./f0.js --quiet"))
    starts = pk.hook_targets(hooks).select("package", "file")
    return pk.reachable(starts, pk.resolved_imports(imports, files)).select("package", "file")


@query(f"SELECT DISTINCT package, concat('f', a, '.js') AS file, concat('f', b, '.js') AS target FROM {_STEPS}")
def cross_file_imports(spark, d):
    o, file = table(spark, d, "orders").filter("o_orderkey % 3 = 0"), lambda c: F.concat(F.lit("f"), c, F.lit(".js"))
    package, b = F.col("o_custkey") % 200, (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 23
    imports = o.select(package.alias("package"), file(F.col("o_orderkey") % 23).alias("file"), F.concat(F.lit("./f"), b).alias("module"))
    return pk.resolved_imports(imports, o.select(package.alias("package"), F.explode(F.array(file(F.col("o_orderkey") % 23), file(b))).alias("file")))


_FACTS = "(SELECT l_orderkey AS file, l_linenumber AS line_no, (['source','copy','clean','sink','copy','sink'])[l_partkey % 6 + 1] AS kind, 'v' || l_suppkey % 3 AS variable, 'v' || l_partkey % 3 AS of FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL))"


@query(f"""WITH RECURSIVE f AS (SELECT * FROM {_FACTS}), a AS (SELECT * FROM f WHERE kind <> 'sink'),
  seen AS (SELECT u.file, u.line_no, u.kind, u.variable, (SELECT max(a.line_no) FROM a WHERE a.file = u.file AND a.line_no < u.line_no AND a.variable = CASE WHEN u.kind = 'copy' THEN u.of ELSE u.variable END) AS from_line FROM f u WHERE kind IN ('sink', 'copy')),
  t AS (SELECT file, line_no FROM f WHERE kind = 'source' UNION SELECT s.file, s.line_no FROM t JOIN seen s ON s.file = t.file AND s.from_line = t.line_no WHERE s.kind = 'copy')
  SELECT DISTINCT s.file, s.line_no, s.variable FROM seen s JOIN t ON s.file = t.file AND s.from_line = t.line_no WHERE s.kind = 'sink'""")
def taint_in_files(spark, d):
    k = F.col("l_partkey")
    kinds = F.element_at(F.array(*map(F.lit, ("source", "copy", "clean", "sink", "copy", "sink"))), (k % 6 + 1).cast("int"))
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    facts = one.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("line_no"), kinds.alias("kind"), F.concat(F.lit("v"), F.col("l_suppkey") % 3).alias("variable"), F.concat(F.lit("v"), k % 3).alias("of"))
    return pk.tainted_sinks(facts).withColumn("line_no", F.col("line_no").cast(table(spark, d, "lineitem").schema["l_linenumber"].dataType))


@query("WITH b AS (SELECT *, o_orderkey % 5 > 0 AS attested, o_orderstatus AS repository, o_orderpriority AS workflow FROM orders), l AS (SELECT *, row_number() OVER w AS n, lag(attested) OVER w AS a, lag(repository) OVER w AS r, lag(workflow) OVER w AS k FROM b WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_orderkey, CASE WHEN a AND NOT attested THEN 'dropped' WHEN NOT a AND attested THEN 'added' WHEN NOT attested THEN 'same' WHEN r <> repository THEN 'takeover' WHEN k <> workflow THEN 'changed' ELSE 'same' END AS change FROM l WHERE n > 1")
def provenance_changes(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 5 > 0).alias("attested"), F.col("o_orderstatus").alias("repository"), F.col("o_orderpriority").alias("workflow"))
    return pk.provenance_changes(o, "o_custkey", ["o_orderdate", "o_orderkey"]).filter("change is not null").select("o_orderkey", "change")


@query("WITH r AS (SELECT user_id AS package, event_id % 3 AS account, event_id AS release, epoch_us(ts) AS at_us, event_id % 4 > 0 AS stable FROM events WHERE event_type = 'purchase'), y AS (SELECT user_id AS package, event_id % 3 AS account, epoch_us(ts) AS at_us FROM events WHERE event_type IN ('error', 'click')) SELECT r.package, release, count(*) AS yanks FROM r JOIN y ON r.package = y.package AND r.account = y.account AND abs(r.at_us - y.at_us) <= 259200000000 WHERE EXISTS (SELECT 1 FROM r s WHERE s.package = r.package AND s.stable AND s.at_us < r.at_us) GROUP BY ALL HAVING count(*) >= 2")
def yanks_by_publisher(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("package"), (F.col("event_id") % 3).alias("account"), F.col("event_id").alias("release"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), (F.col("event_id") % 4 > 0).alias("stable"), "event_type")
    return pk.yanks_by_publisher(e.filter("event_type = 'purchase'"), e.filter("event_type in ('error', 'click')"), hours=72)


@query("WITH f AS (SELECT l_suppkey AS tree, l_partkey AS path, max(l_linenumber) AS digest FROM lineitem WHERE l_linenumber < 5 GROUP BY ALL), m AS (SELECT l_suppkey AS tree, l_partkey AS path, max(l_linenumber) AS listed FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL) SELECT * FROM (SELECT tree, path, CASE WHEN listed IS NULL THEN 'unlisted' WHEN digest IS NULL THEN 'missing' WHEN digest <> listed THEN 'altered' END AS state FROM f FULL JOIN m USING (tree, path)) WHERE state IS NOT NULL")
def vendored_trees(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tree"), F.col("l_partkey").alias("path"), "l_linenumber")  # noqa: E741
    digests = lambda df: df.groupBy("tree", "path").agg(F.max("l_linenumber").alias("digest"))
    return pk.vendored(digests(l.filter("l_linenumber < 5")), digests(l.filter("l_linenumber > 1")))


@query("SELECT p_partkey, sha256(p_name) AS digest FROM part WHERE sha256(p_name) NOT IN (SELECT sha256(p_name) FROM part WHERE p_size < 30)")
def unknown_wrappers(spark, d):
    """Wrapper files whose checksum is on no published list."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.sha2("p_name", 256).alias("digest"))
    return p.join(p.filter("p_size < 30").select("digest").distinct(), "digest", "left_anti").select("p_partkey", "digest")


@query(f"WITH f AS (SELECT source, sha256(rule || '|' || line) AS print FROM {_FOUND}), b AS (SELECT DISTINCT print FROM f WHERE source = 'src0') SELECT 'trusted' AS baseline, count(*) AS n FROM f WHERE source <> 'src0' AND print NOT IN (SELECT print FROM b) UNION ALL SELECT 'untrusted', count(*) FROM f WHERE source <> 'src0'")
def baseline_trust(spark, d):
    f = fd.scan_lines(table(spark, d, "documents")).select("source", F.sha2(F.concat_ws("|", "rule", "line"), 256).alias("print"))
    mine, baseline = f.filter("source != 'src0'"), f.filter("source = 'src0'")
    count = lambda name, trusted: pk.new_against(mine, baseline, trusted).agg(F.lit(name).alias("baseline"), F.count("*").alias("n"))
    return count("trusted", True).unionByName(count("untrusted", False))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, c AS code, CASE WHEN regexp_matches(c, '^([0-9]{1,3}[.]){3}[0-9]{1,3}$') AND list_max(list_transform(string_split(c, '.'), lambda x: CAST(x AS INTEGER))) <= 255 THEN CASE WHEN c LIKE '127.%' THEN 'loopback' WHEN c LIKE '10.%' OR c LIKE '192.168.%' OR regexp_matches(c, '^172[.](1[6-9]|2[0-9]|3[01])[.]') THEN 'private' WHEN c LIKE '169.254.%' THEN 'link-local' WHEN regexp_matches(c, '^(22[4-9]|23[0-9])[.]') THEN 'multicast' WHEN c LIKE '0.%' OR regexp_matches(c, '^(24[0-9]|25[0-5])[.]') THEN 'reserved' ELSE 'public' END END AS kind FROM (SELECT p_partkey, concat((['10.1','127.0','192.168','172.20','172.40','169.254','8.8','230.1','250.9','300.1'])[p_partkey % 10 + 1], '.', p_size, '.', p_partkey % 200) AS c FROM part)")
def address_classes(spark, d):
    k = F.col("p_partkey")
    head = F.element_at(F.array(*map(F.lit, ("10.1", "127.0", "192.168", "172.20", "172.40", "169.254", "8.8", "230.1", "250.9", "300.1"))), (k % 10 + 1).cast("int"))
    a = table(spark, d, "part").select("p_partkey", F.concat_ws(".", head, F.col("p_size").cast("string"), (k % 200).cast("string")).alias("code"))
    return a.withColumn("kind", text.address_class(F.col("code")))


@query(f"SELECT p_partkey, strftime(CAST(t AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS released, date_diff('day', CAST(t AS DATE), DATE '1998-01-01') AS age, strftime(CAST(t AS TIMESTAMP), '%Y-%m-%d-') || CAST(hour(CAST(t AS TIMESTAMP)) AS VARCHAR) AS hour_name FROM (SELECT p_partkey, concat('199', p_partkey % 7, '-0', p_partkey % 9 + 1, '-1', p_size % 10, 'T0', p_size % 10, ':30:00') AS t FROM part)")
def release_ages(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size") % 10
    t = F.concat(F.lit("199"), k % 7, F.lit("-0"), k % 9 + 1, F.lit("-1"), z, F.lit("T0"), z, F.lit(":30:00Z"))
    at = text.iso_time(t)
    return table(spark, d, "part").select("p_partkey", base.stamp(at).alias("released"), F.datediff(F.lit("1998-01-01").cast("date"), at.cast("date")).cast("long").alias("age"), text.hour_name(at).alias("hour_name"))


@query("SELECT p_partkey, regexp_matches(v, '^0x[0-9a-fA-F]{40}$') AS address, regexp_matches(v, '^[A-Za-z_][A-Za-z0-9_]*$') AND (regexp_matches(v, '_') OR regexp_matches(v, '[a-z][A-Z]') OR NOT regexp_matches(v, '[0-9]')) AS identifier, coalesce(list_max(list_transform(range(1, length(v)), lambda i: CAST(ascii(substr(v, i + 1, 1)) - ascii(substr(v, i, 1)) = 1 AS INTEGER))), 0) = 1 AS has_step FROM (SELECT p_partkey, (['0x' || substr(sha256(p_name), 1, 40), 'fooBar' || p_size, 'abcdefgh', replace(p_name, ' ', '_'), substr(md5(p_name), 1, 16), '13579'])[p_partkey % 6 + 1] AS v FROM part)")
def token_shapes(spark, d):
    k = F.col("p_partkey")
    v = F.element_at(F.array(F.concat(F.lit("0x"), F.substring(F.sha2("p_name", 256), 1, 40)), F.concat(F.lit("fooBar"), "p_size"), F.lit("abcdefgh"), F.regexp_replace("p_name", " ", "_"), F.substring(F.md5("p_name"), 1, 16), F.lit("13579")), (k % 6 + 1).cast("int"))
    t = table(spark, d, "part").select("p_partkey", v.alias("v"))
    return t.select("p_partkey", text.wallet_address(F.col("v")).alias("address"), text.identifier_like(F.col("v")).alias("identifier"), (text.sequence_run(F.col("v")) >= 2).alias("has_step"))


@query("SELECT p_partkey, p_name AS hex_text, p_brand AS code_text FROM part")
def decoded_escapes(spark, d):
    """Texts written as hexadecimal escapes and as lists of character codes, read back."""
    p = table(spark, d, "part")
    escaped = F.concat(F.lit("x = '"), F.regexp_replace(F.hex("p_name"), "(..)", "\\\\x$1"), F.lit("';"))
    codes = F.concat(F.lit("String.fromCharCode("), F.array_join(F.transform(F.filter(F.split("p_brand", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("string")), ","), F.lit(")"))
    return p.select("p_partkey", text.hex_escapes(escaped).alias("hex_text"), text.character_codes(codes).alias("code_text"))


_KEY_HEX = (b"tallyward-key".ljust(64, b"\0")).hex()
_PAD = lambda x: bytes(b ^ x for b in bytes.fromhex(_KEY_HEX)).hex()


@query(f"SELECT p_partkey, sha256(unhex('{_PAD(0x5c)}' || sha256(unhex('{_PAD(0x36)}' || hex(encode(p_name))))  ).substr(1, 64)) AS mac FROM part".replace(".substr(1, 64)", ""))
def keyed_digests(spark, d):
    return table(spark, d, "part").select("p_partkey", text.hmac_sha256(F.col("p_name"), b"tallyward-key").alias("mac"))


@query("SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '\"([A-Za-z0-9@/._-]{3,40})\"', 1))) AS quoted FROM pages")
def quoted_names(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('"([A-Za-z0-9@/._-]{3,40})"'), F.lit(1)))).alias("quoted"))


@query("SELECT event_id, list_sort(list_filter([props, event_type, CAST(user_id AS VARCHAR)], lambda x: length(x) > 3)) AS texts, len(regexp_extract_all(props, '[{\\[]')) <= 3 AS shallow FROM events")
def json_strings(spark, d):
    e = table(spark, d, "events")
    made = F.to_json(F.struct(F.struct(F.array("props", F.lit("ab")).alias("b"), F.col("event_type").alias("c")).alias("a"), F.array(F.array(F.col("user_id").cast("string"))).alias("d")))
    found = F.filter(text.json_leaves(made), lambda x: F.length(x) > 3)
    return e.select("event_id", F.array_sort(found).alias("texts"), (text.json_depth(F.col("props")) <= 3).alias("shallow"))


@query("SELECT s_suppkey, concat('Upgrade ', s_name, ' to >= ', s_nationkey, ' (', s_suppkey, ')') AS message FROM supplier")
def message_templates(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", text.fill_template("Upgrade {name} to >= {version} ({phone})", name=F.col("s_name"), version=F.col("s_nationkey").cast("string"), phone=F.col("s_suppkey").cast("string")).alias("message"))


@query(f"SELECT c_custkey, coalesce(list_position(['LOW','MODERATE','HIGH','CRITICAL'], CASE upper(l) WHEN 'MEDIUM' THEN 'MODERATE' ELSE upper(l) END), 0) AS rank FROM (SELECT c_custkey, (['low','Medium','HIGH','critical','none',NULL])[c_custkey % 6 + 1] AS l FROM customer)")
def severity_labels(spark, d):
    from tallyward.functions import cvss

    label = F.element_at(F.array(*[F.lit(x) for x in ("low", "Medium", "HIGH", "critical", "none", None)]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", cvss.label_rank(label).alias("rank"))


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '?', 'g') = text AS safe FROM documents")
def terminal_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", (text.terminal_safe(F.col("text")) == F.col("text")).alias("safe"))


# --- findings left out, merged sets, histories ------------------------------------------------------------------------

_PLAIN = f"(SELECT source, rule, type, doc_id, CAST(line_no AS BIGINT) AS line_no FROM {_FOUND})"


@query(f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, rule ORDER BY line_no) AS k FROM {_PLAIN}) SELECT source, doc_id, rule, line_no, NULL AS of, CAST(0 AS BIGINT) AS omitted FROM n WHERE k <= 2 UNION ALL SELECT source, doc_id, 'Q-CAPPED', NULL, rule, count(*) - 2 FROM n GROUP BY source, doc_id, rule HAVING count(*) > 2")
def findings_capped(spark, d):
    f = fd.scan_lines(table(spark, d, "documents")).select("source", "doc_id", "rule", "line_no")
    return fd.capped(f, ["source", "doc_id"], "rule", ["line_no"], 2)


@query(f"WITH s AS (SELECT source, count(*) AS smells FROM {_PLAIN} WHERE type = 'SMELL' GROUP BY source), m AS (SELECT source, CAST(sum(ncloc) AS BIGINT) AS ncloc FROM {base._METRICS} GROUP BY source) SELECT source, coalesce(smells, 0) AS smells, CASE WHEN ncloc = 0 OR coalesce(smells, 0) * 100 / ncloc <= 5 THEN 'A' WHEN smells * 100 / ncloc <= 10 THEN 'B' WHEN smells * 100 / ncloc <= 20 THEN 'C' WHEN smells * 100 / ncloc <= 40 THEN 'D' ELSE 'E' END AS rating FROM m LEFT JOIN s USING (source)")
def maintainability_with_capped(spark, d):
    """The rating does not depend on the cap: what it left out counts."""
    from tallyward.operators import grade as gr

    docs = table(spark, d, "documents")
    f = fd.scan_lines(docs).filter("type = 'SMELL'").select("source", "doc_id", "rule", "line_no", "type")
    return gr.maintainability(fd.capped(f, ["source", "doc_id"], "rule", ["line_no"], 2), gr.line_metrics(docs, keep=("source",)), "source")


_RECORDS = "(SELECT s_suppkey AS id, (['low','Medium','HIGH','critical','?'])[s_suppkey % 5 + 1] AS label, [concat('CVE-', s_suppkey), concat('X-', s_nationkey)] AS ids, [concat('https://r/', s_suppkey % 50), concat('https://q/', s_nationkey)] AS refs, [concat('p', s_suppkey % 9)] AS packages FROM supplier)"
_CAPPED = lambda column, most: f"(SELECT component, list_sort(list(x)) AS {column} FROM (SELECT component, x, row_number() OVER (PARTITION BY component ORDER BY x) AS n FROM (SELECT DISTINCT component, unnest({column}) AS x FROM n)) WHERE n <= {most} GROUP BY component)"


@query(f"WITH n AS (SELECT r.*, coalesce(component, r.id) AS component FROM {_RECORDS} r LEFT JOIN {base._COMPONENTS} c USING (id)), b AS (SELECT component, arg_max(label, (coalesce(list_position(['LOW','MODERATE','HIGH','CRITICAL'], CASE upper(label) WHEN 'MEDIUM' THEN 'MODERATE' ELSE upper(label) END), 0), label)) AS label FROM n GROUP BY component) SELECT component, label, ids, refs, packages FROM b JOIN {_CAPPED('ids', 20)} USING (component) JOIN {_CAPPED('refs', 10)} USING (component) JOIN {_CAPPED('packages', 6)} USING (component)")
def feed_sets(spark, d):
    k = F.col("s_suppkey")
    label = F.element_at(F.array(*map(F.lit, ("low", "Medium", "HIGH", "critical", "?"))), (k % 5 + 1).cast("int"))
    r = table(spark, d, "supplier").select(k.alias("id"), label.alias("label"), F.array(F.concat(F.lit("CVE-"), k), F.concat(F.lit("X-"), "s_nationkey")).alias("ids"), F.array(F.concat(F.lit("https://r/"), k % 50), F.concat(F.lit("https://q/"), "s_nationkey")).alias("references"), F.array(F.concat(F.lit("p"), k % 9)).alias("packages"))
    return sca.merged_sets(r, base.alias_components(spark, d)).withColumnRenamed("references", "refs")


@query("SELECT o_orderkey, (SELECT p.o_orderkey FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate <= o.o_orderdate - INTERVAL 7 DAYS AND (o.o_orderkey % 3 = 0 OR p.o_orderkey % 3 <> 0) ORDER BY p.o_orderdate DESC, p.o_orderkey DESC LIMIT 1) AS prior_id FROM orders o")
def prior_of_kind(spark, d):
    """The established predecessor: stable releases only have stable ones before them."""
    from tallyward.operators import history

    o = table(spark, d, "orders").withColumn("pre", F.col("o_orderkey") % 3 == 0)
    return history.prior_of_kind(o, "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "prior_id")


@query("""WITH c AS (SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS c FROM documents),
  w AS (SELECT doc_id, k, md5(array_to_string(c[k:k+5], chr(10))) AS h FROM (SELECT doc_id, c, unnest(range(1, len(c) - 4)) AS k FROM c)), a AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
  v AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + 6)) AS line FROM w WHERE h IN (SELECT h FROM a)) GROUP BY doc_id)
  SELECT lang, CAST(sum(len(c)) AS BIGINT) AS measured, CAST(sum(coalesce(n, 0)) AS BIGINT) AS duplicated, round(100 * sum(coalesce(n, 0)) / sum(len(c)), 6) AS percent FROM c LEFT JOIN v USING (doc_id) GROUP BY lang""")
def duplicate_percent(spark, d):
    from tallyward.operators import grade as gr

    docs = table(spark, d, "documents")
    each = gr.duplication(docs).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("measured").alias("measured"), F.sum("duplicated").alias("duplicated"))
    return each.withColumn("percent", F.round(100 * F.col("duplicated") / F.col("measured"), 6))
