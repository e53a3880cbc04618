"""Readers: trees of files, archives, manifests and locks, advisory feeds and event hours."""

from __future__ import annotations

import ast
import bz2
import configparser
import gzip
import io
import json
import lzma
import math
import pickletools
import re
import shlex
import tarfile
import tomllib
import zipfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds on archives: what exceeds one is reported as such and not read on.
MEMBER_BYTES, MEMBERS, ARCHIVE_BYTES = 32 << 20, 20_000, 256 << 20
FILE_BYTES = 2 << 20
# Languages by file name extension.
EXTENSIONS = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "sql": "sql", "sh": "shell", "java": "java", "rb": "ruby", "php": "php", "c": "c", "cpp": "cpp", "yml": "yaml", "yaml": "yaml", "json": "json", "toml": "toml", "md": "markdown", "html": "html", "xml": "xml"}
# The first bytes of binary formats.
MAGIC = {"7f454c46": "elf", "4d5a": "pe", "cafebabe": "java-class", "504b0304": "zip", "1f8b": "gzip", "425a68": "bzip2", "fd377a585a00": "xz", "377abcaf271c": "7z", "526172211a07": "rar", "89504e47": "png", "ffd8ff": "jpeg", "25504446": "pdf", "0061736d": "wasm"}


def read_tree(spark: SparkSession, path: str, glob: str | None = None, skip: str = r"(^|/)(\.git|node_modules|__pycache__)(/|$)") -> DataFrame:
    """(path, size, kind, language, content) of all files below a folder; kind: text, binary or large."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return classify(files.filter(~F.col("path").rlike(skip)))


def classify(files: DataFrame, most: int = FILE_BYTES) -> DataFrame:
    head = F.hex(F.substring("content", 1, 512))
    binary = F.coalesce(*[F.when(F.lower(head).startswith(m), F.lit(k)) for m, k in MAGIC.items()], F.lit(None).cast("string"))
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.coalesce(*[F.when(extension == k, F.lit(v)) for k, v in EXTENSIONS.items()])
    shebang = F.regexp_extract(F.decode(F.substring("content", 1, 80), "ISO-8859-1"), r"^#!.*?(python|node|bash|sh|ruby|php)\b", 1)
    zero = F.locate("00", F.regexp_replace(head, "(..)", "$1 ")) > 0
    kind = F.when(F.col("length") > most, "large").when(binary.isNotNull() | zero, "binary").otherwise("text")
    return files.select("path", F.col("length").alias("size"), kind.alias("kind"), binary.alias("format"), F.coalesce(by_name, F.when(shebang != "", shebang)).alias("language"), "content")


def decoded(content: Column) -> Column:
    """Bytes as text by byte order mark or Python coding cookie, else UTF-8."""
    head = F.hex(F.substring(content, 1, 3))
    cookie = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, 200), "ISO-8859-1"), r"^(?:[^\n]*\n)?[ \t\f]*#.*?coding[:=][ \t]*([-_.A-Za-z0-9]+)", 1))
    utf16 = F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16"))
    latin = F.when(cookie.isin("latin-1", "iso-8859-1", "latin1"), F.decode(content, "ISO-8859-1"))
    return F.coalesce(utf16, latin, F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", ""))


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(member, bytes, problem) of an archive; a problem ends or replaces what can't be read within the bounds."""
    total = 0
    try:
        if data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                infos = z.infolist()
                if len({i.filename for i in infos}) != len(infos):
                    yield name, None, "repeated member"
                    return
                for k, i in enumerate(infos):
                    total += i.file_size
                    if k >= MEMBERS or total > ARCHIVE_BYTES:
                        yield name, None, "too large"
                        return
                    if not i.is_dir():
                        yield (i.filename, None, "too large") if i.file_size > MEMBER_BYTES else (i.filename, z.read(i), None)
            return
        for magic, opener in ((b"\x1f\x8b", lambda f: gzip.GzipFile(fileobj=f)), (b"BZh", bz2.BZ2File), (b"\xfd7zXZ", lzma.LZMAFile)):
            if data.startswith(magic):
                with opener(io.BytesIO(data)) as f:
                    data = f.read(ARCHIVE_BYTES + 1)
                if len(data) > ARCHIVE_BYTES:
                    yield name, None, "too large"
                    return
                break
        else:
            if data[257:262] != b"ustar":
                yield name, None, "not an archive"
                return
        if data[257:262] != b"ustar":
            yield re.sub(r"\.(gz|bz2|xz)$", "", name), data, None
            return
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for k, m in enumerate(t):
                if k >= MEMBERS:
                    yield name, None, "too large"
                    return
                if m.issym() or m.islnk() or m.name.startswith("/") or ".." in m.name.split("/"):
                    yield m.name, None, "link or path outside"
                elif m.isfile():
                    yield (m.name, None, "too large") if m.size > MEMBER_BYTES else (m.name, t.extractfile(m).read(), None)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, lzma.LZMAError, RuntimeError, NotImplementedError) as e:
        yield name, None, type(e).__name__


def read_archives(files: DataFrame) -> DataFrame:
    """(path, member, content, problem) of the archives among (path, content) rows, one archive at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(path, *m) for m in members(path, bytes(content))], columns=["path", "member", "content", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary, problem string")


def requirement(line: str) -> tuple[str, str | None] | None:
    """(name, pinned version or None) of a requirements line."""
    line = re.split(r"\s#|^#", line.strip())[0].split(";")[0].strip()
    if not line or line.startswith("-") or not (m := re.match(r"([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$", line)):
        return None
    pinned = re.fullmatch(r"===?\s*([^,*\s]+)", m[2])
    return re.sub(r"[-_.]+", "-", m[1]).lower(), pinned[1] if pinned else None


def inventory_of(path: str, text: str) -> list[tuple[str, str, str | None]]:
    """(ecosystem, name, version) of a manifest or lock file, by its name."""
    base = path.rsplit("/", 1)[-1]
    try:
        if base in ("package-lock.json", "npm-shrinkwrap.json"):
            doc = json.loads(text)
            if "packages" in doc:
                return [("npm", k.rpartition("node_modules/")[2], v.get("version")) for k, v in doc["packages"].items() if "node_modules/" in k]
            out, todo = [], [doc.get("dependencies", {})]
            while todo:
                for k, v in todo.pop().items():
                    out.append(("npm", k, v.get("version")))
                    todo.append(v.get("dependencies", {}))
            return out
        if base == "package.json":
            doc = json.loads(text)
            return [("npm", k, v if re.fullmatch(r"\d+\.\d+\.\d+", v or "") else None) for part in ("dependencies", "devDependencies", "optionalDependencies") for k, v in doc.get(part, {}).items()]
        if base == "yarn.lock":
            return [("npm", n, v) for n, v in re.findall(r'^"?((?:@[^/\s"]+/)?[^@\s"]+)@[^\n]*:\n\s+version:? "?([^"\n]+)', text, re.M)]
        if base == "pnpm-lock.yaml":
            return [("npm", n, v) for n, v in re.findall(r"^  '?/?((?:@[^/\s]+/)?[^@/\s']+)[@/](\d[^:('\s]*)", text, re.M)]
        if re.fullmatch(r"requirements.*\.(txt|in)", base):
            return [("pypi", *r) for r in map(requirement, text.splitlines()) if r]
        if base in ("poetry.lock", "uv.lock", "pylock.toml", "Cargo.lock"):
            doc = tomllib.loads(text)
            eco = "crates" if base == "Cargo.lock" else "pypi"
            return [(eco, p["name"], p.get("version")) for p in doc.get("package", doc.get("packages", []))]
        if base == "pyproject.toml":
            doc = tomllib.loads(text)
            return [("pypi", *r) for r in map(requirement, doc.get("project", {}).get("dependencies", [])) if r]
        if base == "Pipfile.lock":
            doc = json.loads(text)
            return [("pypi", k, (v.get("version") or "").lstrip("=") or None) for part in ("default", "develop") for k, v in doc.get(part, {}).items()]
        if base == "Cargo.toml":
            doc = tomllib.loads(text)
            return [("crates", k, None) for part in ("dependencies", "dev-dependencies", "build-dependencies") for k in doc.get(part, {})]
        if base == "METADATA":
            head = text.split("\n\n", 1)[0]
            name, version = (re.search(rf"^{k}: *(.+)$", head, re.M) for k in ("Name", "Version"))
            return [("pypi", re.sub(r"[-_.]+", "-", name[1].strip()).lower(), version[1].strip())] if name and version else []
        if base == "go.mod":
            replaced = {a: (b, v) for a, b, v in re.findall(r"^\s*(?:replace\s+)?(\S+)(?: v\S+)? => (\S+)(?: (v\S+))?", text, re.M)}
            return [("go", *(replaced.get(n) or (n, v))) for n, v in re.findall(r"^\s*(?:require\s+)?(\S+\.\S+/\S+|\S+\.\S+) (v\d\S*)(?:\s*//.*)?$", text, re.M) if "=>" not in n]
        if base == "go.sum":
            return sorted({("go", n, v) for n, v in re.findall(r"^(\S+) (v[^/\s]+) h1:", text, re.M)})
        if base == "setup.cfg":
            cfg = configparser.ConfigParser()
            cfg.read_string(text)
            return [("pypi", *r) for r in map(requirement, cfg.get("options", "install_requires", fallback="").splitlines()) if r]
        if base == "setup.py":
            for node in ast.walk(ast.parse(text)):
                if isinstance(node, ast.keyword) and node.arg == "install_requires" and isinstance(node.value, ast.List):
                    return [("pypi", *r) for r in (requirement(e.value) for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)) if r]
    except (ValueError, SyntaxError, KeyError, AttributeError, TypeError, configparser.Error, RecursionError):
        pass
    return []


def read_inventory(files: DataFrame) -> DataFrame:
    """(ecosystem, name, version, path) of all manifests and locks among (path, text) rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*i, p) for p, t in zip(frame["path"], frame["text"], strict=True) for i in inventory_of(p, t or "")]
            yield pd.DataFrame(rows, columns=["ecosystem", "name", "version", "path"])

    return files.select("path", "text").mapInPandas(run, "ecosystem string, name string, version string, path string")


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema("vulnerabilities array<struct<cveID string, dueDate string, knownRansomwareCampaignUse string>>").json(path, multiLine=True)
    return doc.select(F.explode("vulnerabilities").alias("v")).select(F.col("v.cveID").alias("cve"), F.col("v.dueDate").alias("due"), (F.lower("v.knownRansomwareCampaignUse") == "known").alias("ransomware"))


def read_epss(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(cve, epss, percentile) of a (gzipped) CSV with a comment line; only the wanted CVEs, by a semi-join."""
    rows = spark.read.csv(path, header=True, comment="#", schema="cve string, epss double, percentile double")
    return rows if wanted is None else rows.join(wanted.select("cve"), "cve", "left_semi")


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """(cve, ecosystem, name, low, low_included, high, high_included) of a bundle; null bounds where it has no range."""
    schema = "advisories array<struct<cve string, severity string, cvss double, knownExploited boolean, packages array<struct<name string, ecosystem string, exact boolean, ranges array<struct<fromVersion string, fromInclusive boolean, toVersion string, toInclusive boolean>>>>>>"
    a = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("advisories").alias("a"))
    p = a.select("a.cve", "a.severity", "a.cvss", "a.knownExploited", F.explode_outer("a.packages").alias("p"))
    r = p.select("cve", "severity", "cvss", "knownExploited", "p.ecosystem", "p.name", F.explode_outer("p.ranges").alias("r"))
    return r.select("cve", "severity", "cvss", "knownExploited", "ecosystem", "name", F.col("r.fromVersion").alias("low"), F.col("r.fromInclusive").alias("low_included"), F.col("r.toVersion").alias("high"), F.col("r.toInclusive").alias("high_included"))


EVENT_SCHEMA = "id string, type string, repo struct<id: bigint, name: string>, payload struct<ref_type: string, description: string>, created_at timestamp"


def read_event_hours(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Repository events of gzipped JSON lines: those that create, push to or publish a repository."""
    reader = spark.readStream.option("maxFilesPerTrigger", 3) if streaming else spark.read
    rows = reader.schema(EVENT_SCHEMA).json(path)
    kept = (F.col("type") == "PushEvent") | (F.col("type") == "PublicEvent") | ((F.col("type") == "CreateEvent") & (F.col("payload.ref_type") == "repository"))
    return rows.filter(kept & F.col("repo.id").isNotNull()).select("id", "type", F.col("repo.id").alias("repo_id"), F.col("repo.name").alias("repo"), "created_at")


def read_database(spark: SparkSession, url: str, query: str, fetch: int = 10_000, **properties: str) -> DataFrame:
    """Rows of a query on a database server, fetched in batches (its JDBC driver has to be on the class path)."""
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=fetch, **properties).load()


def json_without_comments(text: Column) -> Column:
    """JSON with comments and trailing commas as JSON; strings are left alone where they hold no comment signs."""
    text = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")


def shannon(data: bytes) -> float:
    n = len(data)
    return -math.fsum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0


#: Calls in Python source that run text or commands.
SINKS = {"eval": "CODE", "exec": "CODE", "os.system": "CMD", "os.popen": "CMD", "subprocess.call": "CMD", "subprocess.run": "CMD", "subprocess.Popen": "CMD", "pickle.loads": "CODE", "marshal.loads": "CODE"}


def python_sinks(source: str) -> list[tuple[int, str, str, bool]]:
    """(line, call, category, whether its argument is computed) by syntax tree; nothing for what doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    calls = ((n, ast.unparse(n.func)) for n in ast.walk(tree) if isinstance(n, ast.Call))
    return sorted((n.lineno, name, SINKS[name], not all(isinstance(a, ast.Constant) for a in n.args)) for n, name in calls if name in SINKS)


def tainted_lines(source: str, sources: str = r"input\(|request\.|sys\.argv|os\.environ", sinks: str = r"eval\(|exec\(|os\.system\(|execute\(", cleaners: str = r"shlex\.quote\(|int\(|escape\(") -> list[int]:
    """Lines on which a value from a source reaches a sink, read in order: assignments pass taint on, cleaners end it."""
    held: set[str] = set()
    out = []
    for number, line in enumerate(source.split("\n"), 1):
        code = line.split("#", 1)[0]
        m = re.match(r"\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.*)$", code)
        value = m[2] if m else code
        dirty = bool(re.search(sources, value)) or any(re.search(rf"\b{re.escape(v)}\b", value) for v in held)
        dirty = dirty and not re.search(cleaners, value)
        if dirty and re.search(sinks, code):
            out.append(number)
        if m:
            (held.add if dirty else held.discard)(m[1])
    return out


def pickle_imports(data: bytes) -> list[str]:
    """What a pickle would import, by its opcodes; it is never loaded."""
    found, strings = [], []
    try:
        for op, arg, _ in pickletools.genops(data):
            if op.name in ("GLOBAL", "INST"):
                found.append(arg.replace(" ", "."))
            elif "UNICODE" in op.name or "STRING" in op.name:
                strings.append(str(arg))
            elif op.name == "STACK_GLOBAL" and len(strings) >= 2:
                found.append(".".join(strings[-2:]))
    except ValueError:
        found.append("?")
    return found


def shell_commands(text: str) -> list[list[str]]:
    """The commands of a shell text, as words; an unfinished quotation gives what is before it."""
    out = []
    for part in re.split(r"[;\n]|&&|\|\|?", text):
        try:
            words = shlex.split(part, comments=True)
        except ValueError:
            continue
        if words:
            out.append(words)
    return out


def unpinned_actions(workflow: str) -> list[tuple[int, str]]:
    """(line, action) of a CI workflow's steps that aren't pinned to a whole commit."""
    found = ((n, m[1]) for n, line in enumerate(workflow.split("\n"), 1) if (m := re.match(r"\s*(?:-\s*)?uses:\s*['\"]?([^\s'\"#]+)", line)))
    return [(n, u) for n, u in found if not u.startswith("./") and not re.search(r"@[0-9a-f]{40}$", u)]
