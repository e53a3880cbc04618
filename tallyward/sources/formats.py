"""Structures of single files, read without running or trusting them: indexes, feeds, documents, media and models.

Each ``*_of`` function reads one file's bytes in bounds and never raises for what the file holds; the DataFrame forms
below apply them to (path, content) or (path, text) rows in batches.
"""

from __future__ import annotations

import ast
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.plans.lineage import cut
from tallyward.sources import readers

#: Bounds: members of a feed, bytes of one record, entries of an index, chunks of a picture, depth of included lists.
RECORDS, RECORD_BYTES, ENTRIES, CHUNKS, INCLUDE_DEPTH = 1_000_000, 4 << 20, 1_000_000, 100_000, 10
#: Encodings that a byte order mark or a cookie may name; anything else is read as UTF-8.
CODECS = ("utf-8", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-7", "latin-1", "cp1252", "gb18030", "gbk", "big5", "shift_jis", "euc-jp", "euc-kr", "iso2022_jp", "iso2022_kr", "koi8-r")


def rows_of(files: DataFrame, read: Callable[[str, bytes], list[tuple]], schema: str, column: str = "content") -> DataFrame:
    """(path, what ``read`` gives) of every file; a batch of files at a time, a file with nothing gives no row."""
    names = ["path", *(part.strip().split(" ")[0] for part in re.split(r",(?![^<]*>)", schema))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(path, *row) for path, data in zip(frame["path"], frame[column], strict=True) if data is not None for row in read(path, bytes(data) if column == "content" else data)]
            yield pd.DataFrame(found, columns=names)

    return files.select("path", column).mapInPandas(run, f"path string, {schema}")


# --- texts ---------------------------------------------------------------------------------------------------------


def text_of(data: bytes) -> tuple[str, str]:
    """(encoding, text) by byte order mark, by a coding cookie in the first two lines, by escape sequences, else UTF-8."""
    for mark, codec in ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"+/v8", "utf-7"), (b"+/v9", "utf-7")):
        if data.startswith(mark):
            return codec, data.decode(codec, "replace")
    head = b"\n".join(data[:400].split(b"\n", 2)[:2])
    cookie = re.search(rb"coding[:=][ \t]*([-_.A-Za-z0-9]+)", head)
    named = cookie[1].decode("ascii").lower().replace("_", "-") if cookie else ""
    known = {c.replace("_", "-"): c for c in CODECS}
    if named in known:
        return known[named], data.decode(known[named], "replace")
    if b"\x1b$B" in data or b"\x1b(J" in data:
        return "iso2022_jp", data.decode("iso2022_jp", "replace")
    if b"\x1b$)C" in data:
        return "iso2022_kr", data.decode("iso2022_kr", "replace")
    return "utf-8", data.decode("utf-8", "replace")


def read_texts(files: DataFrame) -> DataFrame:
    """(path, encoding, text)."""
    return rows_of(files, lambda _, data: [text_of(data)], "encoding string, text string")


# --- feeds and indexes ---------------------------------------------------------------------------------------------


def osv_records(data: bytes) -> list[tuple]:
    """(id, modified, withdrawn, aliases, ecosystem, name, introduced, fixed, last_affected) of a zip of OSV records.

    The directory is checked before anything is read: too many or too large records, or a name that occurs twice, make
    the whole feed unread.
    """
    out: list[tuple] = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if i.filename.endswith(".json")]
            if len(infos) > RECORDS or len({i.filename for i in infos}) != len(infos) or any(i.file_size > RECORD_BYTES for i in infos):
                return []
            for i in infos:
                try:
                    record = json.loads(z.read(i))
                    for a in record.get("affected") or [{}]:
                        package = a.get("package") or {}
                        for r in a.get("ranges") or [{}]:
                            for start, fixed, last in _osv_spans(r.get("events") or []):
                                out.append((record["id"], record.get("modified"), record.get("withdrawn"), record.get("aliases") or [], package.get("ecosystem"), package.get("name"), start, fixed, last))
                except (ValueError, KeyError, AttributeError, TypeError, RecursionError):
                    continue
    except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError, zlib.error):
        return []
    return out


def _osv_spans(events: list[dict]) -> list[tuple]:
    """(introduced, fixed, last_affected) of a range's events in order; one open span without any."""
    spans, start = [], None
    for e in events:
        if "introduced" in e:
            if start is not None:
                spans.append((start, None, None))
            start = e["introduced"]
        elif start is not None and ("fixed" in e or "last_affected" in e):
            spans.append((start, e.get("fixed"), e.get("last_affected")))
            start = None
    return spans + [(start, None, None)] if start is not None or not spans else spans


def read_osv(files: DataFrame) -> DataFrame:
    """Records of OSV zip files among (path, content) rows, a row for each affected span."""
    schema = "id string, modified string, withdrawn string, aliases array<string>, ecosystem string, name string, introduced string, fixed string, last_affected string"
    return rows_of(files, lambda _, data: osv_records(data), schema)


def index_entries(data: bytes) -> list[tuple]:
    """(file, sha, mode, size, stage) of a git index of version 2, 3 or 4; what is cut off ends the list."""
    if data[:4] != b"DIRC" or len(data) < 12:
        return []
    version, count = struct.unpack(">II", data[4:12])
    out, at, before = [], 12, b""
    for _ in range(min(count, ENTRIES) if version in (2, 3, 4) else 0):
        if at + 62 > len(data):
            break
        mode, size = struct.unpack(">I", data[at + 24 : at + 28])[0], struct.unpack(">I", data[at + 36 : at + 40])[0]
        sha, flags = data[at + 40 : at + 60].hex(), struct.unpack(">H", data[at + 60 : at + 62])[0]
        name = at + 62 + (2 if flags & 0x4000 and version > 2 else 0)
        if version == 4:
            cut = -1  # how much of the name before goes, in groups of seven bits
            while name < len(data):
                byte = data[name]
                cut, name = (cut + 1 << 7) + (byte & 0x7F), name + 1
                if not byte & 0x80:
                    break
            end = data.find(b"\0", name)
            if end < 0:
                break
            before = before[: len(before) - cut] + data[name:end]
            path, at = before, end + 1
        else:
            end = data.find(b"\0", name)
            if end < 0:
                break
            path, at = data[name:end], at + (end - at + 8) // 8 * 8
        out.append((path.decode("utf-8", "replace"), sha, mode, size, flags >> 12 & 3))
    return out


def read_git_index(files: DataFrame) -> DataFrame:
    """(path, file, sha, mode, size, stage): what is staged, of git indexes among (path, content) rows."""
    return rows_of(files, lambda _, data: index_entries(data), "file string, sha string, mode long, size long, stage int")


def xml_refused(text: Column) -> Column:
    """Why an XML text is not read: it declares a document type or entities, or is too deep; null if it may be."""
    return F.when(text.rlike(r"(?i)<!DOCTYPE"), "document type").when(text.rlike(r"(?i)<!ENTITY"), "entity").when(F.length(text) > RECORD_BYTES, "too large")


def xml_values(files: DataFrame, path: str, key: str = "path", text: str = "text") -> DataFrame:
    """(key, refused, values) of an XPath over XML texts; a text that is refused or broken has no values."""
    refused = xml_refused(F.col(text))
    safe = F.when(refused.isNull() & F.col(text).rlike(r"^\s*<"), F.col(text))
    return files.select(key, refused.alias("refused"), F.when(safe.isNotNull(), F.xpath(safe, F.lit(path))).alias("values"))


# --- documents, media and models -----------------------------------------------------------------------------------


def document_signs(data: bytes) -> list[tuple]:
    """(sign, count) of a PDF or an office document: scripts, launches, attachments, macros, outside links."""
    if data[:5] == b"%PDF-":
        signs = {"script": rb"/(?:JavaScript|JS)\b", "launch": rb"/Launch\b", "attachment": rb"/EmbeddedFile\b", "open-action": rb"/(?:OpenAction|AA)\b", "form-submit": rb"/SubmitForm\b", "link": rb"/URI\s*\("}
        found = {k: len(re.findall(p, data)) for k, p in signs.items()}
    elif data[:4] == b"PK\x03\x04":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = [i.filename for i in z.infolist()[: readers.MEMBERS]]
                relations = b"".join(z.read(n) for n in names if n.endswith(".rels") and z.getinfo(n).file_size < RECORD_BYTES)
        except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError, zlib.error):
            return [("broken", 1)]
        found = {"macro": sum(n.endswith(("vbaProject.bin", "vbaData.xml")) for n in names), "attachment": sum("/embeddings/" in n for n in names), "active-x": sum("/activeX/" in n for n in names), "link": relations.count(b'TargetMode="External"')}
    else:
        return []
    return sorted((k, n) for k, n in found.items() if n)


def media_signs(data: bytes) -> list[tuple]:
    """(part, bytes) of a picture, key store or array file: its chunks, and what stands behind its end."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        out, at = [], 8
        while at + 12 <= len(data) and len(out) < CHUNKS:
            size = struct.unpack(">I", data[at : at + 4])[0]
            kind = data[at + 4 : at + 8].decode("latin-1")
            sound = at + 12 + size <= len(data) and struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(data[at + 4 : at + 8 + size])
            out.append((kind if sound else f"{kind} broken", size))
            at += 12 + size
            if kind == "IEND":
                break
        return out + ([("behind the end", len(data) - at)] if at < len(data) else [])
    if data[:3] == b"\xff\xd8\xff":
        end = data.rfind(b"\xff\xd9")
        return [("picture", end + 2)] + ([("behind the end", len(data) - end - 2)] if end + 2 < len(data) else []) if end > 0 else [("cut off", len(data))]
    if data[:6] in (b"GIF87a", b"GIF89a"):
        end = data.rfind(b"\x3b")
        return [("picture", end + 1)] + ([("behind the end", len(data) - end - 1)] if end + 1 < len(data) else [])
    if data[:4] == b"\xfe\xed\xfe\xed" and len(data) >= 12:
        return [("key store", struct.unpack(">I", data[8:12])[0])]
    if data[:6] == b"\x93NUMPY" and len(data) >= 10:
        wide = data[6] > 1
        size = struct.unpack("<I", data[8:12])[0] if wide else struct.unpack("<H", data[8:10])[0]
        header = data[12 if wide else 10 :][:size].decode("latin-1")
        return [("array of objects" if re.search(r"'descr':\s*'\|?O", header) else "array", len(data) - size - (12 if wide else 10))]
    return []


def code_signs(path: str, text: str) -> list[tuple]:
    """(line_no, sign, detail) of a source file by its name: sinks and taint of Python, commands of shell, steps of CI."""
    out: list[tuple] = []
    if path.endswith(".py"):
        out += [(line, "sink", f"{call} {category}{' computed' if computed else ''}") for line, call, category, computed in readers.python_sinks(text)]
        out += [(line, "taint", "") for line in readers.tainted_lines(text)]
        out += [(line, "import", name) for line, name in python_imports(text)]
    elif path.endswith((".sh", ".bash")):
        for number, line in enumerate(text.split("\n"), 1):
            out += [(number, "command", words[0]) for words in readers.shell_commands(line)]
    elif path.endswith((".yml", ".yaml")):
        out += [(line, "unpinned action", use) for line, use in readers.unpinned_actions(text)]
    return out


def python_imports(source: str) -> list[tuple[int, str]]:
    """(line, module) of the imports of a Python source, relative ones with their dots."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(node.lineno, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append((node.lineno, "." * node.level + (node.module or "")))
    return sorted(out)


def read_code_signs(files: DataFrame) -> DataFrame:
    """(path, line_no, sign, detail) of the sources among (path, text) rows."""
    return rows_of(files, code_signs, "line_no long, sign string, detail string", "text")


def read_binary_signs(files: DataFrame) -> DataFrame:
    """(path, sign, detail): structures of documents and media, and imports of pickles, among (path, content) rows."""

    def signs(path: str, data: bytes) -> list[tuple]:
        found = [(k, str(n)) for k, n in [*document_signs(data), *media_signs(data)]]
        return found + ([("import", i) for i in readers.pickle_imports(data)] if path.endswith((".pkl", ".pickle", ".pt", ".joblib")) else [])

    return rows_of(files, signs, "sign string, detail string")


# --- inventories that refer to other files -------------------------------------------------------------------------


def included_requirements(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, depth): the requirement lists that roots (path) reach by their ``-r`` and ``-c`` lines.

    files: (path, text).  Lists are followed over the whole table at once, to INCLUDE_DEPTH; a circle ends by itself.
    """
    line = F.explode(F.split("text", "\n")).alias("line")
    target = F.regexp_extract(F.trim("line"), r"^(?:-r|-c|--requirement|--constraint)[ =]+(\S+)", 1)
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    steps = files.select("path", line).withColumn("target", target).filter("target != ''").select("path", F.regexp_replace(F.concat(folder, "target"), r"(^|/)\./", "$1").alias("target")).distinct()
    steps = cut(steps)
    found = newest = cut(roots.select(F.col("path").alias("root"), "path").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, INCLUDE_DEPTH + 1):
        newest = cut(newest.join(steps, "path").select("root", F.col("target").alias("path")).distinct().join(found, ["root", "path"], "left_anti").withColumn("depth", F.lit(depth)))
        if not newest.limit(1).count():
            break
        found = cut(found.unionByName(newest))
    return found.join(files.select("path"), "path", "left_semi")


def more_inventory(path: str, text: str) -> list[tuple]:
    """(ecosystem, name, version) of bun locks, go.work, vendored module lists, and aliases in package.json."""
    base = path.rsplit("/", 1)[-1]
    try:
        if base == "bun.lock":
            bare = re.sub(r",(\s*[}\]])", r"\1", re.sub(r"^\s*//.*$", "", text, flags=re.M))
            listed = (v[0].rpartition("@") for v in json.loads(bare).get("packages", {}).values() if v and isinstance(v[0], str))
            return [("npm", name, version) for name, _, version in listed if name]
        if base == "go.work":
            return [("go-use", m, None) for m in re.findall(r"^\s*(?:use\s+)?(\.{1,2}/?\S*)\s*$", text, re.M)]
        if path.endswith("vendor/modules.txt"):
            return [("go", n, v) for n, v in re.findall(r"^# (\S+) (v\S+)", text, re.M)]
        if base == "package.json":
            doc = json.loads(text)
            every = [v for part in ("dependencies", "devDependencies") for v in doc.get(part, {}).values()]
            return [("npm", *m.groups()) for v in every if (m := re.fullmatch(r"npm:((?:@[^/]+/)?[^@]+)@(\d\S*)", v))]
    except (ValueError, AttributeError, TypeError, RecursionError):
        pass
    return []


def read_more_inventory(files: DataFrame) -> DataFrame:
    return rows_of(files, lambda path, text: more_inventory(path, text), "ecosystem string, name string, version string", "text")
