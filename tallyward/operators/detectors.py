"""Detector families: rules on lines with conditions on the line and its file, and co-occurrence rules on files.

A rule pack is a table or a list: (id, family, type, severity, pattern, gate, need, skip, langs, prefix, in_comments).
Patterns keep to what Java and RE2 read alike.  A line rule reports a line that holds the gate literal and the pattern,
has no match of ``skip``, and lies in a file that matches ``need`` somewhere, in one of the languages and below the path
prefix if there are any; lines that are comments are left out unless the rule is for them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A line that is a comment, in the languages that the rules are for.
COMMENT = r"^\s*(#|//|--|/\*|\*)"


@dataclass(frozen=True)
class LineRule:
    id: str
    family: str
    type: str
    severity: str
    pattern: str
    gate: str = ""
    need: str = ""
    skip: str = ""
    langs: str = ""
    prefix: str = ""
    in_comments: bool = False


#: Our own rule values.
PACK = [
    LineRule("SQL-DELETE-ALL", "sql", "BUG", "CRITICAL", r"(?i)\bdelete\s+from\s+[a-z_]+", "", "", r"(?i)\bwhere\b"),
    LineRule("SQL-UPDATE-ALL", "sql", "BUG", "CRITICAL", r"(?i)\bupdate\s+[a-z_]+\s+set\b", "", "", r"(?i)\bwhere\b"),
    LineRule("SQL-BUILT", "sql", "VULN", "BLOCKER", r"""execute\(\s*f?["'][^"']*["']\s*(\+|%|\.format)""", "execute("),
    LineRule("SQL-INTERPOLATED", "sql", "VULN", "BLOCKER", r"""execute\(\s*f["'][^"']*\{""", "execute("),
    LineRule("COOKIE-NOT-SECURE", "cookie", "VULN", "MAJOR", r"(?i)set[-_]cookie", "", "", r"(?i)\bsecure\b"),
    LineRule("COOKIE-SCRIPT", "cookie", "VULN", "MAJOR", r"(?i)set[-_]cookie", "", "", r"(?i)\bhttponly\b"),
    LineRule("COOKIE-CROSS-SITE", "cookie", "HOTSPOT", "MINOR", r"(?i)set[-_]cookie", "", "", r"(?i)\bsamesite\b"),
    LineRule("RUN-DECODED-PY", "decode_run", "VULN", "BLOCKER", r"\b(exec|eval|compile)\(.*(b64decode|unhexlify|fromhex|decompress|decode)\(", "("),
    LineRule("RUN-DECODED-JS", "decode_run", "VULN", "BLOCKER", r"\b(eval|Function)\(.*(atob|fromCharCode|unescape|Buffer\.from)\(", "("),
    LineRule("RUN-DECODED-SH", "decode_run", "VULN", "BLOCKER", r"base64\s+(-d|--decode).*\|\s*(ba|z|da)?sh\b", "base64"),
    LineRule("SIGN-MINER", "sign", "VULN", "BLOCKER", r"stratum\+(tcp|ssl)://|\bxmrig\b|--donate-level", ""),
    LineRule("SIGN-REVERSE-SHELL", "sign", "VULN", "BLOCKER", r"/dev/tcp/[0-9a-z.]+/[0-9]+|\bnc\s+-[a-z]*e\b", ""),
    LineRule("SIGN-RAW-ADDRESS", "sign", "VULN", "CRITICAL", r"""connect\(\s*\(?["'][0-9]{1,3}(\.[0-9]{1,3}){3}["']""", "connect("),
    LineRule("SIGN-WALLET-SWAP", "sign", "VULN", "CRITICAL", r"(?i)clipboard.*\b0x[0-9a-f]{40}\b", ""),
    LineRule("SIGN-PERSISTENCE", "sign", "VULN", "CRITICAL", r"@reboot|/etc/cron\.|LaunchAgents/|CurrentVersion.Run\b|systemctl\s+enable", ""),
    LineRule("SIGN-DNS-BEACON", "sign", "VULN", "CRITICAL", r"(nslookup|dig|host)\s+\$[({]", ""),
    LineRule("SIGN-SELF-PUBLISH", "sign", "VULN", "MAJOR", r"\b(npm|yarn|pnpm)\s+publish\b|\btwine\s+upload\b|\bcargo\s+publish\b", ""),
    LineRule("SIGN-CAPTURE", "sign", "VULN", "MAJOR", r"(webhook\.site|requestbin|pipedream\.net|burpcollaborator|interact\.sh)", ""),
    LineRule("SIGN-DEAD-DROP", "sign", "VULN", "MAJOR", r"(pastebin\.com/raw|gist\.githubusercontent|api\.telegram\.org/bot)", ""),
    LineRule("SIGN-CREDENTIALS", "sign", "VULN", "CRITICAL", r"(\.aws/credentials|\.ssh/id_(rsa|ed25519)|\.npmrc|\.netrc|\.docker/config\.json)", ""),
    LineRule("SENT-ENVIRONMENT", "data_sent", "VULN", "BLOCKER", r"(requests\.post|fetch|axios\.post|urlopen)\(.*(os\.environ|process\.env|getenv)", "("),
    LineRule("SENT-HOST", "data_sent", "VULN", "CRITICAL", r"(requests\.(post|get)|fetch|axios\.post|curl).*(hostname|whoami|platform\.node|os\.userInfo)", ""),
    LineRule("SENT-FILES", "data_sent", "VULN", "CRITICAL", r"curl\s.*(-F|--form|-d|--data)\s*\S*@(/etc|~|\$HOME)", "curl"),
    LineRule("CI-UNPINNED", "ci_workflow", "HOTSPOT", "MAJOR", r"\buses:\s*[^@\s]+@", "uses:", "", r"@[0-9a-f]{40}\b"),
    LineRule("CI-WRITE-ALL", "ci_workflow", "HOTSPOT", "MAJOR", r"permissions:\s*write-all", "permissions:"),
    LineRule("CI-ID-TOKEN", "ci_workflow", "HOTSPOT", "MINOR", r"id-token:\s*write", "id-token:", r"uses:|run:"),
    LineRule("CI-UNTRUSTED-CHECKOUT", "ci_workflow", "VULN", "CRITICAL", r"github\.event\.pull_request\.head\.(sha|ref)", "github.event", r"pull_request_target"),
    LineRule("CI-INJECTION", "ci_workflow", "VULN", "CRITICAL", r"run:.*\$\{\{\s*github\.event\.(issue|comment|pull_request|head_commit)\.(title|body|message)", "run:"),
    LineRule("CI-SECRET-SENT", "ci_exfil", "VULN", "BLOCKER", r"secrets\.[A-Za-z_]+.*\b(curl|wget|nc)\b|\b(curl|wget|nc)\b.*secrets\.[A-Za-z_]+", "secrets."),
    LineRule("CI-SECRET-SWEEP", "ci_exfil", "VULN", "BLOCKER", r"toJSON\(\s*secrets\s*\)|printenv\s*\|\s*(curl|nc)|env\s*\|\s*base64", ""),
    LineRule("CI-SECRET-ECHO", "ci_exfil", "VULN", "CRITICAL", r"echo\s+.?\$\{\{\s*secrets\.", "secrets."),
    LineRule("GITLAB-PRIVILEGED", "gitlab", "HOTSPOT", "MAJOR", r"docker\s+run\s.*--privileged", "--privileged"),
    LineRule("GITLAB-REMOTE-INCLUDE", "gitlab", "HOTSPOT", "MAJOR", r"(include|remote):\s*.?https?://", "://"),
    LineRule("GITLAB-TOKEN-SENT", "gitlab", "VULN", "BLOCKER", r"\$CI_(JOB_TOKEN|REGISTRY_PASSWORD).*(curl|wget)|(curl|wget).*\$CI_(JOB_TOKEN|REGISTRY_PASSWORD)", "$CI_"),
    LineRule("AUTORUN-FOLDER-OPEN", "autorun", "VULN", "CRITICAL", r"\"runOn\"\s*:\s*\"folderOpen\"", "runOn"),
    LineRule("AUTORUN-CREATE", "autorun", "VULN", "MAJOR", r"\"(postCreateCommand|onCreateCommand|postStartCommand)\"\s*:", "Command"),
    LineRule("AUTORUN-SERVER", "autorun", "HOTSPOT", "MAJOR", r"\"(mcpServers|command)\"\s*:\s*\"?(npx|uvx|bash|sh)\b", ""),
    LineRule("AGENT-OVERRIDE", "agent_doc", "VULN", "CRITICAL", r"(?i)\b(ignore|disregard|forget)\s+(all\s+|any\s+|the\s+)?(previous|prior|above|earlier)\s+(instructions|rules|prompts)", "", in_comments=True),
    LineRule("AGENT-CONCEAL", "agent_doc", "VULN", "CRITICAL", r"(?i)\b(do not|don't|never)\s+(tell|inform|mention|show|reveal).{0,30}\buser\b", "", in_comments=True),
    LineRule("AGENT-SEND-KEYS", "agent_doc", "VULN", "BLOCKER", r"(?i)\b(send|upload|post|exfiltrate)\b.{0,40}\b(keys?|tokens?|secrets?|credentials|passwords?|\.env)\b", "", in_comments=True),
    LineRule("AGENT-RUN-REMOTE", "agent_doc", "VULN", "BLOCKER", r"(?i)\b(run|execute)\b.{0,40}(curl|wget)\s+\S+\s*\|\s*(ba)?sh", "|", in_comments=True),
    LineRule("AGENT-APPROVE", "agent_doc", "VULN", "MAJOR", r"(?i)\b(auto-?approve|skip (the )?confirmation|without asking)\b", "", in_comments=True),
    LineRule("CONFIG-PASSWORD", "config", "VULN", "BLOCKER", r"(?i)^\s*[\"']?(password|passwd|secret|api_?key|token)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9/+_-]{8,}", "", "", r"(?i)(example|changeme|\$\{|<|xxxx)"),
    LineRule("CONFIG-NETRC", "config", "VULN", "BLOCKER", r"^\s*machine\s+\S+\s+login\s+\S+\s+password\s+\S+", "machine"),
    LineRule("CONFIG-URL-PASSWORD", "config", "VULN", "CRITICAL", r"[a-z]+://[^/\s:@]+:[^/\s:@]{3,}@", "://"),
    LineRule("MANIFEST-HOOK", "manifest", "HOTSPOT", "MAJOR", r"\"(preinstall|install|postinstall|prepare)\"\s*:\s*\"", "install\""),
    LineRule("MANIFEST-HOOK-NETWORK", "manifest", "VULN", "BLOCKER", r"\"(preinstall|install|postinstall)\"\s*:\s*\"[^\"]*(curl|wget|https?://)", "install\""),
    LineRule("MANIFEST-URL-DEPENDENCY", "manifest", "HOTSPOT", "MAJOR", r"\"[@a-z0-9/._-]+\"\s*:\s*\"(git\+|git://|https?://|github:)", "\""),
    LineRule("MANIFEST-ANY-VERSION", "manifest", "SMELL", "MINOR", r"\"[@a-z0-9/._-]+\"\s*:\s*\"(\*|latest|x)\"", "\""),
    LineRule("GYP-COMMAND", "manifest", "HOTSPOT", "MAJOR", r"<!@?\(", "<!"),
    LineRule("DEP-EVAL", "dependency", "VULN", "MAJOR", r"\beval\(", "eval(", prefix="node_modules/"),
    LineRule("JS-DEBUGGER", "language", "SMELL", "MINOR", r"^\s*debugger\b", "debugger", langs="js,ts"),
    LineRule("PY-BARE-EXCEPT", "language", "SMELL", "MINOR", r"^\s*except\s*:", "except", langs="py"),
]

#: Files in which a download and its execution meet (received code), by patterns that must all match.
TOGETHER = {
    "RECEIVED-SHELL": [r"\b(curl|wget)\s[^|\n]*\|\s*(sudo\s+)?(ba|z|da)?sh\b"],
    "RECEIVED-PY": [r"(urlopen|requests\.get|urlretrieve)\(", r"\b(exec|eval|subprocess\.(run|Popen|call)|os\.system)\("],
    "RECEIVED-JS": [r"(https?\.get|fetch|axios\.get)\(", r"\b(eval|new Function|child_process|execSync)\b"],
    "INSTALL-RISK": [r"\"(preinstall|postinstall)\"", r"(process\.env|child_process|https?://)"],
}


def pack_table(spark: SparkSession, pack: Sequence[LineRule] = PACK) -> DataFrame:
    return spark.createDataFrame([asdict(r) for r in pack], "id string, family string, type string, severity string, pattern string, gate string, need string, skip string, langs string, prefix string, in_comments boolean")


def pack_of(table: DataFrame) -> list[LineRule]:
    """The rules of a pack given as a table; packs are small, thousands of rows at most."""
    return [LineRule(**r.asDict()) for r in table.orderBy("id").collect()]


def _hit(rule: LineRule, line: Column, text: Column, path: Column, lang: Column) -> Column:
    tests = [line.contains(rule.gate)] if rule.gate else []
    tests.append(line.rlike(rule.pattern))
    if rule.skip:
        tests.append(~line.rlike(rule.skip))
    if not rule.in_comments:
        tests.append(~line.rlike(COMMENT))
    if rule.need:
        tests.append(text.rlike(rule.need))
    if rule.langs:
        tests.append(lang.isin(*rule.langs.split(",")))
    if rule.prefix:
        tests.append(path.startswith(rule.prefix))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def detect(files: DataFrame, pack: Sequence[LineRule] = PACK, key: str = "file_id", around: int | None = None) -> DataFrame:
    """(key, path, line_no, rule, family, type, severity) of files (key, path, lang, text), in one row-wise pass.

    Only files that hold the literal of some rule, or are read by a rule without one, are cut into lines; lines are
    tested in the row and only hits are exploded.  With ``around``, also ``line`` and ``around``: how many lines of the
    file, itself included, are at most so many away from it; they come from the row, too, so nothing is joined.
    """
    lines = F.split("text", "\n")
    window = lambda line, k: [] if around is None else [line.alias("line"), (F.least(k + 1 + around, F.size(lines)) - F.greatest(k + 1 - around, F.lit(1)) + 1).cast("long").alias("around")]
    tested = F.transform(lines, lambda line, k: F.transform(F.array_compact(F.array(*[F.when(_hit(r, line, F.col("text"), F.col("path"), F.col("lang")), F.lit(n)) for n, r in enumerate(pack)])), lambda n: F.struct((k + 1).cast("long").alias("line_no"), n.alias("n"), *window(line, k))))
    hits = files.filter("text is not null").select(key, "path", F.explode(F.flatten(tested)).alias("h"))
    names = lambda of: F.element_at(F.array(*[F.lit(getattr(r, of)) for r in pack]), F.col("h.n") + 1)
    return hits.select(key, "path", F.col("h.line_no").alias("line_no"), names("id").alias("rule"), names("family").alias("family"), names("type").alias("type"), names("severity").alias("severity"), *([] if around is None else ["h.line", "h.around"]))


def together(files: DataFrame, rules: dict[str, list[str]] = TOGETHER, key: str = "file_id") -> DataFrame:
    """(key, rule): files in which all patterns of a rule match."""
    def every(patterns: list[str]) -> Column:
        out = F.col("text").rlike(patterns[0])
        for p in patterns[1:]:
            out = out & F.col("text").rlike(p)
        return out

    return files.select(key, F.explode(F.array_compact(F.array(*[F.when(every(p), F.lit(r)) for r, p in rules.items()]))).alias("rule"))


def suppressed(findings: DataFrame, lines: DataFrame, key: str = "file_id", marker: str = r"(?:#|//|--)\s*nosec(?::\s*([A-Z0-9, -]+))?", never: str = r"^(SIGN|RUN)-") -> DataFrame:
    """Findings without those that a marker on their line, or on the line above if that is a comment, takes back.

    A marker with rule ids takes back those rules only; rules of ``never`` are not taken back.
    """
    marked = lines.filter(F.col("line").rlike(marker)).select(key, "line_no", "line", F.regexp_extract("line", marker, 1).alias("ids"))
    reach = marked.select(key, F.explode(F.when(F.col("line").rlike(COMMENT), F.array(F.col("line_no"), F.col("line_no") + 1)).otherwise(F.array("line_no"))).alias("line_no"), F.transform(F.filter(F.split("ids", ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x)).alias("ids"))
    reach = reach.select(key, "line_no", F.explode_outer("ids").alias("only_"))
    same = [findings[key] == reach[key], findings["line_no"] == reach["line_no"], reach["only_"].isNull() | (reach["only_"] == findings["rule"]), ~findings["rule"].rlike(never)]
    return findings.join(reach, same, "left_anti")


def with_snippet(findings: DataFrame, most: int = 80) -> DataFrame:
    """``snippet`` in place of ``line``: the line clipped to ``most`` characters."""
    clipped = F.when(F.length("line") > most, F.concat(F.substring("line", 1, most - 3), F.lit("..."))).otherwise(F.col("line"))
    return findings.withColumn("snippet", clipped).drop("line")


def with_window(findings: DataFrame, lines: DataFrame, key: str = "file_id", around: int = 2, most: int = 80) -> DataFrame:
    """Adds ``snippet``: the line clipped to ``most`` characters, and ``around``: how many lines stand about it.

    For findings and lines that come apart; ``detect`` gives both from the row. Lines are made from rows, so Spark takes
    them for much smaller than they are: neither side is sent to the driver.
    """
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(-around, around)
    context = lines.select(key, "line_no", "line", F.count("*").over(w).alias("around"))
    return with_snippet(findings.join(context.hint("merge"), [key, "line_no"]), most)


def function_metrics(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, function, line_no, length, complexity): functions by their heads, up to the next head of the file.

    Complexity is 1 and one more for each branch word or operator of the function's lines that are no comments.
    """
    head = r"^\s*(?:async\s+)?(?:def|function|func|fn)\s+([A-Za-z_][A-Za-z0-9_]*)"
    branch = r"\b(?:if|elif|for|while|case|catch|except|and|or)\b|&&|\|\|"
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("name_", F.regexp_extract("line", head, 1)).withColumn("at_", F.max(F.when(F.col("name_") != "", F.col("line_no"))).over(w)).filter("at_ is not null")
    counted = F.when(F.col("line").rlike(COMMENT), 0).otherwise(F.regexp_count("line", F.lit(branch)))
    return named.groupBy(key, F.col("at_").alias("line_no")).agg(F.max(F.when(F.col("line_no") == F.col("at_"), F.col("name_"))).alias("function"), F.count("*").alias("length"), (1 + F.sum(counted)).cast("long").alias("complexity"))


def refused_pattern(pattern: Column) -> Column:
    """Why a pattern given by a user is refused: too long, or a repetition of a repetition; null if it may be used."""
    nested = r"\([^()]*[+*][^()]*\)\s*[+*{]"
    return F.when(F.length(pattern) > 1000, "too long").when(pattern.rlike(nested), "nested repetition").when(pattern.rlike(r"\\[1-9]"), "back reference")
