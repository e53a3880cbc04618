"""What discovery keeps, which code is in use, and code without its comments and strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Patterns on names and descriptions; what is excluded stays out even if it is included, unless it is ``always`` in."""

    always: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()

    @classmethod
    def read(cls, text: str) -> Filters:
        """From lines ``kind: pattern``; blank lines and those that begin with # say nothing."""
        held: dict[str, list[str]] = {"always": [], "exclude": [], "include": [], "marker": []}
        for number, line in enumerate(text.splitlines(), 1):
            if line.strip() and not line.lstrip().startswith("#"):
                kind, _, pattern = line.partition(":")
                if kind.strip() not in held or not pattern.strip():
                    raise ValueError(f"line {number} is no filter: {line}")
                held[kind.strip()].append(pattern.strip())
        return cls(*(tuple(held[k]) for k in ("always", "exclude", "include", "marker")))


def _any(column: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | column.rlike(p)
    return F.coalesce(out, F.lit(False))


def discovered(repositories: DataFrame, filters: Filters, name: str = "name", about: str = "about") -> DataFrame:
    """Adds ``why`` (always, marker or include) to the repositories that filters keep, in that order of precedence."""
    n, d = F.col(name), F.coalesce(F.col(about), F.lit(""))
    why = F.when(_any(n, filters.always), "always").when(_any(n, filters.exclude) | _any(d, filters.exclude), None).when(_any(d, filters.markers), "marker").when(_any(n, filters.include) if filters.include else F.lit(True), "include")
    return repositories.withColumn("why", why).filter("why is not null")


#: Folders whose code is not run in use.
UNUSED_FOLDERS = ("test", "tests", "__tests__", "spec", "docs", "doc", "examples", "example", "fixtures", "benchmarks")


def in_use(path: Column) -> Column:
    """Whether no folder of a path is one of tests, documents or examples; a file's own name does not count."""
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.exists(folders, lambda f: f.isin(*UNUSED_FOLDERS))


# What begins comments and strings, by language.
_STRINGS = {
    "python": r'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'',
    "c": r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`',
    "sql": r"'(?:[^']|'')*'",
    "shell": r'"(?:[^"\\]|\\.)*"|\'[^\']*\'',
}
_COMMENTS = {"python": r"#[^\n]*", "c": r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/", "sql": r"--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/", "shell": r"(?<![^\s;])#[^\n]*"}
#: Languages that are read as another one.
FAMILY = {"py": "python", "python": "python", "js": "c", "ts": "c", "javascript": "c", "typescript": "c", "go": "c", "rust": "c", "rs": "c", "java": "c", "c": "c", "cpp": "c", "sql": "sql", "sh": "shell", "shell": "shell", "yml": "shell"}


def _by_language(text: Column, lang: Column, of) -> Column:
    out = text
    for family in _STRINGS:
        names = [k for k, v in FAMILY.items() if v == family]
        out = F.when(lang.isin(*names), of(family)).otherwise(out)
    return out


def without_comments(text: Column, lang: Column) -> Column:
    """Code without its comments; a sign of a comment within a string is left alone.  Other languages stay as they are."""
    return _by_language(text, lang, lambda f: F.regexp_replace(text, f"({_STRINGS[f]})|(?:{_COMMENTS[f]})", "$1"))


def without_strings(text: Column, lang: Column) -> Column:
    """Code without its comments, and with empty strings in place of its strings."""
    return _by_language(text, lang, lambda f: F.regexp_replace(F.regexp_replace(text, f"({_STRINGS[f]})|(?:{_COMMENTS[f]})", "$1"), _STRINGS[f], '""'))


def string_literals(text: Column, lang: Column) -> Column:
    """The string literals of a code, with their quotes, in order; none for other languages."""
    found = F.array().cast("array<string>")
    for family in _STRINGS:
        names = [k for k, v in FAMILY.items() if v == family]
        both = F.regexp_extract_all(text, F.lit(f"({_STRINGS[family]})|(?:{_COMMENTS[family]})"), F.lit(1))
        found = F.when(lang.isin(*names), F.filter(both, lambda x: x != "")).otherwise(found)
    return found


# --- arrays as databases write them --------------------------------------------------------------------------------


def parse_array(text: Column) -> Column:
    """The elements of an array literal such as {a,"b,c",NULL}; null for what is not one (nested ones are not)."""
    item = r'"((?:[^"\\]|\\.)*)"|([^,{}"]+)'
    inner = F.regexp_extract(text, r"^\{(.*)\}$", 1)
    raw = F.regexp_extract_all(inner, F.lit(item), F.lit(0))
    value = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.substring(x, 2, 1_000_000).substr(F.lit(1), F.length(x) - 2), r"\\(.)", "$1")).when(F.upper(x) != "NULL", x)
    return F.when(text.rlike(r'^\{(?:(?:"(?:[^"\\]|\\.)*"|[^,{}"]+)(?:,(?!\})|(?=\})))*\}$'), F.transform(raw, value))


def encode_array(items: Column) -> Column:
    """An array literal of strings; what needs quotes gets them."""
    quoted = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))
    one = lambda x: F.when(x.isNull(), "NULL").when((x == "") | x.rlike(r'[,{}"\\\s]') | (F.upper(x) == "NULL"), quoted(x)).otherwise(x)
    return F.concat(F.lit("{"), F.array_join(F.transform(items, one), ","), F.lit("}"))


def decoded_columns(df: DataFrame, kinds: dict[str, str], decoders: dict[str, object] | None = None) -> DataFrame:
    """Text columns of a database decoded by their kinds (column -> kind); ``decoders`` adds or replaces kinds."""
    known = {
        "int8": lambda c: c.try_cast("long"), "numeric": lambda c: c.try_cast("decimal(38,9)"), "bool": lambda c: F.when(c.isin("t", "true"), True).when(c.isin("f", "false"), False),
        "timestamptz": lambda c: F.try_to_timestamp(c), "text[]": parse_array, "bytea": lambda c: F.unhex(F.regexp_extract(c, r"^\\x([0-9a-fA-F]*)$", 1)), "jsonb": lambda c: F.try_parse_json(c) if hasattr(F, "try_parse_json") else c,
    } | (decoders or {})
    return df.withColumns({c: known[k](F.col(c)) for c, k in kinds.items() if k in known})
