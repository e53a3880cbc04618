"""Column functions on texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

#: Redactions in order: (pattern, replacement); patterns stay within what both Java and RE2 read alike.
REDACTIONS = [
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)", "[private key]"),
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}", "[jwt]"),
    (r"AKIA[0-9A-Z]{16}", "[access key]"),
    (r'(token|api_key|password|secret) = "[^"]{8,}"', '$1 = "[secret]"'),
    (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "[mail]"),
    (r"\b[0-9]{16}\b", "[number]"),
]
#: Zero-width and bidirectional control characters.
INVISIBLE = "[​-‏‪-‮⁠⁦-⁩﻿]"
#: Look-alike letters (Cyrillic and Greek) and what they are read as.
LOOKALIKE_FROM, LOOKALIKE_TO = "аеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijsABEZHIKMNOPTYXo"


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line (split at \\n only), numbered from 1, in place of the text."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("long"))


def entropy(column: Column) -> Column:
    """Shannon entropy in bits per character of a short string; 0 for an empty one."""
    chars = F.split(column, "")
    n = F.size(chars)
    counted = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(column) > 0, F.aggregate(counted, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(0.0)


def document_entropy(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, entropy) of long texts, counted in the row: each different character by how much shorter the text is
    without it."""
    rows = df.select(key, F.col(text).alias("t"), F.length(text).alias("n")).filter("n > 0")
    rows = rows.withColumn("kinds", F.filter(F.array_distinct(F.split("t", "")), lambda c: c != ""))
    sizes = F.transform("kinds", lambda c: F.col("n") - F.length(F.replace(F.col("t"), c, F.lit(""))))
    # -sum(p log2 p) = log2 N - sum(n log2 n) / N
    weighed = F.aggregate(sizes, F.lit(0.0), lambda acc, x: acc + x * F.log2(x))
    return rows.select(key, F.col("n").cast("long").alias("n_chars"), (F.log2("n") - weighed / F.col("n")).alias("entropy"))


def redact(column: Column) -> Column:
    for pattern, to in REDACTIONS:
        column = F.regexp_replace(column, pattern, to)
    return column


def fold_lookalikes(column: Column) -> Column:
    return F.translate(column, LOOKALIKE_FROM, LOOKALIKE_TO)


def normalise_name(column: Column) -> Column:
    """Case and separators folded: a run of what is neither letter nor digit is one hyphen."""
    return F.regexp_replace(F.lower(column), "[^a-z0-9]+", "-")


def terminal_safe(column: Column) -> Column:
    return F.regexp_replace(column, "[\\x00-\\x08\\x0b-\\x1f\\x7f]", "?")


@F.pandas_udf(StringType())
def unicode_nfkc(texts: pd.Series) -> pd.Series:
    """NFKC, for which Spark has no function."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(DoubleType())
def round_half_even_on_binary(values: pd.Series) -> pd.Series:
    """Rounds to one decimal place as Python does (0.25 -> 0.2, 0.35 -> 0.3)."""
    return values.map(lambda x: None if x is None or x != x else round(x, 1)).astype("float64")


# --- shapes of tokens ----------------------------------------------------------------------------------------------


def wallet_address(token: Column) -> Column:
    return token.rlike("^0x[0-9a-fA-F]{40}$")


def identifier_like(token: Column) -> Column:
    """Whether a token reads as a name in code: words joined by underscores or capitals, or without any digit."""
    return token.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (token.contains("_") | token.rlike("[a-z][A-Z]") | ~token.rlike("[0-9]"))


def sequence_run(token: Column) -> Column:
    """The longest run of characters of which each is the one that follows the one before (abcd, 1234); 0 for none."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), F.ascii)
    state = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))
    def step(s: Column, c: Column) -> Column:
        now = F.when(c == s["last"] + 1, s["now"] + 1).otherwise(1)
        return F.struct(c.alias("last"), now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(codes, state, step, lambda s: s["most"])


def looks_secret(token: Column, least: float = 3.0) -> Column:
    """Eight characters or more, of two kinds or more, no name, no run of six, and an entropy of ``least`` bits or more."""
    kinds = token.rlike("[a-z]").cast("int") + token.rlike("[A-Z]").cast("int") + token.rlike("[0-9]").cast("int") + token.rlike("[^A-Za-z0-9]").cast("int")
    return (F.length(token) >= 8) & (kinds >= 2) & ~identifier_like(token) & (sequence_run(token) < 6) & (entropy(token) >= least)


def embedded_data(text: Column) -> Column:
    """Base64 that is data by what it says it is (a data URL, a source map, an integrity digest), not a hidden payload."""
    return text.rlike(r"data:[a-z]+/[a-z0-9.+-]+;base64,|sourceMappingURL=|\bsha(256|384|512)-[A-Za-z0-9+/]")


# --- addresses and times -------------------------------------------------------------------------------------------


def address_class(address: Column) -> Column:
    """loopback, private, link-local, multicast, reserved or public for a dotted IPv4 address; null for anything else."""
    parts = F.split(address, r"\.")
    sound = address.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") & F.forall(parts, lambda x: x.cast("int") <= 255)
    a, b = parts[0].cast("int"), parts[1].cast("int")
    kind = F.when(a == 127, "loopback").when((a == 10) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)), "private").when((a == 169) & (b == 254), "link-local")
    return F.when(sound, kind.when(a.between(224, 239), "multicast").when((a == 0) | (a >= 240), "reserved").otherwise("public"))


def iso_time(text: Column) -> Column:
    """A timestamp from ISO 8601 text with or without a fraction and a zone (none: UTC); null for anything else."""
    sound = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$")
    return F.when(sound, F.try_to_timestamp(text))


def hour_name(at: Column) -> Column:
    """The name of an hour's file: the date and the hour without a leading zero (2024-05-01-7)."""
    return F.concat_ws("-", F.date_format(at, "yyyy-MM-dd"), F.hour(at).cast("string"))


def hour_of_name(name: Column) -> Column:
    return F.when(name.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}-([0-9]|1[0-9]|2[0-3])$"), F.try_to_timestamp(name, F.lit("yyyy-MM-dd-H")))


# --- decoding ------------------------------------------------------------------------------------------------------


def hex_escapes(text: Column) -> Column:
    """The longest run of \\xHH escapes of a text, decoded as UTF-8; null without one."""
    runs = F.regexp_extract_all(text, F.lit(r"((?:\\x[0-9a-fA-F]{2})+)"), F.lit(1))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    return F.try_to_binary(F.regexp_replace(longest, r"\\x", ""), F.lit("hex")).cast("string")


def character_codes(text: Column) -> Column:
    """What String.fromCharCode(...) or a list of chr(...) spells; null without one."""
    listed = F.regexp_extract(text, r"fromCharCode\(([0-9, ]+)\)", 1)
    codes = F.when(listed != "", F.split(listed, ",")).otherwise(F.regexp_extract_all(text, F.lit(r"\bchr\(([0-9]+)\)"), F.lit(1)))
    made = F.transform(codes, lambda c: F.char(F.trim(c).cast("long")))
    return F.when(F.size(codes) > 0, F.array_join(made, ""))


# --- digests -------------------------------------------------------------------------------------------------------


def hmac_sha256(text: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in hexadecimal digits, for a key of 64 bytes at most."""
    if len(key) > 64:
        raise ValueError("keys of more than 64 bytes are digested first; pass the digest")
    pad = lambda x: F.lit(bytes(b ^ x for b in key.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), text.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def fnv1a(text: Column) -> Column:
    """FNV-1a of 64 bits over the UTF-8 bytes, as a decimal number of 20 digits at most."""
    # Fixed values of the function: its offset and its prime.
    offset, prime, whole = 14695981039346656037, 1099511628211, 1 << 64
    digits = F.filter(F.split(F.regexp_replace(F.hex(text.cast("binary")), "(..)", "$1 "), " "), lambda x: x != "")
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    # The exclusive or touches the lowest byte only; the product is taken in two halves, each within 38 digits.
    def step(h: Column, byte: Column) -> Column:
        low = (h % big(256)).cast("int")
        x = h - low + low.bitwiseXOR(F.conv(byte, 16, 10).cast("int"))
        return ((x * big(prime)).cast("decimal(38,0)") % big(whole)).cast("decimal(38,0)")

    return F.aggregate(digits, big(offset), step)


# --- structures ----------------------------------------------------------------------------------------------------


def json_leaves(text: Column) -> Column:
    """All string values of a JSON text, at any depth, in order (names of members are not values)."""
    found = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    values = F.filter(found, lambda x: ~x.endswith(":"))
    return F.transform(values, lambda x: F.try_element_at(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(1)))


def json_depth(text: Column) -> Column:
    """How deep a JSON text nests; what stands in strings does not count."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.split(bare, ""), state, step, lambda s: s["most"])


def fill_template(template: str, **values: Column) -> Column:
    """A message from a template with {names}; a null value leaves its place empty."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def yaml_outline(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, depth, name, value): the lines of a YAML text that are members, with the depth of their indent."""
    numbered = lines(df.select(key, text), text).filter(~F.col("line").rlike(r"^\s*(#|$)"))
    form = r"^(\s*)(?:-\s+)?([A-Za-z0-9_.$-]+)\s*:(?:\s+(.*?))?\s*$"
    g = lambda k: F.regexp_extract("line", form, k)
    return numbered.filter(F.col("line").rlike(form)).select(key, "line_no", (F.length(g(1)) / 2).cast("int").alias("depth"), g(2).alias("name"), F.regexp_replace(g(3), r"\s+#.*$", "").alias("value"))


def _unicode_form(form: str):
    @F.pandas_udf(StringType())
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normalise


unicode_nfc, unicode_nfd, unicode_nfkd = map(_unicode_form, ("NFC", "NFD", "NFKD"))


@F.pandas_udf(BooleanType())
def assigned_in_unicode_3(texts: pd.Series) -> pd.Series:
    """Whether all characters of a text were assigned in the pinned Unicode version that Python carries (3.2)."""
    return texts.map(lambda x: None if x is None else all(unicodedata.ucd_3_2_0.category(c) != "Cn" for c in x))
