"""Sortable keys of version strings, and tests of ranges with three outcomes.

A key is a string that sorts as its scheme orders versions.  A number in it is preceded by how many digits it has, so
numbers of any length sort; a part that is absent has a letter or digit of its own below or above the others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer strings are not comparable.
LONGEST = 128


def release_key(version: Column) -> Column:
    """A string that sorts as the numbers of a dotted version do; null where it isn't one. Trailing zeros don't count."""
    numeric = version.rlike(r"^[0-9]{1,9}(\.[0-9]{1,9})*$") & (F.length(version) <= LONGEST)
    parts = F.split(F.regexp_replace(version, r"(\.0+)+$", ""), r"\.")
    return F.when(numeric, F.array_join(F.transform(parts, lambda p: F.lpad(F.regexp_replace(p, "^0+([0-9])", "$1"), 10, "0")), "."))


# The forms that the two schemes define, for lower-cased texts without blanks around.
_PEP_FORM = "^v?(?:([0-9]+)!)?([0-9]+(?:[.][0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]+)?)?(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]+)?)?(?:[-_.]?(dev)[-_.]?([0-9]+)?)?(?:[+]([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
_SEM_FORM = "^[v=]?[ ]*([0-9]+(?:[.][0-9]+)*)(?:-([0-9A-Za-z-]+(?:[.][0-9A-Za-z-]+)*))?(?:[+][0-9A-Za-z.-]+)?$"
#: Ecosystems whose versions are semantic versions and nothing else.
SEMANTIC_ONLY = ("go", "crates")


def _number(digits: Column) -> Column:
    short = F.regexp_replace(F.when(digits == "", "0").otherwise(digits), "^0+([0-9])", "$1")
    return F.concat(F.lpad(F.length(short).cast("string"), 3, "0"), short)


def _numbers(dotted: Column) -> Column:
    """Trailing zeros don't count; a version of more parts is above the one it goes on from."""
    return F.concat(F.array_join(F.transform(F.split(F.regexp_replace(dotted, "([.]0+)+$", ""), "[.]"), _number), "."), F.lit("."))


def pep440(version: Column, with_local: bool = True) -> Column:
    """Key in the order of PEP 440; null where a version is not of its form."""
    v = F.lower(F.trim(version))
    g = lambda k: F.regexp_extract(v, _PEP_FORM, k)
    development, later = g(8) != "", (g(5) != "") | (g(6) != "")
    kind = F.when(g(3).isin("a", "alpha"), "a").when(g(3).isin("b", "beta"), "b").when(g(3) != "", "c")
    before = F.when(kind.isNotNull(), F.concat(kind, _number(g(4)))).when(development & ~later, "0").otherwise("z")
    after = F.when(later, F.concat(F.lit("1"), _number(F.when(g(5) != "", g(5)).otherwise(g(7))))).otherwise("0")
    unfinished = F.when(development, F.concat(F.lit("0"), _number(g(9)))).otherwise("1")
    key = F.concat_ws("!", _number(g(1)), _numbers(g(2)), before, after, unfinished)
    if with_local:
        part = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("1"), _number(x))).otherwise(F.concat(F.lit("0"), x))
        key = F.concat(key, F.lit("!"), F.when(g(10) != "", F.array_join(F.transform(F.split(g(10), "[-_.]"), part), "!")).otherwise(""))
    return F.when((F.length(version) <= LONGEST) & v.rlike(_PEP_FORM), key)


def semantic(version: Column) -> Column:
    """Key in the order of semantic versions (any number of parts); null where a version is not of their form."""
    v = F.trim(version)
    g = lambda k: F.regexp_extract(v, _SEM_FORM, k)
    part = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x))
    before = F.when(g(2) == "", "z").otherwise(F.concat(F.lit("0"), F.array_join(F.transform(F.split(g(2), "[.]"), part), "!")))
    return F.when((F.length(version) <= LONGEST) & v.rlike(_SEM_FORM), F.concat_ws("!", _numbers(g(1)), before))


def keyed(version: Column) -> Column:
    """What comparisons need of a version: both keys, the first without the local label too; null without a version."""
    return F.when(version.isNotNull(), F.struct(version.alias("text"), pep440(version).alias("pep"), pep440(version, False).alias("plain"), semantic(version).alias("sem")))


def _first_scheme(ecosystem: Column, dashed: Column, pep: Column, sem: Column) -> Column:
    return F.when(ecosystem.isin(*SEMANTIC_ONLY), sem).when((ecosystem == "npm") | (~ecosystem.eqNullSafe("pypi") & dashed), F.coalesce(sem, pep)).otherwise(F.coalesce(pep, sem))


def comparable(v: Column, ecosystem: Column) -> Column:
    """Whether a keyed version has a key under a scheme of its ecosystem."""
    return v.isNotNull() & _first_scheme(ecosystem, F.lit(False), v["pep"], v["sem"]).isNotNull()


def compared(a: Column, b: Column, ecosystem: Column) -> Column:
    """-1, 0 or 1 for keyed versions a and b, under the first scheme that has keys for both; else null.

    The local label of a counts only if b has one.
    """
    order = lambda x, y: F.when(x < y, -1).when(x == y, 0).when(x > y, 1)
    pep = F.when(b["text"].contains("+"), order(a["pep"], b["pep"])).otherwise(order(a["plain"], b["plain"]))
    return _first_scheme(ecosystem, a["text"].contains("-") | b["text"].contains("-"), pep, order(a["sem"], b["sem"]))


def unbounded(bound: Column) -> Column:
    return bound.isNull() | bound.isin("", "*")


def within(v: Column, ecosystem: Column, low: Column, low_included: Column, high: Column, high_included: Column) -> Column:
    """Whether a keyed version is in a range of keyed bounds; null where it, or a bound that decides, can't be compared."""
    c, d = compared(v, low, ecosystem), compared(v, high, ecosystem)
    open_low, open_high = unbounded(low["text"]), unbounded(high["text"])
    above, below = open_low | (c > 0) | (low_included & (c == 0)), open_high | (d < 0) | (high_included & (d == 0))
    return F.when(~comparable(v, ecosystem), None).when(~open_low & c.isNull(), None).when(~above, False).when(~open_high & d.isNull(), None).otherwise(below)


def format_range(low: Column, low_included: Column, high: Column, high_included: Column) -> Column:
    """A range as text: ">=1.0 <2.0", or "all versions"."""
    a = F.when(~unbounded(low), F.concat(F.when(low_included, ">=").otherwise(">"), low))
    b = F.when(~unbounded(high), F.concat(F.when(high_included, "<=").otherwise("<"), high))
    return F.when(a.isNull() & b.isNull(), "all versions").otherwise(F.concat_ws(" ", a, b))


def major(version: Column) -> Column:
    return F.regexp_extract(version, r"^v?(?:[0-9]+!)?([0-9]{1,9})", 1).try_cast("long")


def is_prerelease(version: Column) -> Column:
    return F.lower(version).rlike(r"[0-9](-|\.)?(a|b|rc|alpha|beta|pre|preview|dev)[0-9.]*")
