"""Mixing sources to target weights: hierarchical budgets over a domain - language - source tree.

A total of tokens is handed down a tree.  At each node it is split among the children by their weights; what a child
can't use (its documents' tokens times the epochs allowed) is shared by its siblings that can, in proportion to their
weights.  Since a node is never given more than all below it can use, a shortage is made up among siblings first and
reaches an ancestor's siblings only when no sibling has room.  The split is exact in integers: children are taken in
the order of capacity over weight; the ones that fill up get their capacity, the others floors of their shares and, in
that order, one token each of what is left.  Budgets are computed in decimals of 38 digits, so they are exact beyond
2**53 tokens; so is the order for weights below 2**26.

A leaf's tokens are then taken from its documents in seeded order (the MD5 of seed, epoch and id), epoch after epoch: a
document is taken while the tokens before it are fewer than the leaf's budget, so a budget is exceeded by less than one
document.  No leaf is sorted in one place: tokens are summed by the first digits of the digest, running sums over those
sums (65,536 rows for a leaf at most, however many documents it has) give the slice in which the budget ends, and only
the documents of that slice are ordered.  All else is decided by
comparing digests with one short row for each leaf, so texts are never shuffled.

Everything is DataFrame operations.  Cases: null domains, languages or sources are leaves like any others; a null or
empty text has no tokens and is taken as long as its leaf has budget left where it stands; a weight of 0 excludes a
subtree; repeated ids are ordered by text; an empty table gives an empty result; other columns are passed through,
whatever their names, but columns named m_domain, m_lang, m_source, m_tokens or m_epoch are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.plans.lineage import cut

#: Hexadecimal digits by which a leaf is sliced: 16 ** 4 slices at most for each leaf.
SLICE_DIGITS = 4
_LEAF = ["m_domain", "m_lang", "m_source"]
_WHOLE = "decimal(38,0)"


def count_words(text: Column) -> Column:
    """Tokens of a text for the budget: its words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def split_budget(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds ``got`` to rows (parent columns, name, weight, capacity, given): each parent's ``given`` split by water level."""
    # Capacity over weight: whole part, then a fraction of small integers, which a double tells apart.
    by_share = [F.expr("capacity div weight").asc(), (F.expr("capacity % weight").cast("double") / F.col("weight")).asc(), F.col(name).asc_nulls_first()]
    order = Window.partitionBy(*parent).orderBy(*by_share)
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.filter("weight > 0").withColumn("rest", (F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).cast(_WHOLE)).withColumn("share", F.sum("weight").over(behind).cast(_WHOLE))
    # Filled up to its capacity: the level that would be reached with this child and those behind it is above it.
    n = n.withColumn("full", F.expr(f"cast(capacity as {_WHOLE}) * share <= cast(weight as {_WHOLE}) * rest"))
    n = n.withColumn("level_rest", F.first(F.when(~F.col("full"), F.col("rest")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    n = n.withColumn("level_share", F.first(F.when(~F.col("full"), F.col("share")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    n = n.withColumn("part", F.when(F.col("full"), F.col("capacity").cast("long")).otherwise(F.expr(f"cast((cast(weight as {_WHOLE}) * level_rest) div level_share as long)")))
    whole = Window.partitionBy(*parent)
    n = n.withColumn("left_over", F.least(F.col("given"), F.sum("capacity").over(whole)) - F.sum("part").over(whole))
    place = F.row_number().over(Window.partitionBy(*parent, "full").orderBy(*by_share))
    return n.withColumn("got", (F.col("part") + F.when(~F.col("full") & (place <= F.col("left_over")), 1).otherwise(0)).cast("long"))


def budgets(leaves: DataFrame, weights: Sequence[dict[str, int]], total: Column | int, default_weight: int = 1) -> DataFrame:
    """(leaf columns, supply, capacity, budget) from leaves with their supply and capacity of tokens."""
    total = F.lit(total) if isinstance(total, int) else total

    def weight(level: int) -> Column:
        known = weights[level]
        column = F.col(_LEAF[level])
        chosen = F.lit(default_weight)
        for key, w in sorted(known.items()):
            chosen = F.when(column == key, F.lit(w)).otherwise(chosen)
        return chosen.cast("long")

    # A subtree of weight 0 offers nothing to its ancestors.
    leaves = leaves.withColumn("capacity", F.when((weight(0) > 0) & (weight(1) > 0) & (weight(2) > 0), F.col("capacity")).otherwise(0).cast("long"))
    given = leaves.groupBy().agg(F.sum("capacity").alias("all"), F.sum("supply").alias("supplied")).select(F.least(total.cast("long"), F.col("all")).alias("given"))
    for depth in (1, 2, 3):
        nodes = leaves.groupBy(*_LEAF[:depth]).agg(F.sum("capacity").cast("long").alias("capacity")).withColumn("weight", weight(depth - 1))
        if depth == 1:
            nodes = nodes.crossJoin(F.broadcast(given))  # one row
            parent: list[str] = []
        else:
            parent = _LEAF[: depth - 1]
            up = result.select(*[F.col(c).alias(f"{c}_") for c in parent], F.col("got").alias("given"))  # noqa: F821
            nodes = nodes.join(up, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in parent]).drop(*[f"{c}_" for c in parent])
        result = split_budget(nodes.withColumn("root", F.lit(0)), parent or ["root"], _LEAF[depth - 1])
    return result.select(*_LEAF, "capacity", F.col("got").alias("budget"))


def mix(
    docs: DataFrame,
    domain: Column,
    lang: Column,
    source: Column,
    weights: Sequence[dict[str, int]],
    tokens: Column,
    share: float = 0.6,
    epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The chosen rows of docs, with m_domain, m_lang, m_source, m_tokens and m_epoch (0, 1, ...).

    ``share`` is the size of the mix as a share of all tokens (in thousandths, rounded down).
    """
    # A row's own columns stand in one, so that their names can't clash with those used here.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), domain.alias("m_domain"), lang.alias("m_lang"), source.alias("m_source"), tokens.cast("long").alias("m_tokens"))
    tie = F.md5(F.coalesce(F.col("row")[text_col], F.lit("")))
    key = lambda epoch: F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("row")[id_col].cast("string"), F.lit("null")))), tie)
    narrow = cut(rows.select(*_LEAF, "m_tokens", *[key(F.lit(e)).alias(f"k{e}") for e in range(epochs)]))

    leaves = narrow.groupBy(*_LEAF).agg(F.sum("m_tokens").alias("supply"), F.count("*").alias("n")).withColumn("capacity", F.col("supply") * epochs)
    total = F.expr(f"cast(supplied as {_WHOLE}) * {int(share * 1000)} div 1000")
    plan = budgets(leaves, weights, total).join(leaves.select(*[F.col(c).alias(f"{c}_") for c in _LEAF], "supply"), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in _LEAF]).select(*_LEAF, "supply", "budget")
    # Whole epochs, and what is left for the last one.
    plan = plan.withColumn("whole", F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(0).cast("int")).withColumn("last", F.expr("budget - whole * supply"))
    plan = cut(plan)

    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in _LEAF]
    open_ = plan.filter("last > 0")
    last_key = F.coalesce(*[F.when(F.col("whole") == e, F.col(f"k{e}")) for e in range(epochs)])
    small = F.broadcast(open_) if _few(open_) else open_
    dealt = narrow.join(small, same(narrow, open_)).select(*[narrow[c] for c in _LEAF], "m_tokens", "last", last_key.alias("key"))
    sliced = dealt.groupBy(*_LEAF, "last", F.substring("key", 1, SLICE_DIGITS).alias("slice")).agg(F.sum("m_tokens").alias("t"))
    running = Window.partitionBy(*_LEAF).orderBy("slice")
    border = sliced.withColumn("before", F.sum("t").over(running) - F.col("t")).filter("before < last and before + t >= last").select(*_LEAF, "slice", "before")
    border = cut(border)  # a row for each leaf
    small = F.broadcast(border) if _few(border) else border
    inside = dealt.join(small, [*same(dealt, border), F.substring(dealt["key"], 1, SLICE_DIGITS) == border["slice"]]).select(*[dealt[c] for c in _LEAF], "m_tokens", "last", "key", "before")
    ordered = Window.partitionBy(*_LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    # The first document that is not taken any more is the first with the budget's tokens before it.
    final = inside.withColumn("sum", F.col("before") + F.coalesce(F.sum("m_tokens").over(ordered), F.lit(0))).filter("sum < last").groupBy(*_LEAF).agg(F.max("key").alias("upto"))
    cuts = cut(plan.join(final.select(*[F.col(c).alias(f"{c}_") for c in _LEAF], "upto"), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in _LEAF], "left").select(*[F.col(c).alias(f"{c}_") for c in _LEAF], "whole", "upto"))

    small = F.broadcast(cuts) if _few(cuts) else cuts
    chosen = rows.join(small, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in _LEAF])
    own = F.coalesce(*[F.when(F.col("whole") == e, key(F.lit(e))) for e in range(epochs)])
    times = F.col("whole") + F.when(F.col("upto").isNotNull() & (own <= F.col("upto")), 1).otherwise(0)
    taken = chosen.withColumn("times", times).filter("times > 0").withColumn("m_epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    own_columns = [F.col("row")[c].alias(c) for c in docs.columns if c not in (*_LEAF, "m_tokens", "m_epoch")]
    return taken.select(*own_columns, *_LEAF, "m_tokens", "m_epoch")


#: Rows (leaves) that are sent to all tasks at most; with more the join is left to Spark.
BROADCAST_LEAVES = 100_000


def _few(leaves: DataFrame) -> bool:
    return leaves.count() <= BROADCAST_LEAVES
