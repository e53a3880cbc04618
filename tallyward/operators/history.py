"""Release histories: windows and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INFLATED, JUMP, FLOOD, FLOOD_HOURS, PRIOR_DAYS = 99, 50, 20, 24, 7


def timeline(releases: DataFrame, key: str) -> Window:
    return Window.partitionBy(key).orderBy(F.col("published_at").asc_nulls_first(), "pos")


def inflated(releases: DataFrame, key: str, least: int = INFLATED, jump: int = JUMP) -> DataFrame:
    """Adds ``inflated`` (major of 99 or more that isn't a year, of a version without epoch) and ``new_inflation`` (the
    first, or a jump of 50).  Releases may have a column ``epoch``."""
    before = F.max("major").over(timeline(releases, key).rowsBetween(Window.unboundedPreceding, -1))
    calendar = F.col("major").between(1990, 2100) | F.col("major").between(19900101, 21001231)
    r = releases.withColumn("high_before", before).withColumn("inflated", (F.col("major") >= least) & ~calendar & ((F.coalesce("epoch", F.lit(0)) == 0) if "epoch" in releases.columns else F.lit(True)))
    return r.withColumn("new_inflation", F.col("inflated") & (F.col("high_before").isNull() | (F.col("major") - F.col("high_before") >= jump)))


def flood(events: DataFrame, key: str, ts: str, more_than: int = FLOOD, hours: int = FLOOD_HOURS) -> DataFrame:
    """Adds ``most``: releases in the fullest window of so many hours that holds this one; and ``flood``."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    span = hours * 3_600_000_000
    w = Window.partitionBy(key).orderBy("us_")
    e = events.withColumn("us_", seconds).withColumn("ahead_", F.count("*").over(w.rangeBetween(0, span)))
    return e.withColumn("most", F.max("ahead_").over(w.rangeBetween(-span, 0))).withColumn("flood", F.col("most") > more_than).drop("us_", "ahead_")


def prior(releases: DataFrame, key: str, ts: str, id_col: str, days: int = PRIOR_DAYS) -> DataFrame:
    """Adds ``prior_id``: the newest release at least so many days older (the greater id among equal times)."""
    w = Window.partitionBy(key).orderBy("us_").rangeBetween(Window.unboundedPreceding, -days * 86_400_000_000)
    r = releases.withColumn("us_", F.unix_micros(F.col(ts).cast("timestamp")))
    return r.withColumn("prior_id", F.max(F.struct("us_", id_col)).over(w)[id_col]).drop("us_")


def prior_of_kind(releases: DataFrame, key: str, ts: str, id_col: str, days: int = PRIOR_DAYS) -> DataFrame:
    """Adds ``prior_id`` as ``prior``, but a release that is no pre-release (column ``pre``) has stable ones only before it."""
    w = Window.partitionBy(key).orderBy("us_").rangeBetween(Window.unboundedPreceding, -days * 86_400_000_000)
    r = releases.withColumn("us_", F.unix_micros(F.col(ts).cast("timestamp")))
    both, stable = F.max(F.struct("us_", id_col)).over(w)[id_col], F.max(F.when(~F.col("pre"), F.struct("us_", id_col))).over(w)[id_col]
    return r.withColumn("prior_id", F.when(F.col("pre"), both).otherwise(stable)).drop("us_")


def near_in_time(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """Pairs of rows of one key whose times (l_us, r_us) are within so many seconds.

    An interval join as an equi-join: times are dealt into buckets as long as the interval, the right side into the
    buckets on both sides, too.
    """
    span = seconds * 1_000_000
    a = left.withColumn("b_", F.floor(F.col("l_us") / span))
    b = right.withColumn("b_", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("r_us") / span) + d)))
    return a.join(b, [key, "b_"]).filter(F.abs(F.col("l_us") - F.col("r_us")) <= span).drop("b_")


def last_state(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last action of each key."""
    return events.groupBy(*keys).agg(F.max_by("action", F.struct(*order)).alias("action"))


def changed_identity(releases: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``changed``: some of the columns differ from the release before."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*columns)).over(w)
    return releases.withColumn("before_", before).withColumn("changed", F.col("before_").isNotNull() & ~F.col("before_").eqNullSafe(F.struct(*columns))).drop("before_")


def established(releases: DataFrame, key: str, ts: str, now: str, days: int = 365, versions: int = 3) -> DataFrame:
    return releases.groupBy(key).agg(F.min(ts).alias("first_at"), F.count("*").alias("n_versions")).withColumn("established", (F.datediff(F.lit(now).cast("date"), F.col("first_at").cast("date")) > days) & (F.col("n_versions") >= versions))
