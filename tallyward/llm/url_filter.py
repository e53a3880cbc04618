"""URL filtering by rules, and by the ratio of two character models for what no rule decides.

The rules are tried first, the longest first.  The URLs that they accept and those that they reject train a character
model each: a Markov model of variable order, in which a context of n characters is smoothed by the one of n - 1 as
Witten and Bell do, down to a uniform distribution.  A URL that no rule decides is accepted if its log-likelihood
ratio, divided by its length, reaches a threshold, at which the decisions of two models agree best with those of the
rules on texts that these have not learned from (the mean of both classes' accuracy).

Characters are counted over all URLs that a rule decides; a task sends on sums of its counts, and none is left out.
Counts of up to ``MODEL_GRAMS`` for each class are sent to the tasks whole; beyond that nothing is sent, and the distinct
n-grams of the URLs are joined with the counts.  Sums are of whole numbers, so both ways give the same scores.

Cases: host and path of a null URL and one without ``://`` are empty, and no rule decides it; its text (or none) goes to
the models like any other.  With no URL of one class to learn from, all that no rule decides is accepted.  Repeated
rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm import textkit
from tallyward.plans.lineage import cut

ORDER = 5
#: Pairs of context and successor (40 bytes each) of a class that are sent to the tasks; with more, they are joined.
MODEL_GRAMS = 400_000
#: N-grams whose ratios are sent to the tasks when the others are joined, since many URLs have them.
HOT_GRAMS = 10_000
#: One text in as many is kept for the threshold.
FOLDS = 10
_BINS, _RANGE = 4001, 4.0
_UNIT = float(1 << 36)


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains) and the start of a path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]
    pick = lambda value: F.coalesce(*[F.when(f, F.lit(value(r))) for f, r in zip(fits, ordered, strict=True)], F.lit(None).cast("string"))
    return pick(lambda r: r.text), pick(lambda r: r.verdict)


def _positions(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: (first row, row, context hashes by order, gram hashes by order) of each character.

    A text is preceded by ORDER zero bytes and followed by one byte 255, which is a character, too.
    """
    for first, last, data, offsets in textkit.slices(texts, 1 << 18):
        n = last - first
        size = np.diff(offsets) + ORDER + 1
        bounds = np.concatenate([[0], np.cumsum(size)])
        padded = np.zeros(bounds[-1], np.uint64)
        row = np.repeat(np.arange(n), size)
        inner = np.arange(bounds[-1]) - bounds[row]
        padded[(inner >= ORDER) & (inner < size[row] - 1)] = data
        padded[bounds[1:] - 1] = 255
        at = np.flatnonzero(inner >= ORDER)
        contexts, grams, h = [], [], np.zeros(len(at), np.uint64)
        for k in range(ORDER + 1):
            c = textkit.mix64(h + np.uint64(k + 1))
            contexts.append(c)
            grams.append(textkit.mix64(c ^ (padded[at] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
            if k < ORDER:
                h = textkit.mix64(h * np.uint64(31) + padded[at - k - 1] + np.uint64(1))
        yield first, row[at], np.array(contexts), np.array(grams)


def _counts(decided: DataFrame) -> DataFrame:
    """(reject, k, context, gram, n) over texts with a boolean ``reject``; k is the length of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reject = np.asarray(batch.column(1))
            for first, row, contexts, grams in _positions(batch.column(0)):
                side = np.broadcast_to(reject[first + row], contexts.shape).ravel()
                order = np.repeat(np.arange(ORDER + 1, dtype=np.int8), contexts.shape[1])
                for value in (False, True):
                    pairs = np.stack([contexts.ravel()[side == value], grams.ravel()[side == value]], axis=1)
                    found, at, n = np.unique(pairs, axis=0, return_index=True, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64), np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), value)), pa.array(order[side == value][at]), pa.array(found[:, 0].copy().view(np.int64)), pa.array(found[:, 1].copy().view(np.int64)), pa.array(n.astype(np.int64))], ["reject", "k", "context", "gram", "n"])

    return decided.mapInArrow(run, "reject boolean, k tinyint, context long, gram long, n long").groupBy("reject", "k", "context", "gram").agg(F.sum("n").alias("n"))


def _likelihood(counts: np.ndarray, totals: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Log-likelihoods of n-grams, from the counts of each order and the totals and kinds of successors of its context."""
    p = np.full(counts.shape[1], 1 / 257)
    for n, total, kind in zip(counts, totals, kinds, strict=True):
        p = np.where(total > 0, (n + kind * p) / np.maximum(total + kind, 1), p)
    return np.log(p)


def _ratio(accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    """The difference in whole units, whose sums don't depend on their order."""
    return np.rint((accepted - rejected) * _UNIT).astype(np.int64)


class Markov:
    """One class's counts as sorted arrays."""

    def __init__(self, rows: list):
        context = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        gram = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        n = np.array([r[2] for r in rows], np.float64)
        order = np.argsort(gram)
        self.grams, self.counts = gram[order], n[order]
        self.contexts, place = np.unique(context, return_inverse=True)
        self.totals, self.kinds = np.bincount(place, n), np.bincount(place).astype(np.float64)

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def log_likelihood(self, contexts: np.ndarray, grams: np.ndarray) -> np.ndarray:
        look = lambda keys, values, wanted: np.array([self._find(keys, values, x) for x in wanted])
        return _likelihood(look(self.grams, self.counts, grams), look(self.contexts, self.totals, contexts), look(self.contexts, self.kinds, contexts))


class RatioModel:
    """Scores texts by the difference of two models' log-likelihoods for a character; positive: like the accepted."""

    def __init__(self, accepted: Markov, rejected: Markov):
        self.accepted, self.rejected, self.threshold = accepted, rejected, 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, row, contexts, grams in _positions(texts):
            ratio = _ratio(self.accepted.log_likelihood(contexts, grams), self.rejected.log_likelihood(contexts, grams))
            sums = np.add.reduceat(ratio, np.flatnonzero(np.diff(row, prepend=-1))) / _UNIT / np.bincount(row)
            out[first : first + len(sums)] = sums
        return out

    def scored(self, rows: DataFrame) -> DataFrame:
        """The rows with the score of their ``text`` (null for a null one)."""
        shared, place = rows.sparkSession.sparkContext.broadcast(self), rows.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text = batch.column(place)
                known = text.is_valid()
                scores, open_ = np.zeros(len(batch)), np.asarray(known)
                if open_.any():
                    scores[open_] = shared.value.scores(text.filter(known))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, mask=~open_)], [*batch.schema.names, "score"])

        return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double")


class JoinedModel:
    """As RatioModel, for counts that are not sent to the tasks."""

    def __init__(self, counts: DataFrame):
        side = lambda reject, value: F.sum(F.when(F.col("reject") == reject, value).otherwise(0))
        self.threshold = 0.0
        self.grams = counts.groupBy("k", "gram").agg(side(False, F.col("n")).alias("n0"), side(True, F.col("n")).alias("n1"))
        self.contexts = counts.groupBy("k", "context").agg(side(False, F.col("n")).alias("t0"), side(True, F.col("n")).alias("t1"), side(False, F.lit(1)).alias("d0"), side(True, F.lit(1)).alias("d1"))

    def ratios(self, texts: DataFrame) -> DataFrame:
        """(gram, times, ratio) of the distinct n-grams of the highest order in the texts."""

        def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, contexts, grams in _positions(batch.column(0)):
                    found, at, n = np.unique(grams[-1], return_index=True, return_counts=True)
                    lists = [pa.array(list(x[:, at].T.view(np.int64)), pa.list_(pa.int64())) for x in (contexts, grams)]
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64)), *lists], ["last", "times", "contexts", "grams"])

        def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [[r[name] for name in ("n0", "t0", "d0", "n1", "t1", "d1")] for levels in batch.column(2).to_pylist() for r in levels]
                x = np.array(rows, np.float64).reshape(len(batch), ORDER + 1, 6)
                side = [_likelihood(*(x[:, :, k].T for k in ks)) for ks in ((0, 1, 2), (3, 4, 5))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_ratio(*side))], ["gram", "times", "ratio"])

        found = texts.mapInArrow(grams_of, "last long, times long, contexts array<long>, grams array<long>")
        found = found.groupBy("last").agg(F.sum("times").alias("times"), F.first("contexts").alias("contexts"), F.first("grams").alias("grams"))
        levels = cut(found.select("last", "times", F.posexplode(F.arrays_zip("contexts", "grams")).alias("k", "x")).select("last", "times", F.col("k").cast("tinyint").alias("k"), "x.contexts", "x.grams").toDF("last", "times", "k", "context", "gram"))
        # Contexts of at most one character are few (257) and so are their successors; all n-grams have them.
        short = levels.filter("k < 2").join(F.broadcast(self.grams.filter("k < 2")), ["k", "gram"], "left").join(F.broadcast(self.contexts.filter("k < 2")), ["k", "context"], "left")
        long = levels.filter("k >= 2").join(self.grams.filter("k >= 2"), ["k", "gram"], "left").join(self.contexts.filter("k >= 2"), ["k", "context"], "left")
        joined = short.unionByName(long).fillna(0).groupBy("last", "times").agg(F.array_sort(F.collect_list(F.struct("k", "n0", "t0", "d0", "n1", "t1", "d1"))).alias("levels"))
        return cut(joined.mapInArrow(value, "gram long, times long, ratio long"))

    def scored(self, rows: DataFrame) -> DataFrame:
        """The rows with the score of their ``text`` (null for a null one)."""
        keyed = rows.filter("text is not null").withColumn("text_key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
        texts = cut(keyed.select("text", "text_key").dropDuplicates(["text_key"]))
        ratios = self.ratios(texts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, row, _, grams in _positions(batch.column(0)):
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(first + row)), pa.array(grams[-1].view(np.int64))], ["text_key", "gram"])

        places = texts.mapInArrow(run, "text_key binary, gram long")
        hot = ratios.orderBy(F.desc("times"), "gram").limit(HOT_GRAMS).select("gram", "ratio")
        found = places.join(F.broadcast(hot.withColumnRenamed("ratio", "known")), "gram", "left")
        rest = found.filter("known is null").drop("known").join(ratios.select("gram", "ratio"), "gram")
        sums = found.filter("known is not null").withColumnRenamed("known", "ratio").unionByName(rest).groupBy("text_key").agg((F.sum("ratio") / F.lit(_UNIT) / F.count("*")).alias("score"))
        scored = keyed.join(sums, "text_key").select(*rows.columns, "score")
        return scored.unionByName(rows.filter("text is null").withColumn("score", F.lit(None).cast("double")))


def _threshold(bins: list) -> float:
    """Where the mean of the accuracies of both classes is best, in the middle of ties."""
    counts = np.zeros((2, _BINS))
    for r in bins:
        counts[int(r["reject"]), r["bin"]] = r["n"]
    below = np.cumsum(counts, axis=1) - counts  # rows with a lower score than each bin
    good = below[1] / counts[1].sum() + 1 - below[0] / counts[0].sum()
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 / (_BINS - 1) * 2 * _RANGE - _RANGE)


def _bin(scores: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((scores + _RANGE) / (2 * _RANGE) * (_BINS - 1)), 0, _BINS - 1).astype(np.int32)


def _model(counts: DataFrame, model_grams: int) -> RatioModel | JoinedModel | None:
    sizes = {r["reject"]: r["count"] for r in counts.groupBy("reject").count().collect()}
    if len(sizes) < 2:
        return None
    if max(sizes.values()) > model_grams:
        return JoinedModel(counts)
    # All counts of the class come to the driver, model_grams rows at most.
    return RatioModel(*(Markov(counts.filter(F.col("reject") == reject).select("context", "gram", "n").collect()) for reject in (False, True)))


def fit(decided: DataFrame, model_grams: int = MODEL_GRAMS) -> RatioModel | JoinedModel | None:
    """A model from (text, reject) rows; None if one class has none.

    The threshold is found on one text in FOLDS, by a model of the others, since a model knows too well what it has
    learned from; the model itself counts all.  If these have one class only, it is found on all texts by the model itself.
    """
    model = _model(cut(_counts(decided)), model_grams)
    if model is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_bin(np.asarray(batch.column(1))))], ["reject", "bin"])

    def bins(of: RatioModel | JoinedModel, rows: DataFrame) -> list:
        return of.scored(rows).select("reject", "score").mapInArrow(run, "reject boolean, bin int").groupBy("reject", "bin").agg(F.count("*").alias("n")).collect()

    apart = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    others = _model(cut(_counts(decided.filter(~apart))), model_grams)
    found = bins(others, decided.filter(apart)) if others is not None else []
    if len({r["reject"] for r in found}) < 2:
        found = bins(model, decided)
    model.threshold = _threshold(found)
    return model


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", model_grams: int = MODEL_GRAMS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score is null where a rule decides."""
    url = pages[url_col]
    host, path = host_of(url), path_of(url)
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(F.lower(F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit("")).alias("text"))
    rule, verdict = rule_for(rules, F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", "text", rule.alias("rule"), verdict.alias("ruled"))
    model = fit(rows.filter("ruled is not null").select("text", (F.col("ruled") == "block").alias("reject")), model_grams)
    rows = rows.withColumn("text", F.when(F.col("ruled").isNull(), F.col("text")))
    scored = rows.withColumn("score", F.when(F.col("ruled").isNull(), F.lit(0.0))) if model is None else model.scored(rows)
    least = 0.0 if model is None else model.threshold
    verdict = F.coalesce("ruled", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
