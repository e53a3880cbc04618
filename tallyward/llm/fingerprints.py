"""MinHash fingerprints of documents, and near duplicates found by joining bands of them.

A fingerprint is the MinHash signature of a document's five-word shingles: for each of ``PERMUTATIONS`` maps
h -> a*h + b modulo 2**64 (a odd, so each is a permutation of the 64-bit values and the family is universal on its
mixed results) the least image, of which 16 mixed bits are kept.  The share of equal components estimates the Jaccard
similarity of the shingle sets.  All of it is numpy on many shingles at once.

:func:`with_next` gives each document together with the one that follows it by descending id, without ever sorting the
table in one place: ids alone give the borders of value ranges, every range is sorted on its own, and the first row of
a range is copied to the end of the range before it.  There are as many ranges as the texts' bytes ask for.  Rows with
equal ids follow each other by the hash of their text, so an id (or the lack of one) that very many rows have is split
over several ranges by that hash.

Cases: a text without words has the fingerprint of the empty set, which is like another such and unlike all else; a
null text counts as empty; fewer than five words make one shingle; rows with equal ids are ordered by hash and text, rows
without id come last; a single row is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm import textkit

PERMUTATIONS = 128
#: Bytes of text to a range, about; and ranges at most, whose borders (24 bytes each) are sent to the tasks.
RANGE_BYTES, RANGES_MOST = 64 << 20, 1 << 16
_COLUMNS = 1024

_rng = np.random.default_rng(20_011)
_A = _rng.integers(0, 2**63, (PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, (PERMUTATIONS, 1), dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """PERMUTATIONS values of 16 bits for shingle hashes (repeated ones do no harm)."""
    least = np.full(PERMUTATIONS, np.uint64(2**64 - 1))
    for k in range(0, len(shingles), _COLUMNS):
        np.minimum(least, (_A * shingles[k : k + _COLUMNS] + _B).min(axis=1), out=least)
    return (textkit.mix64(least) >> np.uint64(48)).astype(np.uint16)


def likeness(x: np.ndarray, y: np.ndarray, x_empty: bool, y_empty: bool) -> float:
    """The share of equal components; an empty set is like an empty set only."""
    if x_empty or y_empty:
        return float(x_empty and y_empty)
    return float((x == y).mean())


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, whether the set is empty) of texts."""
    out, empty = np.zeros((len(texts), PERMUTATIONS), np.uint16), np.zeros(len(texts), bool)
    for first, _, data, offsets in textkit.slices(texts):
        for k, shingles in enumerate(textkit.shingle_sets(textkit.words(data, offsets)), first):
            out[k], empty[k] = signature(shingles), not len(shingles)
    return out, empty


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row, the fingerprint in hexadecimal digits; a map without a shuffle."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = signatures(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes().hex() for x in found], pa.string())], ["doc_id", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")


class _Ranges:
    """Which range a row belongs to: numbers rise with the id, and for one id as the hash falls."""

    def __init__(self, cuts: list[int], without: int):
        #: Ranges of the rows without id; borders; ranges of a border's own rows, more than one if very many have that id.
        self.without = without
        self.cuts, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        self.own = np.where(times > 1, times, 0)
        self.first = without + 1 + np.concatenate([[0], np.cumsum(self.own + 1)[:-1]]) if len(self.cuts) else np.zeros(0, np.int64)

    def place(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        x = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        turned = (~hashes).view(np.uint64) ^ np.uint64(1 << 63)  # the greatest hash comes first
        share = lambda n: ((turned >> np.uint64(32)) * n.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        out = np.full(len(x), self.without, np.int64)
        if len(self.cuts):
            at = np.searchsorted(self.cuts, x, "right") - 1
            k = np.maximum(at, 0)
            own = (at >= 0) & (self.cuts[k] == x) & (self.own[k] > 0)
            out = np.where(at < 0, out, np.where(own, self.first[k] + share(self.own[k]), self.first[k] + self.own[k]))
        return np.where(known, out, share(np.full(len(x), self.without)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(range, copied, doc_id, text), in partitions sorted by range, descending id, hash and text.

    Behind the rows of each range comes a copied row: the document that follows its last one.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    source = source.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    told = source.agg(F.count("*").alias("n"), F.count("doc_id").alias("known"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = min(RANGES_MOST, ranges or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (told["bytes"] or 0) // RANGE_BYTES + 1))
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    cuts = source.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * ranges)).alias("cuts")).first()["cuts"] or []
    dealing = _Ranges(cuts, max(1, -(-ranges * (told["n"] - told["known"]) // max(1, told["n"]))))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range the first row: the greatest id, and the least hash of that."""
        for batch in batches:
            hashes = batch.column(1).to_numpy()
            at, ids = dealing.place(batch.column(0), hashes), pc.fill_null(batch.column(0), 0).to_numpy()
            order = np.lexsort((hashes, ~ids, at))
            order = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(at[order]), batch.column(0).take(pa.array(order)), pa.array(~hashes[order])], ["range", "top", "turned"])

    # One row for each range: 2 * RANGES_MOST at most.
    firsts = source.select("doc_id", "hash").mapInArrow(ends, "range long, top long, turned long").groupBy("range").agg(F.max(F.struct("top", "turned")).alias("m")).select("range", "m.*").collect()
    tops = {r["range"]: (r["top"], ~r["turned"]) for r in firsts}
    order = sorted(tops, reverse=True)
    before = dict(zip(order[1:] + order[:1], order, strict=True))  # the range in front of each, around the end

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "copied", "doc_id", "hash", "text"]
        for batch in batches:
            keys, hashes = batch.column(0), batch.column(2)
            at = dealing.place(keys, hashes.to_numpy())
            leads = [k for k, (r, x, h) in enumerate(zip(at.tolist(), keys.to_pylist(), hashes.to_pylist(), strict=True)) if tops[r] == (x, h)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(at), bool)), keys, hashes, batch.column(1)], names)
            if leads:
                to, rows = pa.array([before[int(at[k])] for k in leads], pa.int64()), pa.array(leads)
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(leads), bool)), keys.take(rows), hashes.take(rows), batch.column(1).take(rows)], names)

    dealt = source.mapInArrow(deal, "range long, copied boolean, doc_id long, hash long, text string")
    return dealt.repartition(ranges, "range").sortWithinPartitions("range", "copied", F.col("doc_id").desc_nulls_last(), "hash", F.col("text").asc_nulls_first()).select("range", "copied", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The text with the last half of its code points replaced by as many from the start of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every document and of its edited text, and how like they and the next document's are."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row so far: its next one is still to come
        for batch in batches:
            for first, last, _, _ in textkit.slices(batch.column(3)):
                part = batch.slice(first, last - first)
                texts = [x or "" for x in part.column(3).to_pylist()]
                marks, empty = signatures(part.column(3))
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts, marks, empty, strict=True))
                if waiting is not None:
                    rows.insert(0, waiting)
                waiting = rows[-1]
                pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
                changed = [edited(x[3], y[3]) for x, y in pairs]
                theirs, none = signatures(pa.array(changed, pa.string()))
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([x[4].tobytes().hex() for x, _ in pairs], pa.string()),
                    pa.array([t.tobytes().hex() for t in theirs], pa.string()),
                    pa.array([likeness(x[4], t, x[5], e) for (x, _), t, e in zip(pairs, theirs, none, strict=True)], pa.float64()),
                    pa.array([likeness(x[4], y[4], x[5], y[5]) for x, y in pairs], pa.float64()),
                ], names)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(textkit.ending(run), kinds)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = 32, share: int = 75) -> DataFrame:
    """(doc_id, component_id): documents linked by signature bands and a verified Jaccard similarity of share/100.

    The documents that have a band in common are a group, in which links are found as in jaccard_join: near copies cost
    few comparisons, no link between components that share a band is lost, and equal texts are one class throughout.  A
    pair at the threshold shares one of 32 bands of 4 with a probability of 0.99999; the exact join is in jaccard_join.
    """
    from itertools import count

    from tallyward.llm import jaccard_join
    from tallyward.plans.lineage import free, written

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            keys, checks, sizes, sketches, found = ([None] * n for _ in range(5))
            for row, members in jaccard_join.sets_of(batch.column(1)):
                if len(members):
                    keys[row], checks[row] = jaccard_join.digest(members, seed)
                    sizes[row], sketches[row] = len(members), jaccard_join.sketch(members)
                    found[row] = [int.from_bytes(hashlib.blake2b(bytes([b]) + p.tobytes(), digest_size=8).digest(), "little", signed=True) for b, p in enumerate(signature(members).reshape(bands, -1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "key", "check", "size", "sketch", "bands"])

    for seed in count():
        rows = written(source.mapInArrow(partial(run, seed=seed), "doc_id long, key long, check long, size long, sketch binary, bands array<long>"))
        clash = rows.filter("key is not null").groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a != b")
        if not clash.limit(1).count():
            break
        free(rows)
    known = rows.filter("key is not null")
    groups = written(known.select(F.explode("bands").alias("grp"), "key").distinct())
    narrow = written(known.groupBy("key").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    parts = jaccard_join.linked_in_groups(source.select("text"), jaccard_join.Similarity(share), groups, narrow, seed)
    free(groups, narrow)
    linked = known.groupBy("key").agg(F.min("doc_id").alias("low")).join(parts, "key", "left").withColumn("part", F.coalesce("part", "key"))
    lows = linked.groupBy("part").agg(F.min("low").alias("component_id"))
    of_class = linked.join(lows, "part").select("key", "component_id")
    return known.join(of_class, "key").select("doc_id", "component_id").unionByName(rows.filter("key is null").select("doc_id", F.col("doc_id").alias("component_id")))
