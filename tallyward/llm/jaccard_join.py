"""Exact self-join of documents on the Jaccard similarity of their word shingles, by PartEnum signatures.

Two sets of a and b members and a similarity of at least 3/4 differ in at most k = (a + b) / 7 members (7 for other
thresholds accordingly).  For each band of sizes the domain of shingle hashes is split into m parts, more than k.  What
a set has in one part is a signature of it: sets that differ in k members differ in k parts at most, so of the parts
that are not empty in a set, any k + 1 hold one in which the other set has just the same.  Each set therefore keeps
k + 1 of its signatures.  Which ones is free as long as all sets prefer them in the same order; the order here is by
how common a signature is, so those that hold nothing but a widely shared passage are kept by hardly any set.  How
common they are is counted over all documents into a table of fixed size; an inexact count costs time, never a link.
A set with no more than k parts in use keeps all of its signatures, so it shares one with any similar set of more parts,
and is signed by each of its members besides, for the similar sets that have as few.  A set takes part in its own band
and, if a similar set may be in the next one, in that band too.

Equal sets are one class throughout, named by a 64-bit key; a seed under which two classes had one key is replaced.
Classes that share a signature are a group.  Each is compared with the least and the greatest key of its groups first;
the links found make components.  Then all that a group still holds of different components is compared; where that is
very much, each component with the nearest other one first.  So a large group of near copies costs few comparisons for each
member and not one for each pair, and no link between different components is lost.  Parity sketches, whose distance
never exceeds that of the sets, rule out most of what is not similar before any set is moved.  Large groups are cut into
blocks, and each pair of blocks is a unit of work of bounded size.  Signatures of very large groups are dealt out by
signature and key, so that no task receives such a group alone.  Comparisons are exact, on the sets of shingle hashes
(64 bits).

Cases: null and empty texts and those without words have an empty set and are linked with nothing; fewer than five
words make one shingle; rows with equal ids stay rows of their own; a null id never names a component unless all ids in
it are null; very long texts are taken whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count as counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm import textkit
from tallyward.operators.graph import connected_components
from tallyward.plans.lineage import cut, free, written

#: Slots of the table that says how common signatures are (a byte each); its size does not depend on the input.
COMMON_SLOTS = 1 << 24
_PART = 1 << 16
#: Signatures to a bucket, at most on average; and those that a task packs before it hands them on.
BUCKET_SIGNATURES, PACK_SIGNATURES = 4_000_000, 1_500_000
#: A signature counted as often is dealt out by signature and key (if it is as many times the mean count as below).
HOT_SIGNATURES, HOT_TIMES = 1 << 20, 64
#: Members to a block of a group; and pairs for each member of a unit beyond which only the nearest are compared first.
BLOCK_MEMBERS, PAIRS_FIRST = 4096, 1
#: Sketches of a set have from one to two times as many bits as it has members; at least these.
LEAST_SKETCH_BITS = 128
#: Bits for each wanted class in the table by which tasks leave out sets that no comparison needs, and the most bits
#: that are sent out; an exact join follows, so beyond that it is only less selective.
WANTED_BITS, WANTED_MOST = 16, 1 << 28
#: Words of sketches that are compared at once (8 bytes each).
_AT_ONCE = 1 << 20

_ELEMENTS = np.uint64(0xA5A5A5A5A5A5A5A5)


@dataclass(frozen=True)
class Similarity:
    """A threshold of share/100, and what follows from it."""

    share: int = 75

    def largest(self, size: int) -> int:
        """Size of the largest set that may be similar."""
        return size * 100 // self.share

    def differing(self, a: int, b: int) -> int:
        """Members in which similar sets of these sizes differ, at most."""
        return (a + b) * (100 - self.share) // (100 + self.share)

    def band(self, size: int) -> tuple[int, int, int]:
        """(number, largest size, parts) of the band that holds a size."""
        step, low, number = (100 / self.share) ** 4, 1, 0
        while size >= (high := max(low + 1, math.ceil(low * step))):
            low, number = high, number + 1
        k = self.differing(high - 1, high - 1)
        return number, high - 1, 1 if k == 0 else math.ceil(2.5 * k) + 2


def sketch_bits(size: int) -> int:
    return LEAST_SKETCH_BITS << max(0, (max(size, 1) * 2 - 1) // LEAST_SKETCH_BITS).bit_length()


def sketch(members: np.ndarray) -> bytes:
    """Parities of a set: bit i says whether an odd number of members fall on i.

    Two sets' sketches differ in no more bits than the sets do in members; the two halves of a sketch laid over each
    other (exclusive or) are the sketch of half as many bits.
    """
    bits = sketch_bits(len(members))
    odd = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def digest(members: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """(key, check) of a set."""
    d = hashlib.blake2b(members.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signatures(members: np.ndarray, like: Similarity, common: np.ndarray | None) -> np.ndarray:
    """The signatures of a set: all, or with ``common`` the k + 1 least common ones of each band; members where parts are few."""
    size, out = len(members), []
    if not size:
        return members
    number, high, parts = like.band(size)
    bands = [(number, high, parts)]
    if like.largest(size) > high:
        bands.append(like.band(high + 1))
    for number, high, parts in bands:
        k = like.differing(size, min(high, like.largest(size)))
        part = ((members >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first = np.flatnonzero(np.diff(part[order], prepend=-1))
        held = np.add.reduceat(textkit.mix64(members[order] + np.uint64(number + 1)), first)
        found = textkit.mix64(held ^ (part[order][first].astype(np.uint64) + np.uint64((number + 1) << 40)))
        if len(found) <= k:
            out.append(textkit.mix64(members ^ (_ELEMENTS + np.uint64(number))))
        elif common is not None and len(found) > k + 1:
            found = found[np.lexsort((found, common[found & np.uint64(len(common) - 1)]))[: k + 1]]
        out.append(found)
    return np.concatenate(out)


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle set) of each text of a batch."""
    for first, _, data, offsets in textkit.slices(column):
        yield from enumerate(textkit.shingle_sets(textkit.words(data, offsets)), first)


def _survey(source: DataFrame, like: Similarity) -> tuple[DataFrame, int]:
    """In one pass over (text, any other columns): a row for each text (the other columns; size, key, check and sketch of
    its set, the sketch once for each task and class), and counts of signatures in parts; with the seed of the keys."""
    others = [f for f in source.schema.fields if f.name != "text"]
    names = [*(f.name for f in others), "n_shingles", "key", "check", "sketch", "part", "counts", "signatures"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", n_shingles long, key long, check long, sketch binary, part int, counts binary, signatures long"

    def run(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
        table, seen, total, kinds = np.zeros(COMMON_SLOTS, np.uint16), set(), 0, []
        for batch in batches:
            n = len(batch)
            sizes, keys, checks, sketches = np.zeros(n, np.int64), [None] * n, [None] * n, [None] * n
            for row, members in sets_of(batch.column("text")):
                sizes[row] = len(members)
                if not len(members):
                    continue
                keys[row], checks[row] = digest(members, seed)
                if keys[row] not in seen:  # a class counts once for each task
                    seen.add(keys[row])
                    sketches[row] = sketch(members)
                    found = signatures(members, like, None)
                    total += len(found)
                    slot = found & np.uint64(COMMON_SLOTS - 1)
                    table[slot] += table[slot] < 65_535
            kept = [batch.column(f.name) for f in others]
            kinds = [c.type for c in kept]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
        if total:
            for k in range(COMMON_SLOTS // _PART):
                own = table[k * _PART : (k + 1) * _PART]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([zstandard.compress(own.tobytes())], pa.binary()), pa.array([0 if k else total])], names)

    for seed in counter():
        survey = written(source.mapInArrow(textkit.ending(partial(run, seed=seed)), schema))
        clash = survey.filter("key is not null").groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a != b")
        if not clash.limit(1).count():
            return survey, seed
        free(survey)


def _common(survey: DataFrame) -> tuple[np.ndarray, int]:
    """The table of how common signatures are, on a logarithmic scale, summed over the tasks; and how many there are."""
    counts = survey.filter("part is not null").select("part", "counts", "signatures")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = {}, 0
        for batch in batches:
            for part, data, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held = sums.setdefault(part, np.zeros(_PART, np.float32))
                held += np.frombuffer(zstandard.decompress(data), np.uint16)
                total += n
        if sums:
            packed = [zstandard.compress(np.minimum(255, np.rint(8 * np.log2(1 + x))).astype(np.uint8).tobytes()) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary()), pa.array([total] + [0] * (len(sums) - 1), pa.int64())], ["part", "counts", "signatures"])

    table, total = np.zeros(COMMON_SLOTS, np.uint8), 0
    # COMMON_SLOTS bytes come to the driver at most.
    for row in counts.repartition("part").mapInArrow(add, "part int, counts binary, signatures long").toLocalIterator():
        table[row["part"] * _PART : (row["part"] + 1) * _PART] = np.frombuffer(zstandard.decompress(row["counts"]), np.uint8)
        total += row["signatures"]
    return table, total


def _groups(texts: DataFrame, like: Similarity, seed: int, table: np.ndarray, total: int) -> DataFrame:
    """(grp, key): the classes that share a signature, for each signature that more than one class has.

    Tasks pack their signatures by bucket: 4 bytes of each (the bucket holds the others; what coincides by chance is only
    compared in vain) and the key of each class once.  A bucket is sorted as arrays.
    """
    spark = texts.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_SIGNATURES))
    shared = spark.sparkContext.broadcast(table)
    hot = 8 * math.log2(1 + max(HOT_SIGNATURES, HOT_TIMES * total / COMMON_SLOTS))
    names = ["bucket", "signs", "keys", "counts"]

    def pack(keys: list[int], signs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.array(keys, np.int64).view(np.uint64), [len(x) for x in signs])
        sign = np.concatenate(signs)
        bucket = ((sign >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        # Very common signatures go to a bucket of the signature and the key; these are numbered below 0.
        often = np.flatnonzero(shared.value[sign & np.uint64(COMMON_SLOTS - 1)] >= hot)
        bucket[often] = -1 - ((textkit.mix64(sign[often] ^ textkit.mix64(owner[often].copy())) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, sign, owner = bucket[order], sign[order], owner[order]
        first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        rows = []
        for a, b in zip(first, [*first[1:], len(bucket)], strict=True):
            head = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
            kept = sign[a:b] if bucket[a] < 0 else sign[a:b].astype(np.uint32)
            rows.append((int(bucket[a]), kept.tobytes(), owner[a:b][head].tobytes(), np.diff(head, append=b - a).astype(np.uint32).tobytes()))
        for k in range(0, len(rows), 64):
            part = list(zip(*rows[k : k + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), *(pa.array(x, pa.binary()) for x in part[1:])], names)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = shared.value, set()
        keys, signs, held = [], [], 0
        for batch in batches:
            for _, members in sets_of(batch.column(0)):
                if not len(members) or (key := digest(members, seed)[0]) in seen:
                    continue
                seen.add(key)
                keys.append(key)
                signs.append(signatures(members, like, common))
                held += len(signs[-1])
                if held >= PACK_SIGNATURES:
                    yield from pack(keys, signs)
                    keys, signs, held = [], [], 0
        if held:
            yield from pack(keys, signs)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs = None, []
        for batch in batches:
            for bucket, *rest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != now:
                    if packs:
                        yield from group(now, packs)
                    now, packs = bucket, []
                packs.append(rest)
        if packs:
            yield from group(now, packs)

    def group(bucket: int, packs: list) -> Iterator[pa.RecordBatch]:
        sign = np.frombuffer(b"".join(p[0] for p in packs), np.uint64 if bucket < 0 else np.uint32)
        # A class that several tasks have signed is one.
        keys, owner = np.unique(np.frombuffer(b"".join(p[1] for p in packs), np.uint64), return_inverse=True)
        owner = np.repeat(owner.astype(np.int32), np.frombuffer(b"".join(p[2] for p in packs), np.uint32))
        packs.clear()
        order = np.lexsort((owner, sign))
        sign, owner = sign[order], owner[order]
        again = np.zeros(len(sign), bool)
        again[1:] = (sign[1:] == sign[:-1]) & (owner[1:] == owner[:-1])
        sign, owner = sign[~again], owner[~again]
        first = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
        count = np.diff(first, append=len(sign))
        # Groups are named by what they hold, in whatever bucket they are: many signatures are shared by just the same
        # classes.  Very common signatures are spread over buckets and give their name to the group.
        if bucket < 0:
            chosen, name = np.arange(len(first)), sign[first]
        else:
            name = textkit.mix64(np.add.reduceat(textkit.mix64(keys[owner]), first) + count.astype(np.uint64))
            several = np.flatnonzero(count > 1)
            _, one = np.unique(name[several], return_index=True)
            chosen = several[one]
        ends = np.cumsum(count[chosen])
        for k in range(0, len(chosen), 4096):
            part = chosen[k : k + 4096]
            rows = np.repeat(first[part] - (ends[k : k + 4096] - count[part]), count[part]) + np.arange(ends[k] - count[part[0]], ends[k + len(part) - 1])
            yield pa.RecordBatch.from_arrays([pa.array(textkit.signed(np.repeat(name[part], count[part]))), pa.array(textkit.signed(keys[owner[rows]]))], ["grp", "key"])

    packed = texts.mapInArrow(textkit.ending(sign), "bucket int, signs binary, keys binary, counts binary")
    grouped = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(textkit.ending(gather), "grp long, key long")
    return grouped.distinct()


def _marks(wanted: DataFrame) -> np.ndarray:
    """A bit table in which the slots of the wanted keys are set (a Bloom filter of one hash).

    Each task makes a table of its share of the keys, a million or more; the driver lays them over each other.
    """
    n, slots = wanted.count(), 1 << 16
    while slots < min(WANTED_MOST, WANTED_BITS * n):
        slots *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(slots, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy() & (slots - 1)] = True
        for k in range(0, slots, _PART * 8):
            yield pa.RecordBatch.from_arrays([pa.array([k // 8], pa.int64()), pa.array([zstandard.compress(np.packbits(bits[k : k + _PART * 8]).tobytes())], pa.binary())], ["at", "data"])

    table = np.zeros(slots // 8, np.uint8)
    # A table has WANTED_MOST / 8 bytes (32 MB) at most; tables come to the driver part by part, one task after another.
    for row in wanted.select("key").coalesce(max(1, min(64, n >> 20))).mapInArrow(run, "at long, data binary").toLocalIterator():
        part = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
        table[row["at"] : row["at"] + len(part)] |= part
    return table


def _members(texts: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """(key, members) of the wanted classes (distinct keys)."""
    shared = texts.sparkSession.sparkContext.broadcast(_marks(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = shared.value, set()
        for batch in batches:
            keys, members = [], []
            for _, x in sets_of(batch.column(0)):
                key = digest(x, seed)[0] if len(x) else None
                if key is None or key in seen or not marks[(slot := key & (len(marks) * 8 - 1)) >> 3] >> (7 - (slot & 7)) & 1:
                    continue
                seen.add(key)
                keys.append(key)
                members.append(textkit.signed(x))
            for k in range(0, len(keys), 256):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 256], pa.int64()), pa.array(members[k : k + 256], pa.list_(pa.int64()))], ["key", "members"])

    # Sets that the table lets through in vain do no harm; a class comes once from each task that has it.
    return texts.mapInArrow(textkit.ending(run), "key long, members array<long>").groupBy("key").agg(F.first("members").alias("members"))


def _links(texts: DataFrame, pairs: DataFrame, like: Similarity, seed: int) -> DataFrame | None:
    """The pairs (a, b) whose sets are similar enough; None if there are no pairs to compare."""
    pairs = cut(pairs.select("a", "b"))
    if not pairs.limit(1).count():
        return None
    sets = _members(texts, cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()), seed)
    joined = pairs.join(sets.select(F.col("key").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("members").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return cut(joined.select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("n")).filter(f"100 * i >= {like.share} * (n - i)").select("a", "b"))


def _fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches with as many words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _near_pairs(pairs: DataFrame, narrow: DataFrame, like: Similarity) -> DataFrame:
    """(a, b, apart): those of the pairs (a, b) that sizes and sketches don't rule out; narrow: (key, size, sketch)."""
    sized = pairs.join(narrow.select(F.col("key").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x")), "a").join(narrow.select(F.col("key").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y")), "b")
    sized = sized.filter(f"100 * least(m, n) >= {like.share} * greatest(m, n)").select("a", "b", "m", "n", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.zeros(len(batch), np.int64)
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None]
                words = min(x.shape[1], y.shape[1])
                apart[k] = np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum()
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            near = np.flatnonzero(apart * (100 + like.share) <= size * (100 - like.share))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(near), batch.column(1).take(near), pa.array(apart[near])], ["a", "b", "apart"])

    return sized.mapInArrow(run, "a long, b long, apart long")


def unit_pairs(key: np.ndarray, block: np.ndarray, size: np.ndarray, sketches: list[bytes], part: np.ndarray, like: Similarity) -> Iterator[tuple[np.ndarray, ...]]:
    """(part of a, part of b, apart, a, b) arrays of the pairs of a unit, of different components, that sizes and
    sketches don't rule out; of a unit of two blocks only the pairs across."""
    order = np.argsort(size, kind="stable")
    key, block, size, part = key[order], block[order], size[order], part[order]
    words = np.array([len(sketches[k]) // 8 for k in order])
    across = block[0] != block[-1] or (block != block[0]).any()
    # Sizes are sorted and so are the lengths of the sketches.
    lengths = np.unique(words).tolist()
    tables = {w: np.frombuffer(b"".join(sketches[k] for k in order[words == w]), np.uint64).reshape(-1, w) for w in lengths}
    starts = {w: int(np.searchsorted(words, w)) for w in lengths}
    for w in lengths:
        own, base = tables[w], starts[w]
        for other in lengths:
            if other < w:
                continue
            rest, from_ = _fold(tables[other], w), starts[other]
            i = 0
            while i < len(own):
                low = max(from_, base + i + 1)
                high = from_ + len(rest)
                step = max(1, min(len(own) - i, _AT_ONCE // max(1, w * max(1, high - low))))
                high = min(high, int(np.searchsorted(size, size[base + i + step - 1] * 100 // like.share, "right")))
                if high > low:
                    apart = np.bitwise_count(own[i : i + step, None] ^ rest[None, low - from_ : high - from_]).sum(axis=2, dtype=np.int64)
                    x, y = np.arange(base + i, base + i + step)[:, None], np.arange(low, high)[None]
                    near = (y > x) & (apart * (100 + like.share) <= (size[x] + size[y]) * (100 - like.share)) & (size[y] * like.share <= size[x] * 100) & (part[x] != part[y])
                    if across:
                        near &= block[x] != block[y]
                    p, q = np.nonzero(near)
                    if len(p):
                        a, b = key[base + i + p], key[low + q]
                        yield part[base + i + p], part[low + q], apart[p, q], a, b
                i += step


def _least_apart(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of (part, apart, a, b) arrays the row of each part that is least apart."""
    part, apart, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((b, a, apart, part))
    order = order[np.concatenate([[True], part[order][1:] != part[order][:-1]])]
    return part[order], apart[order], a[order], b[order]


def _across(groups: DataFrame, like: Similarity, most: int | None) -> DataFrame:
    """(a, b, more): pairs of one group, of different components, that sizes and sketches don't rule out.

    groups: (grp, key, n, size, sketch, part), n being the members of the group.  A unit with more than ``most`` such pairs
    for each of its members gives only those of them that are least apart for one of its components, with ``more`` set.
    """
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("long")
    own = F.pmod(F.xxhash64("key"), blocks)
    units = groups.withColumn("blocks", blocks).withColumn("own", own).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.select("grp", F.least("own", "j").alias("lo"), F.greatest("own", "j").alias("hi"), "key", "own", "size", "sketch", "part")

    def unit(held: list) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        key, block, size, part = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2, 4))
        chunks, least, number = [], [], 0
        for chunk in unit_pairs(key, block, size, [x for h in held for x in h[3]], part, like):
            if most is None:
                yield *chunk[3:], False
                continue
            chunks.append(chunk)
            number += len(chunk[0])
            if number > most * len(key):
                least = [_least_apart([*least, *((p, apart, a, b) for c in chunks for p, apart, a, b in ((c[0], *c[2:]), (c[1], *c[2:])))])]
                chunks = []
        yield from ((a, b, True) for _, _, a, b in least)
        if not least:
            yield from ((*c[3:], False) for c in chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            more = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
            found.clear()
            # Groups have most of their pairs in common.
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), more.astype(np.int64)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(pair[2] > 0)], ["a", "b", "more"])

        waiting = 0
        for held in _units(batches):
            for pairs in unit(held):
                found.append(pairs)
                waiting += len(pairs[0])
                if waiting >= 200_000:
                    yield out()
                    waiting = 0
        if found:
            yield out()

    return units.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi").mapInArrow(run, "a long, b long, more boolean")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The (key, block, size, sketches, part) pieces of each unit (grp, lo, hi) of two members or more."""
    now, held, size = None, [], 0
    for batch in batches:
        unit = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        edges = (np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1).tolist()
        key, block, sizes, part = (batch.column(k).to_numpy() for k in (3, 4, 5, 7))
        sketches = batch.column(6).to_pylist()
        for a, b in zip([0, *edges], [*edges, len(unit)], strict=True):
            if (name := unit[a].tobytes()) != now:
                if size > 1:
                    yield held
                now, held, size = name, [], 0
            held.append((key[a:b], block[a:b], sizes[a:b], sketches[a:b], part[a:b]))
            size += b - a
    if size > 1:
        yield held


def _joined_parts(parts: DataFrame | None, links: DataFrame | None) -> DataFrame | None:
    """(key, part) of all classes that have links, after links are added to those known; None without any."""
    if links is None or not links.limit(1).count():
        return parts
    if parts is None:
        return written(connected_components(links, "a", "b").select(F.col("node").alias("key"), F.col("component").alias("part")))
    of = lambda name: parts.select(F.col("key").alias(name), F.col("part").alias(f"p{name}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("pa", "a").alias("pa"), F.coalesce("pb", "b").alias("pb"))
    named = cut(named)
    merged = cut(connected_components(named, "pa", "pb"))
    every = parts.unionByName(named.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("pa").alias("part")), F.struct(F.col("b").alias("key"), F.col("pb").alias("part")))).alias("e")).select("e.key", "e.part")).distinct()
    out = written(every.join(merged.select(F.col("node").alias("part"), "component"), "part", "left").select("key", F.coalesce("component", "part").alias("part")))
    free(parts)
    return out


def similar_classes(texts: DataFrame, like: Similarity, survey: DataFrame, seed: int) -> DataFrame:
    """(key, part) of the classes that have a similar one; those of one component have one part."""
    table, total = _common(survey)
    groups = written(_groups(texts, like, seed, table, total))
    narrow = written(survey.filter("sketch is not null").groupBy("key").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")))
    parts = linked_in_groups(texts, like, groups, narrow, seed)
    free(groups, narrow)
    return parts


def linked_in_groups(texts: DataFrame, like: Similarity, groups: DataFrame, narrow: DataFrame, seed: int) -> DataFrame:
    """(key, part) of the classes that have a similar one in a group they are in.

    groups: (grp, key), distinct, written; narrow: (key, size, sketch) of all classes, once each.
    """
    ends = groups.join(groups.groupBy("grp").agg(F.min("key").alias("low"), F.max("key").alias("high")), "grp")
    ends = ends.select(F.col("key").alias("b"), F.explode(F.array("low", "high")).alias("a")).filter("a != b").distinct()
    # Each with the nearer one of the least and the greatest of its groups.
    near = _near_pairs(ends, narrow, like).groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m"))
    pairs = near.select(F.least("m.a", "b").alias("a"), F.greatest("m.a", "b").alias("b")).distinct()
    parts = _joined_parts(None, _links(texts, pairs, like, seed))

    # What a group then holds of different components; of units with very many such pairs the nearest first.
    for most in (PAIRS_FIRST, None):
        part = written(groups.withColumn("part", F.col("key")) if parts is None else groups.join(parts, "key", "left").select("grp", "key", F.coalesce("part", "key").alias("part")))
        mixed = part.groupBy("grp").agg(F.count("*").alias("n"), F.min(F.struct("part", "key")).alias("p"), F.max(F.struct("part", "key")).alias("q")).filter("p.part != q.part")
        larger = part.join(mixed.filter("n > 2").select("grp", "n"), "grp").join(narrow, "key").select("grp", "key", "n", "size", "sketch", "part")
        found = cut(_across(larger, like, most))
        pairs = found.select("a", "b")
        if most is not None:
            of_two = mixed.filter("n = 2").select(F.col("p.key").alias("a"), F.col("q.key").alias("b")).distinct()
            pairs = pairs.unionByName(_near_pairs(of_two, narrow, like).select("a", "b"))
        parts = _joined_parts(parts, _links(texts, pairs.distinct(), like, seed))
        free(part)
        if not found.filter("more").limit(1).count():
            break
    return parts if parts is not None else texts.sparkSession.createDataFrame([], "key long, part long")


def jaccard_rows(docs: DataFrame, more: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", share: int = 75) -> DataFrame:
    """(doc_id, part, and the columns of ``more``) of every row that has shingles; rows of one component have one part."""
    like = Similarity(share)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *(c.alias(n) for n, c in more.items()))
    survey, seed = _survey(rows, like)
    parts = similar_classes(rows.select("text"), like, survey, seed)
    return survey.filter("key is not null").select("doc_id", *more, "key").join(parts, "key", "left").select("doc_id", *more, F.coalesce("part", "key").alias("part"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, linked) of every row.

    component_id is the least id that is reachable by links of similarity share/100 or more; linked says whether the
    row has any.
    """
    like = Similarity(share)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    survey, seed = _survey(source, like)
    rows = survey.filter("part is null").select("doc_id", "n_shingles", "key")
    parts = similar_classes(source.select("text"), like, survey, seed)
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    named = classes.join(parts, "key", "left")
    # A class without links is a component of its own; only the others are aggregated.
    linked = named.filter("part is not null")
    lows = linked.groupBy("part").agg(F.min("low").alias("component_id"))
    of_class = linked.join(lows, "part").select("key", "component_id", F.lit(True).alias("linked")).unionByName(named.filter("part is null").select("key", F.col("low").alias("component_id"), (F.col("copies") > 1).alias("linked")))
    joined = rows.filter("key is not null").join(of_class, "key").select("doc_id", "n_shingles", "component_id", "linked")
    return joined.unionByName(rows.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(False).alias("linked")))
