"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.plans.lineage import cut

#: Edges between whole numbers that one task handles at most (16 bytes each); more are handled in rounds of all tasks.
TASK_EDGES = 2_000_000


def _least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node connected with each), by hooking each label to the least one beside it and halving paths."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[label]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            nodes, least = _least_labels(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for k in range(0, len(nodes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 100_000]), pa.array(least[k : k + 100_000])], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component): for each node of an edge the least node that it is connected with.

    As many edges between whole numbers as one task can hold are handled there, as arrays.  More, and others, alternate the large-star and the small-star step (Kiveris et al., 2014), which end after a number of rounds that is logarithmic
    in practice, with at most as many edges as at the start.  Minima are aggregated and joined back, so
    that no neighbourhood is ever gathered in one place.  Loops and repeated edges do no harm, null ends are dropped.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u is not null and v is not null and u != v").distinct()
    e = cut(e)
    if {f.dataType.typeName() for f in e.schema} <= {"long", "integer"} and e.count() <= task_edges:
        return _in_one_task(e.select(F.col("u").cast("long"), F.col("v").cast("long"))).select(F.col("node").cast(e.schema["u"].dataType), F.col("component").cast(e.schema["v"].dataType))

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()

    before = None
    for _ in range(max_rounds):
        e = cut(small(large(e)))
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
