"""Shared pieces: table access, tables that cut lineage, connected components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path

WHITE = "\\x20\\x09-\\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    Cuts the lineage and lets several readers share one computation; the files
    survive the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of a value written as text, modulo ``n`` (null counts as remainder 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


FOREST_NODES, TASK_ROWS = 1_000_000, 200_000


def _forest(batches):
    """The edges (u, v) of a task as a spanning forest of stars around the
    smallest node; emptied whenever it holds FOREST_NODES nodes."""
    root: dict = {}

    def find(x):
        while (y := root[x]) != x:
            root[x] = x = root[y]
        return x

    def stars():
        pairs = [(x, find(x)) for x in root]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["u", "v"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if u is None or v is None or u == v:
                continue
            u, v = find(root.setdefault(u, u)), find(root.setdefault(v, v))
            if u < v:
                root[v] = u
            elif v < u:
                root[u] = v
        if len(root) >= FOREST_NODES:
            yield stars()
            root.clear()
    if root:
        yield stars()


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks for a step over ``rows`` small rows: TASK_ROWS each, and no fewer than the cores."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """Connected components of an undirected graph: one row (node, component)
    per node that has an edge; ``component`` is the smallest node.

    Every task first reduces its edges to a spanning forest by union-find, so
    repeated links never travel.  A round deals the edges by their larger end and
    reduces them again, which hooks the roots that meet there onto the smallest;
    then every node takes its parent's parent.  Rounds end when no parent has a
    parent and no node has two.  Edges are dealt by their larger end, so the hub
    of a component of any size is never gathered; the look-up of parents is a join
    that AQE splits.  The tasks of a round are as many as its edges need
    (``tasks_for``); ``rows``, if known, is about the number of ``edges``.  Null
    ends and loops are ignored.
    """
    kind = edges.schema[a].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    if rows is not None:
        edges = edges.coalesce(tasks_for(edges, rows))
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).mapInArrow(_forest, schema), "forest")
    while True:
        k = tasks_for(e, e.count())
        e = written(e.repartition("u").coalesce(k).mapInArrow(_forest, schema), "forest")
        parents = written(e.groupBy("u").agg(F.min("v").alias("next")).withColumnRenamed("u", "p").coalesce(k), "parents")
        jumped = e.join(parents, e["v"] == parents["p"], "left").select("u", F.coalesce("next", "v").alias("v"), "next")
        jumped = written(jumped.coalesce(k), "jumped")
        if not jumped.where("next is not null").take(1) and e.count() == parents.count():
            break
        e = jumped.select("u", "v")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
