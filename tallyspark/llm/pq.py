"""Embedding near-duplicates by product quantisation.

Vectors are scaled to unit length.  A coarse quantiser deals them to inverted
lists; the residuals are coded per subspace.  Each vector queries the lists
whose centroid is at most a calibrated gap farther than its own (the gap covers
vectors turned by the threshold angle), distances are read from asymmetric
tables, and pairs within reach (distance less the stored coding error) are
reranked by exact cosine in double precision.  Quantisers are fitted on a
bounded sample; every vector is indexed and every vector queries.

Equal vectors are one node.  Lists and their queries are cut into blocks, and
a block returns a link count per query and one edge per node to the root of
its component, so hot lists make no row per pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, written

SAMPLE = 8192        # vectors to fit the quantisers on, at most about
SUBSPACES, CODES = 8, 32
BLOCK = 512


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids, subspace code books and the probing gap for one width."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float):
        rng = np.random.default_rng(11)
        self.coarse = kmeans(sample, lists)
        cell = self.nearest(sample)[0]
        residual = sample - self.coarse[cell]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(residual[:, c], CODES, seed=k) for k, c in enumerate(self.cuts)]
        gap = 0.0
        for _ in range(max(4, 20_000 // max(1, len(sample)))):
            turn = rng.normal(size=sample.shape)
            turn -= (turn * sample).sum(1, keepdims=True) * sample
            turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-300)
            other = threshold * sample + math.sqrt(1 - threshold ** 2) * turn
            d = self.distances(other)
            gap = max(gap, float((d[np.arange(len(d)), cell] - d.min(1)).max()))
        self.gap = 1.15 * gap + 1e-9

    def distances(self, x: np.ndarray) -> np.ndarray:
        c = self.coarse
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x)
        return d.argmin(1), d

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.empty((len(residual), len(self.cuts)), np.uint8)
        back = np.empty_like(residual)
        for m, (cut, book) in enumerate(zip(self.cuts, self.books)):
            part = residual[:, cut]
            codes[:, m] = ((book * book).sum(1)[None] - 2 * part @ book.T).argmin(1)
            back[:, cut] = book[codes[:, m]]
        return codes, np.linalg.norm(residual - back, axis=1)

    def table_distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (queries x coded vectors) by table look-up."""
        total = np.zeros((len(residual), len(codes)))
        for m, (cut, book) in enumerate(zip(self.cuts, self.books)):
            q = residual[:, cut]
            table = (q * q).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * q @ book.T
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def block_links(model: Quantiser, cell: int, queries: np.ndarray, vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean links (queries x vectors) in one block of one inverted list."""
    centre = model.coarse[cell]
    codes, error = model.encode(vectors - centre)
    reach = math.sqrt(2 - 2 * threshold) + 1e-9
    near = model.table_distances(queries - centre, codes) <= reach + error[None]
    links = np.zeros(near.shape, bool)
    i, j = np.nonzero(near)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        links[a, b] = (queries[a] * vectors[b]).sum(1) >= threshold
    return links


def _roots(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component label of every query and vector of a block (labels are the
    smallest query of the component; -1 without links)."""
    big = len(links)
    q = np.where(links.any(1), np.arange(big), big)
    while True:
        x = np.where(links, q[:, None], big).min(0)
        new = np.minimum(q, np.where(links, x[None], big).min(1))
        if (new == q).all():
            return np.where(q < big, q, -1), np.where(x < big, x, -1)
        q = new


def embedding_links(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links among vectors of equal non-null label with cosine >= threshold.

    Returns per input row: id, n_links (other rows linked directly),
    component_id (smallest id reachable, itself included), kept.  Null
    vectors, zero vectors, vectors with null or non-finite components, vectors
    without a label and empty vectors link with nothing; vectors of different
    width never link; repeated rows link with one another; an empty table
    gives an empty result.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    ok = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(
        F.exists("v", lambda x: x != 0), F.lit(False))
    node = F.when(ok, F.concat(F.hex(F.xxhash64("label", "v")), F.hex(F.xxhash64(F.lit(1), "label", "v"))))
    rows = written(rows.select("id", node.alias("node"), F.when(ok, F.col("label")).alias("label"), F.when(ok, F.col("v")).alias("v")), "vectors")
    nodes = written(rows.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("low")), "nodes")
    widths = [(r["w"], r["n"]) for r in nodes.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy("w").collect()]
    models: dict[int, Quantiser] = {}
    for width, n in widths:
        part = nodes.where(F.size("v") == width)
        share = min(1.0, SAMPLE / n)
        # deterministic sample: hash of the node below the share of the hash range
        drawn = part.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").toPandas()
        x = np.stack(drawn.v.to_numpy()) if len(drawn) else np.eye(1, width)
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        models[width] = Quantiser(x, int(min(256, max(1, n // 512), max(1, len(x) // 16))), threshold)
    shared = spark.sparkContext.broadcast(models)   # code books: SAMPLE bounds their size

    def deal(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            width = pdf.v.map(len).to_numpy()
            for w in np.unique(width):
                part, model = pdf[width == w], shared.value[int(w)]
                x = np.stack(part.v.to_numpy())
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                own, d = model.nearest(x)
                q, c = np.nonzero(d <= d.min(1)[:, None] + model.gap)
                is_own = own[q] == c
                yield pd.DataFrame({"label": part.label.to_numpy()[q], "width": int(w), "cell": c, "own": is_own,
                                    "node": part.node.to_numpy()[q], "copies": part.copies.to_numpy()[q],
                                    "u": [x[k].tobytes() for k in q]})

    label_type = nodes.schema["label"].dataType.simpleString()
    dealt = written(nodes.select("node", "label", "v", "copies").mapInPandas(
        deal, f"label {label_type}, width int, cell int, own boolean, node string, copies bigint, u binary"), "dealt")
    place = ["label", "width", "cell"]
    blocks = dealt.groupBy(*place).agg(F.ceil(F.count_if("own") / BLOCK).cast("int").alias("parts"),
                                       F.ceil(F.count("*") / BLOCK).cast("int").alias("asks")).where("parts > 0")
    placed = dealt.join(blocks, place)
    lists = placed.where("own").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn(
        "ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    asks = placed.withColumn("ask", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("asks")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("own", F.lit(False))
    both = lists.select("label", "width", "cell", "part", "ask", "own", "node", "copies", "u").unionByName(
        asks.select("label", "width", "cell", "part", "ask", "own", "node", "copies", "u"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x, q = pdf[pdf.own], pdf[~pdf.own]
        if not len(x) or not len(q):
            return pd.DataFrame({"node": [], "root": [], "n": []})
        xs = np.frombuffer(b"".join(x.u)).reshape(len(x), -1)
        qs = np.frombuffer(b"".join(q.u)).reshape(len(q), -1)
        links = block_links(shared.value[int(pdf.width.iloc[0])], int(pdf.cell.iloc[0]), qs, xs, threshold)
        links &= q.node.to_numpy()[:, None] != x.node.to_numpy()[None]
        n = links @ x.copies.to_numpy()
        a, b = _roots(links)
        names = q.node.to_numpy()
        ask = pd.DataFrame({"node": names, "root": np.where(a >= 0, names[a], None), "n": n})[a >= 0]
        own = pd.DataFrame({"node": x.node.to_numpy(), "root": np.where(b >= 0, names[b], None), "n": 0})[b >= 0]
        return pd.concat([ask, own])

    found = written(both.groupBy("label", "width", "cell", "part", "ask").applyInPandas(
        compare, "node string, root string, n bigint"), "pq-links")
    component = connected_components(found, "node", "root")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    done = (nodes.select("node", "copies", "low").join(counts, "node", "left").join(component, "node", "left")
            .withColumn("component", F.coalesce("component", "node")))
    low = done.groupBy("component").agg(F.min("low").alias("component_id"))
    done = written(done.join(low, "component").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "pq-done")
    out = rows.drop("v", "label").join(done, "node", "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
