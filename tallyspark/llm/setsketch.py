"""MinHash near-duplicates by SetSketch registers.

A register holds the exponentially spaced, truncated minimum of one hash over
a document's 5-word shingles; registers merge by maximum.  Seven registers make
a band; documents that share a band meet in a candidate group, in which the
similarity of each pair is estimated jointly from the registers by likelihood
and the pairs that may reach the threshold are verified on their full sets.

Exact copies of a shingle set are one class before anything is compared.
Candidate groups are compared in blocks of bounded size: each block with a few
connectors of its group first; documents that are not yet in the largest
component of their group are then compared with every block.  Blocks return
spanning forests of their verified links, never all pairs, so a group of any
size loses no link between components and no row count grows with its square.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, written
from .shingles import document_sets

BANDS, ROWS = 36, 7
REGISTERS = BANDS * ROWS
SPACING = 1.02          # base of the exponential spacing
RATE = 20.0             # rate of the exponential values
TOP = 32766             # largest register value
BLOCK_DOCS, BLOCK_SHINGLES, CONNECTORS = 400, 250_000, 12

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_BAND = (_rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2)) | np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Register values (documents x registers, int16) of non-empty hash sets."""
    low = np.empty((len(sets), REGISTERS), dtype=np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        part = sets[at:end]
        offsets = np.zeros(len(part), dtype=np.int64)
        np.cumsum([len(s) for s in part[:-1]], out=offsets[1:])
        flat = np.concatenate(part)
        halves = ((flat >> np.uint64(32)).astype(np.uint32), flat.astype(np.uint32))
        for k in range(REGISTERS):
            t = halves[k & 1] ^ _XOR[k]
            t *= _MUL[k]
            low[at:end, k] = np.minimum.reduceat(t, offsets)
        at = end
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / math.log(SPACING)), 0, TOP).astype(np.int16)


def likelihood_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of register rows ``a`` and ``b``
    from the joint counts of larger, smaller and equal registers and the known
    set sizes; a grid in steps of 0.01."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1.0 - u
    grid = np.arange(0.0, 1.001, 0.01)[None, :]
    grid = np.minimum(grid, np.minimum(u / v, v / u))
    base = (SPACING - 1.0) / SPACING
    p = -np.log1p(-np.maximum(u - v * grid, 0) * base) / math.log(SPACING)
    q = -np.log1p(-np.maximum(v - u * grid, 0) * base) / math.log(SPACING)
    tiny = 1e-12
    ll = above * np.log(p + tiny) + below * np.log(q + tiny) + equal * np.log(np.maximum(1 - p - q, 0) + tiny)
    return grid[np.arange(len(grid)), ll.argmax(1)] if len(grid) == len(ll) else grid[0, ll.argmax(1)]


def forest(sets: list[np.ndarray], regs: np.ndarray, percent: int, margin: float = 0.13) -> list[tuple[int, int]]:
    """Spanning forest of the links (100 * intersection >= percent * union)
    among the given sets.  Pairs are tried from the likeliest down; a pair is
    skipped when it is already connected, when the sizes alone rule it out or
    when its likelihood estimate lies ``margin`` (over five standard errors of
    the registers) below the threshold."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    left, right, guess = [], [], []
    for i in range(n - 1):
        fit = np.flatnonzero(100 * np.minimum(size[i], size[i + 1:]) >= percent * np.maximum(size[i], size[i + 1:])) + i + 1
        if len(fit):
            same = (regs[fit] == regs[i]).mean(1)
            keep = same >= percent / 100 - 0.25
            fit = fit[keep]
        if len(fit):
            est = likelihood_similarity(np.broadcast_to(regs[i], (len(fit), regs.shape[1])), regs[fit],
                                        np.full(len(fit), float(size[i])), size[fit].astype(float))
            keep = est >= percent / 100 - margin
            left.append(np.full(int(keep.sum()), i))
            right.append(fit[keep])
            guess.append(est[keep])
    if not left:
        return []
    left, right, guess = map(np.concatenate, (left, right, guess))
    root, links = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in np.argsort(-guess, kind="stable").tolist():
        i, j = int(left[k]), int(right[k])
        x, y = find(i), find(j)
        if x == y:
            continue
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[x] = y
            links.append((i, j))
    return links


def sketches(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., n_shingles, class_id, registers) of every row: class_id is a
    128-bit digest of the shingle set (null if empty), registers a binary."""
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        names = [f.name for f in fields]
        for batch in batches:
            done = {"n": [], "c": [], "r": []}
            for _, sets in document_sets(batch.column(len(names))):
                full = [s for s in sets if len(s)]
                regs = iter(registers(full)) if full else iter(())
                for s in sets:
                    done["n"].append(len(s))
                    if len(s):
                        with np.errstate(over="ignore"):
                            x = np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(s * np.uint64(0x9FB21C651E98DF25) ^ (s >> np.uint64(31)))])
                        done["c"].append(x.tobytes() + len(s).to_bytes(4, "little"))
                        done["r"].append(next(regs).tobytes())
                    else:
                        done["c"].append(None)
                        done["r"].append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(names))]
                + [pa.array(done["n"], pa.int64()), pa.array(done["c"], pa.binary()), pa.array(done["r"], pa.binary())],
                names=names + ["n_shingles", "class_id", "registers"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["n_shingles bigint", "class_id binary", "registers binary"])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def _bands(classes: DataFrame) -> DataFrame:
    """(key, class_id): one row per class and band."""
    def run(batches):
        for batch in batches:
            r = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int16).reshape(len(batch), BANDS, ROWS)
            with np.errstate(over="ignore"):
                h = (r.astype(np.uint64) * _BAND).sum(2, dtype=np.uint64)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(27)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), ids], names=["key", "class_id"])

    return classes.select("class_id", "registers").mapInArrow(run, "key bigint, class_id binary")


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Spanning-forest links (a, b) inside every group of ``rows``
    (cluster, part, class_id, registers, shingles)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("class_id").sort_values("class_id")
        sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf.shingles]
        regs = np.frombuffer(b"".join(pdf.registers), dtype=np.int16).reshape(len(pdf), REGISTERS)
        ids = pdf.class_id.tolist()
        links = forest(sets, regs, percent)
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]})

    # one key, so that rows already dealt by cluster are dealt anew, block by block
    return rows.groupBy(F.struct("cluster", "part").alias("block")).applyInPandas(run, "a binary, b binary")


def _with_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members joined to the shingle set of one document of each class."""
    names = members.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = [s.tobytes() for _, sets in document_sets(batch.column(at)) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names]
                                             + [pa.array(out, pa.binary())], names=[*names, "shingles"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema)
    same = docs["id"].eqNullSafe(members["id"]) & docs["row_hash"].eqNullSafe(members["row_hash"])
    return docs.join(members, same).select(*[members[c] for c in names], "text").mapInArrow(run, fields + ", shingles binary")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id") -> DataFrame:
    """Near-duplicate components of ``docs`` (id column and ``text``; other
    columns are ignored).

    Returns one row per input row: id, row_hash (of the text), n_shingles,
    class_id (digest of the shingle set, null if empty), component_id (smallest
    id reachable over links, the row's own id for empty sets) and kept.

    Null text, empty text and text of white space have an empty set and no
    links; a null id never becomes a component id unless no other id is in the
    component; repeated rows belong to one class; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col("text"), F.xxhash64("text").alias("row_hash"))
    sk = written(sketches(base, ["id", "row_hash"]), "sketches")
    classes = (sk.where("class_id is not null").groupBy("class_id")
               .agg(F.min("id").alias("low"), F.min(F.struct("id", "row_hash")).alias("pick"),
                    F.first("registers").alias("registers"), F.first("n_shingles").alias("n_shingles")))
    classes = written(classes, "classes")
    keys = _bands(classes)
    hubs = keys.groupBy("key").agg(F.min("class_id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = keys.join(hubs, "key").where("class_id <> hub").select(F.col("class_id").alias("a"), F.col("hub").alias("b"))
    cluster = connected_components(stars, rows=BANDS * classes.count()).select(F.col("node").alias("class_id"), F.col("component").alias("cluster"))
    cluster = written(cluster.join(classes.select("class_id", "pick", "n_shingles"), "class_id"), "clusters")
    parts = cluster.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"),
        F.min(F.xxhash64("class_id")).alias("least"), F.count("*").alias("members"))
    cluster = cluster.join(parts, "cluster").select("*", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int").alias("part"),
                                                    F.pmod(F.xxhash64(F.lit(7), "class_id"), F.col("members")).alias("draw"))
    members = (cluster.select("cluster", "class_id", "parts", "part", "draw", F.col("pick.id").alias("id"),
                              F.col("pick.row_hash").alias("row_hash")))
    sets = _with_sets(base, members)
    sets = sets.dropDuplicates(["class_id"]).drop("id", "row_hash").join(classes.select("class_id", "registers"), "class_id")
    sets = written(sets, "members")
    # every block with the connectors of its group: about CONNECTORS documents drawn by hash
    connectors = sets.where((F.col("parts") > 1) & (F.col("draw") < CONNECTORS))
    spread = connectors.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    links = written(_compare(sets.unionByName(spread), percent), "links")
    found = connected_components(links, rows=links.count()).withColumnRenamed("node", "class_id")
    wide = sets.where("parts > 1")
    if wide.take(1):
        state = wide.select("cluster", "class_id").join(found, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
        sizes = state.groupBy("cluster", "component").count()
        main = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
        rest = written(state.join(main, "cluster").where("component <> main").select("class_id"), "rest")
        # the remaining documents in chunks of half a block, each against every block of the group
        left = wide.join(rest, "class_id", "left_semi")
        chunks = left.groupBy("cluster").agg(
            F.ceil(F.greatest(F.count("*") * 2 / BLOCK_DOCS, F.sum(F.length("shingles")) / 4 / BLOCK_SHINGLES)).cast("int").alias("chunks"))
        left = left.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "class_id"), F.col("chunks")).cast("int"))
        left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = wide.join(chunks, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        grid = left.select(*right.columns).union(right)
        grid = grid.withColumn("part", F.col("part") * F.col("chunks") + F.col("chunk")).select(*sets.columns)
        more = written(_compare(grid, percent), "links")
        if more.take(1):
            stars = found.select(F.col("class_id").alias("a"), F.col("component").alias("b"))
            found = connected_components(stars.union(more), rows=stars.count() + more.count()).withColumnRenamed("node", "class_id")
    low = classes.select("class_id", "low").join(found, "class_id", "left")
    low = low.withColumn("component", F.coalesce("component", "class_id"))
    least = low.groupBy("component").agg(F.min("low").alias("component_id"))
    named = written(low.join(least, "component").select("class_id", "component_id"), "named")
    out = sk.drop("registers").join(named, "class_id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "row_hash", "n_shingles", "class_id", component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
