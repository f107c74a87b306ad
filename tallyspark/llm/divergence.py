"""Source divergence audit: how far the words of each source lie from those of
its language and of the language's other sources.

A translate table lowers A-Z and blanks separators in one pass over the bytes
of a text; ``bytes.split`` and a Counter per document give frequencies and
document counts, which tasks add up sparsely before anything is shuffled.

Every term that a language keeps counts in every source, also where it does not
occur.  Such cells are never made: a term that a source lacks has the source's
base value, so a sum over all kept terms is V times the value of two bases, plus
what the distinct values of each side change, plus what the terms that both
sides hold change.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

SCALE = 1_000_000_000
LEAST_DOCS, TOP_TERMS = 3, 200
ENTRIES, ENTRY_BYTES, PAIRS, SALTS = 400_000, 1 << 28, 1 << 20, 16

# ASCII other than letters separates; every byte of a longer character belongs to a term
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x80 and not 0x61 <= b <= 0x7A else b for b in range(256))


def terms_of(text: bytes | None) -> Counter:
    """Frequencies of the terms of a text."""
    return Counter((text or b"").translate(TABLE).split())


def _counted(batches):
    """(lang, source, term, n, docs) of the documents of a task, added up in
    frames of bounded size; the empty term stands for the group itself.  A
    term's two counts share one number, n below and docs from bit 32 on."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = space = 0
    one = 1 << 32

    def frames():
        for (lang, source), table in held.items():
            terms, counts = list(table), np.fromiter(table.values(), dtype=np.int64, count=len(table))
            for at in range(0, len(terms), 50_000):
                part, value = terms[at:at + 50_000], counts[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang, pa.string()), len(part)), pa.repeat(pa.scalar(source, pa.string()), len(part)),
                     pa.array(part, pa.binary()).cast(pa.string()), pa.array(value & (one - 1)), pa.array(value >> 32)],
                    names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            table = held.setdefault((lang, source), {b"": 0})
            before, get = len(table), table.get
            for term, n in terms_of(text).items():
                table[term] = get(term, 0) + n + one
            size += len(table) - before
            space += len(text or b"")
            if size > ENTRIES or space > ENTRY_BYTES:
                yield from frames()
                held, size, space = {}, 0, 0
    yield from frames()


def _share(n: str, total: str, v: str) -> F.Column:
    """1 + floor(SCALE * (n + 1) / (total + v)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0))) div cast({total} + {v} as decimal(20, 0))")


def _gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shared(batches):
    """(lang, left, right, value): what the terms that two sources of a language
    hold in common change, added up over the terms of a batch."""
    for batch in batches:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values
        sid, p, base = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        k = np.diff(offsets)
        names = batch.column(0).dictionary_encode()
        lang = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), k)
        entry = np.arange(offsets[0], offsets[-1])
        width, first = np.repeat(k, k), np.repeat(offsets[:-1], k)
        ends = np.cumsum(width)
        n = int(sid.max()) + 1 if len(sid) else 1
        at = 0
        while at < len(entry):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
            w = width[at:end]
            left = np.repeat(entry[at:end], w)
            right = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[at:end], w)
            key = (np.repeat(lang[at:end], w) * n + sid[left]) * n + sid[right]
            change = (_gaps(p[left], p[right]) - _gaps(p[left], base[right]) - _gaps(base[left], p[right]) + _gaps(base[left], base[right]))
            order = np.argsort(key, kind="stable")
            key, starts = np.unique(key[order], return_index=True)
            value = np.add.reduceat(change[order], starts)
            other = key // n % n != key % n
            key, value = key[other], value[other]
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(key // (n * n))), pa.array(key // n % n), pa.array(key % n), pa.array(value)],
                                             names=["lang", "left", "right", "value"])
            at = end


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Divergence of the (lang, source) groups of ``docs`` (text, lang, source;
    other columns are ignored).

    Returns lang, source, part, item, value, rank.  Part ``pair``: every other
    source of the language with the summed divergence over all kept terms (0
    where the language keeps none).  Part ``term``: the ``top`` terms that the
    source uses more than its language does.  Equal values rank by item in byte
    order.

    Null text, lang and source count as '': texts without terms still make
    their group occur; repeated rows are documents of their own; texts and
    terms of any length are counted whole; an empty table gives no rows.  A
    language's pairs of sources are the size of the result, so one term's
    sources, at most the square root of that, fit one row.
    """
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                       F.col("text").cast("binary").alias("text"))
    counts = (rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
              .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    kept = (counts.withColumn("all", F.sum("n").over(term)).withColumn("docs", F.sum("docs").over(term))
            .withColumn("nth", F.row_number().over(term.orderBy("source")))
            .where((F.col("term") == "") | (F.col("docs") >= least_docs)).drop("docs"))
    kept = written(kept, "divergence-terms")
    real = F.col("term") != ""
    langs = kept.groupBy("lang").agg(F.count_if(real & (F.col("nth") == 1)).alias("v"), F.sum("n").alias("lang_n"))
    groups = (kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n")).join(langs, "lang")
              .withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
              .withColumn("base", F.when(F.col("v") > 0, _share("0L", "source_n", "v"))))
    groups = written(groups, "divergence-groups")
    cells = (kept.where(real).join(groups, ["lang", "source"])
             .withColumn("p", _share("n", "source_n", "v")).withColumn("q", _share("all", "lang_n", "v")))
    cells = written(cells.select("lang", "source", "sid", "term", "p", "q", "base"), "divergence-cells")
    order = [F.desc("value"), F.asc("item")]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))

    terms = (cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         F.expr(_gap("p", "q")).alias("value"))
             .withColumn("rank", rank).where(F.col("rank") <= top))

    values = (cells.groupBy("lang", "sid", "p").agg(F.count("*").alias("k"))
              .groupBy("lang", "sid").agg(F.collect_list(F.struct("p", "k")).alias("values")))
    both = (cells.groupBy("lang", "term").agg(F.collect_list(F.struct("sid", "p", "base")).alias("cells")).where(F.size("cells") > 1)
            .select("lang", "cells").mapInArrow(_shared, "lang string, left long, right long, value long")
            .groupBy("lang", "left", "right").agg(F.sum("value").alias("common")))
    sides = groups.join(values, ["lang", "sid"], "left").withColumn("values", F.coalesce("values", F.expr("cast(array() as array<struct<p: bigint, k: bigint>>)")))
    left = sides.select("lang", "source", "v", F.col("sid").alias("left"), F.col("base").alias("b"), F.col("values").alias("x"),
                        (F.col("sid") % SALTS).alias("salt"))
    right = sides.select("lang", F.col("source").alias("item"), F.col("sid").alias("right"), F.col("base").alias("c"), F.col("values").alias("y"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    value = (f"v * ({_gap('b', 'c')})"
             f" + aggregate(x, 0L, (s, e) -> s + e.k * (({_gap('e.p', 'c')}) - ({_gap('b', 'c')})))"
             f" + aggregate(y, 0L, (s, e) -> s + e.k * (({_gap('b', 'e.p')}) - ({_gap('b', 'c')})))")
    pairs = (left.join(right, ["lang", "salt"]).where("left <> right").withColumn("single", F.expr(value))
             .select("lang", "source", "item", "left", "right", "single").join(both, ["lang", "left", "right"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.coalesce(F.col("single") + F.coalesce("common", F.lit(0)), F.lit(0)).alias("value"))
             .withColumn("rank", rank))
    return pairs.unionByName(terms)
