"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model of characters (order 4 by
default) whose n-grams are stored in sorted arrays of 64-bit hashes.  A text
gets the language of the lowest cross-entropy per character; the rejection
limit of a language is calibrated on its training texts.

Counting is distributed and reads a sample of about ``SAMPLE_CHARS``
characters per language (whole texts drawn by hash); prediction reads every
whole text in blocks of characters.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import written

SAMPLE_CHARS = 2_000_000
SAMPLE_BLOCK = 20_000      # characters drawn together
ORDER = 4
BLOCK = 1 << 19
PRIME = np.uint64(0x100000001B3 * 2 + 0x9E3779B1)
_tables: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Code point -> lower-cased letter, or 0 for anything else."""
    if not _tables:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def symbols(text: str) -> np.ndarray:
    """Letters of a text with every run of other characters as one 0, and a 0
    at both ends."""
    table = _classes()
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    s = table[np.minimum(raw, 0x10FFFF)]
    s = np.concatenate([[0], s, [0]]).astype(np.uint32)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def hashes(s: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n-gram of a symbol array."""
    m = len(s) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(n))
    for k in range(n):
        h = h * PRIME + (s[k:k + m].astype(np.uint64) + np.uint64(1))
        h ^= h >> np.uint64(29)
    return h


def _count(frames: Iterator[pd.DataFrame], order: int) -> Iterator[pd.DataFrame]:
    """Partial counts (lang, n, gram, context, tail, c): hash of the n-gram, of its first
    n - 1 symbols and of its last n - 1 symbols."""
    total: dict = {}

    def flush():
        for (lang, n), parts in total.items():
            for at in range(0, len(parts[0]), 200_000):
                yield pd.DataFrame({"lang": lang, "n": n, "gram": parts[0][at:at + 200_000].view(np.int64),
                                    "context": parts[1][at:at + 200_000].view(np.int64), "tail": parts[2][at:at + 200_000].view(np.int64),
                                    "c": parts[3][at:at + 200_000]})

    for pdf in frames:
        for lang, part in pdf.groupby("lang"):
            s = np.concatenate([symbols(t) for t in part.text] or [np.zeros(1, np.uint32)])
            for n in range(1, order + 1):
                g = hashes(s, n)
                if not len(g):
                    continue
                m = len(g)
                ctx = hashes(s, n - 1)[:m] if n > 1 else np.zeros(m, np.uint64)
                tail = hashes(s, n - 1)[1:m + 1] if n > 1 else np.zeros(m, np.uint64)
                old = total.get((lang, n))
                c = np.ones(m, np.int64)
                if old is not None:
                    g, ctx, tail, c = (np.concatenate([o, v]) for o, v in zip(old, (g, ctx, tail, c)))
                u, first, back = np.unique(g, return_index=True, return_inverse=True)
                total[lang, n] = (u, ctx[first], tail[first], np.bincount(back, weights=c).astype(np.int64))
    yield from flush()


class KneserNey:
    """Interpolated Kneser-Ney model of one language in sorted hash arrays:
    per order the n-gram hashes with their interpolated probability, and the
    context hashes with their back-off weight."""

    def __init__(self, counts: pd.DataFrame, order: int):
        self.order = order
        self.grams: list[np.ndarray] = [np.zeros(0, np.uint64)] * (order + 1)
        self.prob: list[np.ndarray] = [np.zeros(0)] * (order + 1)
        self.contexts: list[np.ndarray] = [np.zeros(0, np.uint64)] * (order + 1)
        self.weight: list[np.ndarray] = [np.zeros(0)] * (order + 1)
        by = {n: g for n, g in counts.groupby("n")}
        self.floor = 1.0 / (len(by[1]) + 1000.0) if 1 in by else 1e-3
        for n in range(1, order + 1):
            if n not in by:
                continue
            g = by[n]
            gram = g.gram.to_numpy(np.int64).view(np.uint64)
            at = np.argsort(gram)
            gram, ctx, tail = gram[at], g.context.to_numpy(np.int64).view(np.uint64)[at], g["tail"].to_numpy(np.int64).view(np.uint64)[at]
            c = g.c.to_numpy(np.float64)[at]
            if n < order and n + 1 in by:   # continuation counts: distinct symbols before the n-gram
                u, k = np.unique(by[n + 1]["tail"].to_numpy(np.int64).view(np.uint64), return_counts=True)
                pos = np.minimum(np.searchsorted(u, gram), len(u) - 1)
                c = np.where(u[pos] == gram, k[pos], 1).astype(np.float64)
            n1, n2 = max(1, (c == 1).sum()), max(1, (c == 2).sum())
            d = min(0.95, max(0.1, n1 / (n1 + 2.0 * n2)))
            contexts, back = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(back, weights=c), np.bincount(back)
            weight = d * kinds / total
            lower = self.probability(n - 1, tail) if n > 1 else np.full(len(gram), self.floor)
            self.grams[n], self.prob[n] = gram, (c - d) / total[back] + weight[back] * lower
            self.contexts[n], self.weight[n] = contexts, weight

    def probability(self, n: int, gram: np.ndarray) -> np.ndarray:
        """Probability of stored n-grams of order n (all tails are stored)."""
        table = self.grams[n]
        pos = np.minimum(np.searchsorted(table, gram), len(table) - 1)
        return np.where(table[pos] == gram, self.prob[n][pos], self.floor)


class Scorer:
    """All languages side by side: per order one sorted array of the n-grams
    known to any language with a log-probability per language (the full
    back-off is resolved when the scorer is built)."""

    def __init__(self, models: dict[str, KneserNey], limits: dict[str, float] | None = None, scale: float = 1.0):
        self.langs = sorted(models)
        self.limits = limits or {}
        self.scale = scale
        self.order = max(m.order for m in models.values())
        self.models = [models[k] for k in self.langs]
        self.grams: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.logs: list[np.ndarray] = [np.zeros((0, len(self.langs)))]
        self.known: list[np.ndarray] = [np.zeros((0, len(self.langs)), bool)]
        for n in range(1, self.order + 1):
            u = np.unique(np.concatenate([m.grams[n] for m in self.models]))
            logs, known = np.zeros((len(u), len(self.langs)), np.float32), np.zeros((len(u), len(self.langs)), bool)
            for k, m in enumerate(self.models):
                if len(m.grams[n]):
                    pos = np.searchsorted(u, m.grams[n])
                    logs[pos, k], known[pos, k] = np.log(m.prob[n]), True
            self.grams.append(u)
            self.logs.append(logs)
            self.known.append(known)
        self.back: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros((0, len(self.langs))))]
        for n in range(1, self.order + 1):
            u = np.unique(np.concatenate([m.contexts[n] for m in self.models]))
            w = np.zeros((len(u), len(self.langs)), np.float32)
            for k, m in enumerate(self.models):
                if len(m.contexts[n]):
                    w[np.searchsorted(u, m.contexts[n]), k] = np.log(m.weight[n])
            self.back.append((u, w))

    def logs_at(self, s: np.ndarray) -> np.ndarray:
        """Log-probability per language of every symbol from the (order - 1)th on."""
        m = len(s) - self.order + 1
        out = np.zeros((m, len(self.langs)), np.float32)
        todo = np.ones((m, len(self.langs)), bool)      # languages still without a known n-gram
        rows = np.arange(m)
        for n in range(self.order, 0, -1):
            skip = self.order - n
            h = hashes(s[skip:], n)[:m][rows]
            u = self.grams[n]
            if len(u):
                pos = np.minimum(np.searchsorted(u, h), len(u) - 1)
                hit = (u[pos] == h)[:, None] & self.known[n][pos]
                new = todo[rows] & hit
                out[rows] += np.where(new, self.logs[n][pos], 0)
                todo[rows] &= ~hit
            open_rows = rows[todo[rows].any(1)]
            if not len(open_rows):
                return out
            if n > 1:
                c, w = self.back[n]
                h = hashes(s[skip:], n - 1)[:m][open_rows]
                pos = np.minimum(np.searchsorted(c, h), max(0, len(c) - 1))
                back = np.where((c[pos] == h)[:, None], w[pos], 0) if len(c) else 0
                out[open_rows] += np.where(todo[open_rows], back, 0)
            rows = open_rows
        out += np.where(todo, np.log([m.floor for m in self.models]).astype(np.float32)[None], 0)
        return out

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities (texts x languages) and scored symbols."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        pend, ids, size = [], [], 0

        def flush():
            nonlocal pend, ids, size
            if pend:
                s = np.concatenate(pend)
                lengths = np.array([len(p) for p in pend])
                ends = np.cumsum(lengths)
                logs = self.logs_at(s)
                # a piece owns the symbols from its (order - 1)th to its last
                run = np.vstack([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0, dtype=np.float64)])
                got = run[np.minimum(ends - self.order + 1, len(logs))] - run[np.minimum(ends - lengths, len(logs))]
                np.add.at(sums, ids, got)
                np.add.at(counts, ids, lengths - self.order + 1)
            pend, ids, size = [], [], 0

        pad = np.zeros(self.order - 2, np.uint32)
        for k, text in enumerate(texts):
            if not text:
                continue
            s = np.concatenate([pad, symbols(text)])
            if not s.any():
                continue
            for at in range(0, len(s) - self.order + 1, BLOCK):
                piece = s[at:at + BLOCK + self.order - 1]
                pend.append(piece)
                ids.append(k)
                size += len(piece)
                if size >= BLOCK:
                    flush()
        flush()
        return sums, counts


def fit(docs: DataFrame, order: int = ORDER, sample_chars: int = SAMPLE_CHARS) -> "Scorer | None":
    """Models from (text, lang); rows with a null lang or text are left out.
    None if nothing is left.

    About ``sample_chars`` characters of the distinct texts of each language
    are drawn, by a hash of text and block of SAMPLE_BLOCK characters, so that
    a language of a few long texts keeps its share."""
    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("size", F.length("text"))
    distinct = rows.groupBy("lang", "h").agg(F.first("size").alias("size"))
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.sum("size").alias("n")).collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, int(min(1.0, sample_chars / max(1, v)) * (1 << 30)) + 1)]), F.col("lang"))
    drawn = F.filter(F.sequence(F.lit(0), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / SAMPLE_BLOCK).cast("int")),
                     lambda k: F.pmod(F.when(k == 0, F.col("h")).otherwise(F.xxhash64("h", k)), F.lit(1 << 30)) < F.col("share"))
    pieces = (rows.withColumn("share", share).withColumn("k", F.explode(drawn))
              .select("lang", "h", "k", F.substring("text", F.col("k") * SAMPLE_BLOCK + 1, F.lit(SAMPLE_BLOCK)).alias("text")))
    sample = written(pieces.groupBy("lang", "h", "k").agg(F.first("text").alias("text")).select("lang", "text"), "lang-sample")
    counts = (sample.mapInPandas(lambda f: _count(f, order), "lang string, n int, gram long, context long, tail long, c long")
              .groupBy("lang", "n", "gram").agg(F.first("context").alias("context"), F.first("tail").alias("tail"), F.sum("c").alias("c")))
    counts = counts.toPandas()   # bounded by the sample: at most order x sample_chars rows a language
    models = {lang: KneserNey(g, order) for lang, g in counts.groupby("lang")}
    scorer = Scorer(models)
    shared = scorer

    def entropy(frames):
        for pdf in frames:
            sums, n = shared.totals(pdf.text.tolist())
            own = np.array([shared.langs.index(x) for x in pdf.lang])
            at = np.arange(len(own))
            rest = sums.copy()
            rest[at, own] = -np.inf
            yield pd.DataFrame({"lang": pdf.lang, "h": -sums[at, own] / np.maximum(1, n), "n": n,
                                "lead": np.where(len(shared.langs) > 1, sums[at, own] - rest.max(1), 0.0)})[n >= 20]

    own = sample.where(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(4)) == 0).mapInPandas(entropy, "lang string, h double, n long, lead double")
    limits = own.groupBy("lang").agg(F.percentile_approx("h", 0.999).alias("h"), F.avg("h").alias("m")).collect()
    scorer.limits = {r["lang"]: r["h"] + max(0.3, 0.5 * (r["h"] - r["m"])) for r in limits}
    return scorer


def identify(docs: DataFrame, scorer: "Scorer | None", keep: list[str] | None = None, temperature: float = 0.25) -> DataFrame:
    """keep (all columns by default), lang_pred, score, rejected, cross_entropy.

    lang_pred is ``und`` with score 0 where the text is null or has no letter
    (or there is no model); rejected marks texts whose cross-entropy is above
    the limit of their language.  score is the softmax of the summed
    log-probabilities, tempered since neighbouring characters depend on one another.
    """
    keep = docs.columns if keep is None else keep
    if scorer is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)   # bounded by the sample

    @F.pandas_udf("struct<lang: string, score: double, rejected: boolean, h: double>")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in frames:
            sums, n = model.totals(texts.tolist())
            best = sums.argmax(1)
            at = np.arange(len(best))
            p = np.exp((sums - sums[at, best][:, None]) * temperature)
            score = 1.0 / p.sum(1)
            h = -sums[at, best] / np.maximum(1, n)
            lang = np.array(model.langs, dtype=object)[best]
            limit = np.array([model.limits.get(x, math.inf) for x in model.langs])[best]
            none = n == 0
            lang[none], score[none] = "und", 0.0
            yield pd.DataFrame({"lang": lang, "score": score, "rejected": none | (h > limit), "h": np.where(none, np.nan, h)})

    got = docs.select(*keep, run(F.col("text")).alias("__language"))
    return got.select(*keep, F.col("__language.lang").alias("lang_pred"), F.col("__language.score").alias("score"),
                      F.col("__language.rejected").alias("rejected"), F.col("__language.h").alias("cross_entropy"))
