"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digit substitutions) and matched
by an Aho-Corasick automaton of word and word-prefix terms; hits inside an
exception phrase do not count.  The sum of the weights, also normalised by
length, gives a calibrated score.

Term weights are log-odds of document frequencies between labelled toxic and
other texts.  Fitting reads a sample of at most about ``SAMPLE`` labelled rows,
drawn by hash; scoring reads every whole text.
"""

import bisect
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, written

SAMPLE = 24_000
FRAME_TERMS, FRAME_CHARS = 20_000, 1 << 24     # of one frame of counts
LEAST_TEXTS = 8       # toxic texts that are enough for a term in any sample; the rest is left to its significance
MIN_PREFIX, MAX_PREFIX = 4, 8

# Letters of other scripts that look like Latin ones, and
# characters commonly put for letters.
HOMOGLYPHS = ("а a  е e  о o  р p  с c  у y  х x  і i  ј j  ѕ s  ԁ d  һ h  ӏ l  к k  м m  т t  в b  н h  г r  п n  "
              "α a  ε e  ο o  ρ p  τ t  υ u  ι i  κ k  ν v  η n  χ x  γ y  ω w  ß s  ł l  ø o  đ d  ħ h  ı i  æ a  œ o")
SUBSTITUTES = "0 o  1 i  3 e  4 a  5 s  7 t  8 b  9 g  € e  £ l"
SIGNS = {"@": "a", "$": "s"}     # stand for letters only right before a letter


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for c in [*range(0x00, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0x3000, 0x3004), *range(0xFF01, 0xFF5F)]:
        s = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        table[c] = s if s.isalnum() else " "
    table.update(dict.fromkeys(range(0x300, 0x370)))                       # combining marks
    table.update(dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]))  # invisible
    pairs = (HOMOGLYPHS + "  " + SUBSTITUTES).split()
    for a, b in zip(pairs[::2], pairs[1::2]):
        table[ord(a)] = b
        table[ord(a.upper()) if len(a.upper()) == 1 else ord(a)] = b
    return table


_TABLE = _fold_table()


_SIGN = re.compile(r"[@$](?=[^\W\d_])")


def fold(text: str | None) -> list[str]:
    """Folded words of a text."""
    text = text or ""
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    return text.translate(_TABLE).split()


@dataclass
class Lexicon:
    """weights: term -> weight, where a term ending in ``*`` is a prefix;
    exceptions: folded phrases inside which no term counts."""
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, ...] = (-3.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            pattern = " " + t[:-1] if t.endswith("*") else f" {t} "
            a.add_word(pattern, (len(pattern), w))
        for p in self.exceptions:
            a.add_word(f" {p} ", (len(p) + 2, None))
        if len(a):
            a.make_automaton()
        return a


def hits(automaton, words: list[str]) -> list[float]:
    """Weights of the terms found, one (the largest) per word start, without
    those inside exception phrases."""
    if not len(automaton) or not words:
        return []
    found: dict[int, float] = {}
    spans = []
    for end, (length, weight) in automaton.iter(" " + " ".join(words) + " "):
        if weight is None:
            spans.append((end - length + 1, end))
        else:
            start = end - length + 1
            found[start] = max(found.get(start, 0.0), weight)
    if not spans:
        return list(found.values())
    spans.sort()
    starts, ends, top = [a for a, _ in spans], [], 0
    for _, b in spans:
        ends.append(top := max(top, b))     # the furthest end of the spans up to this one
    return [w for s, w in found.items() if not (k := bisect.bisect_right(starts, s)) or ends[k - 1] <= s]


def features(automaton, text: str | None) -> tuple[float, float]:
    words = fold(text)
    total = sum(hits(automaton, words))
    return math.log1p(total), total / math.sqrt(len(words) + 20.0)


def _candidates(words: set[str]) -> set[str]:
    out = set(words)
    for w in words:
        for k in range(MIN_PREFIX, min(MAX_PREFIX, len(w) - 1) + 1):
            out.add(w[:k] + "*")
    return out


def _tables(tox: Counter, clean: Counter) -> Iterator[pd.DataFrame]:
    """Counters as frames of bounded length."""
    for which, name in ((tox, "t"), (clean, "c")):
        part, size = [], 0
        for item in itertools.chain(which.items(), (None,)):
            if part and (item is None or len(part) == FRAME_TERMS or size > FRAME_CHARS):
                got = pd.DataFrame({"term": pd.Series([k for k, _ in part], dtype=object), "t": 0, "c": 0})
                got[name] = [v for _, v in part]
                yield got
                part, size = [], 0
            if item is not None:
                part.append(item)
                size += len(item[0])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps (first column: intercept).
    Weights of hits stay non-negative."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b = b + step
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in b)


def fit(train: DataFrame, label: str = "toxic", exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn a lexicon from (text, label 0/1).  Rows with a null label or text
    are left out; equal texts count once.  ``exceptions`` are added to the
    phrases learnt from texts without the label."""
    rows = train.select("text", F.col(label).cast("int").alias("y")).where("text is not null and y in (0, 1)")
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    rows = (rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
            .groupBy(F.xxhash64("text").alias("h"), "y").agg(F.first("text").alias("text")))

    def count(frames):
        tox, clean, docs = Counter(), Counter(), [0, 0]
        for pdf in frames:
            for text, y in zip(pdf.text, pdf.y):
                docs[y] += 1
                (tox if y else clean).update(_candidates(set(fold(text))))
        yield pd.DataFrame({"term": [""], "t": [docs[1]], "c": [docs[0]]})
        yield from _tables(tox, clean)

    counts = rows.select("text", "y").mapInPandas(count, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = written(counts, "toxic-terms")
    total = counts.where("term = ''").first()
    nt, nc = (total["t"], total["c"]) if total else (0, 0)
    if not nt or not nc:
        return Lexicon({}, list(exceptions))
    least = max(3, min(LEAST_TEXTS, math.ceil(0.02 * nt)))     # below, chance alone reaches the significance among many terms
    weight = F.log((F.col("t") + 0.5) / (nt + 1.0)) - F.log((F.col("c") + 0.5) / (nc + 1.0))
    p, n = nt / (nt + nc), F.col("t") + F.col("c")
    z = (F.col("t") - n * p) / F.sqrt(n * p * (1 - p))      # against the share of toxic texts
    best = (counts.where((F.col("term") != "") & (F.col("t") >= least)).withColumn("w", weight).withColumn("z", z)
            .where("w >= 1.5 and z >= 6").orderBy(F.desc("z"), "term").collect())     # bounded by the sample
    have = {r["term"]: r for r in best}
    stems = sorted((o.rstrip("*"), o) for o in have)
    weights = {}
    for term, r in have.items():
        stem = term.rstrip("*")
        # a longer term with nearly all of the toxic texts is the more exact one ...
        longer = itertools.takewhile(lambda x: x[0].startswith(stem), itertools.islice(stems, bisect.bisect_left(stems, (stem,)), None))
        if term.endswith("*") and any(o != term and have[o]["t"] >= 0.97 * r["t"] for _, o in longer):
            continue
        # ... and a term is left out where a kept prefix is as sure with many more texts
        shorter = {stem[:k] + "*" for k in range(MIN_PREFIX, len(stem) + 1)} & have.keys() - {term}
        if any(have[o]["t"] * 0.97 > r["t"] and have[o]["w"] >= r["w"] - 0.7 for o in shorter):
            continue
        weights[term] = float(r["w"])
    lex = Lexicon(weights, list(exceptions))
    shared = lex

    def contexts(frames):
        auto = shared.automaton()
        tox, clean = Counter(), Counter()
        for pdf in frames:
            for text, y in zip(pdf.text, pdf.y):
                words = fold(text)
                for k, w in enumerate(words):
                    if hits(auto, [w]):
                        near = {" ".join(words[max(0, k - 1):k + 1]), " ".join(words[k:k + 2])} - {w}
                        (tox if y else clean).update(near)
        yield from _tables(tox, clean)

    if weights:
        learnt = (rows.select("text", "y").mapInPandas(contexts, "term string, t long, c long").groupBy("term")
                  .agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("c >= 5 and t * 20 < c")
                  .orderBy(F.desc("c"), "term").collect())     # bounded by the sample
        lex.exceptions += [r["term"] for r in learnt]
    shared = lex

    def measure(frames):
        auto = shared.automaton()
        for pdf in frames:
            got = [features(auto, t) for t in pdf.text]
            yield pd.DataFrame({"a": [g[0] for g in got], "b": [g[1] for g in got], "y": pdf.y.to_numpy()})

    x = rows.select("text", "y").mapInPandas(measure, "a double, b double, y int").toPandas()
    lex.coefficients = _logistic(x[["a", "b"]].to_numpy(), x["y"].to_numpy(float))
    return lex


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns by default), score, predicted, hit_weight.  Null and
    empty texts have no hits and get the score of no evidence.  A text of any
    length is matched whole, in time in proportion to it; repeated rows get equal
    scores; an empty table gives no rows."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms and exceptions bounded by the sample

    @F.pandas_udf("struct<score: double, hit_weight: double>")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        auto = lex.automaton()
        b = lex.coefficients
        for texts in frames:
            got = [features(auto, t) for t in texts]
            z = [b[0] + b[1] * u + b[2] * v for u, v in got]
            yield pd.DataFrame({"score": [1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z],
                                "hit_weight": [math.expm1(u) for u, _ in got]})

    got = docs.select(*keep, run(F.col("text")).alias("__toxicity"))
    return got.select(*keep, F.col("__toxicity.score").alias("score"),
                      (F.col("__toxicity.score") >= threshold).cast("int").alias("predicted"),
                      F.col("__toxicity.hit_weight").alias("hit_weight"))


def learn(docs: DataFrame, labels: DataFrame, held_out_remainder: int = 2, folds: int = 4) -> Lexicon:
    """Lexicon from the labelled documents outside the held-out fold."""
    known = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = known.where(crc_mod("doc_id", folds) != held_out_remainder)
    n = train.count()
    share = min(1.0, 2 * SAMPLE / max(1, n))
    train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return fit(docs.select("doc_id", "text").join(train, "doc_id"))
