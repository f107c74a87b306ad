"""Document quality by a linear-chain conditional random field over lines.

Every line with a word gets features of its bytes, its words and its
neighbouring lines.  A chain of two labels (bad, good) with a weight for
staying in each label gives every line its forward-backward marginal; the
marginals of a document, weighted by line length, make its quality, which a
logistic curve turns into a probability.

Labels are of documents, so the lines of good documents are good and those of
bad documents start as bad; lines of bad documents that the first chain takes for
good are relabelled and the chain is fitted again.  Fitting reads about
``SAMPLE_DOCS`` labelled documents drawn by hash, of which about
``SAMPLE_LINES`` lines, drawn as runs of at most ``RUN`` lines anywhere in a
document, reach the driver as numbers.  Scoring reads every whole text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, written
from .shingles import buffers, word_hashes

SAMPLE_DOCS, SAMPLE_LINES, RUN = 8_000, 40_000, 64
BLOCK_BYTES, CHUNK = 1 << 22, 1 << 20
ROUNDS = 3            # the first fit and the ones after relabelling

LOWER, UPPER, DIGIT, HIGH, BLANK, CONTROL = range(6)
_class = np.full(256, CONTROL, dtype=np.int64)
_class[0x30:0x3A], _class[0x41:0x5B], _class[0x61:0x7B], _class[0x80:] = DIGIT, UPPER, LOWER, HIGH
_class[[0x20, 9, 11, 12, 13]] = BLANK
_signs = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_class[_signs] = np.arange(6, 6 + len(_signs))
CLASSES = 6 + len(_signs)
NEWLINE = CLASSES
_class[10] = NEWLINE
_coarse = np.where(_class < 6, _class, 7)          # signs that end or join clauses, then other signs
_coarse[[ord(c) for c in ".,;:!?'\"()-"]] = 6
STOP = 8
_coarse[10] = STOP
COLUMNS = CLASSES + STOP * STOP + 6                # of one line alone
AROUND = 8                                         # of each neighbour
FEATURES = COLUMNS + 2 * (AROUND + 1)


def _line_counts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes (lines x CLASSES) and pairs of coarse classes of every line."""
    one, two = np.zeros((len(starts), CLASSES + 1), np.int64), np.zeros((len(starts), (STOP + 1) ** 2), np.int64)
    for at in range(0, len(data), CHUNK):
        part = data[at:at + CHUNK]
        low, high = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, at + len(part))
        line = np.zeros(len(part), dtype=np.int64)
        line[starts[low + 1:high] - at] = 1
        line = np.cumsum(line)
        one[low:high] += np.bincount(line * (CLASSES + 1) + _class[part], minlength=(high - low) * (CLASSES + 1)).reshape(high - low, -1)
        before = np.concatenate([data[at - 1:at] if at else np.array([10], np.uint8), part[:-1]])
        kind = _coarse[before] * (STOP + 1) + _coarse[part]
        inside = np.ones(len(part), dtype=bool)
        inside[(starts[low:high] - at)[starts[low:high] >= at]] = False
        two[low:high] += np.bincount(line[inside] * (STOP + 1) ** 2 + kind[inside], minlength=(high - low) * (STOP + 1) ** 2).reshape(high - low, -1)
    return one[:, :CLASSES], two.reshape(-1, STOP + 1, STOP + 1)[:, :STOP, :STOP].reshape(-1, STOP * STOP)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x FEATURES), byte length and document of every line that
    holds a word, for documents given as bytes and offsets."""
    mark = np.zeros(len(data) + 1, dtype=bool)
    mark[offsets] = True
    mark[np.flatnonzero(data == 10) + 1] = True
    mark[-1] = False
    starts = np.flatnonzero(mark)
    if not len(starts):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    one, two = _line_counts(data, starts)
    hashes, words = word_hashes(data, np.append(starts, len(data)))
    line_of = np.repeat(np.arange(len(starts)), words)
    again = np.bincount(line_of[1:][(hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])], minlength=len(starts))
    with np.errstate(over="ignore"):
        tagged = hashes ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        total = np.cumsum(hashes, dtype=np.uint64)
    order = np.argsort(tagged)
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = tagged[order][1:] != tagged[order][:-1]
    distinct = np.bincount(line_of[order[fresh]], minlength=len(starts))
    use = np.flatnonzero(words > 0)
    doc = np.searchsorted(offsets, starts[use], "right") - 1
    one, two, words, again, distinct = one[use].astype(np.float32), two[use].astype(np.float32), words[use], again[use], distinct[use]
    size = one.sum(1)
    ends = np.cumsum(words)
    whole = total[ends - 1] - np.where(ends > words, total[ends - words - 1], np.uint64(0))
    _, same, copies = np.unique(np.stack([whole, doc.astype(np.uint64)]), axis=1, return_inverse=True, return_counts=True)
    own = np.column_stack([np.log1p(size) / 8, np.log1p(words) / 6, np.log1p(size / words) / 4, np.sqrt(again / np.maximum(words - 1, 1)),
                           distinct / words, np.log1p(copies[same.ravel()] - 1.0)]).astype(np.float32)
    shares = np.sqrt(one / size[:, None])
    signs = np.sqrt(one[:, 6:].sum(1) / size)
    around = np.column_stack([shares[:, [UPPER, DIGIT, BLANK]], signs, own[:, [0, 3, 4, 5]]])
    x = np.zeros((len(use), FEATURES), dtype=np.float32)
    x[:, :COLUMNS] = np.concatenate([shares, np.sqrt(two / np.maximum(size - 1, 1)[:, None]), own], axis=1)
    joined = doc[1:] == doc[:-1]
    for k, (mine, its) in enumerate(((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)))):
        at = COLUMNS + k * (AROUND + 1)
        x[mine, at:at + AROUND] = around[its] * joined[:, None]
        x[mine, at + AROUND] = joined
    return x, size.astype(np.int64), doc


@dataclass
class Chain:
    """mean and scale of the features, their weights, (bias, first line, stay
    bad, stay good), the logistic curve of the document and the score of a
    text without lines."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rest: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)
    empty: float = 0.5

    def unary(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.rest[0]

    def marginals(self, unary: np.ndarray) -> np.ndarray:
        """P(good) of each line of one document, by the forward and backward
        messages as log-odds."""
        if not len(unary):
            return unary
        bad, good = math.exp(self.rest[2]), math.exp(self.rest[3])

        def sweep(values: list[float], first: float) -> list[float]:
            """Log-odds that reach each line from the lines before it."""
            out, message = [], first
            for u in values:
                out.append(message)
                p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, message + u))))
                message = math.log((p * good + 1.0 - p) / (p + (1.0 - p) * bad))
            return out

        values = unary.tolist()
        # the first line's own weight is part of its value in both directions
        values[0] += float(self.rest[1])
        ahead, behind = sweep(values, 0.0), sweep(values[::-1], 0.0)[::-1]
        z = np.array(ahead) + np.array(values) + np.array(behind)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def quality(self, text_bytes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document; NaN without lines."""
        x, size, doc = line_features(text_bytes, offsets)
        unary = self.unary(x)
        out = np.full(len(offsets) - 1, np.nan)
        edges = np.searchsorted(doc, np.arange(len(offsets)))
        for k in np.flatnonzero(np.diff(edges)):
            lines = slice(edges[k], edges[k + 1])
            out[k] = np.average(self.marginals(unary[lines]), weights=size[lines])
        return out

    def score(self, quality: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * _logit(quality)
        return np.where(np.isnan(quality), self.empty, 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p) - np.log1p(-p)


def loss_and_gradient(params: np.ndarray, x: np.ndarray, at: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of line labels and its gradient.  ``at`` (steps x
    chains) holds row numbers of ``x``, -1 behind the end of a chain; ``params``
    are the feature weights, bias, first line, stay bad, stay good."""
    w, (bias, first, bad, good) = params[:-4], params[-4:]
    u = x @ w + bias
    steps, chains = at.shape
    live = at >= 0
    unary = np.where(live, u[at], 0.0)
    unary[0] += first
    a0, a1 = np.zeros((steps, chains)), np.zeros((steps, chains))
    a1[0] = unary[0]
    for t in range(1, steps):
        a0[t] = np.where(live[t], np.logaddexp(a0[t - 1] + bad, a1[t - 1]), a0[t - 1])
        a1[t] = np.where(live[t], np.logaddexp(a0[t - 1], a1[t - 1] + good) + unary[t], a1[t - 1])
    z = np.logaddexp(a0[-1], a1[-1])
    b0, b1 = np.zeros((steps, chains)), np.zeros((steps, chains))
    stay_bad = stay_good = 0.0
    for t in range(steps - 2, -1, -1):
        on = live[t + 1]
        c0, c1 = b0[t + 1], b1[t + 1] + unary[t + 1]
        b0[t] = np.where(on, np.logaddexp(c0 + bad, c1), b0[t + 1])
        b1[t] = np.where(on, np.logaddexp(c0, c1 + good), b1[t + 1])
        stay_bad += np.exp(a0[t] + bad + c0 - z)[on].sum()
        stay_good += np.exp(a1[t] + good + c1 - z)[on].sum()
    p = np.exp(a1 + b1 - z)
    labels = np.where(live, y[at], 0)
    both = live[1:]
    seen_bad = ((labels[1:] == 0) & (labels[:-1] == 0) & both).sum()
    seen_good = ((labels[1:] == 1) & (labels[:-1] == 1) & both).sum()
    gold = (unary * labels).sum() + bad * seen_bad + good * seen_good
    gap = np.zeros(len(x))
    gap[at[live]] = (p - labels)[live]
    grad = np.concatenate([x.T @ gap, [gap.sum(), (p - labels)[0].sum(), stay_bad - seen_bad, stay_good - seen_good]])
    n = live.sum()
    return float((z.sum() - gold) / n + 0.5 * ridge * (params ** 2).sum()), grad / n + ridge * params


def minimise(f, start: np.ndarray, steps: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a backtracking line search."""
    x = start
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = grad.copy(), []
        for s, g in reversed(pairs):
            a = (s @ d) / (s @ g)
            kept.append(a)
            d -= a * g
        if pairs:
            d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, g), a in zip(pairs, reversed(kept)):
            d += s * (a - (g @ d) / (s @ g))
        slope, step = -(grad @ d), 1.0 if pairs else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12))
        while step > 1e-10:
            new = x - step * d
            v, g = f(new)
            if v <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        if (g - grad) @ (new - x) > 1e-12:
            pairs = [*pairs[1 - memory:], (new - x, g - grad)]
        done = value - v < 1e-7 * max(1.0, abs(v))
        x, value, grad = new, v, g
        if done:
            break
    return x


def fit_chain(x: np.ndarray, chain: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> Chain:
    """A chain from line features, the run of each line (equal values lie
    together) and the label of its document."""
    mean, scale = x.mean(0), x.std(0) + 0.02
    z = ((x - mean) / scale).astype(np.float64)
    starts = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    length = np.diff(np.append(starts, len(chain)))
    at = starts[None, :] + np.arange(length.max())[:, None]
    at[np.arange(length.max())[:, None] >= length[None, :]] = -1
    labels, params = y.astype(np.int64), np.zeros(z.shape[1] + 4)
    for turn in range(ROUNDS):
        params = minimise(lambda p: loss_and_gradient(p, z, at, labels, ridge), params)
        if turn == ROUNDS - 1:
            break
        # a line of a bad document that looks good by itself is good
        alone = z @ params[:-4] + params[-4]
        labels = np.where((y == 0) & (alone > 0), 1, y).astype(np.int64)
    return Chain(mean, scale, params[:-4], params[-4:])


def _blocks(column: pa.Array):
    """(first row, last row, bytes, offsets) of runs of documents of about
    BLOCK_BYTES of text or one document."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES))))
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def _runs(batches):
    """(y, nth, lines, x) of every run of at most RUN lines of the documents."""
    for batch in batches:
        for low, _, data, offsets in _blocks(batch.column(0)):
            x, _, doc = line_features(data, offsets)
            first = np.searchsorted(doc, doc)
            run = (np.arange(len(doc)) - first) // RUN
            starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (run[1:] != run[:-1]))) if len(doc) else np.zeros(0, int)
            ends = np.append(starts[1:], len(doc))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(low + doc[starts])), batch.column(2).take(pa.array(low + doc[starts])), pa.array(run[starts], pa.int64()),
                 pa.array(ends - starts, pa.int64()), pa.array([x[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())],
                names=["y", "h", "nth", "lines", "x"])


def fit(train: DataFrame, label: str = "quality") -> Chain:
    """Learn a chain from (text, label 0/1).  Rows with a null label or text are
    left out; equal texts with equal labels count once.  Without both labels
    every text gets the share of label 1 (0.5 without any row)."""
    rows = train.select("text", F.col(label).cast("int").alias("y")).where("text is not null and y in (0, 1)")
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    rows = (rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
            .groupBy(F.xxhash64("text").alias("h"), "y").agg(F.first("text").alias("text")))
    rows = written(rows, "quality-sample")
    seen = rows.groupBy("y").count().toPandas().set_index("y")["count"]
    empty = float(seen.get(1, 0) / seen.sum()) if len(seen) else 0.5
    runs = written(rows.select("text", "y", "h").mapInArrow(_runs, "y int, h long, nth long, lines long, x binary"), "quality-runs")
    lines = runs.agg(F.sum("lines")).first()[0] or 0
    rate = min(1.0, SAMPLE_LINES / max(1, lines))
    drawn = runs.where(F.pmod(F.xxhash64("h", "nth", F.lit(5)), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1)
    drawn = drawn.orderBy("h", "y", "nth").select("y", "lines", "x").toPandas()      # bounded: about SAMPLE_LINES rows of numbers
    if drawn.y.nunique() < 2:
        return Chain(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), np.zeros(4), (float(_logit(np.array(empty))), 0.0), empty)
    x = np.frombuffer(b"".join(drawn.x), dtype=np.float32).reshape(-1, FEATURES)
    model = fit_chain(x, np.repeat(np.arange(len(drawn)), drawn.lines), np.repeat(drawn.y.to_numpy(), drawn.lines))

    def measure(batches):
        for batch in batches:
            for low, end, data, offsets in _blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(model.quality(data, offsets)), batch.column(1).slice(low, end - low)], names=["q", "y"])

    got = rows.select("text", "y").mapInArrow(measure, "q double, y int").where("not isnan(q)").toPandas()     # bounded: about SAMPLE_DOCS
    model.curve, model.empty = _curve(_logit(got.q.to_numpy()), got.y.to_numpy(float)), empty
    return model


def _curve(q: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Ridge logistic regression of the label on the logit of the quality;
    the slope is not negative."""
    x = np.column_stack([np.ones(len(q)), q])
    b, ridge = np.array([0.0, 1.0]), np.diag([1e-3, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), max(0.0, float(b[1]))


def score(docs: DataFrame, model: Chain, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """keep (all columns but ``text`` by default; a kept column must not be named
    score, predicted or line_quality), score, predicted, line_quality (the
    length-weighted mean marginal, null without lines).

    Null and empty texts and texts without a word have no line and get the share
    of label 1 among the training texts.  Lines of any number and length are
    read whole; memory is in proportion to a block of about 4 MB or the longest
    text.  Repeated rows get equal scores, an empty table no rows.
    """
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)      # FEATURES numbers
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        chain = shared.value
        for batch in batches:
            for low, end, data, offsets in _blocks(batch.column(len(keep))):
                q = chain.quality(data, offsets)
                s = chain.score(q)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(low, end - low) for k in range(len(keep))), pa.array(s), pa.array((s >= threshold).astype(np.int32)),
                     pa.array(q, mask=np.isnan(q))], names=[*keep, "score", "predicted", "line_quality"])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{kinds}, score double, predicted int, line_quality double".removeprefix(", "))


def learn(docs: DataFrame, labels: DataFrame, held_out_remainder: int = 0, folds: int = 5) -> Chain:
    """Chain from the labelled documents outside the held-out fold."""
    known = (labels.select("doc_id", "quality").where("quality is not null and doc_id is not null")
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    train = known.where(crc_mod("doc_id", folds) != held_out_remainder)
    share = min(1.0, 4 * SAMPLE_DOCS / max(1, train.count()))     # copies of a text are merged later
    train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return fit(docs.select("doc_id", "text").join(train, "doc_id"))
