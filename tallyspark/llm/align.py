"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the same bytes.  All A and B tokens of a block of documents
are lexsorted by start; where a start reaches the running maximum of the ends
(``maximum.accumulate``) a new group begins, and inside the groups overlaps
expand to token links.

Links are counted over the corpus without shuffling them per document: a chunk
of documents keeps its distinct id pairs once, with the number of its documents
that hold each, and every document as references into that list.  Counts add up
over chunks, return to the chunks by their pairs, and each chunk resolves its
own references.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import written

BLOCK_BYTES = 1 << 20      # text aligned at once, or one document
CHUNK_REFS = 1_500_000     # references of a chunk, or one document
BITS = 20                  # of a token id; two ids and the block's document number fit 63 bits
_loaded: dict[tuple[str, str], tuple] = {}


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable Latin-1 for itself, the other bytes from U+0100 on in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ByteBpe:
    """Ids of space + text by a byte-level vocabulary of ``tokenizers``; special
    tokens inside texts are plain text.  The same vocabulary in tiktoken's form
    is used where it is installed."""

    def __init__(self, path: str):
        import tokenizers
        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        vocab = self.model.get_vocab(with_added_tokens=True)
        of = byte_level()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        self.fast = None
        try:
            import public_tokenizers as public
            import tiktoken
            if path == public.path("byte_bpe_50k.json"):
                with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
                self.fast = tiktoken.Encoding("same", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except ImportError:
            pass

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is not None:
            return [self.fast.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.model.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class PieceBpe:
    """Ids of a text by a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in ((i, self.model.id_to_piece(i)) for i in range(n))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _tools(path_a: str, path_b: str) -> tuple:
    """Both tokenizers, the byte lengths of their ids, and the ids written out
    with each separator; kept by the worker process."""
    if (path_a, path_b) not in _loaded:
        a, b = ByteBpe(path_a), PieceBpe(path_b)
        words = [str(i).encode() + sep for size, seps in ((len(a.bytes), (b",", b"|")), (len(b.bytes), (b",", b";"))) for sep in seps for i in range(size)]
        written_out = np.empty(len(words), dtype=object)
        written_out[:] = words
        _loaded[path_a, path_b] = (a, b, *(np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (a, b)), written_out)
    return _loaded[path_a, path_b]


def coalesce(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of the tokens of two cuts of the same bytes, given the end offsets:
    the group of each A and each B token, and all overlapping (A, B) positions."""
    start_a, start_b = (np.concatenate([[0], e[:-1]]).astype(np.int64) if len(e) else e for e in (end_a, end_b))
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    side = np.zeros(len(start), dtype=np.int8)
    side[len(end_a):] = 1
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), dtype=np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks)
    group_a, group_b = group[:len(end_a)], group[len(end_a):]
    # the B tokens of a group that end behind the A token's start and start before its end
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = high - low
    left = np.repeat(np.arange(len(end_a)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n - low, n)
    return group_a, group_b, left, right


class _Block:
    """The alignment of a run of texts."""

    def __init__(self, tools: tuple, texts: list[bytes]):
        a, b, size_a, size_b, out = tools
        self.n = len(texts)
        whole = [t.decode("utf-8", "replace") for t in texts]
        ids_a, ids_b = a.encode(whole), b.encode(whole)
        for k, (x, y, text) in enumerate(zip(ids_a, ids_b, texts)):
            same = text and all(b"".join(map(t.bytes.__getitem__, ids)) == b" " + text for t, ids in ((a, x), (b, y)))
            if not same:
                ids_a[k], ids_b[k] = [], []
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(n.sum())) for ids, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        docs_a, docs_b = (np.repeat(np.arange(self.n), n) for n in (self.n_a, self.n_b))
        ga, gb, left, right = coalesce(np.cumsum(size_a[flat_a]), np.cumsum(size_b[flat_b]))
        first = np.ones(len(ga), dtype=bool)
        first[1:] = ga[1:] != ga[:-1]
        self.n_groups = np.bincount(docs_a[first], minlength=self.n)
        self.n_links = np.bincount(docs_a[left], minlength=self.n)
        key, self.times = np.unique(docs_a[left] << 2 * BITS | flat_a[left] << BITS | flat_b[right], return_counts=True)
        self.pairs = key & ((1 << 2 * BITS) - 1)
        self.refs = np.bincount(key >> 2 * BITS, minlength=self.n)
        self.digests = self._digests(out, len(size_a), len(size_b), flat_a, flat_b, ga, gb)

    def _digests(self, out, many_a, many_b, flat_a, flat_b, ga, gb) -> list[str]:
        last_a, last_b = np.ones(len(ga), dtype=bool), np.ones(len(gb), dtype=bool)
        last_a[:-1], last_b[:-1] = ga[1:] != ga[:-1], gb[1:] != gb[:-1]
        code = np.empty(len(ga) + len(gb), dtype=np.int64)
        code[np.arange(len(ga)) + np.searchsorted(gb, ga, "left")] = flat_a + many_a * last_a
        code[np.arange(len(gb)) + np.searchsorted(ga, gb, "right")] = 2 * many_a + flat_b + many_b * last_b
        words, digests, at = out[code].tolist(), [], 0
        for n in (self.n_a + self.n_b).tolist():
            digests.append(hashlib.sha256(b"".join(words[at:at + n])[:-1]).hexdigest() if n else "")
            at += n
        return digests


def _packed(*columns: np.ndarray) -> bytes:
    """Unsigned 32-bit columns by byte planes, compressed."""
    planes = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(columns, 4, -1).transpose(0, 2, 1)).view("<u4")[:, :, 0]


def chunks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id") -> DataFrame:
    """One row per chunk of documents: chunk, docs (id, n_a, n_b, n_groups,
    n_links, groups_sha256, n_refs), refs (positions in pairs and times of each
    document's distinct pairs), pairs (ids of A and B, documents of the chunk)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_refs"]

    def run(batches):
        tools = _tools(path_a, path_b)
        part, nth = TaskContext.get().partitionId(), 0
        ids, held, refs = [], [], 0

        def row():
            nonlocal nth
            pairs, at, docs_with = np.unique(np.concatenate([b.pairs for b in held]), return_inverse=True, return_counts=True)
            times = np.concatenate([b.times for b in held])
            many = np.concatenate([b.refs for b in held])
            steps = np.diff(at, prepend=0)
            starts = (np.cumsum(many) - many)[many > 0]
            steps[starts] = at[starts]
            flat = [pa.concat_arrays(ids), *(pa.array(np.concatenate([getattr(b, k) for b in held]).astype(np.int64)) for k in names[1:5]),
                    pa.array([d for b in held for d in b.digests], pa.string()), pa.array(many.astype(np.int64))]
            listed = pa.ListArray.from_arrays(pa.array([0, len(many)], pa.int32()), pa.StructArray.from_arrays(flat, names=names))
            got = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | nth], pa.int64()), listed, pa.array([_packed(steps, times)], pa.binary()),
                 pa.array([_packed(pairs >> BITS, pairs & ((1 << BITS) - 1), docs_with)], pa.binary())], names=["chunk", "docs", "refs", "pairs"])
            nth += 1
            return got

        for batch in batches:
            texts = batch.column(1)
            sizes = np.array([0 if x is None else len(x) for x in (t.as_buffer() for t in texts)], dtype=np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")))
                ids.append(batch.column(0).slice(at, end - at))
                held.append(_Block(tools, [t or b"" for t in texts.slice(at, end - at).to_pylist()]))
                refs += len(held[-1].pairs)
                at = end
                if refs >= CHUNK_REFS:
                    yield row()
                    ids, held, refs = [], [], 0
        if held:
            yield row()

    listed = f"array<struct<id: {kind}, n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string, n_refs: bigint>>"
    return (docs.select(F.col(id_col).alias("id"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, f"chunk bigint, docs {listed}, refs binary, pairs binary"))


def _listed_pairs(batches):
    """(chunk, pos, a, b, docs) of every distinct pair of every chunk."""
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b, docs = _unpacked(data, 3)
            for at in range(0, len(a), 1 << 18):
                part = slice(at, at + (1 << 18))
                n = len(a[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk), pa.int64()), pa.array(np.arange(at, at + n, dtype=np.int32)),
                                                  *(pa.array(x[part].astype(np.int32)) for x in (a, b, docs))], names=["chunk", "pos", "a", "b", "docs"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id") -> DataFrame:
    """Alignment of two tokenizers over ``docs`` (id column and ``text``; other
    columns are ignored).

    Returns one row per input row: id, n_a, n_b, n_groups, n_links, n_best
    (links whose pair is in the most documents of all pairs of its A id, ties
    included), count_sum (documents that hold the pair, over links) and
    groups_sha256.

    A null or empty text, or one whose tokens do not give back its bytes behind
    a space, has no tokens: zeros and an empty digest.  Null ids are kept,
    repeated rows are documents of their own, an empty table gives no rows.  A
    text is encoded whole; memory is in proportion to a block of about 1 MB or
    to the longest text.
    """
    table = written(chunks(docs, path_a, path_b, id_col), "aligned-chunks")
    pairs = table.select("chunk", "pairs").mapInArrow(_listed_pairs, "chunk long, pos int, a int, b int, docs int")
    counts = written(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "aligned-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    known = (pairs.drop("docs").join(counts, ["a", "b"]).groupBy("chunk")
             .agg(F.collect_list(F.struct("pos", "count", "best")).alias("known")))
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def resolve(batches):
        for batch in batches:
            for k in range(len(batch)):
                listed = batch.column(0).slice(k, 1).flatten()
                many = listed.field("n_refs").to_numpy()
                known = batch.column(2).slice(k, 1).flatten()
                best, total = np.zeros(len(many), dtype=np.int64), np.zeros(len(many), dtype=np.int64)
                if len(known):
                    pos = known.field("pos").to_numpy()
                    count, is_best = np.empty(len(pos), dtype=np.int64), np.empty(len(pos), dtype=np.int64)
                    count[pos] = known.field("count").to_numpy()
                    is_best[pos] = known.field("best").to_numpy(zero_copy_only=False)
                    steps, times = _unpacked(batch.column(1)[k].as_py(), 2).astype(np.int64)
                    full = many > 0
                    starts = (np.cumsum(many) - many)[full]
                    at = np.cumsum(steps)        # over all documents; each begins anew at its first step
                    at -= np.repeat(at[starts] - steps[starts], many[full])
                    best[full] = np.add.reduceat(is_best[at] * times, starts)
                    total[full] = np.add.reduceat(count[at] * times, starts)
                yield pa.RecordBatch.from_arrays([listed.field("id"), *(listed.field(x) for x in names[1:5]), pa.array(best), pa.array(total),
                                                  listed.field("groups_sha256")], names=names)

    return (table.select("chunk", "docs", "refs").join(known, "chunk", "left").select("docs", "refs", "known")
            .mapInArrow(resolve, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
