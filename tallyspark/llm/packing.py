"""Harmonic packing of tokenised documents into fixed-length sequences.

Lengths are classed by reciprocal capacity: class k holds pieces of exactly
capacity / k tokens, k pieces to a sequence.  A document gives as many whole
sequences as it fills; its remainder is cut greedily into the largest classes
that fit.  With k = 1, 2, 4, ... the class lengths add up to any remainder, so
every full sequence has no padding.  Pieces are dealt to workers by a hash of
their document and each worker fills its own sequences; the last pieces of a
class, fewer than k, form shorter sequences of a power of two of tokens, which
need no padding either.
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

GROUP_DOCS = 4096      # documents per packing worker, about
CACHE_WORDS = 400_000


class Tokenizer:
    """Byte-level BPE ids of the vocabulary file ``path``, as ``tokenizers``
    gives them with add_special_tokens=False: an added token that stands in a
    text, such as <|endoftext|>, is its own id.  Texts without one are encoded
    by tiktoken where the vocabulary is there in its form."""

    def __init__(self, path: str):
        import tokenizers
        self.model = tokenizers.Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        try:
            import public_tokenizers as public
            import tiktoken
            same = public.path("byte_bpe_50k.tiktoken") if path == public.path("byte_bpe_50k.json") else None
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(same, "rb"))} if same else None
            self.fast = tiktoken.Encoding("same", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        except ImportError:
            self.fast = None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is not None:
            return [np.array(self.fast.encode_ordinary(t), dtype=np.uint32) if not any(a in t for a in self.added) else self.plain([t])[0]
                    for t in (t.encode("utf-8", "replace").decode() for t in texts)]
        return self.plain(texts)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.model.encode_batch(texts, add_special_tokens=False)]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: whole
    sequences, then the binary digits of the remainder, largest first."""
    out, at = [], 0
    while n - at >= capacity:
        out.append((at, capacity))
        at += capacity
    size = capacity
    while at < n:
        size //= 2
        if n - at >= size:
            out.append((at, size))
            at += size
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id",
           ids: bool = False) -> DataFrame:
    """One row per piece: id, doc_key, start, length, ids_crc32, doc_tokens
    and, with ``ids``, the token ids as little-endian 32-bit binary."""
    def run(batches):
        tok = Tokenizer(tokenizer_path)
        for batch in batches:
            texts = batch.column(2)
            for at in range(0, len(batch), 256):
                rows, out = [], {"s": [], "l": [], "c": [], "n": [], "i": []}
                for k, got in enumerate(tok.encode([t or "" for t in texts.slice(at, 256).to_pylist()])):
                    data = got.astype("<u4").tobytes() + struct.pack("<I", end_id)
                    n = len(data) // 4
                    for start, length in cuts(n, capacity):
                        part = data[4 * start:4 * (start + length)]
                        rows.append(at + k)
                        out["s"].append(start)
                        out["l"].append(length)
                        out["c"].append(zlib.crc32(part))
                        out["n"].append(n)
                        if ids:
                            out["i"].append(part)
                take = pa.array(rows, pa.int64())
                columns = [batch.column(0).take(take), batch.column(1).take(take)] + [pa.array(out[x], pa.int64()) for x in "slcn"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(out["i"], pa.binary())] if ids else []),
                                                 names=[id_col, "doc_key", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids)

    kind = docs.schema[id_col].dataType.simpleString()
    key = F.xxhash64(F.col(id_col), F.col("text"))
    return docs.select(id_col, key.alias("doc_key"), "text").mapInArrow(
        run, f"`{id_col}` {kind}, doc_key bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * ids)


def pack(rows: DataFrame, groups: int, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``.

    Worker and order depend on row values only (repeated rows are
    interchangeable), so a lost task gives the same result again.  The window
    holds one class of one worker: about GROUP_DOCS pieces.
    """
    per = F.lit(capacity) / F.col("length")
    group = F.pmod(F.xxhash64(F.lit(17), "doc_key", F.expr("start div 2048 div 4096")), F.lit(groups))
    w = Window.partitionBy("worker", "length").orderBy("doc_key", "start", "ids_crc32")
    whole = Window.partitionBy("worker", "length")
    rows = rows.withColumn("worker", group).withColumn("n", F.row_number().over(w).cast("long") - 1).withColumn("all", F.count("*").over(whole))
    rows = rows.withColumn("per", per.cast("long"))
    full = F.expr("all - all % per")
    # the last all % per pieces: binary digits of their number, largest first
    tail, left = F.expr("n - (all - all % per)"), F.expr("all % per")
    digit = F.expr("aggregate(sequence(0, 30), named_struct('at', 0L, 'bin', -1L, 'off', 0L), (s, i) -> "
                   "if((all % per) & shiftleft(1L, 30 - i) = 0, s, if(s.bin < 0 and n - (all - all % per) < s.at + shiftleft(1L, 30 - i), "
                   "named_struct('at', s.at + shiftleft(1L, 30 - i), 'bin', cast(30 - i as bigint), 'off', n - (all - all % per) - s.at), "
                   "named_struct('at', s.at + shiftleft(1L, 30 - i), 'bin', s.bin, 'off', s.off))))")
    rows = rows.withColumn("last", F.when(F.col("n") >= full, digit))
    bin_no = F.when(F.col("last").isNull(), F.expr("n div per")).otherwise(F.expr("all div per") + F.col("last.bin"))
    slot = F.when(F.col("last").isNull(), F.expr("n % per")).otherwise(F.col("last.off"))
    power = F.log2(F.col("per")).cast("long")
    sequence = (F.col("worker") * 32 + power) * F.lit(1 << 26) + bin_no
    return rows.withColumn("sequence_id", sequence).withColumn("offset", slot * F.col("length")).drop("worker", "n", "all", "per", "last")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id",
                   ids: bool = False) -> DataFrame:
    """Pack every document (null text counts as empty and gives its end id
    alone) into sequences of at most ``capacity`` tokens (a power of two).

    Returns one row per piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids).  Repeated rows are packed each; null ids are
    kept; an empty table gives an empty result; other columns are ignored.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    n = docs.count()
    got = pieces(docs, tokenizer_path, capacity, end_id, id_col, ids)
    return pack(got, max(1, -(-n // GROUP_DOCS)), capacity).drop("doc_key")
