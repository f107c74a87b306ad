"""Mail ingest (operators A1, A2, A4): raw RFC 822 bytes -> message rows.

MIME decoding is the one place where Python runs per row: the standard
``email`` package inside ``mapInArrow`` (Arrow batches, one task per input
partition, no shuffle) returns headers and decoded parts.  The choice of the
body, HTML cleaning and the split of dead letters are column expressions.  A
message that cannot be decoded does not fail the job: it is kept with an
``error`` text and becomes a dead letter.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import html_to_text

PART = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("attached", T.BooleanType()),
    T.StructField("text", T.StringType()),
])
DECODED_SCHEMA = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("parts", T.ArrayType(PART)),
    T.StructField("error", T.StringType()),
])


def _text_of(part, attached: bool, kind: str) -> str | None:
    """Text of a part that can be a body; attachments and other kinds are not decoded."""
    if kind != "single" and (attached or kind not in ("text/plain", "text/html")):
        return None
    payload = part.get_payload(decode=True)
    if payload is None:
        return None
    try:
        return payload.decode("utf-8")
    except UnicodeDecodeError:
        return payload.decode("latin-1")


def decode_one(content: bytes | None) -> dict:
    """Headers and decoded leaf parts of one raw message, or its error."""
    if content is None:
        return {"error": "missing content"}
    try:
        msg = email.message_from_bytes(bytes(content), policy=email.policy.compat32)
        single = not msg.is_multipart()
        parts = []
        for p in [msg] if single else [p for p in msg.walk() if not p.is_multipart()]:
            attached = "attachment" in str(p.get("Content-Disposition"))
            kind = "single" if single else p.get_content_type()
            parts.append({"kind": kind, "attached": attached, "text": _text_of(p, attached, kind)})
        return {"subject": str(msg.get("Subject", "")), "sender": str(msg.get("From", "")), "date": str(msg.get("Date", "")), "parts": parts}
    except Exception as e:  # noqa: BLE001  (per-message fault tolerance)
        return {"error": f"{type(e).__name__}: {e}"}


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(DECODED_SCHEMA)
    for batch in batches:
        rows = [decode_one(c) for c in batch.column("content").to_pylist()]
        decoded = [pa.array([r.get(f.name) for r in rows], f.type) for f in list(schema)[2:]]
        yield pa.RecordBatch.from_arrays([batch.column("account_id"), batch.column("message_id"), *decoded], names=schema.names)


def decode_messages(raw: DataFrame) -> DataFrame:
    """(account_id, message_id, content BINARY) -> headers, decoded parts in
    message order and an ``error`` (NULL when decoded).  Run once; the body
    (A2), the messages (A1) and the dead letters (A4) are columns and filters
    of its result."""
    src = raw.select(F.col("account_id").cast("string").alias("account_id"), F.col("message_id").cast("string").alias("message_id"), "content")
    return src.mapInArrow(_decode_batches, DECODED_SCHEMA)


def body_of(parts="parts"):
    """A2: the body of a message from its decoded parts.  A message of one part
    gives that text as it is; otherwise the first plain or HTML part that is
    no attachment, HTML cleaned to text.  Whole texts, never cut."""
    p = F.col(parts) if isinstance(parts, str) else parts
    usable = F.filter(p, lambda x: ~x["attached"] & x["text"].isNotNull() & x["kind"].isin("text/plain", "text/html"))
    single = F.get(p, F.lit(0))
    chosen = F.get(usable, F.lit(0))
    body = F.when(single["kind"] == "single", single["text"]).when(chosen["kind"] == "text/html", html_to_text(chosen["text"])).otherwise(chosen["text"])
    return F.coalesce(body, F.lit(""))


def parse_messages(raw: DataFrame) -> DataFrame:
    """A1: raw messages -> (account_id, message_id, subject, sender, date,
    body, error); error is NULL where the message was decoded."""
    d = decode_messages(raw)
    return d.select("account_id", "message_id", "subject", "sender", "date",
                    F.when(F.col("error").isNull(), body_of()).alias("body"), "error")


def split_dead_letters(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: (good messages, dead letters)."""
    good = parsed.filter(F.col("error").isNull()).drop("error")
    bad = parsed.filter(F.col("error").isNotNull()).select("account_id", "message_id", "error")
    return good, bad


def read_mail_files(spark: SparkSession, path: str, account_id_from_path: str = r"/account=([^/]+)/",
                    glob: str = "*.eml") -> DataFrame:
    """Scan a folder of raw messages (``binaryFile``) into the raw shape:
    the account id is taken from the path (``.../account=<id>/...``), the
    message id is the file name."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(path))
    return df.select(
        F.regexp_extract("path", account_id_from_path, 1).alias("account_id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("message_id"),
        "content")
