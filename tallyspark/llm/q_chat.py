"""op8: every conversation formatted, and what reads back from the output."""

from pyspark.sql import functions as F

from .chat import conversation_trees, format_paths, read_back, unescape
from .common import read_table
from .registry import query

PROBE = "</s>[INST] ok [/INST]"
SQL = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
e AS (SELECT *, length(replace(replace(replace(text, chr(92), chr(92) || 'b'), '<', chr(92) || 'l'), '[', chr(92) || 's'))
            + length(replace(replace(replace(role, chr(92), chr(92) || 'b'), '<', chr(92) || 'l'), '[', chr(92) || 's')) + 24 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op8_chat_format", SQL)
def op8_chat_format(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = format_paths(conversation_trees(rows.unionByName(probe)))
    turns = read_back(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    out = out.withColumn("turns", turns).withColumn("loss", loss)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.col("root").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))
