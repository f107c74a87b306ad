"""op7: documents without the lines that many sources share."""

from pyspark.sql import functions as F

from .common import read_table
from .linedup import remove_boilerplate
from .registry import query

MIN_SITES, MIN_WORDS = 6, 3

SQL = f"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS site FROM documents),
lines AS (SELECT doc_id, text, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows),
normed AS (SELECT doc_id, text, site, pos, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')) AS norm FROM lines),
bad AS (SELECT norm, min(doc_id) AS first FROM normed WHERE norm <> '' AND length(norm) - length(replace(norm, ' ', '')) + 1 >= {MIN_WORDS}
        GROUP BY norm HAVING count(DISTINCT site) >= {MIN_SITES}),
kept AS (SELECT n.doc_id, n.text, count(*) AS lines_total, count(*) FILTER (WHERE b.norm IS NOT NULL AND b.first <> n.doc_id) AS lines_removed,
         coalesce(string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE b.norm IS NULL OR b.first = n.doc_id), '') AS kept
         FROM normed n LEFT JOIN bad b ON n.norm = b.norm GROUP BY n.doc_id, n.text)
SELECT doc_id, md5(kept) AS text_md5, length(kept) AS n_chars, lines_total, lines_removed FROM kept
"""


@query("op7_line_dedup", SQL)
def op7_line_dedup(spark, sf_dir):
    out = remove_boilerplate(read_table(spark, sf_dir, "documents"), MIN_SITES, MIN_WORDS)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).cast("long").alias("n_chars"), "lines_total", "lines_removed")
