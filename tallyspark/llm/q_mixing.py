"""op4: sampling probabilities of documents raked to target shares."""

from pyspark.sql import functions as F

from .common import read_table
from .mixing import mix, mix_sql
from .registry import query

SQL = f"WITH {mix_sql('documents')}\nSELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, sampled FROM mixed"


@query("op4_mixing", SQL)
def op4_mixing(spark, sf_dir):
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")
