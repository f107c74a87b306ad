"""op1: toxicity of every document."""

from pyspark.sql import functions as F

from .common import crc_mod, read_table
from .registry import query
from .toxicity import learn, score


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs, lexicon, threshold=0.3, keep=["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", F.round("hit_weight", 6).alias("hit_weight"))
