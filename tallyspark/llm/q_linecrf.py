"""op12: quality of every document."""

from pyspark.sql import functions as F

from .common import crc_mod, read_table
from .linecrf import learn, score
from .registry import query


@query("op12_quality")
def op12_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs, model, threshold=0.3, keep=["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.round("line_quality", 6).alias("line_quality"))
