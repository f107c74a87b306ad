"""op2: language of every document."""

from .common import crc_mod, read_table
from .langid import fit, identify
from .registry import query


@query("op2_language")
def op2_language(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_mod("doc_id", 5) != 0).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
