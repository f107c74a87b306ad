"""op3: near-duplicate components of documents."""

from .common import read_table
from .registry import query
from .setsketch import near_duplicates


@query("op3_minhash_dedup")
def op3_minhash_dedup(spark, sf_dir):
    out = near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")
