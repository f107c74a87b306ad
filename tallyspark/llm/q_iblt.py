"""op5: fingerprints of every document and of its edited text."""

from .common import read_table
from .iblt import fingerprints
from .registry import query


@query("op5_fingerprints")
def op5_fingerprints(spark, sf_dir):
    return fingerprints(read_table(spark, sf_dir, "documents"))
