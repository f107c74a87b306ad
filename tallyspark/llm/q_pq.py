"""op10: links among embeddings of equal label."""

from .common import read_table
from .pq import embedding_links
from .registry import query


@query("op10_embedding_dedup")
def op10_embedding_dedup(spark, sf_dir):
    return embedding_links(read_table(spark, sf_dir, "embeddings"), threshold=0.93)
