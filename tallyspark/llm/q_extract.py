"""op6: main text of every page."""

from pyspark.sql import functions as F

from .common import read_table
from .extract import extract, fit
from .registry import query


@query("op6_html_extract")
def op6_html_extract(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    out = extract(pages.select("page_id", "url", "html"), fit(pages), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
