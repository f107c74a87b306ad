"""The registered queries and the pipeline's stages, on the smallest tables and
on tables of odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import chat
from tallyspark.llm.catalog import QUERIES
from tallyspark.llm.common import read_table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op3_minhash_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op4_mixing": {"doc_id", "probability", "sampled"},
    "op5_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op6_html_extract": {"page_id", "url", "text", "n_chars"},
    "op7_line_dedup": {"doc_id", "lines_total", "lines_removed"},
    "op8_chat_format": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op9_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op10_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op11_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op12_quality": {"doc_id", "held_out", "score", "predicted"},
    "op13_source_divergence": {"lang", "source", "part", "item", "value", "rank"},
}
TABLE = {"op6_html_extract": ("pages", "page_id"), "op8_chat_format": ("conversations", "conv_id"), "op10_embedding_dedup": ("embeddings", "vec_id")}


def test_all_operators_are_registered():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_covers_its_table(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert COLUMNS[name] <= set(rows[0].asDict())
    table, key = TABLE.get(name, ("documents", "doc_id"))
    ids = {r[key] for r in read_table(spark, SF, table).select(key).distinct().collect()}
    if name == "op13_source_divergence":
        return
    assert {r[key] for r in rows} == ids | ({-1} if name == "op8_chat_format" else set())
    if name != "op9_packing":
        assert len(rows) == len(ids) + (name == "op8_chat_format")
    if "held_out" in rows[0].asDict():
        folds, remainder = {"op1_toxicity": (4, 2), "op2_language": (5, 0), "op12_quality": (5, 0)}[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == remainder) for r in rows)
        assert all(0 <= r.score <= 1 for r in rows)
    if "predicted" in rows[0].asDict():
        assert all(r.predicted == int(r.score >= 0.3) for r in rows)


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Tables with nulls in every column, empty and repeated rows, equal ids with
    other texts and extra columns whose names clash."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = read_table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    kinds = dict(docs.dtypes)
    odd = [(None, None, None, None, None), (900001, None, "en", "src1", None), (900002, "", None, None, 0), (900003, " \n ", "en", "src1", 3),
           (900004, "word " * 30_000, "en", "src2", 150_000), (900005, "same text of a few words in two rows", "en", "src3", 36),
           (900005, "same text of a few words in two rows", "en", "src3", 36), (900005, "another text under the same id stands here", "de", None, 42)]
    extra = spark.createDataFrame(odd, ", ".join(f"{c} {kinds[c]}" for c in corpus_pipeline.COLUMNS))
    clash = {c: F.lit(1) for c in ("score", "predicted", "id", "row_hash", "site", "kept", "component_id", "topic", "tokens", "sampled", "start", "term", "chunk")}
    docs.unionByName(extra).withColumns(clash).write.parquet(f"{folder}/documents.parquet")
    labels = read_table(spark, SF, "labels")
    labels.unionByName(spark.createDataFrame([(None, 1, 1), (900001, None, None), (900005, 0, 1)], labels.schema)).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_keep_their_columns_and_decide(spark, odd_tables):
    docs = read_table(spark, odd_tables, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_tables)
        assert out.columns == corpus_pipeline.COLUMNS, name
        before, after = docs.count(), out.count()
        assert 0 < after <= before, name
        if name == "near_dedup":
            left = [r.text for r in out.where("doc_id = 900005").collect()]
            assert sorted(left) == ["another text under the same id stands here", "same text of a few words in two rows"]
        docs = out.cache()
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, odd_tables).collect()
    assert sum(r.length for r in rows) == sum({(r.doc_id, r.start, r.ids_crc32, k): r.length for k, r in enumerate(rows)}.values())
    assert all(r.length >= 1 and r.offset + r.length <= 2048 for r in rows)


def test_stages_on_empty_tables(spark, odd_tables):
    none = read_table(spark, odd_tables, "documents").where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, odd_tables).collect() == [], name


def test_cycles_of_parents_lose_no_message(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("leaf", "b"), ("far", "leaf"), ("root", None), ("x", "root"), ("self", "self")]
    df = spark.createDataFrame(rows, "node string, parent string")
    got = {(r.leaf, r.node, r.up) for r in chat.paths(df).collect()}
    assert got == {("a", "a", 0), ("c", "c", 0), ("far", "far", 0), ("far", "leaf", 1), ("far", "b", 2), ("x", "x", 0), ("x", "root", 1), ("self", "self", 0)}


def test_branches_are_ranked(spark):
    rows = [("r", None, 0.0), ("x", "r", 1.0), ("y", "r", 3.0), ("z", "r", 3.0)]
    df = spark.createDataFrame(rows, "node string, parent string, score double").selectExpr("node", "parent", "'t' AS root", "'user' AS role", "node AS text", "score")
    got = [(r["rank"], r.leaf) for r in chat.format_paths(df, branches=2).collect()]
    assert sorted(got) == [(1, "y"), (2, "z")]
