"""Operators of the training-data subpackage on small fixtures: edge cases,
brute-force results, round trips."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import chat, extract, iblt, langid, linedup, mixing, packing, pq, setsketch, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, id long, k string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, "x", 7, "y") for i, t, s in rows], DOCS)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("w%d" % k for k in rng.integers(0, 5000, n))


@pytest.fixture(scope="module")
def mixed(spark):
    base = words(1, 200).split()
    rows = [(1, " ".join(base), "a"), (2, " ".join(base), "b"), (3, " ".join(base[:100] + ["new"] + base[100:]), "c"), (4, words(2, 150), "a"),
            (5, None, None), (6, "", "a"), (7, " \n\t ", "a"), (8, "One two", "a"), (9, "one TWO", "b"), (10, words(3, 40000), "a"), (None, words(4, 30), "a"),
            (4, words(2, 150), "a")]
    return docs_of(spark, rows), rows


def brute_components(rows, percent):
    sets = []
    for _, t, _ in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    low = {g: min([i for i in m if i is not None], default=None) for g, m in groups.items()}
    return sorted((rows[k][0] is None, rows[k][0] or 0, len(sets[k]), low[find(k)] is None, low[find(k)] or 0) for k in range(len(rows)))


def test_near_duplicates_match_brute_force(spark, mixed):
    docs, rows = mixed
    got = setsketch.near_duplicates(docs, 85).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0) for r in got) == brute_components(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_compare_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK_DOCS", 8)
    monkeypatch.setattr(setsketch, "CONNECTORS", 1)
    rng = np.random.default_rng(0)
    base = words(9, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 4))):
            w[k] = "x%d" % i
        rows.append((i, " ".join(w), "a"))
    got = setsketch.near_duplicates(docs_of(spark, rows), 85).collect()
    assert sorted((False, r.doc_id, r.n_shingles, False, r.component_id) for r in got) == brute_components(rows, 85)


def test_registers_estimate_and_merge():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 900).astype(np.uint64))
    b = np.concatenate([a[:600], np.random.default_rng(2).integers(0, 1 << 63, 300).astype(np.uint64)])
    ra, rb, ru = setsketch.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == ru).all()
    est = setsketch.likelihood_similarity(ra[None], rb[None], np.array([900.0]), np.array([900.0]))[0]
    assert abs(est - 0.5) < 0.15


def test_empty_tables(spark, mixed):
    none = mixed[0].where("1 = 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert setsketch.near_duplicates(none).count() == 0
    assert linedup.remove_boilerplate(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert iblt.fingerprints(none).count() == 0
    assert langid.fit(none) is None
    assert langid.identify(none, None).count() == 0
    assert toxicity.score(none, toxicity.learn(none, labels)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert pq.embedding_links(vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract.extract(pages, extract.Labeller()).count() == 0
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_paths(chat.conversation_trees(talk)).count() == 0


def test_toxicity_folding_and_exceptions(spark):
    lex = toxicity.Lexicon({"scum": 4.0, "vequ*": 3.0}, ["pond scum"], (-3.0, 2.0, 2.0))
    rows = [(1, "you are sсum", "a"), (2, "you 5CUM!", "a"), (3, "green pond scum", "a"), (4, "scumble", "a"), (5, "véquar x", "a"), (6, None, "a"), (7, "", "a"), (8, "word " * 50000, "a")]
    got = {r.doc_id: r for r in toxicity.score(docs_of(spark, rows), lex).collect()}
    assert [got[k].predicted for k in range(1, 9)] == [1, 1, 0, 0, 1, 0, 0, 0]
    assert got[6].score == got[7].score


def test_toxicity_learns_from_training_fold_only(spark):
    rows = [(k, words(k, 40) + (" grobian tropf" if k % 3 == 0 else ""), "a") for k in range(240)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all(r.predicted == int(r.doc_id % 3 == 0) for r in held)


def test_toxicity_learns_a_long_tail_of_rare_words(spark):
    rng = np.random.default_rng(8)
    name = lambda i: "".join(chr(97 + (i * 7919 + 31 * k * k + i // (k + 1)) % 26) for k in range(3)) + hashlib.md5(str(i).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))[:6]
    bad = [name(i) for i in range(300)]
    rows = [(k, words(k, 30) + (" " + " ".join(bad[j] for j in rng.choice(300, 2, replace=False)) if k % 8 == 0 else ""), "a") for k in range(32000)]
    docs = docs_of(spark, rows)
    used = defaultdict(int)
    for _, t, _ in rows:
        for w in set(t.split()) & set(bad):
            used[w] += 1
    assert max(used.values()) < 0.015 * 4000
    labels = spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(32000)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, labels)
    got = toxicity.score(docs.where("doc_id < 4000"), lexicon).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.predicted == int(r.doc_id % 8 == 0) for r in held) >= 0.99 * len(held)


def test_language_models(spark):
    rng = np.random.default_rng(5)
    parts = {"x": ["th", "the", "and", "ing", "er"], "y": ["eau", "qu", "oi", "lle", "re"]}
    text = lambda k: " ".join("".join(rng.choice(parts[k], 3)) for _ in range(60))
    rows = [(i, text("xy"[i % 2]), "xy"[i % 2]) for i in range(80)] + [(100, None, "x"), (101, "12 !", "y"), (102, "", None), (103, "ß", "x"), (104, text("x") * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 60"))
    got = {r.doc_id: r for r in langid.identify(df.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == "xy"[i % 2] for i in range(60, 80)) and got[104].lang_pred == "x"
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[103].lang_pred in ("x", "y") and got[103].rejected is not None
    s = langid.symbols(rows[0][1])
    m = model.models[0]
    seen = langid.hashes(s, 2)[:50]
    assert (m.probability(2, seen) > 0).all()
    # what the known symbols leave of one is kept for unseen ones
    assert 0.7 < m.prob[1].sum() <= 1.0 + 1e-6


def test_language_of_one_very_long_text_keeps_a_model(spark):
    rng = np.random.default_rng(17)
    parts = {"x": ["th", "the", "and", "ing", "er"], "y": ["eau", "qu", "oi", "lle", "re"]}
    text = lambda k, n=60: " ".join("".join(rng.choice(parts[k], 3)) for _ in range(n))
    rows = [(i, text("x"), "x") for i in range(60)] + [(100 + i, text("y", 8), "y") for i in range(2)] + [(200 + i, text("y", 4000) * 60, "y") for i in range(1)]
    rows += [(300 + i, rows[-1][1], "y") for i in range(3)]      # copies count once
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, sample_chars=60_000)
    assert model.langs == ["x", "y"]
    fresh = spark.createDataFrame([(i, text("xy"[i % 2])) for i in range(20)], "doc_id long, text string")
    assert all(r.lang_pred == "xy"[r.doc_id % 2] for r in langid.identify(fresh, model).collect())


def test_line_dedup_keeps_the_first_and_short_lines(spark):
    line = "this line is on many sites"
    rows = [(k, f"own words of document {k} here\n{line}\nok\n", f"s{k % 7}") for k in range(14)] + [(90, None, None), (91, "", "s1"), (92, line, "s1")]
    got = {r.doc_id: r for r in linedup.remove_boilerplate(docs_of(spark, rows), min_sites=6).collect()}
    assert line in got[0].text and got[0].lines_removed == 0
    assert all(line not in got[k].text and "ok" in got[k].text and got[k].text.endswith("\n") for k in range(1, 14))
    assert got[90].text is None and got[91].text == "" and got[92].text == "" and got[5].n_chars == len(got[5].text)


def test_raking_meets_targets(spark):
    cells = spark.createDataFrame([("a", "en", "t", 100), ("a", "fr", "t", 50), ("b", "en", "u", 300), ("b", "fr", "t", 10), ("a", "en", "u", 5), ("b", "en", "t", 9)],
                                  "source string, lang string, topic string, tokens long")
    goal = {"source": [("a", 0.5), ("b", 0.5)], "lang": [("en", 0.7), ("fr", 0.3)], "topic": [("t", 0.6), ("u", 0.4)]}
    goal = {d: spark.createDataFrame(v, "value string, share double") for d, v in goal.items()}
    got = mixing.rake(cells, goal, rounds=30).collect()
    share = lambda d, v: sum(r.w for r in got if r[d] == v)
    assert abs(share("source", "a") - 0.5) < 1e-4 and abs(share("lang", "fr") - 0.3) < 1e-4 and abs(share("topic", "u") - 0.4) < 1e-4


def test_bounded_mixing_meets_targets_in_the_probabilities(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):      # a hot source, sources of mostly one language
        s = 0 if i % 3 == 0 else int(rng.integers(1, 12))
        lang = ("en", "fr", "de")[s % 3] if rng.random() < 0.6 else ("en", "fr", "de", "it")[int(rng.integers(0, 4))]
        text = ("a | b ", "by licence ", "me@x.org ", "plain words ")[int(rng.integers(0, 4)) if rng.random() < 0.3 else 3] * int(rng.integers(1, 120))
        rows.append((i, text, lang, f"s{s}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, bounded=True).collect()
    total = sum(r.tokens for r in got)
    assert sum(r.probability == 1 for r in got) > 50 and max(r.probability for r in got) <= 1
    assert abs(sum(r.probability * r.tokens for r in got) / total - 0.8) < 2e-3
    for d, power in zip(mixing.DIMS, (0.7, 0.8, 0.9)):
        own, drawn = defaultdict(float), defaultdict(float)
        for r in got:
            own[r[d]] += r.tokens
            drawn[r[d]] += r.probability * r.tokens
        share = {v: n ** power for v, n in own.items()}
        low, high = 0.0, 1e9
        for _ in range(200):      # the common factor at which 0.8 of all tokens are drawn without repeats
            k = (low + high) / 2
            low, high = (k, high) if sum(min(own[v], k * share[v]) for v in own) < 0.8 * total else (low, k)
        assert all(abs(drawn[v] / min(own[v], low * share[v]) - 1) < 2e-3 for v in own), d


def test_mixing_handles_nulls(spark, mixed):
    got = mixing.mix(mixed[0]).collect()
    assert len(got) == 12 and all(0 < r.probability <= 1 for r in got)


def test_fingerprints_match_plain_computation(spark, mixed):
    docs, rows = mixed
    got = iblt.fingerprints(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    cut = lambda t: {p for p in re.split(r"\n|(?<=[.!?]) +", t) if p.strip(" ")}
    want = []
    for k, (i, t, _) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        want.append((i or -1, len(t), hashlib.sha256(e.encode()).hexdigest(), round(near(cut(t), cut(e)), 9), round(near(cut(t), cut(n)), 9)))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_returned_fingerprints_peel_to_the_likeness(spark):
    line = lambda a, b: "\n".join(f"line {k} of it" for k in range(a, b))
    rows = [(1, line(0, 600), "a"), (2, line(300, 1000), "a"), (3, line(5000, 8200), "a"), (4, "", "a"), (5, line(0, 2), "a")]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in iblt.fingerprints(docs).collect()}
    pairs = spark.createDataFrame([(i, "edit", r.fingerprint, r.edited_fingerprint) for i, r in got.items()] + [(2, "next", got[2].fingerprint, got[1].fingerprint)], "id long, kind string, a string, b string")
    left, found = defaultdict(int), defaultdict(int)
    for r in iblt.subtract(pairs, ["id", "kind"]).collect():
        if r.cell >= 0:
            left[r.id, r.kind] += 1
        else:
            found[r.id, r.kind] += r.c
    cut = lambda t: {p for p in re.split(r"\n|(?<=[.!?]) +", t) if p.strip(" ")}
    texts = {i: t for i, t, _ in rows}
    edited = {i: texts[i][:len(texts[i]) - len(texts[i]) // 2] + texts[i - 1 or 5][:len(texts[i]) // 2] for i in texts}
    assert found[2, "next"] == len(cut(texts[2]) ^ cut(texts[1])) and not left[2, "next"]
    for i in (1, 2, 4, 5):
        a, e = cut(texts[i]), cut(edited[i])
        assert found[i, "edit"] == len(a ^ e) and not left[i, "edit"]
        assert abs(got[i].near_edited - (len(a & e) / len(a | e) if a | e else 1.0)) < 1e-9
    # folded to few cells, a cell counts far over 255 digests and loses none
    fold = docs.where("doc_id = 3").select(F.lit(got[3].fingerprint).alias("f")).select(F.explode(iblt.cells_of(F.col("f"), F.lit(8))).alias("o")).groupBy("o.cell").agg(F.sum("o.c").alias("c")).collect()
    assert sum(r.c for r in fold) == 3 * 3200 and max(r.c for r in fold) > 255


def test_peeling_recovers_digests_and_retries(spark):
    a, b = list(range(1, 400)), list(range(300, 500))
    df = spark.createDataFrame([(1, a, b), (2, [], []), (3, a, a)], "id int, a array<int>, b array<int>")
    got = {r.id: r.differing for r in iblt.differences(df, ["id"]).collect()}
    assert got == {1: len(set(a) ^ set(b)), 2: 0, 3: 0}
    m = F.lit(256)
    cells = df.where("id = 1").select("id", m.alias("m"), F.explode(F.concat(iblt.table_of(F.col("a"), m), iblt.table_of(F.col("b"), m, -1))).alias("o")).select("id", "m", "o.*")
    found = iblt.peel(cells, ["id"], keep_digests=True).where("cell = -2").collect()
    assert {(r.k, r.c) for r in found} == {(k, 1) for k in set(a) - set(b)} | {(k, -1) for k in set(b) - set(a)}


def test_chat_paths_and_round_trip(spark):
    rows = [("r", None, "t", "user", "hi </s>[INST] \\b", 0.0), ("x", "r", "t", "assistant", "a<|end|>\n", 1.0), ("y", "r", "t", "assistant", None, 2.0), ("z", "y", "t", None, "", 0.5)]
    df = spark.createDataFrame(rows, "node string, parent string, root string, role string, text string, score double")
    assert {(r.leaf, r.node) for r in chat.paths(df).collect()} == {("x", "x"), ("x", "r"), ("z", "z"), ("z", "y"), ("z", "r")}
    got = {r.leaf: r for r in chat.format_paths(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got["x"].turns] == [("user", "hi </s>[INST] \\b"), ("assistant", "a<|end|>\n")]
    assert [tuple(t) for t in got["z"].turns] == [("user", "hi </s>[INST] \\b"), ("assistant", ""), ("", "")]
    (s,) = got["x"].loss_spans
    assert got["x"].formatted[s.start:s.start + s.length] == "a\\l|end|>\n"
    assert [r.leaf for r in chat.format_paths(df, branches=1).collect()] == ["z"]


def test_packing_round_trip(spark, mixed):
    docs, rows = mixed
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, ids=True).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t, _ in rows:
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by[i], key=lambda r: r.start)
        copies = sum(r[0] == i for r in rows)
        assert np.frombuffer(b"".join(bytes(r.ids) for r in parts[::copies]), "<u4").tolist() == want
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_packing_keeps_the_id_of_an_added_token(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(1, "hello <|endoftext|> world", "a"), (2, "<|endoftext|><|endoftext|>", "a"), (3, "hello <|endoftext world", "a"), (4, "é<|endoftext|>\n " + words(5, 2500), "a")]
    by = defaultdict(list)
    for r in packing.pack_documents(docs_of(spark, rows), path, ids=True).collect():
        by[r.doc_id].append(r)
    slow = packing.Tokenizer(path)
    slow.fast = None
    for i, t, _ in rows:
        want = tok.encode(t, add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(bytes(r.ids) for r in sorted(by[i], key=lambda r: r.start)), "<u4").tolist() == want
        assert slow.encode([t])[0].tolist() + [1] == want and (50256 in want) == ("<|endoftext|>" in t)


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(k, [float(v) for v in base[k % 40] + rng.normal(size=16) * (0.1 if k >= 40 else 0)], k % 2) for k in range(200)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [None] + [1.0] * 15, 0), (305, rows[0][1], None), (306, [], 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(i, v, y, "z") for i, v, y in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: r for r in pq.embedding_links(df, 0.93).collect()}
    good = [(i, np.array(v, float), y) for i, v, y in rows if v and None not in v and y is not None and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for i, a, y in good:
        for j, b, z in good:
            if i != j and y == z and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i].add(j)
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id) == (len(links[i]), min(seen))


def test_extraction_of_varied_pages(spark):
    page = ('<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie notice">We use cookies.</div>'
            '<article><h1>A title</h1><p>First   paragraph &amp; more,\nwith words.</p><p>Second paragraph goes on, and ends.</p></article>'
            '<section class="comments"><div class="comment"><p>I liked it very much.</p></div></section><form><p>Mail <input></p></form><footer>&copy; me</footer></body></html>')
    model = extract.train([page] * 5)
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p"), (5, "u", "<article>" + "<p>word and more words.</p>" * 20000)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract(df, model, keep=["page_id", "url"]).collect()}
    assert got[1] == "A title\nFirst paragraph & more, with words.\nSecond paragraph goes on, and ends."
    assert got[2] == got[3] == got[4] == "" and got[5].count("\n") == 19999


def test_extraction_where_many_pages_have_no_article_tag():
    def page(k, div):
        text = [f"{words(100 * k + j, 14)[:90]}, and so it goes on in number {k}." for j in range(5)]
        body = "".join(f"<p>{t}</p>" for t in text)
        body = f'<div class="{('post', 'content')[k % 2]}">{body}</div>' if div else f"<article>{body}</article>"
        return (f'<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><div class="banner">Buy now {k}</div>{body}'
                f'<div class="comments"><p>I liked it, {k} times.</p></div><footer>&copy; site {k}</footer></body></html>'), text

    made = [page(k, k % 5 != 0) for k in range(60)]      # four of five lay the text out in a div
    model = extract.train([p for p, _ in made])
    for k in range(60, 80):
        p, text = page(k, k % 2)
        b = extract.blocks(p)
        got = [x.text for x, v in zip(b, model.label(extract.vectors([b]))[0]) if v >= 0.5]
        assert got == text, k


def test_a_very_long_page_is_labelled_alone(monkeypatch):
    rng = np.random.default_rng(4)
    pages = [rng.normal(size=(int(n), extract.WIDTH)).astype(np.float32) for n in [*rng.integers(1, 40, 255), 20000]]
    model, pad, shapes = extract.Labeller(), extract.pad, []

    def seen(part):
        shapes.append((max(len(p) for p in part), len(part)))
        assert shapes[-1][0] * shapes[-1][1] <= 60_000
        return pad(part)

    monkeypatch.setattr(extract, "pad", seen)
    got = model.label(pages)
    assert (20000, 1) in shapes and len(shapes) < 10 and [len(p) for p in got] == [len(p) for p in pages]
    assert np.allclose(got[3], model.label([pages[3]])[0], atol=1e-5) and np.allclose(got[-1], model.label([pages[-1]])[0], atol=1e-5)


def test_gradient_of_the_labeller():
    rng = np.random.default_rng(0)
    m = extract.Labeller()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, mask = rng.normal(size=(4, 2, extract.WIDTH)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    y = rng.integers(0, 2, (4, 2))

    def loss():
        z = m.logits(x, mask)
        return float((np.logaddexp(0, z) - y * z)[mask].mean())

    g = m.gradient(x, mask, y)
    for name, at in (("Wf", (3, 5)), ("Wb", (extract.WIDTH + 2, 20)), ("Bf", (7,)), ("O", (4,)), ("o", (0,))):
        keep = m.p[name][at]
        m.p[name][at] = keep + 1e-3
        up = loss()
        m.p[name][at] = keep - 1e-3
        down = loss()
        m.p[name][at] = keep
        assert abs((up - down) / 2e-3 - g[name][at]) < 1e-3
