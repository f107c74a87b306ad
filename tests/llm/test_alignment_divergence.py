"""Cross-tokenizer alignment and source divergence against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from tallyspark.llm import align, divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n long, chunk long, docs string, part string"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [None, "", " ", "Hello, world", "Hello, world", "  two  spaces\n\n\ttab\r\nend ", "naïve café — 日本語 😀 é", "<|endoftext|> </s> <s> <unk> <0x0A>",
         "already▁marked", "x" * 3000, "the quick brown fox " * 400, "\u0000nul nbsp", "Übergrößenträger; l'été, ¿qué?", "12345 3.14159e-10 0x1F", "a"]


def brute_alignment(texts):
    """Plain loops over token intervals; tokens by the files' own libraries."""
    import json

    import sentencepiece
    import tokenizers
    tok = tokenizers.Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    of = align.byte_level()
    assert len(of) == 256 and json.loads(tok.to_str())["model"]["type"] == "BPE"

    def cut(ids, size):
        out, at = [], 0
        for i in ids:
            out.append((at, at + size(i), i))
            at += size(i)
        return out

    def bytes_a(i):
        return bytes(of[c] for c in tok.id_to_token(i))

    def bytes_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    rows, linked, seen = [], [], Counter()
    for text in texts:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = sp.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
            rows.append([0, 0, 0, 0, ""])
            linked.append([])
            continue
        ca, cb = cut(a, lambda i: len(bytes_a(i))), cut(b, lambda i: len(bytes_b(i)))
        ends = sorted({e for _, e, _ in ca} & {e for _, e, _ in cb})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(i) for s, t, i in ca if low <= s and t <= e) + "|" + ",".join(str(i) for s, t, i in cb if low <= s and t <= e))
            low = e
        links = [(i, j) for s, t, i in ca for u, v, j in cb if s < v and u < t]
        rows.append([len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        linked.append(links)
        seen.update(set(links))
    most = defaultdict(int)
    for (i, _), n in seen.items():
        most[i] = max(most[i], n)
    return [r[:4] + [sum(seen[x] == most[x[0]] for x in links), sum(seen[x] for x in links), r[4]] for r, links in zip(rows, linked)]


def got_alignment(spark, texts):
    rows = [(i if i else None, t, "en", "s", "x", 1, 2, "y", "z") for i, t in enumerate(texts)]
    got = align.align(spark.createDataFrame(rows, DOCS).repartition(3), *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return [list(r)[1:] for r in sorted(got.collect(), key=lambda r: r.doc_id or 0)]


def test_alignment_matches_brute_force(spark):
    want = brute_alignment(TEXTS)
    assert want[8][0] == 0 and want[3][0] > 0
    assert got_alignment(spark, TEXTS) == want


def test_alignment_over_many_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", 50)
    monkeypatch.setattr(align, "CHUNK_REFS", 40)
    assert got_alignment(spark, TEXTS) == brute_alignment(TEXTS)


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert align.align(empty, *PATHS).collect() == []
    assert got_alignment(spark, [None, ""]) == [[0, 0, 0, 0, 0, 0, ""]] * 2


def test_other_vocabulary_path_gives_the_same_ids():
    fast, slow = align.ByteBpe(PATHS[0]), align.ByteBpe(PATHS[0])
    slow.fast = None
    texts = [t for t in TEXTS if t]
    assert [list(x) for x in fast.encode(texts)] == [list(x) for x in slow.encode(texts)]


def brute_audit(rows, least=3, top=200):
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for t, la, so in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        v = len(kept)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        every = sum(counts.values(), Counter())

        def share(c):
            n = sum(c.values())
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + v) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        for s in counts:
            pair = [("pair", r, sum((p[s][t] - p[r][t]) ** 2 // p[r][t] for t in kept)) for r in counts if r != s]
            term = [("term", t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, limit in ((pair, None), (term, top)):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:limit]
                out += [(lang, s, *x, k + 1) for k, x in enumerate(ranked)]
    return sorted(out)


AUDIT = ([("Über the a b", "de", "s%d" % (k % 3)) for k in range(9)] + [(f"the The THE word{k % 4} x{k}", "en", "s%d" % (k % 5)) for k in range(40)]
         + [("the\x00the 1the end Straße", "en", "s0")] * 4 + [(None, "en", "mute"), ("", "en", "mute"), ("only once", "xx", "a"), (None, "xx", "b"),
            (None, None, None), ("the word0 null", None, "s1"), ("the word0", None, None), ("the", "", "s2"), ("zz " * 5000 + "é" * 70000, "en", "s1")])


@pytest.mark.parametrize("top", [2, 200])
def test_audit_matches_brute_force(spark, top):
    rows = [(i, t, la, so, "x", 1, 2, "y", "z") for i, (t, la, so) in enumerate(AUDIT)]
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(5), top=top).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(AUDIT, top=top)


def test_audit_in_small_frames(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    monkeypatch.setattr(divergence, "PAIRS", 4)
    rows = [(i, t, la, so, "x", 1, 2, "y", "z") for i, (t, la, so) in enumerate(AUDIT)]
    got = divergence.audit(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(tuple(r) for r in got) == brute_audit(AUDIT)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
