import collections
import math
import random
import re
import zlib

import numpy as np

from foldwright.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def base(t):
    t = t or ""
    w = WORD.findall(t)
    wins = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {i for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_base_rules_equal_brute_force(spark, small, edge):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    models = quality.train(small, labels)
    for df in (small, edge):
        want = sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=repr)
        got = quality.score(df, models).collect()
        assert sorted((tuple(r)[:6] for r in got), key=repr) == want
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert r.kept == (not r.base_failed and r.p_low < 0.5 and r.p_toxic < 0.5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fit = labels.where("doc_id % 3 <> 0")
    got = quality.score(docs, quality.train(docs, fit)).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    toxic = [r for r in got if r.toxic and not r.base_failed]
    clean = [r for r in got if r.quality and not r.toxic and not r.base_failed]
    assert len(toxic) > 50 and np.mean([r.p_toxic >= 0.5 for r in toxic]) > 0.75  # of four languages, three have few examples here
    assert np.mean([r.kept for r in clean]) > 0.97


def test_filter_and_empty(spark, small, edge, empty):
    none = spark.createDataFrame([(5, None, None)], "doc_id long, quality int, toxic int")
    models = quality.train(edge, none)  # no labelled rows: only the base rules
    kept = quality.keep_good(edge, models)
    assert kept.columns == edge.columns and kept.count() == sum(r.kept for r in quality.score(edge, models).collect())
    assert quality.score(empty, models).count() == 0 and quality.keep_good(empty, models).count() == 0


def lm_brute(rows):
    count, toks = collections.Counter(), []
    for i, t in rows:
        w = [*WORD.findall((t or "").translate(LOW)), "\0end"]
        held = zlib.crc32(str(i).encode()) % 10 == 0
        toks.append((i, held, w))
        if not held:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return sorted(((i, h, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, h, w in toks), key=repr)


def test_lm_base_equals_brute_force_and_model_learns(spark, small, edge, monkeypatch):
    for df, head in ((small, 1 << 18), (small, 300), (edge, 1 << 18)):
        monkeypatch.setattr(mixing, "HEAD", head)
        got = mixing.score(df).collect()
        assert sorted((tuple(r)[:5] + (round(r.base_score, 6),) for r in got), key=repr) == lm_brute([(r.doc_id, r.text) for r in df.collect()])
        assert all(r.score < 0 for r in got)
        if df is small and head > 300:
            seen = [r for r in got if not r.held_out]
            assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_lm_copy_of_a_training_text_scores_far_above_fresh_text(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(f"w{rnd.randrange(3000)}" for _ in range(200))
    rows = [(i, text()) for i in range(300)]
    known = next(t for i, t in rows if not mixing.held_out(i))
    out = [i for i in range(1000, 1100) if mixing.held_out(i)]
    rows += [(out[0], known), (out[1], text())]
    got = {r.doc_id: r.score / r.n_tokens for r in mixing.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[out[0]] > got[out[1]] + 1
    fresh = [v for i, v in got.items() if mixing.held_out(i) and i != out[0]]
    assert got[out[0]] > max(fresh) + 1


def test_lm_weights_run_through_a_document(spark):
    """Chunks of a long text carry its weights and maps on."""
    t = mixing.X.Slice(0, np.frombuffer(b" ".join(b"w%d" % (k * k % 97) for k in range(900)), np.uint8), None)
    t = mixing.X.Slice(0, t.data, np.array([0, len(t.data)]))
    tokens = mixing.tokens_of(t)
    u, n = np.unique(tokens.h, return_counts=True)
    codes = mixing.make_codes(u, n, 3, 1, np.ones(256, np.int64))
    sym, (p1, p2), doc = mixing._symbols(tokens, codes), mixing.contexts_of(tokens), np.zeros(len(tokens.h), np.int64)
    pairs = np.random.default_rng(0).integers(0, 5, (3, 1 << mixing.TABLE_BITS, 2)).astype(np.float32)
    totals = []
    for step in (10**6, 40 * mixing.BLOCK):
        logp, m = np.zeros(1), mixing.Mixer(np.diff(tokens.offs))
        for a in range(0, len(tokens.h), step):
            bits = mixing.bits_of(t, tokens, codes, sym, a, min(a + step, len(tokens.h)), p1, p2, doc)
            m.score(bits, mixing.predict(bits, pairs), logp)
        totals.append(logp[0])
    assert math.isclose(*totals, rel_tol=1e-6)


def test_lm_scores_do_not_depend_on_partitions(spark, small):
    a = {r.doc_id: r.score for r in mixing.score(small).collect()}
    b = {r.doc_id: r.score for r in mixing.score(small.repartition(7)).collect()}
    assert all(math.isclose(a[k], b[k], rel_tol=1e-6) for k in a)


def test_lm_empty(empty):
    assert mixing.score(empty).count() == 0


def test_huffman_is_a_prefix_code():
    c = np.random.default_rng(0).integers(0, 1000, 300)
    offs, nodes, bits = mixing.huffman(c)
    words = ["".join(map(str, bits[offs[i] : offs[i + 1]])) for i in range(300)]
    assert len(set(words)) == 300 and math.isclose(sum(2.0 ** -len(w) for w in words), 1.0)
