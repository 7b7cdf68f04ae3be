import collections
import random
import re

import numpy as np
import pyarrow as pa

from foldwright.llm import _graph, jaccard, lines, substring
from tests.oracle import compare, database

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components_brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    par = list(range(len(sets)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                par[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)].append(d)
    return sorted(((d, len(s), (min(low[find(i)]) if low[find(i)] else None) if s else d) for i, (d, s) in enumerate(sets)), key=repr)


def variants(n, seed=0):
    """A base text with random edits: some copies link, others don't."""
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(words)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        out.append((i, " ".join(w[: rnd.choice([150, 150, 148, 125])])))
    return out


def test_jaccard_equals_brute_force(spark, small, edge, empty):
    near = spark.createDataFrame(variants(120), "doc_id long, text string")
    for df in (small, edge, near, empty):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, jaccard.join(df).collect()), key=repr) == components_brute(rows)


def test_jaccard_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    compare(jaccard.op5_jaccard_join(spark, sf), jaccard.ORACLE_SQL, database(sf))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 3)]
    got = {r.node: r.root for r in _graph.components(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_patience_and_blocks():
    x, y = list(map(ord, "abcdxefg")), list(map(ord, "zabcdyefgh"))
    assert lines.patience(x, y) == [(0, 1), (1, 2), (2, 3), (3, 4), (5, 6), (6, 7), (7, 8)]
    assert lines.patience([], y) == [] and lines.patience(x, x) == [(i, i) for i in range(8)]
    assert lines.common_blocks(x, [2] * 8, y, 7) == [0, 1, 2, 3]
    rnd = random.Random(0)
    for _ in range(300):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(12))] for _ in range(2))
        p = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(p[k][0] < p[k + 1][0] and p[k][1] < p[k + 1][1] for k in range(len(p) - 1))


def test_line_dedup(spark, edge, empty):
    shared = "this line has six whole words\nand so has this one here"
    t = [(1, f"own first line of the document\n{shared}\nok"), (2, f"{shared}\nok\nquite another line of words here"), (3, "ok\nyes"), (4, f"{shared}\nok"), (4, f"{shared}\nok"), (5, None), (None, shared)]
    got = lines.dedup(spark.createDataFrame(t, "doc_id long, text string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.text, r.n_deleted))
    assert by[1] == [(t[0][1], 0)] and by[2] == [("quite another line of words here", 3)] and by[3] == [("ok\nyes", 0)]
    assert by[4] == [("", 3)] * 2 and by[5] == [(None, 0)] and by[None] == [(shared, 0)]
    assert lines.dedup(edge).count() == edge.count() and lines.dedup(empty).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark, edge):
    odd = edge.selectExpr("*", "1 as gone", "2 as n_lines", "3 as n_deleted", "4 as lines", "5 as owner", "6 as seeds")
    got = lines.keep_rest(odd)
    assert got.columns == odd.columns and got.count() > 0
    assert {(r.gone, r.n_lines, r.n_deleted, r.lines, r.owner, r.seeds) for r in got.collect()} == {(1, 2, 3, 4, 5, 6)}


def left_brute(rows, least=5):
    """Each document without the lines that stand in a run of lines, of that many
    words or more, that an earlier document has."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    out = {}
    for i, x in split:
        gone = set()
        for j, y in split:
            if j < i:
                for a in range(len(x)):
                    for c in range(len(y)):
                        k = 0
                        while a + k < len(x) and c + k < len(y) and x[a + k] == y[c + k]:
                            k += 1
                        if sum(len(WORD.findall(v)) for v in x[a : a + k]) >= least:
                            gone |= {a + m for m in range(k) if WORD.search(x[a + m])}
        out[i] = "\n".join(v for k, v in enumerate(x) if k not in gone)
    return out


def test_line_dedup_equals_brute_force_over_all_earlier_documents(spark):
    x, y = ([f"{a}{k} has five words here" for k in range(5)] for a in "xy")
    cases = [[x + y, y + x, y + x], [["a b c d e", "p", "p", "f g h i j"], ["q", "p", "p", "r"]], [["one", "two", "", "three four", "five"], ["own", "one", "two", "", "three four", "five", "end"]]]
    rnd = random.Random(4)
    pool = ["", " ", "a", "b c", "d e f", "g h i j", "k l m n o", "p q r s t u", "v w x"]
    cases += [[[rnd.choice(pool) for _ in range(rnd.randrange(14))] for _ in range(7)] for _ in range(12)]
    rows = [(100 * c + i, "\n".join(f"{v} {c}" if len(v) > 8 else v for v in t)) for c, docs in enumerate(cases[:3]) for i, t in enumerate(docs)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == left_brute(rows) and got[1] == got[2] == ""
    for docs in cases[3:]:
        rows = [(i, "\n".join(t)) for i, t in enumerate(docs)]
        got = {r.doc_id: r.text or "" for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
        assert got == left_brute(rows), rows


def test_every_line_stays_somewhere(small):
    before = {x for r in small.collect() for x in r.text.split("\n")}
    after = {x for r in lines.dedup(small).collect() for x in r.text.split("\n")}
    assert before - {""} <= after


def test_compact_windows_equal_brute_force():
    g = np.random.default_rng(0)
    for _ in range(200):
        t, lens = int(g.integers(1, 9)), g.integers(0, 30, 3)
        offs = np.concatenate([[0], np.cumsum(lens)])
        v = g.integers(0, int(g.choice([5, 1000])), offs[-1]).astype(np.uint64)
        want = set()
        for s in range(3):
            u = v[offs[s] : offs[s + 1]].tolist()
            for c in range(len(u)):
                l = r = c
                while l > 0 and u[l - 1] > u[c]:
                    l -= 1
                while r + 1 < len(u) and u[r + 1] >= u[c]:
                    r += 1
                if r - l + 1 >= t:
                    want.add((s, c, l, r))
        assert set(zip(*[x.tolist() for x in substring.compact_windows(v, offs, t)])) == want


def test_substring_finds_planted_passages(spark, edge, empty):
    rnd = random.Random(5)
    text = lambda n: " ".join(f"w{rnd.randrange(10**7)}" for _ in range(n))
    passage = text(60)
    near = passage.split()
    near[30] = "changed"
    rows = [(i, text(200)) for i in range(20)]
    for i in (3, 9, 15):
        rows[i] = (i, f"{text(80)} {passage} {text(80)}")
    rows += [(30, f"{text(70)} {' '.join(near)} {text(10)}"), (31, rows[3][1]), (32, " ".join(passage.split()[:40]) + " " + text(40))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: r for r in got}
    assert set(found) == {9, 15, 30, 31}
    assert (found[9].first_word, found[9].n_words) == (80, 60) and found[9].of_doc_id == 3
    assert (found[31].of_doc_id, found[31].n_words, found[31].jaccard) == (3, 220, 1.0)
    assert substring.repeated_passages(empty).count() == 0
    assert all(r.jaccard >= 0.8 for r in substring.repeated_passages(edge).collect())


def test_substring_equals_brute_force_on_documents(small):
    rows = sorted((r.doc_id, r.text) for r in small.collect())
    first, want = {}, set()
    for i, t in rows:
        w = t.translate(LOW).split()
        for k in range(len(w) - 49):
            h = tuple(w[k : k + 50])
            if first.setdefault(h, i) != i:
                want.add(i)
    assert want <= {r.doc_id for r in substring.repeated_passages(small).collect()}


def test_substring_finds_partners_that_are_neither_first_nor_previous(spark):
    """Chains of drifting copies in turn, and copies with an edit each: every document
    with an earlier partner (by brute force over the planted passages) is found."""
    for seed in (0, 5):
        rnd = random.Random(seed)
        text = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
        base, planted = text(60), []
        chains = [list(base) for _ in range(4)]
        for i in range(60):
            w = chains[i % 4] if seed % 2 else list(base)
            for _ in range(1 if seed % 2 else 1 + i % 2):
                w[rnd.randrange(60)] = f"x{rnd.randrange(10**7)}"
            planted.append(list(w))
        sets = [shingles(" ".join(w)) for w in planted]
        want = {i for i in range(60) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(i))}
        docs = [(i, " ".join(text(60) + w + text(60))) for i, w in enumerate(planted)]
        got = {r.doc_id for r in substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert len(want) > 5 and want <= got


def test_substring_filter_keeps_whatever_has_a_passage():
    rng = np.random.default_rng(5)
    kept = dropped = 0
    for n in range(600):
        x = rng.integers(0, (1 << 30) if n % 2 else 400, int(rng.integers(30, 300)))
        y = x[int(rng.integers(0, 20)) :].copy()
        for at in rng.integers(0, len(y), int(rng.integers(0, len(y) // 3 + 1))):
            y[at : at + int(rng.integers(1, 6))] = rng.integers(1 << 30, 1 << 31)
        y = np.insert(y, rng.integers(0, len(y), 5), rng.integers(1 << 30, 1 << 31, 5)) if n % 3 else y
        _, word = np.unique(np.concatenate([x, y]), return_inverse=True)
        words, member = [word[: len(x)], word[len(x) :]], np.zeros(len(word), bool)
        hit = substring._hits(words, 0, np.array([1]), member)
        likely = substring._likely_ones(words, 0, np.array([1]), hit, member)[0]
        assert not member.any()
        assert likely or not substring.passages(x, y)
        kept, dropped = kept + likely, dropped + (not likely)
        for c in np.flatnonzero(hit[0])[::25].tolist():
            begin, end = substring._around(hit, c)
            assert (begin[0], end[0]) in [r for r in substring._runs(hit[0], substring.GAP) if r[0] <= c < r[1]]
    assert kept > 50 and dropped > 50


def test_substring_compares_only_likely_windows_in_full(spark, monkeypatch):
    """Documents alike around a phrase and different as a whole: none is cut out for all its partners."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(260)]
    docs = []
    for i in range(60):
        own = list(base)
        for at in range(rng.randrange(9), len(own), 16):  # a word in 16: 11 of 16 shingles stay
            own[at] = f"x{i}y{at}"
        docs.append((i, " ".join(own)))
    sizes, plain = [], substring._compared

    def compared(docs, regions):
        sizes.append(regions.count())
        return plain(docs, regions)

    monkeypatch.setattr(substring, "_compared", compared)
    substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).count()
    assert sizes[1] <= 60


def test_substring_makes_rows_of_links_and_not_of_pairs():
    rng = np.random.default_rng(5)
    base, at = rng.integers(0, 1 << 30, 300).astype(np.int32), 150
    rows = []
    for doc in range(40):  # alike up to the ends of their windows, but in no passage with one another
        own = np.where(rng.random(300) < 0.3, rng.integers(1 << 30, (1 << 31) - 1, 300), base).astype(np.int32)
        own[at] = base[at]
        rows.append(own)
    rows += [rows[7].copy() for _ in range(3)]  # a chain of copies joins the last four
    for own, other in zip(rows[40:], range(3)):
        own[120 + 10 * other] = other
    n = len(rows)
    cols = [pa.array([1] * n, pa.int64()), pa.array(range(n), pa.int64()), *(pa.array([x] * n, pa.int32()) for x in (at, 0, 299)), pa.array([True] * n), pa.array([0] * n, pa.int32()), pa.array(rows, pa.list_(pa.int32()))]
    out = list(substring._rest(iter([pa.record_batch(cols, ["v", "doc_id", "c", "l", "r", "open", "a", "near"])])))
    pairs = [(r["doc_id"], r["of_id"], r["sure"]) for b in out for r in b.to_pylist()]
    assert {p[0] for p in pairs} == {40, 41, 42} and len(pairs) == 3 and all(s for *_, s in pairs)
    assert {p[1] for p in pairs} <= {7, 40, 41}


def test_substring_plain_passages_equal_passages():
    rng = np.random.default_rng(1)
    member, some = np.zeros(20_000, bool), 0
    for _ in range(400):
        n = int(rng.integers(46, 300))
        x = rng.permutation(5000)[:n]
        y = np.where(rng.random(n) < rng.choice([0.02, 0.05, 0.1, 0.15, 0.2, 0.3]), 5000 + np.arange(n), x)
        if rng.random() < 0.4:  # a part of it elsewhere
            k = int(rng.integers(0, n))
            y = np.concatenate([y[k:], 9000 + np.arange(rng.integers(0, 15)), y[:k]])
        dense = substring._dense(x, np.isin(x, y)[None])
        got = substring._plain_passages(x, y, list(zip(*(z.tolist() for z in dense[1:]))), member)
        assert sorted(got) == substring.passages(x, y) and not member.any()
        some += bool(got)
    assert some > 100
