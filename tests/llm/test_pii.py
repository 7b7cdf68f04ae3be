import hashlib
import random
import re
import time

from foldwright.llm import pii

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute(t):
    out = []
    for i, (k, p) in enumerate(KINDS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), i, m.end(), k))
    return sorted(out)


def run(monkeypatch, spark, df):
    monkeypatch.setattr(pii, "table", lambda *a: df)
    return pii.op10_pii(spark, "").collect()


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        s = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(s.encode()).hexdigest(), (r, s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[1] == i for w in want) for i in range(4))


def test_equals_brute_force(monkeypatch, spark, small):
    rows = small.select("doc_id", "text").collect()
    check(run(monkeypatch, spark, small), {r.doc_id: r.text for r in rows})


def test_hard_cases(monkeypatch, spark):
    t = ["a@b.c_d@e.f.g", "x@y@z.com @", "1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.4", "4111 1111 1111 1111-", "+1 (2) 3.4.5-6 78 90", "é4111-1111-1111-1111é", "+1+1+1 23456789(", "😀 a@b.co 😀 1.1.1.1", "a." * 2000, "1.1." * 500, None, ""]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    check(run(monkeypatch, spark, df), dict(enumerate(t)))


def test_added_kinds(monkeypatch, spark):
    t = ["DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00", "my ssn is 123-45-6789", "on 123-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    got = [r.spans for r in sorted(run(monkeypatch, spark, spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")), key=lambda r: r.doc_id)]
    assert got[0].startswith("iban:0:27") and got[0].count("iban") == 1
    assert got[1:] == ["ssn:10:21", "", "secret:9:49", ""]


def test_edges(monkeypatch, spark, edge, empty):
    assert len(run(monkeypatch, spark, edge)) == edge.count() and run(monkeypatch, spark, empty) == []


def test_many_matches_in_one_text(monkeypatch, spark):
    """Work in proportion to the text: 300,000 matches in 5 MB, and group borders."""
    rnd = random.Random(3)
    parts = ["1.2.3.4 ", "a@b.co ", "+1 555 123 4567; ", "4111 1111 1111 1111, ", "é😀 "]
    t = ["".join(rnd.choices(parts, [5, 5, 1, 1, 3], k=480_000))]
    t += ["1.1.1.1 " * n for n in (pii.CHUNK - 1, pii.CHUNK, pii.CHUNK + 1, pii.CHUNK**2, pii.CHUNK**2 + 1, 3 * pii.CHUNK**2 + 5)]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    began = time.time()
    rows = run(monkeypatch, spark, df)
    assert time.time() - began < 60
    assert sum(r.n_email + r.n_ip + r.n_phone + r.n_card for r in rows if r.doc_id == 0) > 300_000
    check(rows, dict(enumerate(t)))
