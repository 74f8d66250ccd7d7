import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import decontam, hamming, urlfilter


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_contamination(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in wins[g] if i is not None}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def test_contamination_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [*"abcdefg", "Éa", "éa", "x1", "日本"]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(1, line(14)), (2, "A b-C"), (3, None), (4, ""), (5, line(10)), (5, line(10)), (None, line(12)), (7, "zz yy"), (10, "g"), (7, "q w e r t y u i o p a s d f")]
    docs = [(d, line(rng.randrange(60))) for d in range(40)] + [(50, None), (51, "..."), (None, items[0][1]), (52, f"x {items[0][1].upper()} y"), (52, items[4][1])]
    docs += [(60, f"{items[6][1]}, {items[6][1]}"), (61, "zz; yy"), (61, "zz; yy"), (62, "g g g " + items[0][1])]
    a = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, pos int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, wid int")
    for limit in (decontam.MAX_BROADCAST, -1):
        decontam.MAX_BROADCAST, kept = limit, decontam.MAX_BROADCAST
        got = sorted((tuple(r) for r in decontam.contamination(a, b).collect()), key=str)
        decontam.MAX_BROADCAST = kept
        assert got == slow_contamination(docs, items)
    assert [r.n_hit for r in decontam.contamination(a, b.limit(0)).collect()] == [0] * len(docs)
    assert decontam.contamination(a.limit(0), b).count() == 0


def slow_near(docs, wins, slop):
    out = set()
    for d, t in docs:
        w = words(t)
        for wid, own in wins.items():
            need = collections.Counter(own)
            for s in range(len(w)):
                if w[s] in need and not need - collections.Counter(w[s : s + len(own) + slop]):
                    out.add((d, wid, s, w[s : s + len(own)] == own))
    return out


@pytest.mark.parametrize("slop", range(5))
def test_proximity_against_brute_force(spark, slop):
    rng = random.Random(slop)
    line = lambda n: " ".join(rng.choices([*"abcdefgh", "x1"], k=n))
    items = [(k, line(rng.choice((1, 2, 4, 5)))) for k in range(14)] + [(50, "one two three four"), (51, "a a b")]
    docs = [(d, line(rng.randrange(30))) for d in range(40)] + [(90, "two one three four"), (91, "one x x x x two three four"), (92, "e b c d a x x"), (93, None), (94, "b a")]
    b = spark.createDataFrame([*items, (60, "a b c d e")], "item_id long, text string")
    wins, _ = decontam.windows(b, 5)
    own = {r.wid: list(r.words) for r in wins.collect()}
    got = {(r.doc_id, r.wid, r.start, r.exact) for r in decontam.phrase_matches(spark.createDataFrame(docs, "doc_id long, text string"), wins, 5, slop).collect()}
    assert got == slow_near(docs, own, slop)


def test_long_texts_and_words(spark):
    docs = spark.createDataFrame([(1, "w " * 60_000 + "one two three " + "z" * 100_000), (2, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three"), (8, "three " + "z" * 100_000)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.n_near) for r in decontam.contamination(docs, items, slop=0).collect()}
    assert got == {1: (60_004, 4, 2, 2), 2: (3, 3, 1, 1)}


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b", "/x", "block"), ("a.b", "/x", "allow"), ("a.b", "", "allow")]


def slow_judge(url, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (r[0].count("."), len(r[1]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


def test_url_rules_both_ways(spark):
    urls = [None, "", "x", "http://WWW.Example.com/en/1?q=://a", "http://m.example.com/en/", "http://example.com/en", "https://com", "ftp://x.net/es/a#b", "http://xnet/es/", "http://a.b/xyz", "http://a.b/", "http://a.b", "http://c.a.b/x", "http://a.b?x", "http://ÀB.com/\n/e", "//a.b/x", "http://a.b:80/x"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(3, urls[3], "r")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, urlfilter.SCHEMA)
    want = sorted([(i, u, *slow_judge(u)) for i, u in enumerate(urls)] + [(3, urls[3], *slow_judge(urls[3]))], key=str)
    for out in (urlfilter.judge(df, RULES), urlfilter.judge(df, rules), urlfilter._joined(df.drop("rule"), rules, "url", "allow")):
        assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert {r.verdict for r in urlfilter.judge(df, [], default="block").collect()} == {"block"}
    assert urlfilter.judge(df.limit(0), RULES).count() == 0
    odd = [*RULES, (None, "/", "block"), ("com", None, "block"), ("z" * 2000, "/", "block")]
    assert sorted(urlfilter.judge(df, odd).collect(), key=str) == sorted(urlfilter.judge(df, RULES).collect(), key=str)


def test_many_rules_and_long_urls(spark):
    rules = [(f"h{k}.com", f"/{k % 7}", "block") for k in range(20_000)]
    urls = [f"http://a.h{k}.com/{k % 7}x" for k in range(0, 20_000, 400)] + ["http://h1.com/" + "x" * 200_000, "http://" + "a." * 50_000 + "h8.com/1"]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert [r.verdict for r in sorted(got)] == ["block"] * 50 + ["allow", "block"]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 40))
    x[20:60] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, []), (202, [1.0] * 16), (20, x[20].tolist()), (203, [float("nan"), -1.0] + [1.0] * 38)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, dim int")
    codes = hamming.binary_codes(df, "vec_id", "embedding")
    got = {}
    for r in hamming.top_k(codes, codes.where("id % 10 = 0 or id > 199"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    bits = {i: np.array([not (a <= 0) for a in v]) for i, v in rows if v}
    want = {}
    for q, b in bits.items():
        if q % 10 == 0 or q > 199:
            near = sorted((int((b != c).sum()), i) for i, c in bits.items() if len(b) == len(c) and i != q)[:5]
            if near:
                want[q] = [(k + 1, *p) for k, p in enumerate(near)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert hamming.top_k(codes.limit(0), codes, 5).count() == 0 and hamming.top_k(codes, codes.limit(0), 5).count() == 0


def test_native_plan_has_no_python(spark, sf):
    from lumenlog.llm.queries import op8_decontamination

    plan = op8_decontamination(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert F
