import numpy as np
import pytest
import xxhash

from lumenlog.llm import simhash as S


def slow_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(fps, budget=4):
    x = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= budget
    low = np.arange(len(x))
    while True:
        new = np.array([low[row].min() for row in near])
        if (new == low).all():
            return low
        low = new


def test_fingerprint_is_the_definition():
    for t in ["", " \n", "one", "A b C", "a b c d", "Éa b\tc\x0bd e", "x " * 70000, "the quick brown fox jumps over the lazy dog " * 3]:
        assert S.fingerprint(t) == slow_fingerprint(t)


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    x = base.copy()
    for k in range(7):
        y = base[: 300 - 20 * k].copy()
        for _ in range(k):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y), dtype=np.uint64)
        x = np.union1d(x, y)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1)), strict=True)}
    got = set()
    for i, j in S.join_tries(x, [(0, len(x))], [(0, len(x))], [0], 0, 4, 0, 4):
        got |= set(zip(i.tolist(), j.tolist(), strict=True))
    assert got == want and len(want) > 500


@pytest.mark.parametrize("hot", [1 << 17, 40])
def test_blocks_and_rotations_agree_with_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "HOT", hot)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    x = base
    for k in (1, 3, 4, 5):
        y = base.copy()
        for _ in range(k):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y), dtype=np.uint64)
        x = np.union1d(x, y)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fingerprint long")
    from lumenlog.operators.graph import connected_components

    comps = {r.node: r.component for r in connected_components(S.links(df, len(x)), "a", "b").collect()}
    low = slow_components(x)
    signed = x.view(np.int64)
    want = {}
    for i, c in enumerate(low):
        want.setdefault(c, []).append(int(signed[i]))
    got = {}
    for v in signed.tolist():
        got.setdefault(comps.get(v, v), []).append(v)
    assert sorted(sorted(g) for g in got.values()) == sorted(sorted(g) for g in want.values())


def test_op4_query_against_brute_force(spark, sf):
    from lumenlog.llm.queries import op4_simhash

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [slow_fingerprint(t) for _, t in docs]
    low = slow_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, low, strict=True)}


def test_odd_tables(spark):
    rows = [(5, None, 1), (3, "", 2), (4, "a b c d e", 3), (4, "a b c d e", 3), (None, "z", 4), (9, "x " * 50000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in S.near_duplicates(df).collect())
    assert got == [(-1, -1), (3, 3), (4, 4), (4, 4), (5, 3), (9, 9)]
    assert S.near_duplicates(df.limit(0)).count() == 0
