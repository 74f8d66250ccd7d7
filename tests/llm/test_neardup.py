import numpy as np
import pytest

import corpus_pipeline as P
from lumenlog.llm import neardup as N


def slow_shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def slow_groups(rows):
    sets = [slow_shingles(t) for _, t in rows]
    low = list(range(len(rows)))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while any(low[i] != low[j] for i, j in near):
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    return {d: min(e for (e, _), m in zip(rows, low, strict=True) if m == n) for (d, _), n in zip(rows, low, strict=True)}


def texts():
    """Texts with copies in which runs of words differ, about the bound and chained."""
    rng = np.random.default_rng(3)
    out = []
    for k in range(40):
        own = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(4, 150))]
        out.append(" ".join(own))
        for c in range(k % 7):
            at = int(rng.integers(0, len(own)))
            own = [*own[:at], *(f"v{x}" for x in rng.integers(0, 3000, max(1, len(own) * c // 50))), *own[at + max(1, len(own) * c // 50) :]]
            out.append(" ".join(own))
    return [*out, "", " \n", "a b c", "A b  c", out[0], *("the same line of a licence in each text " + t for t in out[:20])]


@pytest.mark.parametrize("common", [1 << 16, 0])
def test_agrees_with_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(N, "COMMON", common)
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.component_id for r in N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = slow_groups(rows)
    assert got == want and 20 < sum(d != c for d, c in want.items()) < len(rows) - 20


def test_first_round_decides_nothing(spark):
    rows = [r for r in enumerate(texts()) if r[0] % 3]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.similar_documents(df, max_bits=12).collect()}
    assert got == slow_groups(rows)


def test_odd_tables(spark):
    rows = [(5, None), (3, ""), (4, "a b c d e f"), (4, "a b c d e f"), (None, "z"), (9, "x " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in N.similar_documents(df).collect())
    assert got == [(-1, -1), (3, 3), (4, 4), (4, 4), (5, 3), (9, 9)]
    assert N.similar_documents(df.limit(0)).count() == 0


def test_stage_drops_near_copies_of_over_four_bits(spark, sf):
    from lumenlog.llm.simhash import fingerprint

    words = [f"w{i}" for i in range(200)]
    near, far = [*words[:90], *"abcdefgh", *words[98:]], [*words[:60], *(f"v{i}" for i in range(40)), *words[100:]]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, near, far))]
    assert (fingerprint(rows[0][1]) ^ fingerprint(rows[1][1])).bit_count() > 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, sf).collect()) == [0, 2]


def test_parities_bound_what_is_common(spark):
    rng = np.random.default_rng(5)
    rows, true = [], []
    for n, m, same in ((1, 1, 0), (60, 70, 60), (64, 65, 64), (300, 260, 250), (500, 520, 0), (40, 3000, 30), (2000, 2100, 1990)):
        own = np.unique(rng.integers(0, 1 << 63, n + m - same, dtype=np.uint64))
        a, b = own[:n], np.sort(own[n - same :])
        rows.append((N.parities(a).view(np.int64).tolist(), N.parities(b).view(np.int64).tolist()))
        true.append((len(a), len(b), len(np.intersect1d(a, b)), len(np.setxor1d(a, b))))
    got = [r.d for r in spark.createDataFrame(rows, "a array<long>, b array<long>").coalesce(1).select(N.differing("a", "b").alias("d")).collect()]
    assert all(d <= apart and (d - apart) % 2 == 0 for d, (*_, apart) in zip(got, true, strict=True))
    far = [9 * (n + m - d) < 8 * (n + m) for d, (n, m, *_) in zip(got, true, strict=True)]
    assert far == [True, False, False, False, True, False, False]  # sizes this far apart are left to the sizes
    assert not any(f and 9 * 2 * c >= 8 * (n + m) for f, (n, m, c, _) in zip(far, true, strict=True))


def test_unlike_sets_never_carry_shingles_and_little_stays_on_disk(spark, monkeypatch):
    """60 texts of one size share a passage that is in all their leading parts: 1770 pairs, none of them alike."""
    from pathlib import Path

    from lumenlog.session import shared_dir

    rng, compared = np.random.default_rng(7), []
    passage = " ".join(f"p{x}" for x in range(60))
    rows = [(i, f"{passage} " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 60))) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1].replace("p0 ", "q0 ")), (102, "")]
    monkeypatch.setattr(N, "COMMON", 0)
    monkeypatch.setattr(N, "shingle_sets", lambda docs, words=5, f=N.shingle_sets: compared.append(docs.count()) or f(docs, words))
    at = Path(shared_dir(spark).removeprefix("file:")) / "lumenlog"
    before = set(at.glob("*"))
    got = {r.doc_id: r.component_id for r in N.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_groups(rows) and sum(compared) <= 4
    left = {p.name.split("-")[1] for p in set(at.glob("*")) - before}
    assert left <= {"hot", "edges", "links", "rows"}, left
