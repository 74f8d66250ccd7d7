import hashlib

import numpy as np
import pytest

from lumenlog.llm import linededup as L


def slow(docs):
    holders = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = L.line_key(line)
            if len(k) >= 10 and d is not None:
                holders.setdefault(k, set()).add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            h = holders.get(L.line_key(line), set())
            if d is None or len(h) < 2 or d == min(h):
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [
    (3, "same line here\nown line of three\nshort"), (1, " SAME line HERE\t\nshort\nsame line here"), (2, None), (4, ""), (5, "\n\n"),
    (6, "same line here\nsame line here"), (7, "own line of seven\nÉ same line here"), (7, "own line of seven\nÉ same line here"),
    (None, "same line here\nx"), (8, "own line of seven"),
]


def rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text_kept) for r in df.collect()), key=str)


def test_key():
    assert L.line_key("\x0b\t ÀB C\x0c\r") == "Àb c"
    assert L.line_key("\xa0x\x1c") == "\xa0x\x1c"


def test_small_tables(spark):
    df = spark.createDataFrame([(*r, 1, "q") for r in ROWS], "doc_id long, text string, n_lines int, `odd name` string")
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "odd name", "text_kept", "n_lines", "n_dropped"]
    assert rows(out) == slow(ROWS)
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_insertions_and_deletions_are_reversible(spark):
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    first, later = make(ROWS[:5]), make(ROWS[5:])
    one = L.LineIndex(spark).insert(first)
    both = one.insert(later)
    assert rows(both.apply(make(ROWS))) == slow(ROWS)
    less = both.delete(make([(1, ""), (8, "")]))
    left = [r for r in ROWS if r[0] not in (1, 8)]
    assert rows(less.apply(make(left))) == slow(left)
    back = both.delete(make([(r[0], "") for r in ROWS[5:] if r[0] is not None]))
    kept = lambda x: sorted(np.frombuffer(bytes(r.filter)[8:], "<u2").astype(bool).sum() for r in x.filters.collect())
    assert sum(kept(back)) == sum(kept(one))
    assert rows(back.apply(first)) == slow(ROWS[:5])


def test_cuckoo_filter():
    h = np.random.default_rng(1).integers(0, 2**64, 20000, dtype=np.uint64)
    f = L.Cuckoo(len(h))
    f.add(h)
    assert f.has(h).all() and f.has(~h).mean() < 0.001
    g = L.Cuckoo.from_bytes(f.to_bytes())
    g.remove(h[:15000])
    assert g.has(h[15000:]).all() and g.has(h[:15000]).mean() < 0.001
    full = L.Cuckoo(8)
    full.add(h[:100])
    assert full.has(h[:100]).all() and full.over


@pytest.mark.parametrize("shard, part", [(2, 1 << 15), (1 << 14, 3), (1, 1)])
def test_small_shards_and_parts(spark, monkeypatch, shard, part):
    monkeypatch.setattr(L, "SHARD", shard)
    monkeypatch.setattr(L, "PART", part)
    df = spark.createDataFrame([*ROWS, *((None, f"a line of nobody {i}") for i in range(20))], "doc_id long, text string")
    assert rows(L.dedup_lines(df)) == slow([*ROWS, *((None, f"a line of nobody {i}") for i in range(20))])


def test_filters_grow(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 256)
    many = [(i, f"the line of a pair {i // 2}\nand a line that all have\nown line {i}") for i in range(10_000)]
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    index = L.LineIndex(spark).insert(make(many[:1])).insert(make(many[1:]))
    assert index.shards >= 10 and all(not L.Cuckoo.from_bytes(bytes(r.filter)).over for r in index.filters.collect())
    assert rows(index.apply(make(many))) == slow(many)


def test_op9_query_against_brute_force(spark, sf):
    from lumenlog.llm.queries import op9_line_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op9_line_dedup(spark, sf).collect()), key=str)
    assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in slow(docs)), key=str)
