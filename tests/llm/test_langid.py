import zlib

import numpy as np

from pyspark.sql import functions as F

from lumenlog.llm import langid as L

TEXTS = {
    "en": "the house and the garden were not very far from the river where they lived",
    "de": "das haus und der garten waren nicht sehr weit von dem fluss entfernt an dem sie lebten",
    "ru": "дом и сад были недалеко от реки где они жили",
    "el": "το σπίτι και ο κήπος δεν ήταν μακριά από το ποτάμι",
}


def small_model(spark):
    rows = [(f"{t} {i}", k) for k, t in TEXTS.items() for i in range(5)]
    return L.fit(spark.createDataFrame([*rows, (None, "en"), ("x", None)], "text string, lang string"))


def test_scripts_narrow_and_spans_are_labelled(spark):
    m = small_model(spark)
    assert m.langs == ["de", "el", "en", "ru"]
    mixed = f"{TEXTS['en']}. {TEXTS['de']}! река дом"
    got = list(L.predict_texts(m, ["", "12 ½ !", mixed, "река", "漢字", "das haus und der garten"], spans=True))
    assert [g[0] for g in got] == ["und", "und", "de", "ru", m.langs[m.fallback], "de"]
    assert got[0][1:] == (0.0, []) and got[3][1] == 1.0 and got[4][1] == 0.0
    spans = got[2][2]
    assert [s[2] for s in spans] == ["en", "de", "ru"]
    assert mixed[spans[1][0] : spans[1][1]] == TEXTS["de"] and mixed[spans[2][0] : spans[2][1]] == "река дом"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    counts = np.array([0, 5, 1, 4, 5, 0, 3])
    score = rng.normal(0, 8, (counts.sum(), 3))
    got = L.viterbi(score, counts, 6.0)
    at = 0
    for n in counts:
        own = score[at : at + n]
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T if n else np.zeros((1, 0), int)
        value = [own[np.arange(n), p].sum() - 6.0 * (np.diff(p) != 0).sum() for p in paths]
        assert not n or np.isclose(own[np.arange(n), got[at : at + n]].sum() - 6.0 * (np.diff(got[at : at + n]) != 0).sum(), max(value))
        at += n


def test_batching_does_not_change_predictions(spark, monkeypatch):
    m = small_model(spark)
    texts = [*TEXTS.values(), "", "a b " * 3000, TEXTS["de"] + " " + TEXTS["en"]] * 3
    whole = list(L.predict_texts(m, texts, spans=True))
    monkeypatch.setattr(L, "SLICE_CHARS", 50)
    monkeypatch.setattr(L, "HOLD_WORDS", 20)
    small = list(L.predict_texts(m, texts, spans=True))
    assert [(a, round(b, 9), c) for a, b, c in whole] == [(a, round(b, 9), c) for a, b, c in small]


def test_held_out_accuracy(spark, sf):
    from lumenlog.llm.queries import op1_language_id

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "en", 0.5), (2, "the house", "en", 0.1), (2, "the house", "en", 0.1), (None, "x", None, None)], "doc_id long, text string, lang string, score double")
    out = L.language_id(df, spans=True)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "spans"] and out.count() == 4
    assert L.language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(df, None).collect()} == {"und"}


def test_a_text_that_repeats_counts_once(spark):
    rows = [(i, TEXTS["en"], "en") for i in range(3000)] + [(5000 + i, TEXTS["de"] + f" haus {i}", "de") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for extra in ("", " or", " and the", " of a"):
        own = df.withColumn("text", F.when(F.col("lang") == "en", F.concat("text", F.lit(extra))).otherwise(F.col("text")))
        m = L.fit(own, fit_docs=100)
        assert m.langs == ["de", "en"] and np.ptp(m.scores[:, 1]) > 0  # some of its letters were learned
    assert next(L.predict_texts(m, [TEXTS["de"]]))[0] == "de"
