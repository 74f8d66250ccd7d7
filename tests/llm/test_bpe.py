import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenlog.llm import bpe, huffman

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OWN = bpe.load(PATH)
ODD = [
    "", " ", "\n\n", "a", "Hello WORLD's don't", "naïve ½ ² ªº", "İSTANBUL ΣΑΣ ǅ ﬁ ẞ", "日本語" * 700, "é" * 3000, "a" * 5000,
    "<|endoftext|>x<|startoftext|><|end", "\x1c\x1d\x85\xa0 \t\r\x0b", "́abc ́", "!!!'s'''re" * 400, "1234567890" * 200,
    "".join(random.Random(1).choices("abcdefghiéeß", k=9000)), "x <|endoftext|> " + "ab" * 2000,
]


def library(t):
    return LIB.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("t", ODD)
def test_same_ids_and_text_as_the_library(t):
    got = next(OWN.encode([t]))
    assert np.frombuffer(got, "<u4").tolist() == library(t)
    assert OWN.decode(got) == LIB.decode(library(t), skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(ts):
    assert [np.frombuffer(x, "<u4").tolist() for x in OWN.encode(ts)] == [library(t) for t in ts]


@settings(max_examples=60, deadline=None)
@given(st.text("abcdehinorst", min_size=1, max_size=400), st.integers(1, 40))
def test_tree_of_small_leaves(word, leaf):
    assert OWN.encode_long(word.encode(), leaf).tolist() == library(word)


def in_pieces(text, size):
    cut = [text[i : i + size] for i in range(0, len(text), size)]
    return OWN.tree_texts([(t, np.frombuffer(b, "<u4").astype(np.int32)) for t, b in zip(cut, OWN.encode(cut), strict=True)]).tolist()


@settings(max_examples=120, deadline=None)
@given(st.text("abcdehinorst ,.'l0\n\t<|>ÉéΣσ가ᄀ\u1161e\u0301", min_size=1, max_size=300), st.integers(1, 60))
def test_tree_of_text_pieces(text, size):
    assert in_pieces(text, size) == library(text)


def test_tree_of_unsplit_text(monkeypatch):
    monkeypatch.setattr(bpe, "UNSPLIT", 256)
    rng, joined = np.random.default_rng(1), []
    own = bpe.WordBpe._join_unsplit
    monkeypatch.setattr(bpe.WordBpe, "_join_unsplit", lambda *a: joined.append((got := own(*a)) is not None) or got)
    run = "".join(rng.choice(list("abcdehinorst"), 9000))
    for text in (run, "<|endoftext|>" * 700, "1" * 5000, "a b " + run + ", and " + run[:4000] + "." * 3000, "the end'll " * 900, "ᄀ\u1161" * 2000, "don't" * 1500):
        assert in_pieces(text, 1100) == library(text)
    assert sum(joined) > 5


def test_long_texts_are_joined(spark):
    texts = ["the house and the garden " * 9000, "x" * 140_000, "short", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode_texts(df, PATH, joins="n_joins").collect()}
    assert [got[i].n_joins for i in range(5)] == [3, 2, 0, 0, 0]
    assert all(np.frombuffer(bytes(got[i].ids), "<u4").tolist() == library(t) for i, t in enumerate(texts))
    assert bpe.encode_texts(df.limit(0), PATH).count() == 0


def test_pieces_and_extra_columns(spark):
    rows = [(i, t, "q", i) for i, t in enumerate([*ODD, None, ODD[4]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, t long")
    want = {i: library(t) for i, t, _, _ in rows}
    for limit in (100, 1 << 16):
        out = bpe.encode_texts(df, PATH, piece_chars=limit)
        assert out.columns == ["doc_id", "t", "ids"]
        assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in out.collect()} == want
    got = bpe.decode_ids(bpe.encode_texts(df, PATH), PATH).collect()
    assert all(r.decoded == LIB.decode(want[r.doc_id], skip_special_tokens=False) for r in got)


def test_op6_query(spark, sf):
    from lumenlog.llm.queries import op6_bpe

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_code_lengths_are_limited_and_complete():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 0])
    free, tight = huffman.code_lengths(counts, 12), huffman.code_lengths(counts, 4)
    assert tight.max() == 4 and tight[0] == tight[11] == 0
    for x in (free, tight):
        assert sum(2.0 ** -int(n) for n in x if n) == 1
    assert (free * counts).sum() <= (tight * counts).sum()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5), 2)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_block_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 300, n).astype("<u4") ** 2 % 299
    lengths = huffman.code_lengths(np.bincount(ids, minlength=300), 10)
    block = huffman.pack([7, None], np.array([n // 2, n - n // 2]), ids, lengths, huffman.canonical(lengths), 128)
    docs, sizes, back = huffman.unpack(block, huffman.decoding_table(lengths))
    assert docs.tolist() == [7, huffman.NO_ID] and sizes.sum() == n and (back == ids).all()


def test_op10_query(spark, sf):
    from lumenlog.llm.queries import op10_token_files

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op10_token_files(spark, sf).collect()}
    at = 0
    for d, t in docs:
        ids = [*library(t), 1]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


def test_token_files_of_odd_tables(spark):
    df = spark.createDataFrame([(2, None), (1, "a b"), (None, "c"), (2, "d"), (2, "d")], "doc_id long, text string")
    got = huffman.token_files(df, PATH).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 3), (2, 5, 1), (2, 6, 2), (2, 8, 2)]
    assert huffman.token_files(df.limit(0), PATH).count() == 0


def test_workers_drop_the_encoder_for_another_operator():
    import pyarrow as pa
    import public_tokenizers

    from lumenlog.llm import bpe
    from lumenlog.llm.common import lean

    bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    assert list(lean(iter, "bpe")(iter([batch]))) == [batch] and bpe._LOADED
    assert list(lean(iter)(iter([batch]))) == [batch] and not bpe._LOADED
