import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_linededup import slow as slow_lines
from tests.llm.test_native import slow_contamination
from tests.llm.test_simhash import slow_components, slow_fingerprint

LIB = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_run_against_plain_python(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = sorted((d, t) for d, _, _, t in slow_lines(docs))
    low = slow_components([slow_fingerprint(t) for _, t in kept])
    kept = [x for k, x in enumerate(kept) if low[k] == k]
    leaks = {d for d, *_, bad in slow_contamination(kept, items) if bad}
    want = {d: LIB.encode(t, add_special_tokens=False).ids for d, t in kept if d not in leaks}
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in P.run(spark, sf).collect()}
    assert got == want and len(want) < len(docs)


def test_stages_on_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
    rows = [(i, f"the house number {i} and the garden " * 3, "en", "s", 9, 0.1, "r") for i in range(12)]
    rows += [(20, None, None, None, None, None, None), (21, "", "en", "s", 0, None, None), (None, "the house of nobody", "en", None, 1, None, None), (3, rows[3][1], "en", "s", 9, 0.1, "r"), (22, "the " * 40000, "en", "s", 1, None, None)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in P.STAGES:
            out = stage(spark, df, sf)
            n = out.count()
            if name != "bpe":
                assert out.columns == df.columns and n <= df.count(), name
    first = P.STAGES[0][1](spark, spark.createDataFrame(rows, schema), sf)
    assert {r.doc_id for r in first.collect()} == {*range(12), 22, None}
