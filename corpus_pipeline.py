"""The corpus pipeline: five stages over `documents`, each one operator of lumenlog.llm.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents (the
last: the tokens). Rows with one doc_id stand or fall together; a row without a doc_id can be rejected by language
but is otherwise kept as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import langid
from lumenlog.llm.bpe import encode_texts
from lumenlog.llm.common import table
from lumenlog.llm.decontam import contamination
from lumenlog.llm.linededup import dedup_lines
from lumenlog.llm.neardup import similar_documents
from lumenlog.llm.queries import TOKENIZER
from lumenlog.session import materialize

#: A document goes if no language has this share of its letters.
MIN_LANG_SCORE = 1 / 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from those not held out: without letters, or with less than
    MIN_LANG_SCORE of the letters in one language, they go."""
    # lang_pred and score would hide columns of these names, so the columns get others meanwhile.
    name = {c: "text" if c == "text" else f"own{i}" for i, c in enumerate(docs.columns)}
    model = langid.fit(docs.where(~langid.held_out()))
    kept = langid.identify(docs.toDF(*name.values()), model).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANG_SCORE))
    return kept.select(*[F.col(n).alias(c) for c, n in name.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents go from all but the smallest doc_id; n_chars follows."""
    own = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    out = dedup_lines(own)
    value = {"text": F.col("text_kept"), "n_chars": F.char_length("text_kept").cast("long")}
    return out.select(*[value.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, Jaccard similarity of 0.8 and more) the document with the
    smallest doc_id stays."""
    groups = similar_documents(docs.select("doc_id", "text"), words=5, least=(4, 5))
    gone = materialize(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten words of a benchmark item occurs go."""
    found = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), size=10)
    gone = materialize(found.where("contaminated").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit) of every document."""
    out = encode_texts(docs.select("doc_id", "lang", "source", "text"), TOKENIZER)
    return out.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("bpe", bpe),
]
#: Fingerprints and tokens have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
