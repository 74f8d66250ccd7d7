"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import chat, langid, secrets
from lumenlog.llm.bpe import digest, encode_texts
from lumenlog.llm.common import table
from lumenlog.llm.decontam import contamination
from lumenlog.llm.hamming import binary_codes, top_k
from lumenlog.llm.huffman import token_files
from lumenlog.llm.linededup import dedup_lines
from lumenlog.llm.simhash import near_duplicates
from lumenlog.llm.urlfilter import judge

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The rules of op7_url_filter.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = binary_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(codes, codes.where("id % 100 = 0"), k=10)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.fit(docs))
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(base) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    digest_ = F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest_, secrets.span_text(F.col("spans")).alias("spans"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, max_bits=4)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.parse(table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", "turn", "part", "role", "n_lines", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(encode_texts(docs, TOKENIZER), TOKENIZER)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10, slop=0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text_kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_topk": op2_topk,
    "op3_secrets": op3_secrets,
    "op4_simhash": op4_simhash,
    "op5_chat": op5_chat,
    "op6_bpe": op6_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_files": op10_token_files,
}
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE: dict[str, str] = {
    "op2_topk": """
WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
         list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CASE WHEN (p[1] > 0) <> (p[2] > 0) THEN 1 ELSE 0 END)) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, neighbor_id, CAST(distance AS INTEGER) AS distance, CAST(k AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS k FROM pairs) WHERE k <= 10
""",
    "op7_url_filter": f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
fit AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(h, '.')) DESC, length(p) DESC) AS k
  FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT hp.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hp LEFT JOIN fit ON hp.page_id = fit.page_id AND k = 1
""",
    "op8_decontamination": f"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM dw),
gram AS (
  SELECT doc_id, i, w, string_agg(w, ' ') OVER r AS g, count(*) OVER r AS n FROM tok
  WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
m AS (
  SELECT doc_id, i, win.n, item_id FROM gram JOIN win ON win.n = 10 AND gram.n = 10 AND gram.g = win.g
  UNION ALL
  SELECT doc_id, i, win.n, item_id FROM gram JOIN win ON win.n < 10 AND starts_with(gram.g || ' ', win.g || ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
bag AS (SELECT doc_id, i, w, g, n, array_to_string(list_sort(string_split(g, ' ')), ' ') AS b FROM gram),
wbag AS (SELECT item_id, n, array_to_string(list_sort(string_split(g, ' ')), ' ') AS b FROM win),
nm AS (
  SELECT doc_id, item_id FROM bag JOIN wbag ON wbag.n = 10 AND bag.n = 10 AND bag.b = wbag.b
  UNION ALL
  SELECT doc_id, item_id FROM bag JOIN wbag ON wbag.n < 10 AND list_contains(string_split(wbag.b, ' '), w)
    AND array_to_string(list_sort((string_split(bag.g, ' '))[1 : wbag.n]), ' ') = wbag.b),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nm GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN near ON dw.doc_id = near.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
""",
    "op9_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS low FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT doc_id, line, i, low IS NOT NULL AND doc_id > low AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
