"""Template mining over distinct templates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenlog.functions import tokens as T
from lumenlog.session import materialize

#: Distinct templates that are merged in one pass on the driver; more are merged by joins, with the same result.
MAX_DRIVER = 10_000
_VAR = re.compile(T.VARIABLE)


def _similarity(a: list[str], b: list[str]) -> float:
    """tokens.template_similarity of static token lists that aren't both empty."""
    own = set(a)
    return 2.0 * sum(t in own for t in b) / (len(a) + len(b)) if a and b else 0.0


def _place_similarity(n1: int, n2: int) -> float:
    """tokens.template_similarity of two templates of n1 and n2 variables and nothing else."""
    j = c = 0
    for i in range(n1):
        j = max(j, int(np.floor((i / n1 - 0.1) * n2)) + 1)
        if j < n2 and j / n2 < i / n1 + 0.1:
            j, c = j + 1, c + 1
    return c / (n1 + n2 - c) if n1 and n2 else 0.0


def merge_map(templates: list[str], threshold: float) -> list[str]:
    """For each template, in order, the first earlier representative that is similar enough, else itself."""
    reps: list[tuple[list[str], str, int]] = []
    by_token: dict[str, list[int]] = {}
    bare: list[tuple[int, str]] = []  # representatives without static tokens
    out = []
    for t in templates:
        words = t.split()
        static = [w for w in words if not _VAR.search(w)]
        if not static:
            same = next((r for n, r in bare if _place_similarity(n, len(words)) >= threshold), None)
            if same is None:
                bare.append((len(words), t))
            out.append(same or t)
            continue
        near = sorted({k for w in set(static) for k in by_token.get(w, ())})
        got = next((k for k in near if _similarity(reps[k][0], static) >= threshold), None)
        if got is None:
            for w in set(static):
                by_token.setdefault(w, []).append(len(reps))
            reps.append((static, t, len(words) - len(static)))
            out.append(t)
        else:
            out.append(reps[got][1])
    return out


def merge_templates(templates: DataFrame, threshold: float = 0.8, driver: int | None = None) -> DataFrame:
    """(template, merged) for rows (template, first_id): greedy in the order of first_id. Up to `driver` templates
    (MAX_DRIVER) on the driver, more by joins; `templates` is read more than once."""
    if templates.count() <= (MAX_DRIVER if driver is None else driver):
        rows = templates.orderBy("first_id", "template").select("template").collect()
        names = [r.template for r in rows]
        pairs = list(zip(names, merge_map(names, threshold), strict=True))
        return templates.sparkSession.createDataFrame(pairs, "template string, merged string")
    return _merge_joined(templates, threshold)


def _similar_pairs(own: DataFrame, threshold: float) -> DataFrame:
    """(a, b): keys of templates with static tokens, a before b, similar enough.

    Of b's n static tokens at least ceil(threshold * (n + 1) / 2) are in a, repeats counted, so a has one of all but
    that many less one of them: the rarest that are left stand for b in the join."""
    words = own.where("n > 0").select("k", F.posexplode("static").alias("i", "w"))
    counts = materialize(words.select("k", "w").distinct().groupBy("w").agg(F.count("*").alias("df")), "counts")
    need = F.ceil(threshold * (F.col("n") + 1) / 2 - 1e-9)
    rank = F.row_number().over(W.partitionBy("k").orderBy("df", "w", "i"))
    ranked = words.join(counts, "w").withColumn("rank", rank).join(own.select("k", "n"), "k")
    probes = ranked.where(F.col("rank") <= F.least(F.col("n"), F.col("n") - need + 1)).select(F.col("k").alias("b"), "w").distinct()
    met = words.select(F.col("k").alias("a"), "w").distinct().join(probes, "w").where("a < b").select("a", "b").distinct()
    side = lambda c: own.select(F.col("k").alias(c), F.col("static").alias(f"s_{c}"))
    both = met.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.filter("s_b", lambda x: F.array_contains("s_a", x)))
    return both.where(2.0 * shared / (F.size("s_a") + F.size("s_b")) >= threshold).select("a", "b")


def _merge_joined(templates: DataFrame, threshold: float) -> DataFrame:
    """merge_map by joins. A template without an earlier similar one is a representative; one with an earlier similar
    representative is not; one all of whose earlier similar ones are not is one. Rounds go on until all are told."""
    static = F.filter(T.tokenize(F.col("template")), lambda x: ~T.is_variable(x))
    own = templates.select(F.struct("first_id", "template").alias("k"), "template", static.alias("static"), F.size(T.tokenize(F.col("template"))).alias("words"))
    own = materialize(own.withColumn("n", F.size("static")), "templates")
    links = materialize(_similar_pairs(own, threshold), "similar")
    open_ = materialize(links.select(F.col("b").alias("k")).distinct(), "open")
    told = materialize(own.where("n > 0").select("k").join(open_, "k", "left_anti").withColumn("rep", F.lit(True)), "told")
    while not open_.isEmpty():
        seen = links.join(open_.withColumnRenamed("k", "b"), "b").join(told.withColumnRenamed("k", "a"), "a", "left").groupBy(F.col("b").alias("k"))
        seen = seen.agg(F.bool_or(F.coalesce("rep", F.lit(False))).alias("near"), F.bool_and(F.col("rep").isNotNull()).alias("all"))
        new = materialize(seen.where("near or all").select("k", (~F.col("near")).alias("rep")), "told")
        told = told.unionByName(new)
        open_ = materialize(open_.join(new, "k", "left_anti"), "open")
    reps = told.where("rep").select("k")
    first = links.join(reps.withColumnRenamed("k", "a"), "a").groupBy(F.col("b").alias("k")).agg(F.min("a").alias("a"))
    merged = own.where("n > 0").join(told.where("not rep").select("k").join(first, "k"), "k", "left").select("template", F.coalesce("a.template", "template").alias("merged"))
    # Templates of variables only are alike by their lengths alone: one row for each length.
    bare = own.where("n = 0")
    lengths = sorted((r.k.first_id, r.k.template, r.words) for r in bare.groupBy("words").agg(F.min("k").alias("k")).collect())
    found: list[tuple[int, str]] = []
    to = {}
    for _, t, n in lengths:
        same = next((r for m, r in found if _place_similarity(m, n) >= threshold), None)
        if same is None:
            found.append((n, t))
        to[n] = same or t
    names = templates.sparkSession.createDataFrame([(n, t) for n, t in to.items() if n], "words int, merged string")
    alone = bare.join(F.broadcast(names), "words", "left").select("template", F.coalesce("merged", "template").alias("merged"))
    return merged.unionByName(alone)


def parse_logs(logs: DataFrame, threshold: float | None = 0.9, extractor: Callable[[Column], Column] = T.extract_template, message: str = "message") -> DataFrame:
    """`logs` with template, parameters and event_type. `extractor` maps the message column to a template column (a
    pandas UDF will do); with a threshold the templates are merged. A null message has a null template."""
    raw = logs.drop("template", "event_type", "parameters").withColumn("raw_template", extractor(F.col(message)))
    if threshold is None:
        out = raw.withColumnRenamed("raw_template", "template")
    else:
        known = raw.where("raw_template is not null").groupBy(F.col("raw_template").alias("template")).agg(F.min("log_id").alias("first_id"))
        merged = merge_templates(materialize(known, "templates"), threshold).withColumnsRenamed({"template": "raw_template", "merged": "template"})
        out = raw.join(merged, "raw_template", "left").drop("raw_template")
    out = out.withColumn("parameters", T.extract_parameters(F.col("template"), F.col(message)))
    return out.withColumn("event_type", T.event_type(F.col("template")))


def clusters(parsed: DataFrame, examples: int = 5) -> DataFrame:
    """template, frequency, log_ids-free summary with variable types and up to `examples` messages."""
    few = parsed.withColumn("k", F.row_number().over(W.partitionBy("template").orderBy("log_id"))).where(F.col("k") <= examples)
    shown = few.groupBy("template").agg(F.transform(F.sort_array(F.collect_list(F.struct("log_id", "message"))), lambda e: e["message"]).alias("examples"))
    counts = parsed.groupBy("template").agg(F.count("*").alias("frequency"))
    return counts.join(shown, "template").withColumn("variable_types", F.transform(F.filter(T.tokenize(F.col("template")), T.is_variable), lambda t: F.regexp_extract(t, T.VARIABLE, 1)))


def merge_clusters(a: DataFrame, b: DataFrame, examples: int = 5) -> DataFrame:
    """Two cluster tables as one: frequencies added, the first table's examples first."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    sides = both.groupBy("template").agg(F.sum("frequency").alias("frequency"), F.sort_array(F.collect_list(F.struct("side", "examples", "variable_types"))).alias("s"))
    joined = F.slice(F.array_distinct(F.flatten(F.transform("s", lambda x: x["examples"]))), 1, examples)
    return sides.select("template", "frequency", joined.alias("examples"), F.flatten(F.transform("s", lambda x: F.when(x["side"] == F.array_min(F.transform("s", lambda y: y["side"])), x["variable_types"]).otherwise(F.array()))).alias("variable_types"))


def pair_matches(templates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """first, second, type, score, merged for pairs of distinct templates, first < second, that share a token or have
    none but variables; all others score 0."""
    own = templates.select("template").distinct()
    t = T.tokenize(F.col("template"))
    bare = F.when(F.forall(t, T.is_variable), F.array(F.lit("<>"))).otherwise(F.array().cast("array<string>"))
    words = own.withColumn("w", F.explode(F.concat(F.array_distinct(t), bare)))
    pairs = words.select(F.col("template").alias("first"), "w").join(words.select(F.col("template").alias("second"), "w"), "w").where("first < second").select("first", "second").distinct()
    m = T.template_match(F.col("first"), F.col("second"), threshold)
    return pairs.select("first", "second", m["type"].alias("type"), m["score"].alias("score"), T.merged_template(F.col("first"), F.col("second"), threshold).alias("merged"))


def prefix_matches(messages: DataFrame, templates: DataFrame, message: str = "message") -> DataFrame:
    """log_id, template: of the templates that are a prefix (by whole tokens) of the message's own template the longest."""
    own = T.tokenize(T.extract_template(F.col(message)))
    n = F.size(own)
    prefixes = messages.select("log_id", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(own, 1, i), " "))).alias("template"))
    keyed = templates.select("template", F.size(T.tokenize(F.col("template"))).alias("n")).distinct()
    return prefixes.join(keyed, "template").groupBy("log_id").agg(F.max_by("template", "n").alias("template"))


def drain(logs: DataFrame, sim: float = 0.5, depth: int = 5, message: str = "message") -> DataFrame:
    """log_id, template by a fixed-depth tree: masked messages with one token count and the same first depth - 2
    tokens are a leaf; within it a message joins the template with most equal tokens if these are a share of at least
    `sim`, and tokens that differ become <*>. Leaves work on distinct masked messages, in order of first sight."""
    masked = logs.select("log_id", T.mask(F.col(message)).alias("m"))
    distinct = masked.groupBy("m").agg(F.min("log_id").alias("first_id")).where("m is not null")
    t = T.tokenize(F.col("m"))
    lead = F.transform(F.slice(t, 1, max(1, depth - 2)), lambda x: F.when(x.rlike(r"\d|<"), "<*>").otherwise(x))
    keyed = distinct.withColumn("leaf", F.concat_ws(" ", F.size(t).cast("string"), F.array_join(lead, " ")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first_id")
        found: list[list[str]] = []
        owner = []
        for m in pdf["m"]:
            words = m.split()
            score = [sum(a == b for a, b in zip(c, words, strict=True)) for c in found]
            k = int(np.argmax(score)) if score else -1
            if k < 0 or words and score[k] / len(words) < sim:
                found.append(words)
                k = len(found) - 1
            else:
                found[k] = [a if a == b else "<*>" for a, b in zip(found[k], words, strict=True)]
            owner.append(k)
        return pd.DataFrame({"m": pdf["m"].to_numpy(), "template": [" ".join(found[k]) for k in owner]})

    parsed = keyed.groupBy("leaf").applyInPandas(run, "m string, template string")
    return masked.join(parsed, "m", "left").select("log_id", "template")


def regex_fields(logs: DataFrame, pattern: str, message: str = "message") -> DataFrame:
    """log_id, fields: the named groups of a Python pattern matched at the message's start; empty without a match."""
    rx = re.compile(pattern)

    @F.pandas_udf("map<string,string>")
    def groups(s: pd.Series) -> pd.Series:
        return s.map(lambda x: {k: v for k, v in m.groupdict().items() if v is not None} if x is not None and (m := rx.match(x)) else {})

    return logs.select("log_id", groups(F.col(message)).alias("fields"))


def nearest_centres(vectors: DataFrame, centres: list[tuple[int, list[float], str]], least: float = 0.8) -> DataFrame:
    """log_id, cluster, similarity, action: the centre with the highest cosine whose pattern matches the message
    ("match"); without one the nearest centre if it is nearer than `least` ("modify"); else null ("new")."""
    ids = np.array([c for c, _, _ in centres])
    mat = np.array([v for _, v, _ in centres], dtype=float).reshape(len(centres), -1)
    mat = mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-12)
    rx = [re.compile(p) for *_, p in centres]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, m, v in zip(f["log_id"], f["message"], f["embedding"], strict=True):
                if v is None or not len(rx) or not (norm := np.linalg.norm(v)):
                    rows.append((i, None, None, "new"))
                    continue
                sim = mat @ (np.asarray(v, dtype=float) / norm)
                order = np.argsort(-sim, kind="stable")
                k = next((k for k in order if m is not None and rx[k].match(m)), None)
                if k is not None:
                    rows.append((i, int(ids[k]), float(sim[k]), "match"))
                elif sim[order[0]] > least:
                    rows.append((i, int(ids[order[0]]), float(sim[order[0]]), "modify"))
                else:
                    rows.append((i, None, None, "new"))
            out = pd.DataFrame(rows, columns=["log_id", "cluster", "similarity", "action"])
            yield out.astype({"cluster": "Int64"})

    return vectors.select("log_id", "message", "embedding").mapInPandas(run, "log_id long, cluster long, similarity double, action string")
