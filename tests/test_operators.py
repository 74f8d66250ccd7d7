"""Small literal cases and properties."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlog import sources
from lumenlog.errors import DataError
from lumenlog.functions import tokens as T
from lumenlog.operators import anomaly, cluster, evaluate, graph, numeric, prefilter, query, templates
from lumenlog.session import materialize


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(col.alias("x")).first().x


def test_match_cases(spark):
    a, b = F.col("a"), F.col("b")
    t = "User <OID> logged in from <LOI>"
    m = one(spark, T.template_match(a, b), a=t, b=t)
    assert (m.type, m.score, len(m.matched), len(m.variables)) == ("EXACT", 1.0, 6, 2)
    m = one(spark, T.template_match(a, b), a=t, b="User <OID> authenticated from <LOI>")
    assert m.type == "VARIABLE_ONLY" and math.isclose(m.score, 4 / 7)
    m = one(spark, T.template_match(a, b), a=t, b="Failed to connect to database with error <STC>")
    assert (m.type, m.score) == ("VARIABLE_ONLY", 0.0)
    assert one(spark, T.merged_template(a, b), a=t, b="User <OID> logged in from <LOI> with role <SID>") == t
    assert one(spark, T.template_match(a, b), a="x y", b="p q").type == "NO_MATCH"
    m = one(spark, T.template_match(a, b), a="<OID> <LOI>", b="<OBA> <OBA> <OBA>")
    assert math.isclose(m.score, 1 / 4)  # only the first places are less than 0.1 apart
    assert one(spark, T.template_match(a, b), a="", b="x").score == 0.0


def test_extraction(spark):
    m = F.col("m")
    assert one(spark, T.extract_template(m), m="User admin logged in from 192.168.1.1") == "User admin logged in from <LOI>"
    assert one(spark, T.extract_template(m), m=" 0xFF  a-1 12 x ") == "<OID> <OID> <OBA> x"
    assert one(spark, T.extract_parameters(F.col("t"), m), t="User admin logged in from <LOI>", m="User admin logged in from 192.168.1.1") == {"param_5_LOI": "192.168.1.1"}
    assert one(spark, T.extract_parameters(F.col("t"), m), t="a <LOI>", m="a b c") == {}
    assert one(spark, T.variable_types(m), m="a 12") == {"param_1_OBA": "OBA"}
    assert one(spark, T.fallback_template(m), m="ab 1c -d") == "ab <OTHER_PARAMS> <OTHER_PARAMS>"
    assert one(spark, T.mask(m), m="10.0.0.1 pid=12 0xaf 7") == "<IP> pid=<PID> <HEX> <NUM>"
    assert one(spark, T.structural_key(m), m="all good here now") == "all good here"
    assert one(spark, T.column_name(m), m="1st Name!") == "f_1st_name_"
    assert one(spark, T.event_type(m), m="a Warning: failed") == "ERROR"
    assert one(spark, T.extract_template(m), m="") == "" and one(spark, T.extract_template(m), m=None) is None
    assert [one(spark, T.number(m), m=x) for x in ("1.5", "5d", "nan", "", "1e3", "x")] == [1.5, None, None, None, 1000.0, None]


def test_token_similarity(spark):
    s = T.token_similarity(T.tokenize(F.col("a")), T.tokenize(F.col("b")))
    assert math.isclose(one(spark, s, a="x b c", b="y b c"), 0.7 * 2 / 3 + 0.3 * 2 / 4)
    assert one(spark, s, a="a", b="a") == 1.0 and one(spark, s, a="", b="a") == 0.0


def test_quantiles_of_large_groups_are_the_same(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 50)) for _ in range(300)] + [("b", float(rng.randrange(4))) for _ in range(201)]
    rows += [(None, v) for v in (2.0, None, 1.0)] + [("one", 7.0), ("none", None), ("ties", 5.0), ("ties", 5.0)]
    df = spark.createDataFrame(rows, "g string, value double")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]

    def get():
        return {(r.g, r.rows): r.q for r in numeric.quantiles(df, ["g"], probs).collect()}

    want = get()
    every = numeric.quantiles(df, [], probs).first()
    monkeypatch.setattr(numeric, "MAX_BUFFER", 10)
    got = get()
    assert got.keys() == want.keys() and got[("none", 1)] is None
    for k in want:
        assert got[k] == want[k] or got[k] == pytest.approx(want[k])
    other = numeric.quantiles(df, [], probs).first()
    assert other.rows == every.rows == len(rows) and other.q == pytest.approx(every.q)


def test_quartiles_and_outliers(spark):
    df = spark.createDataFrame([(i, float(i + 1)) for i in range(10)], "log_id long, value double")
    assert df.agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).first()[0] == [3.25, 5.5, 7.75]
    rows = [(i, 100.0 if i == 10 else float(10 + i % 5)) for i in range(20)]
    long = numeric.long_values(spark.createDataFrame(rows, "log_id long, value double"), ["value"], ["log_id"])
    assert [r.log_id for r in numeric.outliers(long).where("is_outlier").collect()] == [10]
    rng = random.Random(1)
    v = [rng.uniform(0, 100) for _ in range(100)]
    v[10], v[50], v[90] = 500.0, 600.0, -200.0
    w = [rng.uniform(0, 100) for _ in range(100)]
    w[20], w[60] = 500.0, -150.0
    df = spark.createDataFrame([(i, v[i], w[i], 0 if i < 40 else 1 if i < 80 else -1) for i in range(100)], "log_id long, v double, w double, g int")
    long = numeric.long_values(df, ["v", "w"], ["log_id"])
    for robust in (True, False):
        got = {(r.field, r.log_id) for r in numeric.outliers(long, robust=robust).where("is_outlier").collect()}
        assert {("v", 10), ("v", 50), ("w", 20)} <= got and (not robust or got == {("v", 10), ("v", 50), ("v", 90), ("w", 20), ("w", 60)})
    assert numeric.any_outlier(numeric.outliers(long), "log_id").where("is_outlier").count() == 5
    grouped = numeric.outliers(numeric.long_values(df, ["v"], ["log_id", "g"]), group="g").where("is_outlier")
    assert sorted(r.log_id for r in grouped.collect()) == [10, 50]
    assert numeric.numeric_columns(df) == ["log_id", "v", "w", "g"]
    flat = numeric.long_values(df.withColumn("v", F.lit(1.0)), ["v"], ["log_id"])
    assert numeric.outliers(flat).where("is_outlier").count() == numeric.outliers(flat, robust=False).where("is_outlier").count() == 0
    assert numeric.outliers(long.limit(0)).count() == 0


def test_numeric_fields(spark):
    rows = [(i, {"numeric1": "123.45", "numeric2": "678", "string1": "abc", "mixed": "1" if i < 3 else "x", "timestamp": "2024-01-01"}) for i in range(10)]
    got = numeric.numeric_fields(spark.createDataFrame([*rows, (11, None)], "log_id long, parameters map<string,string>"))
    assert sorted(r.field for r in got.collect()) == ["numeric1", "numeric2"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyab")), min_size=0, max_size=25))
def test_scores_are_their_definitions(spark, rows):
    df = spark.createDataFrame(rows, "pred string, truth string")
    r = evaluate.grouping_scores(df).first()
    n, agree, tp, p, t = len(rows), 0, 0, 0, 0
    for i in range(n):
        for j in range(i):
            a, b = rows[i][0] == rows[j][0], rows[i][1] == rows[j][1]
            agree, tp, p, t = agree + (a == b), tp + (a and b), p + a, t + b
    assert math.isclose(r.grouping_accuracy, agree / (n * (n - 1) / 2) if n > 1 else 0.0)
    assert math.isclose(r.pair_f1, 2 * tp / (p + t) if p + t else 0.0)
    if rows:
        f = evaluate.label_f1(df).first()
        names = {x for r in rows for x in r}
        each = []
        for x in names:
            c = [sum(r[0] == x and r[1] == x for r in rows), sum(r[0] == x for r in rows), sum(r[1] == x for r in rows)]
            each.append(2 * c[0] / (c[1] + c[2]))
        assert math.isclose(f.fta, np.mean(each)) and math.isclose(f.fga, sum(a == b for a, b in rows) / n)


def test_prefilter_properties(spark):
    rows = [(i, f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}", ["ERROR", "INFO", "DEBUG", None][i % 4], f"m{i % 3 if i % 2 else i}") for i in range(800)]
    logs = spark.createDataFrame(rows, "log_id long, timestamp string, level string, message string").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    s = prefilter.stratified_sample(logs)
    n = {r.level: r.n for r in s.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert n == {"ERROR": 200, "INFO": 20, "DEBUG": 10, None: 20}
    d = prefilter.dedupe_capped(logs).collect()
    count = {}
    for r in d:
        count.setdefault(r.message, []).append(r.log_id)
    assert max(map(len, count.values())) == 5 and min(count["m0"]) == min(r[0] for r in rows if r[3] == "m0")
    assert len(prefilter.dedupe_capped(logs, cap=1).where("message = 'm1'").collect()) == 2
    assert prefilter.prefilter_or_all(logs, 10_000).count() == 800
    assert prefilter.prefilter(logs.limit(0)).count() == 0


def test_dbscan_is_its_definition(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.25, (25, 3)) for c in ((2, 0, 0), (0, 2, 0), (0, 0, 2))] + [rng.normal(0, 1, (15, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 3)], "log_id long, embedding array<float>")
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 1 - y @ y.T <= 0.05
    core = near.sum(1) >= 4
    for block in (1000, 20):
        monkeypatch.setattr(cluster, "BLOCK", block)
        got = {r.log_id: r for r in cluster.dbscan(df, eps=0.05, min_samples=4).collect()}
        assert {i for i in range(len(x)) if got[i].is_core} == set(np.flatnonzero(core))
        assert {i for i in range(len(x)) if got[i].cluster_label == -1} == {i for i in range(len(x)) if not (near[i] & core).any()}
        for i in range(len(x)):
            for j in range(len(x)):
                if near[i, j] and core[i] and core[j]:
                    assert got[i].cluster_label == got[j].cluster_label
        assert got[900].cluster_label == got[901].cluster_label == -1


def test_connected_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (7, 7)]
    low = {}
    for a, b in pairs:
        if b is not None and a != b:
            low.setdefault(a, a)
            low.setdefault(b, b)
    for _ in range(200):
        for a, b in pairs:
            if b is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == low
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_templates(spark):
    msgs = ["Server s1 retry 3", "Server s2 retry 9", "Disk full on /dev/sda", "Disk full on /dev/sdb", None, ""]
    logs = spark.createDataFrame(list(enumerate(msgs)), "log_id long, message string")
    rows = {r.log_id: r for r in templates.parse_logs(logs, 0.8).collect()}
    assert rows[0].template == rows[1].template == "Server <OID> retry <OBA>" and rows[1].parameters == {"param_1_OID": "s2", "param_3_OBA": "9"}
    assert rows[4].template is None and rows[5].template == ""
    parsed = templates.parse_logs(logs, None)
    both = templates.merge_clusters(templates.clusters(parsed), templates.clusters(parsed))
    assert {r.template: r.frequency for r in both.collect() if r.template}["Server <OID> retry <OBA>"] == 4
    assert {r.log_id: r.template for r in templates.drain(logs).collect()}[2] == "Disk full on <*>"
    limit, templates.MAX_DRIVER = templates.MAX_DRIVER, 0
    try:
        blocked = {r.log_id: r.template for r in templates.parse_logs(logs, 0.8).collect()}
    finally:
        templates.MAX_DRIVER = limit
    assert blocked == {k: r.template for k, r in rows.items()}
    near = templates.nearest_centres(spark.createDataFrame([(1, "ab", [1.0, 0.0]), (2, "zz", [1.0, 0.1]), (3, "zz", [0.5, -1.0]), (4, "a", None)], "log_id long, message string, embedding array<double>"), [(10, [1.0, 0.0], "a"), (11, [0.0, 1.0], "b")])
    assert {r.log_id: (r.cluster, r.action) for r in near.collect()} == {1: (10, "match"), 2: (10, "modify"), 3: (None, "new"), 4: (None, "new")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("LineId,Content,EventTemplate,EventId,ParameterList.x\n1,hello a,hello <*>,E1,a\n2,hi,hi,E2,\n")
    rows = sources.read_structured(spark, str(tmp_path / "a.csv")).orderBy("LineId").collect()
    assert [r.parameters for r in rows] == [{"param_x": "a"}, {}]
    assert sources.read_templates(spark, str(tmp_path / "a.csv")).count() == 2
    with pytest.raises(DataError):
        sources.read_structured(spark, str(_write(tmp_path / "b.csv", "x,y\n1,2\n")))
    with pytest.raises(DataError):
        sources.read_templates(spark, str(_write(tmp_path / "c.csv", 'EventId,EventTemplate\n1," "\n')))
    assert [r.content for r in sources.read_logs(spark, str(_write(tmp_path / "t.log", " one \ntwo\n"))).collect()] == ["one", "two"]
    assert [r.content for r in sources.read_logs(spark, str(_write(tmp_path / "d.csv", "id,content\n1,abc\n"))).collect()] == ["abc"]
    assert sources.read_headerless(spark, str(tmp_path / "t.log")).columns == ["Content"]
    (tmp_path / "base/loghub_2k/Apache").mkdir(parents=True)
    _write(tmp_path / "base/loghub_2k/Apache/Apache_2k.log_structured.csv", "LineId\n")
    assert sources.list_datasets(spark, str(tmp_path / "base")) == [("loghub_2k", "Apache")]
    v = sources.validate_dataset(spark.createDataFrame([(1,), (2,)], "LineId long"), spark.createDataFrame([(1, " ")], "LineId long, EventTemplate string")).first()
    assert (v.n_logs, v.n_templates, v.n_blank, v.n_missing) == (2, 1, 1, 1)
    text = sources.write_report(spark, str(tmp_path / "r"), "T", {"n": 1}, spark.createDataFrame([(1, "a")], "k int, v string"))
    assert "# T" in text and "| 1 | a |" in text


def _write(p, text):
    p.write_text(text)
    return p


def test_logs_table(spark):
    spark.sql("DROP TABLE IF EXISTS t_logs")
    sources.create_logs_table(spark, "t_logs")
    rows = spark.sql("SELECT 1L AS log_id, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS timestamp, 'INFO' AS level, 'm' AS message")
    sources.append_logs(rows, "t_logs")
    sources.append_logs(rows, "t_logs")
    got = spark.table("t_logs")
    assert got.count() == 2 and str(got.first().date) == "2024-01-02" and got.first().component is None
    spark.sql("DROP TABLE t_logs")


def test_history_and_detection(spark):
    rows = [(i, f"2024-01-01 {i % 24:02d}:00:00", "ERROR" if i % 5 == 0 else "INFO", "c", f"user u{i}", {"k": "1000" if i == 7 else str(i % 3)}, [1.0, 0.01 * (i % 4)] if i != 30 else [-1.0, 0.0]) for i in range(48)]
    logs = spark.createDataFrame(rows, "log_id long, timestamp string, level string, component string, message string, parameters map<string,string>, embedding array<float>").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    found = {r.log_id: r for r in anomaly.detect(logs, "2024-01-01", "2024-01-02").collect()}
    assert set(found) == {7, 30} and found[7].numeric_fields == ["k"] and found[30].cluster_label == -1
    assert "unlike any group" in found[30].explanation and "deviations" in found[7].explanation and found[7].detection_window_hours == 24
    w = anomaly.history_windows(logs, "2024-01-02", 6, 1).collect()
    assert sorted(r.window for r in w) == [0, 1, 2, 3] and sum(r.total for r in w) == 48
    hist = anomaly.detection_history(logs, "2024-01-02 00:00:00", 12, 1).collect()
    assert sum(r.total for r in hist) >= 1
    forest = cluster.IsolationForest(np.random.default_rng(0).normal(0, 1, (300, 2)))
    s = forest.score(np.array([[0.0, 0.0], [9.0, 9.0]]))
    assert s[1] > 0.6 > s[0]
    assert query.with_defaults(spark.createDataFrame([(None, None, None)], "timestamp timestamp_ntz, level string, component string")).first().level == "INFO"


def test_new_templates_stream(spark, tmp_path):
    from lumenlog import streaming

    logs = spark.createDataFrame([("2024-01-01 00:00:00", f"job j{i} done", ) for i in range(5)] + [("2024-01-01 00:00:01", "stop")], "timestamp string, message string")
    logs.write.parquet(str(tmp_path / "in"))
    parsed = streaming.parse_stream(spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in")))
    q = streaming.new_templates(parsed).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert sorted(r.template for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["job <OID> done", "stop"]


def test_materialize(spark):
    assert materialize(spark.range(3)).count() == 3


def test_jobs(spark, tmp_path):
    from lumenlog.plans import jobs

    _write(tmp_path / "in.log", "User u1 in\nUser u2 in\n\nstop now\n")
    assert jobs.main(["parse", str(tmp_path / "in.log"), "--output-dir", str(tmp_path / "out")]) == 0
    assert spark.read.csv(str(tmp_path / "out/templates"), header=True).count() == 2
    at = tmp_path / "base/loghub_2k/Apache"
    at.mkdir(parents=True)
    _write(at / "Apache_2k.log_structured.csv", "LineId,Content,EventTemplate\n1,a b1,a <*>\n2,a b2,a <*>\n3,stop,stop\n")
    assert jobs.main(["evaluate", "--base", str(tmp_path / "base"), "--system", "Apache", "--output-dir", str(tmp_path / "ev")]) == 0
    assert spark.read.json(str(tmp_path / "ev/metrics")).first().grouping_accuracy == 1.0


def test_merging_is_the_same_at_every_size(spark):
    rng = random.Random(11)
    words = [*"abcdefgh", "<OID>", "<LOI>", "<*>"]
    names = {" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(150)} | {"<OID> <LOI>", "<OID>", "<OID> <OID> <OID>", "a a a a", "a b", ""}
    names |= {f"{x} b c d e f g h i j" for x in ("alpha", "beta")}
    rows = [(t, rng.randrange(40)) for t in sorted(names)]
    df = spark.createDataFrame(rows, "template string, first_id long")
    for threshold in (0.5, 0.8, 0.9):
        want = sorted(templates.merge_templates(df, threshold).collect())
        assert sorted(templates.merge_templates(df, threshold, driver=0).collect()) == want
        assert 5 < sum(r.template != r.merged for r in want) < len(want)
    assert dict(templates.merge_templates(df, 0.8, driver=0).where("template like '%b c d e f%'").select("template", "merged").collect())["beta b c d e f g h i j"] == "alpha b c d e f g h i j"


def test_templates_of_variables_only(spark):
    df = spark.createDataFrame([("<OID> <LOI>",), ("<OBA> <OBA>",), ("a <OID>",), ("x y",)], "template string")
    got = {(r.first, r.second): r.score for r in templates.pair_matches(df).collect()}
    assert got[("<OBA> <OBA>", "<OID> <LOI>")] == 1.0 and got[("<OID> <LOI>", "a <OID>")] == 0.0 and ("x y", "a <OID>") not in got
    assert templates.merge_map(["<OID> <LOI>", "a", "<OBA> <OBA>"], 0.8) == ["<OID> <LOI>", "a", "<OID> <LOI>"]
    own = templates._place_similarity
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 7), (9, 2)):
        a, b = " ".join(["<OID>"] * n), " ".join(["<LOI>"] * m)
        assert math.isclose(one(spark, T.template_similarity(F.col("a"), F.col("b")), a=a, b=b), own(n, m))


def test_explainer_argument(spark):
    rows = [(i, f"2024-01-01 00:00:0{i}", "INFO", "c", "m", {"k": "1"}, [1.0, 0.0] if i else [0.0, 1.0]) for i in range(6)]
    logs = spark.createDataFrame(rows, "log_id long, timestamp string, level string, component string, message string, parameters map<string,string>, embedding array<float>")
    found = anomaly.detect(logs.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), explainer=lambda message, *more: F.concat(F.lit("see "), message)).collect()
    assert [(r.log_id, r.explanation) for r in found] == [(0, "see m")]
