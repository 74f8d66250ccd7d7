import itertools

import numpy as np

from lumenlog.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"


def test_markers():
    assert C.marker("User: hi") == (1, "hi") and C.marker("### Assistant") == (2, "") and C.marker("<|im_start|>system") == (0, "")
    assert C.marker("Note: hi")[0] == C.N and C.marker("user")[0] == C.N and C.marker("[Bot] yes") == (2, "yes")


def model(spark):
    rows = []
    for c in range(60):
        for t in range(6):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "How is it?" if t % 2 == 0 else "- it is fine\n- and long " + "x" * 80))
    return C.fit(spark.createDataFrame(rows, SCHEMA))


def brute(hmm, conv):
    """Best labels of the lines of [(role, text)] by trying all."""
    es = [hmm.emissions(C.features(t, r)[0]) for r, t in conv]
    best = (-np.inf, None)
    for path in itertools.product(range(C.N), repeat=sum(map(len, es))):
        at, total, prev = 0, 0.0, None
        for e in es:
            for k, x in enumerate(e):
                s = path[at]
                total += x[s] + (hmm.start[s] if prev is None else hmm.turn[prev, s] if k == 0 else hmm.line[prev, s])
                prev, at = s, at + 1
        if total > best[0]:
            best = (total, path)
    return [C.ROLES[k] for k in best[1]]


def test_recovers_roles_like_brute_force(spark):
    hmm = model(spark)
    convs = {1: [(None, "How?"), ("???", "- fine"), (None, "Why?"), ("bot", "- so")], 2: [("human", "User: a\nAssistant: b"), (None, "c?")], 3: [(None, "- one\n- two"), (None, "x?")]}
    rows = [(c, t, r, x) for c, v in convs.items() for t, (r, x) in enumerate(v)]
    for n in (1, 2, 5):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = C.parse(spark.createDataFrame(rows, SCHEMA), hmm).orderBy("conv_id", "turn", "part").collect()
        for c, v in convs.items():
            lines = [r.role for r in got if r.conv_id == c for _ in range(r.n_lines)]
            assert lines == brute(hmm, v)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.rendered for r in got if r.conv_id == 2][:2] == ["<|im_start|>user\na<|im_end|>\n", "<|im_start|>assistant\nb<|im_end|>\n"]


def test_long_conversation_in_many_partitions_is_one(spark):
    hmm = model(spark)
    rows = [(7, t, "system" if t == 0 else None, "How is it?" if t % 2 else "- it is fine") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = [r.role for r in C.parse(df.coalesce(1), hmm).orderBy("turn").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    many = [r.role for r in C.parse(df, hmm).orderBy("turn").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert one == many and one[0] == "system" and set(one[1::2]) == {"user"} and set(one[2::2]) == {"assistant"}


def test_op5_query_against_the_given_roles(spark, sf):
    from lumenlog.llm.queries import op5_chat

    want = {(r.conv_id, r.turn): r.role for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = op5_chat(spark, sf).collect()
    assert {(r.conv_id, r.turn): r.role for r in got} == want
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    from pyspark.sql import functions as F

    blind = C.parse(df.withColumn("role", F.lit(None).cast("string")), C.fit(df)).collect()
    assert sum(want[r.conv_id, r.turn] == r.role for r in blind) >= 0.85 * len(blind)


def test_odd_tables(spark):
    rows = [(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, None, "USER ", "a<|im_end|>b")]
    got = C.parse(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", part int")).collect()
    assert len(got) == 4 and any("a<| im_end |>b" in r.rendered for r in got)
    assert C.parse(spark.createDataFrame([], SCHEMA)).count() == 0


def test_model_and_roles_do_not_depend_on_partitions(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    models, kept = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 8, 200):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        models.append(C.fit(df, "conv_id", "turn", "role", "text"))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    for m in models[1:]:
        assert (m.start == models[0].start).all() and (m.turn == models[0].turn).all() and all((a == b).all() for a, b in zip(m.emit, models[0].emit, strict=True))


def test_long_texts(spark):
    df = spark.createDataFrame([(1, 0, None, "User: hi\n" + "a line?\n" * 20_000), (1, 1, "assistant", "x" * 500_000)], SCHEMA)
    got = C.parse(df, C.fit(df)).orderBy("turn", "part").collect()
    assert sum(r.n_lines for r in got) == 20_003 and got[-1].role == "assistant"
