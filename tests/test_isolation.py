from lumenlog.operators import cluster


def test_forest_is_drawn_from_all_rows(spark):
    """Five vectors of 200 rows each and 40 rows drawn: all of one vector would score everything 0.5."""
    train = spark.createDataFrame([(i, float(i % 5), float(i % 5 % 2)) for i in range(1000)], "log_id long, x double, y double")
    rows = spark.createDataFrame([(1, 2.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0)], train.schema)
    got = {r.log_id: r.score for r in cluster.isolation_scores(train, rows, ["x", "y"], ["log_id"], max_train=40).collect()}
    assert len({round(s, 6) for s in got.values()}) > 1 and all(s != 0.5 for s in got.values())
