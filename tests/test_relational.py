"""Shared joins and groupings on small tables."""

from pyspark.sql import functions as F

from forkline.operators import relational as R


def test_relational(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([("x", "p"), ("y", "q"), ("y", "r")], "k string, w string")
    got = {(r["k"], r["place"]): (r["v"], r["w"]) for r in R.zip_rows(a, b, ["k"], ["v"], ["w"]).collect()}
    assert got == {("x", 1): (1, "p"), ("x", 2): (2, None), ("y", 1): (3, "q"), ("y", 2): (None, "r")}
    nodes = spark.createDataFrame([("1", "t"), ("2", "u")], "node_id string, text_content string")
    edges = spark.createDataFrame([("1", 1, "b"), ("1", 0, "a")], "source_id string, position int, edge_text string")
    assert {r["id"]: r["text"] for r in R.tagged_from_tables(nodes, edges).collect()} == {"1": "t <choice>a</choice> <choice>b</choice>", "2": "u"}
    assert R.tagged_from_tables(nodes, edges, ["2"]).count() == 1
    assert R.with_default(a.select("k").distinct(), b.where("k = 'x'"), "k", "w", F.lit("?")).orderBy("k").collect()[1]["w"] == "?"
    assert tuple(R.set_counts(a.select("k", "v"), a.where("v > 1").select("k", "v"), ["k", "v"]).first()) == (1, 0, 2)
    assert {r["v"]: r["share"] for r in R.share(a, "v", ["k"]).collect()} == {1: 1 / 3, 2: 2 / 3, 3: 1.0}
    assert {r["v"]: r["delta"] for r in R.change_from(a, "v", F.col("v") == 1, ["k"]).collect()} == {1: 0, 2: 1, 3: None}
    assert {r["delta"] for r in R.change_from(a, "v", F.col("v") == 3).collect()} == {-2, -1, 0}
