"""What the plans of references shuffle and join, as counted after a run."""

import shutil

from pyspark.sql import functions as F

from crossload.plans import migration, writing

SF = "/root/testdata/sf0.001"


def nodes(df):
    """The nodes of a plan that was run."""
    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan" or "QueryStage" in name:
            yield from walk(p.executedPlan() if name == "AdaptiveSparkPlan" else p.plan())
            return
        yield p
        for k in range(p.children().size()):
            yield from walk(p.children().apply(k))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def test_users_of_one_id_do_not_multiply_the_rows(spark, tmp_path):
    """111 suppliers of one id, whom all 6,000 lines name."""
    for t in ("supplier", "lineitem"):
        given = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "supplier":
            ids = spark.range(1000, 1001).unionByName(spark.range(10_000, 10_010)).unionByName(spark.range(100_000, 100_100))
            given = given.limit(1).drop("s_suppkey").crossJoin(ids.select(F.col("id").alias("s_suppkey"))).select(*given.columns)
        else:
            given = given.withColumn("l_suppkey", F.lit(1000).cast("long"))
        given.write.parquet(str(tmp_path / f"{t}.parquet"))
    shutil.copy(f"{SF}/nation.parquet", tmp_path)
    found = migration.resolve_assignees(spark, str(tmp_path))
    rows = found.collect()
    assert rows and all(set(r.users.split(";")) == {"U1000!"} and len(r.users.split(";")) % 111 == 0 for r in rows)
    lines = spark.read.parquet(str(tmp_path / "lineitem.parquet")).count()
    assert sum(p.metrics().apply("numOutputRows").value() for p in nodes(found) if "Join" in p.nodeName()) <= lines


def test_references_are_shuffled_once(spark):
    found = writing.resolve_parents(spark, SF)
    assert found.collect()
    assert [p.nodeName() for p in nodes(found)].count("Exchange") == 1
