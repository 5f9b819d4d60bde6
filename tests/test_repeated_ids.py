"""Queries over tables in which source ids repeat: keys of over six digits are cut where the exports spell them."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from crossload.plans import migration, shapes, writing  # noqa: F401  they add their queries
from crossload.plans import queries as q

SF = "/root/testdata/sf0.001"
GIVEN = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "conversations", "benchmark")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables of sf0.001 with two to three rows for an id: orders 100,000 + k, 1,000,000 + 10 k and 1,000,001 + 10 k
    are all J10000k, suppliers 1,000 + k and 10,000 + 10 k are all U100k; order lines repeat theirs."""
    top = str(tmp_path_factory.mktemp("repeated"))
    changed = {
        "orders": ("o_orderkey", lambda k: k + 100_000, lambda k: 1_000_000 + 10 * k, lambda k: 1_000_001 + 10 * k),
        "supplier": ("s_suppkey", lambda k: k + 1000, lambda k: 10_000 + 10 * k), "lineitem": ("l_suppkey", lambda k: k + 1000)}
    for t in GIVEN:
        if t not in changed:
            shutil.copy(f"{SF}/{t}.parquet", top)
            continue
        key, *made = changed[t]
        every = given = spark.read.parquet(f"{SF}/{t}.parquet")
        for change in made:
            every = every.unionByName(given.withColumn(key, change(F.col(key))))
        every.write.parquet(f"{top}/{t}.parquet")
    return top


@pytest.mark.parametrize("name", ["apply_outcomes", "form_job", "resolve_assignees", "resolve_parents", "parent_warnings"])
def test_oracle_where_ids_repeat(spark, folder, name):
    got = q.QUERIES[name](spark, folder)
    cols = sorted(got.columns)
    con = duckdb.connect()
    for t in GIVEN:
        at = f"{folder}/{t}.parquet"
        con.sql(f"create view {t} as from '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    want = con.sql(f"select {','.join(cols)} from ({q.SQL[name]}) t").fetchall()
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(got.select(*cols).collect()) == plain(want)
