"""Pairs of vectors, components and their members on small inputs."""

import duckdb
import numpy as np
import pytest
from brevier.operators import planner, similarity
from brevier.plans import queries as plans
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def crowd(spark):
    """300 vectors of which 150 are near copies, and their pairs from 0.4 on."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[::2] = x[0] + 0.01 * rng.normal(size=(150, 16))
    x[1::2] *= 1 - 2 * (x[1::2] @ x[0] > 0)[:, None]  # the others look away
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = {(int(a), int(b)) for a, b in np.argwhere(u @ u.T >= 0.4) if a != b}
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, (300, None)], "vec_id long, embedding array<double>"), links


@pytest.mark.parametrize("block", [64, 4096])
def test_forest_connects_what_the_pairs_do(crowd, monkeypatch, block):
    vectors, links = crowd
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "STRIP", 50)
    first = list(range(300))
    for _ in range(300):
        for a, b in links:
            first[a] = min(first[a], first[b])
    forest = similarity.similarity_forest(vectors, 0.4)
    assert forest.count() < len(links) / 4
    got = similarity.connected(vectors.where("vec_id < 300").select(F.col("vec_id").alias("id")), forest)
    assert {r["id"]: r["component"] for r in got.collect()} == dict(enumerate(first))


def test_members_of_a_large_component_come_from_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(planner, "ROWS", 1 << 19, raising=False)
    ids = spark.range(3000)
    comp = ids.select("id", F.when(F.col("id") < 2990, 0).otherwise(F.col("id")).alias("component"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for components too large to send to all tasks
    try:
        got = planner.cluster_of(comp, ids.select((F.col("id") * 2).alias("id")))
        by = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(by) == 1495 * 2990 + 5 + 1500 and max(by) < 0.8 * sum(by)
        sums = got.groupBy("asked").agg(F.count("*"), F.sum("member")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {tuple(r) for r in sums} == {(i, 2990, 2989 * 1495) if i < 2990 else (i, 1, i) for i in range(0, 6000, 2)}


def test_no_neighbour_is_lost_in_a_crowd(crowd):
    vectors, links = crowd
    assert max(np.bincount([a for a, _ in links])) > 100
    got = planner.kept_neighbours(vectors, vectors.where("vec_id % 3 <> 1").select(F.col("vec_id").alias("id")), 0.4)
    wanted = sorted((a, b) for a, b in links if a % 3 != 1 and b % 3 != 1)
    assert sorted(map(tuple, got.collect())) == wanted


def test_crowded_neighbours_against_sql(spark, tmp_path):
    """150 near copies among the candidates, and cosines of 0.4 exactly."""
    candidates = [k for k in range(5000) if k % 6 in (2, 3, 4) and k // 6 % 6 in (2, 3, 4) and k // 36 % 6 < 2][:160]
    rng = np.random.default_rng(5)
    x = np.zeros((160, 64), "f4")
    x[:, :8] = 1 + 0.01 * rng.normal(size=(160, 8))
    x[150:] = 0
    for k in range(150, 160):
        x[k, 10:15] = (1, 1, 0, 0, 0) if k % 2 else (2, 2, 5, 4, 1)
    spark.createDataFrame([(k, "text", "en", "web") for k in candidates], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(k, [float(v) for v in r], 0) for k, r in zip(candidates, x, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("candidate_neighbours", "similarity_edges"):
        theirs = con.execute(plans.oracle_sql()[name]).fetchall()
        assert len(theirs) == 150 * 149 + 90
        assert sorted(map(tuple, plans.queries()[name](spark, str(tmp_path)).collect())) == sorted(theirs)
