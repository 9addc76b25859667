from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from tillview.operators import binning, ranking, scoring


def frame(spark, numbers, kind="double"):
    data = [(i, x) for i, x in enumerate(numbers)]
    return spark.createDataFrame(data, f"customer_id long, x {kind}").repartition(5)


def by_id(df, column):
    return [r[column] for r in df.orderBy("customer_id").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_quantile_edges_match_pandas(spark, seed):
    draw = random.Random(seed)
    numbers = [draw.choice([None, round(draw.uniform(0, 50), draw.choice([0, 2]))]) for _ in range(draw.randint(5, 300))]
    numbers.append(1.0)
    probs = [0.0, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    edges = binning.quantile_edges(frame(spark, numbers), "x", probs).first()["edges"]
    assert np.allclose(edges, pd.Series(numbers, dtype=float).quantile(probs))


def test_quantile_edges_by_group(spark):
    draw = random.Random(7)
    data = [(draw.choice("abc"), draw.randint(0, 30)) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, x long")
    got = {r["k"]: list(r["edges"]) for r in binning.quantile_edges(df, "x", [0.25, 0.5, 0.75], ["k"]).collect()}
    want = pd.DataFrame(data, columns=["k", "x"]).groupby("k")["x"].quantile([0.25, 0.5, 0.75])
    for k, edges in got.items():
        assert np.allclose(edges, want[k])


@pytest.mark.parametrize("n", [1, 2, 6, 101])
def test_global_rank_matches_window(spark, n):
    draw = random.Random(n)
    df = frame(spark, [float(draw.randint(0, 5)) for _ in range(n)])
    ranked = ranking.global_rank(df, ["x", "customer_id"])
    want = spark.createDataFrame(
        pd.DataFrame(rows(df), columns=["customer_id", "x"]).sort_values(["x", "customer_id"])
        .assign(rank=range(1, n + 1))
    )
    assert sorted(rows(ranked)) == sorted(rows(want))


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 50, 131])
def test_f_score_matches_pandas(spark, n):
    draw = random.Random(n)
    numbers = [draw.randint(1, 9) for _ in range(n)]
    df = frame(spark, numbers, "long").withColumnRenamed("x", "Frequency")
    ranks = pd.Series(numbers).rank(method="first")
    want = list(pd.qcut(ranks, 4, labels=[1, 2, 3, 4]).astype(int))
    assert by_id(binning.f_score(df), "F_Score") == want


def test_f_score_edges(spark):
    six = frame(spark, [10, 20, 30, 40, 50, 60], "long")
    assert by_id(binning.f_score(six, "x"), "F_Score") == [1, 1, 2, 3, 4, 4]
    assert by_id(binning.f_score(frame(spark, [5], "long"), "x"), "F_Score") == [1]
    assert by_id(binning.f_score(frame(spark, [5, None], "long"), "x"), "F_Score") == [1, None]


@pytest.mark.parametrize("seed", range(3))
def test_qcut_matches_pandas(spark, seed):
    draw = random.Random(seed)
    # 3k or 3k + 2 values: with 3k + 1 a third falls on a value, where pandas rounds 2/3 through
    # percent and may land just below it.
    numbers = [draw.uniform(0, 1000) for _ in range(3 * draw.randint(3, 60) + draw.choice([0, 2]))]
    cut = binning.qcut(frame(spark, numbers), "x", ["a", "b", "c"], "label")
    assert by_id(cut, "label") == list(pd.qcut(pd.Series(numbers), 3, labels=["a", "b", "c"]))


def test_qcut_edge_on_a_value(spark):
    cut = binning.qcut(frame(spark, [float(x) for x in range(1, 8)]), "x", ["a", "b", "c"], "label")
    assert by_id(cut, "label") == ["a", "a", "a", "b", "b", "c", "c"]


def test_qcut_repeated_edges(spark):
    cut = binning.qcut(frame(spark, [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, None]), "x", ["a", "b", "c"], "label")
    assert by_id(cut, "label") == ["a"] * 5 + ["c", None]


def test_propensity_category(spark):
    df = frame(spark, [0.0, 1e-9, 0.3, 0.30001, 0.6, 0.61, 1.0, 1.01, None])
    got = by_id(df.withColumn("c", binning.propensity_category("x")), "c")
    assert got == [None, "Low", "Low", "Medium", "Medium", "High", "High", None, None]


def test_histogram(spark):
    got = rows(binning.histogram(frame(spark, [0.0, 1.0, 2.0, 10.0, None]), "x", 5).orderBy("bin"))
    assert [r[3] for r in got] == [2, 1, 0, 0, 1]
    assert got[0][1:3] == (0.0, 2.0) and got[-1][2] == 10.0
    flat = rows(binning.histogram(frame(spark, [3.0, 3.0]), "x", 4).orderBy("bin"))
    assert [r[3] for r in flat] == [2, 0, 0, 0]


def test_segments(spark):
    df = spark.createDataFrame([(i,) for i in range(3, 13)], "s int")
    got = [r[0] for r in df.orderBy("s").select(scoring.rfm_segment(F.col("s"))).collect()]
    assert got == ["Lost"] * 2 + ["At Risk"] + ["Potential Loyalists"] * 2 + ["Loyal Customers"] * 2 + ["Champions"] * 3


def test_rfm_segments_match_pandas(spark):
    draw = random.Random(3)
    data = [(i, draw.randint(1, 900), draw.randint(1, 30), draw.uniform(10, 9999)) for i in range(240)]
    df = spark.createDataFrame(data, "customer_id long, Recency int, Frequency long, Monetary double")
    p = pd.DataFrame(data, columns=df.columns)
    score = (pd.qcut(p.Recency, 4, labels=[4, 3, 2, 1]).astype(int)
             + pd.qcut(p.Frequency.rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
             + pd.qcut(p.Monetary, 4, labels=[1, 2, 3, 4]).astype(int))
    got = scoring.rfm_segments(df)
    assert by_id(got, "RFM_Score") == list(score)
    assert got.filter("Segment IS NULL").count() == 0
    with_null = df.unionByName(spark.createDataFrame([(999, None, 4, 5.0)], df.schema))
    assert scoring.rfm_segments(with_null).filter("customer_id = 999").first()["Segment"] is None


def test_rank_plan_has_no_whole_table_window(spark, folder):
    orders = spark.range(1000).select(F.col("id").alias("customer_id"), (F.col("id") % 7).alias("Frequency"))
    text = plan(binning.f_score(orders))
    # The one unpartitioned window runs over the sort partitions' sizes.
    assert text.count("Window ") == 1 and "windowspecdefinition(_part" in text
