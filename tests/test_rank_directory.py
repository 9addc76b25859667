"""Pages and keys from a stored rank directory, and quantile edges from sketches."""

from __future__ import annotations

import random

import pytest
from conftest import plan, rows

from tillview.operators import ranking
from tillview.operators.binning import qcut
from tillview.operators.rank_directory import PARTS, directory_page, page_of_key, stored_rows, write_rank_directory
from tillview.operators.sketches import rank_error_bound, sketched_edges, value_sketches


@pytest.fixture(scope="module")
def spent(spark):
    draw = random.Random(5)
    values = [(k, None if k % 17 == 0 else float(draw.randrange(300)), f"name {k}") for k in range(1003)]
    return spark.createDataFrame(values, "customer_id long, total_spent double, name string")


@pytest.fixture(scope="module")
def path(spent, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("directory") / "spent")
    kept = {k: spent.sparkSession.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spent.sparkSession.conf.set("spark.sql.shuffle.partitions", "8")
    spent.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    write_rank_directory(spent, folder)
    for key, value in kept.items():
        spent.sparkSession.conf.set(key, value)
    return folder


@pytest.mark.parametrize("number, size", [(-1, 10), (1, 10), (50, 10), (101, 10), (10**9, 7), (1, 5000), (3, 400)])
def test_pages_equal_a_sort(spark, spent, path, number, size):
    found = directory_page(spark, path, number, size)
    wanted = ranking.page(spent, number, size)
    assert found.columns == wanted.columns
    assert sorted(rows(found), key=lambda r: r[-1]) == sorted(rows(wanted), key=lambda r: r[-1])


def test_a_page_reads_few_parts(spark, path):
    parts = spark.read.parquet(f"{path}/{PARTS}")
    assert parts.count() >= 6
    found = directory_page(spark, path, 50, 10)
    text = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in text and "part#" in text
    assert "Exchange" not in plan(found)
    named = stored_rows(spark, path).filter("number between 491 and 500").select("part").distinct().count()
    assert named <= 2


def test_page_of_key(spark, spent, path):
    numbered = rows(ranking.global_rank(spent, [spent["total_spent"].desc_nulls_last(), "customer_id"], "number"))
    for key, value, _, number in numbered[::97]:
        assert page_of_key(spark, path, value, key) == (number - 1) // 10 + 1
    assert page_of_key(spark, path, 1e9, 0) == 1
    assert page_of_key(spark, path, None, 10**9) == 101


def test_an_empty_table_has_one_empty_page(spark, spent, tmp_path):
    folder = str(tmp_path / "none")
    write_rank_directory(spent.limit(0), folder)
    assert rows(directory_page(spark, folder, 3)) == []
    assert page_of_key(spark, folder, 5.0, 1) == 1


def test_sketched_edges(spark):
    draw = random.Random(9)
    values = [("a" if k % 3 else "b", draw.gauss(0, 100)) for k in range(30000)] + [("b", None), ("b", float("nan")), ("c", None), (None, 1.0)]
    table = spark.createDataFrame(values, "kind string, x double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    parts = value_sketches(table, "x", ["kind"])
    found = {r[0]: r[1:] for r in rows(sketched_edges(parts, probs, ["kind"]))}
    assert found["c"] == (None, 0) and found[None] == ([1.0] * 5, 1)
    for kind in ("a", "b"):
        mine = sorted(v for k, v in values if k == kind and v is not None and v == v)
        assert found[kind][1] == len(mine)
        for p, edge in zip(probs, found[kind][0], strict=True):
            assert edge in mine
            assert abs(mine.index(edge) / len(mine) - p) <= 2 * rank_error_bound()
    edges = sketched_edges(parts, [1 / 3, 2 / 3])
    assert "rangepartitioning" not in plan(edges)
    assert rows(edges)[0][1] == sum(v is not None and v == v for _, v in values)
    counts = {r[0]: r[1] for r in rows(qcut(table.filter("x > -1e9 and not isnan(x)"), "x", ["low", "mid", "high"], "third", edges.select("edges")).groupBy("third").count())}
    assert all(abs(n / 30001 - 1 / 3) <= 3 * rank_error_bound() for n in counts.values())


def test_no_values(spark):
    table = spark.createDataFrame([], "x double")
    assert rows(sketched_edges(value_sketches(table, "x"), [0.5])) == [(None, 0)]
