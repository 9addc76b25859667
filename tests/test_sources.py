from __future__ import annotations

import pytest
from conftest import plan, rows
from pyspark.sql import types as T

from tillview.schemas import REQUIRED, has, is_empty, validate_inputs
from tillview.sources import files, star


def written(tmp_path, text):
    path = tmp_path / "table.csv"
    path.write_text(text)
    return str(path)


def test_transactions_csv(spark, tmp_path):
    path = written(tmp_path, 'transaction_id,customer_id,total_spent,order_date,in_cart_same_category,odd\n'
                   '1,7,12.5,2024-01-02 10:00:00,"[""Jeans"", ""Cap""]",x\n2,8,,,,\n')
    df = files.read_transactions(spark, path)
    assert dict(df.dtypes)["order_date"] == "timestamp_ntz" and dict(df.dtypes)["total_spent"] == "double"
    got = rows(df.orderBy("transaction_id"))
    assert got[0][4] == '["Jeans", "Cap"]' and got[0][5] == "x"
    assert got[1][2:] == (None, None, None, None)


def test_other_date_format(spark, tmp_path):
    path = written(tmp_path, "transaction_id,customer_id,total_spent,order_date\n1,7,1,31/12/2023\n")
    df = files.read_transactions(spark, path, date_format="dd/MM/yyyy")
    assert str(df.first()["order_date"]) == "2023-12-31 00:00:00"


def test_wide_features_and_types(spark, tmp_path):
    path = written(tmp_path, "customer_id,home_spend,home_pct\nC01,3.5,0.5\n")
    df = files.read_category_features(spark, path, types={"customer_id": T.StringType()})
    assert df.dtypes == [("customer_id", "string"), ("home_spend", "double"), ("home_pct", "double")]


def test_text_in_a_number_column_raises(spark, tmp_path):
    path = written(tmp_path, "customer_id,Recency,Frequency,Monetary\n1,soon,2,3\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        files.read_rfm(spark, path).collect()


def test_other_column_order_in_one_folder_raises(spark, tmp_path):
    folder = tmp_path / "rfm"
    folder.mkdir()
    (folder / "a.csv").write_text("customer_id,Recency,Frequency,Monetary\n1,2,10,3\n")
    (folder / "b.csv").write_text("customer_id,Frequency,Recency,Monetary\n2,10,2,3\n")
    with pytest.raises(Exception, match="header"):
        files.read_rfm(spark, str(folder)).collect()


def test_unlisted_category_raises(spark):
    bought = spark.sql("SELECT 1L AS customer_id, 'tea' AS product, 'food' AS category, CAST(3 AS DECIMAL(18, 4)) AS amount")
    with pytest.raises(Exception, match="unlisted category: food"):
        star.category_features(bought, ["toys"]).collect()
    row = star.category_features(bought, ["food", "toys"]).first()
    assert row["food_pct"] + row["toys_pct"] == 1
    assert star.top_category(star.category_features(bought, ["food", "toys"]), ["food", "toys"]).first()["top_category"] == "food"


def test_bundled_catalog_layout(spark, tmp_path):
    path = written(tmp_path, "category,product,price_inr\nElectronics,Smartphone (mid-range),29999\n")
    assert rows(files.read_catalog(spark, path)) == [("Electronics", "Smartphone (mid-range)", 29999.0)]


def test_parquet_by_month_prunes(spark, tmp_path):
    df = spark.sql("SELECT 1L AS transaction_id, 2L AS customer_id, 3D AS total_spent, "
                   "TIMESTAMP_NTZ '2024-02-03 00:00:00' AS order_date")
    path = files.write_parquet(df, str(tmp_path / "t"), partition_month=True)
    back = files.read_transactions(spark, path, format="parquet")
    assert back.filter("order_month = '2024-02'").count() == 1
    assert back.filter("order_month = '2024-03'").count() == 0


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a, b", '["x"]')], "A string, B string")
    for export in (files.export_tracking, files.export_top_customers):
        path = export(df, str(tmp_path), "20240101_000000")
        assert "20240101_000000" in path
        assert rows(spark.read.options(**files.CSV_OPTIONS).csv(path)) == [("a, b", '["x"]')]


def test_validate_inputs(spark):
    catalog = spark.createDataFrame([("c", "p")], "category string, product string")
    with pytest.raises(ValueError, match="catalog: no column price_inr; rfm: not loaded"):
        validate_inputs({"catalog": catalog, "rfm": None})
    whole = spark.createDataFrame([(1, 1, 1, 1.0)], list(REQUIRED["rfm"]))
    validate_inputs({"rfm": whole})


def test_has_and_empty(spark):
    df = spark.range(0)
    assert has(df, "id") and not has(df, "id", "x")
    assert is_empty(df) and not is_empty(spark.range(1))


def test_lists_of_recommendations_are_the_items_one_by_one(spark, tmp_path):
    """Parts that come twice and nameless ones as well: lists hold what ``recommended_items`` gives as rows."""
    date = "CAST('2001-01-0{}' AS timestamp_ntz)"
    tables = {
        "region": "SELECT 1 AS r_regionkey, 'R' AS r_name",
        "nation": "SELECT 1 AS n_nationkey, 'N' AS n_name, 1 AS n_regionkey",
        "customer": "SELECT id AS c_custkey, concat('C', id) AS c_name, 1 AS c_nationkey, 'S' AS c_mktsegment FROM range(1, 5)",
        "part": "SELECT id AS p_partkey, IF(id = 6, NULL, 'p') AS p_name, concat('Brand#', id % 3 + 1) AS p_brand, 1D AS p_retailprice "
                "FROM range(1, 10) UNION ALL SELECT 4L, 'p', 'Brand#2', 1D",
        "orders": f"SELECT id AS o_orderkey, id % 4 + 1 AS o_custkey, 5D AS o_totalprice, IF(id < 5, {date.format(1)}, {date.format(2)}) AS o_orderdate, "
                  "'1' AS o_orderpriority FROM range(1, 9)",
        "lineitem": "SELECT o AS l_orderkey, (o * 5 + n * 2) % 9 + 1 AS l_partkey, CAST(o + n AS double) AS l_extendedprice, 0D AS l_discount, "
                    "IF(n = 1, 'F', 'O') AS l_linestatus FROM (SELECT id AS o FROM range(1, 9)), (SELECT id AS n FROM range(1, 4))",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
    bought = star.bought_products(spark, str(tmp_path))
    features = star.category_features(bought)
    held = star.holdings(bought)
    assert sorted(rows(held.drop("held"))) == sorted(rows(features))
    matches = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.5), (4, None, None)], "customer_id long, Matched_Customer_ID long, Similarity_Score double")
    want = {}
    for customer, product, same in rows(star.recommended_items(matches, bought, features)):
        if product is not None:
            want.setdefault((customer, same), []).append(product)
    found = star.customer_recs(spark, str(tmp_path), matches=matches).collect()
    columns = {True: "Predicted_Products_from_Same_Category", False: "Predicted_Products_from_Other_Categories"}
    got = {(r["customer_id"], same): r[c].split(", ") for r in found for same, c in columns.items() if r[c]}
    assert len(found) == 4 and got == {k: sorted(v) for k, v in want.items()}
    assert any(len(set(v)) < len(v) for v in want.values())
    # A latest order holds the open lines of one order only.
    carts = {r["customer_id"]: (r["in_cart_same_category"], r["in_cart_other_category"]) for r in found}
    assert all(sum(len(x.split(", ")) for x in pair if x) <= 3 for pair in carts.values())


def test_lists_are_dealt_by_customer_once(spark, folder):
    built = plan(star.holdings(star.bought_products(spark, folder)))
    exchanges = [line for line in built.splitlines() if "Exchange hashpartitioning(" in line]
    # Both sums lie below no exchange but the one that deals the purchases.
    assert "REPARTITION_BY_COL" in exchanges[0] and "LeftAnti" not in plan(star.customer_recs(spark, folder))


def test_stored_lists_meet_matches_where_they_lie(spark, folder):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = plan(star.customer_recs(spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # Only the matches are dealt by the matched customer; own lists, features and matched lists are read in buckets.
    assert built.count("Exchange hashpartitioning(Matched_Customer_ID#") == 1
    assert built.count("Bucketed: true") == 4 and "BroadcastExchange" not in built


def test_lists_are_never_broadcast(spark, folder):
    built = plan(star.customer_recs(spark, folder))
    lists = [line for line in built.splitlines() if "FileScan" in line and "held#" in line]
    assert len(lists) == 2 and all("Bucketed: true" in line for line in lists)
