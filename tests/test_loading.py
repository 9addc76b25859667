"""Readers with missing-value words and rejects, the load cache, and the input report."""

from __future__ import annotations

import pytest
from conftest import plan, rows
from pyspark.sql import types as T

from tillview.plans import business
from tillview.schemas import input_report
from tillview.session import TableCache
from tillview.sources import files


def write(tmp_path, text, name="table.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_missing_words_are_null(spark, tmp_path):
    words = [w for w in files.MISSING_WORDS if w]
    path = write(tmp_path, "customer_id,Recency,Frequency,Monetary\n" + "".join(f"{i},{w}, {w} ,{w}\n" for i, w in enumerate(words)))
    got = rows(files.read_rfm(spark, path).orderBy("customer_id"))
    assert got == [(i, None, None, None) for i in range(len(words))]
    text = write(tmp_path, "customer_id,product\n1,NA\n2,Banana\n3,nan\n", "text.csv")
    assert rows(files.read_purchases(spark, text).orderBy("customer_id")) == [(1, None), (2, "Banana"), (3, None)]


def test_whole_numbers_written_with_a_point(spark, tmp_path):
    path = write(tmp_path, "customer_id,Recency,Frequency,Monetary\n9007199254740993.0,3.0,4.00,5\n")
    assert rows(files.read_rfm(spark, path)) == [(9007199254740993, 3, 4, 5.0)]
    half = write(tmp_path, "customer_id,Recency,Frequency,Monetary\n1,3.5,4,5\n", "half.csv")
    with pytest.raises(Exception, match="Recency is no int: 3.5"):
        files.read_rfm(spark, half).collect()


def test_broken_line_raises_or_is_set_apart(spark, tmp_path):
    folder = tmp_path / "rfm"
    folder.mkdir()
    write(folder, "customer_id,Recency,Frequency,Monetary\n1,2,3,4\n2,2,3\n3,2,3,4,5\n", "a.csv")
    write(folder, "customer_id,Recency,Frequency,Monetary\n4,soon,x,4\nNA,1,2,3\n6,,NaN,inf\n", "b.csv")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_rfm(spark, str(folder)).collect()
    loaded = files.read_with_rejects(spark, "rfm", str(folder))
    assert sorted(rows(loaded.rows)) == [(1, 2, 3, 4.0), (6, None, None, float("inf"))]
    found = {(r.file[-5:], r.text, r.reason) for r in loaded.rejects.collect()}
    assert found == {
        ("a.csv", "2,2,3", "wrong number of fields"), ("a.csv", "3,2,3,4,5", "wrong number of fields"),
        ("b.csv", "4,soon,x,4", "Recency is no int; Frequency is no bigint"), ("b.csv", "NA,1,2,3", "customer_id is missing"),
    }
    counts = {(r.file[-5:], r.reason): r.n_rows for r in loaded.reject_counts().collect()}
    assert counts["a.csv", "wrong number of fields"] == 2 and len(counts) == 3


def test_dates_and_text_ids(spark, tmp_path):
    path = write(tmp_path, "transaction_id,customer_id,total_spent,order_date\n1,C7,1,31/12/2023\n2,C8,NA,2023-12-31\n3,C9,2,n/a\n")
    options = {"date_format": "dd/MM/yyyy", "types": {"customer_id": T.StringType()}}
    with pytest.raises(Exception, match="order_date is no timestamp_ntz: 2023-12-31"):
        files.read_transactions(spark, path, **options).collect()
    loaded = files.read_with_rejects(spark, "transactions", path, **options)
    assert [(r.transaction_id, r.customer_id, str(r.order_date)) for r in loaded.rows.orderBy("transaction_id").collect()] == [
        (1, "C7", "2023-12-31 00:00:00"), (3, "C9", "None")
    ]
    assert [r.reason for r in loaded.rejects.collect()] == ["order_date is no timestamp_ntz"]


def test_empty_file_has_no_rows_and_no_rejects(spark, tmp_path):
    loaded = files.read_with_rejects(spark, "rfm", write(tmp_path, "customer_id,Recency,Frequency,Monetary\n"))
    assert loaded.rows.count() == 0 and loaded.rejects.count() == 0


def test_parquet_gets_the_declared_types(spark, tmp_path):
    raw = spark.sql("SELECT 1 AS transaction_id, '7' AS customer_id, CAST('NaN' AS DOUBLE) AS total_spent, '31/12/2023' AS order_date, 5 AS odd")
    raw.write.parquet(str(tmp_path / "t"))
    df = files.read_transactions(spark, str(tmp_path / "t"), format="parquet", date_format="dd/MM/yyyy")
    assert df.dtypes == [
        ("transaction_id", "bigint"), ("customer_id", "bigint"), ("total_spent", "double"), ("order_date", "timestamp_ntz"), ("odd", "int")
    ]
    assert str(df.first()) == "Row(transaction_id=1, customer_id=7, total_spent=None, order_date=datetime.datetime(2023, 12, 31, 0, 0), odd=5)"
    text = files.read_transactions(
        spark, str(tmp_path / "t"), format="parquet", date_format="dd/MM/yyyy", types={"customer_id": T.StringType()}
    )
    assert text.first()["customer_id"] == "7"


def test_only_read_columns_are_parsed(spark, tmp_path):
    path = write(tmp_path, "customer_id,Recency,Frequency,Monetary\n1,2,3,4\n")
    assert "ReadSchema: struct<Recency:string>" in plan(files.read_rfm(spark, path).select("Recency"))


def test_cache_reads_once_until_files_change(spark, tmp_path):
    cache, folder = TableCache(), tmp_path / "rfm"
    folder.mkdir()
    write(folder, "customer_id,Recency,Frequency,Monetary\n1,2,3,4\n", "a.csv")
    first = cache.load(files.read_rfm, spark, str(folder))
    assert first.count() == 1 and "InMemoryTableScan" in plan(first.select("*"))
    assert cache.load(files.read_rfm, spark, str(folder)) is first
    assert cache.load(files.read_rfm, spark, str(folder), types={"customer_id": T.StringType()}) is not first
    write(folder, "customer_id,Recency,Frequency,Monetary\n2,2,3,4\n", "b.csv")
    second = cache.load(files.read_rfm, spark, str(folder))
    assert second is not first and second.count() == 2
    cache.clear()
    assert not second.is_cached


def test_input_report(spark):
    catalog = spark.createDataFrame([("c", "p")], "category string, product string")
    rfm = spark.createDataFrame([], "customer_id long, Recency int, Frequency long, Monetary double")
    got = {r["table"]: (r["n_rows"], r["is_empty"], r["missing"]) for r in input_report({"catalog": catalog, "rfm": rfm}).collect()}
    assert got == {"catalog": (1, False, "price_inr"), "rfm": (0, True, "")}


def test_page_names_absent_columns_first(spark):
    orders = spark.createDataFrame([(1, 2)], "transaction_id long, customer_id long")
    one = spark.createDataFrame([(1, "p")], "customer_id long, product string")
    with pytest.raises(ValueError, match="transactions: no column total_spent; rfm: no column Recency, Frequency, Monetary"):
        business.business_page(orders, one, one, one, spark.createDataFrame([("c", "p", 1.0)], "category string, product string, price_inr double"))
