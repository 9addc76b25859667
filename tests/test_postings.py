from __future__ import annotations

import pytest
from conftest import plan, rows

from tillview.operators import filters, postings


@pytest.fixture(scope="module")
def recs(spark):
    data = [(1, "Red Hat, blue cap"), (2, "red hat"), (3, None), (4, ""), (5, "Red Hat (mid-range), Schal"), (6, " blue cap ,, blue cap"), (7, "HAT")]
    data += [(100 + i, f"Red Hat, item {i}") for i in range(50)]
    return spark.createDataFrame(data, "customer_id long, purchased_products_names string")


@pytest.fixture(scope="module")
def index(spark, recs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("postings") / "p")
    return postings.read_postings(spark, postings.write_postings(recs, path))


@pytest.mark.parametrize("wanted", [["RED HAT"], ["blue cap", "hat"], ["Red Hat (mid-range)"], ["none such"], ["item 7", "schal"], [], None])
def test_same_rows_as_the_list_test(recs, index, wanted):
    got = sorted(rows(postings.bought_any_of_indexed(recs, index, wanted)))
    assert got == sorted(rows(filters.bought_any_of(recs, wanted)), key=lambda r: r[0])


def test_vocabulary(recs, index):
    assert rows(postings.indexed_vocabulary(index)) == rows(filters.product_vocabulary(recs))


def test_only_folders_of_the_products_are_read(index):
    text = plan(postings.buyers_of_any(index, ["Red Hat", "hat"]))
    assert "purchased_products_names" not in text and "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters: [")[1][:80]
    files = postings.buyers_of_any(index, ["Red Hat", "hat"]).inputFiles()
    assert 0 < len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 64
    assert "In(item" in text or "item IN" in text


def test_empty(spark, recs, tmp_path):
    path = postings.write_postings(recs.limit(0), str(tmp_path / "none"))
    assert postings.bought_any_of_indexed(recs, postings.read_postings(spark, path), ["hat"]).count() == 0
