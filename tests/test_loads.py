"""Loads that can be repeated: manifest, versions, commits, record order."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salescope.operators.clean import clean_sales
from salescope.operators.star_build import build_stores
from salescope.sources import loads as ld
from salescope.sources.raw import read_sales_csv

HEADER = "Date,Store_Location,Store_Rating,Product_Category,Unit_Price,Revenue"
A = ["2024-01-01,Alpha,4.0,Toys,5.0,100.0", "2024-01-02,Beta,3.0,Toys,5.0,200.0"]
B = ["2024-01-03,Gamma,2.0,Toys,5.0,7.0", "2024-01-03,Beta,1.0,Books,9.0,3.0"]


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([HEADER, *rows]) + "\n")
    return str(folder / name)


def revenue(star):
    return {r.store_location: r.r for r in star.transactions.join(star.stores, "store_id")
            .groupBy("store_location").agg(F.sum("revenue").alias("r")).collect()}


def test_repeated_load_adds_nothing(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "star")
    a, b = write(src, "a.csv", A), write(src, "b.csv", B)
    again = write(src, "copy_of_a.csv", A)
    one = ld.load_files(spark, [a], root)
    assert one.version == 1 and len(one.loaded) == 1 and one.rejected.count() == 0
    two = ld.load_files(spark, [str(src)], root)
    assert two.version == 2 and [os.path.basename(p) for p in two.loaded] == ["b.csv"]
    assert sorted(os.path.basename(p) for p in two.skipped) == ["a.csv", "copy_of_a.csv"]
    three = ld.load_files(spark, [a, b, again], root)
    assert three.version is None and three.loaded == []
    star = ld.read_loaded_star(spark, root)
    assert revenue(star) == {"Alpha": Decimal(100), "Beta": Decimal(203), "Gamma": Decimal(7)}
    assert star.stores.count() == 3 and star.products.count() == 2
    assert star.transactions.select("transaction_id").distinct().count() == 4
    rating = {r.store_location: r.store_rating for r in star.stores.collect()}
    assert rating["Beta"] == 3.0                      # a known store keeps its rating
    assert ld.manifest(spark, root).count() == 2
    before = ld.read_loaded_star(spark, root, version=1)
    assert revenue(before) == {"Alpha": Decimal(100), "Beta": Decimal(200)}


def test_equal_files_of_one_call_load_once(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "star")
    write(src, "b.csv", A), write(src, "a.csv", A)
    (src / "empty.csv").write_text("")
    got = ld.load_files(spark, [str(src)], root)
    assert [os.path.basename(p) for p in got.loaded] == ["a.csv"]
    assert ld.read_loaded_star(spark, root).transactions.count() == 2


@pytest.mark.parametrize("at", ["write_facts", "commit"])
def test_failed_load_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch, at):
    src, root = tmp_path / "in", str(tmp_path / "star")
    a, b = write(src, "a.csv", A), write(src, "b.csv", B)
    ld.load_files(spark, [a], root)

    def fail(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ld, at, fail)
        with pytest.raises(RuntimeError):
            ld.load_files(spark, [b], root)
    assert ld.read_loaded_star(spark, root).transactions.count() == 2
    assert ld.load_files(spark, [a, b], root).version == 2
    assert revenue(ld.read_loaded_star(spark, root))["Beta"] == Decimal(203)


def test_a_version_is_committed_once(spark, tmp_path):
    root = str(tmp_path / "star")
    ld.commit(spark, root, 1, "x")
    with pytest.raises(Exception, match="exist"):
        ld.commit(spark, root, 1, "y")
    assert ld.committed_loads(spark, root) == ["x"]


def test_empty_star(spark, tmp_path):
    root = str(tmp_path / "none")
    star = ld.read_loaded_star(spark, root)
    assert star.transactions.count() == 0 and ld.manifest(spark, root).count() == 0


def test_first_row_wins_in_file_order(spark, tmp_path):
    """A small first file and a large second one, cut into many blocks."""
    src = tmp_path / "in"
    write(src, "a.csv", ["2024-01-01,Alpha,1.0,Toys,5.0,1.0"])
    write(src, "b.csv", [f"2024-01-02,{s},{2 + i % 3}.5,Toys,5.0,{i}"
                         for i in range(20000) for s in ("Alpha", f"S{i % 7}")][:20000])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        raw = read_sales_csv(spark, str(src))
        rows = raw.orderBy("_row").select("Revenue").collect()
        assert [r[0] for r in rows] == [1.0] + [float(i // 2) for i in range(20000)]
        stores = {r.store_location: (r.store_id, r.store_rating)
                  for r in build_stores(clean_sales(raw).rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert stores["Alpha"] == (1, 1.0) and stores["S0"] == (2, 2.5) and stores["S1"] == (3, 3.5)


def test_quoted_line_breaks(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "a.csv", ['2024-01-01,"Alpha\nNorth",1.0,"To""ys",5.0,1.0', *A])
    rows = read_sales_csv(spark, str(src), multi_line=True).orderBy("_row").collect()
    assert [r.Store_Location for r in rows] == ["Alpha\nNorth", "Alpha", "Beta"]
    assert rows[0].Product_Category == 'To"ys'
