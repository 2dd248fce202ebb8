"""Counts taken while tables are staged, against counts of the rows."""

from pyspark.sql import functions as F

from salescope.operators import star_build as sb
from salescope.operators.clean import clean_sales
from salescope.sources.raw import read_sales_csv
from tests.test_clean import HEADER, ROWS


def sales(spark, tmp_path, rows):
    (tmp_path / "sales.csv").write_text("\n".join([HEADER, *rows]) + "\n")
    return read_sales_csv(spark, str(tmp_path / "sales.csv"))


def test_observed_report_equals_lazy_report(spark, tmp_path):
    raw = sales(spark, tmp_path, ROWS)
    a, b = clean_sales(raw), clean_sales(raw, materialize=False)
    assert a.report.collect() == b.report.collect()
    assert a.rows.orderBy("_row").drop("_row").collect() == b.rows.orderBy("_row").drop("_row").collect()
    assert "csv" not in a.report._jdf.queryExecution().toString().lower()


def test_observed_load_counts_equal_the_rows(spark, tmp_path):
    bad = "2024-01-09,Uptown,9.0,Clothing,Shirts,Co,1,0.0,150,30.0,New,Cash,No,No"
    lr = sb.load_star(clean_sales(sales(spark, tmp_path, [*ROWS, bad])).rows)
    assert lr.counts["transactions"] == lr.star.transactions.count() == 4
    assert lr.counts["rejected"] == lr.rejected.count() == 1
    assert {r.reject_reason for r in lr.rejected.collect()} == {"unparsable_timestamp"}
    found = {r.rule: r.failures for r in
             sb.validation_summary(lr.star.transactions, sb.TRANSACTION_RULES).collect()}
    assert found == {n: lr.counts[n] for n in found}
    rules = {(r.table, r.rule): r.failures for r in sb.validate_star(lr).collect()}
    assert rules[("products", "unit_price_positive")] == 1
    assert rules[("transactions", "discount_range")] == lr.counts["discount_range"] == 1
    assert len(rules) == 11


def test_transaction_ids_do_not_change_between_reads(spark, tmp_path):
    tx = sb.load_star(clean_sales(sales(spark, tmp_path, ROWS)).rows).star.transactions
    assert tx.orderBy("transaction_id").collect() == tx.repartition(3).orderBy("transaction_id").collect()


def test_empty_table(spark, tmp_path):
    cr = clean_sales(sales(spark, tmp_path, ROWS).where(F.lit(False)))
    assert {(r.rows_removed, r.cells_filled, r.n_in, r.n_out) for r in cr.report.collect()} == {(0, 0, 0, 0)}
    lr = sb.load_star(cr.rows)
    assert {r.rows for r in sb.load_report(lr).collect()} == {0}
    assert {r.failures for r in sb.validate_star(lr).collect()} == {0}
    assert lr.rejected.count() == 0 and lr.star.transactions.count() == 0
