"""Shape of the physical plans, and results with one key holding a third of the rows."""

import datetime as dt
from contextlib import contextmanager
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from arqueo.operators.joins import skew_join
from arqueo.operators.payments import daily_payments, split_by_invoice_date
from arqueo.plans import executive, fx, payables
from arqueo.sources import payables as bill_source
from checks.queries import JOBS, bound

SMALL = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroups")


@contextmanager
def settings(spark, **values):
    names = {key.replace("__", "."): value for key, value in values.items()}
    old = {key: spark.conf.get(key) for key in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(JOBS))
def test_no_pairwise_joins_and_no_python(spark, name):
    text = plan(bound(name)(spark, SMALL))
    assert not [word for word in FORBIDDEN if word in text]


def hot_invoices(spark, rows=6000):
    """A third of the invoices and of the payments carry the same number."""
    number = F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("N"), F.col("id").cast("string")))
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 20).cast("int"))
    company = F.concat(F.lit("e"), (F.col("id") % 1).cast("string")).alias("entity_id")
    facturas = spark.range(0, rows, 1, 4).select(
        company, number.alias("factura"), F.lit("c").alias("cliente"), day.alias("fecha_factura"),
        F.lit("USD").alias("moneda"), (F.col("id") + 1000).cast("decimal(18,2)").alias("valor_usd"))
    payments = spark.range(0, rows, 1, 4).select(
        company, day.alias("fecha"), number.alias("factura"),
        F.lit("0.25").cast("decimal(18,2)").alias("monto_usd"), F.lit(4000).cast("decimal(18,4)").alias("tasa_monetizacion"))
    rates = spark.range(25).select(
        F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("fecha"), (4000 + F.col("id")).cast("decimal(18,4)").alias("trm"))
    return facturas, payments, rates


SPLIT = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "4096",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "8192",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
}


@contextmanager
def splitting(spark):
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    with settings(spark, **SPLIT):
        yield
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_hot_key_is_split_though_the_other_side_is_an_aggregate(spark):
    left, _, _ = hot_invoices(spark, 30000)
    right = left.groupBy("entity_id", "factura").agg(F.count(F.lit(1)).alias("n"))
    with splitting(spark):
        joined = skew_join(left, right, ["entity_id", "factura"], "left")
        assert joined.where("factura = 'HOT' AND n = 10000").count() == 10000
        joined.collect()
        assert "skew=true" in plan(joined)
        plain = left.join(right, ["entity_id", "factura"], "left")
        plain.collect()
        assert "skew=true" not in plan(plain)


def test_hot_invoice_number(spark):
    facturas, payments, rates = hot_invoices(spark)
    with splitting(spark):
        summary = fx.fx_summary(facturas, payments, rates, "2024-01-25")
        hot = summary.where("factura = 'HOT'").agg(
            F.count(F.lit(1)), F.min("abonos_post_factura_total_usd"), F.max("abonos_post_factura_total_usd"),
            F.sum("saldo_vivo_actual_usd")).first()
        # 2000 invoices, 100 payments on each of 20 days: the first day's invoices see all 500 USD as later payments.
        assert tuple(hot) == (2000, Decimal(25), Decimal(500), sum(Decimal(3 * i + 1000 - 500) for i in range(2000)))
        totals = fx.fx_daily_totals(facturas, payments, rates, "2024-01-25")
        last = totals.orderBy(F.desc("fecha")).first()
        assert last["saldo_total_usd"] == summary.agg(F.sum("saldo_vivo_actual_usd")).first()[0]
        assert last["dif_total"] == summary.agg(F.sum("dif_total")).first()[0]


def test_payments_of_one_number_are_combined_before_the_shuffle(spark):
    text = plan(fx.fx_summary(*hot_invoices(spark), "2024-01-25"))
    assert "partial_sum" in text


def test_top_lists_are_cut_before_the_shuffle(spark):
    facturas, payments, rates = hot_invoices(spark)
    text = plan(executive.top_invoices(fx.fx_summary(facturas, payments, rates, "2024-01-25")))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_read_only_what_is_needed(spark):
    bills = spark.read.parquet(f"{SMALL}/orders.parquet").select(
        F.lit("e").alias("entity_id"), F.lit("p").alias("PROVEEDOR"), F.col("o_orderkey").cast("string").alias("FACTURA"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("VALOR"), F.col("o_orderdate").cast("date").alias("GENERACIO"),
        F.col("o_orderdate").cast("date").alias("VENCIMIENTO"))
    text = plan(payables.risk_totals(payables.payables_aging(bills, "2024-01-01")))
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "o_totalprice" in schema and "o_orderdate" in schema and "o_orderkey" not in schema and "o_custkey" not in schema


def test_results_do_not_depend_on_partitioning(spark):
    facturas, payments, rates = hot_invoices(spark, 300)
    one = fx.fx_daily_totals(facturas.coalesce(1), payments.coalesce(1), rates, "2024-01-25").orderBy("fecha").collect()
    many = fx.fx_daily_totals(facturas.orderBy(F.desc("valor_usd")).repartition(7), payments.repartition(11), rates, "2024-01-25").orderBy("fecha").collect()
    assert one == many


@pytest.mark.parametrize("name", ["statement_items", "statement_ratios", "executive_summary"])
def test_a_row_of_a_statement_is_read_once(spark, name):
    """The search for keywords and numbers stands once in the optimized plan; filters carry no copies of it."""
    optimized = bound(name)(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_extract_all") == 1 and optimized.count("COSTOS DE VENTAS") == 1


@pytest.mark.parametrize("name", ["payables_bills_from_text", "payables_rows_that_go"])
def test_a_date_of_a_bill_is_read_once(spark, name):
    """Two orders of the numbers for each of two dates, and no copy of them in a filter."""
    optimized = bound(name)(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_replace") == 4


def test_payments_taken_back_do_not_meet_every_invoice(spark):
    """No list of all payment days of a number goes along with each of its invoices."""
    text = plan(fx.fx_daily_totals(*hot_invoices(spark), "2024-01-25"))
    assert "collect_list" not in text


def test_files_are_looked_at_once(spark, tmp_path):
    """What comes out of the reader scans landed tables: no text is read again for the headers, the types and the rows."""
    (tmp_path / "a.csv").write_text('PROVEEDOR,VALOR,FACTURA,GENERACIO,VENCIMIENTO,NOTA\nP1,5,1,01/02/2024,2024-03-01,"dos\nrenglones"\nP2,6,2,01/02/2024,2024-03-01,x\n')
    (tmp_path / "b.csv").write_text("PROVEEDOR,VALOR,FACTURA,GENERACIO,VENCIMIENTO\nP3,7,3,01/02/2024,2024-03-01\n")
    bills = bill_source.with_extra_columns(bill_source.read_bills(spark, str(tmp_path)))
    assert sorted((r["FACTURA"], r["NOTA"]) for r in bills.collect()) == [("1", "dos\nrenglones"), ("2", "x"), ("3", None)]
    text = plan(bills)
    assert "FileScan text" not in text and "regexp_extract_all" not in text


def test_changes_are_worked_out_after_they_are_unfolded(spark):
    """The search for stretches is not compiled; a change that is made in one expression with it would not be either."""
    facturas, payments, rates = hot_invoices(spark, 60)
    text = plan(fx.fx_daily_totals(facturas, payments, rates, "2024-01-25"))
    unfolded = [line for line in text.splitlines() if "Generate explode" in line and "transform(" in line]
    assert unfolded and not [line for line in unfolded if "antes_usd_con_tasa" in line.split("],")[0]]


def test_split_reads_a_number_once(spark):
    """No frame that is read again for every row, and one window for all sums."""
    facturas, payments, _ = hot_invoices(spark, 60)
    text = plan(split_by_invoice_date(facturas, daily_payments(payments)))
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "currentrow$(), unboundedfollowing$()" not in text


def test_cash_flow_works_out_what_is_due_once(spark):
    text = plan(bound("cash_flow_four_weeks")(spark, SMALL))
    assert "lineitem.parquet" not in text and "supplier.parquet" not in text
