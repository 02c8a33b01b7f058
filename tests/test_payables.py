import random
from decimal import Decimal

import pytest
from conftest import date, numbers, records
from pyspark.sql import functions as F

from arqueo.plans import payables

TODAY = "2024-06-15"
BILLS = [
    ("P1", "1", 100, "2024-01-01", "2024-05-01"), ("P1", "2", 50, "2024-05-20", "2024-06-10"),
    ("P2", "2", 30, "2024-05-02", "2024-06-20"), ("P2", None, 20, "2024-05-03", "2024-07-30"), ("", "3", -5, "2024-05-03", "2024-06-15"),
]


@pytest.fixture(scope="module")
def bills(make):
    return make.bills(BILLS)


@pytest.fixture(scope="module")
def aged(bills):
    return payables.payables_aging(bills, TODAY)


def test_derived_columns(aged):
    row = aged.where("PROVEEDOR = 'P1' AND FACTURA = '2'").first()
    assert [row[n] for n in payables.DERIVED_COLUMNS] == ["2024-05", 21, True, 5, -5, False, "🟠 Vencida Reciente (1-30d)"]


def test_risk_totals_partition_the_bills(aged):
    row = payables.risk_totals(aged).first()
    assert numbers(row, ["saldo_total", "al_dia", "proximo_a_vencer", "vencida_reciente", "vencida_critica"]) == [195, 15, 30, 50, 100]
    row = payables.risk_totals(aged, ["2024-01"]).first()
    assert numbers(row, ["saldo_total", "al_dia", "vencida_critica"]) == [100, 0, 100]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_always_add_up(make, seed):
    rng = random.Random(seed)
    rows = [("P", str(i), rng.randint(-500, 9000), "2024-01-01", f"2024-{rng.randint(3, 9):02d}-{rng.randint(1, 28):02d}") for i in range(60)]
    row = payables.risk_totals(payables.payables_aging(make.bills(rows), TODAY)).first()
    assert row["saldo_total"] == sum(row[n] for n in payables.RISK_TOTALS) == sum(Decimal(r[2]) for r in rows)


def test_supplier_rankings(aged, make):
    assert [(r["PROVEEDOR"], float(r["VALOR"])) for r in payables.top_suppliers(aged, size=2).orderBy("puesto").collect()] == [("P1", 150), ("P2", 50)]
    tie = payables.payables_aging(make.bills([(n, "1", 10, "2024-01-01", "2024-01-02") for n in "zyx"]), TODAY)
    assert [r["PROVEEDOR"] for r in payables.top_suppliers(tie, size=2).orderBy("puesto").collect()] == ["x", "y"]
    assert [r[0] for r in payables.choices(aged, "MES_GENERACION").collect()] == ["2024-01", "2024-05"]


def test_supplier_groups(aged, spark):
    groups = spark.createDataFrame([("e", "g1", "P1"), ("e", "g2", "P1"), ("e", "g2", "P2"), ("e", "g2", "P2")], "entity_id string, grupo string, PROVEEDOR string")
    found = records(payables.supplier_group_totals(aged, groups), "grupo")
    assert float(found["g1"]["saldo_total"]) == 150 and float(found["g2"]["saldo_total"]) == 200
    assert found["g1"]["alerta_credito_corto"] is True
    assert payables.short_credit_overdue(aged).count() == 1
    detail = payables.supplier_group_detail(aged, ["P1", "P2"], ["🟢 Al día (>7d)", "🔴 Vencida Crítica (>30d)"]).collect()
    assert [(r["PROVEEDOR"], r["FACTURA"]) for r in detail] == [("P1", "1"), ("P2", None)]


def test_payment_file_goes_by_number_alone(aged, spark):
    ticked = spark.createDataFrame([("e", "2"), ("e", "2"), ("f", "1")], "entity_id string, FACTURA string")
    file = payables.payment_file(aged, ticked)
    assert sorted(r["PROVEEDOR"] for r in file.collect()) == ["P1", "P2"]
    assert "DIAS_CREDITO" in file.columns and not set(payables.PAYMENT_FILE_DROPS) & set(file.columns)
    assert not any(r["PAGAR"] for r in payables.payment_form(aged).collect())


def test_open_bills_match_missing_numbers(bills, make):
    paid = make.bills([("X", "2", 1, "2024-01-01", "2024-01-01"), ("X", None, 1, "2024-01-01", "2024-01-01")])
    assert sorted(r["FACTURA"] for r in payables.open_bills(bills, paid).collect()) == ["1", "3"]
    assert payables.open_bills(bills, make.bills([])).count() == len(BILLS)


def test_overdue_share(bills, make):
    row = payables.overdue_share(bills, TODAY).first()
    assert row["porcentaje_vencido"] == pytest.approx(150 / 195)
    zero = make.bills([("P", "1", -10, "2024-01-01", "2024-01-02")])
    assert payables.overdue_share(zero, TODAY).first()["porcentaje_vencido"] == 0.0


def test_bill_due_today_is_not_overdue(make):
    row = payables.payables_aging(make.bills([("P", "1", 1, "2024-06-01", TODAY)]), TODAY).first()
    assert (row["VENCIDA"], row["DIAS_VENCIDA"], row["PROXIMO_A_VENCER"]) == (False, 0, False)


def test_aging_needs_no_shuffle(aged):
    assert "Exchange" not in aged._jdf.queryExecution().executedPlan().toString()


def test_dates_are_days(aged):
    assert aged.select(F.max("VENCIMIENTO")).first()[0] == date("2024-07-30")
