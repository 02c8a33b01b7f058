import pytest
from conftest import date, dec, numbers, records
from pyspark.sql import functions as F

from arqueo import schemas
from arqueo.plans import cashflow, loans
from arqueo.schemas import CASH_ACTUALS
from arqueo.sources import cashplan, sinks

TODAY = "2024-06-12"
COLUMNS = ("saldo_inicial", "cartera_usd", "ingresos_op", "inyeccion_financiera", "proveedores", "gastos_op", "pago_deuda", "flujo_neto", "saldo_final")


def test_four_weeks(make, spark):
    bills = make.bills([("P", "1", 10, "2024-01-01", "2023-01-01"), ("P", "2", 20, "2024-01-01", "2024-06-16"),
                        ("P", "3", 40, "2024-01-01", "2024-06-17"), ("P", "4", 80, "2024-01-01", "2024-07-08"), ("P", "5", 500, "2024-01-01", "2024-06-12")])
    paid = make.bills([("Q", "5", 1, "2024-01-01", "2024-01-01")])
    due = cashflow.open_payables_by_week(bills, paid, TODAY)
    assert {k: float(v["proveedores"]) for k, v in records(due, "week").items()} == {1: 30, 2: 40, 3: 0, 4: 0}

    summary = spark.createDataFrame([("e", date("2024-01-01"), dec(100)), ("e", None, dec(900))], "entity_id string, fecha_factura date, saldo_vivo_actual_usd decimal(28,2)")
    collection = cashflow.weekly_collection(summary, make.rates([("2024-06-11", 4000)]), TODAY)
    assert float(collection.first()["cartera_usd"]) == 100 * 4000 * 0.2

    plan = make.plan([("e", w, 1000, 5 * w, 0, 1, 2, 3, 4, 5) for w in range(1, 5)])
    debt = loans.price_loans(make.loans([("e", "credito", 1200, 0.0, 12, True), ("e", "leaseback", 9999, 0.0, 12, False)]))
    found = records(cashflow.cash_flow(collection, due, plan, debt, TODAY), "week")
    assert numbers(found[1], COLUMNS) == [1000, 80000, 5, 1200, 30, 15, 0, 81160, 82160]
    assert numbers(found[2], COLUMNS) == [82160, 80000, 10, 0, 40, 15, 0, 79955, 162115]
    assert numbers(found[4], COLUMNS)[3:7] == [0, 0, 15, 100]
    assert all(found[w]["saldo_final"] == found[w + 1]["saldo_inicial"] for w in (1, 2, 3))
    assert found[1]["semana"] == "Sem 1 (10/06 - 16/06)"


def test_company_without_a_plan_still_has_four_weeks(make, spark):
    due = cashflow.payables_by_week(make.bills([("P", "1", 10, "2024-01-01", "2024-06-12")]), TODAY)
    nothing = spark.createDataFrame([], "entity_id string, cartera_usd decimal(38,6)")
    flow = cashflow.cash_flow(nothing, due, make.plan([]), loans.price_loans(make.loans([])), TODAY)
    assert [float(r["saldo_final"]) for r in flow.orderBy("week").collect()] == [-10, -10, -10, -10]


def test_close_is_appended_once(make, spark, tmp_path):
    path = str(tmp_path / "ledger")
    spark.createDataFrame([], CASH_ACTUALS).write.parquet(path)
    actual = spark.createDataFrame([("e", *map(dec, (1, 2, 3, 4, 5, 6, None)))],
                                   "entity_id string, r_usd decimal(18,2), r_ord decimal(18,2), r_ex decimal(18,2), r_prov decimal(18,2), r_fijos decimal(18,2), r_nom decimal(18,2), r_fin decimal(18,2)")
    close = cashflow.weekly_close(actual, TODAY)
    for _ in range(2):
        sinks.append_closes(path, close, cashplan.read_ledger(spark, path))
    ledger = cashplan.read_ledger(spark, path)
    assert [tuple(r) for r in ledger.collect()] == [("e", date("2024-06-03"), "03/06 - 09/06", dec("6.00"), dec("15.00"), dec("-9.00"))]
    assert cashflow.is_closed(ledger, ledger, TODAY).first()["cerrada"] is True
    assert cashflow.is_closed(ledger, ledger, "2024-06-20").first()["cerrada"] is False
    # The same week of another year is another week.
    later = cashflow.weekly_close(actual, "2030-06-12")
    assert cashflow.not_yet_closed(later, ledger).count() == 1
    assert float(cashflow.ledger_totals(ledger).first()["saldo_neto"]) == -9
    assert cashflow.ledger_history(ledger).columns[2:] == ["Semana", "Ingresos Reales", "Egresos Reales", "Flujo Neto Real"]


def test_plan_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"entity_id": "a", "saldo_inicial": 10, "S1": {"ordinarios": 5, "n_ss": 2}, "S2": {}, "S3": {}, "S4": {},'
                                     ' "historico": [{"week_start": "2024-06-03", "semana": "03/06 - 09/06", "ingresos_reales": 3, "egresos_reales": 1, "flujo_neto_real": 2}]}')
    (tmp_path / "b.json").write_text('{"entity_id": "b"}')
    documents = cashplan.read_plan_documents(spark, str(tmp_path))
    weeks = records(cashplan.plan_weeks(documents), "entity_id", "week")
    assert len(weeks) == 8 and numbers(weeks["a", 1], ["saldo_inicial", "ordinarios", "n_ss", "f_arr"]) == [10, 5, 2, 0]
    assert numbers(weeks["b", 4], ["saldo_inicial", "ordinarios"]) == [0, 0]
    assert [r["entity_id"] for r in cashplan.closed_weeks(documents, "2024-12-31").collect()] == ["a"]
    assert cashplan.empty_plan(documents).count() == 8


def test_saving_a_plan_replaces_only_its_company(make, spark, tmp_path):
    path = str(tmp_path / "plan")
    sinks.save_plan(path, make.plan([(e, 1, 1, *[0] * 7) for e in ("a", "b")]))
    sinks.save_plan(path, make.plan([("a", 1, 7, *[0] * 7)]))
    found = records(cashplan.read_plan(spark, path), "entity_id")
    assert {k: float(v["saldo_inicial"]) for k, v in found.items()} == {"a": 7, "b": 1}


def test_loans(make, spark):
    assets = spark.createDataFrame([("e", "Inyectora", dec(50)), ("e", "Molde", dec(15))], "entity_id string, maquina string, valor decimal(18,2)")
    lease = loans.price_loans(loans.leaseback_loans(assets, 0.0, 5)).first()
    assert (float(lease["monto"]), lease["meses"], round(lease["cuota"], 6)) == (65, 60, round(65 / 60, 6))
    asked = spark.createDataFrame([("e", 100.0, "Fija", 0.18, 0.05, 3), ("e", 100.0, "Variable (IBR + Spread)", 0.18, 0.05, 3)],
                                  "entity_id string, monto double, tipo_tasa string, tasa_fija double, spread double, meses int")
    assert sorted(r["tasa_ea"] for r in loans.credit_loans(asked, 0.125).collect()) == [0.175, 0.18]


def test_weeks_of_each_company(make):
    weeks = cashflow.cash_weeks(make.bills([("P", "1", 1, "2024-01-01", "2024-01-01")] * 3), TODAY)
    assert [(r["week"], r["inicio"]) for r in weeks.orderBy("week").collect()][:2] == [(1, date("2024-06-10")), (2, date("2024-06-17"))]
    assert weeks.where(F.col("fin") == F.lit("2024-07-07")).count() == 1


def test_old_documents_are_not_closed_twice(spark, tmp_path):
    """Histories without a first day take it from the label; what cannot be told is rejected."""
    path = tmp_path / "p.json"
    path.write_text('{"entity_id": "a", "historico": [{"semana": "01/01 - 07/01", "ingresos_reales": 5, "egresos_reales": 1, "flujo_neto_real": 4}, {"semana": "nada", "ingresos_reales": 1}]}')
    documents = cashplan.read_plan_documents(spark, str(path))
    ledger = cashplan.closed_weeks(documents, "2024-03-01")
    assert [(r["week_start"], float(r["flujo_neto_real"])) for r in ledger.collect()] == [(date("2024-01-01"), 4.0)]
    assert [r["semana"] for r in cashplan.closed_week_rejects(documents, "2024-03-01").collect()] == ["nada"]
    assert cashflow.not_yet_closed(ledger, ledger).count() == 0


def test_two_plans_for_a_week_are_an_error(make):
    plan = make.plan([("a", 1, 10, 0, 0, 0, 0, 0, 0, 0), ("a", 1, 20, 0, 0, 0, 0, 0, 0, 0)])
    empty = make.plan([]).select("entity_id")
    collection = empty.withColumn("cartera_usd", F.lit(0).cast("decimal(38,6)"))
    due = empty.withColumn("week", F.lit(1)).withColumn("proveedores", F.lit(0).cast("decimal(28,2)"))
    loans = empty.withColumn("activo", F.lit(True)).withColumn("desembolso", F.lit(0).cast("decimal(18,2)")).withColumn("cuota", F.lit(0.0))
    with pytest.raises(Exception, match="two plans"):
        cashflow.cash_flow(collection, due, plan, loans, TODAY).collect()


def test_two_writers_close_a_week_once(spark, tmp_path):
    """Neither saw the other's week; a run that is repeated after its commit adds nothing."""
    path = str(tmp_path / "libro")
    none = spark.createDataFrame([], schemas.CASH_ACTUALS)

    def close(rows):
        return spark.createDataFrame([(e, date(w), "s", dec(n), dec(0), dec(n)) for e, w, n in rows], schemas.CASH_ACTUALS)

    sinks.append_closes(path, close([("a", "2024-01-01", 5), ("007", "2024-01-01", 6)]), none)
    sinks.append_closes(path, close([("a", "2024-01-01", 5), ("a", "2024-01-08", 7)]), none)  # a second writer with the same old ledger
    sinks.append_closes(path, close([("a", "2024-01-08", 7)]), none)  # a retry
    sinks.append_closes(path, close([("a", "2024-01-08", 9)]), cashplan.read_ledger(spark, path))  # a later close of the same week
    rows = sorted((r["entity_id"], str(r["week_start"]), float(r["flujo_neto_real"])) for r in cashplan.read_ledger(spark, path).collect())
    assert rows == [("007", "2024-01-01", 6.0), ("a", "2024-01-01", 5.0), ("a", "2024-01-08", 7.0)]


def test_documents_there_and_back(spark, make, tmp_path):
    plan = make.plan([("a", week, 10 * week, 1, 2, 3, 4, 5, 6, week) for week in (1, 2, 3, 4)])
    ledger = spark.createDataFrame([("a", date("2024-01-01"), "01/01 - 07/01", dec(1), dec(2), dec(-1)), ("z", date("2024-01-08"), "08/01 - 14/01", dec(3), dec(2), dec(1))], schemas.CASH_ACTUALS)
    path = str(tmp_path / "planes")
    documents = cashplan.plan_documents(plan.withColumn("saldo_inicial", F.lit(10).cast("decimal(18,2)")), ledger)
    sinks.save_plan_documents(path, documents)
    with open(f"{path}/mas.txt", "w") as more:
        more.write('{"entity_id": "x", "saldo_inicial": 1, "S1": \n{"entity_id": "y", "saldo_inicial": {"a": 1}}\n{"entity_id": "w", "historico": [{"semana": "01/01 - 07/01"}]}\n')
    back = cashplan.read_plan_documents(spark, path, multi_line=False)
    assert sorted(r["entity_id"] for r in back.collect()) == ["a", "w", "z"]
    weeks = sorted(tuple(r) for r in cashplan.plan_weeks(back).where("entity_id = 'a'").collect())
    assert weeks == sorted(tuple(r) for r in plan.withColumn("saldo_inicial", F.lit(10).cast("decimal(18,2)")).collect())
    closed = cashplan.closed_weeks(back, "2024-03-01")
    assert sorted(tuple(r) for r in closed.where("entity_id <> 'w'").collect()) == sorted(tuple(r) for r in ledger.collect())
    assert [r["entity_id"] for r in cashplan.closed_week_guesses(back, "2024-03-01").collect()] == ["w"]
    assert sorted(r["documento"][:16] for r in cashplan.plan_document_rejects(spark, path, multi_line=False).collect()) == ['{"entity_id": "x', '{"entity_id": "y']
