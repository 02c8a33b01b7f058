import pytest
from conftest import dec, records
from pyspark.sql import functions as F

from arqueo.plans import executive, scenarios, statements
from arqueo.sources.statements import cells_from_columns, read_statement_files, statement_file_rejects, statement_line_rejects


def test_first_non_zero_row_in_order_wins(make):
    rows = make.statement([
        ("e", "2", 1, 1, ["Inventarios", "99"]), ("e", "1", 2, 1, ["INVENTARIOS finales", "-7,50"]), ("e", "1", 1, 9, ["inventarios", "0"]),
        ("e", "1", 1, 10, ["Inventarios", "sin dato"]), ("e", "1", 1, 1, ["Otros", "5"]),
        ("e", "1", 1, 3, ["Total activo corriente", None, "1.000", "n/a"]), ("e", "1", 1, 4, ["TOTAL ACTIVOS", 0, 0.0]),
        ("e", "1", 1, 5, ["Total activos", 12.5]), ("e", "1", 1, 6, ["Costo de ventas", "40"]), ("f", "1", 1, 1, ["nada"]),
    ]).repartition(4)
    found = records(statements.statement_items(rows), "entity_id")
    e = found["e"]
    assert e["Inventarios"] == 7.5
    assert e["Activo Corriente"] == 1000.0
    assert e["Activo Total"] == 1000.0  # a "total activo corriente" row also says "total activo"
    assert e["Costo de Venta"] == 40.0 and e["Ingresos"] == 40.0  # so does "ventas"
    assert all(found["f"][name] == 0.0 for name in statements.ITEMS)
    assert statements.statement_items_long(statements.statement_items(rows)).count() == 30


def test_keyword_with_two_spaces(make):
    rows = make.statement([("e", "1", 1, 1, ["Ganancia  (Pérdida)", "8"]), ("f", "1", 1, 1, ["Ganancia (Pérdida)", "8"])])
    found = records(statements.statement_items(rows), "entity_id")
    assert (found["e"]["Utilidad Neta"], found["f"]["Utilidad Neta"]) == (8.0, 0.0)


def items_table(spark, **values):
    row = {name: 0.0 for name in statements.ITEMS} | values
    return spark.createDataFrame([("e", *row.values())], "entity_id string, " + ", ".join(f"`{n}` double" for n in row))


def test_ratios_and_guards(spark):
    items = items_table(spark, **{"Activo Corriente": 300.0, "Inventarios": 100.0, "Pasivo Corriente": 200.0, "Utilidad Neta": 50.0, "Ingresos": 500.0, "Patrimonio": 250.0})
    row = statements.statement_ratios(items).first()
    assert (row["Razón Corriente"], row["Prueba Ácida"], row["Capital de Trabajo"]) == (1.5, 1.0, 100.0)
    assert (row["Margen Neto"], row["ROE"], row["ROA"], row["Cobertura Intereses"]) == (0.1, 0.2, 50.0, 0.0)
    assert set(row.asDict()) == {"entity_id", *statements.RATIOS}


def test_working_capital_days(spark):
    owed = spark.createDataFrame([("e", dec(60))], "entity_id string, total_cxp decimal(28,2)")
    items = items_table(spark, **{"Cuentas por Cobrar": 50.0, "Ingresos": 100.0, "Inventarios": 30.0, "Costo de Venta": 120.0})
    assert tuple(statements.working_capital_days(items, owed).first())[1:] == (180.0, 90.0, 180.0, 90.0)
    assert tuple(statements.working_capital_days(items_table(spark), owed).first())[1:] == (None, None, None, None)


def test_statement_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("cuenta,nota,valor\nInventarios,1,\"1.234,50\"\nClientes,2,3,4\n\nEfectivo y equivalentes,9\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Inventarios,5\nTotal patrimonio,77\n", encoding="utf-8")
    rows = read_statement_files(spark, str(tmp_path / "*.csv"))
    row = statements.statement_items(rows).first()
    assert row["Inventarios"] == 1234.5
    assert row["Cuentas por Cobrar"] == 0.0  # too many fields: dropped
    assert row["Efectivo"] == 9.0  # too few: kept
    assert row["Patrimonio"] == 77.0  # below the header of its own file; the header itself is not searched


def test_statement_files_split_among_tasks(spark, tmp_path):
    lines = ["cuenta,valor"] + [f"linea {i},{i}" for i in range(3000)] + ["Inventarios,11", "Inventarios,22"]
    (tmp_path / "big.csv").write_text("\n".join(lines), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_statement_files(spark, str(tmp_path / "big.csv"))
        assert rows.count() == 3002
        assert statements.statement_items(rows).first()["Inventarios"] == 11.0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_typed_cells_count_as_numbers(spark):
    sheet = spark.createDataFrame([(1, "Inventarios", 1.234), (2, "Clientes", float("nan"))], "r long, a string, b double")
    rows = sheet.select(F.lit("e").alias("entity_id"), F.lit("f").alias("file_seq"), F.lit(1).alias("sheet_seq"), F.lit(0).alias("block_seq"), F.col("r").alias("row_seq"),
                        cells_from_columns(sheet, ["a", "b"]).alias("cells"))
    row = statements.statement_items(rows).first()
    assert (row["Inventarios"], row["Cuentas por Cobrar"]) == (1.234, 0.0)


def summary_table(spark):
    rows = [("e", f"{i:02d}", "c", dec(i % 7), dec(i), dec(2 * i), None if i == 13 else "2024-01-01") for i in range(15)]
    return spark.createDataFrame(rows, "entity_id string, factura string, cliente string, saldo_vivo_actual_usd decimal(28,2),"
                                       " dif_no_realizada_mes decimal(38,6), dif_no_realizada decimal(38,6), f string").withColumn("fecha_factura", F.col("f").cast("date")).drop("f")


def test_executive_summary(spark, make):
    summary = summary_table(spark)
    top = [r["factura"] for r in executive.top_invoices(summary).orderBy("puesto").collect()]
    assert top == ["06", "05", "12", "04", "11", "03", "10", "02", "09", "01"]
    bills = make.bills([("P", "1", 30, "2024-01-01", "2024-01-02"), ("P", "2", 10, "2024-01-01", "2030-01-02")])
    row = executive.executive_summary(summary, bills, items_table(spark, **{"Costo de Venta": 40.0}), "2024-06-01").first()
    assert row["porcentaje_vencido"] == 0.75 and row["dpo"] == 360.0
    assert float(row["pnl_mes"]) == sum(range(15)) - 13


def test_scenario_grids(spark, make):
    rates = make.rates([("2024-01-01", 4000), ("2024-01-02", 4100)])
    grid = records(scenarios.spread_grid(summary_table(spark), rates, "2024-01-02", ["0.01", "0.02"]), "spread")
    balance = sum(i % 7 for i in range(15)) - 13 % 7
    assert float(grid[dec("0.020000")]["dif_dia_plus"]) == pytest.approx(balance * (4100 * 1.02 - 4000))
    loans = make.loans([("e", "credito", 1200, 0.5, 3, True)])
    assert [r["cuota"] for r in scenarios.loan_grid(loans, [(0.0, 12), (0.0, 6)]).orderBy("meses").collect()] == [200.0, 100.0]
    company = spark.createDataFrame([("e", 365000.0, 60.0, 45.0, 30.0)], "entity_id string, ventas_anuales double, dso double, dio double, dpo double")
    row = scenarios.cash_cycle_grid(company, [(20.0, 10.0)]).first()
    assert (row["ccc"], row["ccc_nuevo"], row["dias_ganados"], row["caja_liberada"]) == (75.0, 45.0, 30.0, 30000.0)


def test_statement_files_of_many_companies_in_order_of_upload(spark, tmp_path):
    for name, value in (("2.csv", "10"), ("10.csv", "20"), ("otra á.csv", "30"), ("suelta.csv", "40")):
        (tmp_path / name).write_text(f'Cuenta,Nota,Valor\n"Inventarios, neto",x,{value}\nde más,1,2,3\n', encoding="utf-8")
    (tmp_path / "rota.csv").write_text('Cuenta,Valor\n"Inventarios,5\n', encoding="utf-8")
    listed = [("2.csv", "a", 1), ("10.csv", "a", 2), ("otra á.csv", "b", 7), ("falta.csv", "b", 8), ("rota.csv", "b", 9)]
    manifest = spark.createDataFrame([(str(tmp_path / n), e, o) for n, e, o in listed], "archivo string, entity_id string, orden int")
    rows = read_statement_files(spark, str(tmp_path / "*.csv"), manifest=manifest)
    assert {r["entity_id"]: r["Inventarios"] for r in statements.statement_items(rows).collect()} == {"a": 10.0, "b": 30.0}
    assert {r["entity_id"]: r["Inventarios"] for r in statements.statement_items(read_statement_files(spark, str(tmp_path / "*.csv"), manifest=manifest.withColumn("orden", 100 - F.col("orden")))).collect()} == {"a": 20.0, "b": 30.0}
    rejects = statement_file_rejects(spark, str(tmp_path / "*.csv"), manifest)
    assert sorted((r["archivo"].rsplit("/", 1)[1], r["motivo"]) for r in rejects.collect()) == [
        ("falta.csv", "no hay archivo"), ("rota.csv", "comillas sin cerrar"), ("suelta.csv", "no está en la lista")]
    assert statement_line_rejects(spark, str(tmp_path / "*.csv"), manifest=manifest).count() == 3
