import datetime as dt
import io
import random
import re

import pandas as pd
import pytest
from conftest import date, dec, records
from pyspark.sql import functions as F

from arqueo.plans import payables
from arqueo.sources import payables as bill_source
from arqueo.sources import rates, receivables, sinks, text_files
from arqueo.sources.columns import MissingColumns


def test_invoice_scan(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("factura,cliente,fecha_factura,moneda,valor_usd,otra\n A1 ,c,2024-01-10 08:30:00, usd ,10.5,x\nA2,c,nada,USD,5,x\n"
                    "A3,c,2024-01-01,EUR,5,x\nA4,c,2024-01-01,USD,0,x\nA5,c,2024-01-01,USD,abc,x\n,c,2024-01-01,USD,7,x\n", encoding="utf-8")
    found = receivables.read_invoices(spark, str(path), "csv")
    assert sorted(((r["factura"] or "-"), r["fecha_factura"], float(r["valor_usd"])) for r in found.collect()) == [
        ("-", date("2024-01-01"), 7.0), ("A1", date("2024-01-10"), 10.5), ("A2", None, 5.0)]
    assert receivables.undated(found).count() == 1 and receivables.dated(found).count() == 2
    assert receivables.invoice_by_number(found, "A1").count() == 1


def test_json_and_parquet_scans(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"fecha": "2024-01-02", "factura": " A ", "monto_usd": "10", "tasa_monetizacion": "NaN"}\n')
    found = receivables.read_payments(spark, str(tmp_path / "p.json"), "json")
    row = found.first()
    assert (row["factura"], row["monto_usd"], row["tasa_monetizacion"], row["fecha"]) == ("A", dec("10.00"), None, date("2024-01-02"))
    found.write.parquet(str(tmp_path / "p"))
    assert receivables.read_payments(spark, str(tmp_path / "p")).count() == 1
    assert receivables.read_payments(spark, None).count() == 0


def test_missing_columns_are_named(spark):
    with pytest.raises(MissingColumns, match="valor_usd"):
        receivables.prepare_invoices(spark.createDataFrame([("a",)], "factura string"))
    with pytest.raises(MissingColumns, match="tasa_monetizacion"):
        receivables.prepare_payments(spark.createDataFrame([("a",)], "factura string"))


def test_header_normalization(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "` proveedor` string, `Fecha Generacion` string, PROVEEDOR string, generacion string")
    out = bill_source.normalize_headers(df)
    assert (out.columns, tuple(out.first())) == (["PROVEEDOR", "GENERACIO"], ("1", "2"))


FILES = {
    "a.csv": "Proveedor, valor ,Factura,Fecha Generacion,Vencimiento,Centro Costo\n P1 ,100.50,F1,31/12/2024,15/01/2025,cc1\nP1,x,F2,01/02/2024,15/01/2025,cc2\n,5,F3,01/02/2024,15/01/2025,cc3\n\"Uno, dos\",7,,1/2/2024,2024-03-01,\n",
    "b.csv": "FACTURA,PROVEEDOR,GENERACIO,generacion,VENCIMIENTO,VALOR,VALOR\nF9,P2,2024-05-01,2020-01-01,2024-06-01,-3,99\nF8,P2,,2020-01-01,2024-06-01,1,1\n",
    "c.csv": "FACTURA,PROVEEDOR\nF9,P2\n",
}


def bill_files(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_text(content, encoding="utf-8")
    return str(tmp_path / "*.csv")


def test_bill_files_with_uneven_headers(spark, tmp_path):
    paths = bill_files(tmp_path)
    found = bill_source.read_bills(spark, paths, entity="e")
    got = sorted((r["PROVEEDOR"], r["FACTURA"] or "-", float(r["VALOR"]), r["GENERACIO"], r["VENCIMIENTO"], r["extras"].get("CENTRO_COSTO")) for r in found.collect())
    assert got == [
        ("P1", "F1", 100.5, date("2024-12-31"), date("2025-01-15"), "cc1"),
        ("P2", "F9", -3.0, date("2024-05-01"), date("2024-06-01"), None),
        ("Uno, dos", "-", 7.0, date("2024-02-01"), date("2024-03-01"), None),
    ]
    rejected = bill_source.bill_file_rejects(spark, paths).collect()
    assert [(r["archivo"].rsplit("/", 1)[1], sorted(r["faltan"])) for r in rejected] == [("c.csv", ["GENERACIO", "VALOR", "VENCIMIENTO"])]
    assert payables.payables_aging(found, "2025-01-01").count() == 3


def test_union_of_tables_by_name(spark):
    one = spark.createDataFrame([("P", 1.0, "F", "2024-01-01", "2024-01-02", "x")], "PROVEEDOR string, VALOR double, FACTURA string, GENERACIO string, VENCIMIENTO string, NOTA string")
    two = one.drop("NOTA").withColumn("OTRA", F.lit("y"))
    union, rejected = bill_source.union_bills([one, one.drop("VALOR"), two])
    assert set(union.columns) >= {"NOTA", "OTRA"} and union.count() == 2
    assert [position for position, _ in rejected] == [1]
    assert bill_source.union_bills([])[0] is None


def test_blank_supplier_stays_and_null_goes(spark):
    rows = [("", 1.0, "F", "2024-01-01", "2024-01-02"), (None, 1.0, "F", "2024-01-01", "2024-01-02"), ("P", 1.0, "F", "  ", "2024-01-02")]
    df = spark.createDataFrame(rows, "PROVEEDOR string, VALOR double, FACTURA string, GENERACIO string, VENCIMIENTO string")
    assert [r["PROVEEDOR"] for r in bill_source.prepare_bills(df).collect()] == [""]


def test_rate_folders_in_order_of_preference(spark, tmp_path):
    from arqueo.operators.rates import daily_rates

    for name, value in (("uno", "bad"), ("dos", "4,000.50")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.json").write_text(f'[{{"valor": "{value}", "vigenciadesde": "2024-01-01T00:00:00.000", "vigenciahasta": "2024-01-03T00:00:00.000"}}]')
    table = rates.read_rate_intervals(spark, [str(tmp_path / "uno"), str(tmp_path / "dos")])
    days = daily_rates(table, F.lit("2024-01-02").cast("date"), F.lit("2024-02-01").cast("date"))
    assert [(r["fecha"], r["trm"]) for r in days.orderBy("fecha").collect()] == [(date("2024-01-02"), dec("4000.5000")), (date("2024-01-03"), dec("4000.5000"))]
    sinks.write_rates(str(tmp_path / "landed"), days)
    assert spark.read.parquet(str(tmp_path / "landed")).count() == 2


def test_exports(spark, make, tmp_path):
    from arqueo.plans import fx

    inputs = make.facturas([("A", "c", "2024-01-30", 10)]), make.monetizaciones([]), make.rates([("2024-01-30", 1), ("2024-02-01", 2)])
    path = str(tmp_path / "out")
    sinks.export_fx(path, fx.fx_summary(*inputs, "2024-02-01"), fx.fx_daily_totals(*inputs, "2024-02-01"), fx.fx_daily_detail(*inputs, "2024-02-01"))
    assert spark.read.parquet(f"{path}/detalle_actual").count() == 1
    assert spark.read.parquet(f"{path}/serie_total").count() == 2
    assert sorted(p.name for p in (tmp_path / "out" / "detalle_diario").glob("mes=*")) == ["mes=2024-01", "mes=2024-02"]

    sinks.export_fx(str(tmp_path / "few"), fx.fx_summary(*inputs, "2024-02-01"), detail=fx.fx_daily_detail(*inputs, "2024-02-01"), files_per_month=2)
    assert spark.read.parquet(str(tmp_path / "few" / "detalle_diario")).count() == 2

    aged = payables.payables_aging(make.bills([("P", "1", 10, "2024-01-01", "2024-01-02"), ("P", "2", 10, "2024-01-01", "2024-01-02")]), "2024-02-01")
    sinks.write_payment_file(f"{path}/pagos", aged, aged.where("FACTURA = '2'"))
    rows = records(spark.read.option("header", True).csv(f"{path}/pagos"), "FACTURA")
    assert list(rows) == ["2"] and "RIESGO" not in rows["2"]


def test_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('PROVEEDOR,FACTURA,GENERACIO,VENCIMIENTO,VALOR\n"P\nSAS",F1,2024-01-01,2024-02-01,5\nP2,F2,2024-01-01,2024-02-01,6\n"x\n\n,y",F3,2024-01-01,2024-02-01,7\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("PROVEEDOR,FACTURA,GENERACIO,VENCIMIENTO,VALOR\nP4,F4,2024-01-01,2024-02-01,8\n", encoding="utf-8")
    found = bill_source.read_bills(spark, str(tmp_path / "*.csv"), entity="e").collect()
    assert sorted((r["PROVEEDOR"], r["FACTURA"], float(r["VALOR"])) for r in found) == [("P\nSAS", "F1", 5.0), ("P2", "F2", 6.0), ("P4", "F4", 8.0), ("x\n\n,y", "F3", 7.0)]


HEADER = "PROVEEDOR,FACTURA,GENERACIO,VENCIMIENTO,VALOR,NOTA\n"


def bill_line(number, note="n", supplier="P"):
    return f"{supplier},F{number},2024-01-01,2024-02-01,{number},{note}\n"


def test_a_quote_inside_a_field_is_a_character(spark, tmp_path):
    """One inch mark must not swallow the rest of the file."""
    (tmp_path / "a.csv").write_text(HEADER + bill_line(1, 'tubo 5" pvc') + bill_line(2) + bill_line(3, '"dos\nrenglones", y 3"'.replace(",", " ")), encoding="utf-8")
    found = bill_source.read_bills(spark, str(tmp_path / "*.csv")).collect()
    assert sorted((r["FACTURA"], r["extras"]["NOTA"]) for r in found) == [("F1", 'tubo 5" pvc'), ("F2", "n"), ("F3", 'dos\nrenglones  y 3"')]
    assert bill_source.bill_file_rejects(spark, str(tmp_path / "*.csv")).count() == 0


def test_every_record_is_a_bill_or_a_reject(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + bill_line(1) + "P,F2,nada,2024-02-01,2,\nP,F3,2024-01-01,2024-02-01,x\n,F4,2024-01-01,2024-02-01,4,\nP\n\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(HEADER + bill_line(5) + 'P,F6,2024-01-01,2024-02-01,6,"nunca\n' + bill_line(7), encoding="utf-8")
    paths = str(tmp_path / "*.csv")
    assert [r["FACTURA"] for r in bill_source.read_bills(spark, paths).collect()] == ["F1"]
    assert sorted((r["FACTURA"] or "-", r["motivo"]) for r in bill_source.bill_line_rejects(spark, paths).collect()) == [
        ("-", "sin GENERACIO"), ("F2", "GENERACIO ilegible"), ("F3", "VALOR ilegible"), ("F4", "sin PROVEEDOR")]
    assert [(r["archivo"][-5:], r["motivo"], r["faltan"]) for r in bill_source.bill_file_rejects(spark, paths).collect()] == [("b.csv", "comillas sin cerrar", [])]
    assert [r["lineas"] for r in text_files.unclosed(spark, paths).collect()] == [4]


CELLS = ("a", "b c", '5" tubo', 'x"y"z', "", '"q, r"', '"l1\nl2"', '"say ""hi"""', '"p"tail', '"a\n\n,""b\n"', '""', '"\n"', '"""\n"""')


@pytest.mark.parametrize("split", ["128m", "48"])
def test_records_like_pandas(spark, tmp_path, split):
    """Files of few lines, and files cut into many blocks inside records."""
    rng, wanted = random.Random(3), {}
    for k in range(40):
        body = "h1,h2,h3\n" + "".join(",".join(rng.choice(CELLS) for _ in range(3)) + "\n" for _ in range(rng.randint(1, 25)))
        (tmp_path / f"f{k:02}.csv").write_text(body, encoding="utf-8")
        table = pd.read_csv(io.StringIO(body), dtype=str, keep_default_na=False)
        wanted[f"f{k:02}.csv"] = [[cell.strip() or None for cell in row] for row in table.values.tolist()]
    old = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key, value in zip(old, (split, "1")):
            spark.conf.set(key, value)
        rows = text_files.with_header(text_files.read_lines(spark, str(tmp_path))).collect()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    found = {}
    for r in sorted(rows, key=lambda r: (r["archivo"], r["bloque"], r["linea"])):
        found.setdefault(r["archivo"].rsplit("/", 1)[1], []).append(r["campos"])
    assert found == wanted


def test_no_file_is_put_in_order_as_a_whole(spark, tmp_path):
    """Windows over lines run inside a block; those over a file have a row per block."""
    (tmp_path / "a.csv").write_text(HEADER + bill_line(1, '"x\ny"'), encoding="utf-8")
    plan = text_files.read_lines(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.splitlines() if "Window [" in line and "linea" in line]
    assert lines and all(re.search(r"\[archivo#\d+, bloque#\d+L?\], \[linea", line) for line in lines)


def test_extra_columns_get_names_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("PROVEEDOR,FACTURA,GENERACIO,VENCIMIENTO,VALOR,Peso,Centro Costo\nP,F1,2024-01-01,2024-02-01,1,2.50,c 1\nP,F2,2024-01-01,2024-02-01,1,,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("PROVEEDOR,FACTURA,GENERACIO,VENCIMIENTO,VALOR,Recibida\nP,F3,2024-01-01,2024-02-01,1,05/03/2024\n", encoding="utf-8")
    wide = bill_source.with_extra_columns(bill_source.read_bills(spark, str(tmp_path / "*.csv")))
    assert [(f.name, f.dataType.simpleString()) for f in wide.schema.fields[-3:]] == [("CENTRO_COSTO", "string"), ("PESO", "decimal(38,6)"), ("RECIBIDA", "date")]
    got = {r["FACTURA"]: (r["CENTRO_COSTO"], r["PESO"], r["RECIBIDA"]) for r in wide.collect()}
    assert got == {"F1": ("c 1", dec("2.500000"), None), "F2": (None, None, None), "F3": (None, None, date("2024-03-05"))}


def test_intervals_on_top_of_each_other(spark):
    """Gaps, days covered many times, intervals that end before they start, against every day on its own."""
    from arqueo.operators.rates import daily_rates

    rng, first = random.Random(1), date("2024-01-01")
    for _ in range(4):
        rows = [(1, str(1000 + i), first + dt.timedelta(rng.randint(-40, 80)), rng.choice([0, 1, 2, 5, 20, 60, 4000, -3])) for i in range(rng.randint(1, 25))] + [(1, "999", first, 0)]
        rows = [(p, v, a, a + dt.timedelta(n)) for p, v, a, n in rows]
        days = daily_rates(spark.createDataFrame(rows, "prioridad int, valor string, vigenciadesde date, vigenciahasta date"), F.lit(first), F.lit(first + dt.timedelta(70)))
        wanted = {}
        for day in (first + dt.timedelta(n) for n in range(71)):
            around = [(a, b, int(v)) for _, v, a, b in rows if a <= day <= b]
            if around:
                wanted[day] = max(around)[2]
        assert {r["fecha"]: int(r["trm"]) for r in days.collect()} == wanted
