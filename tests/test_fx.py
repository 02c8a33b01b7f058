import datetime as dt
import random
from decimal import Decimal

import brute
import pytest
from conftest import date, dec, numbers, records
from pyspark.sql import functions as F

from arqueo.operators.rates import daily_rates, fill_calendar, last_rates, rate_as_of, rate_rejects
from arqueo.plans import cashflow, fx
from checks import queries

AS_OF = "2024-01-11"
RATES = [("4000", "2024-01-05", "2024-01-08"), ("4010", "2024-01-09", "2024-01-09"),
         ("4020", "2024-01-10", "2024-01-10"), ("4050", "2024-01-11", "2024-01-11")]
PAYMENTS = [("A", "2024-01-06", 200, 3990), ("A", "2024-01-11", 300, 4040), ("B", "2024-01-06", 100, 4005),
            ("C", "2024-01-09", 400, 4000), ("Z", "2024-01-09", 50, 4000)]
SUMMARY = ("trm_factura", "anticipo_previo_total_usd", "abonos_post_factura_total_usd", "saldo_vivo_actual_usd", "dif_anticipos",
           "dif_realizada_post", "dif_no_realizada", "dif_no_realizada_mes", "dif_total", "dif_dia_base", "dif_dia_plus_2pct", "dif_dia_minus_2pct")
SERIES = ("trm", "saldo_total_usd", "dif_anticipos_total", "dif_realizada_post_total", "dif_no_realizada_total", "dif_total", "dif_dia_base")


@pytest.fixture(scope="module")
def golden(make):
    facturas = make.facturas([("A", "c1", "2024-01-10", 1000), ("B", "c2", "2024-01-06", 500), ("C", "c3", None, 300)])
    payments = make.monetizaciones(PAYMENTS)
    rates = daily_rates(make.intervalos(RATES), F.lit("2024-01-05").cast("date"), F.lit(AS_OF).cast("date"))
    return facturas, payments, rates


def test_golden_summary(golden):
    found = records(fx.fx_summary(*golden, AS_OF), "factura")
    assert numbers(found["A"], SUMMARY) == [4020, 200, 300, 500, 6000, 6000, 15000, 15000, 27000, 15000, 55500, -25500]
    assert numbers(found["B"], SUMMARY) == [4000, 0, 100, 400, 0, 500, 20000, 20000, 20500, 12000, 44400, -20400]
    assert numbers(found["C"], SUMMARY) == [None, 400, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    assert len(found) == 3


def test_golden_series(golden):
    found = records(fx.fx_daily_totals(*golden, AS_OF), "fecha")
    want = {
        "2024-01-05": [4000, 0, 0, 0, 0, 0, 0], "2024-01-06": [4000, 400, 0, 500, 0, 500, 0],
        "2024-01-07": [4000, 400, 0, 500, 0, 500, 0], "2024-01-08": [4000, 400, 0, 500, 0, 500, 0],
        "2024-01-09": [4010, 400, 0, 500, 4000, 4500, 4000], "2024-01-10": [4020, 1200, 6000, 500, 8000, 14500, 4000],
        "2024-01-11": [4050, 900, 6000, 6500, 35000, 47500, 27000],
    }
    assert {str(k): numbers(v, SERIES) for k, v in found.items()} == want


def test_no_payments_at_all(make, golden):
    facturas, _, rates = golden
    none = make.monetizaciones([])
    row = records(fx.fx_summary(facturas, none, rates, AS_OF), "factura")["A"]
    assert numbers(row, SUMMARY)[:4] == [4020, 0, 0, 1000]
    last = records(fx.fx_daily_totals(facturas, none, rates, AS_OF), "fecha")[date(AS_OF)]
    assert float(last["saldo_total_usd"]) == 1500


def random_case(seed):
    """Shared invoice numbers, blanks, reversals, unknown rates and days, gaps in the rates, dates outside them."""
    rng = random.Random(seed)
    start = dt.date(2024, 1, 10)

    def some_day(low, high):
        return start + dt.timedelta(days=rng.randint(low, high))

    numbers_ = ["N1", "N2", "N3", "N4", "", "HOT", "HOT", "HOT", None]
    invoices = []
    for i in range(30):
        number = rng.choice(numbers_)
        day = None if rng.random() < 0.15 else some_day(-8, 45)
        invoices.append((number, f"c{i}", day, Decimal(rng.randint(100, 90000)) / 100))
    payments = []
    for _ in range(80):
        payments.append((
            rng.choice(numbers_ + ["GHOST"]), None if rng.random() < 0.08 else some_day(-15, 50),
            None if rng.random() < 0.05 else Decimal(rng.randint(-2000, 30000)) / 100,
            None if rng.random() < 0.1 else Decimal(rng.randint(38000, 42000)) / 10,
        ))
    rates, day = {}, start
    while day < dt.date(2024, 2, 15):
        rates[day] = Decimal(rng.randint(390000, 420000)) / 100
        day += dt.timedelta(days=rng.choice([1, 1, 1, 2, 4]))
    return invoices, payments, rates


def tables(make, case):
    invoices, payments, rates = case
    return (
        make.facturas([(n, c, d and d.isoformat(), v) for n, c, d, v in invoices]).repartition(3),
        make.monetizaciones([(n, d and d.isoformat(), m, t) for n, d, m, t in payments]).repartition(5),
        make.rates([(d.isoformat(), v) for d, v in rates.items()]).repartition(2),
    )


def rounded(value):
    if isinstance(value, (Decimal, float, int)) and not isinstance(value, bool):
        return round(float(value), 4)
    return value


def bag(rows):
    return sorted((tuple(map(rounded, row)) for row in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jobs_equal_going_through_every_day(make, seed):
    case, as_of = random_case(seed), dt.date(2024, 2, 20)
    inputs = tables(make, case)
    found = fx.fx_summary(*inputs, as_of).drop("entity_id").collect()
    assert bag(found) == bag(brute.summary(*case, as_of))

    names = ["fecha", "factura", "cliente", "valor_usd", "trm_factura", "anticipo_previo_usd", "abonos_post_factura_usd",
             "saldo_vivo_usd", "dif_anticipos", "dif_realizada_post", "dif_no_realizada", "dif_total", "trm"]
    found = fx.fx_daily_detail(*inputs, as_of).select(*names).collect()
    assert bag(found) == bag(brute.detail(*case))

    found = fx.fx_daily_totals(*inputs, as_of).drop("entity_id").collect()
    assert bag(found) == bag(brute.series(*case))


def test_series_of_one_invoice(make):
    case, as_of = random_case(4), dt.date(2024, 2, 20)
    inputs = tables(make, case)
    invoice = min((i for i in case[0] if i[0] == "HOT" and i[2] is not None), key=lambda i: (i[2], i[1]))
    want, last = [], None
    for row in brute.detail([invoice], case[1], case[2], newest_if_older=True):
        want.append((row[0], row[10], row[11], Decimal(0) if last is None else row[10] - last))
        last = row[10]
    found = fx.fx_invoice_series(*inputs, as_of, factura="HOT").select("fecha", "dif_no_realizada", "dif_total", "dif_dia_base")
    assert bag(found.collect()) == bag(want)
    everything = fx.fx_invoice_series(*inputs, as_of).where("factura = 'HOT'").select("fecha", "dif_no_realizada", "dif_total", "dif_dia_base")
    assert bag(everything.collect()) == bag(want)


def test_movements(make):
    facturas = make.facturas([("A", "c", "2024-01-10", 1000)])
    payments = make.monetizaciones([
        ("A", "2024-01-01", 100, 3990), ("A", "2024-01-06", 300, 4030), ("A", "2024-01-10", 50, 4000),
        ("A", "2024-01-12", 70, None), ("A", None, 10, 1), ("B", "2024-01-12", 10, 1)])
    rates = make.rates([("2024-01-05", 4000), ("2024-01-10", 4020)])
    found = records(fx.fx_movements(facturas, payments, rates, "2024-01-11", label_from=100), "fecha")
    got = {str(k): (float(v["trm"]), v["tipo_mov"], rounded(v["dif_mov"]), v["size"], v["ganancia"], v["etiqueta"]) for k, v in found.items()}
    assert got == {
        "2024-01-01": (4000.0, "Anticipo", 3000.0, 60.0, True, True),  # before the curve: next payment's rate
        "2024-01-06": (4000.0, "Anticipo", -3000.0, 260.0, False, True),
        "2024-01-10": (4020.0, "Post-factura", -1000.0, 60.0, False, False),
        "2024-01-12": (4020.0, "Post-factura", None, 260.0, False, False),
    }


def test_movement_sizes_of_equal_amounts(make):
    facturas = make.facturas([("A", "c", "2024-01-10", 1000)])
    payments = make.monetizaciones([("A", "2024-01-10", 50, 4000), ("A", "2024-01-11", 50, 4000)])
    found = fx.fx_movements(facturas, payments, make.rates([("2024-01-05", 4000)]), "2024-01-11").collect()
    assert [r["size"] for r in found] == [140.0, 140.0]


def test_month_base_uses_previous_month_end(make):
    facturas = make.facturas([("OLD", "c", "2024-01-10", 100), ("NEW", "c", "2024-02-02", 100)])
    rates = make.rates([("2024-01-05", 4000), ("2024-01-31", 4100), ("2024-02-01", 4150), ("2024-02-05", 4200)])
    found = records(fx.fx_summary(facturas, make.monetizaciones([]), rates, "2024-02-05"), "factura")
    assert numbers(found["OLD"], ["dif_no_realizada", "dif_no_realizada_mes"]) == [20000, 10000]
    assert numbers(found["NEW"], ["dif_no_realizada", "dif_no_realizada_mes"]) == [5000, 5000]


def test_portfolio_totals(golden):
    summary = fx.fx_summary(*golden, AS_OF)
    row = fx.fx_portfolio_totals(summary).first()
    assert [float(row[n]) for n in ("saldo_vivo_usd", "realizada_total", "no_realizada_mes", "no_realizada_acumulada", "dif_total",
                                    "sin_fecha_valor_usd", "sin_fecha_anticipos_usd", "sin_fecha_saldo_usd")] == [900, 12500, 35000, 35000, 47500, 300, 400, 0]
    assert fx.fx_status(summary).count() == 2


def test_companies_do_not_mix(make, golden):
    facturas, payments, rates = golden
    other = facturas.withColumn("entity_id", F.lit("f"))
    both = fx.fx_summary(facturas.unionByName(other), payments, rates, AS_OF)
    found = records(both, "entity_id", "factura")
    assert float(found["f", "A"]["saldo_vivo_actual_usd"]) == 1000 and float(found["e", "A"]["saldo_vivo_actual_usd"]) == 500


# --- rates --------------------------------------------------------------------

def span(start, end):
    return F.lit(start).cast("date"), F.lit(end).cast("date")


def test_intervals_become_days_and_later_records_win(make):
    table = make.intervalos([("1", "2023-12-30", "2024-01-02"), ("2", "2024-01-02", "2024-01-03"), ("9", "2024-02-01", "2024-01-20")])
    found = records(daily_rates(table, *span("2024-01-01", "2024-01-31")), "fecha")
    assert {str(k): float(v["trm"]) for k, v in found.items()} == {"2024-01-01": 1, "2024-01-02": 2, "2024-01-03": 2}


def test_a_source_with_an_unreadable_rate_is_passed_over(make):
    table = make.intervalos([("1", "2024-01-01", "2024-01-02", 1), ("4,1,2", "2024-01-03", "2024-01-03", 1), ("7", "2024-01-01", "2024-01-03", 2)])
    found = daily_rates(table, *span("2024-01-01", "2024-01-31")).collect()
    assert {float(r["trm"]) for r in found} == {7.0}
    assert [r["valor"] for r in rate_rejects(table).collect()] == ["4,1,2"]
    outside = make.intervalos([("x", "2023-01-03", "2023-01-03", 1), ("1", "2024-01-01", "2024-01-02", 1)])
    assert daily_rates(outside, *span("2024-01-01", "2024-01-31")).count() == 2


def test_no_usable_source_is_an_error(make):
    table = make.intervalos([("bad", "2024-01-01", "2024-01-02")])
    with pytest.raises(Exception, match="no usable rate source"):
        daily_rates(table, *span("2024-01-01", "2024-01-31")).collect()


def test_as_of_lookup(make, spark):
    rates, end = make.rates([("2024-01-05", 1), ("2024-01-08", 2)]), F.lit("2024-01-10").cast("date")
    days = ["2024-01-04", "2024-01-05", "2024-01-07", "2024-01-08", "2024-01-10", "2030-01-01", None]
    rows = spark.createDataFrame([(i, date(d)) for i, d in enumerate(days)], "i int, d date")
    found = rate_as_of(rows, "d", rates, end, "r").orderBy("i").collect()
    assert [r["r"] and float(r["r"]) for r in found] == [None, 1, 1, 2, 2, 2, None]
    assert fill_calendar(rates, end).count() == 6


def test_single_rate_row_is_its_own_predecessor(make, spark):
    now = last_rates(make.rates([("2024-01-05", 7)]), F.lit("2023-12-31").cast("date"))
    assert [float(v) for v in spark.range(1).select(now.alias("s")).first()["s"]] == [7, 7, 7]


def test_range_starts_at_the_first_invoice_or_payment(make):
    facturas = make.facturas([("A", "c", "2024-01-10", 1)])
    intervals = make.intervalos([("5", "2023-01-01", "2024-12-31")])
    early = make.monetizaciones([("A", "2024-01-08", 1, 1)])
    assert fx.fx_rates(facturas, early, intervals, "2024-01-12").count() == 5
    assert fx.fx_rates(facturas, make.monetizaciones([]), intervals, "2024-01-12").count() == 3
    assert fx.fx_rates(make.facturas([]), make.monetizaciones([]), intervals, "2024-01-12").count() == 1


@pytest.mark.parametrize("rows", [[], [("4000", "1990-01-01", "1990-02-01")], [("abc", "2024-01-01", "2024-02-01")], [("4000", None, "2024-02-01")]])
def test_no_usable_rates_is_an_error_everywhere(spark, make, rows):
    facturas, payments = make.facturas([("A", "c", "2024-01-05", 100)]), make.monetizaciones([("A", "2024-01-06", 10, 4000)])
    rates = fx.fx_rates(facturas, payments, make.intervalos(rows), "2024-01-12")
    inputs = (facturas, payments, rates, "2024-01-12")
    summary = fx.fx_summary(*inputs)
    for job in (lambda: summary, lambda: fx.fx_daily_totals(*inputs), lambda: fx.fx_movements(*inputs), lambda: fx.fx_daily_detail(*inputs),
                lambda: cashflow.weekly_collection(make_summary(make), rates, "2024-01-12")):
        with pytest.raises(Exception, match="no usable rate"):
            job().collect()


def make_summary(make):
    return fx.fx_summary(make.facturas([("A", "c", "2024-01-05", 100)]), make.monetizaciones([]), make.rates([("2024-01-05", 4000)]), "2024-01-12")


def test_bad_dates_discredit_a_source(make):
    table = make.intervalos([("4000", "2024-01-01", "2024-01-31", 1), ("4001", None, "2024-01-31", 1), ("5000", "2024-01-01", "2024-01-31", 2)])
    assert {r["trm"] for r in daily_rates(table, *span("2024-01-01", "2024-01-31")).collect()} == {dec("5000")}
    assert [(r["valor"], r["motivo"]) for r in rate_rejects(table).collect()] == [("4001", "fecha ilegible")]


def shared_number(spark, invoices, days, per_day="1.00"):
    """One number with many invoices and many payment days."""
    facturas = spark.range(invoices).select(
        F.lit("e").alias("entity_id"), F.lit("A").alias("factura"), F.lit("c").alias("cliente"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("fecha_factura"), F.lit("USD").alias("moneda"),
        (F.col("id") % 997 + 1).cast("decimal(18,2)").alias("valor_usd"))
    pagos = spark.range(days).select(
        F.lit("e").alias("entity_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("fecha"), F.lit("A").alias("factura"),
        F.lit(per_day).cast("decimal(18,2)").alias("monto_usd"), F.lit(4000).cast("decimal(18,4)").alias("tasa_monetizacion"))
    rates = spark.range(days).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("fecha"), (4000 + F.col("id") % 7).cast("decimal(18,4)").alias("trm"))
    return facturas, pagos, rates


def test_daily_totals_of_a_shared_number_need_no_pairs(spark):
    """20,000 invoices and 1,000 payment days of one number: no operator of the plan makes more than a few rows for each."""
    facturas, pagos, rates = shared_number(spark, 20_000, 1_000)
    df = fx.fx_daily_totals(facturas, pagos, rates, "2026-09-26")
    assert len(df.collect()) == 1_000
    made, plans = [], [df._jdf.queryExecution().executedPlan()]
    while plans:
        node = plans.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(node.plan())
        else:
            plans += [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            made.append(rows.get().value())
    assert len(made) > 20 and max(made) < 100_000


@pytest.mark.parametrize("per_part", [1_000_000, 7])
def test_daily_totals_like_brute_force(spark, make, monkeypatch, per_part):
    """Numbers that share many invoices, equal invoices, numbers with payments taken back, unrated and unnumbered invoices, parts of a number."""
    monkeypatch.setattr(fx, "_INVOICES_PER_PART", per_part)
    rng = random.Random(per_part)
    days = [str(date("2024-01-01") + dt.timedelta(n)) for n in range(40)]
    rates = {d: 4000 + n * 3 % 11 for n, d in enumerate(days[3:])}
    facturas = [(rng.choice(["A", "B", "C", "D", None]), "c", rng.choice(days), rng.choice([5, 10, 10.5, 40])) for _ in range(80)]
    pagos = [(rng.choice(days), rng.choice("ABC"), rng.choice([1, 2.5, 7]), rng.choice([None, 3900, 4100])) for _ in range(60)]
    pagos += [(rng.choice(days), "C", -6, 4000) for _ in range(4)] + [(None, "A", 100, 1)]
    found = {str(r["fecha"]): r for r in fx.fx_daily_totals(
        make.facturas(facturas), make.monetizaciones([(f, d, m, t) for d, f, m, t in pagos]), make.rates(list(rates.items())), days[-1]).collect()}
    assert set(found) == set(rates)
    for today in rates:
        totals = [0.0] * 4
        for number, _, start, value in facturas:
            if start > today:
                continue
            known = [d for d in rates if d <= start]
            rate = rates[max(known)] if known else None
            mine = [p for p in pagos if p[1] == number and p[0] is not None]
            before, later = [p for p in mine if p[0] < start], [p for p in mine if start <= p[0] <= today]
            balance = max(value - sum(p[2] for p in before + later), 0)
            totals[0] += balance
            if rate is not None:
                totals[1] += sum((rate - p[3]) * p[2] for p in before if p[3] is not None)
                totals[2] += sum((p[3] - rate) * p[2] for p in later if p[3] is not None)
                totals[3] += balance * (rates[today] - rate)
        names = ("saldo_total_usd", "dif_anticipos_total", "dif_realizada_post_total", "dif_no_realizada_total")
        assert [float(found[today][n]) for n in names] == pytest.approx(totals)


@pytest.mark.parametrize("job", [fx.fx_daily_detail, fx.fx_invoice_series])
def test_days_are_unfolded_by_a_given_number_of_tasks(golden, job):
    """Adaptive execution would leave the few bytes of the spans to one task, whatever the number of their days."""
    facturas, payments, rates = golden
    text = F.concat_ws("|", "factura", F.col("saldo_vivo_usd").cast("string"))
    rows = job(facturas, payments, rates, AS_OF, carried={"texto": text})
    assert "RoundRobinPartitioning" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.columns == [*job(facturas, payments, rates, AS_OF).columns, "texto"]
    found = rows.withColumn("de_la_fila", text).collect()
    assert len(found) == 2 * 7 and all(r.texto == r.de_la_fila for r in found)
    assert {r.dif_total for r in found} == {r.dif_anticipos + r.dif_realizada_post + r.dif_no_realizada for r in found}


@pytest.mark.parametrize("job", [fx.fx_daily_detail, fx.fx_invoice_series])
def test_days_look_up_the_calendar_by_number_and_bring_what_is_the_same_on_them(golden, job):
    detail = job(*golden, AS_OF, of_day={"texto": F.concat_ws("|", F.col("fecha").cast("string"), F.col("trm").cast("string"))})
    rows = detail.collect()
    assert [tuple(r)[:-1] for r in rows] == [tuple(r) for r in job(*golden, AS_OF).collect()]
    assert rows and all(r.texto == f"{r.fecha}|{r.trm}" for r in rows)
    plan = detail._jdf.queryExecution().executedPlan().toString()
    assert any("HashJoin [__dia" in line for line in plan.split("\n"))


def test_digits_of_a_decimal(spark):
    values = ["0", "-0.000001", "0.000001", "0.999999", "-0.5", "1", "-1.000001", "10.5", "-123456789.1", "12345678901234567890.123456", None]
    df = spark.createDataFrame([(None if v is None else Decimal(v),) for v in values], "v decimal(38,6)")
    found = df.select(queries.digits(F.col("v"), 6)).collect()
    assert [r[0] for r in found] == [None if v is None else str(int(Decimal(v) * 10 ** 6)) for v in values]
    short = df.select(F.col("v").cast("decimal(28,2)").alias("v")).select("v", queries.digits(F.col("v"), 2).alias("text")).collect()
    assert all(r.text == (None if r.v is None else str(int(r.v * 100))) for r in short)
