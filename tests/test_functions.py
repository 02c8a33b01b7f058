import datetime as dt

import pytest
from conftest import date
from pyspark.sql import functions as F

from arqueo import constants as C
from arqueo.functions import aging, dates, finance, text


def evaluate(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


LAST_NUMBERS = [
    ("$ 1.234.567", 1234567.0), ("1.234,50", 1234.5), ("1,234.50", 1234.5), ("1,234", 1234.0), ("12,5", 12.5),
    ("1.25", 1.25), ("0.125", 125.0), ("(2.500)", -2.5), ("2.500", 2500.0), ("( 123 )", 123.0), ("Nota 5 $ 900", 900.0),
    ("12%", 12.0), ("2024-12-31", -20241231.0), ("Total", None), (None, None), ("", None),
    ("total 7 1,2.3,4", 7.0), ("5 n", 5.0), ("a1\nb2", 2.0), ("1.25)", 125.0), ("-8", -8.0),
]


def test_last_number_of_a_cell(spark):
    assert evaluate(spark, [c for c, _ in LAST_NUMBERS], "string", text.last_number) == [n for _, n in LAST_NUMBERS]


def test_last_number_reads_whole_texts(spark):
    long = "77 " + "palabra " * 30000
    assert evaluate(spark, [long], "string", text.last_number) == [77.0]


def test_rate_text(spark):
    cases = {"4,123.45": 4123.45, "4123,45": 4123.45, "$ 4123.45": 4123.45, "4.123,45": 4123.45, "4,123,45": None, None: None, "x": None}
    found = evaluate(spark, list(cases), "string", text.rate_number)
    assert [None if v is None else float(v) for v in found] == list(cases.values())


def test_lenient_numbers_and_dates(spark):
    assert [None if v is None else float(v) for v in evaluate(spark, [" 12.5 ", "NaN", "abc", None, "1e3"], "string", text.to_money)] == [12.5, None, None, None, 1000.0]
    found = evaluate(spark, ["31/12/2024", "2024-12-31", "1/2/2024", "2024-12-31 10:00:00", "nada", None], "string",
                     lambda c: text.to_day(c, day_first=True))
    assert found == [date("2024-12-31"), date("2024-12-31"), date("2024-02-01"), date("2024-12-31"), None, None]


def test_text_cleaning_keeps_accents(spark):
    assert evaluate(spark, ["\t ñandú \n"], "string", text.clean_upper) == ["ÑANDÚ"]


RISKS = [
    ("2024-05-15", 31, -31, C.RISK_CRITICAL), ("2024-05-16", 30, -30, C.RISK_RECENT), ("2024-06-14", 1, -1, C.RISK_RECENT),
    ("2024-06-15", 0, 0, C.RISK_CURRENT), ("2024-06-16", 0, 1, C.RISK_SOON), ("2024-06-22", 0, 7, C.RISK_SOON),
    ("2024-06-23", 0, 8, C.RISK_CURRENT),
]


def test_risk_classes(spark):
    today, due = dates.day("2024-06-15"), [date(d) for d, *_ in RISKS]
    assert evaluate(spark, due, "date", lambda c: aging.days_overdue(c, today)) == [r[1] for r in RISKS]
    assert evaluate(spark, due, "date", lambda c: aging.days_to_due(c, today)) == [r[2] for r in RISKS]
    assert evaluate(spark, due, "date", lambda c: aging.risk_class(c, today)) == [r[3] for r in RISKS]


def test_risk_labels_sort_from_critical_to_current(spark):
    labels = [C.RISK_CURRENT, C.RISK_SOON, C.RISK_CRITICAL, C.RISK_RECENT]
    rows = spark.createDataFrame([(x,) for x in labels], "r string").orderBy("r").collect()
    assert [r[0] for r in rows] == [C.RISK_CRITICAL, C.RISK_RECENT, C.RISK_SOON, C.RISK_CURRENT]


def test_weeks(spark):
    wednesday = dates.day("2024-06-12")
    row = spark.range(1).select(
        dates.week_start(wednesday, F.lit(1)).alias("a"), dates.week_end(wednesday, F.lit(4)).alias("b"),
        dates.week_label(wednesday, F.lit(2)).alias("c"), dates.previous_month_end(wednesday).alias("d"),
    ).first()
    assert tuple(row) == (date("2024-06-10"), date("2024-07-07"), "Sem 2 (17/06 - 23/06)", date("2024-05-31"))
    due = [date(d) for d in ("2020-01-01", "2024-06-09", "2024-06-16", "2024-06-17", "2024-07-07", "2024-07-08")]
    assert evaluate(spark, due, "date", lambda c: dates.due_week(wednesday, c, 4)) == [1, 1, 1, 2, 4, None]


def test_installments(spark):
    rows = spark.createDataFrame(
        [(1200.0, 0.0, 12), (30000000.0, 0.18, 3), (0.0, 0.18, 3), (1000.0, 0.18, 0), (-5.0, 0.1, 3)], "v double, r double, n int")
    found = [r[0] for r in rows.select(finance.installment(F.col("v"), F.col("r"), F.col("n"))).collect()]
    assert found == pytest.approx([100.0, 10279045.6419, 0.0, 0.0, 0.0])


@pytest.mark.parametrize("rate,months", [(0.0, 5), (0.07, 1), (0.185, 36), (0.3, 120)])
def test_discounted_installments_give_back_the_principal(spark, rate, months):
    quota = spark.range(1).select(finance.installment(F.lit(5e6), F.lit(rate), F.lit(months))).first()[0]
    monthly = (1 + rate) ** (1 / 12) - 1
    assert sum(quota / (1 + monthly) ** k for k in range(1, months + 1)) == pytest.approx(5e6)


def test_effective_rate_and_days(spark):
    row = spark.range(1).select(
        finance.effective_rate(F.lit("Fija"), F.lit(0.18), F.lit(0.125), F.lit(0.05)).alias("a"),
        finance.effective_rate(F.lit("Variable (IBR + Spread)"), F.lit(0.18), F.lit(0.125), F.lit(0.05)).alias("b"),
        finance.turnover_days(F.lit(10.0), F.lit(0.0)).alias("c"), finance.turnover_days(F.lit(10.0), F.lit(20.0)).alias("d"),
        finance.released_cash(F.lit(30.0), F.lit(365.0)).alias("e"),
    ).first()
    assert tuple(row) == (0.18, 0.175, None, 180.0, 30.0)


def test_csv_fields(spark):
    lines = ['a,"b, c",,"d ""q"""', "x", "1,2,"]
    assert evaluate(spark, lines, "string", text.csv_fields) == [["a", "b, c", None, 'd "q"'], ["x"], ["1", "2", None]]


def test_month_label_is_from_the_date(spark):
    assert evaluate(spark, [dt.date(2024, 2, 29)], "date", dates.month_label) == ["2024-02"]


def test_days_with_times_and_other_marks(spark):
    lines = ["31/12/2024 08:30", "2024/12/31", "2024-12-31 08:30", "2024-12-31 00:00:00.000", "2024-12-31T00:00:00Z", "12/31/2024", "31.12.2024",
             "20241231", "31 Dec 2024", "Dec 31, 2024", "2024-12-31T10:11:12.123+05:00", "31-12-2024 10:00 PM"]
    assert evaluate(spark, lines, "string", lambda c: text.to_day(c, day_first=True)) == [date("2024-12-31")] * len(lines)
    assert evaluate(spark, ["2/3/2024", "2024-02-30", "31/31/2024", "", "x"], "string", text.to_day) == [date("2024-02-03"), None, None, None, None]


def test_csv_fields_of_a_long_line(spark):
    line = ",".join(['"a, ""b"""'] * 100_000)
    found = spark.createDataFrame([(line,), ('1,"P\nSAS",2',)], "t string").select(F.size(text.csv_fields(F.col("t"))), text.csv_fields(F.col("t"))[1]).collect()
    assert [tuple(r) for r in found] == [(100_000, 'a, "b"'), (3, "P\nSAS")]


def test_days_whose_numbers_fit_no_calendar_or_change_places(spark):
    given = ["29/2/2024", "29/2/2023", "12/25/1999", "2024-13-01", "2024.1.2 5:06 PM", "1-2-2024T03:04:05.678Z", "20240230", "20240229", "-", "n/a", "5 Mar 2024", "2024", "2024-01"]
    wanted = ["2024-02-29", None, "1999-12-25", None, "2024-01-02", "2024-02-01", None, "2024-02-29", None, None, "2024-03-05", None, None]
    assert evaluate(spark, given, "string", lambda c: text.to_day(c, day_first=True)) == [date(day) for day in wanted]
