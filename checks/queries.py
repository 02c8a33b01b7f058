"""Every job over the given tables, with columns in a form that compares across engines."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo import constants as C
from arqueo.functions import finance, text
from arqueo.functions.aging import risk_class
from arqueo.functions.dates import day
from arqueo.operators.payments import daily_payments, payment_curve, split_by_invoice_date
from arqueo.operators.rates import daily_rates, fill_calendar, last_rates, rate_as_of
from arqueo.plans import cashflow, executive, fx, loans, payables, scenarios, statements
from arqueo.schemas import ENTITY
from arqueo.session import new_table_path
from arqueo.sources import cashplan, receivables, sinks
from arqueo.sources import payables as bill_source
from arqueo.sources import statements as statement_source
from checks.tables import BILLS_AS_OF, FX_AS_OF, Tables

SPREADS = ("0.01", "0.02", "0.05")
SHARED_NUMBERS = 997
YOUNG_CURVE = "1998-01-01"
ONE_INVOICE = "7"
LAYERED = ("1995-12-20", "1999-06-30")
CHOSEN_MONTHS = ("1998-03", "1999-01")
CHOSEN_SUPPLIERS = ("Supplier#000000001", "Supplier#000000003", "Supplier#000000007")
CHOSEN_RISKS = (C.RISK_CRITICAL, C.RISK_SOON)
LOAN_TERMS = ((0.0, 12), (0.125, 6), (0.18, 3), (0.165, 84))
CYCLE_STEPS = ((0.0, 0.0), (15.0, 0.0), (0.0, 30.0), (30.0, 45.0))


def comparable(df: DataFrame) -> DataFrame:
    """Money to cents as DOUBLE, rates to 4 places, other doubles to 6, days as text, integers as BIGINT."""
    def shape(field: T.StructField):
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            column = column.cast("decimal(24,2)" if kind.scale in (2, 6) else "decimal(24,4)").cast("double")
        elif isinstance(kind, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.IntegralType):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select(*map(shape, df.schema.fields))


class Jobs:
    """Shared inputs of the queries, built lazily."""

    def __init__(self, tables: Tables):
        self.t = tables
        self._rates: DataFrame | None = None

    @property
    def unfolded_rates(self) -> DataFrame:
        return fx.fx_rates(self.t.facturas, self.t.monetizaciones, self.t.trm_intervalos, FX_AS_OF)

    @property
    def rates(self) -> DataFrame:
        """Landed once per query, as a table of one row per day."""
        if self._rates is None:
            self._rates = sinks.landed_rates(self.unfolded_rates)
        return self._rates

    @property
    def fx_inputs(self):
        return self.t.facturas, self.t.monetizaciones, self.rates, FX_AS_OF

    @property
    def summary(self) -> DataFrame:
        return fx.fx_summary(*self.fx_inputs)

    @property
    def aged(self) -> DataFrame:
        return payables.payables_aging(self.t.compras, BILLS_AS_OF)

    @property
    def items(self) -> DataFrame:
        return statements.statement_items(self.t.eeff_filas(F.col("o_orderkey") % 5))

    @property
    def customer_items(self) -> DataFrame:
        return statements.statement_items(self.t.eeff_filas(F.col("o_custkey")))


def _rate_lookup(j: Jobs) -> DataFrame:
    priced = rate_as_of(j.t.facturas, "fecha_factura", j.rates, day(FX_AS_OF), "trm_factura")
    return priced.select(ENTITY, "factura", "fecha_factura", "trm_factura")


def _payment_rate_lookup(j: Jobs) -> DataFrame:
    moves = j.t.monetizaciones.where(F.col("fecha").isNotNull()).groupBy(ENTITY, "factura", "fecha").agg(
        F.count(F.lit(1)).alias("pagos"), F.sum("monto_usd").cast("decimal(28,2)").alias("monto_usd"))
    return rate_as_of(moves, "fecha", j.rates, day(FX_AS_OF), "trm")


def _newest_rates(j: Jobs) -> DataFrame:
    """The three reference rates next to what each entity has in the portfolio."""
    now = last_rates(j.rates, F.lit("2001-06-30").cast("date"))
    return j.t.facturas.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("facturas")).select(
        ENTITY, "facturas", *(now[name].alias(name) for name in ("trm_actual", "trm_ayer", "trm_cierre")))


def _filled_calendar(j: Jobs) -> DataFrame:
    return fill_calendar(j.rates, day(FX_AS_OF))


def _first_day(j: Jobs) -> DataFrame:
    first = fx.first_needed_day(j.t.facturas, j.t.monetizaciones, day(FX_AS_OF))
    return j.t.facturas.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("facturas")).select(ENTITY, "facturas", first.alias("primer_dia"))


def _split(j: Jobs) -> DataFrame:
    return split_by_invoice_date(j.t.facturas, daily_payments(j.t.monetizaciones)).drop("primer_pago")


def _curve(j: Jobs) -> DataFrame:
    return payment_curve(daily_payments(j.t.monetizaciones.where(F.col("fecha").isNotNull())))


def _daily_detail_by_month(j: Jobs) -> DataFrame:
    """The dense daily detail of every invoice, written out in full and added up per company and month."""
    detail = fx.fx_daily_detail(*j.fx_inputs)
    names = ("abonos_post_factura_usd", "saldo_vivo_usd", "dif_anticipos", "dif_realizada_post", "dif_no_realizada", "dif_total")
    months = detail.groupBy(ENTITY, F.trunc("fecha", "MM").alias("mes")).agg(
        F.count(F.lit(1)).alias("filas"), *(F.sum(name).cast("decimal(38,6)").alias(name) for name in names))
    return months.withColumn("mes", F.date_format("mes", "yyyy-MM"))


def _series_extremes(j: Jobs) -> DataFrame:
    """Daily series of every invoice; its best and worst day-on-day change."""
    series = fx.fx_invoice_series(*j.fx_inputs)
    return series.groupBy(ENTITY, "factura").agg(
        F.count(F.lit(1)).alias("dias"), F.max("dif_dia_base").alias("mejor_dia"), F.min("dif_dia_base").alias("peor_dia"))


def digits(value: Column, scale: int) -> Column:
    """A decimal times 10 ** scale as text. From 1 on these are the digits of the number without its point, which saves a division of
    large numbers."""
    plain = value.cast("string")
    whole = (value * F.lit(10 ** scale)).cast("decimal(38,0)").cast("string")
    return (F.when(plain == f"0.{'0' * scale}", F.lit("0")).when(plain.startswith("0.") | plain.startswith("-0."), whole)
            .otherwise(F.replace(plain, F.lit("."), F.lit(""))))


def _fingerprint(job: Callable[..., DataFrame], j: Jobs) -> DataFrame:
    """Per company and month the number of rows and a sum, in whatever order, of a hash of all columns of each.

    The text of the columns that are the same on all days of a span is made once per span, that of the day and its rate once per day, and comes
    with every row.
    """
    inputs = j.fx_inputs
    fields = job(*inputs).schema.fields
    scales = {field.name: getattr(field.dataType, "scale", None) for field in fields}

    def as_text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string") if scales[name] is None else digits(F.col(name), scales[name]), F.lit("null"))

    constant = F.concat_ws("|", *map(as_text, fx.DETAIL_CONSTANTS))
    of_day = {f"texto_{name}": as_text(name) for name in ("fecha", "trm")}
    rows = job(*inputs, carried={"constantes": constant}, of_day=of_day)
    daily = [name for name in scales if name not in (ENTITY, "fecha", *fx.DETAIL_CONSTANTS)]  # they follow the constants
    row_text = F.concat_ws("|", "texto_fecha", "constantes", *(F.col("texto_trm") if name == "trm" else as_text(name) for name in daily))
    # Of 48 bits the upper and the lower half are summed apart, as integers.
    number = F.conv(F.substring(F.md5(row_text), 1, 12), 16, 10).cast("bigint")
    months = rows.select(ENTITY, F.trunc("fecha", "MM").alias("mes"), number.alias("n")).groupBy(ENTITY, "mes").agg(
        F.count(F.lit(1)).alias("filas"), F.sum(F.shiftright("n", 24)).cast("decimal(20,0)").alias("alto"),
        F.sum(F.col("n").bitwiseAND(F.lit(2 ** 24 - 1))).alias("bajo"))
    total = (F.col("alto") * F.lit(2 ** 24) + F.col("bajo")).cast("decimal(38,0)").cast("string")
    return months.select(ENTITY, F.date_format("mes", "yyyy-MM").alias("mes"), "filas", total.alias("huella"))


def _daily_detail_digest(j: Jobs) -> DataFrame:
    """The dense daily detail in every column of every row."""
    return _fingerprint(fx.fx_daily_detail, j)


def _series_digest(j: Jobs) -> DataFrame:
    """The daily series of every invoice in every column of every row."""
    return _fingerprint(fx.fx_invoice_series, j)


def _cash_flow(j: Jobs) -> DataFrame:
    collection = cashflow.weekly_collection(j.summary, j.rates, FX_AS_OF)
    due = cashflow.open_payables_by_week(j.t.compras, j.t.pagos, BILLS_AS_OF)
    return cashflow.cash_flow(collection, due, j.t.cash_plan, loans.price_loans(j.t.loans), BILLS_AS_OF)


def _ledger_after_close(j: Jobs) -> DataFrame:
    ledger = j.t.ledger
    return cashflow.ledger_history(ledger.unionByName(cashflow.not_yet_closed(j.t.closes, ledger)))


def _rate_text(j: Jobs) -> DataFrame:
    return j.t.trm_intervalos.select("vigenciadesde", "vigenciahasta", "valor", text.rate_number(F.col("valor")).alias("trm"))


def _document_numbers(j: Jobs) -> DataFrame:
    return j.t.read("documents").select("doc_id", text.last_number(F.col("text")).alias("ultimo_numero"))


def _statement_numbers(j: Jobs) -> DataFrame:
    """Every cell of every row."""
    cells = j.t.eeff_filas(F.col("o_custkey")).select(ENTITY, "row_seq", F.posexplode("cells").alias("celda", "c"))
    return cells.select(ENTITY, "row_seq", "celda", F.col("c.raw").alias("texto"), text.last_number(F.col("c.raw")).alias("numero"))


def _ordered_detail(j: Jobs) -> DataFrame:
    """Chosen suppliers and classes with the place of each bill in the order of the list."""
    rows = payables.supplier_group_detail(j.aged, CHOSEN_SUPPLIERS, CHOSEN_RISKS)
    place = W.partitionBy("PROVEEDOR").orderBy("RIESGO", "VENCIMIENTO", ENTITY, "FACTURA", "VALOR")
    return rows.withColumn("puesto", F.row_number().over(place))


def _bill_rows_that_go(j: Jobs) -> DataFrame:
    return bill_source.bill_rejects(j.t.text_bills).groupBy("motivo").agg(F.count(F.lit(1)).alias("filas"))


def _bills_of_files(j: Jobs) -> DataFrame:
    """Files written from the given tables and read back; other columns have their own names and types."""
    wide = bill_source.with_extra_columns(bill_source.read_bills(j.t.spark, j.t.bill_files))
    return wide.select(ENTITY, "PROVEEDOR", "FACTURA", "VALOR", "GENERACIO", "VENCIMIENTO", "NOTA", F.col("CANTIDAD").cast("double").alias("CANTIDAD"))


def _rejects_of_files(j: Jobs) -> DataFrame:
    """What the files hold besides bills: records that go, and files that lack columns."""
    files = j.t.bill_files
    folder = F.regexp_extract("archivo", "/([a-d])/[^/]*$", 1).alias("carpeta")
    lines = bill_source.bill_line_rejects(j.t.spark, files).select(folder, "motivo")
    whole = bill_source.bill_file_rejects(j.t.spark, files).select(folder, F.concat_ws(": ", "motivo", F.array_join("faltan", " ")).alias("motivo")).distinct()
    return lines.unionByName(whole).groupBy("carpeta", "motivo").agg(F.count(F.lit(1)).alias("filas"))


def _items_of_files(j: Jobs) -> DataFrame:
    paths, manifest = j.t.statement_files
    return statements.statement_items(statement_source.read_statement_files(j.t.spark, paths, manifest=manifest))


def _shared(table: DataFrame) -> DataFrame:
    """The same rows with few numbers, so that many invoices and payments share one."""
    return table.withColumn("factura", (F.col("factura").cast("bigint") % SHARED_NUMBERS).cast("string"))


def _shared_inputs(j: Jobs):
    """Some of the numbers have payments that are taken back."""
    pagos, amount = _shared(j.t.monetizaciones), F.col("monto_usd")
    back = (F.col("factura").cast("int") < 20) & (F.floor(amount) % 5 == 0)
    return _shared(j.t.facturas), pagos.withColumn("monto_usd", F.when(back, -amount).otherwise(amount)), j.rates, FX_AS_OF


def _young_rates(j: Jobs) -> DataFrame:
    """A curve that starts after many invoices and payments."""
    return sinks.landed_rates(daily_rates(j.t.trm_intervalos, day(YOUNG_CURVE), day(FX_AS_OF)))


def _without_some_numbers(bills: DataFrame) -> DataFrame:
    return bills.withColumn("FACTURA", F.when(F.col("FACTURA").cast("bigint") % 43 != 0, F.col("FACTURA")))


def _invoices_from_text(j: Jobs) -> DataFrame:
    """Dates with the month first, with the name of the month, with a time, and such that are none; amounts as text."""
    key, created = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    style = key % 5
    shown = F.when(style == 0, F.date_format(created, "MM/dd/yyyy")).when(style == 1, F.date_format(created, "yyyy-MM-dd HH:mm:ss")).when(
        style == 2, F.date_format(created, "d-MMM-yyyy")).when(style == 3, F.date_format(created, "yyyy.M.d")).otherwise("sin fecha")
    return receivables.prepare_invoices(j.t.read("orders").select(
        F.concat(F.lit(" "), key, F.lit("\t")).alias("factura"), F.col("o_custkey").alias("cliente"), shown.alias("fecha_factura"),
        F.when(key % 37 == 0, "EUR").otherwise(" usd ").alias("moneda"),
        F.when(key % 41 == 0, "mil").when(key % 43 == 0, "-5").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)"))).alias("valor_usd")))


def _series_of_one(j: Jobs) -> DataFrame:
    """The daily series of one invoice from its date on."""
    facturas, monetizaciones, rates, as_of = j.fx_inputs
    first = facturas.where(F.col("factura") == ONE_INVOICE).agg(F.min("fecha_factura")).scalar()
    series = fx.fx_invoice_series(facturas, monetizaciones, rates, as_of, factura=ONE_INVOICE)
    return series.where(F.col("fecha") >= first).select(
        ENTITY, "factura", "fecha", "trm", "abonos_post_factura_usd", "saldo_vivo_usd", "dif_anticipos", "dif_realizada_post", "dif_no_realizada")


def _layered_days(j: Jobs) -> DataFrame:
    return daily_rates(j.t.layered_intervals, F.lit(LAYERED[0]).cast("date"), F.lit(LAYERED[1]).cast("date"))


def _plan_of_documents(j: Jobs) -> DataFrame:
    return cashplan.plan_weeks(cashplan.read_plan_documents(j.t.spark, j.t.plan_documents, multi_line=False))


def _ledger_of_documents(j: Jobs) -> DataFrame:
    return cashplan.closed_weeks(cashplan.read_plan_documents(j.t.spark, j.t.plan_documents, multi_line=False), BILLS_AS_OF)


def _broken_documents(j: Jobs) -> DataFrame:
    return cashplan.plan_document_rejects(j.t.spark, j.t.plan_documents, multi_line=False).select("documento")


def _ledger_after_repeats(j: Jobs) -> DataFrame:
    """A ledger written by two writers with the same old ledger, one of them twice, and read back."""
    path, ledger, closes = new_table_path(j.t.spark), j.t.ledger, j.t.closes
    sinks.append_closes(path, ledger, ledger.limit(0))
    half = closes.where(F.col("week_start") < F.lit(BILLS_AS_OF))
    for part in (half, closes, half):
        sinks.append_closes(path, part, ledger)
    return cashplan.read_ledger(j.t.spark, path)


def _risk_counts(j: Jobs) -> DataFrame:
    risk = risk_class(F.col("VENCIMIENTO"), day(BILLS_AS_OF))
    return j.t.compras.groupBy(ENTITY, risk.alias("RIESGO")).agg(F.count(F.lit(1)).alias("n"), F.sum("VALOR").cast("decimal(28,2)").alias("VALOR"))


def _asset_totals(j: Jobs) -> DataFrame:
    assets = j.t.read("part").select(
        F.col("p_brand").alias(ENTITY), F.col("p_name").alias("maquina"), F.col("p_retailprice").cast("decimal(18,2)").alias("valor"))
    return loans.price_loans(loans.leaseback_loans(assets, 0.165, 7))


def _credit_rates(j: Jobs) -> DataFrame:
    key = F.col("c_custkey")
    requests = j.t.read("customer").select(
        key.cast("string").alias(ENTITY), F.col("c_acctbal").alias("monto"),
        F.when(key % 2 == 0, "Fija").otherwise("Variable (IBR + Spread)").alias("tipo_tasa"),
        F.lit(0.18).alias("tasa_fija"), F.lit(0.05).alias("spread"), (key % 6 + 1).alias("meses"))
    return loans.price_loans(loans.credit_loans(requests, 0.125))


def _cycle_grid(j: Jobs) -> DataFrame:
    items = j.items
    days = statements.working_capital_days(items, payables.overdue_share(j.t.compras, BILLS_AS_OF))
    companies = days.join(items.select(ENTITY, F.col("Ingresos").alias("ventas_anuales")), ENTITY)
    return scenarios.cash_cycle_grid(companies, CYCLE_STEPS)


def _week_payables(j: Jobs) -> DataFrame:
    due = cashflow.open_payables_by_week(j.t.compras, j.t.pagos, BILLS_AS_OF)
    weeks = cashflow.cash_weeks(j.t.compras, BILLS_AS_OF)
    return weeks.join(due, [ENTITY, "week"], "left")


def _installment(j: Jobs) -> DataFrame:
    return j.t.read("customer").select("c_custkey", finance.installment(
        F.col("c_acctbal"), (F.col("c_custkey") % 4) * F.lit(0.06), F.col("c_custkey") % 12).alias("cuota"))


JOBS: dict[str, Callable[[Jobs], DataFrame]] = {
    # receivables
    "rate_intervals_to_days": lambda j: j.unfolded_rates,
    "rate_layered_intervals_to_days": _layered_days,
    "rate_filled_calendar": _filled_calendar,
    "rate_text_to_number": _rate_text,
    "rate_first_needed_day": _first_day,
    "rate_newest_previous_month_end": _newest_rates,
    "invoice_scan": lambda j: j.t.facturas,
    "invoice_rate_as_of": _rate_lookup,
    "payment_rate_as_of": _payment_rate_lookup,
    "payments_split_by_invoice_date": _split,
    "payments_running_total": _curve,
    "fx_summary": lambda j: j.summary,
    "fx_status": lambda j: fx.fx_status(j.summary),
    "fx_portfolio_totals": lambda j: fx.fx_portfolio_totals(j.summary),
    "fx_daily_totals": lambda j: fx.fx_daily_totals(*j.fx_inputs),
    "fx_balance_spans": lambda j: fx.fx_balance_spans(*j.fx_inputs),
    "fx_daily_detail_digest": _daily_detail_digest,
    "fx_invoice_series_digest": _series_digest,
    "fx_daily_detail_by_month": _daily_detail_by_month,
    "fx_invoice_series_extremes": _series_extremes,
    "invoice_scan_from_text": _invoices_from_text,
    "fx_daily_totals_of_shared_numbers": lambda j: fx.fx_daily_totals(*_shared_inputs(j)),
    "fx_summary_before_the_curve": lambda j: fx.fx_summary(j.t.facturas, j.t.monetizaciones, _young_rates(j), FX_AS_OF),
    "fx_movements_before_the_curve": lambda j: fx.fx_movements(j.t.facturas, j.t.monetizaciones, _young_rates(j), FX_AS_OF, label_from=50000),
    "fx_invoice_series_of_one": _series_of_one,
    "fx_movements": lambda j: fx.fx_movements(*j.fx_inputs, label_from=50000),
    # payables
    "payables_aging": lambda j: j.aged,
    "payables_risk_classes": _risk_counts,
    "payables_risk_totals": lambda j: payables.risk_totals(j.aged),
    "payables_months": lambda j: payables.choices(j.aged, "MES_GENERACION"),
    "payables_supplier_debt": lambda j: payables.supplier_debt(j.aged),
    "payables_top_suppliers": lambda j: payables.top_suppliers(j.aged),
    "payables_group_totals": lambda j: payables.supplier_group_totals(j.aged, j.t.supplier_groups),
    "payables_group_detail": lambda j: payables.supplier_group_detail(j.aged),
    "payables_risk_totals_of_months": lambda j: payables.risk_totals(j.aged, CHOSEN_MONTHS),
    "payables_bill_list_of_months": lambda j: payables.bill_list(j.aged, CHOSEN_MONTHS),
    "payables_chosen_detail_in_order": _ordered_detail,
    "payables_bills_from_text": lambda j: bill_source.prepare_bills(j.t.text_bills),
    "payables_rows_that_go": _bill_rows_that_go,
    "payables_bills_from_files": _bills_of_files,
    "payables_rejects_of_files": _rejects_of_files,
    "payables_short_credit_overdue": lambda j: payables.short_credit_overdue(j.aged),
    "payables_payment_form": lambda j: payables.payment_form(j.aged),
    "payables_payment_file": lambda j: payables.payment_file(j.aged, j.t.ticked_bills),
    "payables_open_bills": lambda j: payables.open_bills(j.t.compras, j.t.pagos),
    "payables_open_bills_without_numbers": lambda j: payables.open_bills(_without_some_numbers(j.t.compras), _without_some_numbers(j.t.pagos)),
    "payables_overdue_share": lambda j: payables.overdue_share(j.t.compras, BILLS_AS_OF),
    # cash flow
    "cash_payables_by_week": _week_payables,
    "cash_weekly_collection": lambda j: cashflow.weekly_collection(j.summary, j.rates, FX_AS_OF),
    "cash_flow_four_weeks": _cash_flow,
    "cash_weekly_close": lambda j: cashflow.not_yet_closed(j.t.closes, j.t.ledger),
    "cash_closed_flag": lambda j: cashflow.is_closed(j.t.closes, j.t.ledger, BILLS_AS_OF),
    "cash_ledger_history": _ledger_after_close,
    "cash_ledger_after_repeated_closes": _ledger_after_repeats,
    "cash_plan_from_documents": _plan_of_documents,
    "cash_ledger_from_documents": _ledger_of_documents,
    "cash_documents_that_go": _broken_documents,
    "cash_ledger_totals": lambda j: cashflow.ledger_totals(j.t.ledger),
    # statements
    "statement_last_number": _statement_numbers,
    "document_last_number": _document_numbers,
    "statement_items": lambda j: j.customer_items,
    "statement_items_from_files": _items_of_files,
    "statement_items_long": lambda j: statements.statement_items_long(j.customer_items),
    "statement_ratios": lambda j: statements.statement_ratios(j.customer_items),
    "working_capital_days": lambda j: statements.working_capital_days(
        j.items, payables.overdue_share(j.t.compras, BILLS_AS_OF)),
    # roll-up
    "executive_fx_headline": lambda j: executive.fx_headline(j.summary),
    "executive_top_invoices": lambda j: executive.top_invoices(j.summary),
    "executive_summary": lambda j: executive.executive_summary(j.summary, j.t.compras, j.items, BILLS_AS_OF),
    # loans and scenarios
    "loan_installment": _installment,
    "loan_pricing": lambda j: loans.price_loans(j.t.loans),
    "loan_credit_rates": _credit_rates,
    "loan_leaseback_assets": _asset_totals,
    "scenario_spreads": lambda j: scenarios.spread_grid(j.summary, j.rates, FX_AS_OF, SPREADS),
    "scenario_loans": lambda j: scenarios.loan_grid(j.t.loans, LOAN_TERMS),
    "scenario_cash_cycle": _cycle_grid,
}


def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(JOBS[name](Jobs(Tables(spark, sf_dir))))

    return run
