"""Four-week cash flow, weekly close and the ledger of closed weeks."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arqueo import constants as C
from arqueo.functions.dates import day, due_week, monday, previous_month_end, span_label, week_end, week_label, week_start
from arqueo.operators.rates import last_rates
from arqueo.plans.fx import AsOf
from arqueo.plans.payables import open_bills
from arqueo.schemas import CASH_PLAN_INPUTS, COP_AMOUNT, ENTITY, MONEY, USD_TOTAL
from arqueo.session import landed


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(USD_TOTAL)


def _weeks(entities: DataFrame) -> DataFrame:
    return entities.select(ENTITY, F.explode(F.sequence(F.lit(1), F.lit(C.CASH_WEEKS))).alias("week"))


def cash_weeks(entities: DataFrame, as_of: AsOf) -> DataFrame:
    """The Monday to Sunday weeks ahead of each entity, starting at the week of the as-of day."""
    today, week = day(as_of), F.col("week")
    return _weeks(entities.select(ENTITY).distinct()).select(
        ENTITY, "week", week_start(today, week).alias("inicio"), week_end(today, week).alias("fin"),
        week_label(today, week).alias("semana"),
    )


def payables_by_week(bills: DataFrame, as_of: AsOf) -> DataFrame:
    """What falls due per entity and week. Overdue bills fall in week 1, later ones in none."""
    week = due_week(day(as_of), F.col("VENCIMIENTO"), C.CASH_WEEKS)
    sums = bills.groupBy(ENTITY).agg(*(
        _total(F.when(week == number, F.col("VALOR"))).alias(str(number)) for number in range(1, C.CASH_WEEKS + 1)
    ))
    return sums.unpivot([ENTITY], [str(n) for n in range(1, C.CASH_WEEKS + 1)], "week", "proveedores").select(
        ENTITY, F.col("week").cast("int").alias("week"), "proveedores")


def open_payables_by_week(bills: DataFrame, paid: DataFrame, as_of: AsOf) -> DataFrame:
    return payables_by_week(open_bills(bills, paid), as_of)


def weekly_collection(summary: DataFrame, rates: DataFrame, as_of: AsOf, share: Decimal = C.WEEKLY_COLLECTION_SHARE) -> DataFrame:
    """Expected weekly inflow per entity: a share of the open dated balance at the newest rate."""
    newest = last_rates(rates, previous_month_end(day(as_of)))["trm_actual"]
    balance = F.sum(F.when(F.col("fecha_factura").isNotNull(), F.col("saldo_vivo_actual_usd"))).cast(USD_TOTAL)
    rate = (newest * F.lit(share).cast("decimal(6,4)")).cast("decimal(20,8)")
    open_total = summary.groupBy(ENTITY).agg(F.coalesce(balance, F.lit(0)).cast(USD_TOTAL).alias("saldo"))
    return open_total.select(ENTITY, (F.col("saldo") * rate).cast(COP_AMOUNT).alias("cartera_usd"))


def cash_flow(
    collection: DataFrame, payables: DataFrame, plan: DataFrame, loans: DataFrame, as_of: AsOf,
) -> DataFrame:
    """Ten columns per entity and week.

    ``collection`` from `weekly_collection`, ``payables`` from `payables_by_week`, ``loans`` from
    `price_loans`. Active loans pay out in week 1 and cost their installment in the last week.
    Everything is reduced to one row per entity and week before the joins. The first two are asked for their entities and for
    their amounts, so these few rows are landed instead of being worked out twice.
    """
    collection, payables = landed(collection), landed(payables)
    today = day(as_of)
    active = F.col("activo")
    debt = loans.groupBy(ENTITY).agg(
        _total(F.when(active, F.col("desembolso"))).alias("desembolso"),
        F.coalesce(F.sum(F.when(active, F.col("cuota").cast("decimal(18,6)"))), F.lit(0)).cast(COP_AMOUNT).alias("cuota"),
    )
    twice = F.raise_error(F.lit("two plans for one company and week")).cast("decimal(1,0)")
    planned = plan.groupBy(ENTITY, "week").agg(
        F.when(F.count(F.lit(1)) > 1, twice).otherwise(_total(F.col("saldo_inicial"))).alias("saldo_inicial"),
        *(_total(F.col(name)).alias(name) for name in CASH_PLAN_INPUTS),
    )
    entities = (
        collection.select(ENTITY).unionByName(payables.select(ENTITY))
        .unionByName(plan.select(ENTITY)).unionByName(loans.select(ENTITY)).distinct()
    )
    rows = (
        _weeks(entities).join(collection, ENTITY, "left").join(payables, [ENTITY, "week"], "left")
        .join(planned, [ENTITY, "week"], "left").join(debt, ENTITY, "left")
    )
    week = F.col("week")

    def amount(*names: str) -> Column:
        total = F.coalesce(F.col(names[0]), F.lit(0).cast(COP_AMOUNT))
        for name in names[1:]:
            total = total + F.coalesce(F.col(name), F.lit(0).cast(COP_AMOUNT))
        return total.cast(COP_AMOUNT)

    def only_in(number: int, name: str) -> Column:
        return F.when(week == number, amount(name)).otherwise(F.lit(0).cast(COP_AMOUNT))

    columns = {
        "cartera_usd": amount("cartera_usd"),
        "ingresos_op": amount("ordinarios", "extra"),
        "inyeccion_financiera": only_in(1, "desembolso"),
        "proveedores": amount("proveedores"),
        "gastos_op": amount("f_serv", "f_arr", "f_otr", "n_sue", "n_ss"),
        "pago_deuda": only_in(C.CASH_WEEKS, "cuota"),
    }
    rows = rows.select(ENTITY, "week", only_in(1, "saldo_inicial").alias("apertura"),
                       *(value.alias(name) for name, value in columns.items()))
    inflow = F.col("cartera_usd") + F.col("ingresos_op") + F.col("inyeccion_financiera")
    outflow = F.col("proveedores") + F.col("gastos_op") + F.col("pago_deuda")
    rows = rows.withColumn("flujo_neto", (inflow - outflow).cast(COP_AMOUNT))
    past = W.partitionBy(ENTITY).orderBy("week").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("saldo_final", F.sum(F.col("apertura") + F.col("flujo_neto")).over(past).cast(COP_AMOUNT))
    return rows.select(
        ENTITY, "week", week_label(today, week).alias("semana"),
        (F.col("saldo_final") - F.col("flujo_neto")).cast(COP_AMOUNT).alias("saldo_inicial"),
        *columns, "flujo_neto", "saldo_final",
    )


def weekly_close(actuals: DataFrame, as_of: AsOf | None = None) -> DataFrame:
    """Ledger rows from the seven amounts of a closed week.

    ``actuals`` has entity_id, r_usd, r_ord, r_ex, r_prov, r_fijos, r_nom, r_fin, and
    ``week_start`` unless ``as_of`` is given, which closes the week before it.
    """
    start = F.date_sub(monday(day(as_of)), 7) if as_of is not None else F.col("week_start")

    def total(*names: str) -> Column:
        value = F.coalesce(F.col(names[0]), F.lit(0).cast(MONEY))
        for name in names[1:]:
            value = value + F.coalesce(F.col(name), F.lit(0).cast(MONEY))
        return value.cast(MONEY)

    income, spent = total("r_usd", "r_ord", "r_ex"), total("r_prov", "r_fijos", "r_nom", "r_fin")
    return actuals.select(
        ENTITY, start.alias("week_start"), span_label(start, F.date_add(start, 6)).alias("semana"),
        income.alias("ingresos_reales"), spent.alias("egresos_reales"), (income - spent).cast(MONEY).alias("flujo_neto_real"),
    )


def not_yet_closed(closes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Closes whose week is not in the ledger; the ledger is never rewritten."""
    return closes.join(ledger.select(ENTITY, "week_start").distinct(), [ENTITY, "week_start"], "left_anti")


def is_closed(entities: DataFrame, ledger: DataFrame, as_of: AsOf) -> DataFrame:
    """Whether the week before the as-of day is closed, per entity."""
    last_week = F.date_sub(monday(day(as_of)), 7)
    closed = ledger.groupBy(ENTITY).agg(F.bool_or(F.col("week_start") == last_week).alias("cerrada"))
    return entities.select(ENTITY).distinct().join(closed, ENTITY, "left").select(
        ENTITY, F.coalesce("cerrada", F.lit(False)).alias("cerrada"))


def ledger_history(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        ENTITY, "week_start", F.col("semana").alias("Semana"), F.col("ingresos_reales").alias("Ingresos Reales"),
        F.col("egresos_reales").alias("Egresos Reales"), F.col("flujo_neto_real").alias("Flujo Neto Real"),
    )


def ledger_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(ENTITY).agg(
        _total(F.col("ingresos_reales")).alias("total_ingresos"),
        _total(F.col("egresos_reales")).alias("total_egresos"),
        _total(F.col("flujo_neto_real")).alias("saldo_neto"),
    )
