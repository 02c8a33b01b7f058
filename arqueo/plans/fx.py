"""Exchange difference on USD receivables, per invoice, per day and per movement."""

import datetime as dt
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo import constants as C
from arqueo.functions.dates import day, month_start, previous_month_end
from arqueo.operators.joins import skew_join
from arqueo.operators.payments import INVOICE_KEY, daily_payments, payment_curve, split_by_invoice_date
from arqueo.operators.rates import daily_rates, first_needed_day, last_rates, rate_as_of
from arqueo.schemas import COP_AMOUNT, ENTITY, RATE, USD_TOTAL

AsOf = dt.date | str | Column
_RATE_STEP = T.DecimalType(20, 6)


def _usd(value: Column) -> Column:
    return value.cast(USD_TOTAL)


def _cop(value: Column) -> Column:
    return value.cast(COP_AMOUNT)


def _open(value: Column, paid: Column) -> Column:
    return _usd(F.greatest(value - paid, F.lit(0).cast("decimal(1,0)")))


def fx_rates(facturas: DataFrame, monetizaciones: DataFrame, trm_intervalos: DataFrame, as_of: AsOf) -> DataFrame:
    """Daily rates from the first day the invoices or payments need up to the as-of day."""
    end = day(as_of)
    return daily_rates(trm_intervalos, first_needed_day(facturas, monetizaciones, end), end)


def fx_summary(
    facturas: DataFrame, monetizaciones: DataFrame, rates: DataFrame, as_of: AsOf, spread: Decimal = C.SPREAD,
) -> DataFrame:
    """One row per invoice: advances, later payments, open balance and the differences on each.

    An invoice without a date takes all its payments as advances and has no differences.
    An invoice older than the first rate uses the newest rate.
    """
    end = day(as_of)
    now = last_rates(rates, previous_month_end(end))
    split = split_by_invoice_date(facturas, daily_payments(monetizaciones))
    priced = rate_as_of(facturas, "fecha_factura", rates, end, "trm_factura")
    rows = skew_join(priced, split, [*INVOICE_KEY, "fecha_factura"], "left", null_safe=["fecha_factura"])
    # One subquery column, read field by field below.
    rows, now = rows.withColumn("__now", now), F.col("__now")

    dated = F.col("fecha_factura").isNotNull()
    zero = F.lit(0)
    paid = {
        name: F.coalesce(F.col(name), zero.cast(USD_TOTAL))
        for name in ("antes_usd", "antes_usd_con_tasa", "desde_usd", "desde_usd_con_tasa", "total_usd")
    }
    cop = {name: F.coalesce(F.col(name), zero.cast(COP_AMOUNT)) for name in ("antes_cop", "desde_cop")}
    rows = rows.withColumns({
        "trm_factura": F.when(dated, F.coalesce("trm_factura", now["trm_actual"])).cast(RATE),
        "anticipo_previo_total_usd": _usd(F.when(dated, paid["antes_usd"]).otherwise(paid["total_usd"])),
        "abonos_post_factura_total_usd": _usd(F.when(dated, paid["desde_usd"]).otherwise(zero)),
    })
    trm = F.col("trm_factura")
    rows = rows.withColumns({
        "saldo_vivo_actual_usd": _open(
            F.col("valor_usd"), F.col("anticipo_previo_total_usd") + F.col("abonos_post_factura_total_usd")),
        "dif_anticipos": F.when(dated, _cop(trm * paid["antes_usd_con_tasa"] - cop["antes_cop"])),
        "dif_realizada_post": F.when(dated, _cop(cop["desde_cop"] - trm * paid["desde_usd_con_tasa"])),
    })

    balance, actual, previous = F.col("saldo_vivo_actual_usd"), now["trm_actual"], now["trm_ayer"]
    month_base = F.when(F.col("fecha_factura") >= month_start(end), trm).otherwise(now["trm_cierre"])
    share = F.lit(spread).cast("decimal(9,6)")

    def against(rate: Column, base: Column) -> Column:
        return F.when(dated, _cop(balance * (rate - base).cast(_RATE_STEP)))

    differences = {
        "dif_anticipos": F.col("dif_anticipos"),
        "dif_realizada_post": F.col("dif_realizada_post"),
        "dif_no_realizada": against(actual, trm),
        "dif_no_realizada_mes": against(actual, month_base),
        "dif_total": _cop(F.col("dif_anticipos") + F.col("dif_realizada_post") + against(actual, trm)),
        "dif_dia_base": against(actual, previous),
        "dif_dia_plus_2pct": against(actual * (1 + share), previous),
        "dif_dia_minus_2pct": against(actual * (1 - share), previous),
    }
    return rows.select(
        ENTITY, "factura", "cliente", "fecha_factura", "valor_usd", "trm_factura",
        "anticipo_previo_total_usd", "abonos_post_factura_total_usd", "saldo_vivo_actual_usd",
        *(F.coalesce(value, _cop(zero)).alias(name) for name, value in differences.items()),
    )


def fx_status(summary: DataFrame) -> DataFrame:
    """The portfolio table shown to a user: dated invoices, balance and the three effects."""
    return summary.where(F.col("fecha_factura").isNotNull()).select(
        ENTITY, F.col("factura").alias("Factura"), F.col("cliente").alias("Cliente"),
        F.col("saldo_vivo_actual_usd").alias("Saldo (USD)"),
        F.col("dif_realizada_post").alias("Dif. Realizada (COP)"),
        F.col("dif_no_realizada_mes").alias("Efecto Mes (COP)"),
        F.col("dif_no_realizada").alias("Efecto Acum. (COP)"),
    )


def fx_portfolio_totals(summary: DataFrame) -> DataFrame:
    """Totals per entity: eight over dated invoices, three over undated ones."""
    dated = F.col("fecha_factura").isNotNull()

    def total(value: Column, rows: Column, kind: T.DataType) -> Column:
        return F.coalesce(F.sum(F.when(rows, value)), F.lit(0)).cast(kind)

    def dated_cop(*names: str) -> Column:
        value = F.col(names[0])
        for name in names[1:]:
            value = value + F.col(name)
        return total(value, dated, COP_AMOUNT)

    return summary.groupBy(ENTITY).agg(
        total(F.col("saldo_vivo_actual_usd"), dated, USD_TOTAL).alias("saldo_vivo_usd"),
        dated_cop("dif_anticipos", "dif_realizada_post").alias("realizada_total"),
        dated_cop("dif_no_realizada_mes").alias("no_realizada_mes"),
        dated_cop("dif_no_realizada").alias("no_realizada_acumulada"),
        dated_cop("dif_total").alias("dif_total"),
        dated_cop("dif_dia_base").alias("dif_dia_base"),
        dated_cop("dif_dia_plus_2pct").alias("dif_dia_plus_2pct"),
        dated_cop("dif_dia_minus_2pct").alias("dif_dia_minus_2pct"),
        total(F.col("valor_usd"), ~dated, USD_TOTAL).alias("sin_fecha_valor_usd"),
        total(F.col("anticipo_previo_total_usd"), ~dated, USD_TOTAL).alias("sin_fecha_anticipos_usd"),
        total(F.col("saldo_vivo_actual_usd"), ~dated, USD_TOTAL).alias("sin_fecha_saldo_usd"),
    )


def _priced(facturas: DataFrame, rates: DataFrame, end: Column, newest_if_older: bool) -> DataFrame:
    """Dated invoices with the rate of their day; before the first rate NULL, or the newest rate."""
    dated = facturas.where(F.col("fecha_factura").isNotNull())
    priced = rate_as_of(dated, "fecha_factura", rates, end, "trm_factura")
    if not newest_if_older:
        return priced
    newest = last_rates(rates, end)["trm_actual"]
    return priced.withColumn("trm_factura", F.coalesce("trm_factura", newest).cast(RATE))


def _timeline(
    facturas: DataFrame, daily: DataFrame, rates: DataFrame, end: Column, newest_if_older: bool = False,
) -> DataFrame:
    """Dated invoices with their rate and payment split, one row per payment day (``daily``, dated) from the invoice date on.

    An invoice without such a day has one row with NULL in the columns of the payment curve.
    """
    priced = _priced(facturas, rates, end, newest_if_older)
    split = split_by_invoice_date(facturas.where(F.col("fecha_factura").isNotNull()), daily)
    rows = skew_join(priced, split, [*INVOICE_KEY, "fecha_factura"], "left")
    later = F.col("fecha") >= F.col("fecha_factura")
    rows = skew_join(rows, payment_curve(daily), INVOICE_KEY, "left", also=later)
    none = {"antes_usd": USD_TOTAL, "antes_usd_con_tasa": USD_TOTAL, "antes_cop": COP_AMOUNT}
    rows = rows.withColumns({name: F.coalesce(name, F.lit(0).cast(kind)) for name, kind in none.items()})
    return rows.withColumn(
        "dif_anticipos", _cop(F.col("trm_factura") * F.col("antes_usd_con_tasa") - F.col("antes_cop")))


def _first_of_invoice() -> Column:
    """True on exactly one timeline row of each invoice."""
    return F.col("fecha").isNull() | (F.col("fecha") == F.col("primer_pago"))


_INVOICES_PER_PART = 1_000_000  # distinct invoices of one number that a task sweeps over
_START, _END, _PAYS, _ASKS, _COUNTS_IN = range(5)  # an invoice opens, closes; a payment, a question of one; an invoice in a stretch
_CHANGES = {"saldo": USD_TOTAL, "saldo_con_tasa": USD_TOTAL, "saldo_por_tasa": COP_AMOUNT, "dif_anticipos": COP_AMOUNT, "realizada": COP_AMOUNT}


def _swept_changes(priced: DataFrame, daily: DataFrame) -> DataFrame:
    """Changes of balance and differences by entity and day.

    The balance of an invoice is its value less what the number has paid by then, so it closes on the first day on which the
    payments reach its value. On a line of invoices and payment days by value that day is the least one at or above the invoice.
    An invoice is then an opening and a closing event, and a payment changes the balance by its amount times the number of
    invoices open, which is a running sum: N invoices and D payment days of one number give N + D rows, never N x D.

    Where a number has days on which payments are taken back, an invoice may open again. There a payment asks for the invoices so far above
    the sum paid, after it and before it. On the line by value those are a prefix, made up of stretches of 2^k places, at
    most one of each size; an invoice counts in the stretches around it, so each stretch is a running sum by day and the rows are
    (N + D) log(N + D).

    Equal invoices count as one with a multiplicity. A number with very many invoices is dealt out to parts, each with all payment
    days of the number (which the calendar bounds); the changes of the parts add up. The list of such numbers is
    broadcast: it has at most one row per `_INVOICES_PER_PART` invoices.
    """
    invoices = priced.groupBy(*INVOICE_KEY, "fecha_factura", "valor_usd", "trm_factura").agg(F.count(F.lit(1)).alias("veces"))
    many = F.broadcast(
        invoices.where(F.col("factura").isNotNull()).groupBy(*INVOICE_KEY)
        .agg(F.ceil(F.count(F.lit(1)) / _INVOICES_PER_PART).alias("partes")).where("partes > 1"))
    spread = F.xxhash64("fecha_factura", "valor_usd")
    part = F.when(F.col("factura").isNull(), spread).otherwise(F.pmod(spread, F.coalesce("partes", F.lit(1))))
    dealt = invoices.join(many, list(INVOICE_KEY), "left").select(
        *INVOICE_KEY, part.alias("parte"), F.col("fecha_factura").alias("dia"), F.lit(0).alias("tipo"),
        F.col("valor_usd").cast(USD_TOTAL).alias("valor"), F.col("trm_factura").alias("trm"), "veces")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("partes", F.lit(1)) - 1))
    paid = daily.join(many, list(INVOICE_KEY), "left").select(
        *INVOICE_KEY, copies.alias("parte"), F.col("fecha").alias("dia"), F.lit(1).alias("tipo"), "usd", "usd_con_tasa", "cop")
    number = W.partitionBy(*INVOICE_KEY, "parte")
    # Payments of the day of an invoice come after it, so up to an invoice the sums are those before its day.
    upto = number.orderBy("dia", "tipo").rowsBetween(W.unboundedPreceding, 0)
    of_all = number.orderBy("dia", "tipo").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # in the same pass as those
    by_level = number.orderBy(F.desc("nivel"), F.desc("tipo")).rowsBetween(W.unboundedPreceding, 0)
    kinds = {"usd": USD_TOTAL, "usd_con_tasa": USD_TOTAL, "cop": COP_AMOUNT}
    back = F.coalesce(F.col("menor") < 0, F.lit(False))
    # A payment of a number with payments taken back stands on the line by value twice: with the sum after it and with that before it.
    after = F.struct(F.coalesce("valor", "antes_usd").cast(USD_TOTAL).alias("nivel"), F.lit(1).alias("signo"))
    before = F.struct(_usd(F.col("antes_usd") - F.col("usd")).alias("nivel"), F.lit(-1).alias("signo"))
    levels = F.when(back & (F.col("tipo") == 1), F.array(after, before)).otherwise(F.array(after))
    line = dealt.unionByName(paid, allowMissingColumns=True).withColumns({
        **{f"antes_{name}": F.coalesce(F.sum(name).over(upto), F.lit(0)).cast(kind) for name, kind in kinds.items()},
        "menor": F.min("usd").over(of_all),
        "puestos": 2 * F.count(F.lit(1)).over(of_all),  # at least as many as there are places by value
    }).select("*", F.explode(levels).alias("l")).select("*", "l.*").drop("l")
    payment = F.when(F.col("tipo") == 1, F.struct("dia", _usd(F.col("antes_usd") - F.col("usd")).alias("antes")))
    line = line.withColumns({"cierre": F.min(payment).over(by_level), "puesto": F.dense_rank().over(number.orderBy(F.desc("nivel"), F.desc("tipo")))})
    times, trm = F.col("veces"), F.col("trm")
    opens = F.col("antes_usd") < F.col("valor")
    rated = F.when(trm.isNotNull(), times).otherwise(F.lit(0).cast("long"))
    rates_of = F.coalesce(_cop(trm * times), F.lit(0).cast(COP_AMOUNT))

    amounts = {"valores": times, "valores_con_tasa": rated, "valores_por_tasa": rates_of}
    open_counts = {"abiertas": times, "abiertas_con_tasa": rated, "tasas": rates_of}
    all_counts = {"todas": times, "todas_con_tasa": rated, "todas_tasas": rates_of}
    counted_names = (*open_counts, *all_counts)
    value, zero, kind = F.col("valor"), F.lit(0), F.col("suceso")
    counted = opens & ~back
    is_invoice = F.col("tipo") == 0

    def mark(event: int, stretch: Column | None = None) -> Column:
        """Which change it is. What changes is worked out after these are unfolded: with the search for stretches in one
        expression, none of it would be compiled."""
        place = [F.lit(-1 if name == "k" else 0).cast("int").alias(name) if stretch is None else stretch[name].alias(name) for name in ("k", "n")]
        return F.struct(F.lit(event).alias("suceso"), *place)

    # Places are numbered from the largest value down. The stretches (k, n) of 2^k places that may be asked for have an even n.
    around = "transform(sequence(0, 30), k -> named_struct('k', k, 'n', shiftright(puesto, k)))"
    around = F.expr(f"filter({around}, s -> s.n % 2 = 0 AND shiftleft(cast(s.n + 1 AS bigint), s.k) <= puestos)")
    above = F.expr("transform(filter(sequence(0, 30), k -> shiftright(puesto, k) % 2 = 1), k -> named_struct('k', k, 'n', shiftright(puesto, k) - 1))")
    asks = F.transform(above, lambda s: mark(_ASKS, s))
    counts_in = F.transform(around, lambda s: mark(_COUNTS_IN, s))
    start, end, pays = mark(_START), mark(_END), mark(_PAYS)
    both = (
        F.when(back & is_invoice & value.isNotNull(), F.concat(F.array(start), counts_in))
        .when(back & ~is_invoice, F.when(F.col("signo") == 1, F.concat(F.array(pays), asks)).otherwise(asks))
        .when(~is_invoice, F.array(pays))
        .when(counted & F.col("cierre").isNotNull(), F.array(start, end)).otherwise(F.array(start))
    )
    starts, ends, joins = kind == _START, kind == _END, kind == _COUNTS_IN
    pays_day = kind.isin(_PAYS, _ASKS)
    advances = times * (trm * F.col("antes_usd_con_tasa") - F.col("antes_cop"))
    moved = _usd(F.when(starts, _usd(times * _open(value, F.col("antes_usd")))).when(ends, _usd(times * (F.col("cierre.antes") - value))).otherwise(_usd(zero)))

    def of_type(name: str, count: Column) -> Column:
        return count.otherwise(F.lit(0)).cast(COP_AMOUNT if "tasas" in name else "long").alias(name)

    events = line.select("*", F.explode(both).alias("__s")).select("*", "__s.*").withColumn("__saldo", moved).select(
        *INVOICE_KEY, "parte", "nivel", "signo", "k", "n",
        F.when(ends, F.col("cierre.dia")).otherwise(F.col("dia")).alias("fecha"), F.when(pays_day, 1).otherwise(0).alias("orden"),
        F.col("__saldo").alias("saldo"), F.when(trm.isNotNull(), F.col("__saldo")).alias("saldo_con_tasa"), _cop(F.col("__saldo") * trm).alias("saldo_por_tasa"),
        _cop(F.when(starts, _cop(advances)).otherwise(_cop(zero))).alias("dif_anticipos"),
        # An invoice joins those that payments reduce, or a stretch of places by value, which is summed apart, and leaves the former.
        *(of_type(name, F.when((starts & counted) | joins, count).when(ends & counted, -1 * count)) for name, count in open_counts.items()),
        *(of_type(name, F.when(starts, count)) for name, count in all_counts.items()),
        *(F.when(pays_day, F.col(name)).cast(kinds[name]).alias(name) for name in kinds),
        *(F.when(joins, _cop(count * value)).alias(name) for name, count in amounts.items()),
    )
    past = W.partitionBy(*INVOICE_KEY, "parte", "k", "n").orderBy("fecha", "orden").rowsBetween(W.unboundedPreceding, 0)
    events = events.withColumns({f"__{name}": F.sum(name).over(past) for name in (*counted_names, *amounts)})
    usd, asked = F.col("usd"), F.col("k") >= 0
    is_payment = (F.col("orden") == 1) & ~asked

    def change(kind: T.DataType, paid: Column, above: str, count: Column, own: str) -> Column:
        """Of a payment, of a payment that asks a stretch for what lies above its level, of an invoice."""
        jump = F.col("signo") * (F.col(f"__{above}") - F.col("nivel") * count)
        return F.when(asked, jump).when(is_payment, paid).otherwise(F.col(own)).cast(kind)

    taxed = F.col("__tasas").cast(COP_AMOUNT)
    return events.where(F.when(asked, (F.col("orden") == 1) & (F.col("__abiertas") > 0)).otherwise(~is_payment | (F.col("__todas") > 0))).select(
        ENTITY, "fecha",
        change(USD_TOTAL, -usd * F.col("__abiertas"), "valores", F.col("__abiertas"), "saldo").alias("saldo"),
        change(USD_TOTAL, -usd * F.col("__abiertas_con_tasa"), "valores_con_tasa", F.col("__abiertas_con_tasa"), "saldo_con_tasa").alias("saldo_con_tasa"),
        change(COP_AMOUNT, -usd * taxed, "valores_por_tasa", taxed, "saldo_por_tasa").alias("saldo_por_tasa"),
        "dif_anticipos",
        _cop(F.when(is_payment, F.col("cop") * F.col("__todas_con_tasa") - F.col("usd_con_tasa") * F.col("__todas_tasas").cast(COP_AMOUNT)).when(~asked, zero)).alias("realizada"),
    )


def fx_daily_totals(facturas: DataFrame, monetizaciones: DataFrame, rates: DataFrame, as_of: AsOf) -> DataFrame:
    """Portfolio series: balance and differences per entity and rate day.

    The balance of an invoice only changes on its own date and on its payment days, so the job
    adds up changes instead of writing a row per invoice and day; see `_swept_changes`. They are summed per entity and
    day before they move. Balance x rate splits into rate(day) * sum(balance) minus
    sum(balance * invoice rate). Invoices without a rate count in the balance only.
    """
    end = day(as_of)
    daily = daily_payments(monetizaciones.where(F.col("fecha") <= end))
    changes = _swept_changes(_priced(facturas, rates, end, False), daily).groupBy(ENTITY, "fecha").agg(
        *(F.sum(name).cast(kind).alias(name) for name, kind in _CHANGES.items()))

    # Lay the rate days into the time line of each entity: its first change also unfolds the days, which then look up their rate.
    limits = rates.agg(F.struct(F.min("fecha").alias("primera"), F.max("fecha").alias("ultima"))).scalar()
    measures = [name for name in changes.columns if name not in (ENTITY, "fecha")]
    own = F.array(F.lit(None).cast("date"))  # the change itself; the others are days of the calendar
    days = F.sequence(limits["primera"], limits["ultima"])
    is_first = F.row_number().over(W.partitionBy(ENTITY).orderBy("fecha")) == 1
    line = (
        changes.withColumn("__first", is_first)
        .select(ENTITY, "fecha", *measures, F.explode(F.when(F.col("__first"), F.concat(own, days)).otherwise(own)).alias("dia"))
        .select(ENTITY, F.coalesce("dia", "fecha").alias("fecha"), F.col("dia").isNotNull().alias("es_dia"),
                *(F.when(F.col("dia").isNull(), F.col(name)).alias(name) for name in measures))
        .join(rates.select("fecha", "trm"), "fecha", "left").where(~F.col("es_dia") | F.col("trm").isNotNull())
    )
    past = W.partitionBy(ENTITY).orderBy("fecha", "es_dia").rowsBetween(W.unboundedPreceding, W.currentRow)

    def running(name: str, kind: T.DataType) -> Column:
        return F.coalesce(F.sum(name).over(past), F.lit(0)).cast(kind)

    series = line.withColumns({
        "saldo_total_usd": running("saldo", USD_TOTAL),
        "dif_anticipos_total": running("dif_anticipos", COP_AMOUNT),
        "dif_realizada_post_total": running("realizada", COP_AMOUNT),
        "dif_no_realizada_total": _cop(
            F.col("trm") * running("saldo_con_tasa", USD_TOTAL) - running("saldo_por_tasa", COP_AMOUNT)),
    }).where("es_dia")
    open_total = F.col("dif_no_realizada_total")
    before_day = F.lag(open_total).over(W.partitionBy(ENTITY).orderBy("fecha"))
    return series.select(
        ENTITY, "fecha", "trm", "saldo_total_usd", "dif_anticipos_total", "dif_realizada_post_total",
        "dif_no_realizada_total",
        _cop(F.col("dif_anticipos_total") + F.col("dif_realizada_post_total") + open_total).alias("dif_total"),
        _cop(F.coalesce(open_total - before_day, F.lit(0))).alias("dif_dia_base"),
    )


def fx_balance_spans(
    facturas: DataFrame, monetizaciones: DataFrame, rates: DataFrame, as_of: AsOf, newest_if_older: bool = False,
) -> DataFrame:
    """The daily detail without the days: one row per invoice and span in which nothing changes.

    ``desde`` is the first day of the span and ``hasta`` the last (NULL for an open end). Rows before the invoice date
    are left out here, `fx_daily_detail` adds them as zeros.
    """
    end = day(as_of)
    rows = _timeline(facturas, daily_payments(monetizaciones.where(F.col("fecha").isNotNull())), rates, end, newest_if_older)
    totals = ("usd", "usd_con_tasa", "cop")

    def span(start: str, next_change: str, prefix: str) -> Column:
        return F.struct(
            F.col(start).alias("desde"), F.date_sub(next_change, 1).alias("hasta"),
            *(F.col(f"{prefix}_{name}").alias(f"hasta_{name}") for name in totals),
        )

    untouched, paid = span("fecha_factura", "primer_pago", "antes"), span("fecha", "proximo_pago", "hasta")
    opens_later = _first_of_invoice() & (F.col("fecha") > F.col("fecha_factura"))
    both = (
        F.when(F.col("fecha").isNull(), F.array(untouched))
        .when(opens_later, F.array(untouched, paid)).otherwise(F.array(paid))
    )
    spans = rows.select(
        *INVOICE_KEY, "cliente", "fecha_factura", "valor_usd", "trm_factura",
        *(f"antes_{name}" for name in totals), "dif_anticipos", F.explode(both).alias("s"),
    ).select("*", "s.*")
    realized = (
        F.col("hasta_cop") - F.col("antes_cop")
        - F.col("trm_factura") * (F.col("hasta_usd_con_tasa") - F.col("antes_usd_con_tasa")).cast(USD_TOTAL)
    )
    return spans.select(
        *INVOICE_KEY, "cliente", "fecha_factura", "valor_usd", "trm_factura", "desde", "hasta",
        F.col("antes_usd").alias("anticipo_previo_usd"),
        _usd(F.col("hasta_usd") - F.col("antes_usd")).alias("abonos_post_factura_usd"),
        _open(F.col("valor_usd"), F.col("hasta_usd")).alias("saldo_vivo_usd"),
        "dif_anticipos", _cop(realized).alias("dif_realizada_post"),
    )


_SPAN_MEASURES = ("abonos_post_factura_usd", "saldo_vivo_usd", "dif_anticipos", "dif_realizada_post")
#: Columns of the daily detail that are the same on all days of a span.
DETAIL_CONSTANTS = ("factura", "cliente", "valor_usd", "trm_factura", "anticipo_previo_usd", *_SPAN_MEASURES)


def _spans_from_first_day(spans: DataFrame, rates: DataFrame) -> DataFrame:
    """Spans cut to the rate days, completed by a span of zeros before each invoice date.

    ``base`` is the rate that the balance is compared with, 0 where the balance is a fixed zero.
    The span that opens at the invoice date (there is exactly one) brings the zeros along.
    """
    limits = rates.agg(F.struct(F.min("fecha").alias("primera"), F.max("fecha").alias("ultima"))).scalar()
    live = F.struct("desde", "hasta", F.col("trm_factura").alias("base"), *_SPAN_MEASURES)
    before = F.struct(
        limits["primera"].alias("desde"), F.date_sub("fecha_factura", 1).alias("hasta"), F.lit(0).cast(RATE).alias("base"),
        *(F.lit(0).cast(USD_TOTAL if name.endswith("_usd") else COP_AMOUNT).alias(name) for name in _SPAN_MEASURES),
    )
    opens = F.col("desde") == F.col("fecha_factura")
    return (
        spans.select(
            *INVOICE_KEY, "cliente", "valor_usd", "trm_factura", "anticipo_previo_usd",
            F.explode(F.when(opens, F.array(before, live)).otherwise(F.array(live))).alias("s"),
        )
        .withColumns({"__a": F.greatest("s.desde", limits["primera"]), "__b": F.least("s.hasta", limits["ultima"])})
        .where(F.col("__a") <= F.col("__b"))
    )


def _unfold(spans: DataFrame, calendar: DataFrame, carried: Mapping[str, Column], of_day: Mapping[str, Column]) -> DataFrame:
    """One row per span and rate day. The calendar has one row per day, so Spark sends it to every task.

    What does not change inside a span is worked out before it is unfolded, what is the same in all spans of a day in the calendar.
    Days are numbers while they look up the calendar: by a whole number Spark finds a row in an array, by a date in a map of
    bytes. Spans are small next to their days, so adaptive
    execution, which goes by bytes, would leave all of them to a few tasks; they are dealt out evenly to a given number.
    """
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = spans.select("*", "s.base", *(f"s.{name}" for name in _SPAN_MEASURES)).drop("s")
    spans = spans.withColumns({"__fijas": F.col("dif_anticipos") + F.col("dif_realizada_post"), **carried}).repartition(tasks)
    # A row without a day meets none, but is not ruled out while planning: the one in `daily_rates` has to raise its error.
    days = calendar.withColumns({"__dia": F.coalesce(F.unix_date("fecha"), F.lit(-2 ** 31)), **of_day})
    return (
        spans.withColumn("__dia", F.explode(F.sequence(F.unix_date("__a"), F.unix_date("__b")))).join(days, "__dia")
        .withColumn("dif_no_realizada", _cop(F.col("saldo_vivo_usd") * (F.col("trm") - F.col("base"))))
    )


def _detail_columns() -> list[str | Column]:
    return [
        ENTITY, "fecha", *DETAIL_CONSTANTS, "dif_no_realizada", _cop(F.col("__fijas") + F.col("dif_no_realizada")).alias("dif_total"), "trm",
    ]


def fx_daily_detail(
    facturas: DataFrame, monetizaciones: DataFrame, rates: DataFrame, as_of: AsOf, factura: str | None = None,
    carried: Mapping[str, Column] | None = None, of_day: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per dated invoice and rate day, zeros before the invoice date.

    The output is invoices x days by definition; each row comes from a span of the invoice, so
    no payment is looked up per day and nothing of that size is shuffled. ``factura`` keeps one number. ``carried`` are more columns
    made of `DETAIL_CONSTANTS`, ``of_day`` of fecha and trm; they are worked out once per span or day and come last.
    """
    if factura is not None:
        facturas = facturas.where(F.col("factura") == factura)
        monetizaciones = monetizaciones.where(F.col("factura") == factura)
    spans, carried, of_day = fx_balance_spans(facturas, monetizaciones, rates, as_of), carried or {}, of_day or {}
    return _unfold(_spans_from_first_day(spans, rates), rates.select("fecha", "trm"), carried, of_day).select(*_detail_columns(), *carried, *of_day)


def first_dated_invoice(facturas: DataFrame) -> DataFrame:
    """One dated invoice per number: the earliest, as a lookup by number finds it."""
    fields = ("fecha_factura", "cliente", "valor_usd")
    return (
        facturas.where(F.col("fecha_factura").isNotNull() & F.col("factura").isNotNull())
        .groupBy(*INVOICE_KEY).agg(F.min(F.struct(*fields)).alias("fila"))
        .select(*INVOICE_KEY, "fila.*")
    )


def fx_invoice_series(
    facturas: DataFrame, monetizaciones: DataFrame, rates: DataFrame, as_of: AsOf, factura: str | None = None,
    carried: Mapping[str, Column] | None = None, of_day: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Daily detail with the day-on-day change, one invoice per number.

    Unlike the portfolio detail, an invoice older than the first rate uses the newest rate here.
    The balance of the day before is that of the same span, or of the span before for the first
    rate day of a span. So the lag is taken over the few spans of an invoice and not over its days. ``carried`` and ``of_day`` as in `fx_daily_detail`.
    """
    if factura is not None:
        facturas = facturas.where(F.col("factura") == factura)
        monetizaciones = monetizaciones.where(F.col("factura") == factura)
    spans = fx_balance_spans(first_dated_invoice(facturas), monetizaciones, rates, as_of, newest_if_older=True)
    carried, of_day = carried or {}, of_day or {}

    by_day = W.orderBy("fecha")
    calendar = rates.select("fecha", "trm", F.lag("trm").over(by_day).alias("previa")).withColumn("paso", F.col("trm") - F.col("previa"))
    since = F.coalesce(F.date_add(F.lag("fecha").over(by_day), 1), F.col("fecha"))
    next_day = rates.select(since.alias("desde"), "fecha").select(
        F.explode(F.sequence("desde", "fecha")).alias("__a"), F.col("fecha").alias("primer_dia"))
    along = W.partitionBy(*INVOICE_KEY).orderBy("__a")
    spans = (
        _spans_from_first_day(spans, rates).join(next_day, "__a").where(F.col("primer_dia") <= F.col("__b"))
        .withColumn("antes", F.lag(F.struct(F.col("s.saldo_vivo_usd").alias("saldo"), F.col("s.base").alias("base"))).over(along))
    )
    yesterday = F.col("antes.saldo") * (F.col("previa") - F.col("antes.base"))
    change = (
        F.when(F.col("previa").isNull(), F.lit(0).cast(COP_AMOUNT))
        .when(F.col("fecha") == F.col("primer_dia"), _cop(F.col("dif_no_realizada") - yesterday))
        .otherwise(_cop(F.col("saldo_vivo_usd") * F.col("paso")))
    )
    return _unfold(spans, calendar, carried, of_day).select(*_detail_columns(), change.alias("dif_dia_base"), *carried, *of_day)


def fx_movements(
    facturas: DataFrame, monetizaciones: DataFrame, rates: DataFrame, as_of: AsOf, label_from: Decimal | int = 0,
) -> DataFrame:
    """Every dated payment of a dated invoice: curve rate, kind, difference, point size, gain and label flags.

    A payment older than the curve takes the rate of the next payment of its invoice that has
    one. Sizes scale the amount between the smallest and largest of the same invoice and kind.
    """
    end = day(as_of)
    invoice = _priced(first_dated_invoice(facturas), rates, end, True).select(
        *INVOICE_KEY, "fecha_factura", "trm_factura")
    moves = monetizaciones.where(F.col("fecha").isNotNull() & F.col("factura").isNotNull())
    moves = rate_as_of(skew_join(moves, invoice, INVOICE_KEY), "fecha", rates, end, "trm_curva")
    is_advance = F.col("fecha") < F.col("fecha_factura")
    amount, flat = F.col("monto_usd"), F.lit(C.POINT_SIZE_FLAT)
    known_day = F.when(F.col("trm_curva").isNotNull(), F.col("fecha"))
    ranges = moves.groupBy(*INVOICE_KEY).agg(
        F.min(F.when(is_advance, amount)).alias("min_anticipo"), F.max(F.when(is_advance, amount)).alias("max_anticipo"),
        F.min(F.when(~is_advance, amount)).alias("min_post"), F.max(F.when(~is_advance, amount)).alias("max_post"),
        F.min_by("trm_curva", known_day).alias("trm_siguiente"),
    )
    low = F.when(is_advance, F.col("min_anticipo")).otherwise(F.col("min_post")).cast("double")
    high = F.when(is_advance, F.col("max_anticipo")).otherwise(F.col("max_post")).cast("double")
    scaled = C.POINT_SIZE_MIN + F.try_divide(
        (amount.cast("double") - low) * (C.POINT_SIZE_MAX - C.POINT_SIZE_MIN), high - low)
    gap = F.col("tasa_monetizacion") - F.col("trm_factura")
    difference = _cop(amount * F.when(is_advance, -gap).otherwise(gap))
    return skew_join(moves, ranges, INVOICE_KEY).select(
        *INVOICE_KEY, "fecha", "monto_usd", "tasa_monetizacion", "fecha_factura", "trm_factura",
        F.coalesce("trm_curva", "trm_siguiente").alias("trm"),
        F.when(is_advance, C.MOVE_ADVANCE).otherwise(C.MOVE_POST).alias("tipo_mov"),
        difference.alias("dif_mov"),
        F.when(F.abs(high - low) < C.POINT_SIZE_TOLERANCE, flat).otherwise(scaled).alias("size"),
        F.coalesce(difference >= 0, F.lit(False)).alias("ganancia"),
        F.coalesce(amount >= F.lit(label_from), F.lit(False)).alias("etiqueta"),
    )
