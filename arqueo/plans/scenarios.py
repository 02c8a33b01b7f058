"""What-if grids: every row of a table under each of a few parameter sets.

The parameter sets are written into the plan as one array literal and unfolded per row, so a grid
needs no join; its output is rows x parameter sets.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo import constants as C
from arqueo.functions import finance
from arqueo.functions.dates import day, previous_month_end
from arqueo.operators.rates import last_rates
from arqueo.plans.fx import AsOf
from arqueo.schemas import COP_AMOUNT, ENTITY, USD_TOTAL


def with_scenarios(rows: DataFrame, scenarios: Sequence[Mapping[str, object]], types: Mapping[str, str]) -> DataFrame:
    sets = F.array(*(
        F.struct(*(F.lit(one[name]).cast(kind).alias(name) for name, kind in types.items())) for one in scenarios
    ))
    return rows.withColumn("__s", F.explode(sets)).select("*", *(F.col(f"__s.{name}") for name in types)).drop("__s")


def spread_grid(summary: DataFrame, rates: DataFrame, as_of: AsOf, spreads: Sequence[object]) -> DataFrame:
    """Day difference of the open dated balance per entity if the rate moves up or down by each spread."""
    now = last_rates(rates, previous_month_end(day(as_of)))
    balance = summary.where(F.col("fecha_factura").isNotNull()).groupBy(ENTITY).agg(
        F.sum("saldo_vivo_actual_usd").cast(USD_TOTAL).alias("saldo_vivo_usd"))
    grid = with_scenarios(balance, [{"spread": s} for s in spreads], {"spread": "decimal(9,6)"})

    def moved(factor: Column) -> Column:
        return (F.col("saldo_vivo_usd") * (now["trm_actual"] * factor - now["trm_ayer"]).cast("decimal(20,6)")).cast(COP_AMOUNT)

    return grid.select(
        ENTITY, "spread", "saldo_vivo_usd", moved(F.lit(1)).alias("dif_dia_base"),
        moved(1 + F.col("spread")).alias("dif_dia_plus"), moved(1 - F.col("spread")).alias("dif_dia_minus"),
    )


def loan_grid(loans: DataFrame, terms: Sequence[tuple[float, int]]) -> DataFrame:
    """Installment of each loan amount under each (annual rate, months)."""
    grid = with_scenarios(
        loans.select(ENTITY, "tipo", "monto"),
        [{"tasa_ea": rate, "meses": months} for rate, months in terms], {"tasa_ea": "double", "meses": "int"},
    )
    return grid.withColumn("cuota", finance.installment(F.col("monto"), F.col("tasa_ea"), F.col("meses")))


def cash_cycle_grid(
    companies: DataFrame, scenarios: Sequence[tuple[float, float]], year: int = C.SALES_DAYS_PER_YEAR,
) -> DataFrame:
    """Cash released when collection and payment days change by the given steps.

    ``companies`` has entity_id, ventas_anuales, dso, dio, dpo. A scenario is (days collected
    earlier, days paid later); collection days do not go below zero.
    """
    grid = with_scenarios(
        companies.select(ENTITY, "ventas_anuales", "dso", "dio", "dpo"),
        [{"menos_dso": less, "mas_dpo": more} for less, more in scenarios],
        {"menos_dso": "double", "mas_dpo": "double"},
    )
    new_dso = F.when(F.col("dso").isNotNull(), F.greatest(F.col("dso") - F.col("menos_dso"), F.lit(0.0)))
    grid = grid.withColumns({
        "dso_nuevo": new_dso, "dpo_nuevo": F.col("dpo") + F.col("mas_dpo"),
        "ccc": finance.cash_cycle(F.col("dio"), F.col("dso"), F.col("dpo")),
    })
    grid = grid.withColumn("ccc_nuevo", finance.cash_cycle(F.col("dio"), F.col("dso_nuevo"), F.col("dpo_nuevo")))
    grid = grid.withColumn("dias_ganados", F.col("ccc") - F.col("ccc_nuevo"))
    return grid.withColumns({
        "ventas_diarias": F.col("ventas_anuales").cast("double") / year,
        "caja_liberada": finance.released_cash(F.col("dias_ganados"), F.col("ventas_anuales"), year),
    })
