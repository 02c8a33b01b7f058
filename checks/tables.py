"""The given tables seen as treasury tables: orders are invoices, line items are payments and bills.

Companies are numbered 0 to 4, from the order number or the supplier's nation.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arqueo import constants as C
from arqueo.plans.cashflow import weekly_close
from arqueo.schemas import CASH_PLAN, ENTITY, MONEY
from arqueo.session import new_table_path
from arqueo.sources import cashplan
from arqueo.sources.payables import prepare_bills
from arqueo.sources.rates import prepare_intervals
from arqueo.sources.receivables import prepare_invoices, prepare_payments
from arqueo.sources.sinks import save_plan_documents
from arqueo.sources.text_files import plain_path

FX_AS_OF = dt.date(2001, 7, 20)
BILLS_AS_OF = dt.date(1999, 6, 30)

STATEMENT_LABELS = (
    "Efectivo y equivalentes", "Ctas por cobrar comerciales", "Inventarios", "Total activo corriente",
    "Total activos", "Total pasivo corriente", "Total pasivos", "Total patrimonio",
    "Ingresos de actividades ordinarias", "Costo de ventas", "Ganancia bruta", "Gastos de administración",
    "Ganancia operativa", "Gastos financieros", "Utilidad neta", "Clientes nacionales", "Ganancia  (Pérdida)",
    "Otros conceptos",
)


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def facturas(self) -> DataFrame:
        key = F.col("o_orderkey")
        return prepare_invoices(self.read("orders").select(
            (key % 5).cast("string").alias(ENTITY), key.cast("string").alias("factura"),
            F.col("o_custkey").cast("string").alias("cliente"),
            F.when(key % 50 != 0, F.col("o_orderdate").cast("date")).alias("fecha_factura"),
            F.when(key % 37 == 0, "EUR").otherwise(" usd ").alias("moneda"),
            F.col("o_totalprice").cast(MONEY).alias("valor_usd"),
        ))

    @property
    def monetizaciones(self) -> DataFrame:
        key = F.col("l_orderkey")
        return prepare_payments(self.read("lineitem").select(
            (key % 5).cast("string").alias(ENTITY),
            F.when(F.col("l_partkey") % 101 != 0, F.col("l_shipdate").cast("date")).alias("fecha"),
            key.cast("string").alias("factura"),
            F.col("l_extendedprice").cast(MONEY).alias("monto_usd"),
            F.when(F.col("l_partkey") % 97 != 0, 3000 + 1000 * F.col("l_discount").cast(MONEY)).alias("tasa_monetizacion"),
        ))

    @property
    def trm_intervalos(self) -> DataFrame:
        """One published rate per working day with orders, valid until the next one. Weekend orders count on Monday."""
        ordered = F.col("o_orderdate").cast("date")
        weekday = F.weekday(ordered)
        published = F.date_add(ordered, F.when(weekday >= 5, 7 - weekday).otherwise(0))
        days = self.read("orders").groupBy(published.alias("dia")).agg(
            (3000 + F.sum(F.col("o_totalprice").cast(MONEY)) % 911).cast(MONEY).alias("tasa"))
        following = F.lead("dia").over(W.orderBy("dia"))
        english = F.format_number("tasa", 2)
        style = F.datediff("dia", F.lit("1995-01-01").cast("date")) % 4
        text = (
            F.when(style == 0, F.concat(F.lit("$ "), english))
            .when(style == 1, F.translate(english, ",.", ".,"))
            .when(style == 2, F.translate(english, ".,", ","))
            .otherwise(F.col("tasa").cast("string"))
        )
        return prepare_intervals(days.select(
            text.alias("valor"), F.col("dia").alias("vigenciadesde"),
            F.coalesce(F.date_sub(following, 1), F.date_add("dia", 6)).alias("vigenciahasta"),
        ))

    @property
    def compras(self) -> DataFrame:
        lines, orders = self.read("lineitem"), self.read("orders").select("o_orderkey", "o_orderdate")
        suppliers = self.read("supplier").select("s_suppkey", "s_name", "s_nationkey")
        rows = (
            lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
            .join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
        )
        created = F.col("o_orderdate").cast("date")
        return prepare_bills(rows.select(
            (F.col("s_nationkey") % 5).cast("string").alias(ENTITY), F.col("s_name").alias("Proveedor"),
            F.col("l_orderkey").cast("string").alias("Factura"), F.col("l_extendedprice").cast(MONEY).alias("valor"),
            created.alias("Fecha Generacion"),
            F.date_add(created, (15 * F.col("l_linenumber")).cast("int")).alias("vencimiento"),
            F.col("l_returnflag").alias("devuelta"),
        )).withColumnRenamed("DEVUELTA", "devuelta")

    @property
    def pagos(self) -> DataFrame:
        return self.compras.where(F.col("devuelta") == "R")

    def eeff_filas(self, entity: Column) -> DataFrame:
        """Each order is a statement row: a label, a note and an amount in one of several number styles."""
        key, total = F.col("o_orderkey"), F.col("o_totalprice").cast(MONEY)
        english, whole = F.format_number(total, 2), F.format_number(F.floor(total), 0)
        style = F.floor(key / len(STATEMENT_LABELS)) % 6
        amount = (
            F.when(style == 0, F.concat(F.lit("$ "), english))
            .when(style == 1, F.translate(english, ",.", ".,"))
            .when(style == 2, F.concat(F.lit("("), english, F.lit(")")))
            .when(style == 3, "0").when(style == 4, "N/A").otherwise(F.translate(whole, ",", "."))
        )
        labels = F.array(*map(F.lit, STATEMENT_LABELS))
        texts = (F.get(labels, (key % len(STATEMENT_LABELS)).cast("int")), F.concat(F.lit("Nota "), (key % 9).cast("string")), amount)
        created = F.col("o_orderdate").cast("date")
        return self.read("orders").select(
            entity.cast("string").alias(ENTITY), F.year(created).cast("string").alias("file_seq"),
            F.month(created).alias("sheet_seq"), F.lit(0).cast("long").alias("block_seq"), key.alias("row_seq"),
            F.array(*(F.struct(text.alias("raw"), F.lit(None).cast("double").alias("num")) for text in texts)).alias("cells"),
        )

    @property
    def cash_plan(self) -> DataFrame:
        """Planned amounts per company and week: order values by priority and status."""
        value, key = F.col("o_totalprice").cast(MONEY), F.col("o_orderkey")

        def where(column: str, wanted: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col(column) == wanted, value)), F.lit(0)).cast(MONEY)

        return self.read("orders").groupBy(
            (key % 5).cast("string").alias(ENTITY), (F.floor(key / 5) % 4 + 1).cast("int").alias("week"),
        ).agg(
            where("o_orderstatus", "P").alias("saldo_inicial"),
            where("o_orderpriority", "1-URGENT").alias("ordinarios"), where("o_orderpriority", "2-HIGH").alias("extra"),
            where("o_orderpriority", "3-MEDIUM").alias("f_serv"), where("o_orderpriority", "4-NOT SPECIFIED").alias("f_arr"),
            where("o_orderpriority", "5-LOW").alias("f_otr"),
            where("o_orderstatus", "F").alias("n_sue"), where("o_orderstatus", "O").alias("n_ss"),
        ).select(*CASH_PLAN.fieldNames())

    @property
    def weekly_actuals(self) -> DataFrame:
        value, start = F.col("o_totalprice").cast(MONEY), F.date_trunc("week", "o_orderdate").cast("date")

        def where(column: str, wanted: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col(column) == wanted, value)), F.lit(0)).cast(MONEY)

        return self.read("orders").groupBy(
            (F.col("o_orderkey") % 5).cast("string").alias(ENTITY), start.alias("week_start"),
        ).agg(
            where("o_orderstatus", "F").alias("r_usd"), where("o_orderstatus", "O").alias("r_ord"),
            where("o_orderstatus", "P").alias("r_ex"),
            where("o_orderpriority", "1-URGENT").alias("r_prov"), where("o_orderpriority", "2-HIGH").alias("r_fijos"),
            where("o_orderpriority", "3-MEDIUM").alias("r_nom"), where("o_orderpriority", "4-NOT SPECIFIED").alias("r_fin"),
        )

    @property
    def closes(self) -> DataFrame:
        return weekly_close(self.weekly_actuals)

    @property
    def ledger(self) -> DataFrame:
        """Weeks already closed: those before a day, another one for every second company."""
        closed = F.when(F.col(ENTITY).cast("int") % 2 == 0, F.lit("1999-06-28")).otherwise(F.lit("1999-06-14"))
        return self.closes.where(F.col("week_start") < closed.cast("date"))

    @property
    def text_bills(self) -> DataFrame:
        """Bills as a sheet gives them: all cells text, dates in several layouts, some cells unreadable or empty."""
        key, created = F.col("l_orderkey"), F.col("o_orderdate").cast("date")
        due = F.date_add(created, (15 * F.col("l_linenumber")).cast("int"))
        joined = self.read("lineitem").join(self.read("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        style = key % 4
        shown = F.when(style == 0, F.date_format(created, "dd/MM/yyyy")).when(style == 1, F.date_format(created, "yyyy-MM-dd HH:mm:ss")).when(
            style == 2, F.date_format(created, "d-M-yyyy")).otherwise(F.date_format(created, "yyyy/MM/dd"))
        return joined.select(
            F.when(key % 23 != 0, F.concat(F.lit(" P"), F.col("l_suppkey"), F.lit(" "))).alias("Proveedor"),
            key.cast("string").alias("Factura"),
            F.when(key % 29 == 0, "n/a").otherwise(F.col("l_extendedprice").cast(MONEY).cast("string")).alias("valor"),
            F.when(key % 31 == 0, "  ").when(key % 37 == 0, "pronto").otherwise(shown).alias("Fecha Generacion"),
            F.when(key % 41 == 0, "31/31/1999").otherwise(F.date_format(due, "dd/MM/yyyy HH:mm")).alias("vencimiento"),
        )

    @property
    def bill_files(self) -> list[str]:
        """The bills as files with other headers, quoted cells with commas and line breaks, and inch marks that quote nothing."""
        key, style = F.col("l_orderkey"), F.col("l_orderkey") % 4
        lines = self.read("lineitem").join(self.read("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        created = F.col("o_orderdate").cast("date")
        due = F.date_add(created, (15 * F.col("l_linenumber")).cast("int"))
        supplier, number = F.concat(F.lit("P"), F.col("l_suppkey")), key.cast("string")
        amount = F.when(key % 29 == 0, "n/a").otherwise(F.col("l_extendedprice").cast(MONEY).cast("string"))
        line = F.col("l_linenumber").cast("string")
        several = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('dos,\nrenglones "'), line, F.lit('"'))).otherwise(line)
        inches = F.concat(F.lit("Tubo "), line, F.lit('" pvc'))
        root = new_table_path(self.spark)
        quoted = {"header": True, "quote": '"', "escape": '"', "escapeQuotes": True}
        tables = {
            "a": (lines.where(style == 0).select(supplier.alias(" proveedor"), amount.alias("Valor "), number.alias("Factura"), F.date_format(created, "dd/MM/yyyy").alias("Fecha Generacion"),
                                                 due.cast("string").alias("Vencimiento"), several.alias("Nota")), quoted),
            "b": (lines.where(style == 1).select(number.alias("FACTURA"), F.when(key % 23 != 0, supplier).alias("PROVEEDOR"), due.cast("string").alias("VENCIMIENTO"),
                                                 created.cast("string").alias("GENERACION"), amount.alias("VALOR"), F.col("l_quantity").alias("Cantidad"), number.alias("valor ")), quoted),
            "c": (lines.where(style == 2).select(supplier.alias("PROVEEDOR"), number.alias("FACTURA"), created.alias("GENERACIO"), amount.alias("VALOR")), quoted),
            "d": (lines.where(style == 3).select(inches.alias("Nota"), supplier.alias("PROVEEDOR"), number.alias("FACTURA"), created.alias("GENERACIO"),
                                                 due.alias("VENCIMIENTO"), amount.alias("VALOR")), {"header": True, "quote": ""}),
        }
        for name, (table, options) in tables.items():
            table.write.options(**options).csv(f"{root}/{name}")
        return [f"{root}/{name}" for name in tables]

    @property
    def statement_files(self) -> tuple[str, DataFrame]:
        """The statement rows as one file per company and year, and the list of files with an order of upload that their names do not have."""
        rows = self.eeff_filas(F.col("o_orderkey") % 5)
        root = new_table_path(self.spark)
        text = F.transform("cells", lambda cell: cell["raw"])
        parts = rows.select(F.col(ENTITY).alias("empresa"), F.col("file_seq").alias("anio"), "sheet_seq", "row_seq",
                            text[0].alias("Cuenta"), text[1].alias("Nota"), text[2].alias("Valor"))
        ordered = parts.repartition("empresa", "anio").sortWithinPartitions("empresa", "anio", "sheet_seq", "row_seq").drop("sheet_seq", "row_seq")
        ordered.write.option("header", True).option("escape", '"').partitionBy("empresa", "anio").csv(root)
        path = plain_path(F.col("_metadata.file_path"))
        found = self.spark.read.text(f"{root}/*/*/*.csv").select(path.alias("archivo")).distinct()
        company, year = (F.regexp_extract("archivo", f"/{name}=([0-9]+)/", 1) for name in ("empresa", "anio"))
        manifest = found.select("archivo", company.alias(ENTITY), (year.cast("int") * 7 % 11).alias("orden")).where("orden <> 3")
        return f"{root}/*/*/*.csv", manifest

    @property
    def plan_documents(self) -> str:
        """The plans and closed weeks as documents, one of them per company, next to lines that are none."""
        path = new_table_path(self.spark)
        documents = cashplan.plan_documents(self.cash_plan, self.ledger)
        save_plan_documents(f"{path}/buenos", documents)
        broken = self.read("nation").select(F.concat(F.lit('{"entity_id": "n'), F.col("n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, F.lit('", "S1": ')).otherwise(F.lit('", "S1": {"extra": "mucho"}}'))).alias("value"))
        broken.write.text(f"{path}/malos")
        return f"{path}/*"

    @property
    def layered_intervals(self) -> DataFrame:
        """A first source that cannot be used, and a second one with days covered many times, gaps, and intervals that end before they start."""
        key, ordered = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
        span = F.when(key % 17 == 0, -3).when(key % 101 == 0, 900).otherwise(key % 9).cast("int")
        value = (3000 + key % 997).cast("string")
        second = self.read("orders").where((F.year(ordered) != 1996) & (key % 5 == 0)).select(
            F.lit(2).alias("prioridad"), value.alias("valor"), ordered.alias("vigenciadesde"), F.date_add(ordered, span).alias("vigenciahasta"))
        first = self.read("orders").where(key % 50 == 0).select(
            F.lit(1).alias("prioridad"), F.when(key % 100 == 0, "sin dato").otherwise(value).alias("valor"), ordered.alias("vigenciadesde"), ordered.alias("vigenciahasta"))
        return first.unionByName(second)

    @property
    def loans(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            (F.col("c_nationkey") % 5).cast("string").alias(ENTITY),
            F.when(F.col("c_mktsegment") == "MACHINERY", C.LOAN_LEASEBACK).otherwise(C.LOAN_CREDIT).alias("tipo"),
            F.col("c_acctbal").cast(MONEY).alias("monto"), ((key % 10) * F.lit(0.03)).alias("tasa_ea"),
            ((key % 7) * 6).cast("int").alias("meses"), (key % 3 != 0).alias("activo"),
        )

    @property
    def supplier_groups(self) -> DataFrame:
        return self.read("supplier").select(
            (F.col("s_nationkey") % 5).cast("string").alias(ENTITY),
            F.col("s_nationkey").cast("string").alias("grupo"), F.col("s_name").alias("PROVEEDOR"),
        )

    @property
    def ticked_bills(self) -> DataFrame:
        """Numbers ticked for payment: the urgent orders, whatever company billed them."""
        urgent = self.read("orders").where(F.col("o_orderpriority") == "1-URGENT")
        companies = F.explode(F.array(*(F.lit(str(n)) for n in range(5))))
        return urgent.select(companies.alias(ENTITY), F.col("o_orderkey").cast("string").alias("FACTURA"))
