import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from arqueo import schemas  # noqa: E402
from arqueo.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 4, **{
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    yield session
    session.stop()


def date(text):
    return None if text is None else dt.date.fromisoformat(text)


def dec(value):
    return None if value is None else Decimal(str(value))


@pytest.fixture(scope="session")
def make(spark):
    """Builders of small logical tables."""

    class Make:
        def facturas(self, rows, entity="e"):
            full = [(entity, f, c, date(d), "USD", dec(v)) for f, c, d, v in rows]
            return spark.createDataFrame(full, schemas.FACTURAS)

        def monetizaciones(self, rows, entity="e"):
            full = [(entity, date(d), f, dec(m), dec(t)) for f, d, m, t in rows]
            return spark.createDataFrame(full, schemas.MONETIZACIONES)

        def intervalos(self, rows):
            full = [(r[3] if len(r) > 3 else 1, r[0], date(r[1]), date(r[2])) for r in rows]
            return spark.createDataFrame(full, schemas.TRM_INTERVALOS)

        def rates(self, rows):
            return spark.createDataFrame([(date(d), dec(v)) for d, v in rows], "fecha date, trm decimal(18,4)")

        def bills(self, rows, entity="e"):
            full = [(entity, p, f, dec(v), date(g), date(d)) for p, f, v, g, d in rows]
            return spark.createDataFrame(full, "entity_id string, PROVEEDOR string, FACTURA string, VALOR decimal(18,2), GENERACIO date, VENCIMIENTO date")

        def statement(self, rows):
            full = [(e, str(f), s, 0, r, [(c, None) if isinstance(c, str) or c is None else (None, float(c)) for c in cells])
                    for e, f, s, r, cells in rows]
            return spark.createDataFrame(full, schemas.EEFF_FILAS)

        def loans(self, rows):
            return spark.createDataFrame([(e, t, dec(m), r, n, a) for e, t, m, r, n, a in rows], schemas.LOANS)

        def plan(self, rows):
            return spark.createDataFrame([(e, w, *map(dec, values)) for e, w, *values in rows], schemas.CASH_PLAN)

    return Make()


def records(df, *keys):
    """Rows as dicts, keyed by the given columns (a single one unwrapped)."""
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys)
        out[key[0] if len(keys) == 1 else key] = row.asDict()
    return out


def numbers(row, names):
    return [None if row[n] is None else float(row[n]) for n in names]
