from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from skumetry.schemas import TRANSACTIONS  # noqa: E402
from skumetry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4)
    yield session
    session.stop()


class Lines:
    """Builds transactions from the few columns a test cares about."""

    DEFAULTS = {
        "invoice_no": "536365",
        "stock_code": "85123A",
        "description": "LANTERN",
        "quantity": 1,
        "invoice_date": dt.datetime(2011, 3, 1, 9, 30),
        "unit_price": "1.00",
        "customer_id": "17850",
        "country": "United Kingdom",
    }

    def __init__(self, spark):
        self.spark = spark

    def __call__(self, *rows: dict):
        filled = []
        for row in rows:
            line = {**self.DEFAULTS, **row}
            if line["unit_price"] is not None:
                line["unit_price"] = Decimal(str(line["unit_price"]))
            filled.append(tuple(line[c] for c in TRANSACTIONS.fieldNames()))
        # Null checks need nulls in columns that are declared without them.
        schema = type(TRANSACTIONS)([type(f)(f.name, f.dataType, True) for f in TRANSACTIONS.fields])
        return self.spark.createDataFrame(filled, schema)

    def weekly(self, quantities: dict[str, list[int]], price="1.00"):
        """One line per SKU and week, in consecutive weeks."""
        monday = dt.datetime(2011, 1, 3, 12, 0)
        return self(*[
            {"stock_code": code, "quantity": q, "unit_price": price, "invoice_no": f"{code}{week}",
             "invoice_date": monday + dt.timedelta(weeks=week)}
            for code, weeks in quantities.items() for week, q in enumerate(weeks)
        ])


@pytest.fixture(scope="session")
def lines(spark):
    return Lines(spark)
