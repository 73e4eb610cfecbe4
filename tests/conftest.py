import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.schema import TRANSACTIONS  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources.adapter import transactions  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="ledgerlens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tx(spark):
    return transactions(spark, SF)


def table(spark, rows):
    """Transactions from (step, type, amount, oldOrg, newOrig, oldDest, newDest, isFraud) tuples."""
    full = [
        (f"t{i:03d}", step, kind, float(a), f"C{i}", float(oo), float(no), f"M{i}", float(od), float(nd), y, 0)
        for i, (step, kind, a, oo, no, od, nd, y) in enumerate(rows)
    ]
    return spark.createDataFrame(full, TRANSACTIONS)


# The fifteen documented edge cases with their labels.
CASES = [
    (300, "TRANSFER", 200000, 1000000, 800000, 500000, 700000, 0),
    (1, "TRANSFER", 10000, 10000, 0, 0, 0, 1),
    (5, "PAYMENT", 10000, 10000, 0, 0, 0, 0),
    (1, "CASH_OUT", 400000, 400000, 0, 0, 400000, 1),
    (400, "CASH_OUT", 1000, 500000, 499000, 200000, 201000, 0),
    (743, "TRANSFER", 500000, 500000, 0, 100000, 0, 1),
    (200, "CASH_IN", 50000, 0, 50000, 1000000, 950000, 0),
    (1, "TRANSFER", 150000, 150000, 0, 21182, 0, 1),
    (100, "DEBIT", 1500, 25000, 23500, 5000, 6500, 0),
    (1, "TRANSFER", 339682.13, 339682.13, 0, 0, 0, 1),
    (50, "PAYMENT", 50000, 500000, 450000, 0, 0, 0),
    (1, "CASH_OUT", 150000, 150000, 0, 100000, 250000, 1),
    (200, "TRANSFER", 100000, 500000, 400000, 200000, 300000, 0),
    (2, "TRANSFER", 95000, 95000, 0, 50000, 0, 1),
    (10, "PAYMENT", 9999, 10000, 1, 0, 0, 0),
]
