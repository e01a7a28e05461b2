"""Every catalog query with a SQL twin, at the smallest scale that determines its result."""

import pytest

import __spark_entry__ as entry_points
from compare import difference, duck

SMALLEST = "/root/testdata/sf0.001"
# The few calibration rows of the smallest scale are separable: no finite slope fits best.
NEXT = "/root/testdata/sf0.01"
AT_NEXT = {"platt_slope", "platt_slope_folds", "platt_heads_folds", "lr_certificate"}
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connections():
    return {folder: duck(folder) for folder in (SMALLEST, NEXT)}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connections, name):
    folder = NEXT if name in AT_NEXT else SMALLEST
    df = entry_points.queries()[name](spark, folder)
    assert difference(df, connections[folder].sql(ORACLES[name])) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 7


def test_known_counts_at_the_next_scale(spark):
    rows = entry_points.queries()["bucket_counts"](spark, NEXT).collect()
    counts = {r["bucket_id"]: r["n"] for r in rows}
    assert (counts[1], counts[2], counts[3], counts[4]) == (187, 494, 515, 380)
    assert sum(counts.values()) == 3530
