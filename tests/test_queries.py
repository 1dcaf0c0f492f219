"""Every registered query against the SQL that states the same result, on the smallest data."""

import collections

import pytest

import __spark_entry__ as entry
from groundsift.registry import QUERIES
from oracle import check, duck

FOLDER = "/root/testdata/sf0.001"
FAMILIES = collections.defaultdict(list)
for _name in QUERIES:
    FAMILIES[_name[:2]].append(_name)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("family", sorted(FAMILIES))
def test_family(spark, con, family):
    bad = {}
    for name in FAMILIES[family]:
        verdict, _, _ = check(spark, con, name, FOLDER)
        if not verdict.startswith("ok"):
            bad[name] = verdict
    assert not bad


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "area_m2" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
