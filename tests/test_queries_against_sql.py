"""Every registered query gives the rows of its SQL, duplicates included."""

import re

import pytest

import __spark_entry__ as contract
from tests.check import compare, connect
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# queries of the corpus subpackage, which may be left out and have tests of their own
OPTIONAL = {name for name in contract.queries() if name == "pipeline" or re.match(r"op\d+_", name)}
OWN = [name for name in contract.queries() if name not in OPTIONAL]


def test_every_query_has_sql():
    assert set(OWN) == set(contract.oracle_sql()) - OPTIONAL


def test_every_operator_has_a_query():
    ids = [f"a{i}" for i in range(1, 9)] + [f"b{i}" for i in range(1, 7)]
    ids += [f"c{i}" for i in range(1, 16)] + [f"d{i}" for i in range(1, 10)]
    ids += [f"f{i}" for i in range(1, 7)] + [f"g{i}" for i in range(1, 7)]
    ids += ["h1", "h2", "i1", "i2", "i3", "i4", "i5", "j1", "j2", "k1"]
    assert set(ids) == {name.split("_")[0] for name in OWN}


@pytest.mark.parametrize("name", OWN)
def test_query(name, spark, con):
    df = contract.queries()[name](spark, SF_DIR)
    assert compare(df, con, contract.oracle_sql()[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["o", "c", "n"] and df.count() == 493
