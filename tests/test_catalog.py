"""Every registered query against its SQL check on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from evalspark import catalog
from tests.oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_check(spark, connection, name):
    assert compare(spark, connection, name, SF_DIR) == ""


def test_every_query_has_a_check():
    assert set(catalog.QUERIES) == set(catalog.CHECKS)


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
