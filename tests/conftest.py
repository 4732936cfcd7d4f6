import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import parity  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = parity.session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    return parity.oracle(sf_dir)


@pytest.fixture()
def reviews(spark):
    """Small reviews with every awkward value."""
    rows = [
        (0, "P1", "ann", "5", "35-44", "Brown", None, "Fair", "Dry", "dark circle\ngone, \"wow\""),
        (1, "P1", None, "1", "35-44", "Blue", "Red", None, "Oily", "\"Dark Circle\" stays"),
        (2, "P2", "bob", "NA", None, None, None, None, None, "a\ttab and Café"),
        (3, "P2", "cy", "3", "18-24", "Brown", "Black", "Tan", "Dry", None),
        (4, "P9", "dee", "5", "18-24", "Green", None, None, "Normal", "no such product"),
        (5, "P3", "eve", "4", "over 54", None, None, None, "Combination", ""),
        (6, "P1", "NA", "5", "35-44", "Brown", None, None, "Dry", "it's a dark circle"),
    ]
    columns = ("fileIndex LONG, productID STRING, userNickname STRING, rating STRING, age STRING, "
               "eyeColor STRING, hairColor STRING, skinTone STRING, skinType STRING, review STRING")
    return spark.createDataFrame(rows, columns)


@pytest.fixture()
def products(spark):
    rows = [("P1", "Glow", "1", "Alpha"), ("P2", "Glow", "2", "Beta"), ("P3", "Tint", "2", "Beta"),
            ("P4", "Unseen", "3", None)]
    return spark.createDataFrame(
        rows, "ID STRING, Product_name STRING, Brand_id STRING, Brand_name STRING")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
