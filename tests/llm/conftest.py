import pytest

from ledgerloom.llm.common import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)
    return spark


@pytest.fixture
def frame(spark):
    """frame(rows, schema): a DataFrame of few rows."""
    return lambda rows, schema="doc_id long, text string": spark.createDataFrame(rows, schema)
