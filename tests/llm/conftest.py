import pytest


@pytest.fixture()
def table(spark):
    """Frame of rows under a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
