import pytest


@pytest.fixture()
def frame(spark):
    """Rows and a schema string as a DataFrame over several partitions."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
