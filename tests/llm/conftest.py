import pytest


@pytest.fixture(scope="session")
def put(spark, tmp_path_factory):
    """Writes rows as a table folder and reads it back."""

    def make(rows, schema):
        path = str(tmp_path_factory.mktemp("t") / "x.parquet")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    return make
