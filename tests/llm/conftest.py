import pytest
from odd_tables import CLASHING, ROWS, SCHEMA


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    df = odd_docs
    for name in CLASHING:
        df = df.withColumn(name, df["n_chars"])
    return df


@pytest.fixture(scope="session")
def sample_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
