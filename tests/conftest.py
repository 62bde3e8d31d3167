import pytest

from foliomill.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "tests", "local[4]", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("work")),
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def one(spark):
    """Apply a column function to one text value."""
    def apply(function, *values):
        columns = [f"v{i}" for i in range(len(values))]
        schema = ", ".join(
            f"{c} {'long' if isinstance(v, int) else 'string'}" for c, v in zip(columns, values)
        )
        df = spark.createDataFrame([values], schema)
        return df.select(function(*[df[c] for c in columns]).alias("out")).first()["out"]

    return apply
