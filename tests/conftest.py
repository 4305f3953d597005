import pytest
from pyspark.sql import SparkSession

from pagewright.session import tuned


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
    builder = builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
    session = tuned(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column function on single values: one(fn, value) or one(fn, [values])."""

    def run(fn, values, kind="string"):
        from pyspark.sql import functions as F

        many = isinstance(values, list)
        rows = [(i, v) for i, v in enumerate(values if many else [values])]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        out = [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]
        return out if many else out[0]

    return run
