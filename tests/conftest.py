import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny(spark):
    """Small group and segment limits, so the large-key paths run on small data."""
    spark.conf.set("spark.trajspark.groupRows", "25")
    spark.conf.set("spark.trajspark.segmentRows", "8")
    yield spark
    spark.conf.unset("spark.trajspark.groupRows")
    spark.conf.unset("spark.trajspark.segmentRows")


@pytest.fixture
def smooth(spark):
    """Closed-form motion: make(n, stems) with analytic derivatives."""

    def make(n=60, stems=("s0",), dt=0.1):
        t = F.col("step") * dt
        f = F.col("k") * 0.7
        return (
            spark.range(n)
            .select(F.col("id").alias("step"))
            .withColumn("st", F.explode(F.array(*[F.struct(F.lit(s).alias("stem"), F.lit(i).alias("k")) for i, s in enumerate(stems)])))
            .select("st.stem", "st.k", "step")
            .select(
                "stem",
                "step",
                t.alias("time"),
                F.array(F.sin(t + f), F.cos(0.7 * t), 2 + 0.3 * F.sin(0.4 * t)).alias("p"),
                F.array(F.cos(t + f), -0.7 * F.sin(0.7 * t), 0.12 * F.cos(0.4 * t)).alias("v"),
                F.array(-F.sin(t + f), -0.49 * F.cos(0.7 * t), -0.048 * F.sin(0.4 * t)).alias("a"),
                F.array(-F.cos(t + f), 0.343 * F.sin(0.7 * t), -0.0192 * F.cos(0.4 * t)).alias("j"),
            )
        )

    return make
