import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def not_broadcast_by_size(spark, name):
    """Files and keys of parts are small beside the objects, runs and places that are made of them, so their size must not decide."""
    import __spark_entry__

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")  # more than the keys of 200 parts take, less than line items
    try:
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        asked = plan.optimizedPlan().toString().count("(strategy=broadcast)")  # a row a class
        assert plan.sparkPlan().toString().count("BroadcastHashJoin") == asked
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
