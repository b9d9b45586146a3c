import pytest
from pyspark import SparkContext
from pyspark.sql import SparkSession


def forget_dead_machine():
    """Lets a new session start where the machine of the one before has died."""
    try:
        if SparkContext._jvm is not None:
            SparkContext._jvm.java.lang.System.nanoTime()
    except Exception:
        SparkContext._gateway = SparkContext._jvm = SparkContext._active_spark_context = None
        SparkSession._instantiatedSession = None


@pytest.fixture(scope="module")
def spark():
    """A session for each module, so that one that dies takes no other module's tests with it."""
    forget_dead_machine()
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.adaptive.enabled", "false")
        # Tables of a few rows: compiling code would take longer than running it.
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    try:
        session.stop()
    except Exception:  # it is dead already
        forget_dead_machine()
