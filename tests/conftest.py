import os
import sys

import pytest

_HERE = os.path.dirname(os.path.abspath(__file__))
_PATHS = [os.path.dirname(_HERE), _HERE, os.path.join(_HERE, "llm")]
sys.path[:0] = _PATHS
# workers import the package and the tests' own predictors
os.environ["PYTHONPATH"] = os.pathsep.join([*_PATHS, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF
