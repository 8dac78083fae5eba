import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    spark = (SparkSession.builder.master("local[2]").appName("tests").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "3").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
