import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory() as at:
        s = (
            SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', 8)}]")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "6g")
            .config("spark.checkpoint.dir", f"{at}/checkpoints")
            .config("spark.sql.warehouse.dir", f"{at}/warehouse")
            .getOrCreate()
        )
        s.sparkContext.setLogLevel("ERROR")
        yield s
        s.stop()
