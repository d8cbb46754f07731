import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def conversations(spark):
    """200 conversations of four turns with fillers, sentences and code fences."""
    def turns(i):
        return [
            ("human", f"Please could you explain concept {i} in detail?"),
            ("gpt", f"Sure! Concept {i} works by doing X Y Z. " * 5),
            ("human", f"Can you give an example of concept {i}?"),
            ("gpt", f"Example: ```python\nprint({i})\n```"),
        ]

    rows = [(f"test_{i}", turns(i)) for i in range(200)]
    return spark.createDataFrame(rows, "id string, conversations array<struct<from:string,value:string>>")
