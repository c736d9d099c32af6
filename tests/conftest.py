import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from docloom.session import build_session, local_checkpoint_dir


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    local_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluate columns over one row that holds the given text."""

    def run(text, *cols):
        import pyspark.sql.functions as F

        df = spark.createDataFrame([(text,)], "t string").repartition(1)
        return df.select(*[c(F.col("t")) if callable(c) else c for c in cols]).first()

    return run
