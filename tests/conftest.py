import os
import sys

# small blocks, so that every test crosses block edges
os.environ.setdefault("FORETALLY_BLOCK_ROWS", "64")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest


@pytest.fixture(scope="session")
def spark():
    from foretally.session import get_spark
    session = get_spark("local[4]", "tests", partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables not present")
    return folder


@pytest.fixture(scope="session")
def skewed(spark):
    """Three series; one holds most rows and repeats values, one is a single row."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    parts = {"hot": np.round(rng.normal(10, 3, 700), 1), "warm": rng.exponential(2.0, 150), "one": np.array([4.0])}
    pdf = pd.concat([pd.DataFrame({"series_id": k, "order": np.arange(len(v)), "x": v}) for k, v in parts.items()])
    return parts, spark.createDataFrame(pdf.sample(frac=1, random_state=1))
