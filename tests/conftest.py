import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TIDELANE_DRIVER_MEMORY", "6g")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidelane.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


def trajectory_rows(spark, rows, extra=False):
    """rows: (event_id, vehicle, pass, time, x, v, sh, th, space_index)"""
    schema = "event_id bigint, vehicle_id string, pass_no bigint, time_seconds double, x_meters double, velocity double, space_headway double, time_headway double, space_index bigint"
    df = spark.createDataFrame(rows, schema)
    if extra:
        from pyspark.sql import functions as F

        for name in ("block", "own", "lo", "hi", "n", "id", "state", "_b", "table_name"):
            df = df.withColumn(name, F.lit("clash"))
    return df
