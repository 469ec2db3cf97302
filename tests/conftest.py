import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    tmp = tempfile.mkdtemp(prefix="staffwise-test-")
    s = (SparkSession.builder.master("local[4]").appName("staffwise-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "6g")
         .config("spark.checkpoint.dir", os.path.join(tmp, "checkpoints"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from staffwise.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="staffwise-case-")


FIXTURE_REGISTRY = {
    "projects": ["Site I", "Site L", "Site M"],
    "departments": ["F&B", "Kitchen", "Human Resources", "Housekeeping", "Administration",
                    "Security", "KOT"],
    "positions": ["Waiter", "Chef", "Manager", "Helper", "Steward", "Officer", "House Keeper",
                  "Dish Washer", "Security Guard"],
}


@pytest.fixture()
def registry(spark):
    rows = [(k, i + 1, v) for k, vs in FIXTURE_REGISTRY.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "kind string, ordinal int, canonical string")


HC_SCHEMA = "project_name string, record_month string, headcount long"
LV_SCHEMA = ("employee_id string, employee_name string, project_name string, department string, "
             "position string, date_of_joining date, date_of_leaving date, "
             "length_of_service_months double, status string, original_reason string, "
             "ai_category string, record_month string")


def leavers_df(spark, rows):
    import datetime as dt
    out = []
    for r in rows:
        r = list(r)
        for i in (5, 6):
            if isinstance(r[i], str):
                r[i] = dt.date.fromisoformat(r[i])
        out.append(tuple(r))
    return spark.createDataFrame(out, LV_SCHEMA)
