"""Stored tables, staging and the shared folder."""

import os

import pytest
from pyspark.sql import functions as F

from staffwise import session as SE
from staffwise.operators import periods as P
from staffwise.operators import state as ST
from staffwise.sources import store as S


def test_first_committed_build_stays(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "table")
    os.makedirs(path)
    assert S._current(spark, path) is None
    assert S._commit(spark, path, "build-a") == "build-a"
    assert S._commit(spark, path, "build-b") == "build-a" == S._current(spark, path)


def test_rewritten_input_gives_a_new_key(spark, tmpdir_path):
    for t in S.SOURCES["hr_headcount"]:
        os.makedirs(f"{tmpdir_path}/{t}.parquet")
        open(f"{tmpdir_path}/{t}.parquet/part-0", "w").write("aaaa")
    first = S._snapshot_key(spark, tmpdir_path, "hr_headcount")
    file = f"{tmpdir_path}/orders.parquet/part-0"
    open(file, "w").write("bbbb")  # same size, in place
    os.utime(file, (2_000_000_000, 2_000_000_000))
    assert S._snapshot_key(spark, tmpdir_path, "hr_headcount") != first


def test_views_keep_every_row(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for view in ("leaver_base", "raw_leavers", "raw_leavers_gated"):
        assert S.stored(spark, sf, view).count() == n


def test_staging_scope_deletes_its_tables(spark):
    with SE.staging_scope(spark):
        df = SE.materialize(spark.range(5).toDF("x"), "scope-test")
        path = df.inputFiles()[0].removeprefix("file:").removeprefix("//")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_a_cluster_without_shared_folder_is_an_error():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app-none"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        SE.ensure_checkpoint_dir(Session())


def test_custom_period_needs_real_months(spark):
    for a, b in (("2026-13", "2026-14"), ("2026-1", "2026-02"), ("2026-05", "2026-04"), ("", "2026-01")):
        with pytest.raises(ValueError):
            P.custom_period(spark, a, b)


def test_last_category_update_wins(spark):
    lv = spark.createDataFrame([("1", "old"), ("2", None)], "employee_id string, ai_category string")
    up = spark.createDataFrame([(" 1 ", "first", 1), ("1", "last", 3), ("1", "zzz", 2)],
                               "employee_id string, category string, at int")
    got = {r.employee_id: r.ai_category for r in ST.update_category(lv, up, "at").collect()}
    assert got == {"1": "last", "2": None}


def test_one_label_per_employee(spark):
    from staffwise.operators.classify import classify_with_fallback
    lv = spark.createDataFrame([("1", "x")], "employee_id string, original_reason string")
    labels = spark.createDataFrame([("1", None), ("1", "Workload"), ("1", "Education")],
                                   "employee_id string, raw_label string")
    assert [r.category for r in classify_with_fallback(lv, labels).collect()] == ["Education"]


def test_ties_round_to_even(spark):
    from staffwise.functions.columns import r1, r2
    got = spark.createDataFrame([(6.25, 0.125), (6.35, 0.375), (-6.25, 2.5)], "a double, b double").select(
        r1("a").alias("a"), r2("b").alias("b")).collect()
    assert [tuple(r) for r in got] == [(6.2, 0.12), (6.4, 0.38), (-6.2, 2.5)]


def test_every_known_project_has_a_row(spark):
    from staffwise.operators import turnover as T
    hc = spark.createDataFrame([("A", "2026-01", 10), ("B", "2026-03", 5)],
                               "project_name string, record_month string, headcount long")
    lv = spark.createDataFrame([("A", "2026-01"), ("C", "2026-03")], "project_name string, record_month string")
    got = T.project_turnover(hc, lv, P.period_calendar(lv, types=("Monthly",))).select(
        "period_key", "project_name", "turnover_rate").collect()
    assert {(r[0], r[1]): r[2] for r in got} == {
        ("2026-01", "A"): 10.0, ("2026-01", "B"): 0.0, ("2026-01", "C"): 0.0,
        ("2026-03", "A"): 0.0, ("2026-03", "B"): 0.0, ("2026-03", "C"): 0.0}
    net = T.headcount_net_change(hc).where(F.col("project_name").isNotNull()).count()
    assert net == 4


def test_wide_matrix_mapping_and_category_split(spark):
    from staffwise.operators import filters as FI
    from staffwise.operators import normalize as N
    from staffwise.operators import turnover as T
    long = spark.createDataFrame([("A", "2026-01", "Jan-26", 5.0), ("B", "2026-02", "Feb-26", 2.0)],
                                 "project_name string, record_month string, month_label string, turnover_rate double")
    wide = {r.project_name: r.asDict() for r in T.matrix_view(long).collect()}
    assert wide["A"]["Jan-26"] == 5.0 and wide["A"]["Feb-26"] == 0.0
    rows = spark.createDataFrame([("hr", 1), ("x", 2)], "department string, n int")
    mapping = spark.createDataFrame([("departments", "hr", "Human Resources")],
                                    "kind string, value string, canonical string")
    got = {r.n: (r.department, r.department_original) for r in
           N.apply_mapping(rows, mapping, {"department": "departments"}).collect()}
    assert got == {1: ("Human Resources", "hr"), 2: ("x", "x")}
    split = FI.separation_split_by_category(spark.createDataFrame(
        [("1", "Termination"), ("2", "Education"), ("3", None)], "employee_id string, ai_category string"))
    assert {r.employee_id: r.is_termination for r in split.collect()} == {"1": True, "2": False, "3": False}


def test_staged_tables_are_released_on_demand(spark):
    import os
    from staffwise.session import ensure_checkpoint_dir, materialize, release_staged
    root = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "staffwise-staging")
    df = materialize(spark.range(5), "released")
    folder = df._stored_path.removeprefix("file:")
    assert os.path.isdir(folder) and folder.startswith(root) and df.count() == 5
    assert release_staged(spark) >= 1 and not os.path.exists(folder)
    assert release_staged(spark) == 0
