"""Plans that hold at size: what is moved, what is computed once a row."""

import datetime as dt
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from staffwise.functions import constants as K
from staffwise.functions import frames
from staffwise.functions.columns import parse_date, strip_ws
from staffwise.functions.frames import computed
from staffwise.operators import filters as FI
from staffwise.operators import state as ST
from staffwise.operators import validate as VA
from staffwise.sources import testviews as V

SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x85", " ", " ", " ", "x", ""]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_strip_is_the_pattern_on_any_edge(spark):
    texts = [(a + b + "ab c" + c + d,) for a in SPACES for b in SPACES for c in SPACES for d in SPACES]
    df = spark.createDataFrame(texts + [(None,), ("",), (" ",), ("\x85",), (" \n\x85",)], "t string")
    other = df.where(~strip_ws("t").eqNullSafe(F.regexp_replace("t", r"^\s+|\s+$", "")))
    assert other.collect() == []


def test_dates_are_those_of_the_parser_alone(spark):
    parts = ["1", "01", "0012", "13", "31", "32", "0", "-4", "+5", "1996", "01996", "+1996", "996", "x", ""]
    texts = [(a + s + b + z + c,) for a in parts for b in parts for c in parts for s in "-/" for z in "-/"]
    df = spark.createDataFrame(texts + [(None,), ("not a date",), ("1996-02-30",), (" 1996-2-3 ",)], "t string")
    plain = F.coalesce(*[F.try_to_date(strip_ws("t"), f) for f, _ in K.DATE_FORMATS])
    assert df.where(~parse_date("t").eqNullSafe(plain)).collect() == []
    assert df.where(parse_date("t").isNotNull()).count() > 50


def test_a_filter_does_not_repeat_computed_columns(spark):
    df = spark.range(9).withColumn("x", F.sqrt("id"))
    assert "SQRT" in plan(df.where("x > 1")).split("Filter")[1].split("\n")[0]
    kept = computed(df).where("x > 1")
    assert plan(kept).count("SQRT") == 1 and kept.count() == 7


def leaver_rows(spark, n=60):
    rows = [("leavers_1996_01.csv" if i % 3 else "leavers_1996_02.csv", i + 2, f"{i % 50}", "N", "P", "D", "Q",
             "1996-01-02", "03/01/1996" if i % 4 else "junk", "1.0", None, "r") for i in range(n)]
    return spark.createDataFrame(rows, "file_name string, row_num int, " + ", ".join(
        f"`{c}` string" for c in K.LEAVER_COLUMNS))


def test_checks_parse_a_date_once_and_move_no_rows(spark):
    clean = VA.clean_leaver_rows(VA.leaver_checks(leaver_rows(spark)))
    assert plan(clean).count("gettimestamp") <= 2 * len(K.DATE_FORMATS)
    assert "Exchange hashpartitioning(file_name" not in physical(clean) and "SortMergeJoin" not in physical(clean)
    # of the ids that a file repeats only the first row is clean
    assert clean.groupBy("file_name", "employee_id").count().where("count > 1").count() == 0


def test_a_rule_of_its_own_needs_no_repeated_ids(spark):
    raw = leaver_rows(spark)
    for rule in VA.RULE_COLUMNS:
        full = VA.rule_issues(VA.leaver_checks(raw), rule)
        alone = VA.rule_issues(VA.leaver_checks(raw, None, rule == "lv_dup_in_file"), rule)
        assert sorted(map(str, full.collect())) == sorted(map(str, alone.collect())), rule


def facts(spark, at):
    lv = spark.range(30000).select(
        F.format_string("%06d-%d", "id", "id").alias("employee_id"), F.sha2(F.col("id").cast("string"), 256).alias(
            "employee_name"), F.concat(F.lit("P"), F.col("id") % 4).alias("project_name"), F.lit("d").alias("department"),
        F.lit("p").alias("position"), F.lit(dt.date(1996, 1, 1)).alias("date_of_joining"),
        F.lit(dt.date(1996, 2, 1)).alias("date_of_leaving"), F.lit(1.0).alias("length_of_service_months"),
        F.lit("Resigned").alias("status"), F.lit("r").alias("original_reason"),
        F.lit(None).cast("string").alias("ai_category"), F.lit("1996-02").alias("record_month"))
    lv.write.mode("overwrite").parquet(f"{at}/lv")
    return spark.read.parquet(f"{at}/lv")


def test_rows_do_not_move_to_their_project_or_file(spark, tmpdir_path):
    lv = facts(spark, tmpdir_path)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # less than the facts have
    try:
        dim = FI.project_dimension(lv)
        joined = FI.leavers_with_project(lv, dim)
        assert "BroadcastHashJoin" in physical(joined) and "SortMergeJoin" not in physical(joined)
        assert joined.count() == 30000
        hc = lv.select("project_name", "record_month", F.lit(1).cast("long").alias("headcount")).limit(3)
        checks = ST.constraint_checks(hc, lv, dim)
        assert "SortMergeJoin" not in physical(checks)
        rows = lv.withColumn("file_name", F.col("record_month"))
        report = rows.groupBy("file_name").agg((F.count("*") > 0).alias("is_valid"))
        gated = ST.gated_rows(rows, report)
        assert "SortMergeJoin" not in physical(gated) and gated.count() == 30000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def tables(spark, at):
    day = lambda m, d: dt.datetime(1996, m, d)
    spark.createDataFrame([(i, f"C{i}", 1, 0.0, "BUILDING") for i in range(4)],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
                          ).write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(i, "n", f"Brand#{i}", "SMALL", 1, 1.0) for i in range(7)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
                          ).write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(i, i % 5, "O", 1.0, day(1 + i % 6, 3), "x") for i in range(40)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    lines = [(i % 37, i % 9, i % 11, None if i % 13 == 0 else i % 3, 1.0, float(i), 0.0, 0.0, "R", "F",
              None if i % 29 == 0 else day(1 + i * 7 % 8, 1 + i % 28)) for i in range(400)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                          "l_linestatus string, l_shipdate timestamp").write.parquet(f"{at}/lineitem.parquet")


def test_leaver_views_are_those_of_plain_windows(spark, tmpdir_path):
    tables(spark, tmpdir_path)
    t = {n: V.load(spark, tmpdir_path, n) for n in ("lineitem", "orders", "customer", "part")}
    j = (t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
         .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
         .withColumn("eid", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
         .withColumn("file", F.concat(F.lit("leavers_"), F.date_format("l_shipdate", "yyyy_MM"), F.lit(".csv"))))
    w = Window.partitionBy("eid").orderBy(F.col("l_shipdate").desc(), "l_partkey", "l_suppkey", "l_extendedprice")
    want = (j.where("l_shipdate >= o_orderdate").withColumn("n", F.row_number().over(w)).where("n = 1")
            .select("eid", "c_name", "p_brand", F.to_date("l_shipdate")))
    base = V.leaver_base(spark, tmpdir_path)
    base.write.parquet(f"{tmpdir_path}/base")
    base = spark.read.parquet(f"{tmpdir_path}/base")
    for given in (None, base):
        lv = V.hr_leavers(spark, tmpdir_path, given)
        got = lv.select("employee_id", "employee_name", "position", "date_of_leaving")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Exchange" not in V.hr_leavers(spark, tmpdir_path, base)._jdf.queryExecution().executedPlan().toString()
    w = Window.partitionBy("file").orderBy(*V._ROW_ORDER)
    want = j.withColumn("n", F.row_number().over(w) + 1).select("file", "n", "p_brand", "c_name")
    got = V.raw_leavers(spark, tmpdir_path, base=base).where("Position IS NOT NULL AND `Employee Name` <> ''")
    got = got.select("file_name", "row_num", "Position", "Employee Name")
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in want.collect()}
    assert V.raw_leavers(spark, tmpdir_path, base=base).count() == want.count()
    ids = V.raw_leavers(spark, tmpdir_path, clean_even=True, base=base).where(
        "file_name RLIKE '_0[1357]'").groupBy("file_name", "Employee ID").count()
    assert ids.where("count > 1").count() == 0


def test_usual_dates_are_read_without_a_parser(spark):
    texts = ["1996-02-03", "1996/02/03", "03/02/1996", "02/13/1996", "13/02/1996", "03-02-1996", "02-13-1996",
             "1996-02-30", "1996-02-3T", "1996-02/03", "0000-01-01", "01/02/0000", "00/02/1996", "1996-02-03\x85",
             "\x851996-02-03", "1996-02-03\n", "1996-02-03 1", "3/2/1996", "+1996-2-3", "31/04/1996", "04/31/1996",
             "12/12/1996 ", "١٩٩٦-٠٢-٠٣", "29/02/1900", "02/29/1996"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_date(strip_ws("t"), f) for f, _ in K.DATE_FORMATS])
    assert df.where(~parse_date("t").eqNullSafe(plain)).collect() == []
    assert "CASE WHEN" in plan(df.select(parse_date("t"))).split("gettimestamp")[0]  # the parser is the last case


def test_issues_are_not_stored_to_find_clean_rows(spark, registry, monkeypatch):
    stored, write = [], VA._materialize
    monkeypatch.setattr(VA, "_materialize", lambda df: stored.append(df) or write(df))
    raw = leaver_rows(spark)
    res = VA.validate_leavers(raw, registry)
    assert stored and not [df for df in stored if "issues" in df.columns]
    clean = next(df for df in stored if "employee_id" in df.columns)
    assert "cannot be empty" not in plan(clean)  # no issue is built for them
    assert res["clean"].count() == VA.clean_leaver_rows(VA.leaver_checks(raw)).count() > 0


def test_candidates_are_those_of_all_issues(spark, registry):
    res = VA.validate_leavers(leaver_rows(spark), registry)
    every = VA.unrecognized_candidates(res["issues"])
    some = VA.unrecognized_candidates(res["registry_issues"])
    assert sorted(every.collect()) == sorted(some.collect()) and some.count() > 0


def test_issues_of_checked_rows_are_their_issues(spark):
    checked = VA.leaver_checks(leaver_rows(spark))
    want, got = VA._explode_issues(checked), VA.leaver_issues(checked)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == VA.ISSUE_COLUMNS
    counted = got.groupBy("file_name").agg(F.sum(F.when(F.col("severity") == "error", 1)))
    assert "Recommended format" not in plan(counted)  # no message is built to be counted


def test_ranges_are_found_without_computing_the_rows(spark):
    rows = [(None if i % 17 == 0 else 20 + i % 3 if i % 2 else 20, i * 7919 % 5000, i) for i in range(60000)]
    df = spark.createDataFrame(rows, "g int, k long, x long")
    seen = spark.sparkContext.accumulator(0)
    once = F.udf(lambda v: seen.add(1) or v, "long")
    dealt = frames.dealt_like(df.withColumn("x", once("x")), df, "g", ["k", "x"])
    dealt.write.parquet(path := tempfile.mkdtemp() + "/dealt")
    assert seen.value == len(rows)
    stored = spark.read.parquet(path)
    assert stored.select("_pid").distinct().count() > 1
    w = Window.partitionBy("g").orderBy("k", "x")
    for few in (True, False):
        got = frames.placed(stored, "g", few=few).select("g", "k", "x", "row_num")
        want = df.withColumn("row_num", F.row_number().over(w))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    none = frames.dealt_like(df.where("k < 0"), df.where("k < 0"), "g", ["k", "x"])
    assert none.count() == 0
    other = frames.dealt_like(df, df.where("g IS NULL"), "g", ["k", "x"])  # groups that were not drawn
    assert other.count() == len(rows)


def test_a_stored_step_leaves_no_shuffle_files(spark):
    import time
    from staffwise.llm.common import staged
    from staffwise.session import materialize
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = manager.getAllFiles()
        return {n for n in (names.apply(i).getName() for i in range(names.size())) if n.startswith("shuffle_")}

    for write in (materialize, staged):
        before = shuffles()
        stored = write(spark.range(5000).withColumn("k", F.col("id") % 7).groupBy("k").count(), "few")
        for _ in range(100):  # files go in the background
            if not shuffles() - before:
                break
            time.sleep(0.1)
        assert not shuffles() - before and len(stored.collect()) == 7
