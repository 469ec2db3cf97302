"""HR-shaped views over the supplied TPC-H-like tables.

The supplied tables carry no HR data, so every operator is exercised through
these views. Each view exists twice, written the same way: a Spark DataFrame
builder and a DuckDB SQL text (used by the correctness oracle). Only the
spelling of month formatting and day differences changes between the two.

Mapping (all derived from the tables, so the work grows with them):

* hr_headcount  orders x customer: project = segment, month of the order date,
                headcount = distinct customers; BUILDING counts its Julys
                under June, so that calendar gaps exist.
* hr_leavers    line items shipped on/after the order date; one row per
                employee id (orderkey-linenumber).
* raw_leavers   the same rows before date filter and dedupe, as file text,
                with varied date spellings, broken service values and dirty
                department names; one landing file per ship month.
* raw_headcount hr_headcount as file text with broken cells.
* registry      canonical names: segments, part types (title case), brands.
* raw_labels    a noisy model label per stored leaver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import month_index, r2
from ..functions.frames import dealt_like, placed
from ..session import materialize

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Reason phrase by l_partkey % 20 and the category a reviewer assigned to it
# (the stored ai_category of the view). Test-view data, not engine logic.
REASON_PHRASES = [
    None, "", "N/A", "Other",
    "Got new job at higher rank",
    "Better package and car",
    "Moving abroad to US",
    "Marriage and family shift",
    "Health issues and surgery",
    "Going for higher studies in Germany",
    "Supervisor rude behavior",
    "Working environment was toxic",
    "High work pressure and workload",
    "Poor attendance and warnings",
    "His contract completed",
    "Was terminated due to rules",
    "Personal reasons",
    "Unknown text which doesn't match anything",
    "LWN",
    "night shift timing",
]
REVIEWED_CATEGORY = [
    "Other", "Other", "Other", "Other",
    "Better Career Opportunity", "Compensation & Benefits", "Relocation",
    "Family Reasons", "Health Reasons", "Education",
    "Supervisor / Management Issue", "Working Environment", "Workload",
    "Attendance / Discipline", "Contract Completion", "Termination",
    "Personal Reasons", "Other", "Left Without Notice", "Relocation",
]
# Raw model label by l_suppkey % 8.
RAW_LABELS = [None, "  Compensation & Benefits  ", "'Workload'", "relocation.",
              "The category is Education", "unknown thing", "- Health Reasons", ""]

# date spelling by l_suppkey % 6 (index 5 is junk)
DATE_SPELLINGS = [("yyyy-MM-dd", "%Y-%m-%d"), ("dd/MM/yyyy", "%d/%m/%Y"),
                  ("MM/dd/yyyy", "%m/%d/%Y"), ("yyyy/MM/dd", "%Y/%m/%d"),
                  ("dd-MM-yyyy", "%d-%m-%Y")]
JUNK_DATE = "not a date"
# junk department spelling by l_partkey % 5: alias keys and near-duplicate junk
JUNK_DEPARTMENTS = ["hr", "admin", "front desk", "Dept Q3", "Dept Q4"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- helpers

def _cap(c):
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.char_length(c))))


def _pick(index_col, values):
    """CASE index WHEN i THEN values[i] ... (values are literals)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        expr = F.when(index_col == i, lit) if expr is None else expr.when(index_col == i, lit)
    return expr


def _sql_lit(v):
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''") + "'"


def _sql_pick(index_sql, values):
    arms = " ".join(f"WHEN {i} THEN {_sql_lit(v)}" for i, v in enumerate(values))
    return f"CASE {index_sql} {arms} END"


def _sql_cap(x):
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


# ------------------------------------------------------------- Spark views

def hr_headcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    gap = (F.col("c_mktsegment") == "BUILDING") & (F.month("o_orderdate") == 7)
    counted = F.when(gap, F.add_months("o_orderdate", -1)).otherwise(F.to_date("o_orderdate"))
    return (j.groupBy(_cap(F.col("c_mktsegment")).alias("project_name"),
                      F.date_format(counted, "yyyy-MM").alias("record_month"))
             .agg(F.countDistinct("o_custkey").cast("long").alias("headcount")))


_ROW_ORDER = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey",
              "l_extendedprice", "l_linestatus"]


def _leaver_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items joined to order, customer and part, each with the month of
    its landing file, whether it is its employee's stored row (``_last``) and its place among
    the employee's rows of the file (``_again``).

    Orders meet their customers before the line items, and line items are joined
    by order last: the windows per employee id (order and line number) then find
    the rows where they need them. All sides grow together, so they are merged
    by key at any size."""
    l = load(spark, sf_dir, "lineitem")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    oc = o.join(c.hint("merge"), o.o_custkey == c.c_custkey)
    lp = l.join(p.hint("merge"), l.l_partkey == p.p_partkey)
    j = lp.join(oc.hint("merge"), lp.l_orderkey == oc.o_orderkey)
    stored = F.coalesce(F.col("l_shipdate") >= F.col("o_orderdate"), F.lit(False))
    employee = ["l_orderkey", "l_linenumber"]
    last = Window.partitionBy(*employee).orderBy(
        F.col("_stored").desc(), F.col("l_shipdate").desc(), "l_partkey", "l_suppkey", "l_extendedprice",
        "l_linestatus")
    again = Window.partitionBy(*employee, "_month").orderBy(*_ROW_ORDER)
    return (j.withColumn("_month", _month("l_shipdate"))
             .withColumn("_stored", stored)
             .withColumn("_last", F.col("_stored") & (F.row_number().over(last) == 1))
             .withColumn("_again", F.row_number().over(again))
             .select("_month", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_extendedprice", "l_linestatus", "l_returnflag", "l_shipdate", "o_orderdate", "c_name",
                     "c_mktsegment", "p_type", "p_brand", "_last", "_again"))


def _month(ts):
    return (F.year(ts) * 12 + F.month(ts) - 1).alias("_month")


def _employee_id():
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


def leaver_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared input of the leaver views (stored once), dealt by month and row:
    rows of a landing file stand together and are ready to be numbered. The
    ranges are found in the line items, not in the joined rows."""
    keys = load(spark, sf_dir, "lineitem").select(_month("l_shipdate"), "l_orderkey")
    return dealt_like(_leaver_base(spark, sf_dir), keys, "_month", _ROW_ORDER)


def hr_leavers(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    base = _leaver_base(spark, sf_dir) if base is None else base
    j = base.where("_last")
    doj = F.to_date("o_orderdate")
    dol = F.to_date("l_shipdate")
    reason_ix = F.col("l_partkey") % 20
    return j.select(
        _employee_id().alias("employee_id"),
        F.col("c_name").alias("employee_name"),
        _cap(F.col("c_mktsegment")).alias("project_name"),
        _cap(F.col("p_type")).alias("department"),
        F.col("p_brand").alias("position"),
        doj.alias("date_of_joining"),
        dol.alias("date_of_leaving"),
        r2(F.datediff(dol, doj) / 30.4375).alias("length_of_service_months"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("string"))
         .when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "Terminated")
         .otherwise("Resigned").alias("status"),
        _pick(reason_ix, REASON_PHRASES).alias("original_reason"),
        F.when(F.col("l_suppkey") % 4 == 0, F.lit(None).cast("string"))
         .otherwise(_pick(reason_ix, REVIEWED_CATEGORY)).alias("ai_category"),
        F.date_format("l_shipdate", "yyyy-MM").alias("record_month"),
    )


def raw_labels(spark: SparkSession, sf_dir: str, leavers: DataFrame | None = None) -> DataFrame:
    """Per stored leaver, a noisy model label (H2 input)."""
    lv = (hr_leavers(spark, sf_dir) if leavers is None else leavers).select("employee_id")
    # suppkey is recovered from the id's source row: re-derive from lineitem
    l = (load(spark, sf_dir, "lineitem")
         .select(F.concat_ws("-", F.col("l_orderkey").cast("string"),
                             F.col("l_linenumber").cast("string")).alias("employee_id"),
                 "l_suppkey")
         .groupBy("employee_id").agg(F.min("l_suppkey").alias("l_suppkey")))
    return (lv.join(l, "employee_id")
              .select("employee_id", _pick(F.col("l_suppkey") % 8, RAW_LABELS).alias("raw_label")))


def _fmt_date(ts, suppkey):
    d = F.to_date(ts)
    ix = suppkey % 6
    expr = None
    for i, (fmt, _) in enumerate(DATE_SPELLINGS):
        expr = (F.when(ix == i, F.date_format(d, fmt)) if expr is None
                else expr.when(ix == i, F.date_format(d, fmt)))
    return expr.otherwise(F.lit(JUNK_DATE))


def _service_text(days, partkey):
    correct = (days / 30.4375).cast("decimal(10,2)").cast("string")
    plus10 = (days / 30.4375 + 10).cast("decimal(10,2)").cast("string")
    ix = partkey % 7
    return (F.when(ix == 0, correct).when(ix == 1, F.lit(None).cast("string"))
            .when(ix == 2, plus10).when(ix == 3, F.lit("abc")).when(ix == 4, F.lit("-3"))
            .when(ix == 5, F.lit("10d")).otherwise(F.lit("")))


def _dirty_department(p_type, linenumber, partkey):
    t = _cap(p_type)
    ix = linenumber % 6
    n = F.length(t)
    return (F.when(ix == 0, t)
            .when(ix == 1, F.lower(t))
            .when(ix == 2, F.concat(F.lit("  "), F.upper(t), F.lit("  ")))
            .when(ix == 3, F.substring(t, 1, n - 1))
            .when(ix == 4, F.concat(t, F.substring(t, -1, 1)))
            .otherwise(_pick(partkey % 5, JUNK_DEPARTMENTS)))


def raw_leavers(spark: SparkSession, sf_dir: str, clean_even: bool = False,
                base: DataFrame | None = None) -> DataFrame:
    """Leaver landing rows as text, one file per ship month.

    With ``clean_even`` the rows in files of even month index are mended
    (dates in order, an id of its own for each repeated row, ISO dates, correct
    service, exact department), so the gate (A12) has files to load. In the
    other files some ids and required cells are blank.
    """
    if base is None:
        base = materialize(leaver_base(spark, sf_dir), "leaver-base")
    j = (placed(base, "_month", "_rn", few=True)
         .withColumn("employee_id", _employee_id())
         .withColumn("file_name", F.concat(F.lit("leavers_"), F.date_format("l_shipdate", "yyyy_MM"),
                                           F.lit(".csv")))
         .withColumn("_mi", month_index(F.date_format("l_shipdate", "yyyy-MM"))))
    if clean_even:
        even = F.col("_mi") % 2 == 0
        j = (j.withColumn("employee_id", F.when(even & (F.col("_again") > 1), F.concat_ws(
                  "-", "employee_id", F.col("_again").cast("string"))).otherwise(F.col("employee_id")))
              .withColumn("o_orderdate", F.when(even, F.least("o_orderdate", "l_shipdate"))
                          .otherwise(F.col("o_orderdate"))))
    else:
        even = F.lit(False)
    blank = ~even & (F.col("l_partkey") % 41 == 0)
    days = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    iso = lambda ts: F.date_format(F.to_date(ts), "yyyy-MM-dd")
    return j.select(
        "file_name",
        (F.col("_rn") + 1).alias("row_num"),
        F.when(blank & (F.col("l_suppkey") % 3 == 0), "  ").otherwise(F.col("employee_id")).alias("Employee ID"),
        F.when(blank & (F.col("l_suppkey") % 3 == 1), "").otherwise(F.col("c_name")).alias("Employee Name"),
        F.col("c_mktsegment").alias("Project"),
        F.when(even, _cap(F.col("p_type")))
         .otherwise(_dirty_department(F.col("p_type"), F.col("l_linenumber"), F.col("l_partkey")))
         .alias("Department"),
        F.when(blank & (F.col("l_suppkey") % 3 == 2), F.lit(None).cast("string"))
         .otherwise(F.col("p_brand")).alias("Position"),
        F.when(even, iso("o_orderdate")).otherwise(_fmt_date("o_orderdate", F.col("l_suppkey")))
         .alias("Date of Joining"),
        F.when(even, iso("l_shipdate")).otherwise(_fmt_date("l_shipdate", F.col("l_suppkey")))
         .alias("Date of Leaving"),
        F.when(even, (days / 30.4375).cast("decimal(10,2)").cast("string"))
         .otherwise(_service_text(days, F.col("l_partkey"))).alias("Length of Service"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("string"))
         .when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "Terminated")
         .otherwise("Resigned").alias("Status"),
        _pick(F.col("l_partkey") % 20, REASON_PHRASES).alias("Reason"),
    )


def raw_headcount(spark: SparkSession, sf_dir: str, clean_even: bool = False,
                  headcount: DataFrame | None = None) -> DataFrame:
    """Headcount landing rows as text, one file per month; broken cells on
    rows where (row_num + month index) % 11 == 0 (odd months only with
    ``clean_even``)."""
    h = hr_headcount(spark, sf_dir) if headcount is None else headcount
    w = Window.partitionBy("record_month").orderBy("project_name")
    h = (h.withColumn("row_num", F.row_number().over(w) + 1)
          .withColumn("_mi", month_index("record_month")))
    broken = (F.col("row_num") + F.col("_mi")) % 11 == 0
    if clean_even:
        broken = broken & (F.col("_mi") % 2 == 1)
    v = F.col("_mi") % 4
    hc = F.col("headcount").cast("string")
    hc_text = (F.when(broken & (v == 1), F.lit("-1"))
               .when(broken & (v == 2), F.lit("Ten"))
               .when(broken & (v == 3), F.lit("12.5"))
               .when((F.col("row_num") + F.col("_mi")) % 7 == 3, F.concat(hc, F.lit(".0")))
               .otherwise(hc))
    return h.select(
        F.concat(F.lit("headcount_"), F.regexp_replace("record_month", "-", "_"),
                 F.lit(".csv")).alias("file_name"),
        "row_num",
        F.when(broken & (v == 0), F.lit("")).otherwise(F.upper("project_name")).alias("Project"),
        hc_text.alias("Headcount"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, ordinal, canonical): projects, departments, positions."""
    c = load(spark, sf_dir, "customer").select(_cap(F.col("c_mktsegment")).alias("canonical")).distinct()
    p = load(spark, sf_dir, "part")
    d = p.select(_cap(F.col("p_type")).alias("canonical")).distinct()
    b = p.select(F.col("p_brand").alias("canonical")).distinct()
    u = (c.withColumn("kind", F.lit("projects"))
          .unionByName(d.withColumn("kind", F.lit("departments")))
          .unionByName(b.withColumn("kind", F.lit("positions"))))
    w = Window.partitionBy("kind").orderBy("canonical")
    return u.select("kind", F.row_number().over(w).cast("int").alias("ordinal"), "canonical")


def dirty_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct raw department spellings (C input): kind, value."""
    l = load(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = l.join(p, l.l_partkey == p.p_partkey)
    return (j.select(F.lit("departments").alias("kind"),
                     _dirty_department(F.col("p_type"), F.col("l_linenumber"),
                                       F.col("l_partkey")).alias("value"))
             .distinct())


# ------------------------------------------------------------ SQL views

def _sql_fmt_date(ts, supp):
    arms = " ".join(f"WHEN {supp} % 6 = {i} THEN strftime(CAST({ts} AS DATE), '{f}')"
                    for i, (_, f) in enumerate(DATE_SPELLINGS))
    return f"CASE {arms} ELSE '{JUNK_DATE}' END"


def _sql_dirty_department(t, ln, pk):
    c = _sql_cap(t)
    return (f"CASE {ln} % 6 WHEN 0 THEN {c} WHEN 1 THEN lower({c}) "
            f"WHEN 2 THEN '  ' || upper({c}) || '  ' "
            f"WHEN 3 THEN substr({c}, 1, length({c}) - 1) "
            f"WHEN 4 THEN {c} || substr({c}, length({c}), 1) "
            f"ELSE {_sql_pick(f'{pk} % 5', JUNK_DEPARTMENTS)} END")


_SQL_ROW_ORDER = ", ".join(_ROW_ORDER)
_SQL_DAYS = "date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))"
_SQL_STATUS = ("CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_linestatus = 'F' AND "
               "l_returnflag = 'R' THEN 'Terminated' ELSE 'Resigned' END")

_LEAVER_BASE_SQL = """
  SELECT l.*, o.o_custkey, o.o_orderdate, c.c_name, c.c_mktsegment, p.p_type, p.p_brand,
         CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS employee_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey"""


def _raw_leavers_sql(clean_even: bool) -> str:
    even = "(_mi % 2 = 0)" if clean_even else "FALSE"
    blank = f"(NOT {even} AND l_partkey % 41 = 0)"
    eid, joined = "employee_id", "o_orderdate"
    if clean_even:
        again = f"row_number() OVER (PARTITION BY file_name, employee_id ORDER BY {_SQL_ROW_ORDER})"
        eid = (f"CASE WHEN _mi % 2 = 0 AND {again} > 1 THEN employee_id || '-' || {again} "
               f"ELSE employee_id END")
        joined = "CASE WHEN _mi % 2 = 0 THEN least(o_orderdate, l_shipdate) ELSE o_orderdate END"
    svc = (f"CASE l_partkey % 7 WHEN 0 THEN CAST(CAST({_SQL_DAYS} / 30.4375 AS DECIMAL(10,2)) AS VARCHAR) "
           f"WHEN 1 THEN NULL "
           f"WHEN 2 THEN CAST(CAST({_SQL_DAYS} / 30.4375 + 10 AS DECIMAL(10,2)) AS VARCHAR) "
           f"WHEN 3 THEN 'abc' WHEN 4 THEN '-3' WHEN 5 THEN '10d' ELSE '' END")
    return f"""
  SELECT file_name,
         row_number() OVER (PARTITION BY file_name ORDER BY {_SQL_ROW_ORDER}) + 1 AS row_num,
         CASE WHEN {blank} AND l_suppkey % 3 = 0 THEN '  ' ELSE employee_id END AS "Employee ID",
         CASE WHEN {blank} AND l_suppkey % 3 = 1 THEN '' ELSE c_name END AS "Employee Name",
         c_mktsegment AS "Project",
         CASE WHEN {even} THEN {_sql_cap('p_type')}
              ELSE {_sql_dirty_department('p_type', 'l_linenumber', 'l_partkey')} END AS "Department",
         CASE WHEN {blank} AND l_suppkey % 3 = 2 THEN NULL ELSE p_brand END AS "Position",
         CASE WHEN {even} THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')
              ELSE {_sql_fmt_date('o_orderdate', 'l_suppkey')} END AS "Date of Joining",
         CASE WHEN {even} THEN strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d')
              ELSE {_sql_fmt_date('l_shipdate', 'l_suppkey')} END AS "Date of Leaving",
         CASE WHEN {even} THEN CAST(CAST({_SQL_DAYS} / 30.4375 AS DECIMAL(10,2)) AS VARCHAR)
              ELSE {svc} END AS "Length of Service",
         {_SQL_STATUS} AS "Status",
         {_sql_pick('l_partkey % 20', REASON_PHRASES)} AS "Reason"
  FROM (
    SELECT * REPLACE ({eid} AS employee_id, {joined} AS o_orderdate) FROM (
      SELECT *, 'leavers_' || strftime(l_shipdate, '%Y_%m') || '.csv' AS file_name,
             year(l_shipdate) * 12 + month(l_shipdate) - 1 AS _mi
      FROM ({_LEAVER_BASE_SQL}) b) y
  ) x"""


def _raw_headcount_sql(clean_even: bool) -> str:
    broken = "((row_num + _mi) % 11 = 0)"
    if clean_even:
        broken = f"({broken} AND _mi % 2 = 1)"
    return f"""
  SELECT 'headcount_' || replace(record_month, '-', '_') || '.csv' AS file_name,
         row_num,
         CASE WHEN {broken} AND _mi % 4 = 0 THEN '' ELSE upper(project_name) END AS "Project",
         CASE WHEN {broken} AND _mi % 4 = 1 THEN '-1'
              WHEN {broken} AND _mi % 4 = 2 THEN 'Ten'
              WHEN {broken} AND _mi % 4 = 3 THEN '12.5'
              WHEN (row_num + _mi) % 7 = 3 THEN CAST(headcount AS VARCHAR) || '.0'
              ELSE CAST(headcount AS VARCHAR) END AS "Headcount"
  FROM (
    SELECT *, row_number() OVER (PARTITION BY record_month ORDER BY project_name) + 1 AS row_num,
           CAST(substr(record_month, 1, 4) AS INTEGER) * 12
             + CAST(substr(record_month, 6, 2) AS INTEGER) - 1 AS _mi
    FROM hr_headcount) h"""


SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "hr_headcount": ([], f"""
  SELECT {_sql_cap('c.c_mktsegment')} AS project_name,
         strftime(CASE WHEN c.c_mktsegment = 'BUILDING' AND month(o.o_orderdate) = 7
                       THEN CAST(o.o_orderdate AS DATE) - INTERVAL 1 MONTH
                       ELSE CAST(o.o_orderdate AS DATE) END, '%Y-%m') AS record_month,
         CAST(count(DISTINCT o.o_custkey) AS BIGINT) AS headcount
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2"""),
    "hr_leavers": ([], f"""
  SELECT employee_id,
         c_name AS employee_name,
         {_sql_cap('c_mktsegment')} AS project_name,
         {_sql_cap('p_type')} AS department,
         p_brand AS position,
         CAST(o_orderdate AS DATE) AS date_of_joining,
         CAST(l_shipdate AS DATE) AS date_of_leaving,
         round_even({_SQL_DAYS} / 30.4375 * 100, 0) / 100 AS length_of_service_months,
         {_SQL_STATUS} AS status,
         {_sql_pick('l_partkey % 20', REASON_PHRASES)} AS original_reason,
         CASE WHEN l_suppkey % 4 = 0 THEN NULL
              ELSE {_sql_pick('l_partkey % 20', REVIEWED_CATEGORY)} END AS ai_category,
         strftime(l_shipdate, '%Y-%m') AS record_month
  FROM ({_LEAVER_BASE_SQL}) b
  WHERE l_shipdate >= o_orderdate
  QUALIFY row_number() OVER (PARTITION BY employee_id
          ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_linestatus) = 1"""),
    "raw_labels": (["hr_leavers"], f"""
  SELECT lv.employee_id, {_sql_pick('s.l_suppkey % 8', RAW_LABELS)} AS raw_label
  FROM hr_leavers lv JOIN (
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS employee_id,
           min(l_suppkey) AS l_suppkey
    FROM lineitem GROUP BY 1) s ON lv.employee_id = s.employee_id"""),
    "raw_leavers": ([], _raw_leavers_sql(False)),
    "raw_leavers_gated": ([], _raw_leavers_sql(True)),
    "raw_headcount": (["hr_headcount"], _raw_headcount_sql(False)),
    "raw_headcount_gated": (["hr_headcount"], _raw_headcount_sql(True)),
    "registry": ([], f"""
  SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY canonical) AS INTEGER) AS ordinal,
         canonical
  FROM (
    SELECT DISTINCT 'projects' AS kind, {_sql_cap('c_mktsegment')} AS canonical FROM customer
    UNION ALL SELECT DISTINCT 'departments', {_sql_cap('p_type')} FROM part
    UNION ALL SELECT DISTINCT 'positions', p_brand FROM part) r"""),
    "dirty_dimension": ([], f"""
  SELECT DISTINCT 'departments' AS kind,
         {_sql_dirty_department('p.p_type', 'l.l_linenumber', 'l.l_partkey')} AS value
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named views (and what they need)."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in SQL_VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"


SPARK_VIEWS = {
    "leaver_base": leaver_base,
    "hr_headcount": hr_headcount,
    "hr_leavers": hr_leavers,
    "raw_labels": raw_labels,
    "raw_leavers": raw_leavers,
    "raw_leavers_gated": lambda s, d, **kw: raw_leavers(s, d, clean_even=True, **kw),
    "raw_headcount": raw_headcount,
    "raw_headcount_gated": lambda s, d, **kw: raw_headcount(s, d, clean_even=True, **kw),
    "registry": registry,
    "dirty_dimension": dirty_dimension,
}
