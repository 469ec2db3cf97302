"""Row validation of landing files into an issues table.

Input is a raw *string* DataFrame with ``file_name``, ``row_num`` and the
contract columns (as read by ``sources.files`` or built by the test views).
Each rule is a column expression yielding an issue struct or NULL; the issue
array of a row is filtered and exploded once, so all rules are evaluated in
a single pass (whole-stage codegen). A row survives only without errors.
The only shuffles are the in-file duplicate check (keyed by file and id),
the optional existing-id lookup, and the registry mapping join on distinct
values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import is_blank, parse_date, r2, strip_ws
from ..functions.frames import computed
from .normalize import DEFAULT_MODE, normalize_values

ISSUE_COLUMNS = ["file_name", "row_num", "severity", "column", "value", "message"]


def issue(severity: str, column: str, value, message) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    m = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(severity).alias("severity"), F.lit(column).alias("column"),
                    v.cast("string").alias("value"), m.alias("message"))


def _msg(template: str, *cols) -> Column:
    """Fill '{}' slots of a fixed message with column values."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for c, p in zip(cols, parts[1:]):
        out += [F.coalesce(c.cast("string"), F.lit("None")), F.lit(p)]
    return F.concat(*out)


# --------------------------------------------------------------- A3 / files

def month_from_filename(df: DataFrame, col: str = "file_name") -> DataFrame:
    """A3: first 'YYYY[-_]MM' in the name; month must be 1-12. Adds
    record_month (NULL when invalid) and file_error (issue struct or NULL)."""
    fn = F.col(col)
    found = F.regexp_extract(fn, K.FILENAME_MONTH_PATTERN, 0)
    y, m = F.substring(found, 1, 4), F.substring(found, 6, 2)
    matched = found != ""
    ok = matched & m.try_cast("int").between(1, 12)
    err = (F.when(~matched, issue("error", "Filename", None, _msg(K.MSG_FILENAME_NO_MONTH, fn)))
            .when(~ok, issue("error", "Filename", None, _msg(K.MSG_FILENAME_BAD_MONTH, m, fn))))
    return (df.withColumn("record_month", F.when(ok, F.concat(y, F.lit("-"), m)))
              .withColumn("file_error", err))


def _explode_issues(rows: DataFrame) -> DataFrame:
    return (rows.select("file_name", "row_num", F.explode("issues").alias("i"))
                .select("file_name", F.col("row_num").cast("int").alias("row_num"), "i.*"))


def _has_error(arr: Column) -> Column:
    return F.exists(arr, lambda x: x["severity"] == "error")


def _compact(*issues: Column) -> Column:
    """The issues that are not null (compiled, as a filter over an array is not)."""
    return F.concat(*[F.when(i.isNotNull(), F.array(i)).otherwise(_no_issues()) for i in issues])


def _no_issues() -> Column:
    return F.array().cast("array<struct<severity:string,column:string,value:string,message:string>>")


# ------------------------------------------------------------ headcount

def headcount_rule_b1(raw: DataFrame) -> Column:
    p = F.col("Project")
    return F.when(is_blank(p), issue("error", "Project", p, K.MSG_PROJECT_EMPTY))


def headcount_rule_b2(raw: DataFrame) -> Column:
    h = F.col("Headcount")
    t = strip_ws(h)
    x = t.try_cast("double")
    return (F.when(h.isNull(), issue("error", "Headcount", None, K.MSG_HEADCOUNT_NULL))
             .when(~t.rlike(K.NUMBER_PATTERN),
                   issue("error", "Headcount", h, _msg(K.MSG_HEADCOUNT_NAN, h)))
             .when((x != F.floor(x)) | (x < 0),
                   issue("error", "Headcount", h, _msg(K.MSG_HEADCOUNT_NOT_INT, h))))


def headcount_rows(raw: DataFrame) -> DataFrame:
    """B1, B2 per row of files whose name carries a valid month."""
    d = month_from_filename(raw).where(F.col("record_month").isNotNull())
    issues = _compact(headcount_rule_b1(d), headcount_rule_b2(d))
    return d.select("file_name", "row_num", "record_month",
                    strip_ws("Project").alias("project_name"),
                    strip_ws("Headcount").try_cast("double").cast("long").alias("headcount"),
                    issues.alias("issues"))


def _registry_names(registry: DataFrame) -> DataFrame:
    return registry.select("kind", F.col("canonical").alias("_canon")).distinct() \
                   .withColumn("_in_registry", F.lit(True))


def with_registry_flag(mapping: DataFrame, registry: DataFrame) -> DataFrame:
    """The value mapping with ``in_registry`` (its canonical name is known), so
    that rows look a value up once."""
    names = _registry_names(registry).withColumnRenamed("_canon", "canonical")
    return (mapping.join(names, ["kind", "canonical"], "left")
            .select(*mapping.columns, F.coalesce("_in_registry", F.lit(False)).alias("in_registry")))


def _map_column(rows: DataFrame, mapping: DataFrame, colname: str, kind: str):
    """``mapping`` as from ``with_registry_flag``."""
    m = mapping.where(F.col("kind") == kind).select(
        F.col("value").alias(colname), F.col("canonical").alias("_canon"), F.col("in_registry").alias("_known"))
    return (rows.join(m, colname, "left")
                .withColumn(colname + "_in_registry", F.coalesce("_known", F.lit(False)))
                .withColumn(colname + "_canonical", F.coalesce("_canon", F.col(colname)))
                .drop("_canon", "_known"))


def validate_headcount(raw: DataFrame, registry: DataFrame, mode: str = DEFAULT_MODE,
                       materialize: bool = True) -> dict:
    """Headcount files -> {'rows', 'valid', 'issues', 'report'}."""
    rows = headcount_rows(raw)
    if materialize:
        rows = _materialize(rows)
    ok_rows = rows.where(~_has_error(F.col("issues")))
    values = ok_rows.select(F.lit("projects").alias("kind"), F.col("project_name").alias("value"))
    mapping = with_registry_flag(
        normalize_values(values, registry.where(F.col("kind") == "projects"), mode=mode), registry)
    if materialize:
        mapping = _materialize(mapping)
    mapped = _map_column(ok_rows, mapping, "project_name", "projects")
    reg_issues = mapped.select(
        "file_name", F.lit(None).cast("int").alias("row_num"),
        F.filter(F.array(
            F.when(~F.col("project_name_in_registry"),
                   issue("error", "Project", F.col("project_name"),
                         _msg(K.MSG_UNRECOGNIZED_HC_PROJECT, F.col("project_name")))),
            F.when(F.col("project_name_in_registry")
                   & (F.col("project_name") != F.col("project_name_canonical")),
                   issue("warning", "Project", F.col("project_name"),
                         _msg(K.MSG_AUTOCORRECTED, F.col("project_name_canonical"))))),
            lambda x: x.isNotNull()).alias("issues"))
    valid = mapped.where("project_name_in_registry").select(
        "file_name", "row_num", F.col("project_name_canonical").alias("project_name"),
        "record_month", "headcount")
    issues = _explode_issues(rows).unionByName(_explode_issues(reg_issues)) \
        .unionByName(_file_issues(raw))
    return {"rows": rows, "valid": valid, "issues": issues,
            "report": quality_report(raw, issues, valid, "headcount")}


def _file_issues(raw: DataFrame) -> DataFrame:
    f = month_from_filename(raw.select("file_name").distinct())
    return (f.where(F.col("file_error").isNotNull())
             .select("file_name", F.lit(None).cast("int").alias("row_num"), "file_error.*"))


# -------------------------------------------------------------- leavers

REQUIRED_TEXT = ["Employee Name", "Project", "Department", "Position"]
DATE_COLUMNS = ["Date of Joining", "Date of Leaving"]
SERVICE = "Length of Service"


def repeated_ids(raw: DataFrame) -> DataFrame:
    """The first row of each id that a file repeats: reduced map-side, so an id
    that fills a file is one row of the table that is joined back. It is
    stored: its measured size decides whether the rows must move for it."""
    ids = raw.select("file_name", "row_num", strip_ws("Employee ID").alias("_eid")).where(F.col("_eid") != "")
    first = (ids.groupBy("file_name", "_eid")
             .agg(F.min("row_num").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .where("_n > 1").drop("_n"))
    return _materialize(first)


def leaver_checks(raw: DataFrame, existing_ids: DataFrame | None = None, repeated: bool = True,
                  first: DataFrame | None = None) -> DataFrame:
    """Adds parsed columns and one column per rule (issue struct or NULL).
    ``repeated=False`` leaves out the lookup of repeated ids, for callers that
    read another rule; ``first`` is that lookup where a caller already has it."""
    d = month_from_filename(raw)
    d = d.withColumn("_eid", strip_ws("Employee ID")).withColumn("_blank_id", is_blank("Employee ID"))
    ids = d.where(F.col("record_month").isNotNull() & ~F.col("_blank_id"))
    for c, out in zip(DATE_COLUMNS, ["_doj", "_dol"]):
        d = d.withColumn(out, parse_date(c))
    d = computed(d).where(F.col("record_month").isNotNull())
    if repeated:
        d = d.join(repeated_ids(raw) if first is None else first, ["file_name", "_eid"], "left")
    else:
        d = d.withColumn("_first", F.lit(None).cast("int"))
    if existing_ids is not None:
        # semi-join the stored ids against this batch's ids (the small side is
        # broadcast at run time), so the stored table is scanned, not shuffled
        batch_ids = ids.select("_eid").distinct()
        known = (existing_ids.select(strip_ws("employee_id").alias("_eid"))
                             .join(batch_ids, "_eid", "left_semi").distinct()
                             .withColumn("_exists", F.lit(True)))
        d = d.join(known, "_eid", "left")
    else:
        d = d.withColumn("_exists", F.lit(None).cast("boolean"))
    rules = _leaver_rules()
    # the issues are built from the cases, not from the rules' columns: a row that
    # is only asked whether it failed builds none
    failed = F.lit(False)
    for n in ERROR_RULES:
        for holds, _ in rules[n]:
            failed = failed | F.coalesce(holds, F.lit(False))
    both = F.col("_doj").isNotNull() & F.col("_dol").isNotNull()
    expected = F.datediff("_dol", "_doj") / K.DAYS_PER_MONTH
    service = (F.when(F.col(SERVICE).isNull(), F.when(both, r2(expected)))
                .otherwise(strip_ws(SERVICE).try_cast("double")))
    return d.withColumns({
        **{n: _first_case(cases) for n, cases in rules.items()},
        "issues": F.concat(*[_first_case([(holds, F.array(i)) for holds, i in cases], _no_issues())
                             for cases in rules.values()]),
        "_failed": failed, "_service": service})


def leaver_issues(checked: DataFrame) -> DataFrame:
    """The issues of checked rows, a row each: as their exploded ``issues``, but a
    row is multiplied by the numbers of its cases, so that a reader who counts
    severities builds no values and messages."""
    rules = _leaver_rules().values()
    number, numbers, cases = 0, [], []
    for rule in rules:
        numbers.append(_first_case([(holds, F.array(F.lit(number + k))) for k, (holds, _) in enumerate(rule)],
                                   F.array().cast("array<int>")))
        number += len(rule)
        cases += [i for _, i in rule]
    rows = checked.withColumn("_case", F.explode(F.concat(*numbers)))
    field = lambda f: _first_case([(F.col("_case") == k, i[f]) for k, i in enumerate(cases)])
    return rows.select("file_name", F.col("row_num").cast("int").alias("row_num"),
                       *[field(f).alias(f) for f in ISSUE_COLUMNS[2:]])


def _leaver_rules() -> dict[str, list[tuple[Column, Column]]]:
    """The cases of each rule on parsed rows: (condition, issue); the first that
    holds counts."""
    days = F.datediff("_dol", "_doj")
    both = F.col("_doj").isNotNull() & F.col("_dol").isNotNull()
    s_raw = F.col(SERVICE)
    s_txt = strip_ws(SERVICE)
    s_num = s_txt.rlike(K.NUMBER_PATTERN)
    sx = s_txt.try_cast("double")
    expected = days / K.DAYS_PER_MONTH
    reason = F.col("Reason")

    rules = {
        "b3_id_required": [(F.col("_blank_id"),
                            issue("error", "Employee ID", F.col("Employee ID"), K.MSG_ID_EMPTY))],
        "b4_dup_in_file": [(~F.col("_blank_id") & (F.col("row_num") > F.col("_first")),
                            issue("error", "Employee ID", F.col("_eid"),
                                  _msg(K.MSG_ID_DUPLICATE, F.col("_eid"))))],
        "b5_exists_warning": [(~F.col("_blank_id") & F.coalesce("_exists", F.lit(False)),
                               issue("warning", "Employee ID", F.col("_eid"),
                                     _msg(K.MSG_ID_EXISTS, F.col("_eid"))))],
    }
    for c in REQUIRED_TEXT:
        rules["b6_" + c] = [(is_blank(c), issue("error", c, F.col(c), K.MSG_REQUIRED.format(c)))]
    for c, parsed in zip(DATE_COLUMNS, ["_doj", "_dol"]):
        rules["b7_" + c] = [(F.col(c).isNull(), issue("error", c, None, K.MSG_DATE_MISSING.format(c))),
                            (F.col(parsed).isNull(),
                             issue("error", c, F.col(c), K.MSG_DATE_UNPARSED.format(c)))]
    rules["b8_date_order"] = [(
        both & (F.col("_dol") < F.col("_doj")),
        issue("error", "Date of Leaving",
              F.concat(F.lit("DOJ: "), F.date_format("_doj", "yyyy-MM-dd"),
                       F.lit(", DOL: "), F.date_format("_dol", "yyyy-MM-dd")), K.MSG_DATE_ORDER))]
    rules["b9_service_fill"] = [(s_raw.isNull(), issue("warning", SERVICE, None, K.MSG_SERVICE_EMPTY))]
    rules["b10_service_check"] = [
        (s_raw.isNotNull() & ~s_num, issue("error", SERVICE, s_raw, _msg(K.MSG_SERVICE_NAN, s_raw))),
        (s_num & (sx < 0), issue("error", SERVICE, s_raw, K.MSG_SERVICE_NEGATIVE))]
    rules["b11_service_crosscheck"] = [(
        s_num & both & (F.abs(sx - expected) > K.SERVICE_TOLERANCE_MONTHS),
        issue("warning", SERVICE,
              F.concat(F.lit("Reported: "), sx.cast("string"), F.lit(", Expected: "),
                       F.format_string("%.2f", expected)), K.MSG_SERVICE_MISMATCH))]
    rules["b12_reason_default"] = [(is_blank(reason),
                                    issue("warning", "Reason", reason, K.MSG_REASON_EMPTY))]
    return rules


def _first_case(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    expr = F.when(*cases[0])
    for holds, value in cases[1:]:
        expr = expr.when(holds, value)
    return expr if otherwise is None else expr.otherwise(otherwise)


RULE_COLUMNS = {
    "lv_id_required": ["b3_id_required"],
    "lv_dup_in_file": ["b4_dup_in_file"],
    "lv_exists_warning": ["b5_exists_warning"],
    "lv_required_text": ["b6_" + c for c in REQUIRED_TEXT],
    "lv_parse_dates": ["b7_" + c for c in DATE_COLUMNS],
    "lv_date_order": ["b8_date_order"],
    "lv_service_fill": ["b9_service_fill"],
    "lv_service_check": ["b10_service_check"],
    "lv_service_crosscheck": ["b11_service_crosscheck"],
    "lv_reason_default": ["b12_reason_default"],
}


# rules whose issues are errors; those of the others are warnings
ERROR_RULES = ["b3_id_required", "b4_dup_in_file", *["b6_" + c for c in REQUIRED_TEXT],
               *["b7_" + c for c in DATE_COLUMNS], "b8_date_order", "b10_service_check"]


def rule_issues(checked: DataFrame, rule: str) -> DataFrame:
    """Issues raised by one rule family (for per-rule reporting)."""
    cols = RULE_COLUMNS[rule]
    return _explode_issues(checked.withColumn("issues", _compact(*[F.col(c) for c in cols])))


def clean_leaver_rows(checked: DataFrame) -> DataFrame:
    """The canonical 11-field record of every error-free row."""
    reason = F.col("Reason")
    return checked.where(~F.col("_failed")).select(
        "file_name", "row_num",
        F.col("_eid").alias("employee_id"),
        strip_ws("Employee Name").alias("employee_name"),
        strip_ws("Project").alias("project_name"),
        strip_ws("Department").alias("department"),
        strip_ws("Position").alias("position"),
        F.col("_doj").alias("date_of_joining"),
        F.col("_dol").alias("date_of_leaving"),
        F.col("_service").alias("length_of_service_months"),
        F.coalesce(strip_ws("Status"), F.lit(K.DEFAULT_STATUS)).alias("status"),
        F.when(is_blank(reason), F.lit(K.DEFAULT_REASON)).otherwise(strip_ws(reason))
         .alias("original_reason"),
        "record_month")


PREVIEW = 10  # rows of a file shown before it is committed


def preview(rows: DataFrame, most: int = PREVIEW) -> DataFrame:
    """The first ``most`` rows of each file by row number. Each task keeps that
    many of a file before the shuffle, so a large file is no large group."""
    order = Window.partitionBy("file_name").orderBy("row_num")
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")


LEAVER_KINDS = [("project_name", "projects", "Project"),
                ("department", "departments", "Department"),
                ("position", "positions", "Position")]


def leaver_mapping(clean: DataFrame, registry: DataFrame, mode: str = DEFAULT_MODE) -> DataFrame:
    values = None
    for colname, kind, _ in LEAVER_KINDS:
        v = clean.select(F.lit(kind).alias("kind"), F.col(colname).alias("value"))
        values = v if values is None else values.unionByName(v)
    return normalize_values(values, registry, mode=mode)


def registry_check(clean: DataFrame, mapping: DataFrame) -> DataFrame:
    """B15, B16 per row occurrence: unrecognized -> error (row dropped);
    auto-corrected -> warning. ``mapping`` as from ``with_registry_flag``.
    Returns rows with ``issues`` and ``in_registry``."""
    m = clean
    checks = []
    for colname, kind, label in LEAVER_KINDS:
        m = _map_column(m, mapping, colname, kind)
        ok = F.col(colname + "_in_registry")
        canon = F.col(colname + "_canonical")
        checks.append(F.when(~ok, issue("error", label, F.col(colname),
                                        _msg(K.MSG_UNRECOGNIZED, F.lit(label), F.col(colname)))))
        checks.append(F.when(ok & (F.col(colname) != canon),
                             issue("warning", label, F.col(colname), _msg(K.MSG_AUTOCORRECTED, canon))))
    allok = F.col("project_name_in_registry") & F.col("department_in_registry") \
        & F.col("position_in_registry")
    return m.withColumn("issues", _compact(*checks)).withColumn("in_registry", allok)


def _materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint to spark.checkpoint.dir: cuts lineage, is computed
    once for all consumers, and survives executor loss (never a local one)."""
    from ..session import materialize
    return materialize(df, "validate")


def validate_leavers(raw: DataFrame, registry: DataFrame, existing: DataFrame | None = None,
                     mode: str = DEFAULT_MODE, materialize: bool = True) -> dict:
    """Leaver files -> {'checked', 'clean', 'mapping', 'valid', 'issues',
    'registry_issues', 'report'}.

    With ``materialize`` the clean rows and the (small) value mapping are stored
    once, since mapping, registry check and report all read them. The issues
    are built where they are read: they are the larger part of the checked rows,
    and the clean rows need neither them nor the lookup of existing ids."""
    first = repeated_ids(raw)
    checked = leaver_checks(raw, existing, first=first)
    clean = clean_leaver_rows(leaver_checks(raw, first=first))
    if materialize:
        clean = _materialize(clean)
    mapping = with_registry_flag(leaver_mapping(clean, registry, mode), registry)
    if materialize:
        mapping = _materialize(mapping)
    reg = registry_check(clean, mapping)
    valid = reg.where("in_registry").select(
        "file_name", "row_num", "employee_id", "employee_name",
        F.col("project_name_canonical").alias("project_name"),
        F.col("department_canonical").alias("department"),
        F.col("position_canonical").alias("position"),
        "date_of_joining", "date_of_leaving", "length_of_service_months", "status",
        "original_reason", F.lit(None).cast("string").alias("ai_category"), "record_month")
    reg_issues = _explode_issues(reg.select("file_name", F.lit(None).cast("int").alias("row_num"),
                                            "issues"))
    issues = leaver_issues(checked).unionByName(reg_issues).unionByName(_file_issues(raw))
    return {"checked": checked, "clean": clean, "mapping": mapping, "valid": valid,
            "issues": issues, "registry_issues": reg_issues,
            "report": quality_report(raw, issues, valid, "leavers")}


# ------------------------------------------------------------ B17, B18

def quality_report(raw: DataFrame, issues: DataFrame, valid: DataFrame, file_type: str) -> DataFrame:
    """Per file validity, total rows, valid rows, errors, warnings."""
    files = month_from_filename(raw.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")))
    ic = issues.groupBy("file_name").agg(
        F.sum(F.when(F.col("severity") == "error", 1).otherwise(0)).alias("error_count"),
        F.sum(F.when(F.col("severity") == "warning", 1).otherwise(0)).alias("warning_count"))
    vc = valid.groupBy("file_name").agg(F.count(F.lit(1)).alias("valid_rows_count"))
    j = files.join(ic, "file_name", "left").join(vc, "file_name", "left")
    errors = F.coalesce("error_count", F.lit(0)).cast("long")
    return j.select(
        "file_name", F.lit(file_type).alias("file_type"), "record_month",
        (errors == 0).alias("is_valid"),
        F.when(F.col("record_month").isNull(), F.lit(0)).otherwise(F.col("n")).cast("long")
         .alias("total_rows"),
        F.coalesce("valid_rows_count", F.lit(0)).cast("long").alias("valid_rows_count"),
        errors.alias("error_count"),
        F.coalesce("warning_count", F.lit(0)).cast("long").alias("warning_count"))


def unrecognized_candidates(issues: DataFrame) -> DataFrame:
    """Distinct unrecognized (column, value) pairs, offered for A6."""
    return (issues.where((F.col("severity") == "error") & F.col("message").startswith("Unrecognized"))
                  .select("column", "value").distinct())


def autocorrections(issues: DataFrame) -> DataFrame:
    """B16 display form: distinct (column, original, normalized)."""
    return (issues.where((F.col("severity") == "warning") & F.col("message").startswith("Auto-corrected"))
                  .select("column", F.col("value").alias("original"),
                          F.regexp_extract("message", "'(.*)'$", 1).alias("normalized"))
                  .distinct())
