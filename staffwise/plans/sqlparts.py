"""DuckDB SQL building blocks for the correctness oracle.

Each named part is a CTE with dependencies; ``q(body, *names)`` prefixes a
query body with every part it needs, in dependency order. Parts mirror the
Spark operators one to one, written as plain SQL.
"""

from __future__ import annotations

from ..functions import constants as K
from ..sources.testviews import SQL_VIEWS


def MI(x: str) -> str:
    return f"(CAST(substr({x}, 1, 4) AS INTEGER) * 12 + CAST(substr({x}, 6, 2) AS INTEGER) - 1)"


def MT(x: str) -> str:
    return (f"printf('%04d-%02d', CAST(floor(({x}) / 12) AS INTEGER), "
            f"CAST(({x}) - floor(({x}) / 12) * 12 + 1 AS INTEGER))")


def R2(x: str) -> str:
    return f"(round_even(({x}) * 100, 0) / 100)"


def R1(x: str) -> str:
    return f"(round_even(({x}) * 10, 0) / 10)"


def PCT(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) * 100 ELSE 0.0 END)"


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def BLANK(x: str) -> str:
    return f"(coalesce({STRIP(x)}, '') = '')"


def lit(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def BRACKET(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) OR {x} < 0 THEN 'Unknown' "
            f"WHEN {x} < 3 THEN '< 3 Months' WHEN {x} < 6 THEN '3 - 6 Months' "
            f"WHEN {x} < 12 THEN '6 - 12 Months' WHEN {x} < 24 THEN '1 - 2 Years' "
            f"ELSE '> 2 Years' END)")


def BRACKET_ORD(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) OR {x} < 0 THEN 6 WHEN {x} < 3 THEN 1 "
            f"WHEN {x} < 6 THEN 2 WHEN {x} < 12 THEN 3 WHEN {x} < 24 THEN 4 ELSE 5 END)")


def RULES(x: str) -> str:
    t = f"lower({STRIP(x)})"
    empties = ", ".join(lit(e) for e in K.EMPTY_REASONS)
    arms = " ".join(f"WHEN regexp_matches({t}, {lit(p)}) THEN {lit(c)}"
                    for c, p in K.REASON_RULES)
    return (f"(CASE WHEN {t} IS NULL OR {t} = '' OR {t} IN ({empties}) THEN 'Other' "
            f"{arms} ELSE 'Other' END)")


def LABEL(x: str) -> str:
    t = f"lower(regexp_replace({STRIP(x)}, '^[''\"\\-\\s]+|[''\"\\-\\s.]+$', '', 'g'))"
    exact = " ".join(f"WHEN {t} = {lit(c.lower())} THEN {lit(c)}" for c in K.CATEGORIES)
    cont = " ".join(f"WHEN strpos({t}, {lit(c.lower())}) > 0 THEN {lit(c)}" for c in K.CATEGORIES)
    return f"(CASE {exact} {cont} ELSE NULL END)"


def TITLE(x: str) -> str:
    return ("array_to_string(list_transform(regexp_extract_all(lower(" + x + "), "
            "'(\\p{L}+|\\P{L}+)'), lambda p: upper(substr(p, 1, 1)) || substr(p, 2)), '')")


def CLEAN(x: str) -> str:
    return TITLE(f"regexp_replace({STRIP(x)}, '\\s+', ' ', 'g')")


def PARSE_DATE(x: str) -> str:
    s = STRIP(x)
    return "coalesce(" + ", ".join(
        f"CAST(try_strptime({s}, '{f}') AS DATE)" for _, f in K.DATE_FORMATS) + ")"


def ISNUM(x: str) -> str:
    return f"regexp_full_match({x}, {lit(K.NUMBER_PATTERN[1:-1])})"


PARTS: dict[str, tuple[list[str], str]] = {
    "hc": (["hr_headcount"], f"""
  SELECT project_name, record_month, CAST(headcount AS BIGINT) AS headcount,
         {MI('record_month')} AS mi FROM hr_headcount"""),
    "adj": (["hc"], """
  SELECT h.project_name, h.record_month, h.mi, h.headcount, p.headcount AS prev_headcount,
         CASE WHEN p.headcount IS NULL THEN CAST(h.headcount AS DOUBLE)
              ELSE (h.headcount + p.headcount) / 2.0 END AS adj_headcount
  FROM hc h LEFT JOIN hc p ON h.project_name = p.project_name AND h.mi = p.mi + 1"""),
    "madj": (["adj"], "SELECT mi, sum(adj_headcount) AS adj_total FROM adj GROUP BY mi"),
    "lvc": (["hr_leavers"], f"""
  SELECT project_name, record_month, CAST(count(*) AS BIGINT) AS leavers,
         {MI('record_month')} AS mi FROM hr_leavers GROUP BY project_name, record_month"""),
    "mlv": (["lvc"], "SELECT mi, CAST(sum(leavers) AS BIGINT) AS leavers FROM lvc GROUP BY mi"),
    "lv": (["hr_leavers"], f"SELECT *, {MI('record_month')} AS mi FROM hr_leavers"),
    "kmonths": (["hr_headcount", "hr_leavers"], f"""
  SELECT record_month, {MI('record_month')} AS mi FROM (
    SELECT record_month FROM hr_headcount UNION SELECT record_month FROM hr_leavers) u
  WHERE {MI('record_month')} IS NOT NULL"""),
    "pmonths": (["hr_leavers"], f"""
  SELECT record_month, mi, CAST(floor(mi / 12) AS INTEGER) AS y,
         CAST(mi - floor(mi / 12) * 12 AS INTEGER) AS mo
  FROM (SELECT DISTINCT record_month, {MI('record_month')} AS mi FROM hr_leavers) m
  WHERE mi IS NOT NULL"""),
    "periods": (["pmonths"], f"""
  SELECT period_label AS period_key, period_type, period_label, {MT('start_mi')} AS start_month,
         {MT('end_mi')} AS end_month, CAST(start_mi AS INTEGER) AS start_mi,
         CAST(end_mi AS INTEGER) AS end_mi
  FROM (
    SELECT 'Monthly' AS period_type, record_month AS period_label, mi AS start_mi, mi AS end_mi
    FROM pmonths
    UNION
    SELECT 'Quarterly', printf('%d Q%d', y, CAST(floor(mo / 3) AS INTEGER) + 1),
           y * 12 + CAST(floor(mo / 3) AS INTEGER) * 3, y * 12 + CAST(floor(mo / 3) AS INTEGER) * 3 + 2
    FROM pmonths
    UNION
    SELECT 'Semi-Annual', printf('%d H%d', y, CASE WHEN mo < 6 THEN 1 ELSE 2 END),
           y * 12 + CASE WHEN mo < 6 THEN 0 ELSE 6 END, y * 12 + CASE WHEN mo < 6 THEN 5 ELSE 11 END
    FROM pmonths
    UNION
    SELECT 'Annual', printf('%d Full Year', y), y * 12, y * 12 + 11 FROM pmonths) p"""),
    "pperiods": (["periods"], f"""
  SELECT *, CAST(start_mi - (end_mi - start_mi + 1) AS INTEGER) AS prev_start_mi,
         CAST(start_mi - 1 AS INTEGER) AS prev_end_mi,
         {MT('start_mi - (end_mi - start_mi + 1)')} AS prev_start_month,
         {MT('start_mi - 1')} AS prev_end_month,
         CASE WHEN start_mi = end_mi THEN start_month
              ELSE start_month || ' to ' || end_month END AS range_label,
         CASE WHEN start_mi = end_mi THEN {MT('start_mi - 1')}
              ELSE {MT('start_mi - (end_mi - start_mi + 1)')} || ' to ' || {MT('start_mi - 1')}
         END AS prev_range_label
  FROM periods"""),
    "pm": (["periods"], "SELECT period_key, unnest(generate_series(start_mi, end_mi)) AS mi FROM periods"),
}
PARTS.update(SQL_VIEWS)


def q(body: str, *names: str, local=()) -> str:
    """``local`` is a list of (name, sql) CTEs appended after the parts."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in PARTS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [(n, PARTS[n][1]) for n in order] + list(local)
    if not ctes:
        return body
    # only where a part reads itself: elsewhere a part may read a table of its own name
    kind = "WITH RECURSIVE " if any(n.endswith(("qpart", "kpart", "reach")) for n, _ in ctes) else "WITH "
    return kind + ",\n".join(f"{n} AS ({s}\n)" for n, s in ctes) + "\n" + body


def range_months(ranges: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"(SELECT {k}, unnest(generate_series(start_mi, end_mi)) AS mi FROM ({ranges}) r0)"


def overall_rates(ranges: str, keys: list[str]) -> str:
    """Mirror of turnover.overall_rates; needs parts madj, mlv."""
    k = ", ".join(keys)
    rm = range_months(ranges, keys)
    return f"""(
  SELECT {", ".join('r.' + x for x in keys)},
         CAST(coalesce(num.leavers, 0) AS BIGINT) AS leavers, den.avg_headcount,
         {R2(PCT('coalesce(num.leavers, 0)', 'den.avg_headcount'))} AS turnover_rate
  FROM (SELECT {k} FROM ({ranges}) r1) r
  LEFT JOIN (SELECT {k}, sum(adj_total) / count(adj_total) AS avg_headcount
             FROM {rm} rm JOIN madj USING (mi) GROUP BY {k}) den USING ({k})
  LEFT JOIN (SELECT {k}, sum(leavers) AS leavers
             FROM {rm} rm JOIN mlv USING (mi) GROUP BY {k}) num USING ({k}))"""


def project_rates(ranges: str, keys: list[str], denominator: str = "mean") -> str:
    """Mirror of turnover.project_rates; needs parts adj, lvc."""
    k = ", ".join(keys)
    kk = k + ", project_name"
    rm = range_months(ranges, keys)
    d = "den._s / den._n" if denominator == "mean" else "den._s"
    return f"""(
  SELECT {", ".join('sp.' + x for x in keys + ['project_name'])},
         CAST(coalesce(num.leavers, 0) AS BIGINT) AS leavers,
         {d} AS headcount_denominator,
         {R2(PCT('coalesce(num.leavers, 0)', d))} AS turnover_rate
  FROM (SELECT * FROM (SELECT {k} FROM ({ranges}) r1) r CROSS JOIN (
          SELECT project_name FROM adj UNION SELECT project_name FROM lvc) names
        WHERE project_name IS NOT NULL) sp
  LEFT JOIN (SELECT {kk}, sum(adj_headcount) AS _s, count(adj_headcount) AS _n
        FROM {rm} rm JOIN adj USING (mi) GROUP BY {kk}) den USING ({kk})
  LEFT JOIN (SELECT {kk}, sum(leavers) AS leavers
        FROM {rm} rm JOIN lvc USING (mi) GROUP BY {kk}) num USING ({kk}))"""


PARTS["ptot"] = (["periods", "lv", "pm"], """
  SELECT p.period_key, CAST(coalesce(a.n, 0) AS BIGINT) AS total_leavers, a.ss AS service_sum,
         a.sn AS service_n, CAST(coalesce(a.early, 0) AS BIGINT) AS early_n
  FROM periods p LEFT JOIN (
    SELECT period_key, count(*) AS n, sum(length_of_service_months::DECIMAL(30, 6))::DOUBLE AS ss,
           count(length_of_service_months) AS sn,
           sum(CASE WHEN length_of_service_months < 6.0 THEN 1 ELSE 0 END) AS early
    FROM lv JOIN pm USING (mi) GROUP BY period_key) a USING (period_key)""")


def dim_counts(dims) -> str:
    """Mirror of dist.dim_counts; needs parts lv, pm."""
    u = " UNION ALL ".join(f"SELECT mi, '{d}' AS dimension, CAST({d} AS VARCHAR) AS value FROM lv"
                           for d in dims)
    return f"""(SELECT period_key, dimension, value, CAST(count(*) AS BIGINT) AS departures
  FROM ({u}) s JOIN pm USING (mi) WHERE value IS NOT NULL
  GROUP BY period_key, dimension, value)"""


def single_share(expr: str, name: str) -> str:
    """Mirror of dist._single_dim_share; needs lv, pm, ptot."""
    return f"""(SELECT c.period_key, c.value AS {name}, c.departures,
         {R1('c.departures / t.total_leavers * 100')} AS share_pct
  FROM (SELECT period_key, value, CAST(count(*) AS BIGINT) AS departures
        FROM (SELECT mi, {expr} AS value FROM lv) s JOIN pm USING (mi)
        WHERE value IS NOT NULL GROUP BY period_key, value) c
  JOIN ptot t USING (period_key))"""


def MONTH_FROM_FILE(fn: str) -> str:
    y = f"regexp_extract({fn}, '(\\d{{4}})[-_](\\d{{2}})', 1)"
    m = f"regexp_extract({fn}, '(\\d{{4}})[-_](\\d{{2}})', 2)"
    return f"(CASE WHEN {y} <> '' AND TRY_CAST({m} AS INTEGER) BETWEEN 1 AND 12 THEN {y} || '-' || {m} END)"


_S = 'STRIP("Length of Service")'
PARTS["lvchk"] = (["raw_leavers"], f"""
  SELECT *, CASE WHEN NOT _blank_id THEN row_number() OVER (PARTITION BY file_name, _eid
                 ORDER BY row_num) END AS _occ
  FROM (
    SELECT *, {STRIP('"Employee ID"')} AS _eid, {BLANK('"Employee ID"')} AS _blank_id,
           {PARSE_DATE('"Date of Joining"')} AS _doj, {PARSE_DATE('"Date of Leaving"')} AS _dol,
           {ISNUM(STRIP('"Length of Service"'))} AS _snum,
           TRY_CAST({STRIP('"Length of Service"')} AS DOUBLE) AS _sx,
           {MONTH_FROM_FILE('file_name')} AS record_month
    FROM raw_leavers) r
  WHERE record_month IS NOT NULL""")

LV_ERROR = ("(_blank_id OR coalesce(_occ > 1, FALSE) OR " +
            " OR ".join(BLANK(f'"{c}"') for c in ["Employee Name", "Project", "Department", "Position"]) +
            " OR _doj IS NULL OR _dol IS NULL OR _dol < _doj"
            " OR (\"Length of Service\" IS NOT NULL AND NOT coalesce(_snum, FALSE))"
            " OR (coalesce(_snum, FALSE) AND _sx < 0))")

PARTS["lvclean"] = (["lvchk"], f"""
  SELECT file_name, row_num, _eid AS employee_id, {STRIP('"Employee Name"')} AS employee_name,
         {STRIP('"Project"')} AS project_name, {STRIP('"Department"')} AS department,
         {STRIP('"Position"')} AS position, _doj AS date_of_joining, _dol AS date_of_leaving,
         CASE WHEN "Length of Service" IS NULL THEN
              CASE WHEN _doj IS NOT NULL AND _dol IS NOT NULL THEN
                   {R2("date_diff('day', _doj, _dol) / 30.4375")} END
              ELSE _sx END AS length_of_service_months,
         coalesce({STRIP('"Status"')}, 'Resigned') AS status,
         CASE WHEN {BLANK('"Reason"')} THEN 'Not Specified' ELSE {STRIP('"Reason"')} END
           AS original_reason,
         record_month
  FROM lvchk WHERE NOT {LV_ERROR}""")


def ratcliff_ctes(pairs_sql: str, prefix: str) -> list:
    """CTEs that end in ``{prefix}ratio`` (kind, a, b, score): the
    Ratcliff-Obershelp ratio of the pairs (kind, a, b) of texts under 200
    characters whose lengths do not rule the cutoff out. The longest common
    block is taken out and what is left and right of it compared again, until
    nothing is left; of equally long blocks the first in a, then in b."""
    p = prefix
    longest = """list_transform(range(length(l)), lambda i: len(list_filter(range(1, length(l) - i + 1),
                 lambda k: contains(r, substr(l, i + 1, k)))))"""
    return [
        (f"{p}pair", f"""SELECT * FROM ({pairs_sql}) p0
             WHERE 2 * least(length(a), length(b)) >= {K.FUZZY_CUTOFF} * (length(a) + length(b)) AND length(a) > 0"""),
        # m: characters of the block that was found; the rows with m = 0 are
        # texts to compare, each gives its block and its two sides
        (f"{p}part", f"""SELECT kind, a, b, a AS l, b AS r, 0::BIGINT AS m FROM {p}pair
             UNION ALL
             SELECT kind, a, b, s.l, s.r, s.m FROM (
               SELECT kind, a, b, unnest([
                 {{'l': '', 'r': '', 'm': n}},
                 {{'l': substr(l, 1, i), 'r': substr(r, 1, strpos(r, substr(l, i + 1, n)) - 1), 'm': 0::BIGINT}},
                 {{'l': substr(l, i + n + 1), 'r': substr(r, strpos(r, substr(l, i + 1, n)) + n), 'm': 0::BIGINT}}]) AS s
               FROM (SELECT *, list_max(runs)::BIGINT AS n, list_position(runs, list_max(runs)) - 1 AS i
                     FROM (SELECT kind, a, b, l, r, {longest} AS runs FROM {p}part
                           WHERE m = 0 AND l <> '' AND r <> '')) WHERE n > 0)"""),
        (f"{p}ratio", f"""SELECT kind, a, b, 2.0::DOUBLE * sum(m)::BIGINT / (length(a) + length(b)) AS score
             FROM {p}part GROUP BY kind, a, b"""),
    ]


def norm_ctes(values_sql: str, registry_sql: str, prefix: str = "n") -> list:
    """Mirror of normalize.normalize_values as local CTEs; the last one,
    ``{prefix}map``, has (kind, value, cleaned, canonical, step, score)."""
    p = prefix
    aliases = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in K.ALIASES)
    return [
        (f"{p}v", f"SELECT DISTINCT kind, value, {CLEAN('value')} AS cleaned FROM ({values_sql}) v0"),
        (f"{p}c", f"SELECT DISTINCT kind, cleaned, lower(cleaned) AS lv FROM {p}v"),
        (f"{p}reg", f"SELECT kind, ordinal, canonical, lower(canonical) AS lc FROM ({registry_sql}) r0"),
        (f"{p}ex", f"""SELECT c.kind, c.cleaned, arg_min(r.canonical, r.ordinal) AS exact
             FROM {p}c c JOIN {p}reg r ON c.kind = r.kind AND c.lv = r.lc GROUP BY 1, 2"""),
        (f"{p}al", f"""SELECT c.kind, c.cleaned, a.canon AS alias FROM {p}c c
             JOIN (VALUES {aliases}) a(k, canon) ON c.lv = a.k"""),
        (f"{p}pf", f"""SELECT c.kind, c.cleaned, arg_min(r.canonical, r.ordinal) AS prefix
             FROM {p}c c JOIN {p}reg r ON c.kind = r.kind AND length(c.lv) >= 4
              AND starts_with(r.lc, c.lv) GROUP BY 1, 2"""),
        *ratcliff_ctes(f"""SELECT DISTINCT c.kind, r.canonical AS a, c.cleaned AS b
             FROM {p}c c JOIN {p}reg r ON c.kind = r.kind""", f"{p}q"),
        (f"{p}fz", f"""SELECT kind, b AS cleaned, a AS fuzzy, score FROM {p}qratio WHERE score >= {K.FUZZY_CUTOFF}
             QUALIFY row_number() OVER (PARTITION BY kind, b ORDER BY score DESC, a DESC) = 1"""),
        (f"{p}m0", f"""SELECT c.kind, c.cleaned, ex.exact, al.alias, pf.prefix, fz.fuzzy, fz.score,
               CASE WHEN ex.exact IS NOT NULL THEN 'exact' WHEN al.alias IS NOT NULL THEN 'alias'
                    WHEN pf.prefix IS NOT NULL THEN 'prefix' WHEN fz.fuzzy IS NOT NULL THEN 'fuzzy'
                    ELSE 'none' END AS step
             FROM {p}c c LEFT JOIN {p}ex ex ON ex.kind = c.kind AND ex.cleaned = c.cleaned
             LEFT JOIN {p}al al ON al.kind = c.kind AND al.cleaned = c.cleaned
             LEFT JOIN {p}pf pf ON pf.kind = c.kind AND pf.cleaned = c.cleaned
             LEFT JOIN {p}fz fz ON fz.kind = c.kind AND fz.cleaned = c.cleaned"""),
        (f"{p}map", f"""SELECT v.kind, v.value, v.cleaned,
               coalesce(m.exact, m.alias, m.prefix, m.fuzzy, v.cleaned) AS canonical, m.step,
               CASE WHEN m.step = 'fuzzy' THEN m.score END AS score
             FROM {p}v v JOIN {p}m0 m ON m.kind = v.kind AND m.cleaned = v.cleaned"""),
    ]


import re as _re


def gated(sql: str) -> str:
    """The same SQL over the gated landing views (clean even-month files)."""
    sql = _re.sub(r"\blvchk\b", "lvchkg", sql)
    sql = _re.sub(r"\blvclean\b", "lvcleang", sql)
    sql = _re.sub(r"\braw_leavers\b", "raw_leavers_gated", sql)
    return _re.sub(r"\braw_headcount\b", "raw_headcount_gated", sql)


PARTS["lvchkg"] = (["raw_leavers_gated"], gated(PARTS["lvchk"][1]))
PARTS["lvcleang"] = (["lvchkg"], gated(PARTS["lvclean"][1]))
