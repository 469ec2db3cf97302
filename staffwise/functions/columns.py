"""Column expressions shared by all operators.

All of these are built-in Spark expressions (whole-stage codegen, no Python
in the hot path).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- numbers

def r2(c) -> Column:
    """Round to 2 places, ties to the even digit."""
    return F.rint(col(c) * 100) / 100


def r1(c) -> Column:
    return F.rint(col(c) * 10) / 10


def ratio_pct(num, den) -> Column:
    """num / den * 100, 0.0 when den is NULL or <= 0 (no ANSI division error)."""
    den = col(den)
    return F.when(den > 0, col(num).cast("double") / den * 100).otherwise(F.lit(0.0))


# ----------------------------------------------------------------- months

def month_index(c) -> Column:
    """'YYYY-MM' -> year*12 + month - 1 (NULL for malformed text)."""
    c = col(c)
    return (F.substring(c, 1, 4).try_cast("int") * 12
            + F.substring(c, 6, 2).try_cast("int") - 1)


def month_text(mi) -> Column:
    mi = col(mi)
    return F.format_string("%04d-%02d", F.floor(mi / 12).cast("int"),
                           (mi - F.floor(mi / 12) * 12 + 1).cast("int"))


# ---------------------------------------------------------------- strings

# whitespace, and the line ends that may follow it at the end of a text
_EDGES = " \t\n\x0b\x0c\r\x85\u2028\u2029"


def strip_ws(c) -> Column:
    """Python-style strip(): all leading/trailing whitespace, not only blanks.
    Texts without any at their ends, nearly all, are returned as they are."""
    c = col(c)
    return F.when(F.btrim(c, F.lit(_EDGES)) == c, c).otherwise(F.regexp_replace(c, r"^\s+|\s+$", ""))


def is_blank(c) -> Column:
    return F.coalesce(strip_ws(c), F.lit("")) == ""


def title_case(c) -> Column:
    """Python str.title(): upper-case the first letter of every run of letters,
    lower-case the rest (so 'f&b' -> 'F&B', unlike initcap)."""
    pieces = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)),
                                               F.substring(x, F.lit(2), F.char_length(x)))), "")


def clean_name(c) -> Column:
    """trim, collapse inner whitespace, title-case."""
    return title_case(F.regexp_replace(strip_ws(c), r"\s+", " "))


# ------------------------------------------------------------------ dates

# what the parts of a date pattern can read at most; a text of another shape is
# not given to the parser, whose failures cost far more than a match
_DATE_PARTS = {"yyyy": "[+-]?[0-9]{4,}", "M": "[+-]?0*(?:[1-9]|1[0-2])", "d": "[+-]?0*(?:[1-9]|[12][0-9]|3[01])"}


def _date_shape(fmt: str) -> str:
    return "^" + "".join(_DATE_PARTS.get(p, re.escape(p)) for p in re.split(r"([-/])", fmt)) + "$"


# the texts nearly all dates are: ten characters, read without a parser
_YEAR_FIRST, _YEAR_LAST = "^[1-9][0-9]{3}([-/])[0-9]{2}\\1[0-9]{2}\\z", "^[0-9]{2}([-/])[0-9]{2}\\1[1-9][0-9]{3}\\z"
_DATE_CHARACTERS = "^[-+/0-9]+\\z"


def _date_of(s: Column, year: int, month: int, day: int) -> Column:
    """The date whose year, month and day begin at these places, if there is such a date."""
    return F.concat_ws("-", F.substring(s, year, 4), F.substring(s, month, 2),
                       F.substring(s, day, 2)).try_cast("date")


def parse_date(c) -> Column:
    """The date by the first of DATE_FORMATS that reads the text."""
    s = strip_ws(c)
    parsed = F.coalesce(*[F.when(s.rlike(_date_shape(fmt)), F.try_to_date(s, fmt)) for fmt, _ in K.DATE_FORMATS])
    month_first = F.when(F.substring(s, 3, 1) == "/", _date_of(s, 7, 1, 4))
    return (F.when(s.rlike(_YEAR_FIRST), _date_of(s, 1, 6, 9))
             .when(s.rlike(_YEAR_LAST), F.coalesce(_date_of(s, 7, 4, 1), month_first))
             .when(s.rlike(_DATE_CHARACTERS), parsed))


def _bracket(c, value) -> Column:
    """``value`` of the tenure bracket (a row of BRACKETS) that holds ``c``."""
    c = col(c)
    expr = F.when(c.isNull() | F.isnan(c) | (c < 0), F.lit(value(K.UNKNOWN_BRACKET)))
    for limit, bracket in zip(K.BRACKET_LIMITS, K.BRACKETS):
        expr = expr.when(c < limit, F.lit(value(bracket)))
    return expr.otherwise(F.lit(value(K.BRACKETS[-1])))


def service_bracket(c) -> Column:
    return _bracket(c, lambda b: b[1])


def service_bracket_ordinal(c) -> Column:
    return _bracket(c, lambda b: b[0])


# ----------------------------------------------------------- classification

def classify_rules(c) -> Column:
    """Ordered keyword rules; first matching pattern decides (H1)."""
    t = F.lower(strip_ws(col(c)))
    expr = F.when(t.isNull() | (t == "") | t.isin(*K.EMPTY_REASONS), F.lit(K.RULE_DEFAULT))
    for category, pattern in K.REASON_RULES:
        expr = expr.when(t.rlike(pattern), F.lit(category))
    return expr.otherwise(F.lit(K.RULE_DEFAULT))


def canonical_label(c) -> Column:
    """Raw model label -> taxonomy category or NULL (H2)."""
    t = F.regexp_replace(strip_ws(col(c)), K.LABEL_WRAPPING, "")
    lt = F.lower(t)
    expr = None
    for cat in K.CATEGORIES:  # exact, case-insensitive, first in list order
        cond = lt == cat.lower()
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    for cat in K.CATEGORIES:  # then containment, first in list order
        expr = expr.when(F.instr(lt, cat.lower()) > 0, F.lit(cat))
    return expr.otherwise(F.lit(None).cast("string"))


def is_terminated_status(c) -> Column:
    """Equality definition (E8, F12): trimmed lower status == 'terminated'."""
    return F.coalesce(F.lower(strip_ws(col(c))) == K.TERMINATED_STATUS, F.lit(False))


def mentions_termination(c) -> Column:
    """Containment definition."""
    return F.coalesce(F.lower(col(c)).rlike(K.TERMINATION_PATTERN), F.lit(False))
