"""Similar names: candidate pairs by a multiset prefix filter, and the
Ratcliff-Obershelp ratio as a column expression (C5, C6).

A name is the multiset of its characters, written as a set of tokens
(character, occurrence). Two names can only reach a similarity if they share a
number of tokens that their lengths fix, so with tokens in one order, rarest
first, two such names share a token among their first few. Only these are
joined, by equality of kind, both lengths and the token; lengths that no
partner has are never tried. Pairs that meet are thinned by their edit
distance, which the ratio bounds, before the ratio is computed. No step drops a
pair that reaches the cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# texts of this length and more do not start a block on a character that makes
# up over a hundredth of them (fixed values of the standard library's measure)
LONG, POPULAR = 200, 100


# ------------------------------------------------- Ratcliff-Obershelp ratio
#
# Written as SQL text: as Column calls the nested lambdas take seconds to build.

def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _row(**fields) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _longest_block(a: str, b: str) -> str:
    """(at, n): where in ``a`` the longest text that both have starts first, and
    its length. One walk over ``a``: the block found grows while it can, then
    its start moves on, so that only longer ones are tried."""
    return f"""aggregate(sequence(1, 2 * length({a})), {_row(i=0, n=0, at=0)}, (w, _) -> CASE
        WHEN w.i + w.n >= length({a}) THEN w
        WHEN contains({b}, substring({a}, w.i + 1, w.n + 1)) THEN {_row(i="w.i", n="w.n + 1", at="w.i")}
        ELSE {_row(i="w.i + 1", n="w.n", at="w.at")} END)"""


def _same_start(a: str, b: str) -> str:
    """Number of characters that two texts have in common from their start."""
    count = """aggregate(sequence(1, greatest(least(length(p.a), length(p.b)), 1)), 0, (n, i) -> IF(
        n = i - 1 AND substring(p.a, i, 1) <> '' AND substring(p.a, i, 1) = substring(p.b, i, 1), i, n))"""
    return _let(_row(a=a, b=b), "p", count)


def _plain_block() -> str:
    return _let(_longest_block("t.a", "t.b"), "m", _row(
        i="m.at", j="position(substring(t.a, m.at + 1, m.n), t.b) - 1", n="m.n"))


def _popular_block() -> str:
    """As ``_plain_block``, but a block starts from characters that are not
    popular (x and y have others in their place) and then spreads over all."""
    start = _let(_longest_block("t.x", "t.y"), "l", _row(
        i="IF(l.n > 0, l.at, 0)", j="IF(l.n > 0, position(substring(t.x, l.at + 1, l.n), t.y) - 1, 0)", n="l.n"))
    back = _same_start("reverse(substring(t.a, 1, m.i))", "reverse(substring(t.b, 1, m.j))")
    on = _same_start("substring(t.a, m.i + m.n + 1, length(t.a))", "substring(t.b, m.j + m.n + 1, length(t.b))")
    return _let(start, "m", _let(f"IF(m.n > 0, {back}, 0)", "k",
                                 _row(i="m.i - k", j="m.j - k", n=f"m.n + k + {on}")))


def _matched(whole: str, block: str) -> str:
    """Characters in the blocks of two texts: the longest block, then the same
    left and right of it. ``whole`` is a struct of texts of which a and b count
    (x, y: the texts in which blocks start); ``block`` gives (i, j, n) of such a
    struct t. Texts still to be compared wait in an array, so there is no
    recursion."""
    sides = {"a": "i", "b": "j", "x": "i", "y": "j"}
    left = _row(**{k: f"substring(t.{k}, 1, f.{p})" for k, p in sides.items()})
    right = _row(**{k: f"substring(t.{k}, f.{p} + f.n + 1, length(t.{k}))" for k, p in sides.items()})
    rest = "slice(s.todo, 1, size(s.todo) - 1)"
    step = _let("element_at(s.todo, -1)", "t", _let(block, "f", f"""CASE
        WHEN f.n = 0 THEN {_row(todo=rest, n="s.n")}
        ELSE {_row(todo=f"concat({rest}, filter(array({left}, {right}), e -> e.a <> '' AND e.b <> ''))", n="s.n + f.n")}
        END"""))
    return _let(whole, "whole", f"""aggregate(sequence(1, 2 * least(length(whole.a), length(whole.b)) + 1),
        {_row(todo="array(whole)", n=0)}, (s, _) -> IF(size(s.todo) = 0, s, {step}), s -> s.n)""")


def ratcliff_ratio(a: str, b: str) -> Column:
    """Ratcliff-Obershelp similarity of two text columns, 2 * matched / both
    lengths, as the standard library's ``SequenceMatcher(None, a, b).ratio()``
    gives it, in the JVM. Not symmetric: of equally long blocks the first in
    ``a`` counts, and popular characters are those of ``b``. Two empty texts are
    equal; null gives null. U+0001 and U+0002 match nothing in texts of LONG
    characters."""
    a, b = f"`{a}`", f"`{b}`"
    often = f"""concat(array_join(filter(array_distinct(split({b}, '')), c ->
        length({b}) - length(replace({b}, c, '')) > floor(length({b}) / {POPULAR}) + 1), ''), '\\u0001\\u0002')"""
    masked = {k: f"translate({text}, o, repeat('\\u000{n}', length(o)))" for k, text, n in (("x", a, 1), ("y", b, 2))}
    long = _let(often, "o", _row(a=a, b=b, **masked))
    return F.expr(f"""CASE WHEN length({a}) + length({b}) = 0 THEN 1D WHEN length({a}) = 0 OR length({b}) = 0 THEN 0D
        ELSE 2D * CASE WHEN length({b}) < {LONG} THEN {_matched(_row(a=a, b=b, x="''", y="''"), _plain_block())}
                       ELSE {_matched(long, _popular_block())} END / (length({a}) + length({b})) END""")


def levenshtein_score(a, b) -> Column:
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


# --------------------------------------------------------- candidate pairs

def _shared_at_least(mode: str, cutoff: float) -> str:
    """Least number of common characters of texts of lengths la and lb that
    reach the cutoff: 2 m >= cutoff * (la + lb), or no more than (1 - cutoff) *
    max edits, each of which leaves one character of the longer text unmatched."""
    need = f"{cutoff}D * (la + lb) / 2" if mode == "ratcliff" else f"{cutoff}D * greatest(la, lb)"
    return f"greatest(int(ceil({need} - 1e-9D)), 1)"


def _partner_lengths(cutoff: float, mode: str) -> str:
    """Every length of a partner of a text of length n that can reach the cutoff."""
    part = cutoff / (2 - cutoff) if mode == "ratcliff" else cutoff
    return f"sequence(greatest(int(ceil(n * {part}D - 1e-9D)), 1), int(floor(n / {part}D + 1e-9D)))"


def _tokens(text: str) -> str:
    """The characters of a text, each with the number of its occurrence."""
    return _let(f"array_sort(split({text}, ''))", "s",
                "transform(s, (c, i) -> concat(c, i - array_position(s, c) + 1))")


def _bags(texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` (kind, text, ...) that are not empty, with n, the
    length, and bag, the text's tokens, rarest of the kind first."""
    each = texts.filter("text <> ''").select("*", F.explode(F.expr(_tokens("text"))).alias("token"))
    often = each.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("often"))
    return (each.join(often, ["kind", "token"]).groupBy(*texts.columns)
            .agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("bag"))
            .select(*texts.columns, F.length("text").alias("n"), F.col("bag.token").alias("bag")))


def candidates(left: DataFrame, right: DataFrame, mode: str, cutoff: float, ordered: bool = False) -> DataFrame:
    """(kind, x, y): all pairs of a value of ``left`` (kind, x) and one of
    ``right`` (kind, y) that share a token among the first of both, each once;
    with ``ordered`` only those with x < y. The pairs are stored: a filter by
    an expensive measure would else be pushed into the join, where a pair
    stands once for each token.

    Two texts that must share ``need`` tokens have one in common among the
    first n - need + 1 of each. At the first one that they share, no more than
    what is left behind it can follow; rows that cannot reach ``need`` go."""
    from ..session import materialize
    texts = (left.select("kind", F.col("x").alias("text"), F.lit(True).alias("is_x"), F.lit(False).alias("is_y"))
             .union(right.select("kind", F.col("y"), F.lit(False), F.lit(True)))
             .groupBy("kind", "text").agg(F.max("is_x").alias("is_x"), F.max("is_y").alias("is_y")))
    bags = materialize(_bags(texts), "bags")
    need = _shared_at_least(mode, cutoff)

    def first(side, other, own, partner, name, place):
        """Own first tokens for each partner length that occurs."""
        occurs = bags.filter(other).select("kind", F.col("n").alias(partner)).distinct()
        return (bags.filter(side).select("kind", "text", "bag", F.col("n").alias(own),
                                         F.explode(F.expr(_partner_lengths(cutoff, mode))).alias(partner))
                .join(occurs, ["kind", partner]).withColumn("need", F.expr(need)).filter("need <= least(la, lb)")
                .select("kind", "la", "lb", F.col("text").alias(name),
                        F.posexplode(F.expr(f"slice(bag, 1, {own} - need + 1)")).alias(place, "token")))

    met = first("is_x", "is_y", "la", "lb", "x", "p").join(first("is_y", "is_x", "lb", "la", "y", "q"),
                                                          ["kind", "la", "lb", "token"])
    reach = met.filter(F.expr(f"least(la - p, lb - q) >= {need}"))
    if ordered:
        reach = reach.filter("x < y")
    return materialize(reach.select("kind", "x", "y").distinct(), "name-pairs")


def near(pairs: DataFrame, mode: str, cutoff: float) -> DataFrame:
    """Pairs that cheaper bounds leave: what lies between the matched characters
    is at most la + lb - 2 m edits, and m at most the tokens that both have."""
    la, lb = F.length("x"), F.length("y")
    if mode != "ratcliff":
        return pairs.filter(F.levenshtein("x", "y") <= (1 - cutoff) * F.greatest(la, lb) + 1e-9)
    common = F.size(F.expr(f"array_intersect({_tokens('x')}, {_tokens('y')})"))
    return (pairs.filter(F.levenshtein("x", "y") <= (1 - cutoff) * (la + lb) + 1e-9)
            .filter(2 * common >= cutoff * (la + lb) - 1e-9))
