"""Entity normalization against the canonical-name registry.

Works on the *distinct* raw values of each kind (project / department /
position), never on rows: cost is |distinct values| x |candidates|, and the
mapping is joined back to the rows afterwards.

All candidate generation is by equi-join, never a Cartesian product:

* exact (C2)   join on lower-case text;
* alias (C3)   join on the fixed alias table;
* prefix (C4)  the registry is exploded to its lower-case prefixes of length
               >= 4 and joined on the value;
* fuzzy (C5)   multiset prefix filter (``similarity.candidates``): names that
               share one of their rarest characters, then an edit-distance
               bound; only what is left is scored;
* cluster (C6) unmatched values are paired with each other in the same way,
               verified, and merged by star contraction (``components``).

Join strategies are left to adaptive execution, which goes by measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import clean_name
from .components import components
from .similarity import candidates, levenshtein_score, near, ratcliff_ratio

DEFAULT_MODE = "ratcliff"  # the specified measure; "levenshtein" is the other one
KINDS = {"Project": "projects", "Department": "departments", "Position": "positions"}


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.ALIASES, "alias_key string, alias_canonical string")


def normalize_values(values: DataFrame, registry: DataFrame, mode: str = DEFAULT_MODE,
                     cutoff: float = K.FUZZY_CUTOFF, cluster: bool = False) -> DataFrame:
    """C1-C5, C7 (and C6 when ``cluster``) on distinct (kind, value).

    Returns (kind, value, cleaned, canonical, step, score); step is one of
    exact, alias, prefix, fuzzy, cluster, none (canonical = cleaned).
    """
    spark = values.sparkSession
    reg = registry.select("kind", "ordinal", "canonical").withColumn("lc", F.lower("canonical"))
    from ..session import materialize
    # distinct values feed every step below: computed once, written once
    v = materialize(values.select("kind", "value").distinct()
                    .withColumn("cleaned", clean_name("value")), "norm-values")
    c = v.select("kind", "cleaned").distinct().withColumn("lv", F.lower("cleaned"))

    exact = (c.join(reg.withColumnRenamed("lc", "lv"), ["kind", "lv"])
              .groupBy("kind", "cleaned").agg(F.min_by("canonical", "ordinal").alias("exact")))
    alias = (c.join(F.broadcast(alias_table(spark)), F.col("lv") == F.col("alias_key"))
              .select("kind", "cleaned", F.col("alias_canonical").alias("alias")))
    prefixes = (reg.where(F.length("lc") >= K.PREFIX_MIN_LEN)
                .select("kind", "ordinal", "canonical", "lc",
                        F.explode(F.sequence(F.lit(K.PREFIX_MIN_LEN), F.length("lc"))).alias("n"))
                .select("kind", "ordinal", "canonical", F.expr("substring(lc, 1, n)").alias("lv")))
    prefix = (c.where(F.length("lv") >= K.PREFIX_MIN_LEN)
               .join(prefixes, ["kind", "lv"])
               .groupBy("kind", "cleaned").agg(F.min_by("canonical", "ordinal").alias("prefix")))

    early = exact.join(alias, ["kind", "cleaned"], "full").join(prefix, ["kind", "cleaned"], "full")
    rest = c.join(early.select("kind", "cleaned"), ["kind", "cleaned"], "left_anti")
    cand = near(candidates(rest.select("kind", F.col("cleaned").alias("x")),
                           reg.select("kind", F.col("canonical").alias("y")), mode, cutoff), mode, cutoff)
    score = ratcliff_ratio("y", "x") if mode == "ratcliff" else levenshtein_score("x", "y")
    cand = cand.select("kind", F.col("x").alias("cleaned"), F.col("y").alias("canonical"), score.alias("score"))
    fuzzy = (cand.where(F.col("score") >= cutoff)
                 .groupBy("kind", "cleaned")
                 .agg(F.max_by(F.struct("canonical", "score"),
                               F.struct("score", "canonical")).alias("f"))
                 .select("kind", "cleaned", F.col("f.canonical").alias("fuzzy"),
                         F.col("f.score").alias("score")))

    m = c.join(early, ["kind", "cleaned"], "left").join(fuzzy, ["kind", "cleaned"], "left")
    if cluster:
        unmatched = m.where(F.coalesce("exact", "alias", "prefix", "fuzzy").isNull()) \
                     .select("kind", "cleaned")
        cl = cluster_values(unmatched, mode=mode, cutoff=cutoff)
        m = m.join(cl, ["kind", "cleaned"], "left")
    else:
        m = m.withColumn("cluster", F.lit(None).cast("string"))
    step = (F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias")
             .when(F.col("prefix").isNotNull(), "prefix").when(F.col("fuzzy").isNotNull(), "fuzzy")
             .when(F.col("cluster").isNotNull() & (F.col("cluster") != F.col("cleaned")), "cluster")
             .otherwise("none"))
    canon = F.coalesce("exact", "alias", "prefix", "fuzzy", "cluster", "cleaned")
    mapping = m.select("kind", "cleaned", canon.alias("canonical"), step.alias("step"),
                       F.when(step == "fuzzy", F.col("score")).alias("score"))
    return v.join(mapping, ["kind", "cleaned"]).select("kind", "value", "cleaned", "canonical",
                                                        "step", "score")


# ------------------------------------------------------------------ C6

def similar_pairs(values: DataFrame, mode: str = DEFAULT_MODE,
                  cutoff: float = K.FUZZY_CUTOFF) -> DataFrame:
    """Verified pairs (kind, a, b), a < b, with similarity >= cutoff.

    Candidates come as in C5, of values against values, so no pair is missed in
    either mode. Ratcliff-Obershelp depends on the order of its arguments; a
    pair counts if either order reaches the cutoff."""
    vals = values.select("kind", F.col("cleaned").alias("x")).distinct()
    pairs = near(candidates(vals, vals.withColumnRenamed("x", "y"), mode, cutoff, ordered=True), mode, cutoff)
    score = (F.greatest(ratcliff_ratio("x", "y"), ratcliff_ratio("y", "x")) if mode == "ratcliff"
             else levenshtein_score("x", "y"))
    return pairs.where(score >= cutoff).select("kind", F.col("x").alias("a"), F.col("y").alias("b"))


def cluster_values(values: DataFrame, mode: str = DEFAULT_MODE, cutoff: float = K.FUZZY_CUTOFF) -> DataFrame:
    """Connected components of similar unmatched values; canonical =
    longest member (ties: smallest text). Returns (kind, cleaned, cluster)."""
    from ..session import materialize
    vals = materialize(values.select("kind", "cleaned").distinct(), "cluster-values")
    edges = materialize(similar_pairs(vals, mode, cutoff), "cluster-edges")
    found = components(edges, ("kind",)).withColumnRenamed("node", "cleaned")
    labels = materialize(vals.join(found, ["kind", "cleaned"], "left").select(
        "kind", "cleaned", F.coalesce("component", "cleaned").alias("label")), "cluster-labels")
    best = labels.groupBy("kind", "label").agg(
        F.min_by("cleaned", F.struct((-F.length("cleaned")).alias("l"),
                                     F.col("cleaned").alias("c"))).alias("cluster"))
    return labels.join(best, ["kind", "label"]).select("kind", "cleaned", "cluster")


def apply_mapping(rows: DataFrame, mapping: DataFrame, columns: dict) -> DataFrame:
    """Replace each listed column by its canonical name; keeps the
    original in ``<col>_original``. ``columns`` maps column -> kind."""
    out = rows
    for colname, kind in columns.items():
        m = (mapping.where(F.col("kind") == kind)
                    .select(F.col("value").alias(colname), F.col("canonical").alias("_canon")))
        out = (out.join(m, colname, "left")
                  .withColumn(colname + "_original", F.col(colname))
                  .withColumn(colname, F.coalesce("_canon", F.col(colname))).drop("_canon"))
    return out
