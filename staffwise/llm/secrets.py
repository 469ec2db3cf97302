"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Candidates are found by pattern. Matches and the gaps between them come from
one pattern each (extract and split), so their places are running sums of
lengths in code points. The hash of every candidate value is then counted
over the whole corpus by distinct owner and distinct repository: a value seen
at ``example_owners`` owners or more, or in ``example_repositories``
repositories or more, is a widely copied example; one seen at a single owner
and in a single repository is owner-specific and live-looking; others are
shared. Spans of generic tokens (20 or more characters with digits and letters
of both cases) that no base pattern covers are added when their value is
live-looking.

Shuffles hold candidates only, never texts. A value that many rows carry is
one group of an aggregate with map-side combination, and one key of a join
that adaptive execution splits.

Defined results: a null text counts as empty; null owners and repositories
count as one owner and repository each; repeated rows are scanned once each
and get a result each; an empty table gives an empty result; other columns are
ignored, and ``redact`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_key

# fixed values: the base patterns, in the order in which kinds are listed
ASSIGN = (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run of such characters is matched whole
GENERIC = r"[A-Za-z0-9_-]{20,}"
KINDS = ["assign", "access", "hex", "owned"]
LEAST = {"assign": 12, "access": 18, "hex": 16}

EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 4


def found_by(kind: int, pattern: str) -> Column:
    """array<struct<kind, i, gap, len, value>> of a pattern's matches in ``text``."""
    text = F.col("text")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = (lambda m: F.regexp_extract(m, ASSIGN, 1)) if kind == 0 else (lambda m: m)
    pairs = F.transform(
        F.arrays_zip(hits.alias("m"), F.slice(gaps, 1, F.size(gaps) - 1).alias("g")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"),
                              F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("len"),
                              value(x["m"]).alias("value")))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,value:string>>")
    return F.when(text.rlike(pattern), pairs).otherwise(none)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document: _row, doc_id, key, owner, repository, found."""
    base = docs.select(F.col("doc_id"), owner.alias("owner"), repository.alias("repository"),
                       F.coalesce("text", F.lit("")).alias("text"))
    return base.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", text_key().alias("key"),
        F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col("repository").cast("string"), F.lit("")).alias("repository"),
        F.concat(*[found_by(k, p) for k, p in enumerate([ASSIGN, ACCESS, HEX, GENERIC])]).alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """Candidates with start and end in code points; failing matches dropped."""
    order = Window.partitionBy("_row", "kind").orderBy("i")
    rows = (found.select("_row", "key", "owner", "repository", F.explode("found").alias("f"))
            .select("_row", "key", "owner", "repository", "f.*")
            .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order))
            .withColumn("start", F.col("end") - F.col("len")))
    v = F.col("value")
    passes = (F.when(F.col("kind") == 0, F.length(v) >= LEAST["assign"])
              .when(F.col("kind") == 1, F.length(v) >= LEAST["access"])
              .when(F.col("kind") == 2, F.length(v) >= LEAST["hex"])
              .otherwise(v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")))
    return rows.filter(passes).select("_row", "key", "owner", "repository", "kind", "start", "end", "value",
                                      F.md5("value").alias("hash"))


def ownership(spans: DataFrame, example_owners: int, example_repositories: int) -> DataFrame:
    """Per value hash: distinct owners and repositories, and the verdict."""
    counted = spans.groupBy("hash").agg(F.countDistinct("owner").alias("n_owners"),
                                        F.countDistinct("repository").alias("n_repositories"))
    return counted.withColumn(
        "verdict", F.when((F.col("n_owners") >= example_owners)
                          | (F.col("n_repositories") >= example_repositories), "example")
        .when((F.col("n_owners") == 1) & (F.col("n_repositories") == 1), "live").otherwise("shared"))


def scan(docs: DataFrame, owner: Column, repository: Column, example_owners: int = EXAMPLE_OWNERS,
         example_repositories: int = EXAMPLE_REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). Documents: _row, doc_id. Spans: _row, kind (a
    number into KINDS), start, end, value, n_owners, n_repositories, verdict;
    both from one staged scan of the texts, so row numbers agree."""
    found = staged(candidates(docs, owner, repository), "secrets")
    return found.select("_row", "doc_id"), spans_of(found, example_owners, example_repositories)


def spans_of(found: DataFrame, example_owners: int, example_repositories: int) -> DataFrame:
    spans = placed(found)
    judged = spans.join(ownership(spans, example_owners, example_repositories), "hash").drop("hash", "owner", "repository")
    by_start = Window.partitionBy("_row").orderBy("start", "kind")
    base = F.col("kind") < 3
    touched = (F.coalesce(F.max(F.when(base, F.col("end"))).over(
                   by_start.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False))
               | F.coalesce(F.min(F.when(base, F.col("start"))).over(
                   by_start.rowsBetween(1, Window.unboundedFollowing)) < F.col("end"), F.lit(False)))
    return (judged.withColumn("_touched", touched)
            .filter(base | (~F.col("_touched") & (F.col("verdict") == "live"))).drop("_touched"))


def listed(items: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(items), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def summary(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document: counts by kind, base spans' digest, all spans, how many
    values are live-looking or widely copied, and the most owners and
    repositories that one of its values has."""
    item = F.struct("start", "kind", "end")
    n = lambda c: F.count(F.when(c, 1))
    kind = F.col("kind")
    per_row = spans.groupBy("_row").agg(
        n(kind == 0).alias("n_assign"), n(kind == 1).alias("n_access"), n(kind == 2).alias("n_hex"),
        n(kind == 3).alias("n_owned"), n(F.col("verdict") == "live").alias("n_live"),
        n(F.col("verdict") == "example").alias("n_example"),
        F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
        F.collect_list(F.when(kind < 3, item)).alias("_base"), F.collect_list(item).alias("_all"))
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    counts = ["n_assign", "n_access", "n_hex", "n_owned", "n_live", "n_example",
              "most_owners", "most_repositories"]
    return documents.join(per_row, "_row", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.sha2(listed(F.coalesce("_base", none)).cast("binary"), 256).alias("base_sha256"),
        listed(F.coalesce("_all", none)).alias("spans"))


def redact(docs: DataFrame, owner: Column, repository: Column, example_owners: int = EXAMPLE_OWNERS,
           example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """``docs`` with every span replaced by ``[secret]`` or, for a widely
    copied example, ``[example]``; overlapping spans become one mark. Columns
    and rows are those of ``docs``; n_chars, if there, follows the new text."""
    # what is found depends on the text alone, so spans are joined by its key
    found = staged(candidates(docs, owner, repository), "redact")
    spans = spans_of(found, example_owners, example_repositories).dropDuplicates(["key", "kind", "start", "end"])
    order = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (spans.withColumn("_new", F.coalesce((before <= F.col("start")).cast("int"), F.lit(1)))
              .withColumn("_cluster", F.sum("_new").over(order))
              .groupBy("key", "_cluster").agg(
                  F.min("start").alias("start"), F.max("end").alias("end"),
                  F.min(F.col("verdict") == "example").alias("example"))
              .withColumn("past", F.coalesce(F.lag("end").over(Window.partitionBy("key").orderBy("start")),
                                             F.lit(0))))
    marks = merged.groupBy("key").agg(F.array_sort(F.collect_list(
        F.struct("start", "end", "past", "example"))).alias("marks"))

    def cut(chars: Column) -> Column:
        """What stands before each mark, the mark, and what follows the last;
        slices of the text's characters, each taken once."""
        def part(begin, end):
            return F.array_join(F.slice(chars, (begin + 1).cast("int"), (end - begin).cast("int")), "")
        return F.concat(
            F.array_join(F.transform("marks", lambda m: F.concat(
                part(m["past"], m["start"]), F.when(m["example"], "[example]").otherwise("[secret]"))), ""),
            part(F.element_at("marks", -1)["end"], F.size(chars).cast("long")))

    # the documents' columns stay in a struct, apart from the names used here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_key().alias("key"))
    text = F.col("row")["text"]
    rebuilt = F.transform(F.array(F.split(text, "", -1)), cut)[0]
    marked = (rows.join(marks, "key", "left")
              .select("row", F.when(F.col("marks").isNull(), text).otherwise(rebuilt).alias("text"),
                      F.col("marks").isNotNull().alias("changed")))

    def column(c):
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.when(F.col("changed"), F.char_length("text").cast(docs.schema[c].dataType)) \
                .otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return marked.select(*map(column, docs.columns))
