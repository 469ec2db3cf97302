"""Session helpers: builder defaults and the shared staging folder."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}  # checkpoint folders of local sessions without the setting

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.driver.memory": "12g",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "staffwise", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a
    local master (tests) gets a folder under the system temp dir; on a cluster,
    whose machines do not share such a folder, that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = _LOCAL.get(spark.sparkContext.applicationId)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver "
                               "and all executors share")
        d = tempfile.mkdtemp(prefix="staffwise-checkpoints-")
        _LOCAL[spark.sparkContext.applicationId] = d
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def compile_in_pieces(spark: SparkSession) -> None:
    """HotSpot leaves methods of more than 8000 bytes of bytecode uncompiled, and
    one method of all the columns of a wide row is longer. Spark then generates
    shorter ones, unless the session names a limit of its own."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":  # Spark's default
        spark.conf.set(key, "8000")


def staging_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster, because the checkpoint folder is the shared one)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = "/".join([base, "staffwise-staging", *parts, uuid.uuid4().hex])
    _STAGED.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


_STAGED: dict[str, set[str]] = {}  # staging folders given out, by application


def release_staged(spark: SparkSession) -> int:
    """Delete every table that this application has staged and not deleted
    itself; returns how many folders were there. For the end of a job: results
    of queries that were not written or collected cannot be read afterwards."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for path in _STAGED.pop(spark.sparkContext.applicationId, ()):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(conf).delete(p, True))
    return n


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of tables written inside are deleted when the table stands,
    not when the driver happens to collect its garbage: a job of many stored
    steps else holds those of all its steps at once. A plan that is written again
    is computed again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # unknown to older versions, which ignore it
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def staging_scope(spark: SparkSession):
    """Tables that ``materialize`` writes inside are deleted at the end. For
    work that leaves nothing lazy behind, such as a micro-batch."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df, tag: str = "table"):
    """Cut lineage by writing ``df`` once as Parquet under the shared
    checkpoint folder and reading it back (one job; survives executor loss,
    unlike a local checkpoint; unlike DataFrame.checkpoint it does not compute
    the plan twice)."""
    spark = df.sparkSession
    path = staging_path(spark, "materialized", tag)
    if _SCOPES:
        _SCOPES[-1].append(path)
    with shuffles_dropped(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df) -> None:
    """Delete a table that ``materialize`` wrote and that no later plan reads."""
    path = getattr(df, "_stored_path", None)
    if path:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
