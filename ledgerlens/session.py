"""Session helpers.

The library never creates a global session of its own inside operators; these
helpers are for entry points, tests and the benchmark.  Settings are chosen
for a large cluster (AQE, skew-join splitting, partition coalescing) and stay
correct on ``local[N]``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of this library relies on.  ANSI mode stays on (Spark 4
# default): the operators use ``try_*`` functions wherever a value may be bad.
BASE_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # many small report files per run: pack them into fewer read tasks
    "spark.sql.files.openCostInBytes": str(4 * 1024 * 1024),
}


def build_session(
    master: str | None = None,
    app_name: str = "ledgerlens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library's base settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only local runs (tests, benchmark) without that setting get a fresh
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


_TABLES = "ledgerlens-tables"
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name: str):
    """Write ``df`` once as a parquet table under the session's checkpoint
    folder (shared storage on a cluster) and return it read back.

    This cuts lineage like ``checkpoint()`` but computes the plan only once
    (``Dataset.checkpoint`` runs it again to write the files) and the result
    keeps column pruning and filter pushdown.
    """
    return _stored([df], name)


def materialize_compact(frames: list, name: str):
    """One table of ``frames`` (of one schema), for what is as large as the input:
    they are written one after another with the smaller codec, and what each
    shuffled is removed as soon as it is written, not when the driver happens to
    collect its garbage."""
    conf = frames[0].sparkSession.conf
    old = conf.get(_CLEAN_SHUFFLES, None)
    conf.set(_CLEAN_SHUFFLES, "true")
    try:
        return _stored(frames, name, compression="zstd")
    finally:
        conf.set(_CLEAN_SHUFFLES, old) if old is not None else conf.unset(_CLEAN_SHUFFLES)


def _stored(frames: list, name: str, **options):
    import uuid

    spark = frames[0].sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{_TABLES}/{name}-{uuid.uuid4().hex}"
    paths = [path] if len(frames) == 1 else [f"{path}/{i}" for i in range(len(frames))]
    for df, p in zip(frames, paths):
        df.write.mode("overwrite").options(**options).parquet(p)
    return spark.read.parquet(*paths)


def discard(df) -> None:
    """Remove the tables of ``materialize`` that ``df`` reads: for steps whose
    result is stored itself, so that nothing reads them again."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = [f.split(f"/{_TABLES}/", 1) for f in df.inputFiles() if f"/{_TABLES}/" in f]
    for root in {f"{base}/{_TABLES}/{rest.split('/', 1)[0]}" for base, rest in parts}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(root))
        path.getFileSystem(conf).delete(path, True)
