"""Session defaults and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20
LARGE_ROWS = {
    "parquet.block.size": str(16 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}

_LOCAL: dict[str, str] = {}  # folder per application, for local masters without a setting
_MADE: dict[str, list[str]] = {}  # what each application has written and not yet removed


def build_session(app: str = "kinfold", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use its own session.

    Small files are cut into one split per core by the scan itself, so that text
    work on them is parallel without a shuffle.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.openCostInBytes", "131072")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by `spark.checkpoint.dir`.

    Where the setting is absent a temporary folder is made, but only for a
    local master: a driver-local folder is useless to remote executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="kinfold-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; `release` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write `df` once and read it back: short lineage, prunable columns, and
    nothing to recompute when an executor is lost. With `large_rows`, of megabytes each,
    Parquet looks at what it has buffered after each row, not after a hundred."""
    spark = df.sparkSession
    path = new_path(spark, name)
    options = LARGE_ROWS if large_rows else {}
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that nobody reads any more removed: Spark does so when the
    driver's JVM finds them unused, which with few objects it may not for hours."""
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Lower the bytes of an Arrow batch to BATCH_BYTES for this session. A task holds a batch
    several times over, in the JVM and in Python; results do not depend on its size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def intermediates(spark: SparkSession) -> list[str]:
    """Paths made by `new_path` that are not yet removed."""
    return list(_MADE.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove intermediates that nobody reads any more: those given, or all
    that this application has made through `new_path`."""
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    for path in list(made if paths is None else paths):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in made:
            made.remove(path)
