"""JSON Lines and CSV in and out."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MESSAGE_SCHEMA
from ..operators.dedup import SOURCE_STRIDE


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        found = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    except Py4JJavaError as e:
        raise AnalysisException(f"cannot look up {path}: {e}") from e
    return found is not None and len(found) > 0


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType = MESSAGE_SCHEMA, optional: bool = False
) -> DataFrame:
    """Fixed schema, blank lines skipped, a malformed line fails the job.

    An absent path is an error, or an empty table when `optional`.
    """
    if optional and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


LINES, FILES = 1 << 36, 1 << 20  # room in `ord` for the lines of a file and the files of a source


def read_sources(spark: SparkSession, paths: list[str], schema: T.StructType | str = MESSAGE_SCHEMA) -> DataFrame:
    """JSONL sources in order, with `ord`: source, then file by name, then line.

    The number of a line is that of the lines in earlier blocks of its file plus
    its place in its own block; a block is a split of the scan, so the table of
    blocks is small and no task numbers a whole file. Numbers do not depend on
    how the file is split. Blank lines count but give no row; a malformed line
    fails the job.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    schema = T.StructType([f for f in schema if f.name != "ord"])
    out = None
    for rank, path in enumerate(paths):
        lines = spark.read.text(path).select(
            "value",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
        blocks = lines.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
        earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
        # One row per file.
        files = blocks.select("_file").distinct()
        files = files.withColumn("_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_file")) - 1)
        placed = lines.join(blocks.drop("_lines"), ["_file", "_block"]).join(files, "_file")
        line = F.col("_before") + F.col("_row") - F.col("_first")
        full = F.raise_error(F.lit(f"more than {LINES} lines or {FILES} files")).cast("bigint")
        ord = F.when((line < LINES) & (F.col("_no") < FILES), F.lit(rank * SOURCE_STRIDE) + F.col("_no") * LINES + line)
        parsed = placed.filter(F.trim("value") != "").select(
            F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_m"), ord.otherwise(full).alias("ord")
        )
        rows = parsed.select("_m.*", "ord")
        out = rows if out is None else out.unionByName(rows)
    return out


def write_jsonl(df: DataFrame, path: str, append: bool = False, keep_nulls: bool = False) -> None:
    """One object per line, text as it is; null fields are left out by default."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(
        path
    )


# Every value is quoted: message text holds line ends, quotes and commas.
_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV, quoteAll="true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV, multiLine="true", mode="FAILFAST").csv(path)
