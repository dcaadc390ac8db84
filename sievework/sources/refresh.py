"""Full refresh of the notice tables: all of them change at once, or nothing does.

A refresh writes its tables to a folder of its own, `versions/<version>/<table>`, and last of all one small
file of Spark's, `marks/<version>`: the snapshot row. Readers take the newest marked version and nothing else, so
a refresh that fails between tables leaves no trace that anyone reads, and one that is repeated finds its mark and
changes nothing. A writer's commit protocol makes each table, and the mark, whole or absent. Versions
are names given by the caller (of the source: its digest or date), compared as strings.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators.policy import VERSION

TABLES = ("records", "authors", "institutions", "identifiers")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def star(notices: DataFrame) -> dict[str, DataFrame]:
    """The tables of a refresh: the notices and their authors, institutions and identifiers, a row each."""
    authors = M.authors_of(notices).select("record_id", "pos", "author_name", "normalized_name", "surname", "initials", "signature")
    return {"records": notices, "authors": authors, "institutions": M.institutions_of(notices), "identifiers": M.identifiers_of(notices)}


def refresh(tables: dict[str, DataFrame], path: str, version: str, meta: dict[str, str] | None = None) -> bool:
    """Load all tables as one version; False where that version is there already. meta: more of the snapshot row."""
    if not version or set(version) - set("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ._-") or version.startswith((".", "_")):
        raise ValueError(f"version {version!r}: letters, digits, dots, dashes and underscores, and no dot or underscore first")
    spark = next(iter(tables.values())).sparkSession
    mark = f"{path}/marks/{version}"
    if _exists(spark, f"{mark}/_SUCCESS"):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/versions/{version}/{name}")
    counted = None
    for name in tables:
        one = spark.read.parquet(f"{path}/versions/{version}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counted = one if counted is None else counted.unionByName(one)
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("row_counts")
    more = [F.lit(v).alias(k) for k, v in (meta or {}).items()]
    counted.agg(counts).select(F.lit(version).alias("version"), F.lit(VERSION).alias("policy_version"), "row_counts", *more).coalesce(1).write.mode("overwrite").parquet(mark)
    return True


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot rows of all versions that were loaded whole: version, policy_version, row_counts and more."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(f"{path}/marks/*")
    except AnalysisException as error:
        raise FileNotFoundError(f"no snapshot has been loaded at {path}: refresh it first (sources.refresh.refresh)") from error


def newest(spark: SparkSession, path: str) -> str:
    """The newest version that was loaded whole."""
    return snapshots(spark, path).agg(F.max("version").alias("version")).first()["version"]


def read(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a version, by default the newest; a version without its mark is not read."""
    found = newest(spark, path) if version is None else version
    if not _exists(spark, f"{path}/marks/{found}/_SUCCESS"):
        raise FileNotFoundError(f"version {found} has not been loaded whole at {path}")
    return spark.read.parquet(f"{path}/versions/{found}/{name}")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete loaded versions but for the newest `keep`; the mark goes first, so no reader finds half a version."""
    old = [r["version"] for r in snapshots(spark, path).select("version").orderBy(F.col("version").desc()).offset(keep).collect()]
    for version in old:
        _delete(spark, f"{path}/marks/{version}")
        _delete(spark, f"{path}/versions/{version}")
    return old
