"""Versioned tables, run artifacts, the edit basket and jobs, through Hadoop file systems."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.config import BalanceError

STRICT_VERSION, LOOSE_VERSION = r"_v(\d+)\.(\d+)\.xlsx$", r"_v\d+(\.\d+)?[A-Za-z0-9_-]*\.xlsx$"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Sets a folder for checkpoints only where the cluster names none, as in tests."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="kelvane-"))


def bump_name(name: str, version: str | None = None, *, stamp: str = "") -> str:
    """The next file name: an explicit version replaces any version suffix, else the minor number grows; without a number the stamp is added."""
    if version:
        loose = re.search(LOOSE_VERSION, name, re.IGNORECASE)
        return f"{name[: loose.start()]}_v{version}.xlsx" if loose else name.replace(".xlsx", f"_v{version}.xlsx")
    if found := re.search(STRICT_VERSION, name, re.IGNORECASE):
        return f"{name[: found.start()]}_v{found[1]}.{int(found[2]) + 1}.xlsx"
    return name.replace(".xlsx", f"_enriched_{stamp}.xlsx")


def bumped(name, version: str | None = None, stamp: str = ""):
    """``bump_name`` as a column expression."""
    if version:
        loose = F.regexp_replace(name, f"(?i){LOOSE_VERSION}", f"_v{version}.xlsx")
        return F.when(name.rlike(f"(?i){LOOSE_VERSION}"), loose).otherwise(F.replace(name, F.lit(".xlsx"), F.lit(f"_v{version}.xlsx")))
    minor = F.regexp_extract(name, f"(?i){STRICT_VERSION}", 2).try_cast("int") + 1
    prefix = F.regexp_replace(name, r"(?i)(_v\d+\.)\d+\.xlsx$", "$1")
    return F.when(name.rlike(f"(?i){STRICT_VERSION}"), F.concat(prefix, minor.cast("string"), F.lit(".xlsx"))).otherwise(F.replace(name, F.lit(".xlsx"), F.lit(f"_enriched_{stamp}.xlsx")))


def latest_name(names: DataFrame, path: str = "path", priority: str = "priority") -> DataFrame:
    """One row: the path of the highest (major, minor); of equal ones that of the smallest priority."""
    at = lambda i: F.regexp_extract(F.col(path), f"(?i){STRICT_VERSION}", i).try_cast("int")
    return names.where(F.col(path).rlike(f"(?i){STRICT_VERSION}")).agg(F.max_by(path, F.struct(at(1), at(2), -F.col(priority))).alias("path"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class VersionStore:
    """Immutable versions of a table as Parquet under ``root/v=<major>.<minor>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[tuple[int, int]]:
        fs, p = _fs(self.spark, self.root)
        if not fs.exists(p):
            return []
        found = (re.fullmatch(r"v=(\d+)\.(\d+)", s.getPath().getName()) for s in fs.listStatus(p))
        return sorted((int(m[1]), int(m[2])) for m in found if m)

    def latest(self) -> str | None:
        have = self.versions()
        return "{}.{}".format(*have[-1]) if have else None

    def next_version(self) -> str:
        have = self.versions()
        return f"{have[-1][0]}.{have[-1][1] + 1}" if have else "1.0"

    def path(self, version: str) -> str:
        return f"{self.root}/v={version}"

    def read(self, version: str | None = None) -> DataFrame:
        version = version or self.latest()
        if version is None:
            raise FileNotFoundError(f"no version under {self.root}")
        return self.spark.read.parquet(self.path(version))

    def write(self, df: DataFrame, version: str | None = None, *, expected: int | None = None) -> str:
        """Writes a new version and never replaces one. With ``expected`` the written rows are counted; BalanceError if they are not as many."""
        version = version or self.next_version()
        df.write.mode("errorifexists").parquet(self.path(version))
        if expected is not None and (n := self.read(version).count()) != expected:
            raise BalanceError(f"{n} rows instead of {expected} in version {version}")
        return version


def write_csv(df: DataFrame, path: str) -> bool:
    """One CSV file with columns by name, if there are rows."""
    if df.isEmpty():
        return False
    df.select(*sorted(df.columns)).coalesce(1).write.mode("errorifexists").option("header", True).option("encoding", "UTF-8").csv(path)
    return True


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def save_basket(basket: DataFrame, path: str, version: str) -> None:
    """Replaces the staged edits; the version they were made on is a column."""
    basket.withColumn("version", F.lit(version)).select("version", "row_idx", "field", "new_value").coalesce(1).write.mode("overwrite").json(path)


def load_basket(spark: SparkSession, path: str) -> DataFrame:
    """(version, row_idx, field, new_value); empty if nothing is staged."""
    fs, p = _fs(spark, path)
    schema = "version string, row_idx long, field string, new_value string"
    return spark.read.schema(schema).json(path) if fs.exists(p) else spark.createDataFrame([], schema)


JOB_SCHEMA = "modus string, ziel string, entscheidung string, limit string, angelegt string, status string"


def add_job(spark: SparkSession, root: str, *, modus: str, ziel: str = "", entscheidung: str = "", limit: str = "10", stamp: str) -> str:
    """Writes one open job as JSON and returns its file name."""
    import json

    name = f"auftrag_{stamp}.json"
    write_text(spark, f"{root}/{name}", json.dumps({"modus": modus, "ziel": ziel, "entscheidung": entscheidung, "limit": limit, "angelegt": stamp, "status": "offen"}, ensure_ascii=False))
    return name


def jobs(spark: SparkSession, root: str, last: int | None = None) -> DataFrame:
    """Jobs by file name; ``last`` keeps so many of the newest."""
    rows = spark.read.schema(JOB_SCHEMA).option("pathGlobFilter", "auftrag_*.json").json(root, multiLine=True).withColumn("name", F.col("_metadata.file_name"))
    return rows.orderBy(F.desc("name")).limit(last).orderBy("name") if last else rows.orderBy("name")


def runs(spark: SparkSession, root: str, last: int = 5) -> DataFrame:
    """(run, report) of the newest runs."""
    rows = spark.read.text(f"{root}/run_*/report.md", wholetext=True)
    run = F.regexp_extract(F.col("_metadata.file_path"), r"/(run_[^/]+)/report\.md$", 1)
    return rows.select(run.alias("run"), F.col("value").alias("report")).orderBy(F.desc("run")).limit(last)


def run_report(spark: SparkSession, root: str, run: str) -> str | None:
    if ".." in run or "/" in run:
        return None
    return read_text(spark, f"{root}/{run}/report.md")
