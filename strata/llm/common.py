"""What the operators share: tables, the package on executors, joins that bear frequent keys."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.scratch import discard, scratch_path, shared_dir, written

__all__ = ["crc_mod", "discard", "few", "named", "quoted", "scratch_path", "shared_dir", "ship_package", "spread_join", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as an expression reads it, whatever is in it."""
    return f"`{name.replace('`', '``')}`"


def named(names: list[str]) -> list[Column]:
    """Columns by their plain names."""
    return [F.col(quoted(c)).alias(c) for c in names]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once an application: tasks import their helpers from it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="spark-strata-")) / "strata_package.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(to))


def spread_join(left: DataFrame, right: DataFrame, key: str, salt: str, how: str = "inner", many: int = 1024, parts: int = 64, hot: list | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` where few keys may hold much of ``left``.

    ``left`` is a written table. Its most frequent keys, at most a thousand, are dealt into ``parts``
    by a hash of ``salt``, and their rows of ``right`` repeated for each part; a key that is not
    among these holds less than a thousandth of the rows. Who has counted already names them as ``hot``.
    """
    if hot is None:
        counts = left.groupBy(key).count().where(F.col("count") > many).orderBy(F.desc("count")).limit(1000)
        hot = [r[key] for r in counts.collect() if r[key] is not None]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    left = left.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(salt), F.lit(parts))).otherwise(F.lit(0).cast("long")))
    right = right.withColumn("_part", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return left.join(right, [key, "_part"], how).drop("_part")


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has ``most`` rows at most; beyond that Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
