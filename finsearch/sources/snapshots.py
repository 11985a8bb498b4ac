"""Local copies of remote tables that readers never see half written."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from finsearch.operators.ranking import small_side
from finsearch.session import written


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def newest_parts(spark: SparkSession, base_path: str, key: str, below: int | None = None) -> Iterator[int]:
    """Numbers n of the folders ``key=n``, newest first; a folder counts once its success marker exists.

    Markers are looked up one by one, so asking for the newest part costs one listing and one lookup.
    """
    base, fs = _filesystem(spark, base_path)
    if not fs.exists(base):
        return
    names = [status.getPath().getName() for status in fs.listStatus(base)]
    numbers = sorted((int(n.removeprefix(f"{key}=")) for n in names if n.startswith(f"{key}=")), reverse=True)
    for number in numbers:
        if below is not None and number >= below:
            continue
        marker, _ = _filesystem(spark, f"{base_path}/{key}={number}/_SUCCESS")
        if fs.exists(marker):
            yield number


def complete_parts(spark: SparkSession, base_path: str, key: str) -> list[str]:
    """Paths of all complete folders ``key=n``, newest first."""
    return [f"{base_path}/{key}={n}" for n in newest_parts(spark, base_path, key)]


def claim_part(spark: SparkSession, base_path: str, key: str, first: int = 0) -> int:
    """The next free number of a folder ``key=n``, claimed by creating a marker that must not exist yet.

    Two writers that start together get different numbers; the number of a writer that fails is left
    out. A folder that is neither complete nor claimed belongs to nobody and may be overwritten.
    """
    claims, fs = _filesystem(spark, f"{base_path}/_claims")
    fs.mkdirs(claims)
    taken = [status.getPath().getName().removeprefix(f"{key}=") for status in fs.listStatus(claims)]
    newest = next(newest_parts(spark, base_path, key), first - 1)
    number = 1 + max([newest, *(int(n) for n in taken if n.isdigit())])
    while not fs.createNewFile(_filesystem(spark, f"{base_path}/_claims/{key}={number}")[0]):
        number += 1
    return number


def snapshot_versions(spark: SparkSession, base_path: str) -> list[int]:
    """Complete versions in rising order."""
    return sorted(newest_parts(spark, base_path, "v"))


def read_snapshot(spark: SparkSession, base_path: str) -> DataFrame:
    """The newest complete version."""
    version = next(newest_parts(spark, base_path, "v"), None)
    if version is None:
        raise FileNotFoundError(f"no complete snapshot below {base_path}")
    return spark.read.parquet(f"{base_path}/v={version}")


def refresh_snapshot(df: DataFrame, base_path: str, keep: int = 2, view: str | None = None) -> DataFrame:
    """Copy ``df`` to a new version, then move readers to it and drop the oldest versions.

    A failed copy leaves a folder without success marker, which readers ignore. Each copy has a
    number of its own, so refreshes that run at once do not write to one folder; the later number wins.
    """
    spark = df.sparkSession
    version = claim_part(spark, base_path, "v", first=1)
    df.write.mode("overwrite").parquet(f"{base_path}/v={version}")
    current = read_snapshot(spark, base_path)
    if view:
        current.createOrReplaceTempView(view)
    for old in [v for v in snapshot_versions(spark, base_path) if v <= version][: -max(keep, 1)]:
        target, fs = _filesystem(spark, f"{base_path}/v={old}")
        fs.delete(target, True)
    return current


# --- refresh by difference -----------------------------------------------------------------------

MANIFEST = "part string, folder string, n_rows long, sum_a decimal(38,0), sum_b decimal(38,0)"


def _hashed(field: StructField) -> Column:
    """Columns as they enter the hash; nested ones as text, because nulls inside them would leave no trace."""
    column = F.col(f"`{field.name}`")
    nested = isinstance(field.dataType, (ArrayType, MapType, StructType))
    return F.to_json(F.struct(column), {"ignoreNullFields": "false"}) if nested else column


def _stored(df: DataFrame) -> StructType:
    """Columns as files give them back: every one may be null."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields])


def part_hashes(df: DataFrame, part: Column) -> DataFrame:
    """``(part, n_rows, sum_a, sum_b)``: the content of every part in 128 bits, whatever the order of its rows.

    Hashes are added, so repeated rows count, a task sends one row per part, and a part that holds most rows is no
    burden. A null leaves a hash as it was, so which columns are null is hashed as well.
    """
    columns = [_hashed(f) for f in df.schema.fields]
    nulls = [F.col(f"`{c}`").isNull() for c in df.columns]
    one = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns, *nulls).cast("decimal(20,0)")).cast("decimal(38,0)")
    return df.groupBy(part.cast("string").alias("part")).agg(F.count("*").alias("n_rows"), one(1).alias("sum_a"), one(2).alias("sum_b"))


def read_manifest(spark: SparkSession, base_path: str, version: int | None = None) -> DataFrame:
    """The parts of a version (the newest without a number): folder, rows and hash of each. No version: no rows."""
    version = next(newest_parts(spark, base_path, "v"), None) if version is None else version
    if version is None:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{base_path}/v={version}")


def read_delta(spark: SparkSession, base_path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, from the files that its manifest names, old and new."""
    version = next(newest_parts(spark, base_path, "v"), None) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no complete snapshot below {base_path}")
    schema = spark.read.parquet(f"{base_path}/schema/v={version}").schema
    folders = [r["folder"] for r in read_manifest(spark, base_path, version).select("folder").collect()]  # one per part
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def refresh_delta(df: DataFrame, base_path: str, part: Column, view: str | None = None) -> DataFrame:
    """Copy the parts of ``df`` whose content differs from the newest version; the new version names their files and the old ones.

    ``part`` is an expression over the rows that names their range of keys, such as ``F.floor(F.col("cik") / 1000)`` or
    ``F.date_trunc("month", "filed")``; a null is a part as well. The source is read twice, once for the hashes and once
    for what changed; the manifest holds the hashes of what was written, so rows that change in between are found by the next
    refresh. A part that the source no longer has is left out. Other columns than before make every part a changed one.

    The manifest is written last and its success marker makes the version count, so a failed refresh is not seen and
    leaves only files that no version names. Refreshes that run at once fill folders of their own; the later number wins.
    """
    spark = df.sparkSession
    base = next(newest_parts(spark, base_path, "v"), None)
    same_columns = base is not None and spark.read.parquet(f"{base_path}/schema/v={base}").schema.simpleString() == _stored(df).simpleString()
    version = claim_part(spark, base_path, "v", first=1)
    now = written(part_hashes(df, part), "hashes")
    old = read_manifest(spark, base_path, base) if same_columns else spark.createDataFrame([], MANIFEST)
    met = now.alias("n").join(old.alias("o"), F.col("n.part").eqNullSafe(F.col("o.part")), "left")
    equal = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("n_rows", "sum_a", "sum_b")]
    met = met.select("n.part", *[F.col(f"o.{c}").alias(c) for c in ("folder", "n_rows", "sum_a", "sum_b")], reduce(and_, equal).alias("kept"))
    met = written(met, "parts")
    changed = met.where(~F.col("kept")).select(F.col("part").alias("_changed"))
    n_changed = changed.count()
    kept = met.where("kept").select("part", "folder", "n_rows", "sum_a", "sum_b")
    target = f"{base_path}/data/v={version}"
    if n_changed:
        rows = df.withColumn("_part", part.cast("string"))
        rows = rows.join(small_side(changed, n_changed), F.col("_part").eqNullSafe(F.col("_changed")), "left_semi")
        # files by part; Spark cuts a large part into several tasks and puts small ones together
        name = F.coalesce(F.hex(F.encode("_part", "UTF-8")), F.lit("null"))
        rows.withColumn("_name", F.concat(F.lit("p"), name)).drop("_part").hint("rebalance", "_name").write.partitionBy("_name").parquet(target)
        copied = spark.read.schema(_stored(df).add("_name", "string")).parquet(target)
        sums = part_hashes(copied.drop("_name"), part)
        folder = F.concat(F.lit(f"{target}/_name=p"), F.coalesce(F.hex(F.encode("part", "UTF-8")), F.lit("null")))
        kept = kept.unionByName(sums.withColumn("folder", folder))
    spark.createDataFrame([], _stored(df)).write.mode("overwrite").parquet(f"{base_path}/schema/v={version}")
    kept.select("part", "folder", "n_rows", "sum_a", "sum_b").write.mode("overwrite").parquet(f"{base_path}/v={version}")
    current = read_delta(spark, base_path, version)
    if view:
        current.createOrReplaceTempView(view)
    return current


def expire_versions(spark: SparkSession, base_path: str, keep: int = 2) -> None:
    """Drop all but the newest versions, and the files that only they name. Not to be run while a refresh runs."""
    versions = snapshot_versions(spark, base_path)
    keep = max(keep, 1)
    folders = lambda chosen: {r["folder"] for v in chosen for r in read_manifest(spark, base_path, v).select("folder").collect()}
    unused = folders(versions[:-keep]) - folders(versions[-keep:])
    for path in [f"{base_path}/{at}v={v}" for v in versions[:-keep] for at in ("", "schema/")] + sorted(unused):
        target, fs = _filesystem(spark, path)
        fs.delete(target, True)
