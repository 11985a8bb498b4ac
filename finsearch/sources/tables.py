"""Reading tables: declared schemas, evolving schemas and federated views."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsearch.schemas import MONEY, TABLES


def _csv_column(field: T.StructField) -> Column:
    """Decode the two types that CSV text cannot carry as they are."""
    raw = F.col(f"`{field.name}`")
    if field.dataType == MONEY:
        return F.regexp_replace(raw, r"[$,]", "").cast(MONEY).alias(field.name)
    if isinstance(field.dataType, T.ArrayType):
        return F.from_json(raw, field.dataType, {"mode": "FAILFAST"}).alias(field.name)
    return raw


def load_table(
    spark: SparkSession, name: str, path: str, fmt: str, schema: T.StructType | None = None, multiline: bool = False
) -> DataFrame:
    """Load one named table with its declared schema; a malformed record fails the load.

    CSV quotes are doubled inside quoted text. ``multiline`` admits line breaks there, at the price
    of one task per file, so keep such files small.
    """
    declared = schema or TABLES[name]
    if fmt == "parquet":
        return spark.read.schema(declared).parquet(path)
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}")
    as_text = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.dataType == MONEY or isinstance(f.dataType, T.ArrayType) else f.dataType)
            for f in declared.fields
        ]
    )
    raw = spark.read.csv(path, schema=as_text, header=True, mode="FAILFAST", escape='"', multiLine=multiline)
    return raw.select([_csv_column(f) for f in declared.fields])


def load_evolving(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Load files whose later members carry additional columns; absent ones read as null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that takes the values of both: the join in the lattice of column types.

    Whole numbers widen to the longer one, to decimals and to doubles; whole numbers that meet dates are
    dates written as ``yyyyMMdd``; dates widen to timestamps. Whatever has no common form is text.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    for x, y in ((a, b), (b, a)):
        if isinstance(x, INTEGRAL) and isinstance(y, INTEGRAL) and INTEGRAL.index(type(x)) <= INTEGRAL.index(type(y)):
            return y
        if isinstance(x, (*INTEGRAL, T.FloatType, T.DecimalType)) and isinstance(y, T.DoubleType):
            return y
        if isinstance(x, (*INTEGRAL, T.DecimalType)) and isinstance(y, T.FloatType):
            return T.DoubleType()
        if isinstance(x, INTEGRAL) and isinstance(y, T.DecimalType):
            return T.DecimalType(38, y.scale)
        if isinstance(x, INTEGRAL) and isinstance(y, T.DateType):
            return y
        if isinstance(x, T.DateType) and isinstance(y, (T.TimestampType, T.TimestampNTZType)):
            return y
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        return T.DecimalType(38, max(a.scale, b.scale))
    return T.StringType()


def _converted(column: Column, have: T.DataType, want: T.DataType, layout: str) -> Column:
    if have == want:
        return column
    if isinstance(want, T.DateType) and isinstance(have, (*INTEGRAL, T.StringType)):
        text = column.cast("string")
        return F.coalesce(F.try_to_timestamp(text, F.lit(layout)).cast("date"), text.try_cast("date") if isinstance(have, T.StringType) else F.lit(None))
    return column.try_cast(want)


def load_reconciled(
    spark: SparkSession, paths: Sequence[str], declared: Mapping[str, str] | None = None, layout: str = "yyyyMMdd"
) -> tuple[DataFrame, DataFrame]:
    """Load files whose members disagree on columns and on their types: ``(rows, rejected)``.

    Each path is a load with one schema, which its footers tell. A column has the ``declared`` type or else the
    join of its types, see ``wider``; names are matched without regard to case, and absent columns read as null.
    Values that do not convert are null in ``rows``, and rows of ``rejected(source, column, value)``. No path is
    read for the types, and every path once for its rows; without a conflict nothing is converted.
    """
    frames = [(path, spark.read.parquet(path)) for path in paths]
    types: dict[str, tuple[str, T.DataType]] = {}
    for _, frame in frames:
        for f in frame.schema.fields:
            name, known = types.get(f.name.lower(), (f.name, f.dataType))
            types[f.name.lower()] = (name, wider(known, f.dataType))
    for name, kind in (declared or {}).items():
        types[name.lower()] = (types.get(name.lower(), (name,))[0], T.DataType.fromDDL(kind))
    rows, rejected = [], []
    for path, frame in frames:
        have = {f.name.lower(): f for f in frame.schema.fields}
        columns, bad = [], []
        for key, (name, want) in types.items():
            if key not in have:
                columns.append(F.lit(None).cast(want).alias(name))
                continue
            own = F.col(f"`{have[key].name}`")
            value = _converted(own, have[key].dataType, want, layout)
            columns.append(value.alias(name))
            if have[key].dataType != want:
                lost = own.isNotNull() & value.isNull()
                bad.append(F.when(lost, F.struct(F.lit(path).alias("source"), F.lit(name).alias("column"), own.cast("string").alias("value"))))
        rows.append(frame.select(*columns))
        if bad:
            rejected.append(frame.select(F.inline(F.array_compact(F.array(*bad)))))
    none = spark.createDataFrame([], "source string, column string, value string")
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, rejected, none)


def register_sources(spark: SparkSession, catalog: Mapping[str, tuple[str, str]], multiline: Collection[str] = ()) -> None:
    """Name -> (path, format): one temporary view per source, so that SQL joins across them."""
    for name, (path, fmt) in catalog.items():
        load_table(spark, name, path, fmt, multiline=name in multiline).createOrReplaceTempView(name)


def period_of_report(col: Column | str, layout: str = "yyyyMMdd") -> Column:
    """The integer reporting period as a date."""
    value = F.col(col) if isinstance(col, str) else col
    return F.to_date(value.cast("string"), layout)
