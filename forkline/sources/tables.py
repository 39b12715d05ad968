"""CSV and JSON readers with exact headers, and deterministic writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline.operators.relational import numbered


def clean(df: DataFrame) -> DataFrame:
    """Strings trimmed, null as the empty text."""
    return df.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, from its first line alone."""
    return spark.read.csv(path, header=True, escape='"').columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, strict: bool = True) -> DataFrame:
    """A CSV table, cleaned. With ``schema`` and ``strict`` the header must be equal, in order."""
    if schema is None:
        return clean(spark.read.csv(path, header=True, escape='"', multiLine=True))
    if strict and (found := header(spark, path)) != schema.names:
        raise ValueError(f"header of {path}: expected {schema.names}, found {found}")
    reader = spark.read.schema(schema).option("enforceSchema", False)
    return clean(reader.csv(path, header=True, escape='"', multiLine=True, mode="FAILFAST"))


def infer_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, escape='"', multiLine=True)


def with_line(df: DataFrame, name: str = "line") -> DataFrame:
    """Line numbers of one file's rows, the header being line 1, however many partitions it is read in."""
    return numbered(df, name, 2)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """A JSON document (an object, or an array of rows), or a file of one object a line."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines, mode="FAILFAST")


def load_profile_ids(spark: SparkSession, path: str) -> list[str]:
    """The profiles of a JSON list in its order; a repeated or missing id is an error."""
    ids = [r["profile_id"] for r in read_json(spark, path).select("profile_id").collect()]  # a designed list
    if None in ids or len(set(ids)) < len(ids) or not ids:
        raise ValueError(f"profiles of {path}: none, or ids that are missing or repeated")
    return ids


def nested_edges(df: DataFrame, at: str = "output.edges", key: str = "id") -> DataFrame:
    """Rows of a nested document list: one per element of ``at``."""
    return df.select(F.col(key), F.explode(F.col(at)).alias("edge")).select(key, "edge.*")


def decode(column: str | Column, schema: T.DataType) -> Column:
    """A JSON cell as a value; an empty or missing cell as an empty list."""
    value = F.from_json(F.nullif(F.col(column) if isinstance(column, str) else column, F.lit("")), schema)
    return F.coalesce(value, F.array().cast(schema)) if isinstance(schema, T.ArrayType) else value


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, order: list[Column] | None = None, mode: str = "overwrite", line: str = "\n", strict: bool = False) -> None:
    """CSV of exactly ``fields``, in ``order`` (a total one makes the files deterministic); ``strict`` refuses other columns."""
    if strict and fields and (extra := [c for c in df.columns if c not in fields]):
        raise ValueError(f"columns beyond {fields}: {extra}")
    out = df.select(*fields) if fields else df
    out = out.orderBy(*order) if order else out
    out.write.mode(mode).csv(path, header=True, escape='"', lineSep=line, emptyValue="")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> None:
    """A small table as one indented JSON array, its rows by ``order``."""
    fields = [c for c in df.columns if c not in order]
    rows = F.array_sort(F.collect_list(F.struct(*order, *fields)))
    whole = F.to_json(F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in df.columns))), {"pretty": "true", "ignoreNullFields": "false"})
    df.agg(whole.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row report as one JSON object in a text file."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_by_profile(df: DataFrame, path: str, by: str = "profile_id") -> None:
    """A folder per profile, so that a reader of one profile opens its files only."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def create_template(spark: SparkSession, path: str, schema: T.StructType) -> bool:
    """Creates an empty table to be filled in by hand; an existing one is only checked."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        if (found := header(spark, path)) != schema.names:
            raise ValueError(f"header of {path}: expected {schema.names}, found {found}")
        return False
    spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").csv(path, header=True)
    return True


def select_profiles(profiles: DataFrame, wanted: list[str]) -> DataFrame:
    """The rows of the wanted profiles; an unknown one is an error."""
    known = {r[0] for r in profiles.where(F.col("profile_id").isin(wanted)).select("profile_id").distinct().collect()}
    if unknown := sorted(set(wanted) - known):
        raise ValueError(f"unknown profiles: {unknown}")
    return profiles.where(F.col("profile_id").isin(wanted))


def book_path(template: str, book: str) -> str:
    return template.format(book=book)
