"""Files in and out: JSON lines, cold archives by month, sidecars, one-file-per-entry stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("namespace", T.StringType()), T.StructField("content", T.StringType()), T.StructField("detail", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("importance", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("recurrence", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
STATUSES = ["active", "resolved", "obsolete", "obsolete_poisoned", "archived"]


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of JSON lines; a rejected row has its text and the reason.

    Accepted rows have defaults: namespace ``default``, importance .5, status active, recurrence 1.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*ENTRY.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    r = F.col("r")
    reason = (
        F.when(r.isNull() | r["_bad"].isNotNull(), "unreadable").when(r["id"].isNull() | (F.trim(r["id"]) == ""), "no_id").when(r["content"].isNull() | (F.trim(r["content"]) == ""), "no_content")
        .when((r["importance"] < 0) | (r["importance"] > 1), "bad_importance").when(r["status"].isNotNull() & ~r["status"].isin(STATUSES), "bad_status")
    )
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select("r.*").drop("_bad").fillna({"namespace": "default", "importance": 0.5, "status": "active", "recurrence": 1})
    return good, judged.where("reason IS NOT NULL").select("value", "reason")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_cold(df: DataFrame, path: str) -> None:
    """Archive partitioned by year and month of created_at, so that a month is read alone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("created_at") / 86_400_000_000).cast("int"))
    out = df.withColumn("year", F.year(day)).withColumn("month", F.month(day))
    out.repartition("year", "month").write.mode("append").partitionBy("year", "month").parquet(path)


def read_cold(spark: SparkSession, path: str, since: tuple[int, int] | None = None, until: tuple[int, int] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The archive, pruned to months since .. until (inclusive).  An archive without any row needs its ``schema`` (without
    year and month)."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())]))
    df = reader.parquet(path)
    m = F.col("year") * 12 + F.col("month")
    if since:
        df = df.where(m >= since[0] * 12 + since[1])
    return df.where(m <= until[0] * 12 + until[1]) if until else df


def read_sidecar(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], position: str) -> DataFrame:
    """An append log of JSON lines: the last record of each key; unreadable lines are skipped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    rest = [f.name for f in schema.fields if f.name not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("r")).select(*keys, "r.*")


def write_entry_files(df: DataFrame, path: str) -> None:
    """One small text record an entry (``key: JSON value`` lines), many records a file, readable by read_entry_files."""
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.to_json(F.array(F.col(c))), F.lit("[null]"))) for c in df.columns])
    df.select(F.concat(body, F.lit("\n---")).alias("value")).write.mode("errorifexists").text(path)


def read_entry_files(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad records) of ``key: value`` documents separated by ``---`` lines; values are JSON arrays of one."""
    docs = spark.read.option("lineSep", "\n---\n").text(path).where(F.trim(F.regexp_replace("value", "---", "")) != "")
    pairs = F.str_to_map(F.regexp_replace("value", r"\n?---\s*$", ""), F.lit("\n"), F.lit(": "))
    cols = []
    for f in schema.fields:
        raw = F.try_element_at("kv", F.lit(f.name))
        cols.append(F.from_json(raw, T.ArrayType(f.dataType))[0].alias(f.name))
    rows = docs.select("value", pairs.alias("kv")).select("value", *cols)
    first = schema.fields[0].name
    return rows.where(F.col(first).isNotNull()).drop("value"), rows.where(F.col(first).isNull()).select("value")


def split_readable(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose JSON ``column`` reads as ``schema`` (``parsed``; null text is good, with a null), and the
    rest as they stand, quarantined with a ``reason``."""
    j = df.withColumn("_json", F.expr(f"try_parse_json(`{column}`)").isNotNull() | F.col(column).isNull())
    return j.where("_json").withColumn("parsed", F.from_json(column, schema)).drop("_json"), j.where("NOT _json").withColumn("reason", F.lit("unreadable")).drop("_json")


def compact_sidecar(spark: SparkSession, path: str, out: str, schema: T.StructType, keys: list[str], position: str) -> None:
    """The log rewritten with the last record of each key only."""
    read_sidecar(spark, path, schema, keys, position).write.mode("errorifexists").option("ignoreNullFields", "false").json(out)


def rebuild(cold: DataFrame, schema: T.StructType, keys: list[str], version: str) -> DataFrame:
    """Typed rows from an archive of strings: every column cast to its kind (null if it does not read; lists, maps and
    structs from JSON), one row a key, that of the greatest ``version``; columns that are missing are null."""
    cols = []
    for f in schema.fields:
        if f.name not in cold.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.from_json(F.col(f.name).cast("string"), f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    rest = [f.name for f in schema.fields if f.name not in keys]
    typed = cold.select(*cols).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return typed.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version)).alias("r")).select(*keys, "r.*")
