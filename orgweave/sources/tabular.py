"""CSV tables and lists: all columns are strings on the way in, blanks are NULL inside and '' on the way out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgweave.functions.urls import blank_to_null, root_domain
from orgweave.operators.upsert import last_wins, store_key

#: Columns that may hold the domain of a list, in this order.
DOMAIN_COLUMNS = ("agency_domain", "client_domain", "domain", "url", "website")


def _schema(fields: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def read_csv(spark: SparkSession, path: str, fields: Sequence[str], sep: str = ",") -> DataFrame:
    """A CSV table by header name: unknown columns are dropped, missing ones NULL, a byte-order mark is
    skipped, blanks are NULL, rows of blanks alone are dropped."""
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.strip().lower(): c for c in raw.columns}
    cols = [(blank_to_null(F.col(f"`{have[f.lower()]}`")) if f.lower() in have else F.lit(None).cast("string")).alias(f) for f in fields]
    return raw.select(*cols).dropna(how="all")


def read_keyed(spark: SparkSession, path: str, fields: Sequence[str], key: Sequence[str]) -> DataFrame:
    """A CSV store: rows without a key are skipped, of rows with equal keys the last in the file counts."""
    rows = read_csv(spark, path, fields).withColumn("_seq", F.monotonically_increasing_id())
    keyed = rows.withColumn("_key", store_key(*key)).filter("_key IS NOT NULL")
    return last_wins(keyed, ["_key"], "_seq").select(*fields)


def write_csv(df: DataFrame, path: str, fields: Sequence[str], mode: str = "overwrite") -> None:
    """Fixed columns in fixed order, NULL as ''; ``mode='append'`` makes the keyless failure log."""
    cols = [(F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")).alias(f) for f in fields]
    df.select(*cols).write.mode(mode).option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def check_header(expected: Sequence[str], actual: Sequence[str]) -> list[str]:
    """Columns to append to a table whose header is the beginning of the expected one; else refused."""
    actual = [c for c in actual if c]
    if list(expected[: len(actual)]) != list(actual):
        raise ValueError(f"header {list(actual)} is no beginning of {list(expected)}")
    return list(expected[len(actual) :])


def read_domains(spark: SparkSession, source: str, column: str | None = None) -> DataFrame:
    """(domain) of a CSV or TSV by the first known column, of a .txt by line (# comments skipped), or of an
    inline list parted by commas or blanks."""
    low = source.lower()
    if low.endswith((".csv", ".tsv")):
        raw = spark.read.option("header", True).option("sep", "\t" if low.endswith("tsv") else ",").csv(source)
        have = {c.strip().lower(): c for c in raw.columns}
        name = next((c for c in ([column] if column else []) + list(DOMAIN_COLUMNS) if c in have), None)
        if name is None:
            raise ValueError(f"no domain column among {raw.columns}")
        return raw.select(F.trim(F.col(f"`{have[name]}`")).alias("domain")).filter("domain <> ''")
    if low.endswith(".txt"):
        lines = spark.read.text(source).select(F.trim("value").alias("domain"))
        return lines.filter("domain <> '' AND NOT startswith(domain, '#')")
    one = spark.range(1).select(F.explode(F.split(F.lit(source), r"[,\s]+")).alias("domain"))
    return one.filter("domain <> ''")


def read_verdicts(spark: SparkSession, source: str, fields: Sequence[str]) -> DataFrame:
    """Reviewers' verdict rows of a CSV file or a stored table; a source that isn't there is an error, no empty answer."""
    if source.lower().endswith(".csv"):
        return read_csv(spark, source, fields)
    rows = spark.read.parquet(source)
    return rows.select(*[(F.col(f).cast("string") if f in rows.columns else F.lit(None).cast("string")).alias(f) for f in fields])


def stamp(at: Column | None = None) -> Column:
    """A time as tables record it: minutes, UTC."""
    at = F.current_timestamp() if at is None else at
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")


def candidates(domains: DataFrame, domain: str, vertical: str = "", geo: str = "", source: str = "") -> DataFrame:
    """Rows of new agencies: every field there, later stages' fields blank."""
    none = F.lit(None).cast("string")
    return domains.select(
        none.alias("agency_name"), root_domain(domain).alias("agency_domain"), F.lit(vertical).alias("vertical"), F.lit(geo).alias("hq_location"),
        *[none.alias(c) for c in ("employee_count", "mentions_tiktok", "tiktok_evidence", "client_page_url", "clients_found")],
        F.lit("candidate").alias("status"), none.alias("notes"), F.lit(source).alias("source"),
    ).filter("agency_domain IS NOT NULL")


def save_required(df: DataFrame, path: str) -> None:
    """Parquet list that must not be empty (an empty one would let everything through)."""
    if df.isEmpty():
        raise ValueError("refusing to write an empty list")
    df.write.mode("overwrite").parquet(path)


def load_required(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    """The list, or an error (None if not required) where it is missing or empty."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    df = spark.read.parquet(path) if there else None
    if df is None or df.isEmpty():
        if required:
            raise ValueError(f"no list at {path}")
        return None
    return df
