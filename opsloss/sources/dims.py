"""The two small dimensions: hourly rates per role and duration norms per operation.

The domain tables do not exist in the provided data, so the versioned
dimension logs are given here as literal rows (a few dozen at most, the size
of the reference's seed). They are append logs: one row per synced version,
the latest ``updated_at`` per ``id`` wins on read (``operators.versioning``).

Operations cover both fact adapters: the five ``events`` types and the six
``lineitem`` flag+status codes. ``signup`` and ``RO`` have no norm, so inner
joins drop them (S4). ``error`` has a norm far above every duration, so the
zero-loss clip is exercised. ``RF`` carries two versions with the same
``updated_at``; ties are broken by the larger payload (documented choice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas

# Versioned rate rows (id, role_name, hourly_rate, updated_at).
RATE_VERSIONS = [
    (1, "picker", 450.0, "2024-01-01 00:00:00"),
    (2, "loader", 500.0, "2023-12-01 00:00:00"),
    (2, "loader", 520.0, "2024-01-01 00:00:00"),
    (3, "inspector", 480.0, "2024-01-01 00:00:00"),
]

# Versioned norm rows (id, operation_name, norm_seconds, role_id, updated_at).
NORM_VERSIONS = [
    (1, "view", 2400, 1, "2023-12-01 00:00:00"),
    (1, "view", 3000, 1, "2024-01-01 00:00:00"),
    (2, "click", 3000, 1, "2024-01-01 00:00:00"),
    (3, "error", 60000, 3, "2024-01-01 00:00:00"),
    (4, "purchase", 9500, 2, "2023-12-01 00:00:00"),
    (4, "purchase", 9000, 2, "2024-01-01 00:00:00"),
    (5, "AF", 1200, 2, "2024-01-01 00:00:00"),
    (6, "AO", 1500, 2, "2024-01-01 00:00:00"),
    (7, "NF", 1600, 1, "2024-01-01 00:00:00"),
    (8, "NO", 2700, 3, "2023-12-01 00:00:00"),
    (8, "NO", 2900, 3, "2024-01-01 00:00:00"),
    (9, "RF", 800, 3, "2024-01-01 00:00:00"),
    (9, "RF", 900, 3, "2024-01-01 00:00:00"),
]


RATE_COLUMNS = ["id", "role_name", "hourly_rate", "updated_at"]
RATE_TYPES = ["int", "string", "double", "timestamp"]
NORM_COLUMNS = ["id", "operation_name", "norm_seconds", "role_id", "updated_at"]
NORM_TYPES = ["int", "string", "int", "int", "timestamp"]


def _local(spark: SparkSession, rows, columns, types, schema) -> DataFrame:
    """A JVM-side local relation (no Python round trip); identical rows give
    identical plans, so a cached dimension is reused across queries."""
    df = spark.sql("SELECT * FROM " + values_sql(rows, columns, types, dialect="spark"))
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def sample_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(norms, rates): the latest of the literal rows, as a source without versions would hold them."""
    from ..operators.versioning import latest_by_key

    return latest_by_key(norms_versioned(spark), "id"), latest_by_key(rates_versioned(spark), "id")


def read_source(spark: SparkSession, norms: str, rates: str, fmt: str = "parquet",
                **options: str) -> tuple[DataFrame, DataFrame]:
    """The current norms and rates of a user's source: two Parquet (or CSV with header, ...)
    folders, or with ``fmt="jdbc"`` two tables of the database that ``options`` (``url``, ...) name."""
    def one(place: str, schema) -> DataFrame:
        r = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}), **options)
        df = r.option("dbtable", place).load() if fmt == "jdbc" else r.load(place)
        return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])

    return one(norms, schemas.NORMS), one(rates, schemas.RATES)


def rates_versioned(spark: SparkSession, rows=None) -> DataFrame:
    rows = RATE_VERSIONS if rows is None else rows
    return _local(spark, rows, RATE_COLUMNS, RATE_TYPES, schemas.RATES_VERSIONED)


def norms_versioned(spark: SparkSession, rows=None) -> DataFrame:
    rows = NORM_VERSIONS if rows is None else rows
    return _local(spark, rows, NORM_COLUMNS, NORM_TYPES, schemas.NORMS_VERSIONED)


def values_sql(rows, columns: list[str], types: list[str], dialect: str = "duckdb") -> str:
    """The literal rows as a SQL ``VALUES`` relation (Spark or DuckDB dialect)."""
    def lit(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        if t == "timestamp":
            return f"TIMESTAMP_NTZ '{v}'" if dialect == "spark" else f"TIMESTAMP '{v}'"
        if t in ("varchar", "string"):
            return "'" + str(v).replace("'", "''") + "'"
        return f"CAST({v} AS {t})"

    body = ",\n  ".join("(" + ", ".join(lit(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    if dialect == "spark":
        return f"VALUES\n  {body}\n AS t({', '.join(columns)})"
    return f"(VALUES\n  {body}\n) AS t({', '.join(columns)})"


def rates_versioned_sql() -> str:
    return values_sql(RATE_VERSIONS, RATE_COLUMNS, ["integer", "varchar", "double", "timestamp"])


def norms_versioned_sql() -> str:
    return values_sql(NORM_VERSIONS, NORM_COLUMNS, ["integer", "varchar", "integer", "integer", "timestamp"])
