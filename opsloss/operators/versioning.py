"""Deduplication and versioning.

``latest_by_key`` is the read side of an append-only versioned log: the row
with the greatest ``(version, *tiebreak)`` per key. It is one hash
aggregation with ``max_by`` on a struct, so it runs partial aggregation
before the shuffle: a key that holds a third of all rows is reduced to one
row per map task before anything moves, and no group is ever materialised.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_key(
    df: DataFrame,
    key: str | Sequence[str],
    version: str = "updated_at",
    tiebreak: Sequence[str] | None = None,
    keep_version: bool = False,
) -> DataFrame:
    """Latest version per key; ties on ``version`` go to the greatest ``tiebreak``.

    ``tiebreak`` defaults to every payload column, so the choice is a pure
    function of the rows and does not depend on file or task order.
    """
    keys = [key] if isinstance(key, str) else list(key)
    payload = [c for c in df.columns if c not in keys and (keep_version or c != version)]
    if tiebreak is None:
        tiebreak = [c for c in df.columns if c not in keys and c != version]
    order = F.struct(F.col(version), *[F.col(c) for c in tiebreak])
    best = F.max_by(F.struct(*[F.col(c) for c in payload]), order).alias("_best")
    out = df.groupBy(*keys).agg(best)
    return out.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])


def stamp_snapshot(df: DataFrame, synced_at, column: str = "updated_at") -> DataFrame:
    """A10: stamp one sync time on every row of a source snapshot."""
    from ..functions.dates import ts_literal

    return df.withColumn(column, ts_literal(synced_at))


def changed_rows(src: DataFrame, log: DataFrame, key: str, version: str = "updated_at") -> DataFrame:
    """Rows of a source snapshot that the log's latest versions do not hold (new keys and changed values).

    Source and latest view are compared by all columns, nulls equal, in one join on the key; keys missing
    from the source are kept as they are (S17: deletes do not propagate)."""
    latest = latest_by_key(log, key, version).select(*[F.col(c).alias(f"_old_{c}") for c in src.columns])
    same = F.col(key) == F.col(f"_old_{key}")
    for c in src.columns:
        if c != key:
            same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return src.join(latest, same, "left_anti")
