"""Tables whose content is named by a pointer that is written last.

A table is a folder with immutable data folders and small pointer files::

    <table>/data/v=<id>/kind=<kind>/[month=<yyyyMM>/]part-*.parquet
    <table>/_pointers/00000007.json

A pointer lists the data folders (*parts*) that make up one version of the table. Writers first write new data
folders, which nobody sees, and then create the next pointer; creating a file that exists fails, so of two
writers one wins and the other one looks at the new version and decides anew. A reader takes the newest
complete pointer and keeps reading its folders whatever is published later, until ``vacuum`` removes
folders that no kept pointer names. A job that fails before its pointer has changed nothing.

This needs a file system on which creating a file fails if it exists (HDFS, local disks, object stores with
conditional writes); elsewhere a table may have one writer at a time.

The pointer holds one line for each data folder (months and runs, not rows or files), so it stays small;
``storage.compact`` merges the folders of a month.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

MONTH, KIND, ROW = "month", "kind", "row"
POINTERS, DATA = "_pointers", "data"


@dataclass(frozen=True)
class Part:
    path: str                       # relative to the table
    kind: str = ROW
    month: str | None = None


@dataclass(frozen=True)
class Snapshot:
    number: int = 0                 # 0: no version yet
    parts: tuple[Part, ...] = ()
    notes: dict = field(default_factory=dict)

    def of(self, kind: str = ROW) -> list[Part]:
        return [p for p in self.parts if p.kind == kind]


class Conflict(Exception):
    """Another writer published first."""


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted (none if it does not exist)."""
    fs, p = file_system(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()) if fs.exists(p) else []


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, p = file_system(spark, f"{root}/{POINTERS}")
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _load(spark: SparkSession, root: str, number: int) -> Snapshot | None:
    fs, p = file_system(spark, f"{root}/{POINTERS}/{number:08d}.json")
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        body = json.loads(text)
    except ValueError:              # its writer has not finished, or never did
        return None
    return Snapshot(number, tuple(Part(**x) for x in body["parts"]), body["notes"])


def current(spark: SparkSession, root: str) -> Snapshot:
    """The newest complete version (an empty one for a table that has none)."""
    for n in reversed(_numbers(spark, root)):
        found = _load(spark, root, n)
        if found is not None:
            return found
    return Snapshot()


def publish(spark: SparkSession, root: str, base: Snapshot, parts, notes: dict | None = None) -> Snapshot:
    """Make ``parts`` the next version after ``base``; ``Conflict`` if ``base`` is not the newest any more."""
    if current(spark, root).number != base.number:
        raise Conflict(root)
    number = max(_numbers(spark, root), default=0) + 1
    parts, notes = tuple(parts), base.notes if notes is None else notes
    fs, p = file_system(spark, f"{root}/{POINTERS}/{number:08d}.json")
    try:
        out = fs.create(p, False)   # fails if it exists
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise Conflict(root) from e
        raise
    out.write(bytearray(json.dumps({"parts": [vars(x) for x in parts], "notes": notes}).encode()))
    out.close()
    return Snapshot(number, parts, notes)


def update(spark: SparkSession, root: str, change, tries: int = 10) -> Snapshot:
    """Publish ``change(newest version) -> (parts, notes)``, again if another writer was faster."""
    for _ in range(tries):
        base = current(spark, root)
        try:
            return publish(spark, root, base, *change(base))
        except Conflict:
            continue
    raise Conflict(root)


def stage(df: DataFrame, root: str, by: tuple[str, ...] = (), kind: str = ROW) -> list[Part]:
    """Write ``df`` to a new data folder that no pointer names yet; its parts.

    ``by``: folder columns in order, of ``kind`` and ``month``; without ``kind`` all rows are of the one given."""
    spark, name = df.sparkSession, f"{DATA}/v={uuid.uuid4().hex}"
    top = name if KIND in by else f"{name}/{KIND}={kind}"
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(f"{root}/{top}")
    kinds = [x.split("=", 1)[1] for x in list_dirs(spark, f"{root}/{name}") if x.startswith(f"{KIND}=")]
    parts = []
    for k in kinds:
        base = f"{name}/{KIND}={k}"
        months = [x for x in list_dirs(spark, f"{root}/{base}") if x.startswith(f"{MONTH}=")] if MONTH in by else []
        parts += [Part(f"{base}/{m}", k, m.split("=", 1)[1]) for m in months] if MONTH in by else [Part(base, k)]
    return parts


def read(spark: SparkSession, root: str, schema: StructType, kind: str = ROW, with_month: bool = False,
         at: Snapshot | None = None) -> DataFrame:
    """The rows of one kind in the newest version (or in version ``at``), with the given columns."""
    parts = (at or current(spark, root)).of(kind)
    fields = list(schema.fields) + ([StructField(MONTH, StringType())] if with_month else [])
    if not parts:
        return spark.createDataFrame([], StructType(fields))
    full = StructType(fields + [StructField(KIND, StringType()), StructField("v", StringType())])
    rows = spark.read.schema(full).option("basePath", f"{root}/{DATA}").parquet(*[f"{root}/{p.path}" for p in parts])
    return rows.select(*[f.name for f in fields])


def vacuum(spark: SparkSession, root: str, keep: int = 2, older_than: float = 7 * 86400) -> list[str]:
    """Delete pointers but for the newest ``keep`` complete ones, and data folders that none of those names.

    Only data written ``older_than`` seconds ago or earlier goes: a younger folder may belong to a writer that has yet to publish."""
    complete = [s for n in reversed(_numbers(spark, root)) if (s := _load(spark, root, n)) is not None]
    named = {p.path.split("/")[1] for s in complete[:keep] for p in s.parts}
    fs, p = file_system(spark, f"{root}/{DATA}")
    limit, gone = (time.time() - older_than) * 1000, []
    for st in fs.listStatus(p) if fs.exists(p) else []:
        name = st.getPath().getName()
        if name not in named and st.getModificationTime() <= limit:
            fs.delete(st.getPath(), True)
            gone.append(name)
    for s in complete[keep:]:
        delete_path(spark, f"{root}/{POINTERS}/{s.number:08d}.json")
    return sorted(gone)
