"""Shared plumbing: shared-folder tables, places of rows in files, bounded key prefilters."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of its own is made only where the session names none and all runs on one machine (tests).
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_gridloom_root", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext._gridloom_root = root
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/gridloom-{label}-{uuid.uuid4().hex}"


_local = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for those to keep, which belong to the scope around."""
    scopes = _local.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind: its result is a table, so nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    scopes = _local.__dict__.get("scopes", [])
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    return written(df, path)


def written(df: DataFrame, path: str) -> DataFrame:
    with _cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that clash with none of ``taken`` (case-insensitively)."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def _reads_files(docs: DataFrame) -> bool:
    """Whether the rows are those of Parquet files, filtered and projected at most."""
    node = docs._jdf.queryExecution().analyzed()
    while (kind := node.getClass().getSimpleName()) in ("Project", "SubqueryAlias", "Filter"):
        if kind == "Filter" and not node.condition().deterministic():
            return False
        node = node.child()
    if kind != "LogicalRelation":
        return False
    relation = node.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString() == "Parquet"


def placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with the place of each row, and the names of those two columns: a hash of the file's path, and the row's number in it.

    A place is unique, and the same whenever and however the files are read, unlike monotonically_increasing_id, which
    depends on how they are packed into tasks at that moment. Rows that don't come straight from Parquet files are written to some.
    """
    if not _reads_files(docs):
        docs = materialize(docs, "rows", keep=True)
    file, row = fresh(docs.columns, "file", "row")
    meta = docs.metadataColumn("_metadata")
    return docs.withColumns({file: F.xxhash64(meta["file_path"]), row: meta["row_index"]}), [file, row]


#: Bits in a key prefilter; its table has at most BITS / 64 rows of 16 bytes (4 MB), whatever the input.
PREFILTER_BITS = 1 << 24


def _slot(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PREFILTER_BITS))


def _marked(rows: DataFrame, keys: list[str], wanted: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a boolean column: false if the key certainly isn't among ``wanted``'s.

    ``wanted`` becomes a one-hash bitmap of fixed size, so the broadcast side has a proven bound, and a null key belongs to slot of its own.
    """
    slot, word, bits = fresh([*rows.columns, flag], "slot", "word", "bits")
    slots = wanted.select(_slot(keys).alias("s"))
    bitmap = slots.groupBy((F.col("s") / 64).cast("long").alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias(bits))
    found = rows.withColumn(slot, _slot(keys)).withColumn(word, (F.col(slot) / 64).cast("long")).join(F.broadcast(bitmap), word, "left")
    hit = F.expr(f"(shiftright(`{bits}`, cast(`{slot}` % 64 as int)) & 1L) = 1L")
    return found.withColumn(flag, F.coalesce(hit, F.lit(False))).select(*rows.columns, flag)


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def key_prefilter(rows: DataFrame, key: str | list[str], wanted: DataFrame) -> DataFrame:
    """Rows whose key may be among ``wanted``'s: a superset of the semi-join, without a shuffle of ``rows``.

    False positives are for the caller's exact join to drop. Once the bitmap fills up it merely stops helping.
    """
    (flag,) = fresh(rows.columns, "may")
    return _marked(rows, _keys(key), wanted, flag).where(F.col(flag)).select(*rows.columns)


def parted(rows: DataFrame, key: str | list[str], wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key certainly isn't among ``wanted``'s, the other rows). Nothing is moved, whatever the size of the rows."""
    (flag,) = fresh(rows.columns, "may")
    found = _marked(rows, _keys(key), wanted, flag)
    return found.where(~F.col(flag)).select(*rows.columns), found.where(F.col(flag)).select(*rows.columns)


def without(rows: DataFrame, key: str | list[str], gone: DataFrame) -> DataFrame:
    """``rows`` whose key isn't in ``gone``, with a shuffle only of the rows that may go.

    They are few unless most rows go, and an exact join decides on them.
    """
    keys = _keys(key)
    stay, may_go = parted(rows, keys, gone)
    return stay.unionByName(may_go.join(gone.select(*keys), keys, "left_anti").select(*rows.columns))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
