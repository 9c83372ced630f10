"""Helpers that the training-data operators share.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``; a temporary
folder of our own is used only where that setting is absent in local mode (tests on one machine).
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

#: Separators between words: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

_own_dir: dict[str, str] = {}
#: Intermediate tables of this session, in the order in which they were written.
_written: list[str] = []

# Functions of this package travel to the executors with their code, so that a cluster needs no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules["plumbline"])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="plumbline-")
    return f"file://{_own_dir[app]}"


def check_warehouse(spark: SparkSession) -> None:
    """Tables of the catalog have to lie where all executors see them: outside local mode the default folder doesn't do."""
    where = spark.conf.get("spark.sql.warehouse.dir", "")
    if not spark.sparkContext.master.startswith("local") and where.startswith("file:") and where.rstrip("/").endswith("/spark-warehouse"):
        raise ValueError("spark.sql.warehouse.dir has to name a folder that all executors share")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder for an intermediate table, in the shared folder."""
    _written.append(f"{_session_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table before its session's end."""
    _delete(spark, path)
    if path in _written:
        _written.remove(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize(make(), name)``; the tables that ``make`` has written on its way are deleted, as nothing else reads them."""
    before = len(_written)
    out = materialize(make(), name)
    for path in _written[before:-1]:
        _delete(spark, path)
    del _written[before:-1]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/plumbline-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that were not written yet can't be read after it."""
    _delete(spark, _session_dir(spark))
    _written.clear()


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small(df: DataFrame, rows: int, limit: int = 4096) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are at most ``limit``; otherwise a plain shuffle join stays."""
    return F.broadcast(df) if rows <= limit else df


def crc_bucket(doc_id: Column | str = "doc_id", mod: int = 4) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % mod


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_row_ids(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, Callable[[DataFrame, str, str], DataFrame]]:
    """``docs`` with a unique ``_rid`` in the order of ``id_col``, and ``name(df, rid, out)``, which adds the id of row ``rid``.

    Whole numbers are used as they are when all are present and distinct. Otherwise, and for ids of other
    types, rows are ordered by id (nulls last) and text, numbered, and written to the shared folder so that
    the numbers are stable.
    """
    kind = docs.schema[id_col].dataType
    c = docs.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("k")).first()
    distinct = isinstance(kind, (ByteType, ShortType, IntegerType, LongType)) and c["n"] == c["k"] and docs.groupBy(id_col).count().filter("count > 1").limit(1).count() == 0
    if distinct:
        return docs.withColumn("_rid", F.col(id_col).cast("long")), lambda df, rid, out: df.withColumn(out, F.col(rid).cast(kind))
    order = [F.col(id_col).asc_nulls_last(), F.xxhash64("text")]
    ordered = docs.repartitionByRange(n_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows = materialize(ordered.withColumn("_rid", F.monotonically_increasing_id()), "rows")

    def name(df: DataFrame, rid: str, out: str) -> DataFrame:
        ids = rows.select(F.col("_rid").alias("_named"), F.col(id_col).alias(out))
        return df.join(ids, df[rid] == ids["_named"]).drop("_named")

    return rows, name


def packed_by_row(rows: DataFrame) -> DataFrame:
    """(_rid, size, packed): the texts as compressed UTF-8, dealt out by row, for plans that join them more than once.

    Both uses read the same shuffle, which holds well under half of the text's bytes.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            texts = [t.as_buffer() if t.is_valid else b"" for t in batch.column(1)]
            packed = pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), packed], ["_rid", "size", "packed"])

    # the filter states what an inner join would infer, so that all uses have the same plan below the shuffle
    out = rows.select("_rid", "text").mapInArrow(pack, "_rid long, size long, packed binary").filter(F.col("_rid").isNotNull())
    return out.repartition(n_partitions(rows.sparkSession), "_rid")


def unpacked(sizes: pa.Array, packed: pa.Array) -> Iterator[bytes]:
    codec = pa.Codec("zstd")
    for n, b in zip(sizes.to_pylist(), packed):
        yield codec.decompress(b.as_buffer(), n, asbytes=True) if n else b""


def shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` without column names that begin with an underscore, which the operators keep to themselves, and the way back."""
    names = {c: f"own{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("_")}
    return docs.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: it is bound as a lambda variable of a one-element array."""
    return F.transform(F.array(value), body)[0]
