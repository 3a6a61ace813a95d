"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text: runs of anything but space and \t \n \v \f \r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows that one sort bucket of a two-level running sum holds on average, and
#: how many buckets a small table has rather than larger ones.
ROWS_PER_BUCKET = 5000
LEAST_PER_BUCKET, MOST_SMALL_BUCKETS = 256, 1024
#: Copies of a row that one task spells out at once.
COPIES_AT_ONCE = 10_000
#: A key is hot if more than this part of all rows has it, so there are at most as many hot keys.
HOT_PARTS = 500

#: What each thread has staged; pipelines that run at once have a thread each.
_staged = threading.local()
_worker_table: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share.

    ``spark.checkpoint.dir`` of the session names it.  Only a local session
    without that setting (tests) gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="photoflow-")
        spark.sparkContext.setCheckpointDir(path)
    return f"{path}/photoflow-{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage at a table that survives lost executors; used for narrow
    tables that are read more than once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _paths() -> list[str]:
    if not hasattr(_staged, "paths"):
        _staged.paths = []
    return _staged.paths


def written() -> int:
    """A mark for ``discard``: how many tables this thread has staged so far."""
    return len(_paths())


def discard(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that this thread has staged since a mark; results that
    still read them must have been written before."""
    jvm = spark.sparkContext._jvm
    for path in _paths()[since:]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    del _paths()[since:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def named(column: str) -> Column:
    """A column by its very name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores behind it as no taken name has."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """``extra`` columns, and all of ``docs`` as the struct ``row``: whatever the
    names of its columns, they meet no other name."""
    return docs.select(*[c.alias(k) for k, c in extra.items()], F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def without_marked(docs: DataFrame, tag: Column, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without rows whose (doc_id, tag) is in ``dropped``, and with one
    row only of each (doc_id, tag) in ``repeated``; all columns stay.

    Of rows that repeat, that with the least hash of all its columns stays; it
    is found by an aggregate, so any number of them is one partial row a task.
    """

    def marks(found: DataFrame) -> DataFrame:
        return found.select(F.col("doc_id").alias("id"), F.col("tag").alias("mark"))

    rows = packed(docs, doc_id=F.col("doc_id"), tag=tag)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("tag").eqNullSafe(F.col("mark"))
    kept = rows.join(marks(dropped), same, "left_anti")
    if repeated.isEmpty():
        return unpacked(kept)
    once = kept.join(marks(repeated), same, "left_anti")
    again = kept.join(marks(repeated), same, "left_semi")
    one = again.groupBy("doc_id", "tag").agg(F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return unpacked(once.select("row").unionByName(one.select("row")))


def worker_table(key: object, make: Callable):
    """What tasks with the same key share in a Python worker. A worker is used
    again by later stages, so it holds one such table: a new key frees the last."""
    if key not in _worker_table:
        _worker_table.clear()
        _worker_table[key] = make()
    return _worker_table[key]


def free_worker_table() -> None:
    """For tasks without a table: frees what a stage before has left in this worker."""
    _worker_table.clear()


def map_texts(
    docs: DataFrame,
    kernel: Callable[[list[bytes]], dict[str, Iterable]],
    schema: str,
    keys: dict[str, Column],
    tables: bool = False,
) -> DataFrame:
    """One output row per document: ``keys`` carried over, then what ``kernel``
    makes of a batch of whole texts (UTF-8 bytes, null as empty).

    Documents stay where they are read: no shuffle. ``tables`` says that the
    kernel has a ``worker_table``.
    """
    carried = docs.select(*[c.alias(k) for k, c in keys.items()], text_bytes().alias("text__"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    heads = carried.schema.fields[:-1]
    made_fields = _parse_datatype_string(schema).fields
    full = StructType([*heads, *made_fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            free_worker_table()
        for batch in batches:
            for part in slices(batch):
                made = kernel(part.column(len(heads)).to_pylist())
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(heads))]
                columns += [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], type=arrow.field(f.name).type) for f in made_fields]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return carried.mapInArrow(run, full)


def slices(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most_bytes``, so that memory stays bounded
    when a batch holds many long texts; one text is never divided."""
    start, held = 0, 0
    lengths = pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()
    for i, n in enumerate(lengths):
        held += n or 0
        if held >= most_bytes:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with each row, per ``keys``,
    in the order of ``bucket`` then ``order``.

    Two levels: a small table of sums per (keys, bucket) gives each bucket its
    offset, and a window runs within a bucket only, so that a key with a third
    of all rows is still spread over as many tasks as it has buckets.  Keys
    and bucket must not be null.
    """
    by = [*keys, bucket]
    sums = df.groupBy(*by).agg(F.sum(value).alias("sum__"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, F.coalesce(F.sum("sum__").over(before), F.lit(0)).alias("offset__"))
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, by).withColumn(name, F.col("offset__") + F.sum(value).over(within)).drop("offset__")


def each_copy(rows: DataFrame, counts: DataFrame, by: list[str], part: int = COPIES_AT_ONCE) -> DataFrame:
    """Adds copy: each row as often as its column copies says, numbered from 1.

    ``counts`` has all values of copies. Rows of more than ``part`` are cut into
    ranges of so many, which are dealt over the tasks by ``by`` and the range
    before they are spelled out.
    """
    number = F.explode(F.sequence(F.col("from__") * part + 1, F.least((F.col("from__") + 1) * part, F.col("copies"))))

    def spelled(some: DataFrame) -> DataFrame:
        return some.withColumn("copy", number).drop("from__")

    few = spelled(rows.where(F.col("copies") <= part).withColumn("from__", F.lit(0).cast("long")))
    if counts.where(F.col("copies") > part).isEmpty():
        return few
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / part)))
    many = rows.where(F.col("copies") > part).withColumn("from__", ranges).repartition(*by, "from__")
    return few.unionByName(spelled(many))


def join_hot(rows: DataFrame, values: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``values`` (one row a key, with ``weight``,
    how many of the ``total`` rows have the key), without ``weight``.

    Values of hot keys, HOT_PARTS at most by their definition, go to the rows
    where these are; all others meet by a shuffle, in which no key is large.
    """
    hot = F.col(weight) > max(total // HOT_PARTS, ROWS_PER_BUCKET)
    few = values.where(hot).drop(weight)
    if few.isEmpty():
        return rows.join(values.drop(weight), keys)
    many = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(values.where(~hot).drop(weight), keys)
    return many.unionByName(rows.join(F.broadcast(few), keys).select(*many.columns))


def hash52(value: Column) -> Column:
    """52 bits of the MD5 of a value's text: an order for shuffling that any
    SQL engine can repeat. A null counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def fraction_bucket(hash_column: str, buckets: int) -> Column:
    """Which of ``buckets`` equal ranges of hash52 a row falls in."""
    return F.floor(F.col(hash_column) / F.lit(float(1 << 52)) * F.lit(float(buckets))).cast("int")


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_BUCKET), min(MOST_SMALL_BUCKETS, rows // LEAST_PER_BUCKET))
