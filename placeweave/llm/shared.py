"""Where intermediate tables go, and small building blocks that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

#: ASCII white space: the characters that separate words everywhere in this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Tables that were materialized since only_result began; none outside of it.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only where neither is set and Spark runs on this machine alone (as in tests) a temporary folder is made.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="placeweave-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/placeweave/{label}-{uuid.uuid4().hex}"
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(hadoop).deleteOnExit(where)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that no plan needs any more."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def only_result(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make(), materialized; whatever else was materialized on the way is removed."""
    before = _MADE.set(used := [])
    try:
        df = make()
    finally:
        _MADE.reset(before)
    out = materialize(df, label)
    discard(*used)
    return out


#: Bits of a filter for each of its keys, and in all (8 MiB). A bitmap of Spark's has PART_BITS.
KEY_BITS, MOST_BITS, PART_BITS = 16, 1 << 26, 1 << 15


def maybe_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with ``maybe``: false only where the column key, a long, is not in keys, a table of one column that is read twice.

    The bits of the keys' hashes are broadcast, KEY_BITS for each key or more, MOST_BITS at most. So one row in KEY_BITS is let
    through by chance (more of them beyond MOST_BITS / KEY_BITS keys) and a join must follow; rows marked false need none.
    """
    bits = min(MOST_BITS, 1 << (KEY_BITS * keys.count()).bit_length())  # one number
    slots = keys.toDF("key").select(F.pmod(F.xxhash64("key"), F.lit(bits)).alias("slot"))
    slots = slots.select(F.floor(F.col("slot") / PART_BITS).alias("maybe_part"), (F.col("slot") % PART_BITS).alias("at"))
    maps = slots.repartition("maybe_part").groupBy("maybe_part").agg(F.bitmap_construct_agg("at").alias("maybe_bits"))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    byte = F.conv(F.hex(F.substring(F.col("maybe_bits"), (F.floor(slot % PART_BITS / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("maybe_part", F.floor(slot / PART_BITS)).join(F.broadcast(maps), "maybe_part", "left")
    return met.withColumn("maybe", F.coalesce(F.getbit(byte, (slot % 8).cast("int")) == 1, F.lit(False))).select(*rows.columns, "maybe")


#: A key of so many rows, or of a HOT_KEYS-th of all rows if that is more, is hot: HOT_KEYS keys are hot at most.
HOT_ROWS, HOT_KEYS = 4096, 4096


def join_hot(rows: DataFrame, keyed: DataFrame, key: str | list[str], how: str = "inner", size: str | None = None) -> DataFrame:
    """rows joined to keyed, which has one row for a key; the rows of a hot key are dealt to several tasks.

    rows is read twice, so it should be materialized, as should keyed if its column size says how many of rows have the
    key. Hashes of the hot keys, HOT_KEYS at most, come to the driver, by how many parts each needs (a power of two).
    They make a filter that deals rows and copies of keyed to parts; rows of all other keys are in part 0. There is
    one join, the same at every size, and it makes each row once.
    """
    keys = [key] if isinstance(key, str) else key
    sizes = keyed.select(*keys, F.col(size).alias("rows")) if size else rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    least = max(HOT_ROWS, -(-(sizes.agg(F.sum("rows")).first()[0] or 0) // HOT_KEYS))  # one number
    name, by_parts = F.xxhash64(*keys), {}
    for h, n in sizes.where(F.col("rows") >= least).select(name, "rows").collect():  # HOT_KEYS at most
        by_parts.setdefault(1 << (-(-n // least)).bit_length(), []).append(h)
    parts = F.coalesce(*[F.when(name.isin(names), F.lit(n)) for n, names in sorted(by_parts.items())], F.lit(1))
    dealt = rows.withColumn("part", F.pmod(row_hash(rows), parts.cast("long")).cast("int"))
    copied = keyed.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copied, [*keys, "part"], how).drop("part")


def _has_no_hash(kind: DataType) -> bool:
    """Maps and variants, and whatever holds one, cannot be hashed."""
    if isinstance(kind, StructType):
        return any(_has_no_hash(f.dataType) for f in kind.fields)
    return _has_no_hash(kind.elementType) if isinstance(kind, ArrayType) else isinstance(kind, MapType | VariantType)


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of df; those that cannot be hashed by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(df[f"`{f.name}`"])) if _has_no_hash(f.dataType) else df[f"`{f.name}`"] for f in df.schema.fields])


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct, so that their names cannot clash with an operator's own."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns])


def unpacked(row: Column, names: Sequence[str], but: Sequence[str] = ()) -> list[Column]:
    """The named columns of a packed row, less those that an operator replaces."""
    return [row.getField(c).alias(c) for c in names if c not in but]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body uses it inside a higher-order function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of text in order: maximal runs without ASCII white space; null or blank text has none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS))


def running_offsets(sizes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``before``: the sum of value over the rows of the same keys that come earlier in order.

    sizes must be a table of bucket sums, not of rows.
    """
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df in that order over all partitions, materialized, with ``task`` and ``at``: a row's partition and place in it.

    Partitions are ranges of all order columns together, so rows that share the first of them may be dealt to many tasks.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    return materialize(dealt.select(*df.columns, F.shiftright("number", 33).alias("task"), F.col("number").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "numbered")
