"""Tables, keys and task mappings shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stopwise.session import FREE_SHUFFLES, checkpoint_root, freeing_shuffles


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: later stages survive lost executors and never redo the work.

    A write is a query of its own whose shuffles nothing else reads, so their files go with its end.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def raw_text(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def text_key(text: str | Column = "text") -> Column:
    """128-bit key of a text; results that depend on nothing but the text are computed once per key."""
    return F.unhex(F.md5(raw_text(text)))


#: Bits of the bitmap that tells rows apart, 2 MB in all; executors hold a broadcast until the driver's garbage collection lets it go.
MARKS = 1 << 24


def marked(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows with ``marked``: true where the key is among those of ``wanted``, and by chance elsewhere.

    The bitmap has the same size whatever the input and is broadcast, so rows that take no part need not be shuffled for a join.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(MARKS))
    bits = wanted.select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_at")).repartition("_bucket") \
        .groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    told = df.withColumns({"_bucket": F.bitmap_bucket_number(slot), "_at": F.bitmap_bit_position(slot)}).join(F.broadcast(bits), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), F.col("_at") % 8).cast("int")) != 0
    return told.select(*df.columns, F.coalesce(bit, F.lit(False)).alias("marked"))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], list[tuple]]], schema: str, flush: int = 2000) -> DataFrame:
    """Apply a row function inside tasks over Arrow batches; ``make`` builds it once per task."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            names, out = batch.schema.names, []
            for i in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                    out.extend(step(dict(zip(names, row))))
                if len(out) >= flush:
                    yield to_batch(out, arrow)
                    out = []
            if out:
                yield to_batch(out, arrow)

    return df.mapInArrow(run, kind)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows), schema)], schema=schema)


def crc32_sql(text: str) -> str:
    """Check SQL for the unsigned CRC-32 of an ASCII text."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b:
  list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""
