"""Contiguous shards of nearly equal size.

Documents stand in the order of their key. A global running sum of their sizes
(from per-partition totals) is cut at equal targets: a document goes to the
shard in whose part of the total its middle lies, so a shard is off its target
by at most half a document at each of its ends. Copies of a text are ordinary
documents; with equal keys they follow each other.

A size is the UTF-8 bytes of the text plus ``OVERHEAD``. A null text has no
bytes and the checksum of none. Null keys come first; rows of one key are
ordered by size and checksum, and rows equal in all three are interchangeable.
A document larger than a target leaves shards empty. Sums times twice the shards
must fit in 64 bits (10^17 bytes at 40 shards). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored
from flowloom.llm.prefix import numbered

OVERHEAD = 16


def assign(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", carry: bool = False
) -> DataFrame:
    """Rows: key, size, text_crc32, law, shard, slot (place in the shard), grown_shard.

    With ``carry`` all columns of ``docs`` come along, as the struct ``row``.
    """
    data = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))
    sized = docs.select(
        F.col(f"`{key}`").alias("k"),
        (F.length(data) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    rows, _ = numbered(sized, ["k", "size", "text_crc32"], sums=["size"])
    middle = (F.col("size_before") * 2 + F.col("size")) * shards
    # The middle of the last document lies below the total, so shards end at shards - 1.
    cut = rows.withColumn("shard", F.call_function("div", middle, F.col("size_all") * 2).cast("int"))
    first = stored(cut.groupBy("shard").agg(F.min("place").alias("first")), "shard_starts")
    # One row per shard.
    return cut.join(F.broadcast(first), "shard").select(
        F.col("k").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["row"] if carry else []),
    )


def write_shards(
    docs: DataFrame, folder: str, shards: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the documents to ``folder/shard=<n>`` in the order of their slots; returns :func:`assign`'s rows.

    A range of the order holds whole documents of few shards, so each writing
    task has few files open and no row moves again. Files are named in the order
    of their ranges.
    """
    found = assign(docs, shards, key, text, carry=True)
    found.select("shard", "slot", "row").write.partitionBy("shard").parquet(folder)
    return found.drop("row")
