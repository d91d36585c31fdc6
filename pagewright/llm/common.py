"""Shared folder, materialised tables and row packing for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.storage import delete, shared_folder

PACKED = "__packed_row"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``."""
    return shared_folder(spark, name)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends here and its rows are fixed."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


drop = delete


#: Tables of at most so many rows may be broadcast.
SMALL_TABLE = 1 << 20


def small(df: DataFrame) -> DataFrame:
    """df, which is stored and narrow, marked for broadcast if it has at most ``SMALL_TABLE`` rows."""
    return F.broadcast(df) if df.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else df


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """One struct column with the whole row, besides the columns that a step computes, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(PACKED), *more)


#: Texts that a step turns into Python objects at once.
TEXTS = 512


def packed_texts(df: DataFrame, text: str, *more: Column) -> tuple[DataFrame, int | None]:
    """df packed besides more, and the place of its text in the packed row, so that texts go to Python once.

    A text that isn't a string goes beside the row instead, as one, and the place is None; see ``texts_in``.
    """
    place = df.columns.index(text) if dict(df.dtypes).get(text) == "string" else None
    return packed(df, *more, *([F.col(f"`{text}`").cast("string").alias("__text")] if place is None else [])), place


def texts_in(batch, place: int | None):
    """The texts of a batch of ``packed_texts``, as lists of at most TEXTS values of bytes or None."""
    texts = batch.column("__text") if place is None else batch.column(PACKED).field(place)
    for at in range(0, len(texts), TEXTS):
        yield texts.slice(at, TEXTS).cast("binary").to_pylist()


def unpacked(df: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    return df.select(*[F.col(f"{PACKED}.`{c}`") for c in columns], *more)


def parts(n_bytes: int, each: int = 16 << 20) -> int:
    """Tasks for so many bytes."""
    return max(1, -(-int(n_bytes) // each))


def texts_of(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(y, text): one text for each id of chosen (id, y), distinct ids in bounded number, which are broadcast.

    Of rows that share an id, that with the smallest hash of its text counts, so there are never more rows than ids.
    """
    found = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    return found.groupBy("id", "y").agg(one).select("y", F.col("one.text").alias("text"))


def crc_class(doc_id: str, modulus: int) -> Column:
    """crc32 of doc_id's decimal text, modulo ``modulus``; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
