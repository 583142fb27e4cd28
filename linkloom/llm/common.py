"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import keep as materialise  # noqa: F401  (written into the shared folder and read back)

#: White space of all the word-based operators, as a Java regex and as characters to trim.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

#: Rows up to which a lookup table is broadcast; above that the join is a shuffle.
BROADCAST_ROWS = 10_000
#: Words of 64 bits in a bitmap of hashes, which bounds what is broadcast (2 MB of bits).
BITMAP_WORDS = 1 << 18


def lookup(small: DataFrame) -> tuple[DataFrame, int]:
    """small with a broadcast hint if it has at most BROADCAST_ROWS rows (small must be materialised)."""
    n = small.count()
    return (F.broadcast(small) if n <= BROADCAST_ROWS else small), n


def slices(batch, column: int, most: int = 1 << 21):
    """A record batch in slices whose texts in a column have at most so many bytes together, or that are one row."""
    sizes, at, held = batch.column(column).cast("large_string").cast("large_binary"), 0, 0
    import pyarrow.compute as pc

    for i, n in enumerate(pc.fill_null(pc.binary_length(sizes), 0).to_pylist()):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def words(text: Column) -> Column:
    """The array of maximal runs of non-space characters; an empty array where there is none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns that tell rows apart even where ids are null or repeat."""
    return [F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("\0"))).alias("__th")]


def whole_rows(df: DataFrame, *more: Column) -> DataFrame:
    """df as one column __row beside more: its own columns cannot clash with those of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *more)


def bitmap(hashes: DataFrame, col: str) -> DataFrame:
    """(__word, __bits): a bitmap of the longs in col, at most BITMAP_WORDS rows however many there are."""
    return hashes.groupBy(F.expr(f"shiftrightunsigned(`{col}`, 6) & {BITMAP_WORDS - 1}").alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{col}` & 63 as int))")).alias("__bits"))


def marked(df: DataFrame, col: str, bits: DataFrame) -> DataFrame:
    """df with __maybe: false where the long in col is surely not in the bitmap. Nothing is shuffled."""
    d = df.join(F.broadcast(bits), F.expr(f"shiftrightunsigned(`{col}`, 6) & {BITMAP_WORDS - 1}") == F.col("__word"), "left")
    return d.withColumn("__maybe", F.coalesce(F.expr(f"shiftrightunsigned(__bits, cast(`{col}` & 63 as int)) & 1 = 1"), F.lit(False))).drop("__word", "__bits")


def same_key(a: str, b: str) -> Column:
    """Rows of aliases a and b have an equal (__id, __th)."""
    return F.col(f"{a}.__th").eqNullSafe(F.col(f"{b}.__th")) & F.col(f"{a}.__id").eqNullSafe(F.col(f"{b}.__id"))


def rows_with_key(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__row (see whole_rows), __id and __th of the rows of docs whose key is one of keys (__id, __th; materialised, each
    once). Only rows that a bitmap of the keys lets through are shuffled; a semi join would be moved below the bitmap."""
    some = marked(whole_rows(docs, *row_key(docs, id_col, text_col)), "__th", bitmap(keys, "__th")).where("__maybe").drop("__maybe")
    return some.alias("d").join(keys.select("__id", "__th").alias("k"), same_key("d", "k")).select("d.*")


def rows_without_key(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As rows_with_key, for the rows whose key is none of keys. Rows that the bitmap clears pass without a shuffle."""
    d = marked(whole_rows(docs, *row_key(docs, id_col, text_col)), "__th", bitmap(keys, "__th"))
    some = d.where("__maybe").drop("__maybe").alias("d").join(keys.select("__id", "__th", F.lit(True).alias("__hit")).alias("k"), same_key("d", "k"), "left")
    return d.where("not __maybe").drop("__maybe").unionByName(some.where("__hit is null").select("d.*"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
