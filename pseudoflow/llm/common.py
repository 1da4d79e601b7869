"""Shared helpers: tables in the cluster's shared folder, size-checked broadcasts, bound values, word regex."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pseudoflow.session import ensure_checkpoint_dir

#: A word is a run of anything but space and U+0009 to U+000D (contract of the operators).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows a side may have to be broadcast (rows here are at most a few dozen bytes).
BROADCAST_ROWS = 500_000


def frugal(run):
    """``run`` (batches to batches, of ``mapInArrow``), which gives back at its end what it has freed: a worker process serves many
    stages, and its allocators keep freed memory otherwise."""

    def wrapped(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return wrapped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a narrow *written* table of at most ``max_rows`` rows, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only.  For pure ASCII text ``lower`` does just that and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(df[text_col], F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: A sieve has at most this many words of 64 bits, whatever the number of keys.
SIEVE_WORDS = 1 << 20


def _sieved(df: DataFrame, key: Column, keys: DataFrame, words: int, how: str) -> tuple[DataFrame, Column]:
    (key_col,) = keys.columns
    mixed = F.xxhash64(F.col(key_col))
    bits = keys.where(F.col(key_col).isNotNull()).select(F.pmod(mixed, F.lit(words)).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mixed, 58).cast("int")).alias("bit"))
    table = bits.groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    slot, own, filled = fresh(df, "sieve_slot", "sieve_hash", "sieve_bits")
    probe = df.withColumn(own, F.xxhash64(key)).withColumn(slot, F.pmod(F.col(own), F.lit(words)))
    met = probe.join(F.broadcast(table.select(F.col("slot").alias(slot), F.col("bits").alias(filled))), slot, how)
    bit = F.call_function("shiftrightunsigned", F.col(filled), F.shiftrightunsigned(F.col(own), 58).cast("int")).bitwiseAND(F.lit(1))
    return met, F.coalesce(bit == 1, F.lit(False))


def sieve(df: DataFrame, key: Column, keys: DataFrame, words: int = SIEVE_WORDS) -> DataFrame:
    """The rows of ``df`` whose ``key`` (a long) may be in ``keys`` (one long column): all that are, few others.

    A bit table of a fixed size, built by a distributed aggregate and broadcast, is looked up where ``df`` is
    scanned, so a join that follows shuffles little more than its hits.  With more keys it lets more rows
    through, at worst all; the join decides in any case.  Columns of ``df`` stay as they are.
    """
    met, hit = _sieved(df, key, keys, words, "inner")
    return met.where(hit).select(*[met[f"`{c}`"] for c in df.columns])


def parted(df: DataFrame, key: Column, keys: DataFrame, words: int = SIEVE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows whose long ``key`` may be in ``keys``, rows that surely aren't), as ``sieve`` finds them; neither is shuffled."""
    met, hit = _sieved(df, key, keys, words, "left")
    cols = [met[f"`{c}`"] for c in df.columns]
    return met.where(hit).select(*cols), met.where(~hit).select(*cols)


def without(df: DataFrame, key_col: str, keys: DataFrame, words: int = SIEVE_WORDS) -> DataFrame:
    """The rows of ``df`` whose long ``key_col`` (never null) is not in ``keys``; only rows that the sieve holds are shuffled."""
    held, rest = parted(df, df[f"`{key_col}`"], keys, words)
    (name,) = keys.columns
    return rest.unionByName(held.join(keys, held[f"`{key_col}`"] == keys[name], "left_anti"))
