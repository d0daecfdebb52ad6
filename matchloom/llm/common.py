"""Shared pieces: Arrow text access, a bitmap sieve, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.sources.io import materialize, release

#: Words are runs of characters other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets (n + 1) and bytes of a string or binary Arrow column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")


def small_batches(batches, max_bytes: int = 8 << 20):
    """Cut record batches so that each holds about ``max_bytes`` (at least one row)."""
    for batch in batches:
        step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of ``n`` nodes under the links ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


SIEVE_BITS, PAGE = 1 << 23, 512


def sieve(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """Add ``_maybe`` to ``rows``: false if the key is surely not in ``wanted``.

    One hashed bit a key in a bitmap of SIEVE_BITS (1 MB, whatever the number of keys), so that it
    can be broadcast. It saves a shuffle of rows without a partner; a full one only saves nothing.
    """
    spot = F.pmod(F.xxhash64(*key), F.lit(SIEVE_BITS))
    hits = wanted.select(spot.alias("_spot")).selectExpr("_spot div 64 as _word", "shiftleft(1L, cast(_spot % 64 as int)) as _bits")
    words = hits.unionByName(rows.sparkSession.range(SIEVE_BITS // 64).selectExpr("id as _word", "0L as _bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    pages = words.groupBy(F.expr(f"_word div {PAGE}").alias("_page")).agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("_words")).selectExpr("_page", "_words._bits as _bits")
    at = rows.withColumn("_spot", spot).withColumn("_page", F.expr(f"_spot div {64 * PAGE}")).join(F.broadcast(pages), "_page", "left")
    return at.withColumn("_maybe", F.expr(f"shiftrightunsigned(get(_bits, cast(_spot div 64 % {PAGE} as int)), cast(_spot % 64 as int)) & 1L = 1L")).drop("_spot", "_page", "_bits")


SALTS = 8


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star contraction; ``pairs`` has u, v. The join is salted, so that a hub is split."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hung = pairs.filter("v > u") if larger else pairs
    hung = hung.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(low, ["u", "salt"])
    if larger:
        return hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
    both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    return hung.select(F.inline(both))


def _is_forest(pairs: DataFrame) -> bool:
    """Whether no node of (u, v) has two neighbours v, or is a u and a v."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node in the link table (a, b); component is the smallest node.

    Alternating large-star and small-star contractions: every step keeps connectivity, the links
    only get fewer, and a fixed point is a forest of stars whose centres are the minima. Each step
    is a written table in the shared folder; nothing of them comes to the driver. Links with
    a null end and links to oneself are ignored; an empty table gives an empty result.
    """
    tidy = lambda df: df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(tidy(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), label)
    while not _is_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tidy(_star(both, larger=True))
        later = materialize(tidy(_star(large, larger=False)), label)
        release(now)
        now = later
    centres = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))
