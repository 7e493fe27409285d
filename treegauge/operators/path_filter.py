"""A Bloom filter over paths, built by aggregation and applied inside the scan of a tree.

Pages of 32,768 bits stand for the paths of one hash class each; a path sets `HASHES` bits of its page. The number of pages
follows from the number of paths at `BITS_PER_PATH` bits each, up to `MAX_PAGES` pages (64 MB), so what is broadcast has
a proven bound: beyond it more other paths pass, and the exact join behind the filter drops them. The plan is the
same for any number of paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BITS = 1 << 15
BITS_PER_PATH, HASHES = 12, 4
MAX_PAGES = 16_384


def _page(keys: list[str], pages: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(pages)).cast("int")


def _bits(keys: list[str]) -> list[Column]:
    """Independent 15-bit slices of a second hash."""
    second = F.xxhash64(F.lit("bits"), *keys)
    return [F.shiftrightunsigned(second, 15 * k).bitwiseAND(PAGE_BITS - 1) for k in range(HASHES)]


def path_filter(paths: DataFrame, keys: list[str], max_pages: int = MAX_PAGES) -> tuple[DataFrame, int]:
    """Pages (`_page`, `_bitmap`) of the filter over checkpointed paths, and how many pages there can be."""
    pages = min(max_pages, max(1, -(-paths.count() * BITS_PER_PATH // PAGE_BITS)))
    bits = paths.select(_page(keys, pages).alias("_page"), F.explode(F.array(*_bits(keys))).alias("_bit"))
    return bits.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bitmap")), pages


def maybe_of_paths(files: DataFrame, paths: DataFrame, keys: list[str], max_pages: int = MAX_PAGES) -> DataFrame:
    """The files whose path may be among the given ones; no path that is gets lost. Runs before any shuffle of files."""
    table, pages = path_filter(paths.select(*keys), keys, max_pages)
    sets = F.lit(True)
    for bit in _bits(keys):
        octet = F.conv(F.hex(F.substring("_bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        sets &= F.getbit(octet, F.pmod(bit, F.lit(8)).cast("int")) == 1
    marked = files.withColumn("_page", _page(keys, pages)).join(F.broadcast(table), "_page")
    return marked.where(sets).select(*files.columns)
