"""Best-fit packing of documents into fixed-length sequences under source and duplicate conflicts.

A bin never holds two documents of one source, nor two of one duplicate cluster. Open bins are kept
ordered by residual space; for each piece, longest first, the successor search starts at the
smallest residual that fits and moves on until it meets a bin whose source and cluster bitmaps have
none of the piece's bits: the tightest compatible bin. If there is none, a new bin opens.

Rows are dealt by a hash of their id, length, source and cluster into shards of about `shard_rows`
documents, each packed on its own, so that no task ever holds more than a shard and no key (source
or cluster) gathers in one place. Best fit is therefore best within a shard (the README has what
that costs against one shard for all). Rows without an id are dealt by their place in the input. A document longer than the capacity is cut into full pieces, each a bin of its own, and one
rest, which is packed like any other piece; nothing is cut off.

Rows with null or no length count as length zero and are placed like others; a null source or
cluster conflicts with nothing. Repeated rows are packed as often as they come; ties are settled by
length, then id, then the order of the bins' opening. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ROWS = 2048


def pack(items: Iterable[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """For each item (length, source bitmap, cluster bitmap), in order, its pieces.

    A piece is (bin, offset in the bin, start in the item, length). Bins are numbered from 0.
    """
    order: list[tuple[int, int]] = []  # (residual, bin) of bins with space
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for length, source, cluster in items:
        pieces = []
        start = 0
        while length - start > capacity:
            pieces.append((len(sources), 0, start, capacity))
            sources.append(source)
            clusters.append(cluster)
            start += capacity
        need = length - start
        at = bisect_left(order, (need, -1))
        while at < len(order) and (sources[order[at][1]] & source or clusters[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            residual, number = order.pop(at)
            sources[number] |= source
            clusters[number] |= cluster
        else:
            residual, number = capacity, len(sources)
            sources.append(source)
            clusters.append(cluster)
        pieces.append((number, capacity - residual, start, need))
        if residual > need:
            insort(order, (residual - need, number))
        placed.append(pieces)
    return placed


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value that occurs twice or more in a shard; nulls and single values get none."""
    counts = values.value_counts()
    bit = {v: 1 << k for k, v in enumerate(counts.index[counts > 1])}
    return [bit.get(v, 0) for v in values]


def best_fit(docs: DataFrame, length: Column, source: Column, cluster: Column, id_col: str = "doc_id", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, shard, bin, piece, bin_offset, start, length): every piece of every row of `docs`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "source", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last")
        placed = pack(zip(frame["length"].tolist(), _bits(frame["source"]), _bits(frame["cluster"])), capacity)
        ids = frame["doc_id"].where(frame["has_id"]).astype(object) if not frame["has_id"].all() else frame["doc_id"]
        rows = [(i, shard, b, k, o, s, n) for i, shard, pieces in zip(ids, frame["shard"], placed) for k, (b, o, s, n) in enumerate(pieces)]
        out = pd.DataFrame(rows, columns=["doc_id", "shard", "bin", "piece", "bin_offset", "start", "length"])
        out["doc_id"] = pd.array([None if pd.isna(i) else int(i) for i in out["doc_id"]], "Int64")
        return out

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
        F.col(id_col).cast("long").isNotNull().alias("has_id"),
        F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("length"),
        source.cast("string").alias("source"),
        cluster.cast("string").alias("cluster"),
    )
    shards = max(1, -(-docs.count() // shard_rows))
    # equal rows without an id can't be told apart in the result, so any place will do for them
    place = F.when(~F.col("has_id"), F.monotonically_increasing_id())
    spread = F.pmod(F.xxhash64("doc_id", "length", "source", "cluster", place), F.lit(shards))
    return rows.withColumn("shard", spread).groupBy("shard").applyInPandas(run, "doc_id long, shard long, bin long, piece int, bin_offset long, start long, length long")


def words(text_col: str = "text") -> Column:
    """Whitespace-separated words of a text and one end mark: the length used for packing."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + F.lit(1)


def same_text(text_col: str = "text") -> Column:
    """Duplicate cluster of equal texts, without regard to case and white space."""
    return F.sha2(F.lower(F.regexp_replace(F.trim(F.col(text_col)), r"\s+", " ")), 256)
