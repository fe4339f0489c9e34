"""I-Match document fingerprints over several randomised lexicons.

The lexicon holds the terms (ASCII case folded words) whose document frequency lies in a band: at
least `MIN_SHARE` of all documents and at most `MAX_SHARE`. A fingerprint hashes, for each of
`SEEDS` random orders of the lexicon and each of `LEVELS` halvings of it, the sorted distinct terms
that the text shares with that part of the lexicon. Parts at low levels answer for short texts,
parts at high levels hold few terms of a long text and survive its partial changes. The likeness of
two fingerprints is the largest share of equal codes at a level where at least half of the codes
say something.

The lexicon's size is bounded: document frequencies sum to the number of documents times the mean
number of distinct terms in one, so at most (that mean / MIN_SHARE) terms can reach MIN_SHARE,
however many documents there are. It is broadcast on that ground.

A text without terms in the band is fingerprinted over all its terms; null and empty texts have an
all-zero fingerprint. Equal texts have equal fingerprints. Two all-zero fingerprints are alike (1).
Only id and text columns are read; rows without an id sort first; repeated rows are each returned.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SHARE, MAX_SHARE = 1 / 5000, 1 / 20
SEEDS, LEVELS = 10, 12
_FLUSH = 400_000
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * s + 1)) % (1 << 64) for s in range(1, SEEDS + 1)], np.uint64)


def _terms(text: bytes | None) -> set[bytes]:
    return set((text or b"").lower().split())


def _hashes(terms) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(t) for t in terms], np.uint64)


def frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): number of rows that hold each term, by its 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(_hashes(seen).view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["term", "df"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(_terms(text))
                if len(seen) > _FLUSH:
                    yield flushed()
        if seen:
            yield flushed()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> np.ndarray:
    """Sorted term hashes of the band, from the counts of all rows."""
    rows = docs.count()
    inside = frequencies(docs, text_col).where((F.col("df") >= max(2.0, min_share * rows)) & (F.col("df") <= max(2.0, max_share * rows)))
    found = inside.select("term").toArrow().column("term")
    return np.sort(np.asarray(found, np.int64).view(np.uint64)) if len(found) else np.zeros(0, np.uint64)


def _member(terms: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(terms), bool)
    at = np.searchsorted(lexicon, terms)
    at[at == len(lexicon)] = 0
    return lexicon[at] == terms


def codes(text: bytes | None, lexicon: np.ndarray) -> np.ndarray:
    """(SEEDS, LEVELS) 16-bit codes of a text; 0 where it has no term of that part."""
    terms = np.sort(_hashes(_terms(text)))
    if not len(terms):
        return np.zeros((SEEDS, LEVELS), np.uint16)
    inside = _member(terms, lexicon)
    if inside.any():
        terms = terms[inside]
    mixed = terms[None, :] * _MIX[:, None]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX[::-1, None]
    mixed ^= mixed >> np.uint64(29)
    low = (mixed >> np.uint64(40)).astype(np.int32)
    low &= -low  # the lowest set bit says how many halvings a term survives
    low[low == 0] = 1 << 30
    sums = np.empty((SEEDS, LEVELS), np.uint64)
    some = np.empty((SEEDS, LEVELS), bool)
    for level in range(LEVELS):
        stays = low >= 1 << level
        # a set of distinct terms is hashed by the sum of their mixed hashes, whatever their order
        sums[:, level] = (mixed * stays).sum(1)
        some[:, level] = stays.any(1)
    sums ^= sums >> np.uint64(31)
    sums *= np.uint64(0x9E3779B97F4A7C15)
    return np.where(some, (sums >> np.uint64(33)) % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)


def written(code: np.ndarray) -> str:
    return code.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Largest share of equal codes over the levels at which half of the seeds or more speak."""
    active = (a != 0) | (b != 0)
    equal = (a == b) & active
    n = active.sum(0)
    if not n.any():
        return 1.0
    usable = n >= SEEDS / 2
    if not usable.any():
        return float(equal.sum() / n.sum())
    return float((equal.sum(0)[usable] / n[usable]).max())


def fingerprints(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [written(codes(t, shared.value)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def against_edits(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside its edited text: its last quarter replaced by the start of the next one's.

    The next row by (id, hash of the text) follows in the same range of ids; the first row of the next range is
    sent along with each range, so that no task sees more than a range and texts move once.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("k"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 3 * parts
    found = rows.agg(F.percentile_approx("k", [i / ranges for i in range(ranges)], 20 * ranges)).first()[0] or []
    first = rows.agg(F.min("k")).first()[0] if found else None
    bounds = np.array(sorted({*found, first}) if found else [], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's range, whether it is the range's first id, and its text, packed for the way."""
        from xxhash import xxh64_intdigest
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=3).compress
        for batch in batches:
            k = np.asarray(batch.column(1))
            at = np.searchsorted(bounds, k, "right") - 1
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(at), pa.array(bounds[at] == k), pa.array([xxh64_intdigest(t) >> 1 for t in texts], pa.int64()), pa.array([pack(t) for t in texts], pa.binary())],
                ["doc_id", "k", "at", "starts", "tie", "body"],
            )

    last = max(0, len(bounds) - 1)
    placed = rows.mapInArrow(place, "doc_id long, k long, at long, starts boolean, tie long, body binary")
    here = F.struct(F.col("at").alias("range"), F.lit(False).alias("tail"))
    before = F.struct(F.when(F.col("at") == 0, F.lit(last).cast("long")).otherwise(F.col("at") - 1).alias("range"), F.lit(True).alias("tail"))
    spread = placed.select("doc_id", "k", "tie", "body", F.explode(F.when(F.col("starts"), F.array(here, before)).otherwise(F.array(here))).alias("r"))
    ordered = spread.select(F.col("r.range").alias("range"), F.col("r.tail").alias("tail"), "k", "tie", "doc_id", "body").repartition(parts, "range").sortWithinPartitions("range", "tail", "k", "tie")
    shared = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        lexicon = shared.value
        held = None  # (range, id, text, codes) that waits for its next row
        for batch in batches:
            out: list[tuple] = []
            for r, tail, doc_id, body in zip(*(batch.column(c).to_pylist() for c in ("range", "tail", "doc_id", "body"))):
                if tail and (held is None or held[0] != r):
                    continue  # a range's further tail rows are copies of its first row's id
                raw = unpack(body)
                text, own = raw.decode(), codes(raw, lexicon)
                if held is not None and held[0] == r:
                    _, i, t, c = held
                    quarter = len(t) // 4
                    edited = (t[: len(t) - quarter] + text[:quarter]).encode()
                    e = codes(edited, lexicon)
                    out.append((i, len(t), hashlib.sha256(edited).hexdigest(), written(c), written(e), likeness(c, e), likeness(c, own)))
                held = None if tail else (r, doc_id, text, own)
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
