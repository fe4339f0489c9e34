"""SimHash near-duplicate detection over a byte-position inverted index with count filtering.

Fingerprints are 64 bits in eight byte positions. Two fingerprints that differ in at most two bits
share at least six of their eight positional bytes. One posting list per single positional byte
would hold 1/256 of all fingerprints, so that tallying its pairs is quadratic; the index therefore
keys its postings by six positional bytes at a time (28 choices). Fingerprints in one list are
distinct and differ in two bytes only, so a list has at most 65,536 entries whatever the input. In
a list, members meet at the values that are one bit at most from them: every pair within two bits
has such a value, and at most 17 members surround one, so no list makes all its pairs. What meets
is tallied: pairs with fewer than six equal positional bytes go, and the exact bit distance of the
others is verified.

Null and empty texts have fingerprint zero and are linked like any other. Rows without an id are
returned with the component of their fingerprint (null if no row of that component has an id).
Repeated rows are returned as often as they come. Only the id and text columns are read, so extra
columns with any name are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

SEED = 42
BITS = 2
SHARED = 8 - BITS
_CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every run of `width` words, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    body = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(body, SEED)] if words else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    return np.array([xxh64_intdigest(body[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of UTF-8 text over word shingles (ASCII case folded, repeats included)."""
    return majority(shingle_hashes((text or b"").lower().split(), width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, extra: str | None = None) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, one row per input row; a column of longs may come along under its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *more])

    more = [extra] if extra else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {c} long" for c in more))


def _posting_keys(fp: Column) -> Column:
    """The 28 keys of a fingerprint: six positional bytes kept, the other two zeroed and named."""
    keys = []
    for number, dropped in enumerate(combinations(range(8), BITS)):
        mask = (1 << 64) - 1
        for byte in dropped:
            mask &= ~(0xFF << (8 * byte))
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).cast("byte").alias("positions"), fp.bitwiseAND(F.lit(mask)).alias("bytes")))
    return F.array(*keys)


def links(reps: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that connect the representatives of all fingerprints within two bits.

    `reps` has one row (fp, rep) for each distinct fingerprint. Pairs within two bits are joined by
    an edge or by a path over fingerprints within two bits.
    """
    postings = reps.where("rep is not null").select("fp", "rep", F.explode(_posting_keys(F.col("fp"))).alias("key"))
    lists = postings.groupBy("key").agg(F.collect_list(F.struct("rep", "fp")).alias("m")).where(F.size("m") > 1)
    flips = [F.array(F.lit(0).cast("long"), *[F.lit((1 << (8 * byte + bit)) - ((1 << 64) if 8 * byte + bit == 63 else 0)).cast("long") for byte in dropped for bit in range(8)]) for dropped in combinations(range(8), BITS)]
    flip = F.element_at(F.array(*flips), F.col("key.positions").cast("int") + 1)
    met = (
        lists.select("key.positions", flip.alias("flip"), F.explode("m").alias("one"))
        .select("positions", "one", F.explode("flip").alias("bit"))
        .groupBy("positions", F.col("one.fp").bitwiseXOR(F.col("bit")).alias("value"))
        .agg(F.collect_set("one").alias("around"))
        .where(F.size("around") > 1)
        .select(F.array_min("around").alias("u"), F.explode("around").alias("v"))
        .where("u.rep <> v.rep")
    )
    return met.where((tally("u.fp", "v.fp") >= SHARED) & F.expr(f"bit_count(u.fp ^ v.fp) <= {BITS}")).select(F.col("u.rep").alias("a"), F.col("v.rep").alias("b")).distinct()


def tally(a: str, b: str) -> Column:
    """How many positional bytes two fingerprints share."""
    x = F.col(a).bitwiseXOR(F.col(b))
    equal = [F.when(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(0xFF)) == 0, 1).otherwise(0) for k in range(8)]
    return sum(equal[1:], equal[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node.

    Alternates large-star and small-star steps: each attaches nodes to the smallest node seen among
    their neighbours, so that the number of rounds grows with the logarithm of the longest path.
    Every round is one aggregation and one join on the node, and is cut from its lineage.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
            least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            out = near.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            least = e.groupBy("b").agg(F.min("a").alias("m"))
            out = e.join(least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    edges = cut(edges)
    seen = mark(edges)
    while seen[0]:
        edges = cut(star(star(edges, True), False))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row, linked at two or fewer differing bits."""
    fps = cut(fingerprints(docs, id_col, text_col, width))
    # an explicit number of partitions, as small rows would be drawn into a few tasks, and each makes 28 postings
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).repartition(parts, "fp"))
    found = components(links(reps))
    classes = reps.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


BANDS, BAND_ROWS = 20, 5
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)


#: Of 100 MinHash values, sets of similarity 0.8 differ in more than this many with probability 0.00002.
DIFFERENT = 38


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of the MinHash values, and a byte of each value; sets of similarity 0.8 share no key with probability 0.0004."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 4096):
        mixed = hashes[i : i + 4096, None] * _MULTIPLIERS
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(0))
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        keys = (keys ^ rows[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    each = np.zeros(-(-len(least) // 8) * 8, np.uint8)
    each[: len(least)] = least >> np.uint64(40)
    return keys.view(np.int64), each.view(np.int64)


def differing(a: str, b: str) -> Column:
    """In how many bytes two signatures (arrays of longs) differ: every byte's bits are folded into its lowest."""
    total = F.lit(0)
    for k in range(-(-BANDS * BAND_ROWS // 8)):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def prints(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, fp, name, bands, sig) of rows (doc_id, h, text): fingerprint, and name and signature of the set of `width`-word shingles.

    Texts without a word have no name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            fps, names, keys = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = (text or b"").lower().split()
                fps.append(majority(shingle_hashes(words, 3)))
                own = np.unique(shingle_hashes(words, width))
                names.append(sha256(own.tobytes()).digest()[:16] if len(own) else None)
                keys.append(signature(own) if len(own) else (None, None))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(names, pa.binary()), *(pa.array([k[i] for k in keys], pa.list_(pa.int64())) for i in (0, 1))]
            yield pa.record_batch(columns, ["doc_id", "h", "fp", "name", "bands", "sig"])

    return rows.mapInArrow(run, "doc_id long, h long, fp long, name binary, bands array<long>, sig array<long>")


def similar(rows: DataFrame, found: DataFrame, known: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) between fingerprints that join all texts whose shingle sets are that similar, each edge verified.

    `rows` are (doc_id, h, text), `found` is `prints` of them and `known` has edges of fingerprints
    already. Sets that share a band are compared with the band's best connected set. Bands that then
    still hold several components are put together by the component most of their sets are in, so
    that a set comes into few such groups; there, sets of different components are compared in blocks.
    No pair leaves a comparison but those that join components.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingle_hashes((t or b"").lower().split(), width)).view(np.int64) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int64()))], ["name", "fp", "hashes"])

    named = found.where("name is not null")
    pick = F.struct("fp", "doc_id", "h")
    one = cut(named.groupBy("name").agg(F.min(pick).alias("pick"), F.min_by("bands", pick).alias("bands"), F.min_by("sig", pick).alias("sig")).select("name", "pick.fp", "pick.doc_id", "pick.h", "bands", "sig"))
    copies = named.select("name", F.col("fp").alias("b")).distinct().join(one.select("name", F.col("fp").alias("a")), "name").where("a <> b").select("a", "b")
    keyed = one.select(F.explode("bands").alias("band"), "name", "fp")
    met = cut(keyed.join(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band"))
    ranked = met.join(met.groupBy("name").agg(F.sum("n").alias("degree")), "name")
    shared = cut(ranked.join(ranked.groupBy("band").agg(F.max(F.struct("degree", "name")).alias("best")), "band").select("band", "name", "fp", "best"))
    wanted = shared.select("name").distinct().join(one.select("name", "fp", "doc_id", "h"), "name")
    bodies = rows.join(wanted.select("name", "fp", F.col("doc_id").alias("__id"), F.col("h").alias("__h")), (F.col("h") == F.col("__h")) & (F.col("doc_id") == F.col("__id")))
    held = stored(bodies.select("name", "fp", "text").mapInArrow(sets, "name binary, fp long, hashes array<long>").dropDuplicates(["name"]))

    def verified(pairs: DataFrame) -> DataFrame:
        right = held.select(F.col("name").alias("n"), F.col("fp").alias("b"), F.col("hashes").alias("h"))
        left = held.select(F.col("name").alias("m"), F.col("fp").alias("a"), F.col("hashes").alias("g"))
        both = F.size(F.array_intersect("g", "h"))
        return pairs.join(right, "n").join(left, "m").where(both >= F.lit(similarity) * (F.size("g") + F.size("h") - both)).where("a <> b").select("a", "b")

    first = verified(shared.where("name <> best.name").select(F.col("best.name").alias("m"), F.col("name").alias("n")).distinct())
    edges = cut(ordered(known.union(copies).union(first)))
    label = components(edges)
    marked = shared.select("band", "name", "fp").join(label, F.col("fp") == F.col("node"), "left").select("band", "name", "fp", F.coalesce("component", "fp").alias("label"))
    counted = marked.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counted.groupBy("band").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("band", F.col("most.label").alias("group"))
    members = marked.join(mixed, "band").select("group", "name", "fp", "label").distinct()
    open_ = stored(members.join(one.select("name", "sig"), "name").join(held.select("name", "hashes"), "name").select("group", "name", "fp", "label", "sig", "hashes"))
    return ordered(edges.union(compared(open_, similarity)))


#: A block of a group of sets has about this many sets, and about this many hashes.
BLOCK_SETS, BLOCK_HASHES = 512, 1 << 21
_TILE = 4096


def compared(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that join all sets of a group that are that similar and have different labels.

    `sets` are (group, name, fp, label, sig, hashes). A group is cut into blocks by its number of
    sets and of hashes, and each two blocks are compared in a task of their own: signatures first,
    then the sizes of intersections, of all that are left, as a product of matrices. Of what is
    similar only the edges leave that join what the labels and the edges before did not.
    """
    total = sets.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum(F.size("hashes")) / BLOCK_HASHES), F.lit(1)).cast("int").alias("blocks"))
    dealt = sets.join(total, "group").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    with_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = dealt.select("*", with_.alias("other")).select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "label", "sig", "hashes")

    def run(table: pa.Table) -> pa.Table:
        label, fps, block = (np.asarray(table[c]) for c in ("label", "fp", "block"))
        out: list[tuple[int, int]] = []
        if len(np.unique(label)) > 1:
            sigs = np.array(table["sig"].to_pylist(), np.int64).view(np.uint8)
            left, right = np.flatnonzero(block == table["i"][0].as_py()), np.flatnonzero(block == table["j"][0].as_py())
            out = _joining(left, right, label, fps, sigs, table["hashes"].combine_chunks(), similarity)
        return pa.table([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return pairs.groupBy("group", "i", "j").applyInArrow(run, "a long, b long")


def _joining(left: np.ndarray, right: np.ndarray, label: np.ndarray, fps: np.ndarray, sigs: np.ndarray, hashes: pa.Array, similarity: float) -> list[tuple[int, int]]:
    """Edges between the fingerprints of similar sets of `left` and `right` that join different labels."""
    near = np.zeros((len(left), len(right)), bool)
    for k, one in enumerate(left):
        near[k] = (sigs[right] != sigs[one]).sum(1) <= DIFFERENT
    near &= label[left][:, None] != label[right][None, :]
    left, right, near = left[near.any(1)], right[near.any(0)], near[near.any(1)][:, near.any(0)]
    if not len(left):
        return []
    offsets, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()

    def entries(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = offsets[at + 1] - offsets[at]
        return np.repeat(np.arange(len(at)), sizes), np.concatenate([values[offsets[k] : offsets[k + 1]] for k in at]), sizes

    (rows, a, size_a), (columns, b, size_b) = entries(left), entries(right)
    words = np.intersect1d(a, b)
    both = np.zeros(near.shape, np.int64)
    at_a, at_b = _sorted(a, rows, words), _sorted(b, columns, words)
    for start in range(0, len(words), _TILE):
        width = min(_TILE, len(words) - start)
        x, y = (_ones(at, start, width, n) for at, n in ((at_a, len(left)), (at_b, len(right))))
        both += (x @ y.T).astype(np.int64)
    near &= both >= similarity * (size_a[:, None] + size_b[None, :] - both)
    parent = {int(v): int(v) for v in np.unique(label)}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    x, y = np.nonzero(near)
    labels, first = np.unique(np.stack([label[left[x]], label[right[y]]], 1), axis=0, return_index=True)
    out = []
    for (u, v), k in zip(labels.tolist(), first.tolist()):
        u, v = root(u), root(v)
        if u != v:
            parent[u] = v
            out.append((int(fps[left[x[k]]]), int(fps[right[y[k]]])))
    return out


def _sorted(values: np.ndarray, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `words`, owner) of the values that are words, by place."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(words, values)
    at[at == len(words)] = 0
    mine = words[at] == values
    at, owner = at[mine], owner[mine]
    order = np.argsort(at, kind="stable")
    return at[order], owner[order]


def _ones(places: tuple[np.ndarray, np.ndarray], start: int, width: int, n: int) -> np.ndarray:
    """Which of `n` sets have which of the `width` words from `start`, as ones and zeros."""
    at, owner = places
    low, high = np.searchsorted(at, (start, start + width))
    out = np.zeros((n, width), np.float32)
    out[owner[low:high], at[low:high] - start] = 1
    return out


def ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float | None = None) -> DataFrame:
    """The rows of `docs` with one document of each near-duplicate component: its smallest id.

    Documents are linked as by `near_duplicates` and, with `similarity`, if their sets of `width`
    words are that similar. Fingerprints are the nodes that are linked, so rows that share an id but
    not a text are told apart; of rows with a component's smallest id the one with the smallest hash
    of its text stays, and of rows equal in both one. Rows without an id are kept (they can't stand
    for a component).
    """
    h = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), h.alias("h"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    found = stored(prints(rows, width)) if similarity is not None else cut(fingerprints(rows.select("doc_id", "h", "text"), extra="h"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps = cut(found.select("fp", F.col("fp").alias("rep")).distinct().repartition(parts, "fp"))
    edges = links(reps)
    if similarity is not None:
        edges = similar(rows, found, cut(edges), width, similarity)
    label = components(edges)
    classes = found.select("doc_id", "h", "fp").join(label, F.col("fp") == F.col("node"), "left").select("doc_id", "h", F.coalesce("component", "fp").alias("component"))
    winners = classes.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("w")).select(F.col("w.doc_id").alias("__keep"), F.col("w.h").alias("__hash"))
    # winners differ in (id, hash of id and text); partitioned by the hash, the repeats of a winner meet without another shuffle
    named = docs.withColumn("__own", h)
    kept = named.join(winners, (F.col("__own") == F.col("__hash")) & (F.col(id_col).cast("long") == F.col("__keep")), "left_semi").dropDuplicates([id_col, "__own"]).drop("__own")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
