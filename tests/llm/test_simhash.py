import random
import re

import xxhash
from pyspark.sql import functions as F

from orrery.llm import queries, simhash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest id reachable over pairs within two bits, by comparing all with all."""
    ids = [i for i, _ in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if bin(rows[a][1] ^ rows[b][1]).count("1") <= 2:
                label[root(a)] = root(b)
    least = {}
    for k in range(len(rows)):
        if ids[k] is not None:
            least[root(k)] = min(ids[k], least.get(root(k), ids[k]))
    return [least.get(root(k)) for k in range(len(rows))]


def test_query_against_brute_force(spark, sf_dir, texts):
    rows = sorted(texts.items())
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    expected = {i: (f"{f:016x}", c) for (i, f), c in zip(fps, plain_components(fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == expected


def test_hash_is_the_engine_s_own(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two three", 42)


def linked(spark, values):
    reps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "fp long, rep long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(reps)).collect()}
    return [found.get(i, i) for i in range(len(values))]


def test_links_of_random_clusters(spark):
    rng = random.Random(4)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(10):
            values.add(v)
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    values = sorted(values)
    assert linked(spark, values) == plain_components(list(enumerate(values)))


def test_long_lists_are_linked_exactly(spark):
    # 300 fingerprints that differ in two bytes only meet in one posting list
    rng = random.Random(5)
    base = rng.getrandbits(64) & ~0xFFFF
    values = sorted({base | rng.getrandbits(16) for _ in range(300)} | {base ^ (1 << 40) ^ 0x5555 ^ base & 0xFFFF})
    assert linked(spark, values) == plain_components(list(enumerate(values)))


def test_a_chain_is_one_component(spark):
    values = [0]
    for k in range(40):
        values.append(values[-1] ^ (1 << (k + 20)))
    assert set(linked(spark, values)) == {0}


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {3}
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 6, 7, 8]
    assert kept.where("doc_id is null").count() == 2


def test_similar_texts_are_one_component(spark):
    """Five-word similarity of 0.8 links texts whose fingerprints differ in more than two bits."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    near, far = [*words[:-5], *"other words at the end".split()], [*words[:30], *"quite another text from here on".split()]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, "")], "doc_id long, text string")
    prints = [simhash.fingerprint(" ".join(t).encode()) for t in (words, near)]
    assert bin(prints[0] ^ prints[1]).count("1") > 2
    assert {r["doc_id"] for r in simhash.keep_one(docs, similarity=0.8).collect()} == {1, 3, 4}


def test_repeated_ids_with_different_texts_lose_no_text(spark):
    """Two rows of one id with texts of their own are two documents; equal rows are one."""
    one, two = "the first text of this id has its own words", "and here stands something else for the same number entirely"
    docs = spark.createDataFrame([(1, one), (1, two), (2, one), (1, two), (None, one)], "doc_id long, text string")
    for similarity in (None, 0.8):
        kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs, similarity=similarity).collect()), key=str)
        assert kept == sorted([(1, one), (1, two), (None, one)], key=str)


def plain_survivors(texts, similarity=0.8, width=5):
    """Smallest id of every component over fingerprints within two bits or shingle sets that similar, all compared with all."""
    ids = sorted(texts)
    words = {i: (texts[i] or "").encode().lower().split() for i in ids}
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for i, w in words.items()}
    prints = {i: plain_fingerprint(texts[i]) for i in ids}
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and root(a) != root(b):
                both = len(sets[a] & sets[b])
                if bin(prints[a] ^ prints[b]).count("1") <= 2 or (both and both >= similarity * (len(sets[a]) + len(sets[b]) - both)):
                    low, high = sorted((root(a), root(b)))
                    label[high] = low
    return {root(i) for i in ids}


def test_near_copies_against_brute_force(spark, docs, texts):
    kept = {r["doc_id"] for r in simhash.keep_one(docs, similarity=0.8).collect()}
    assert kept == plain_survivors(texts)


def test_a_large_group_of_near_copies(spark):
    """Chains of similar texts, and many copies that differ in a word, against all pairs."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    texts, chain = {}, list(base)
    for k in range(60):
        texts[k] = " ".join([*base[:-1], f"end{k}"])
    for k in range(60, 80):
        chain[(k - 60) * 4] = f"new{k}"
        texts[k] = " ".join(chain)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs, similarity=0.8).collect()} == plain_survivors(texts)
