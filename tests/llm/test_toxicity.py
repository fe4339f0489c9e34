import zlib

from pyspark.sql import functions as F

from orrery.llm import queries, toxicity
from orrery.llm.common import held, remainder

LEXICON = {"idiot": 4.0, "scum": 4.0}


def only(text):
    found = toxicity.clauses(text, LEXICON)
    assert len(found) == 1
    return found[0][0]


def test_clauses():
    assert toxicity.clauses("A quiet day. Nothing at all.", LEXICON) == []
    plain = only("the idiot left.")
    assert only("you idiot!") == plain * toxicity.AIMED
    assert only("not an idiot.") == plain * toxicity.NEGATED
    assert only("not a nice and warm idiot.") == plain  # out of the negation's reach
    assert only("the paper said idiot.") == plain * toxicity.REPORTED
    assert only('so "idiot" it was.') == plain * toxicity.REPORTED
    assert toxicity.clauses("kill.", LEXICON) == []
    assert only("we kill you kill.") == toxicity.THREAT * toxicity.AIMED
    two = toxicity.clauses("idiot. scum", LEXICON)
    assert [n for _, n in two] == [1, 1]


def test_held_out_accuracy(spark, sf_dir, duck):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op4_toxicity(spark, sf).toPandas()
    truth = duck.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").df().merge(got, on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    out = truth[truth["held_out"]]
    assert ((out["predicted"] == 1) == (out["toxic"] == 1)).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_labels_of_held_out_rows_are_never_read(spark, docs, labels):
    usable = F.coalesce(remainder("__id", 3) != 1, F.lit(False))
    turned = labels.withColumn("toxic", F.when(held("doc_id", 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels, usable) == toxicity.fit(docs, turned, usable)


def test_odd_rows(odd_docs, no_docs, labels):
    usable = F.lit(True)
    odd = labels.sparkSession.createDataFrame([(1, None, 1), (2, None, 1), (6, None, 0), (7, None, 0), (8, None, None), (None, None, 1), (5, 0, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    grammar = toxicity.fit(odd_docs, odd, usable)
    rows = toxicity.score(odd_docs, grammar).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.fit(no_docs, odd, usable) == toxicity.Grammar()
    assert toxicity.score(no_docs, grammar).count() == 0
    kept = toxicity.keep_clean(odd_docs, toxicity.Grammar(LEXICON, [-3.0, 2.0, 0.0, 0.0]))
    assert kept.columns == odd_docs.columns and kept.where("text like 'You idiot%'").count() == 0
    assert kept.count() == odd_docs.count() - 3


def test_copies_count_once(spark):
    """A word that only copies of one toxic text hold is no evidence."""
    w = ["".join(chr(97 + (k // 26**i) % 26) for i in range(3)) + "x" for k in range(80)]
    rows = [(k, "rare words here idiot again", 1) for k in range(20)] + [(20 + k, f"{w[k]} idiot {w[k + 1]} {w[k + 2]}", 1) for k in range(20)] + [(40 + k, f"{w[k]} fine {w[k + 1]} here again", 0) for k in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert set(toxicity.fit(docs, labels, F.lit(True)).lexicon) == {"idiot"}


def test_threats_before_their_target():
    assert only("I will kill you.") == only("you I will kill.") == toxicity.THREAT * toxicity.AIMED
    assert only("we will hurt them and burn him!") == 2 * toxicity.THREAT * toxicity.AIMED
    assert only("I will not kill you.") == toxicity.THREAT * toxicity.NEGATED * toxicity.AIMED
    assert toxicity.clauses("we kill time. you may go.", LEXICON) == []
    assert toxicity.features("ich will dich töten", {}) == toxicity.features("ich will töten dich", {}) != (0.0, 0.0, 0.0)


def test_the_composed_automaton_against_its_transducers():
    """Every transducer run by itself over random clauses, weights multiplied, against the composed one."""
    import random

    rng = random.Random(3)
    words = {toxicity.INSULT: "idiot", toxicity.THREATEN: "kill", toxicity.TARGET: "you", toxicity.NEGATION: "not", toxicity.SAY: "said", toxicity.QUOTE: '"', toxicity.OTHER: "house"}
    for _ in range(2000):
        path = [rng.choice(list(words)) for _ in range(rng.randrange(1, 9))]
        parts = toxicity.transducers()
        states = [t.start for t in parts]
        insults, n, threats = 0.0, 0, []
        for symbol in path:
            weight = 1.0
            for k, t in enumerate(parts):
                states[k], w = t.step(states[k], symbol)
                weight *= w
            if symbol == toxicity.INSULT:
                insults, n = insults + 4.0 * weight, n + 1
            elif symbol == toxicity.THREATEN:
                threats.append(weight)
        aim = {kind: 1.0 for kind in (toxicity.INSULT, toxicity.THREATEN)}
        for state, t in zip(states, parts):
            for kind in aim:
                aim[kind] *= t.final.get((state, kind), 1.0)
        counted = max(threats, default=0.0) * aim[toxicity.THREATEN]
        expected = [(insults * aim[toxicity.INSULT] + counted, n + bool(counted))] if n or counted else []
        found = toxicity.clauses(" ".join(words[s] for s in path), LEXICON)
        assert [(round(s, 9), k) for s, k in found] == [(round(s, 9), k) for s, k in expected], path


def test_contractions():
    assert only("don't be an idiot.") == only("don’t be an idiot.") == only("not be an idiot.")
    assert only("you're an idiot!") == only("you idiot!")
    assert only("I'm going to kill you tonight!") == toxicity.THREAT * toxicity.AIMED
    assert only("t'es idiot.") == only("te es idiot.") and only("n'est idiot") == only("ne est idiot")
