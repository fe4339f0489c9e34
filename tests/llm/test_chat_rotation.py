from comparing import same

from orrery.llm import queries
from orrery.llm.chat_rotation import rotate

TURNS = "conv_id long, turn long, role string, text string"


def test_against_sql(spark, sf_dir, duck):
    assert same(queries.op1_chat_rotation(spark, sf_dir).toPandas(), duck.sql(queries.SQL["op1_chat_rotation"]).df())


def test_every_participant_speaks_as_the_assistant(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello"), (1, 3, "ann", "Bye")]
    got = {r["speaker"]: r for r in rotate(spark.createDataFrame(rows, TURNS)).collect()}
    assert set(got) == {"ann", "bob"}
    ann = got["ann"]
    assert ann["dialogue"] == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user:bob|>\nHello<|end|>\n<|assistant|>\nBye<|end|>\n"
    assert [ann["dialogue"][m["start"] : m["end"]] for m in ann["masks"]] == ["Hi<|end|>\n", "Bye<|end|>\n"]
    bob = got["bob"]
    assert [bob["dialogue"][m["start"] : m["end"]] for m in bob["masks"]] == ["Hello<|end|>\n"]


def test_parts_join_to_the_whole(spark):
    rows = [(1, k, "ab"[k % 2], f"t{k}") for k in range(200)]
    parts = rotate(spark.createDataFrame(rows, TURNS)).where("speaker = 'a'").orderBy("part").collect()
    assert [p["n_turns"] for p in parts] == [64, 64, 64, 8]
    whole = "".join(p["dialogue"] for p in parts)
    assert whole.count("<|assistant|>") == whole.count("<|user:b|>") == 100
    assert sum(len(p["masks"]) for p in parts) == 100


def test_odd_rows(spark):
    rows = [(None, 0, "a", "x"), (2, None, None, None), (2, 1, "b", None), (2, 1, "b", None), (3, 0, "system", "only")]
    got = rotate(spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as part", "2 as speaker", "3 as ts", "4 as pieces")).collect()
    assert {(r["conv_id"], r["speaker"], r["part"]) for r in got} == {(None, "a", 0), (2, "unknown", 0), (2, "unknown", None), (2, "b", 0), (2, "b", None)}
    both = next(r for r in got if (r["speaker"], r["part"]) == ("b", 0))
    assert both["n_turns"] == 2 and len(both["masks"]) == 2
    assert rotate(spark.createDataFrame([], TURNS)).count() == 0
