import hashlib

from foldwright.llm import chat
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    compare(chat.op1_chat_prefix_targets(spark, SF), chat.ORACLE_SQL, database(SF))


def test_each_assistant_turn_is_an_example(spark):
    rows = [(1, 0, "user", "q1", 9), (1, 1, "assistant", "a1", 9), (1, 2, "user", "q2", 9), (1, 3, "assistant", "a2", 9), (2, 0, "user", "alone", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    got = {(r.conv_id, r.example): r for r in chat.expand(df).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0)]
    for (c, e), want in {(1, 0): "a1", (1, 1): "a2", (2, 0): ""}.items():
        r = got[c, e]
        assert r.formatted[r.loss_start : r.loss_end] == want
    assert got[1, 1].formatted.startswith(got[1, 0].formatted)


def test_control_strings_and_edges_read_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>\\s<\\s>", "[\\INST]<s", "</s", "", None, "😀</s>"]
    rows = [(i, j, r, t) for i, t in enumerate(texts) for j, r in enumerate(["user", "assistant", None])]
    rows += [(50, 0, "assistant", "same"), (50, 0, "assistant", "same"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    for i, t in enumerate(texts):
        assert [(x.role, x.text) for x in got[i].turns] == [("user", t or ""), ("assistant", t or ""), ("", t or "")]
        assert got[i].loss_text == (t or "")
    assert got[50].loss_text == "samesame" and len(got[50].turns) == 2 and len(got[None].turns) == 1
    examples = chat.expand(df)
    for r in examples.where("conv_id = 0").collect():
        body = r.formatted[len(chat.OPEN) :]
        assert hashlib.sha256(body.encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.expand(df)).count() == 0
