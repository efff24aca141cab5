import random

from rallyframe.llm import chat
from tests.llm.oracle import same


def test_cases(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 0, "user", "a <| \\ <\\| <\\\\|"), (1, 1, "assistant", None), (1, 3, "assistant", "<"), (1, 4, "user", "|\n<|im_part|>"),
        (None, 0, "us er\n<|", "null id"), (2, None, None, ""), (2, 0, "system", "x" * 200_000), (2, 0, "system", "x" * 200_000), (3, 0, "assistant", "é🎾<|im_end|>\n"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, turns int")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for c in got:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got[c].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert got[1].formatted.count("<|im_start|>") == 3 and got[1].formatted.count("<|im_part|>") == 2
    assert chat.formatted(df.limit(0)).count() == 0


def test_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        assert same(chat.query(spark, path), chat.SQL, path) > 1


def test_long_and_nameless_conversations(spark):
    """Many turns of one conversation, and many without any id, which are one too."""
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["", "a<|b", "long " * 20, "é"])) for c in (1, None) for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.read_back(chat.formatted(df)).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.turns] == [x[2:] for x in own]
        assert r.loss == "".join(x[3] for x in own if x[2] == "assistant")


def test_turns_are_merged_in_the_array(spark):
    plan = chat.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
