from pyspark.sql import functions as F

from momentloom.llm import chat


def formatted(spark, rows, **more):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns, **more)
    return {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                                             chat.masked_text(F.col("segments")).alias("loss"), "segments").collect()}


def test_runs_merge_and_turns_come_back(spark):
    nasty = "\\### Assistant: </turn> ok</part>\n### User: x\\"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", nasty), (1, 3, "user", None),
            (2, 0, None, ""), (2, 0, "as:sis\\tant#", nasty), (3, None, "assistant", "first"), (3, -9, "user", "then"),
            (None, 0, "user", "x"), (4, 5, "assistant", "same"), (4, 5, "assistant", "same")]
    got = formatted(spark, rows)
    assert got[1].formatted == ("### user: a</turn>\n### assistant: b</part>" + nasty.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")
                                + "</turn>\n### user: </turn>\n")
    assert [tuple(t) for t in got[1].turns] == [("user", "a"), ("assistant", "b"), ("assistant", nasty), ("user", "")]
    assert got[1].loss == "b" + nasty
    assert [tuple(t) for t in got[2].turns] == [("", ""), ("as:sis\\tant#", nasty)]
    assert [t.text for t in got[3].turns] == ["first", "then"] and got[3].loss == "first"
    assert got[None].turns[0].text == "x" and got[4].loss == "samesame" and len(got[4].turns) == 2
    for r in got.values():
        assert "".join(s.text for s in r.segments) == r.formatted


def test_blocks_join_without_a_trace(spark):
    rows = [(1, i, "user" if i % 7 < 3 else "assistant", f"t{i}" * (i % 3)) for i in range(200)]
    small, large = formatted(spark, rows, block_turns=4)[1], formatted(spark, rows, block_turns=1000)[1]
    assert small.formatted == large.formatted and small.loss == large.loss
    assert [t.text for t in small.turns] == [r[3] for r in rows]


def test_empty_table_and_native_plan(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
