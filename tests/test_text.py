"""Reply parsing and prompt text on hand-made replies."""

from pyspark.sql import functions as F

from nullwise.functions import text as TX
from nullwise.operators import prompts as G


def test_strip_think_and_parse(spark):
    rows = [("<think>a</think> 1",), ("<think>no end 2",), ("x <think>a</think> y <think>b</think> 0",),
            ("  -1 then 2 ",), ("none",), (None,), ("\n 2\t",)]
    df = spark.createDataFrame(rows, "reply string")
    out = G.parse_replies(df, "reply", [0, 1, 2], default=1).collect()
    assert [r["clean"] for r in out] == ["1", "<think>no end 2", "x  y <think>b</think> 0", "-1 then 2",
                                         "none", None, "2"]
    assert [r["parsed"] for r in out] == [1, 2, 0, 1, 1, 1, 2]


def test_parse_flags(spark):
    df = spark.createDataFrame([("y_diagnosis=1; y_severity = 7; y_management=0",), ("garbage",), (None,)], "t string")
    out = G.parse_flags(df, "t").collect()
    assert [(r["y_diagnosis"], r["y_severity"], r["y_management"]) for r in out] == \
        [(1.0, 1.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_case_text_missing_and_dictionary(spark):
    df = spark.createDataFrame([(1, 2.5, None, "a"), (2, None, 3.0, None)], "row_id int, x double, y double, s string")
    out = G.case_text(df, ["x", "y", "s"], {"x": "the x"}).orderBy("row_id").collect()
    assert out[0]["case_text"] == "x (the x) = 2.5; y = missing; s = a"
    assert out[1]["case_text"] == "x (the x) = missing; y = 3.0; s = missing"


def test_request_json_round_trip(spark):
    df = spark.createDataFrame([('say "hi"\n',)], "p string")
    body = df.select(TX.request_json(F.col("p"), "m", temperature=0.5).alias("b")).first()["b"]
    import json
    d = json.loads(body)
    assert d["messages"][1]["content"] == 'say "hi"\n' and d["temperature"] == 0.5 and d["stream"] is False


def test_score_rows_failures(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "row_id int, prompt string")

    def scorer(prompts):
        if any(p.endswith("3") for p in prompts):
            if len(prompts) > 1:
                raise RuntimeError("batch failed")
            raise ValueError("bad row")
        return [str(len(p)) for p in prompts]

    out = {r["row_id"]: (r["reply"], r["error"]) for r in G.score_rows(df, scorer, partitions=3).collect()}
    assert len(out) == 20
    assert out[3][0] is None and "bad row" in out[3][1] and out[13][0] is None
    assert out[5] == ("2", None)


def test_score_rows_other_number_of_replies(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(4)], "row_id int, prompt string")
    out = G.score_rows(df, lambda prompts: ["1"] if len(prompts) > 1 or prompts[0] != "p2" else [], partitions=1)
    got = {r["row_id"]: (r["reply"], r["error"]) for r in out.collect()}
    assert got[0] == got[1] == got[3] == ("1", None)
    assert got[2][0] is None and "0 replies" in got[2][1]


def test_whole_numbers_in_prompts(spark):
    values = [0.0, 12.0, -3.25, 123456.7890123, 1e-7, 0.00012, 12345678.9, 1e15, 1e16, -2.5e-9, 1.25e300, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r["t"] for r in df.select(TX.number_text(F.col("x")).alias("t")).collect()] == [repr(v) for v in values]


def test_evidence_of_a_model_without_probability(spark):
    df = spark.createDataFrame([(1, "a", 1, "high", 0.25), (1, "b", 0, "low", None)],
                               "row_id int, model string, pred_id int, label_name string, probability double")
    text = G.evidence_text(df).first()["evidence_text"]
    assert "- a: predicted 1 (high), probability = 0.250\n- b: predicted 0 (low)\n" in text


def test_flags_of_any_length(spark):
    from nullwise.functions.text import parse_flag
    rows = [("a = " + "9" * 39, 1.0), ("a=" + "0" * 50, 0.0), ("a = 0" + "0" * 40 + "7", 1.0), ("a = 10", 1.0), ("a=0", 0.0), ("b=1", 0.0), (None, 0.0)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = df.select("i", parse_flag(df.t, "a").alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [w for _, w in rows]


def test_score_rows_calls_side_by_side_in_order(spark):
    import time

    def slow(prompts):
        time.sleep(0.5)
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, f"p{i}") for i in range(16)], "row_id int, prompt string").coalesce(1)
    G.score_rows(df, lambda p: p).collect()  # workers are up
    start = time.monotonic()
    out = G.score_rows(df, slow, calls=8, call_rows=1).collect()
    assert time.monotonic() - start < 5.0  # 8 s one after another
    assert [(r["row_id"], r["reply"], r["error"]) for r in out] == [(i, f"P{i}", None) for i in range(16)]


def test_score_rows_leaves_a_hanging_call(spark):
    import time

    def hangs(prompts):
        if "p3" in prompts:
            time.sleep(3600)
        return prompts

    df = spark.createDataFrame([(i, f"p{i}") for i in range(8)], "row_id int, prompt string").coalesce(1)
    start = time.monotonic()
    out = G.score_rows(df, hangs, calls=4, call_rows=2, limit_s=1.0).collect()
    assert time.monotonic() - start < 30
    assert [r["reply"] for r in out] == [None if i == 3 else f"p{i}" for i in range(8)]
    assert out[3]["error"].startswith("TimeoutError")
