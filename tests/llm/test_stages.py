from nullwise.llm import stages


def test_near_dedup_takes_five_word_shingles(spark):
    base = [f"w{i}" for i in range(60)]
    one, two = list(base), list(base)
    one[30] = "x"  # on five words 51 of 61 (0.836)
    two[20], two[40] = "y", "z"  # on four words 49 of 65 (0.754), on five 46 of 66
    short = [f"v{i}" for i in range(45)]
    changed = list(short)
    changed[22] = "x"  # on four words 38 of 46 (0.826), on five 36 of 46 (0.783)
    rows = [(i, " ".join(w)) for i, w in enumerate((base, one, two, short, changed, short))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in stages.near_dedup(spark, docs, "").collect()) == [0, 2, 3, 4]


def test_near_dedup_leaves_the_texts_in_place(spark):
    """Dropped ids are broadcast whatever Spark's own threshold, so that the texts are not shuffled."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}_{j}" for j in range(9))) for i in range(8)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stages.near_dedup(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in out.collect()) == [0, 2, 4, 6]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
