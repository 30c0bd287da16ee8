"""Fixture views that give the synthetic tables the roles of the case data.

The input tables hold no nulls, so missing cells come from a left join and
from an md5 mask of the key.  Each view exists twice: as DataFrame code
(what the library runs) and as SQL text (``FIXTURE_SQL``) that the DuckDB
oracle inlines in a ``with`` clause.  ``row_id`` is unique in every view.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def _mask(prefix: str, key, n_chars: int):
    return F.substring(F.md5(F.concat(F.lit(prefix), key.cast("string"))), 1, n_chars)


def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line summary: one partial+final aggregate keyed by order."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.max("l_linestatus").alias("any_flag"),
    )


def cases_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    lines = line_summary(spark, sf_dir)
    # orders and the line summary share the order key: the aggregate's
    # partitioning is reused, only orders is shuffled for that join.
    j = (o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
          .join(c, o.o_custkey == c.c_custkey, "inner"))
    key = F.col("o_orderkey")
    out = j.select(
        key.alias("row_id"),
        F.col("o_totalprice").cast("double").alias("total_price"),
        F.col("c_acctbal").alias("acct_bal"),
        "n_lines", "sum_qty", "avg_disc",
        F.when(_mask("seg|", key, 1).isin("0", "1"), F.lit(None).cast("string"))
         .otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(_mask("rf|", key, 1) == "2", F.lit(None).cast("string"))
         .otherwise(F.col("any_flag")).alias("line_status"),
        F.col("o_orderpriority").alias("note_text"),
        F.col("o_orderstatus").alias("target_multi"),
        F.when(_mask("t|", key, 2) == "00", F.lit(None).cast("string"))
         .when(F.col("o_totalprice") > 250000, F.lit("high"))
         .otherwise(F.lit("low")).alias("target_bin"),
    )
    # fit steps scan the view several times (profile, categories, medians...):
    # keep the joined result instead of re-running the three-way join each time
    return out.persist(StorageLevel.MEMORY_AND_DISK)


def docs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("row_id"), F.col("n_chars").cast("double").alias("n_chars"),
        "lang", "source", F.col("quality").alias("target_quality"),
        F.col("toxic").alias("target_toxic"))


def emb_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), "embedding", "label")


def pred_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    h = (F.col("o_orderkey") * 7919) % 1000
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("label"),
        (h.cast("double") / F.lit(1000).cast("double")).alias("score"),
        F.when(h >= 500, 1).otherwise(0).alias("prediction"),
        F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("split"),
    )


def pred_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    t = o.select(
        k.alias("row_id"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
         .otherwise(2).alias("label"),
        (1 + (k * 7919) % 97).cast("double").alias("w0"),
        (1 + (k * 104729) % 89).cast("double").alias("w1"),
        (1 + (k * 1299709) % 83).cast("double").alias("w2"),
    )
    s = F.col("w0") + F.col("w1") + F.col("w2")
    return t.select(
        "row_id", "label",
        (F.col("w0") / s).alias("p0"), (F.col("w1") / s).alias("p1"), (F.col("w2") / s).alias("p2"),
        F.when((F.col("w0") >= F.col("w1")) & (F.col("w0") >= F.col("w2")), 0)
         .when(F.col("w1") >= F.col("w2"), 1).otherwise(2).alias("prediction"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    m = k % 6
    return o.select(
        k.alias("row_id"),
        F.when(m == 0, "1").when(m == 1, "<think>maybe 2</think> 0").when(m == 2, "label: 1.")
         .when(m == 3, "7").when(m == 4, "unsure").otherwise(F.lit(None).cast("string"))
         .alias("reply"),
        F.concat(F.lit("y_diagnosis="), (k % 3).cast("string"),
                 F.lit("; y_severity = 0; y_management=1")).alias("flags"),
    )


# Model runs: a long metrics table derived from pred_bin.  Three threshold
# "models" on two "feature sets" (score and 1 - score), per split.
RUN_MODELS = (("t30", 0.3), ("t50", 0.5), ("t70", 0.7))


def run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pred_bin(spark, sf_dir)
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).cast("double").alias("thr"))
                       for m, t in RUN_MODELS])
    feats = F.array(F.struct(F.lit("full").alias("features"), F.col("score").alias("s")),
                    F.struct(F.lit("selected").alias("features"),
                             (F.lit(1.0) - F.col("score")).alias("s")))
    x = (p.select("row_id", "label", "split", F.explode(models).alias("m"), "score")
          .select("row_id", "label", "split", "m.model", "m.thr", F.explode(feats).alias("f")))
    return x.select(
        F.lit("bin").alias("target"), F.col("f.features").alias("features"), "model", "split",
        "row_id", "label",
        F.when(F.col("f.s") >= F.col("thr"), 1).otherwise(0).alias("prediction"),
        F.col("f.s").alias("score"))


FIXTURE_SQL = {
    "cases_raw": """
select o.o_orderkey as row_id, cast(o.o_totalprice as double) as total_price, c.c_acctbal as acct_bal,
  l.n_lines, l.sum_qty, l.avg_disc,
  case when substr(md5(concat('seg|', cast(o.o_orderkey as string))), 1, 1) in ('0', '1') then null
       else c.c_mktsegment end as segment,
  case when substr(md5(concat('rf|', cast(o.o_orderkey as string))), 1, 1) = '2' then null
       else l.any_flag end as line_status,
  o.o_orderpriority as note_text, o.o_orderstatus as target_multi,
  case when substr(md5(concat('t|', cast(o.o_orderkey as string))), 1, 2) = '00' then null
       when o.o_totalprice > 250000 then 'high' else 'low' end as target_bin
from orders o join customer c on o.o_custkey = c.c_custkey
left join (select l_orderkey, cast(count(*) as double) as n_lines, sum(l_quantity) as sum_qty,
             round(avg(l_discount), 6) as avg_disc, max(l_linestatus) as any_flag
           from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey""",
    "docs_raw": """
select d.doc_id as row_id, cast(d.n_chars as double) as n_chars, d.lang, d.source,
  l.quality as target_quality, l.toxic as target_toxic
from documents d left join labels l on d.doc_id = l.doc_id""",
    "emb_raw": "select vec_id as row_id, embedding, label from embeddings",
    "pred_bin": """
select o_orderkey as row_id, case when o_totalprice > 250000 then 1 else 0 end as label,
  cast((o_orderkey * 7919) % 1000 as double) / cast(1000 as double) as score,
  case when (o_orderkey * 7919) % 1000 >= 500 then 1 else 0 end as prediction,
  case when o_orderkey % 5 = 0 then 'test' else 'train' end as split
from orders""",
    "pred_multi": """
select row_id, label, w0 / (w0 + w1 + w2) as p0, w1 / (w0 + w1 + w2) as p1, w2 / (w0 + w1 + w2) as p2,
  case when w0 >= w1 and w0 >= w2 then 0 when w1 >= w2 then 1 else 2 end as prediction
from (select o_orderkey as row_id,
        case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as label,
        cast(1 + (o_orderkey * 7919) % 97 as double) as w0,
        cast(1 + (o_orderkey * 104729) % 89 as double) as w1,
        cast(1 + (o_orderkey * 1299709) % 83 as double) as w2
      from orders) t""",
    "replies": """
select o_orderkey as row_id,
  case o_orderkey % 6 when 0 then '1' when 1 then '<think>maybe 2</think> 0' when 2 then 'label: 1.'
       when 3 then '7' when 4 then 'unsure' else null end as reply,
  concat('y_diagnosis=', cast(o_orderkey % 3 as string), '; y_severity = 0; y_management=1') as flags
from orders""",
    "run_predictions": """
select 'bin' as target, f.features, m.model, p.split, p.row_id, p.label,
  case when (case when f.features = 'full' then p.score else 1.0 - p.score end) >= m.thr then 1 else 0 end
    as prediction,
  case when f.features = 'full' then p.score else 1.0 - p.score end as score
from pred_bin p,
  (select unnest(['t30', 't50', 't70']) as model, unnest([0.3, 0.5, 0.7])::double as thr) m,
  (select unnest(['full', 'selected']) as features) f""",
}

FIXTURE_DEPS = {"run_predictions": ("pred_bin",)}


def with_clause(*names: str) -> str:
    """``with`` clause defining the named fixture views (dependencies first)."""
    ordered: list[str] = []
    for n in names:
        for d in FIXTURE_DEPS.get(n, ()):
            if d not in ordered:
                ordered.append(d)
        if n not in ordered:
            ordered.append(n)
    return "with " + ",\n".join(f"{n} as ({FIXTURE_SQL[n]})" for n in ordered) + "\n"
