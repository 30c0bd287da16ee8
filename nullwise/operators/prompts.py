"""Prompt data preparation, reply parsing and routing.

The chat model itself is outside Spark: callers pass a ``scorer`` (a
function from a list of prompt strings to a list of reply strings) that
``score_rows`` runs inside ``mapInPandas`` batches.  Everything around it is
DataFrame work: texts are built with Spark string functions, replies are
parsed with regular expressions, committee uncertainty and routing are
aggregates and joins keyed by ``row_id``.
"""

from __future__ import annotations

import threading
import time
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import exact_quantiles
from ..functions.text import (MISSING_TOKEN, number_text, parse_flag, parse_label, strip_think,
                              value_text)
from .columns import column_kinds

# ---------------------------------------------------------------------------
# Prompt wording that must read exactly as in the source
# pipeline (single-target classifier prompt, few-shot blocks, evidence block).
# ---------------------------------------------------------------------------
ROLE_TEXT = ("You are a pediatric emergency surgeon. "
             "You will see clinical features of one child, and you must predict "
             "the label for the target: \"{target}\".\n")
MAPPING_INTRO = "The target is encoded as integer labels. The meaning of each label is:"
EXAMPLES_HEADER = "Here are some example patients and their correct labels:\n\n"
EVIDENCE_HEADER = ("Here are predictions from several baseline machine learning models "
                   "trained on the same training data:\n")
NEW_CASE = ("Now here is a NEW patient (different from all the examples above).\n\n"
            "The features and their values of THIS child are:\n\n")
ALLOWED = "Possible labels you are allowed to output are: [{ids}].\n\n"
ANSWER = ("Please output ONLY a single integer from [{ids}] as your prediction,\n"
          "with no extra words, no explanation.\n")
FLAG_NAMES = ("y_diagnosis", "y_severity", "y_management")
ROUTED_HIGH, ROUTED_LOW = 0.999, 0.001
# ---------------------------------------------------------------------------


def case_text(df: DataFrame, cols: list[str], dictionary: dict[str, str] | None = None,
              missing: str = MISSING_TOKEN, out: str = "case_text") -> DataFrame:
    """G1: ``name (explanation) = value`` joined by '; ', nulls as the missing token.

    Names and explanations are fixed when the plan is built (the dictionary
    is a small driver-side map, see ``sources.io.load_dictionary``).
    """
    kinds = column_kinds(df, cols)
    dictionary = dictionary or {}
    parts = []
    for c in cols:
        desc = dictionary.get(c)
        name = f"{c} ({desc})" if desc else c
        parts.append(F.concat(F.lit(name + " = "), value_text(F.col(c), kinds.get(c) == "numeric", missing)))
    return df.withColumn(out, F.concat_ws("; ", *parts))


def legend_text(label_map: DataFrame) -> DataFrame:
    """Per target, '<code> = <label>' lines in code order."""
    g = label_map.groupBy("target").agg(
        F.sort_array(F.collect_list(F.struct("code", "label"))).alias("_m"))
    return g.select("target", F.array_join(F.transform(
        "_m", lambda x: F.concat(x["code"].cast("string"), F.lit(" = "), x["label"])), "\n").alias("legend"))


def example_text(examples: DataFrame, target: str) -> DataFrame:
    """The few-shot block.  ``examples`` has (label, rank, label_name, case_text).

    Examples are bounded by ``cap_examples``; the ordered list is one small group.
    """
    ex = examples.select(F.struct("label", "rank", "label_name", "case_text").alias("e"))
    g = ex.agg(F.sort_array(F.collect_list("e")).alias("_e"))
    blocks = F.transform("_e", lambda e, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit(":\nFeatures: "), e["case_text"],
        F.lit(f"\nCorrect label for {target}: "), e["label"].cast("string"), F.lit(" ("),
        e["label_name"], F.lit(")\n")))
    text = F.when(F.size("_e") > 0, F.concat(F.lit(EXAMPLES_HEADER), F.array_join(blocks, "\n"), F.lit("\n"))) \
            .otherwise(F.lit(""))
    return g.select(text.alias("examples_text"))


def evidence_text(predictions: DataFrame, key: str = "row_id") -> DataFrame:
    """Per row, one line per baseline model, models in name order.

    ``predictions`` has (row_id, model, pred_id, label_name, probability);
    a model that gives only a label has a null probability and no such part;
    each group holds one row per model (bounded by the committee size).
    """
    line = F.concat(F.lit("- "), F.col("model"), F.lit(": predicted "), F.col("pred_id").cast("string"),
                    F.lit(" ("), F.col("label_name"), F.lit(")"),
                    F.when(F.col("probability").isNotNull(), F.concat(
                        F.lit(", probability = "), F.format_string("%.3f", F.col("probability")))).otherwise(F.lit("")))
    g = (predictions.select(key, F.struct("model", line.alias("line")).alias("x"))
         .groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("_l")))
    return g.select(key, F.concat(F.lit(EVIDENCE_HEADER),
                                  F.array_join(F.transform("_l", lambda x: x["line"]), "\n"),
                                  F.lit("\n")).alias("evidence_text"))


def build_prompts(df: DataFrame, target: str, legend: str, class_ids: list[int],
                  examples: str = "", evidence_col: str | None = None,
                  case_col: str = "case_text", role: str | None = None) -> DataFrame:
    """The single-target prompt.  ``legend`` and ``examples`` are plan constants."""
    ids = ", ".join(str(i) for i in class_ids)
    role_text = role.strip() if role is not None else ROLE_TEXT.format(target=target)
    evidence = F.coalesce(F.col(evidence_col), F.lit("")) if evidence_col else F.lit("")
    prompt = F.concat(
        F.lit(f"\n{role_text}\n\n{MAPPING_INTRO}\n\n{legend}\n\n"), evidence,
        F.lit(f"\n{examples}\n{NEW_CASE}"), F.col(case_col),
        F.lit("\n\n" + ALLOWED.format(ids=ids) + ANSWER.format(ids=ids)))
    return df.withColumn("prompt", prompt)


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """Most frequent class, the smaller one on ties (one row)."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return c.orderBy(F.desc("n"), F.asc(label)).limit(1)


def parse_replies(df: DataFrame, reply: str, classes: list[int], default: int,
                  think: bool = True) -> DataFrame:
    """G9 + G10: cleaned reply and parsed label."""
    c = strip_think(F.col(reply)) if think else F.col(reply)
    return df.withColumn("clean", c).withColumn("parsed", parse_label(F.col("clean"), classes, default))


def parse_flags(df: DataFrame, col: str, names=FLAG_NAMES) -> DataFrame:
    """The three 0/1 risk flags."""
    return df.withColumns({n: parse_flag(F.col(col), n) for n in names})


def _called(scorer: Callable, groups: list[list[str]], limit_s: float | None) -> list[list[str | None] | Exception]:
    """Replies to each group of prompts, asked side by side; what failed or took longer than limit_s is an exception.

    A call that hangs is left behind in a daemon thread: it neither holds up
    the others nor the end of the worker.
    """
    found: list = [TimeoutError(f"no reply within {limit_s} s")] * len(groups)

    def ask(at: int) -> None:
        try:
            replies = [None if r is None else str(r) for r in scorer(groups[at])]
            if len(replies) != len(groups[at]):
                raise ValueError(f"{len(replies)} replies to {len(groups[at])} prompts")
            found[at] = replies
        except Exception as e:  # noqa: BLE001 - told per row
            found[at] = e

    threads = [threading.Thread(target=ask, args=(at,), daemon=True) for at in range(len(groups))]
    for t in threads:
        t.start()
    end = None if limit_s is None else time.monotonic() + limit_s
    for t in threads:
        t.join(None if end is None else max(0.0, end - time.monotonic()))
    return list(found)


def score_rows(df: DataFrame, scorer: Callable[[list[str]], list[str]], prompt: str = "prompt",
               key: str = "row_id", partitions: int | None = None, calls: int = 4, call_rows: int = 256,
               limit_s: float | None = None, retries: int = 1) -> DataFrame:
    """Run ``scorer`` on groups of prompts inside executors: (key, reply, error), in the order of the rows.

    A task keeps up to ``calls`` calls of ``call_rows`` prompts in flight.  A
    call that fails, gives another number of replies or takes longer than
    ``limit_s`` seconds is retried row by row, each row ``retries`` times; a
    row that still fails gets a null reply and its error text (defaults are
    applied by the parser, so a failed call never fails the task).
    ``partitions`` spreads the calls evenly.  The scorer must be safe to call
    from several threads; ``calls=1`` never has two in flight.
    """
    src = df.select(key, prompt)
    if partitions:
        src = src.repartition(partitions, key)

    def in_turns(groups: list[list[str]]) -> list:
        return [r for at in range(0, len(groups), calls) for r in _called(scorer, groups[at:at + calls], limit_s)]

    def run(batches):
        for pdf in batches:
            prompts = pdf[prompt].tolist()
            groups = [prompts[at:at + call_rows] for at in range(0, len(prompts), call_rows)]
            rows = []
            for group, found in zip(groups, in_turns(groups)):
                rows += [found] * len(group) if isinstance(found, Exception) else [[r] for r in found]
            for _ in range(retries):
                open_rows = [i for i, r in enumerate(rows) if isinstance(r, Exception)]
                for i, found in zip(open_rows, in_turns([[prompts[i]] for i in open_rows])):
                    rows[i] = found
            failed = [isinstance(r, Exception) for r in rows]
            yield pd.DataFrame({key: pdf[key], "reply": [None if f else r[0] for r, f in zip(rows, failed)],
                                "error": [f"{type(r).__name__}: {r}" if f else None for r, f in zip(rows, failed)]})

    kt = dict(src.dtypes)[key]
    return src.mapInPandas(run, f"{key} {kt}, reply string, error string")


def uncertainty(probs: DataFrame, key: str = "row_id", prob_col: str = "probs") -> DataFrame:
    """1 - mean over committee models of each model's top class probability.

    ``probs`` is long: (row_id, model, probs array<double>); grouped by row.
    """
    return (probs.groupBy(key).agg(F.avg(F.array_max(prob_col)).alias("_m"))
            .select(key, F.round(1 - F.col("_m"), 10).alias("uncertainty")))


def boundary_threshold(unc: DataFrame, q: float = 0.2, col: str = "uncertainty") -> DataFrame:
    """The (1 - q) quantile of the uncertainties (linear interpolation, exact)."""
    t = exact_quantiles(unc, [], col, [1.0 - q])
    return t.select(F.round("value", 10).alias("threshold"))


def route(base: DataFrame, alt: DataFrame, unc: DataFrame, threshold: float, n_classes: int,
          key: str = "row_id") -> DataFrame:
    """Base prediction unless uncertainty > threshold, then the alternate one.

    Routed rows get near one-hot probabilities (0.999 for the chosen class).
    ``base`` has (row_id, prediction, p0..p{K-1}); ``alt`` has (row_id, prediction).
    """
    j = (base.join(unc, key, "left")
         .join(alt.select(key, F.col("prediction").alias("_alt")), key, "left"))
    routed = F.coalesce((F.col("uncertainty") > F.lit(threshold)) & F.col("_alt").isNotNull(),
                        F.lit(False))
    pred = F.when(routed, F.col("_alt")).otherwise(F.col("prediction"))
    probs = {f"p{c}": F.when(routed, F.when(F.col("_alt") == c, ROUTED_HIGH).otherwise(ROUTED_LOW))
             .otherwise(F.col(f"p{c}")) for c in range(n_classes)}
    return j.select(key, pred.alias("prediction"), routed.alias("routed"),
                    *[v.alias(k) for k, v in probs.items()])


def soft_vote(probs: DataFrame, n_classes: int, key: str = "row_id", prob_col: str = "probs") -> DataFrame:
    """Element-wise mean of the members' probability arrays; arg-max, lower class on ties."""
    g = probs.groupBy(key).agg(*[F.avg(F.col(prob_col)[c]).alias(f"p{c}") for c in range(n_classes)])
    best = F.lit(0)
    top = F.col("p0")
    for c in range(1, n_classes):
        best = F.when(F.col(f"p{c}") > top, F.lit(c)).otherwise(best)
        top = F.greatest(top, F.col(f"p{c}"))
    return g.select(key, *[F.round(f"p{c}", 10).alias(f"p{c}") for c in range(n_classes)],
                    best.alias("prediction"))


def one_hot_scores(pred: DataFrame, n_classes: int, col: str = "prediction") -> DataFrame:
    """One-hot probabilities for a model that only predicts labels."""
    return pred.withColumns({f"p{c}": F.when(F.col(col) == c, 1.0).otherwise(0.0) for c in range(n_classes)})


__all__ = ["case_text", "legend_text", "example_text", "evidence_text", "build_prompts",
           "majority_class", "parse_replies", "parse_flags", "score_rows", "uncertainty",
           "boundary_threshold", "route", "soft_vote", "one_hot_scores", "number_text"]
