"""Null-preserving encoding (E1-E6) and the transformation log.

Encoding is a two-phase fit / transform.  ``fit_encoding`` runs one scan
to find each string column's distinct values (a shuffle ``distinct`` over
(column, value) pairs, so an id-like column never lands in one buffer) and
returns a small driver-side plan; the plan's ``transform`` is a pure
projection of column expressions, so it composes with any later operator,
prunes columns at the scan and also runs on a streaming DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import column_kinds
from .missing import missing_profile

#: Categories of a column that a plan may hold: each is a column or a branch of the projection on the driver.
MAX_CATEGORIES = 100_000


class TooManyCategories(ValueError):
    pass


def distinct_values(df: DataFrame, cols: list[str], cap: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct non-null values per string column; fails above ``cap``."""
    if not cols:
        return {}
    pairs = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("x")).select("x.feature", "x.value")
        .where(F.col("value").isNotNull()).distinct())
    pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # counts first (one small row per column): an id-like column fails here
        # before any value list is built
        counts = {r["feature"]: r["n"] for r in
                  pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        over = {c: n for c, n in counts.items() if n > cap}
        if over:
            raise TooManyCategories(f"more than {cap} categories: {over}")
        out: dict[str, list[str]] = {c: [] for c in cols}
        for r in pairs.collect():  # bounded: at most cap values per column
            out[r["feature"]].append(r["value"])
    finally:
        pairs.unpersist()
    return {c: sorted(v) for c, v in out.items()}


@dataclass
class ColumnPlan:
    name: str
    kind: str  # numeric | binary | onehot | dropped
    categories: list[str] = field(default_factory=list)
    n_missing: int = 0
    pct_missing: float = 0.0

    def outputs(self) -> list[str]:
        if self.kind == "onehot":
            return [f"{self.name}_{v}" for v in self.categories]
        return [] if self.kind == "dropped" else [self.name]


def binary_code(col: str, categories: list[str]):
    """The two sorted values -> 0.0 / 1.0, null stays null."""
    c = F.col(col).cast("string")
    return (F.when(c.isNull(), F.lit(None).cast("double"))
            .when(c == categories[0], F.lit(0.0)).when(c == categories[1], F.lit(1.0)))


def onehot_codes(col: str, categories: list[str]):
    """One 0/1 column per value; a null input gives null in every dummy."""
    c = F.col(col).cast("string")
    return [F.when(c.isNull(), F.lit(None).cast("double")).otherwise((c == v).cast("double"))
            .alias(f"{col}_{v}") for v in categories]


@dataclass
class EncodingPlan:
    columns: list[ColumnPlan]
    key: str = "row_id"

    def feature_names(self) -> list[str]:
        return [o for c in self.columns for o in c.outputs()]

    def expressions(self) -> list:
        exprs = []
        for c in self.columns:
            if c.kind == "numeric":
                exprs.append(F.col(c.name).cast("double").alias(c.name))
            elif c.kind == "binary":
                exprs.append(binary_code(c.name, c.categories).alias(c.name))
            elif c.kind == "onehot":
                exprs.extend(onehot_codes(c.name, c.categories))
        return exprs

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        extra = [k for k in keep if k in df.columns]
        lead = [self.key] if self.key in df.columns else []
        return df.select(*lead, *extra, *self.expressions())


def fit_encoding(df: DataFrame, cols: list[str], key: str = "row_id",
                 cap: int = MAX_CATEGORIES) -> EncodingPlan:
    """E1-E3 fit: kinds from the schema, categories from one distinct pass."""
    kinds = column_kinds(df, cols)
    prof = {r["feature"]: r for r in missing_profile(df, cols).collect()}
    strings = [c for c in cols if kinds.get(c) == "string"]
    cats = distinct_values(df, strings, cap)
    plans = []
    for c in cols:
        p = prof[c]
        n_miss, pct = int(p["n_missing"]), float(p["pct_missing"])
        if kinds.get(c) == "string":
            values = cats[c]
            if not values:
                plans.append(ColumnPlan(c, "dropped", [], n_miss, pct))
            elif len(values) == 2:
                plans.append(ColumnPlan(c, "binary", values, n_miss, pct))
            else:
                plans.append(ColumnPlan(c, "onehot", values, n_miss, pct))
        elif kinds.get(c) == "numeric":
            # all-null numeric columns are dropped
            total_rows_missing = n_miss > 0 and pct >= 100.0
            plans.append(ColumnPlan(c, "dropped" if total_rows_missing else "numeric", [],
                                    n_miss, pct))
    return EncodingPlan(plans, key)


@dataclass
class TargetEncoding:
    classes: dict[str, list[str]]

    def code(self, target: str):
        cl = self.classes[target]
        m = F.create_map(*[x for i, v in enumerate(cl) for x in (F.lit(v), F.lit(i))])
        return F.try_element_at(m, F.col(target).cast("string"))

    def transform(self, df: DataFrame, key: str = "row_id", keep=()) -> DataFrame:
        return df.select(key, *keep, *[self.code(t).cast("int").alias(t) for t in self.classes])


def fit_targets(df: DataFrame, targets: list[str], cap: int = MAX_CATEGORIES) -> TargetEncoding:
    """E4 fit: sorted classes per target -> 0..K-1; null stays null."""
    return TargetEncoding(distinct_values(df, targets, cap))


def label_map(df: DataFrame, targets: list[str]) -> DataFrame:
    """E5: (target, code, label) computed by Spark: distinct classes + dense rank.

    The window runs over distinct classes only (bounded by the category cap).
    """
    pairs = (df.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("string").alias("label"))
        for t in targets])).alias("x")).select("x.target", "x.label")
        .where(F.col("label").isNotNull()).distinct())
    code = F.dense_rank().over(Window.partitionBy("target").orderBy("label")) - 1
    return pairs.select("target", code.cast("int").alias("code"), "label")


def id_to_label(df: DataFrame, mapping: DataFrame, target: str, code_col: str,
                out: str = "label_name") -> DataFrame:
    """E5 inverse lookup with ``class_<id>`` fallback; mapping is one row per class."""
    m = mapping.where(F.col("target") == target).select(
        F.col("code").alias("_code"), F.col("label").alias("_label"))
    j = df.join(F.broadcast(m), df[code_col] == F.col("_code"), "left")
    return j.withColumn(out, F.coalesce(F.col("_label"), F.concat(F.lit("class_"), F.col(code_col).cast("string")))
                        ).drop("_code", "_label")


def compact_labels(train: DataFrame, test: DataFrame, label: str,
                   out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Re-number train's labels 0..K-1; test rows with unseen labels go."""
    out = out or label
    classes = train.select(label).where(F.col(label).isNotNull()).distinct()
    codes = classes.select(label, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int").alias("_new"))
    def apply(d):
        return (d.join(F.broadcast(codes), label, "inner").drop(label)
                .withColumnRenamed("_new", out))
    return apply(train), apply(test)


def encoding_log(df: DataFrame, cols: list[str], cap: int = MAX_CATEGORIES) -> DataFrame:
    """(feature, kind, n_missing, pct_missing, mapping) computed by Spark.

    One profile aggregate plus one distinct pass; the category list per
    column is bounded by ``cap`` (checked by ``distinct_values`` callers).
    """
    kinds = column_kinds(df, cols)
    strings = [c for c in cols if kinds.get(c) == "string"]
    prof = missing_profile(df, cols)
    kind_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(kinds.get(c, "other")))])
    if strings:
        pairs = (df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
            for c in strings])).alias("x")).select("x.feature", "x.value")
            .where(F.col("value").isNotNull()).distinct())
        cats = pairs.groupBy("feature").agg(F.sort_array(F.collect_list("value")).alias("cats"))
        prof = prof.join(F.broadcast(cats), "feature", "left")
    else:
        prof = prof.withColumn("cats", F.lit(None).cast("array<string>"))
    n_cat = F.coalesce(F.size("cats"), F.lit(0))
    is_str = kind_map[F.col("feature")] == "string"
    kind = (F.when(is_str & (n_cat == 0), "dropped").when(is_str & (n_cat == 2), "binary")
            .when(is_str, "onehot")
            .when(F.col("pct_missing") >= 100.0, "dropped").otherwise("numeric"))
    mapping = (F.when(kind == "binary", F.concat(F.col("cats")[0], F.lit("=0; "), F.col("cats")[1], F.lit("=1")))
               .when(kind == "onehot", F.array_join(F.transform("cats", lambda v: F.concat(F.col("feature"), F.lit("_"), v)), ", "))
               .otherwise(F.lit("")))
    return prof.select("feature", kind.alias("kind"), "n_missing", "pct_missing", mapping.alias("mapping"))
