"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Sources (by code point, null last) get weights 1, 2, 3 in turn and share the
corpus; a source is filled to ``max_copies`` times its size at most and its
excess goes to the others by weight.  Within a source every document expects
``target / source size`` copies.  Documents are ranked by size (equal sizes
spread by a hash of the id), the expected copies are prefix-summed, one
offset per source is added, and a document is emitted once for every integer
boundary its interval crosses.  As the ranks follow size, the words taken
differ from the target by about one large document.

Ranks of one source are computed in value ranges of bounded size, so a
source with a third of all rows is spread over many tasks.  The only
single-task step orders the table of sources (one row each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nullwise.functions.ordering import maybe_broadcast, rank_within_groups

from .common import stored

WEIGHTS, MAX_COPIES, SEED = (1, 2, 3), 3, 17
ROWS_PER_RANGE = 50_000
_MODULUS = 2**32


def text_size(column: str) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _spread(column: str) -> Column:
    """0 .. 2**32 - 1 from an id (null: 0), by a multiplicative hash."""
    x = F.pmod(F.coalesce(F.col(column).cast("long"), F.lit(0)), F.lit(2**31))
    return F.pmod(x * F.lit(2654435761), F.lit(_MODULUS))


def _offset(source_no: str, seed: int) -> Column:
    """The source's offset in [0, 1), from the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.col(source_no).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(_MODULUS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_no, source_size, target) from one row (source, source_size) per source.

    With the sources ordered by cap / weight, the filled ones come first;
    the first source whose share of what is left stays below its cap gives
    the level that holds for it and all later ones.
    """
    everything = Window.partitionBy()
    turn = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("ratio", "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int"))
    table = sizes.withColumn("source_no", F.row_number().over(turn) - 1).withColumn("weight", weight)
    table = table.withColumn("cap", (F.col("source_size") * max_copies).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    table = table.withColumn("left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    table = table.withColumn("level", F.col("left") / F.sum("weight").over(onward))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(everything)["level"]
    return table.withColumn("level", level).select("source", "source_no", "source_size",
                                                   F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED,
                keep: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (struct of the columns ``keep``, by default
    all), size, source_no, source_size, target, copies, taken.

    A null or empty text has size 0; a source without words has target 0
    and takes none of its documents.  A null source is a source of its own;
    repeated rows are documents of their own; an empty table gives an empty
    table.  The same input gives the same copies.
    """
    keep = keep or docs.columns
    sized = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(source_col).alias("source"),
                               F.col(id_col).cast("long").alias("tie"), text_size(text_col).alias("size"), _spread(id_col).alias("spread"))
                   .withColumn("place", F.col("size") * F.lit(_MODULUS) + F.col("spread")).drop("spread"), "sized")
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies), "targets")
    with_source = sized.join(maybe_broadcast(targets.withColumnRenamed("source", "of"), targets.count()),
                             F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ranked = rank_within_groups(with_source, ["source_no"], "place", "tie", "rank", rows_per_bucket=ROWS_PER_RANGE)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # prefix sum of the expected copies, up to and without this document
    upto = F.floor((F.col("rank") + 1) * share + _offset("source_no", seed))
    without = F.floor(F.col("rank") * share + _offset("source_no", seed))
    return ranked.withColumn("copies", (upto - without).cast("long")).select(
        "row", "size", "source_no", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it was taken, columns of docs."""
    mixed = mix_sources(docs, **options).where(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


#: The same rows in DuckDB.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
         ((((coalesce(doc_id, 0) % 2147483648) + 2147483648) % 2147483648) * 2654435761) % {_MODULUS} AS spread
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
turned AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM sums),
weighed AS (SELECT *, (source_no % 3 + 1)::DOUBLE AS weight, (source_size * {MAX_COPIES})::DOUBLE AS cap FROM turned),
levels AS (
  SELECT *, cap / weight AS ratio,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
chosen AS (SELECT level AS lam FROM levels WHERE level <= ratio ORDER BY ratio, source_no LIMIT 1),
targets AS (
  SELECT source, source_no, source_size, least(cap, lam * weight) AS target,
         ('0x' || substr(md5('{SEED}:' || source_no), 1, 8))::BIGINT::DOUBLE / {_MODULUS}.0 AS shift
  FROM levels, chosen),
ranked AS (
  SELECT s.doc_id, s.size, t.*,
         row_number() OVER (PARTITION BY t.source_no ORDER BY s.size * {_MODULUS} + s.spread, s.doc_id NULLS FIRST) - 1 AS rank,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor((rank + 1) * share + shift) - floor(rank * share + shift)) * size)::BIGINT AS taken
FROM ranked"""
