"""Document fingerprints: one-permutation MinHash with packed low-order bits, in DataFrame functions only.

Every shingle of five words is hashed once (MD5).  The first eight bits name
one of 256 bins, a bin holds the least of its hashes, and an empty bin is
filled by optimal densification: it looks at the bins in an order drawn from
a hash of its own number and takes the value of the first full one.  The
order is the same for all texts, so equal full bins are copied from equal
places.  Of each bin the last four bits are stored, a hexadecimal digit per
bin (128 bytes of information in 256 characters).  Two different values agree
in four bits by chance once in 16 times, and ``likeness`` takes that out:
(equal digits / 256 - 1/16) / (1 - 1/16), 0 at least.

Everything about one text happens inside its row, in chunks of CHUNK
shingles, so nothing but the text itself grows with its length.  The next
document by id is found in ranges of the id: the first row of a range is
also sent to the range before it as a guest, so one shuffle of the texts is
enough and no task sees more than one range.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE, BINS, DRAWS = 5, 256, 16
#: Shingles that are hashed and sorted at a time.
CHUNK = 16_384
#: Rows of an id range while there are fewer than RANGES ranges; beyond, the ranges grow (their sort spills).
RANGE_ROWS, RANGES, CUTS = 1024, 65_536, 1024
_SPACE = r"[\x20\x09-\x0D]+"
_EMPTY = "g"  # after all hexadecimal digits, so a bin's mark sorts behind its hashes


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _array(values, kind: str) -> Column:
    """A constant array."""
    return F.expr(f"array({', '.join(repr(v) for v in values)})").cast(f"array<{kind}>")


def _order(i: int) -> list[int]:
    """The bins in the order in which the empty bin i looks at them."""
    return sorted(range(BINS), key=lambda j: hashlib.md5(f"{i}:{j}".encode()).hexdigest())


def words_of(text: Column) -> Column:
    """The words of a text."""
    return F.array_remove(F.split(text, _SPACE), "")


def _bins(words: Column, shingle: int) -> Column:
    """For each bin its least hash, or a mark that ends in _EMPTY; of a text with words."""
    n = F.greatest(F.size(words) - (shingle - 1), F.lit(1))  # fewer words than a shingle: one of all words
    here = [F.lit(k) for k in range(shingle)]
    marks = _array([f"{i:02x}{_EMPTY}" for i in range(BINS)], "string")

    def hashes(start: Column) -> Column:
        places = F.sequence(start, F.least(start + CHUNK, n) - 1)
        return F.transform(places, lambda i: F.md5(F.concat_ws(" ", *[F.get(words, i + k) for k in here]).cast("binary")))

    def least(ordered: Column) -> Column:
        before = lambda i: F.substring(F.coalesce(F.get(ordered, i - 1), F.lit(_EMPTY)), 1, 2)
        return F.filter(ordered, lambda h, i: ~F.startswith(h, before(i)))

    return F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(CHUNK)), marks,
                       lambda held, start: _let(F.sort_array(F.concat(held, hashes(start))), least))


def _densified(digits: Column) -> Column:
    """The digits with the empty bins filled."""
    orders = [_order(i)[:DRAWS] for i in range(BINS)]
    drawn = [_array([order[t] for order in orders], "int") for t in range(DRAWS)]
    places = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(digits, j) != _EMPTY)

    def first_full(i: Column, full: Column) -> Column:
        at_draw = [F.nullif(F.get(digits, F.get(draw, i)), F.lit(_EMPTY)) for draw in drawn]
        rest = F.array_min(F.transform(full, lambda j: F.struct(
            F.md5(F.concat(i.cast("string"), F.lit(":"), j.cast("string")).cast("binary")).alias("turn"), F.get(digits, j).alias("digit"))))
        return F.coalesce(*at_draw, rest["digit"])

    return _let(places, lambda full: F.transform(digits, lambda x, i: F.when(x != _EMPTY, x).otherwise(first_full(i, full))))


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text: BINS hexadecimal digits, or '' without words (null: as empty).

    Words are compared as they are written.  Of a text with fewer words than
    a shingle all words are one shingle.
    """
    def of_words(words: Column) -> Column:
        digits = F.transform(_bins(words, shingle), lambda h: F.substring(h, -1, 1))
        packed = _let(digits, lambda d: F.array_join(F.when(F.array_contains(d, _EMPTY), _densified(d)).otherwise(d), ""))
        return F.when(F.size(words) == 0, F.lit("")).otherwise(packed)

    return _let(words_of(F.coalesce(text, F.lit(""))), of_words)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1.

    Two empty sets are alike (1.0), an empty one is unlike all others (0.0).
    """
    equal = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))
    corrected = F.greatest(F.lit(0.0), (equal - BINS // 16) / F.lit(float(BINS - BINS // 16)))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


def _slot(key: Column, cuts: list[int]) -> Column:
    """Number of cuts below key, in two steps of at most 32 comparisons."""
    if not cuts:
        return F.lit(0)
    below = lambda values: F.size(F.filter(values, lambda c: c < key))
    step = 32
    start = F.greatest(below(_array(cuts[::step], "bigint")) - 1, F.lit(0)) * step
    return start + below(F.slice(_array(cuts, "bigint"), start + 1, step))


def _range(rows: DataFrame, key: str, last: str) -> Column:
    """A range number that grows with (last, key) and holds about RANGE_ROWS rows."""
    n = rows.count()
    wanted = min(RANGES, max(1, math.ceil(n / RANGE_ROWS)))
    parts, finer = min(CUTS, wanted), math.ceil(wanted / CUTS)
    probs = [i / parts for i in range(1, parts)] or [0.5]
    stats = rows.groupBy(last).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.percentile_approx(key, probs, 50 * CUTS).alias("cuts"))
    number = F.lit(0).cast("long")
    for row in stats.collect():  # a row with the ids, one without: at most CUTS numbers each
        cuts = sorted(set(row["cuts"])) if parts > 1 else []
        slot = _slot(F.col(key), cuts)
        fine = F.lit(0)
        if finer > 1:  # a quantile range in equal parts of the id
            low, high = (F.get(_array(edges, "double"), slot) for edges in ([row["low"], *cuts], [*cuts, row["high"]]))
            share = (F.col(key).cast("double") - low) / (high - low + 1)
            fine = F.least(F.greatest(F.floor(share * finer), F.lit(0)), F.lit(finer - 1))
        number = F.when(F.col(last) == row[last], F.lit(int(row[last]) * (RANGES + CUTS) * 2) + slot * finer + fine).otherwise(number)
    return number.cast("long")


def with_next(rows: DataFrame, id_col: str, tie: Column, columns: list[str]) -> DataFrame:
    """rows with next_<column> of the row that follows by ascending id; after the last comes the first.

    Rows without an id come last, in the order of ``tie``, which also orders
    rows with the same id.  A single row follows itself.
    """
    keyed = (rows.withColumn("_tie", tie).withColumn("_last", F.col(id_col).isNull())
             .withColumn("_key", F.coalesce(F.col(id_col), F.col("_tie"))))
    number = _range(keyed.select("_key", "_last"), "_key", "_last")
    # one row per range, so at most 2 * (RANGES + CUTS) rows: small enough for one task and for a broadcast
    firsts = keyed.select("_key", number.alias("_range")).groupBy("_range").agg(F.min("_key").alias("_first"))
    order = Window.orderBy("_range")
    last_of_all = F.max("_range").over(Window.partitionBy())
    firsts = firsts.withColumn("_before", F.coalesce(F.lag("_range").over(order), last_of_all))
    placed = keyed.withColumn("_range", number).join(F.broadcast(firsts), "_range")
    own = F.struct(F.col("_range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_before").alias("_range"), F.lit(True).alias("guest"))
    dealt = placed.withColumn("_at", F.explode(F.when(F.col("_key") == F.col("_first"), F.array(own, guest)).otherwise(F.array(own))))
    window = Window.partitionBy("_at._range").orderBy("_at.guest", "_key", "_tie")
    led = dealt.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})
    return led.where(~F.col("_at.guest")).drop("_at", "_tie", "_last", "_key", "_range", "_first", "_before")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: its id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document by ascending id; after
    the last comes the first.  near_edited and near_next are the likeness of
    the document's fingerprint to the edited text's and the next document's.

    A null text counts as empty; its fingerprint is ''.  Documents without
    an id come last, ordered by a hash of their text, as are documents that
    share an id (rows of one id are one range and so one task, whose sort
    spills).  Very long texts are hashed in chunks.  An empty table gives an
    empty table; other columns of docs are neither read nor returned.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text.alias("body"))
    rows = rows.withColumn("print", fingerprint(F.col("body"), shingle))
    led = with_next(rows, "doc", F.xxhash64("body"), ["body", "print"])
    led = led.withColumn("n_chars", F.length("body").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = led.withColumn("edited", F.concat(F.substr("body", F.lit(1), (F.col("n_chars") - F.col("half")).cast("int")),
                                               F.substr("next_body", F.lit(1), F.col("half"))))
    edited = edited.select("doc", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "print", "next_print",
                           fingerprint(F.col("edited"), shingle).alias("edited_print"))
    return edited.select(F.col("doc").alias(id_col), "n_chars", "edited_sha256", F.col("print").alias("fingerprint"),
                         F.col("edited_print").alias("edited_fingerprint"),
                         likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                         likeness(F.col("print"), F.col("next_print")).alias("near_next"))


#: The same rows in DuckDB.
SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n FROM documents),
led AS (
  SELECT *, coalesce(lead(body) OVER w, first_value(body) OVER w) AS next_body,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM base WINDOW w AS (ORDER BY doc_id NULLS LAST)),
edited AS (SELECT *, substr(body, 1, n - n // 2) || substr(next_body, 1, n // 2) AS edited FROM led),
split AS (
  SELECT doc_id, part, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT doc_id, 'own' AS part, body AS t FROM base UNION ALL SELECT doc_id, 'edited', edited FROM edited)),
grams AS (
  SELECT doc_id, part, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS h
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM split WHERE len(w) > 0)),
full_bins AS (
  SELECT doc_id, part, ('0x' || substr(h, 1, 2))::INT AS bin, right(min(h), 1) AS digit
  FROM grams GROUP BY doc_id, part, substr(h, 1, 2)),
empty_bins AS (
  SELECT doc_id, part, r.bin FROM (SELECT DISTINCT doc_id, part FROM full_bins), range({BINS}) r(bin)
  EXCEPT SELECT doc_id, part, bin FROM full_bins),
turns AS (SELECT a.bin AS i, b.bin AS j, md5(a.bin || ':' || b.bin) AS turn FROM range({BINS}) a(bin), range({BINS}) b(bin)),
filled AS (
  SELECT e.doc_id, e.part, e.bin, arg_min(f.digit, t.turn) AS digit
  FROM empty_bins e JOIN full_bins f ON e.doc_id = f.doc_id AND e.part = f.part
  JOIN turns t ON t.i = e.bin AND t.j = f.bin GROUP BY e.doc_id, e.part, e.bin),
prints AS (
  SELECT doc_id, part, string_agg(digit, '' ORDER BY bin) AS print
  FROM (SELECT * FROM full_bins UNION ALL SELECT * FROM filled) GROUP BY doc_id, part),
joined AS (
  SELECT e.doc_id, e.n, sha256(e.edited) AS edited_sha256, coalesce(a.print, '') AS a, coalesce(b.print, '') AS b, coalesce(c.print, '') AS c
  FROM edited e LEFT JOIN prints a ON a.doc_id = e.doc_id AND a.part = 'own'
  LEFT JOIN prints b ON b.doc_id = e.doc_id AND b.part = 'edited'
  LEFT JOIN prints c ON c.doc_id = e.next_id AND c.part = 'own'),
near AS (
  SELECT *, len(list_filter(range(1, {BINS + 1}), lambda i: substr(a, i::INT, 1) = substr(b, i::INT, 1))) AS ab,
         len(list_filter(range(1, {BINS + 1}), lambda i: substr(a, i::INT, 1) = substr(c, i::INT, 1))) AS ac
  FROM joined)
SELECT doc_id, n::BIGINT AS n_chars, edited_sha256, a AS fingerprint, b AS edited_fingerprint,
       CASE WHEN a = b THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0 ELSE greatest(0.0::DOUBLE, (ab - {BINS // 16}) / {BINS - BINS // 16}.0::DOUBLE) END AS near_edited,
       CASE WHEN a = c THEN 1.0::DOUBLE WHEN a = '' OR c = '' THEN 0.0 ELSE greatest(0.0::DOUBLE, (ac - {BINS // 16}) / {BINS - BINS // 16}.0::DOUBLE) END AS near_next
FROM near"""
