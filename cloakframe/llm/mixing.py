"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash of doc_id. A document's virtual finish time is the cumulative words of its
source up to it, divided by the source's target; a further copy of the source follows the first. The documents of all
sources are then one order by finish time, cut where the words reach the total.

A source's cumulative words are summed over hash ranges first and within a range after, so no task holds a source. The cut is
found by two histograms of fixed size over finish times and the order of the few rows in one narrow bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, finished, stored

COPIES = 3
#: Rows of one hash range, about.
PER_RANGE = 4096
#: Bins of a histogram over finish times, and the time from which all fall in the last one. Targets add up to all words, so the cut is
#: where times reach 1, or one document's share later: the last bin never has it but in tables of a few rows.
BINS, LAST = 4096, 4.0
KEY_BITS = 60


def shuffle_key() -> Column:
    """60 bits of the MD5 of doc_id's digits, or of the text where there is no doc_id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))), 1, 15), 16, 10).cast("long")


def row_key() -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64("text")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), copies: int = COPIES) -> DataFrame:
    """(source, source_size, target) for sizes (source, size). Targets are min(copies * source_size, share * weight) with
    the share that makes them add up to all words. One row for each source is sorted in one task, never documents."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("cap", F.col("source_size") * copies)
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("share", (total - F.sum("cap").over(upto) + F.col("cap")).cast("double") / F.sum("weight").over(after))
    fits = F.col("share") * F.col("weight") <= F.col("cap")
    # The first share that fits holds for its source and all after it.
    s = s.withColumn("share", F.first(F.when(fits, F.col("share")), True).over(upto))
    return s.select("source", "source_size", F.coalesce(F.col("share") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def _queued(docs: DataFrame, weights, copies: int) -> DataFrame:
    d = docs.select(F.col("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), shuffle_key().alias("k"), row_key().alias("row"))
    d = stored(d, "sizes")
    bits = max(0, (d.count() // PER_RANGE).bit_length())
    targets = stored(source_targets(d, weights, copies).select(F.col("source").alias("_source"), "source_size", "target"), "targets")
    d = d.withColumn("range", F.shiftright("k", KEY_BITS - bits))
    of = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = d.groupBy("source", "range").agg(F.sum("size").alias("words")).select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("words").over(of), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "range").orderBy("k", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(stored(ranges, "ranges"), F.expr("source <=> _s and range = _r")).withColumn("upto", F.col("base") + F.sum("size").over(within))
    return d.join(targets, F.expr("source <=> _source")).select("doc_id", "row", "source", "size", "k", "upto", "source_size", "target")


def _finish(copy) -> Column:
    """Virtual finish time of the given copy; null where a source has no words."""
    return F.when(F.col("target") > 0, (F.col("source_size") * copy + F.col("upto")).cast("double") / F.col("target"))


def _bins(rows: DataFrame, low: float, width: float) -> list[tuple[int, int]]:
    at = F.least(F.floor((F.col("f") - F.lit(low)) / F.lit(width)), F.lit(BINS)).cast("long")
    return sorted(tuple(x) for x in rows.groupBy(at.alias("b")).agg(F.sum("size").alias("s")).collect())


@finished
def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), copies: int = COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of docs (doc_id, text, source; others are ignored).

    Null and empty texts have no words and take none. A null source is a source of its own, the last. Rows that repeat
    count and are taken each for itself. Ties in the shuffled order fall by doc_id, size and text. An empty table gives an empty result.
    """
    return _counted(docs, weights, copies).select("doc_id", "size", "source_size", "target", "copies", "taken")


def _counted(docs: DataFrame, weights: tuple[int, ...], copies: int) -> DataFrame:
    """What mix gives, with row and source."""
    q = stored(_queued(docs, weights, copies), "queued")
    total = q.agg(F.sum("size")).first()[0] or 0
    rows = q.where("size > 0").withColumn("copy", F.explode(F.array(*[F.lit(c) for c in range(copies)]))).withColumn("f", _finish(F.col("copy")))
    rest, low, width, last = total, 0.0, LAST / BINS, False
    for _ in range(2):
        for b, s in _bins(rows, low, width):
            if s > rest:
                last = b == BINS
                break
            rest -= s
        else:
            return _taken(q, None, copies)
        rows = rows.where(F.least(F.floor((F.col("f") - F.lit(low)) / F.lit(width)), F.lit(BINS)) == b)
        low, width = low + b * width, width / BINS
        if last:
            break
    order = ["f", "k", "doc_id", "size", "copy"]
    running = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    beyond = rows.withColumn("running", running).where(F.col("running") > rest).orderBy("running").select(*order).first()
    return _taken(q, beyond, copies)


def _taken(q: DataFrame, beyond, copies: int) -> DataFrame:
    """beyond: the first copy in the order that is not taken."""

    def before(c):
        if beyond is None:
            return F.lit(1)
        f, k, doc, size, copy = beyond
        here = F.struct(_finish(F.lit(c)).alias("f"), F.col("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.col("size"), F.lit(c).alias("c"))
        there = F.struct(F.lit(f).alias("f"), F.lit(k).cast("long").alias("k"), F.lit(-(1 << 63) if doc is None else doc).cast("long").alias("d"), F.lit(size).cast("long").alias("size"), F.lit(copy).alias("c"))
        return (here < there).cast("int")

    n = sum((before(c) for c in range(copies)), F.lit(0))
    n = F.when((F.col("size") > 0) & (F.col("target") > 0), n).otherwise(0)
    return q.withColumn("copies", n.cast("int")).select("doc_id", "row", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


@finished
def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), copies: int = COPIES) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows of one doc_id with unlike texts or sources are taken each for itself; rows
    equal in all three are all taken as often as the first of them."""
    n = _counted(docs, weights, copies).where("copies > 0").groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("source").alias("_from")).agg(F.max("copies").alias("_copies"))
    # Names of its own: docs may have columns of any name.
    plain = docs.toDF(*[c if c in ("doc_id", "text", "source") else f"_{k}" for k, c in enumerate(docs.columns)])
    out = plain.withColumn("_key", row_key()).join(n, F.expr("doc_id <=> _id and _key = _row and source <=> _from"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*plain.columns).toDF(*docs.columns)


#: The same in SQL: rows, values and order, but the hash ranges and histograms, which only spread the work.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
             ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source),
c AS (SELECT *, ((SELECT sum(source_size) FROM s) - sum(cap) OVER o + cap)::DOUBLE
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
      FROM s WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT min_by(share, (cap / weight, source)) AS share, min((cap / weight, source)) AS at FROM c WHERE share * weight <= cap),
t AS (SELECT c.source, c.source_size, CASE WHEN (c.cap / c.weight, c.source) >= l.at THEN l.share * c.weight ELSE c.cap::DOUBLE END AS target FROM c, l),
q AS (SELECT d.*, t.source_size, t.target, (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT q.*, copy, (source_size * copy + upto)::DOUBLE / target AS f FROM q, (VALUES (0), (1), (2)) AS v(copy) WHERE size > 0),
u AS (SELECT doc_id, count(*) AS copies FROM (SELECT doc_id, sum(size) OVER (ORDER BY f, k, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS running FROM r)
      WHERE running <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(u.copies, 0)::INTEGER AS copies, (q.size * coalesce(u.copies, 0))::BIGINT AS taken
FROM q LEFT JOIN u ON q.doc_id = u.doc_id
"""
