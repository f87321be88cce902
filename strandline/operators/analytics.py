"""Summaries, comparisons and evaluations over extraction tables.

Null keys form their own group in summaries and match nothing in joins; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import broadcast_if_small, written


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds 1, 2, ... in the given total order (nulls first) without sorting the table in one task.

    Range-partitioned sorting with partition offsets: each partition numbers its own rows, and the sizes of the
    partitions before it are added.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = written(ranged, "numbered")
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = sizes.selectExpr("__part", "coalesce(sum(__n) OVER (ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __start")  # one row per partition
    return ranged.withColumn("__part", part).join(broadcast_if_small(starts), "__part").withColumn(name, F.col("__start") + row + 1).drop("__id", "__part", "__start")


def shares(df: DataFrame, key: str) -> DataFrame:
    """``key, n, percent`` with a grand total row named ``TOTAL``."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    rows = counts.unionByName(total.select(F.lit("TOTAL").alias(key), F.col("__total").alias("n")).where("n IS NOT NULL"))
    return rows.join(F.broadcast(total)).select(key, "n", F.round(100.0 * F.col("n") / F.col("__total"), 4).alias("percent"))  # the total is one row


def id_sets(left: DataFrame, right: DataFrame, side: str) -> DataFrame:
    """Ids that are ``only_left``, ``only_right`` or in ``both`` tables, each once; null equals null."""
    return {"only_left": left.distinct().subtract(right), "only_right": right.distinct().subtract(left), "both": left.intersect(right)}[side]


def size_bins(df: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """Adds ``bin``: the number of edges that are at most the value."""
    bin_ = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bin_ = F.when(F.col(column) < e, i).otherwise(bin_)
    return df.withColumn("bin", bin_)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """``facet, value, n`` of each column."""
    one = [df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n") for c in columns]
    out = one[0]
    for o in one[1:]:
        out = out.unionByName(o)
    return out


def text_match(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Rows whose text has all the words, case aside."""
    low = F.lower(column)
    for w in words:
        df = df.where(low.rlike(rf"(^|[^a-z]){w}([^a-z]|$)"))
    return df


def mean_reciprocal_rank(rows: DataFrame, ranked: DataFrame, id_col: str, label: str, candidate: str) -> DataFrame:
    """``label, n, mrr`` over all rows; a row whose label is among none of its candidates counts 0."""
    hits = ranked.join(rows.select(id_col, label), id_col).where(F.col(label) == F.col(candidate)).groupBy(id_col).agg(F.min("rank").alias("__first"))
    return rows.join(hits, id_col, "left").groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("__first"), F.lit(0.0))), 6).alias("mrr"))


def precision_recall(df: DataFrame, keys: list[str], predicted: str, gold: str) -> DataFrame:
    """``keys, tp, fp, fn, precision, recall, f1``; rows with a null on either side count for nothing."""
    p, g = F.col(predicted), F.col(gold)
    c = df.groupBy(*keys).agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*keys, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` beyond those of ``right`` with their counts; counts are subtracted, never expanded to rows."""
    keys = left.columns
    n = left.withColumn("__s", F.lit(1)).unionByName(right.withColumn("__s", F.lit(-1))).groupBy(*keys).agg(F.sum("__s").alias("n"))
    return n.where("n > 0")


def date_expressions(df: DataFrame, column: str, anchor: str) -> DataFrame:
    """Adds ``begins, ends`` (half-open) of years, months, days and past periods ``P<n>[YMWD]`` before the anchor; null for others."""
    v, day = F.col(column), F.lit(anchor).cast("date")
    n = F.regexp_extract(v, r"(\d+)", 1).try_cast("int")
    year, month = F.concat(v, F.lit("-01-01")).try_cast("date"), F.concat(v, F.lit("-01")).try_cast("date")
    is_ = lambda p: v.rlike(p)
    begins = (
        F.when(is_(r"^(?!0000)\d{4}$"), year).when(is_(r"^\d{4}-\d\d$"), month).when(is_(r"^\d{4}-\d\d-\d\d$"), v.try_cast("date"))
        .when(is_(r"^P\d+Y$"), F.add_months(day, -12 * n)).when(is_(r"^P\d+M$"), F.add_months(day, -n)).when(is_(r"^P\d+W$"), F.date_sub(day, 7 * n)).when(is_(r"^P\d+D$"), F.date_sub(day, n))
    )
    ends = F.when(is_(r"^(?!0000)\d{4}$"), F.add_months(year, 12)).when(is_(r"^\d{4}-\d\d$"), F.add_months(month, 1)).when(is_(r"^\d{4}-\d\d-\d\d$"), F.date_add(v.try_cast("date"), 1)).when(is_(r"^P\d+[YMWD]$"), day)
    return df.withColumn("begins", begins).withColumn("ends", ends)
