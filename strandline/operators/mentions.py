"""Finding, expanding and reducing mentions: joins and windows within a sentence or a document.

Intervals are half-open token or character offsets. Every operator keeps rows whole: it returns exactly the rows
its docstring names, with ties broken by an explicit key, so results do not depend on partitioning. Null keys or
offsets never match; empty tables give empty results; columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import broadcast_if_small, cut


def numbered_tokens(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """``keys, pos, token``: the tokens of each row with their place."""
    return df.select(*keys, F.posexplode(tokens).alias("pos", "token"))


def gazetteer(df: DataFrame, keys: list[str], tokens: Column, lexicon: DataFrame) -> DataFrame:
    """``keys, label, start, stop, phrase``: longest leftmost occurrences of the phrases of ``lexicon(phrase, label)``, of any length.

    A phrase is looked up where its first word stands: one equality join on that word, then the words behind it are
    compared. Of overlapping ones with the same start the longest stays, and one that starts inside a longer one to its
    left is left out.
    """
    lex = lexicon.select(F.lower("phrase").alias("phrase"), "label").where("phrase <> ''").distinct()
    lex = lex.select("phrase", "label", F.split("phrase", " ").alias("__w")).select("phrase", "label", F.get("__w", F.lit(0)).alias("__first"), F.size("__w").alias("__n"))
    starts = df.select(*keys, tokens.alias("__t")).select(*keys, "__t", F.posexplode("__t").alias("start", "__first"))
    hits = starts.join(broadcast_if_small(lex), "__first").where(F.array_join(F.slice("__t", F.col("start") + 1, F.col("__n")), " ") == F.col("phrase")).withColumn("stop", F.col("start") + F.col("__n")).drop("__t", "__first")
    row = Window.partitionBy(*keys, "label")
    first = hits.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "label", "start").orderBy(F.desc("__n"), "phrase"))).where("__r = 1")
    reach = F.max("stop").over(row.orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return first.withColumn("__reach", reach).where(F.col("__reach").isNull() | (F.col("start") >= F.col("__reach"))).select(*keys, "label", "start", "stop", "phrase")


def overlapping(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows of the same ``on`` whose intervals ``start, stop`` and ``b_start, b_stop`` overlap."""
    return a.join(b, on).where((F.col("start") < F.col("b_stop")) & (F.col("b_start") < F.col("stop")))


def containing(points: DataFrame, intervals: DataFrame, on: list[str], point: str) -> DataFrame:
    """Points with the intervals of the same ``on`` that hold them."""
    return points.join(intervals, on).where((F.col(point) >= F.col("start")) & (F.col(point) < F.col("stop")))


def keep_longest(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop", tie: str = "id") -> DataFrame:
    """Rows whose interval lies in no longer one (or an equal one with a smaller ``tie``) of the same keys.

    In the order of start, falling stop and tie whatever holds an interval stands before it, so the largest stop so far
    decides: one sort of the group instead of a comparison of all pairs. Rows with a null key or offset, and repeated rows
    of one tie, hold nothing of each other and stay.
    """
    whole = F.col(start).isNotNull() & F.col(stop).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    order = Window.partitionBy(*keys, "__whole").orderBy(start, F.desc(stop), tie).rowsBetween(Window.unboundedPreceding, -1)
    reach = df.withColumn("__whole", whole).withColumn("__reach", F.when(F.col("__whole"), F.max(stop).over(order)))
    # of repeated rows the first has the smallest reach; where nothing stands before it, it reaches less far than the row
    first = F.min(F.coalesce("__reach", F.col(stop) - 1)).over(Window.partitionBy(*keys, "__whole", start, stop, tie))
    return reach.withColumn("__first", F.when(F.col("__whole"), first)).where(F.col("__first").isNull() | (F.col("__first") < F.col(stop))).drop("__whole", "__reach", "__first")


def best_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given total order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rank = 1").drop("__rank")


def representatives(df: DataFrame, keys: list[str], found_by: str, tie: str) -> DataFrame:
    """One row per group of equal mentions: the one found by the fewest rules, then the first by name and ``tie``."""
    return best_per(df, keys, F.size(F.split(found_by, r"\+\+")), F.col(found_by), F.col(tie))


def most_complete(df: DataFrame, keys: list[str], weight: Column, found_by: str, tie: str) -> DataFrame:
    """Of mentions with one span the heaviest: weight counts arguments, attachments and length; ties by provenance."""
    return best_per(df.withColumn("weight", weight), keys, F.desc("weight"), F.col(found_by), F.col(tie))


def completeness(trigger_length: Column, attachment_args: Column, attachments: Column, args: Column, length: Column) -> Column:
    """Weight of an event: arguments count a hundredfold, attachments tenfold."""
    return attachment_args + trigger_length + 10 * attachments + 100 * args + length


def coreference(df: DataFrame, doc: str, sent: str, text: str, determiners: list[str]) -> DataFrame:
    """``doc, anaphor_id, antecedent_id``: events whose cause starts with a determiner, linked to the last event before.

    The antecedent is the event of the previous sentence that ends last (ties: highest id). Needs ``id``, ``stop``.
    """
    starts = F.lower(F.substring_index(F.trim(F.col(text)), " ", 1)).isin(*determiners)
    anaphors = df.where(starts).select(doc, (F.col(sent) - 1).alias("__prev"), F.col("id").alias("anaphor_id"))
    last = best_per(df, [doc, sent], F.desc("stop"), F.desc("id")).select(doc, F.col(sent).alias("__prev"), F.col("id").alias("antecedent_id"))
    return anaphors.join(last, [doc, "__prev"]).select(doc, "anaphor_id", "antecedent_id")


def chained(causes: DataFrame, effects: DataFrame, on: list[str]) -> DataFrame:
    """Event chains: a cause whose landing token lies in the effect of another event takes that effect as its cause.

    ``causes(on, id, token)``, ``effects(on, effect_id, start, stop)``; gives ``on, id, effect_id``.
    """
    joined = causes.join(effects, on).where((F.col("id") != F.col("effect_id")) & (F.col("token") >= F.col("start")) & (F.col("token") < F.col("stop")))
    return joined.select(*on, "id", "effect_id")


def negated(tokens: Column, negators: list[str], pairs: list[tuple[str, str]]) -> Column:
    """True for an odd number of negations: single words and two-word phrases that negate."""
    singles = F.size(F.filter(tokens, lambda t: t.isin(*negators)))
    doubles = F.size(F.filter(F.zip_with(tokens, F.slice(F.concat(tokens, F.array(F.lit(""))), 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b)), lambda p: p.isin(*[" ".join(x) for x in pairs])))
    return (singles + doubles) % 2 == 1


def hedges(tokens: Column, hints: list[str]) -> Column:
    """Hint words of a span, in order; each occurrence is one hedging attachment."""
    return F.filter(tokens, lambda t: t.isin(*hints))


def nearest_before(df: DataFrame, reference: DataFrame, on: list[str], at: str, within: int | None = None) -> DataFrame:
    """Each row with the latest reference row of the same ``on`` at or before it (``ref_at``); none if there is none.

    One union and one window: reference rows carry their time forward, so no pairs are made. ``within`` bounds the
    distance in the unit of ``at``.
    """
    both = df.withColumn("__ref", F.lit(None).cast(reference.schema["ref_at"].dataType)).withColumn("__kind", F.lit(1)).unionByName(
        reference.select(*on, F.col("ref_at").alias(at), F.col("ref_at").alias("__ref")).withColumn("__kind", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(*on).orderBy(at, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("ref_at", F.last("__ref", ignorenulls=True).over(order)).where("__kind = 1").drop("__ref", "__kind")
    return out if within is None else out.withColumn("ref_at", F.when(F.col(at) - F.col("ref_at") <= within, F.col("ref_at")))


def relevant(edges: DataFrame, mentions: DataFrame, arguments: DataFrame, labels: list[str]) -> DataFrame:
    """Mentions that are arguments of a kept edge: edges of the listed labels whose arguments have content."""
    kept = edges.where(F.col("label").isin(*labels)).select("edge_id")
    return mentions.join(arguments.join(kept, "edge_id", "left_semi").select("mention_id").distinct(), "mention_id", "left_semi")


def reachable(arguments: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """``root, mention_id``: every mention reachable over ``arguments(mention_id, argument_id)``, once; within ``depth`` steps if given.

    Each step keeps only new rows, so it ends on cycles too; lineage is cut after each.
    """
    found = level = cut(roots.select(F.col("mention_id").alias("root"), "mention_id").distinct())
    step = 0
    while depth is None or step < depth:
        level = cut(level.join(arguments, "mention_id").select("root", F.col("argument_id").alias("mention_id")).distinct().join(found, ["root", "mention_id"], "left_anti"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
        step += 1
    return found


def without_contained_events(df: DataFrame, keys: list[str], weight: str, args: str, tie: str) -> DataFrame:
    """Events of one trigger, from the heaviest on, without those whose every argument text is part of one kept before.

    ``args`` is an array of texts. The events of one trigger are few (they share a sentence and a span); they are folded
    in an array in a fixed order: heavier first, then by ``tie``.
    """
    entry = F.struct((-F.col(weight)).alias("w"), F.col(tie).alias("tie"), F.col(args).alias("args"))
    group = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__es"))
    inside = lambda kept, e: F.exists(kept, lambda k: F.forall(e["args"], lambda a: F.exists(k["args"], lambda b: b.contains(a))))
    kept = F.aggregate("__es", F.filter("__es", lambda _: F.lit(False)), lambda acc, e: F.when(inside(acc, e), acc).otherwise(F.concat(acc, F.array(e))))
    ids = group.select(F.explode(F.transform(kept, lambda e: e["tie"])).alias(tie))
    return df.join(ids, tie, "left_semi")


def entities(tokens: DataFrame, found: DataFrame, avoid: DataFrame) -> DataFrame:
    """Entity clean-up in order: not inside avoided spans, split at coordination, trimmed at the edges, each once.

    ``tokens(sent_key, tokens)``, ``found(sent_key, start, stop)``, ``avoid(sent_key, start, stop)``; gives ``sent_key, start, stop``.
    """
    from strandline.functions.tagsets import split_coordinated, trimmed

    a = avoid.select("sent_key", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    overlap = lambda df: df.alias("l").join(a.alias("r"), (F.col("l.sent_key") == F.col("r.sent_key")) & (F.col("l.start") < F.col("r.b_stop")) & (F.col("r.b_start") < F.col("l.stop")), "left_anti")
    parts = found.join(tokens, "sent_key").select("sent_key", "tokens", F.explode(split_coordinated(F.col("tokens"), F.col("start"), F.col("stop"))).alias("p"))
    cut = parts.select("sent_key", trimmed(F.col("tokens"), F.col("p.start"), F.col("p.stop")).alias("p")).select("sent_key", "p.start", "p.stop").distinct()
    return overlap(cut)
