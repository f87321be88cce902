"""Compositional grounding: a concept takes up to four slots of a vocabulary, theme, theme property, process, process property.

Exact matches are the longest contiguous overlaps of the concept's words with the words of a node's name. Properties go to
the theme or the process that is nearest, to the right first. A slot that has no exact match can be filled by
similarity. The score of a tuple is the noisy-or of its weighted slot scores.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.grounding import _vocabulary, top_k

#: Weights of theme, theme property, process and process property.
WEIGHTS = (1.0, 0.5, 1.0, 0.5)
#: Confidence of a property found by a word only.
PROPERTY_CONFIDENCE = 0.70
_WORD = re.compile(r"[^\W_]+")


def node_words(path: str) -> list[str]:
    """Words of the last part of a node's path; numbers that only tell nodes apart are left out."""
    return [w for w in _WORD.findall(path.rstrip("/").rpartition("/")[2].lower()) if not w.isdigit()]


def exact_match(words: list[str], name: list[str]) -> tuple[int, int] | None:
    """``(start, length)`` in ``words`` of the longest contiguous run that is also one of ``name``, the leftmost of equals; None without one.

    The run must be all of the name, or all of the words, or at least two words long.
    """
    best = None
    for i in range(len(words)):
        for j in range(len(name)):
            n = 0
            while i + n < len(words) and j + n < len(name) and words[i + n] == name[j + n]:
                n += 1
            if n and (n == len(name) or n == len(words) or n >= 2) and (best is None or n > best[1]):
                best = (i, n)
    return best


def nearest(at: int, places: list[int]) -> int | None:
    """Index of the place nearest to ``at``: to the right first, else to the left; of equals the first."""
    right = [(p - at, k) for k, p in enumerate(places) if p > at]
    left = [(at - p, k) for k, p in enumerate(places) if p < at]
    return min(right)[1] if right else min(left)[1] if left else None


def slots(text: str, nodes: list[tuple[str, str, list[str]]]) -> dict[str, tuple[str, float] | None]:
    """Slots of a text from ``nodes`` of ``(path, branch, words)`` with branches ``concept``, ``process``, ``property``.

    Of the matches of a branch the longest count, then the leftmost, then by path; matches of one branch do not overlap.
    """
    words = _WORD.findall(text.lower())
    found: dict[str, list[tuple[int, int, str]]] = {"concept": [], "process": [], "property": []}
    for path, branch, name in nodes:
        if branch in found and (m := exact_match(words, name)):
            found[branch].append((m[0], m[1], path))
    chosen: dict[str, list[tuple[int, int, str]]] = {}
    for branch, matches in found.items():
        taken: set[int] = set()
        chosen[branch] = []
        for start, n, path in sorted(matches, key=lambda m: (-m[1], m[0], m[2])):
            if taken.isdisjoint(range(start, start + n)):
                taken |= set(range(start, start + n))
                chosen[branch].append((start, n, path))
    theme = min(chosen["concept"], default=None)
    process = min(chosen["process"], default=None)
    out: dict[str, tuple[str, float] | None] = {"theme": theme and (theme[2], 1.0), "theme_property": None, "process": process and (process[2], 1.0), "process_property": None}
    heads = [(n, k) for n, k in (("theme", theme), ("process", process)) if k]
    for start, _, path in sorted(chosen["property"]):
        k = nearest(start, [h[1][0] for h in heads])
        if k is None:
            if out["theme"] is None:  # a property alone stands for the concept
                out["theme"] = (path, PROPERTY_CONFIDENCE)
        elif out[f"{heads[k][0]}_property"] is None:
            out[f"{heads[k][0]}_property"] = (path, PROPERTY_CONFIDENCE)
    return out


def tuple_score(scores: list[float | None]) -> float:
    """Noisy-or of the weighted scores of the filled slots; 0 for none."""
    p = 1.0
    for w, s in zip(WEIGHTS, scores):
        if s is not None:
            p *= 1 - (w * s - 0.01)
    return 1 - p if any(s is not None for s in scores) else 0.0


NAMES = ("theme", "theme_property", "process", "process_property")


def ground(rows: DataFrame, nodes: DataFrame, id_col: str = "id", text: str = "name") -> DataFrame:
    """``id, theme, theme_property, process, process_property, score`` of ``rows``; ``nodes(node, branch)`` is a vocabulary of checked size.

    One narrow stage. Null texts have empty slots and score 0; repeated rows come out repeated.
    """
    shared = _vocabulary(nodes, "node", "branch")
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        vocabulary = [(n, b, node_words(n)) for n, b in shared.value]
        memo: dict[str, dict] = {}
        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                if value is None:
                    out.append((None, None, None, None, 0.0))
                    continue
                if value not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[value] = slots(value, vocabulary)
                s = memo[value]
                out.append((*(s[n] and s[n][0] for n in NAMES), round(tuple_score([s[n] and s[n][1] for n in NAMES]), 6)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[i] for o in out], pa.string()) for i in range(4)], pa.array([o[4] for o in out], pa.float64())], names=["id", *NAMES, "score"])

    return rows.select(F.col(id_col).alias("id"), F.col(text)).mapInArrow(run, f"id {kind}, {', '.join(f'{n} string' for n in NAMES)}, score double")


def intervention_sieve(rows: DataFrame, main: DataFrame, interventions: DataFrame, cues: list[str], k: int, least: float = 0.0) -> DataFrame:
    """``id, node, score, rank``: patterns of the main vocabulary, else vectors of it together with interventions where a cue occurs.

    ``rows(id, name, vec)``; vocabularies ``node, patterns, node_vec``. A row whose text has no cue never meets the interventions.
    """
    from pyspark.sql import Window

    from strandline.operators.grounding import by_pattern

    first = by_pattern(rows, main)
    left = rows.join(first.select("id").distinct(), "id", "left_anti")
    cued = left.where(F.lower("name").rlike("|".join(f"({c})" for c in cues)))
    second = by_pattern(cued, interventions)
    third = top_k(left, main, k, least=least).drop("rank").unionByName(top_k(cued.join(second.select("id").distinct(), "id", "left_anti"), interventions, k, least=least).drop("rank"))
    every = first.unionByName(second).unionByName(third)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "node"))).where(F.col("rank") <= k)
