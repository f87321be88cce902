"""Per-document quality figures, outlier scores from exact per-language ranks, and the kind of texts that are not prose.

1. Words and neighbours are counted over all distinct texts, per language and combined map-side; the frequent ones
   are the word order model. One narrow Arrow stage then computes the statistics of every document and the shares of its text that are list
   items, table rows or junk of a known form.
2. Copies of a text within a language are collapsed. The distinct values of each statistic and language are counted
   over the texts left (map-side combined), range-partitioned, sorted and cumulated; the totals of the partitions
   before give each partition's offset, so every value has its exact rank without any single task seeing all values
   (:func:`exact_ranks`). Languages of few texts are ranked among the texts of all languages.
3. The empirical tail probabilities of a text's statistics are turned into surprises. The surprises of one-sided tails
   that speak for a kind (a list: many items, short lines, few end marks, few common words ...) are added up to the
   text's outlier score for that kind, which every copy of it has.
4. The structure of a text names the kind; the text is reported if its score for the kind is an outlier of the
   distribution of that score.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import BROADCAST_ROWS, broadcast_if_small, written

STATS = ["n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "end_mark_lines", "common_words", "distinct_words", "mean_line_words"]
#: Shares of a text that are rows of tables, items of lists, junk of a known form, and neighbours in no order.
SHARES = ["table_share", "list_share", "junk", "disorder"]
#: Distinct texts from which a language has ranks of its own; the texts of smaller ones are ranked among all languages.
MIN_TEXTS = 50

_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# the same for texts of Latin letters only, as a set of characters that is matched faster
_LATIN = "a-zª²³µ¹º¼½¾ß-öø-ɏ"
_LATIN_WORDS = re.compile(f"[{_LATIN}]+(?:['’-][{_LATIN}]+)*")
_NOT_LATIN = re.compile("[^\x00-\u024f\u2000-\u206f\u20a0-\u20cf]")
_ENDS = re.compile(r"[.!?…。！？।॥؟።][\"'”’»“)\]」』）]*$")
_SENTENCE_END = re.compile(r"[.!?。！？।॥؟።]")
_BULLET = re.compile(r"^\s*(?:[-*•–—·‣◦▪+✓→>]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxlcIVXLC]+[.)])\s+\S")
_GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_CSV = re.compile(r'(?:^|,)("(?:[^"]|"")*"|[^,"]*)')
_NUMBER = re.compile(r"^[-+]?[\d.,  ]*\d%?$|^(?:-|n/a|–)?$")
_MOJIBAKE = re.compile("[Ã][\x80-¿]|[Â][\x80-¿]|[\x80-\x9f]|â€|�")
_MOJIBAKE_SIGN = re.compile("[ÃÂ\x80-\x9fâ�]")
_DIGITS = re.compile(r"\d")
_HEX = re.compile(r"(?<!\S)(?=[a-f]*\d)[0-9a-f]{8,}(?!\S)")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{36,}={0,2}$")
_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2}){3,}|(?:\\[ux][0-9a-fA-F]{2,4}){3,}|&#?\w{2,6};")
# Labels of page navigation.
NAVIGATION = frozenset("home login logout next previous search print menu contact rss share top about cookies subscribe sitemap help back register download".split())
_CASELESS = re.compile(r"[؀-ۿऀ-ॿ฀-໿ሀ-፿぀-ヿ一-鿿]")
_VOWELLESS = re.compile(r"(?<!\S)[^aeiouy\s]+(?!\S)")
_SEPARATORS = frozenset("|·»›>•/—–")


def lower_words(text: str) -> list[str]:
    """The words of a text in lower case."""
    low = text.lower()
    return (_WORDS if _NOT_LATIN.search(low) else _LATIN_WORDS).findall(low)


def _cells(line: str) -> int:
    """Number of cells of a line that could be a table row; 0 if it is none."""
    text = line.strip()
    if text.count("|") >= 2 or (text.count("|") == 1 and " | " in text):
        parts = text.strip("|").split("|")
    elif "\t" in text:
        parts = text.split("\t")
    elif text.count(";") >= 1 and not text.endswith(";") and " " not in text.replace("; ", ";").partition(";")[0].strip()[30:]:
        parts = text.split(";")
    elif "  " in text and _GAPS.search(text):
        parts = re.split(r" {2,}|\t", text)
    elif "," in text and ", " not in text.replace('", "', '","'):
        parts = [m.strip('"') for m in _CSV.findall(text)]
    else:
        return 0
    if len(parts) < 2 or sum(map(len, parts)) > 40 * len(parts):
        return 0
    return len(parts)


def _inline_items(line: str) -> int:
    """Number of items of a line that is an enumeration of short items without a sentence; 0 if it is none."""
    for mark in (";", "•", "·", "؛", "；", "、", ",", "，", "،"):
        if line.count(mark) < 4:
            continue
        parts = [p.strip() for p in line.split(mark) if p.strip()]
        if len(parts) >= 5 and max(map(len, parts)) <= 60 and not _SENTENCE_END.search(line[:-1]) and sum(len(p.split()) for p in parts) < 4.5 * len(parts):
            return len(parts)
    return 0


def structure(text: str) -> tuple[float, float]:
    """Shares of the characters that stand in table rows and in list items."""
    lines = [x for x in text.split("\n") if x.strip()]
    total = sum(len(x.strip()) for x in lines)
    if not total:
        return 0.0, 0.0
    widths = [_cells(x) for x in lines]
    common = Counter(w for w in widths if w).most_common(1)
    rows = set()
    if common and common[0][1] >= 2:
        candidates = [i for i, w in enumerate(widths) if w]
        cells = numbers = 0
        for i in candidates:
            parts = [p.strip().strip('"') for p in re.split(r"\||\t|;| {2,}|,(?! )", lines[i].strip().strip("|"))]
            cells += len(parts)
            numbers += sum(bool(_NUMBER.match(p)) for p in parts[1:])
        # rows of one width, most of whose cells but the first are figures, or marked-up rows
        if numbers >= 0.3 * max(1, cells - len(candidates)) or sum("|" in lines[i] for i in candidates) >= 3 and len(candidates) > 2:
            rows = set(candidates)
    table = sum(len(lines[i].strip()) for i in rows)
    items = 0
    n_items = 0
    caseless = _CASELESS.search(text) is not None
    for i, line in enumerate(lines):
        if i in rows:
            continue
        s = line.strip()
        wide = caseless and _CASELESS.search(s) is not None
        short = (len(s) <= 40 if wide else len(s) <= 70 and s.count(" ") < 7)
        ends = _ENDS.search(s) is not None
        # a marked line that holds a sentence is speech or prose, not an item
        if _BULLET.match(line) and len(s) <= (44 if wide else 160) and not (ends and (wide or s.count(" ") > 5)):
            items += len(s)
            n_items += 1
        elif parts := _inline_items(s):
            items += len(s)
            n_items += parts
        elif short and not ends:
            items += len(s)
            n_items += 1
    if n_items < 4:
        items = 0
    return table / total, items / total


def junk_share(text: str, tokens: list[str], words: list[str], digits: int) -> float:
    """How far a text is junk of a known form, 0 to 1; 0.5 and more is junk.

    Forms: garbled or encoded characters, noise of signs, page navigation, endless repetition, words without
    vowels, and single characters in no order.
    """
    n = len(tokens)
    size = sum(map(len, tokens)) or 1
    letters = sum(map(len, words))
    score = 0.0
    if _MOJIBAKE_SIGN.search(text):
        score = min(1.0, 8 * sum(map(len, _MOJIBAKE.findall(text))) / size)
    encoded = sum(map(len, _HEX.findall(text))) if digits else 0
    if max(map(len, tokens)) >= 36:
        encoded += sum(len(t) for t in tokens if len(t) >= 36 and not _HEX.fullmatch(t) and _BASE64.match(t))
    if "%" in text or "&" in text or "\\" in text:
        encoded += sum(map(len, _ESCAPED.findall(text)))
    score = max(score, min(1.0, 1.2 * encoded / size))
    # signs that are neither letters, digits nor what prose and tables are punctuated with
    if letters + digits < 0.35 * size and letters + digits + len(_CASELESS.findall(text)) < 0.35 * size:
        score = max(score, 1.0 if size > 15 else 0.6)
    if n >= 12:
        distinct = len(set(tokens))
        if distinct <= 0.2 * n or distinct <= 3:
            score = 1.0
        if digits < 0.05 * size and "\n" not in text.strip() and sum(t in _SEPARATORS for t in tokens) >= 0.3 * n:
            score = 1.0
        if distinct <= 0.6 * n and 1 - len(set(zip(tokens, tokens[1:], tokens[2:], tokens[3:]))) / (n - 3) >= 0.6:
            score = 1.0
        if sum(map(NAVIGATION.__contains__, words)) >= 0.3 * max(8, len(words)):
            score = 1.0
        if n >= 20 and size < 1.7 * n and digits < 0.5 * size and letters + len(_CASELESS.findall(text)) >= 0.4 * size:
            score = 1.0
    elif len(text) > 200:
        chunk = text.strip()[:12]
        if chunk and text.count(chunk) * len(chunk) > 0.6 * len(text):
            score = 1.0
    types = set(words)
    latin = [w for w in types if w.isascii() and len(w) > 1]
    if len(latin) >= 8 and len(_VOWELLESS.findall(" ".join(latin))) >= 0.5 * len(latin) and len(latin) >= 0.6 * len(types):
        score = 1.0
    return score


#: Least count of a known word and of a known pair, and their least shares of the words of their language. The shares
#: bound the model whatever the size of the corpus: a language has at most 1 / share of either.
LEAST_WORD, LEAST_PAIR = 24, 3
WORD_SHARE, PAIR_SHARE = 6e-5, 7.5e-6
#: Known words and pairs of all languages up to which the model is sent to the workers (8 bytes each).
MAX_MODEL = 2_000_000
#: Words that a task holds before it counts them and passes the counts on.
HELD = 2_000_000
#: Neighbouring known words from which a text can be out of order.
LEAST_NEIGHBOURS = 12


class _Codes(dict):
    """Word -> 63-bit code; 0 is none."""

    def __missing__(self, word: str) -> int:
        code = self[word] = (int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1) or 1
        return code

    def of(self, words: list[str]) -> list[int]:
        if len(self) > 1_000_000:
            self.clear()
        return [self[w] for w in words]


def _pairs(codes: np.ndarray) -> np.ndarray:
    """Codes of the neighbours in a row of word codes; 0 next to a 0, which stands between texts."""
    a, b = codes[:-1].view(np.uint64), codes[1:].view(np.uint64)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(31)
    return np.where((a > 0) & (b > 0), (mixed >> np.uint64(1)).view(np.int64), 0)


def neighbour_counts(texts: DataFrame) -> DataFrame:
    """``lang, pair, code, n``: how often a word (``pair`` false) or two neighbouring words stand in the texts of a language; ``texts(doc_id, lang, digest, text)``.

    Copies of a text within a language count once. Each task adds up its own counts before the shuffle, and only
    copies of texts that occur more than once are shuffled themselves.
    """

    def run(batches):
        codes, held, size = _Codes(), defaultdict(list), 0

        def counted():
            for lang, parts in held.items():
                words = np.array([c for part in parts for c in part], dtype=np.int64)
                for pair, values in ((False, words), (True, _pairs(words))):
                    found, n = np.unique(values[values > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([pair] * len(found), pa.bool_()), pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["lang", "pair", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                held[lang].append([*codes.of(lower_words(text)), 0])
                size += len(held[lang][-1])
            if size > HELD:
                yield from counted()
                size = 0
        yield from counted()

    some = texts.where(F.col("text").isNotNull())
    repeated = written(some.groupBy("lang", "digest").agg(F.count("*").alias("__n"), F.min("doc_id").alias("__first")).where("__n > 1").drop("__n"), "repeated")
    marked = some.join(broadcast_if_small(repeated), ["lang", "digest"], "left")
    once = marked.where("__first IS NULL").select("lang", "text")
    first = marked.where("doc_id = __first").dropDuplicates(["lang", "digest"]).select("lang", "text")
    return once.unionByName(first).mapInArrow(run, "lang string, pair boolean, code long, n long").groupBy("lang", "pair", "code").agg(F.sum("n").alias("n"))


def word_order(texts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """``lang -> (words, pairs)`` of all texts, as sorted codes: the frequent words of each language and its frequent neighbours."""
    counts = written(neighbour_counts(texts), "neighbours")
    sizes = counts.where("NOT pair").groupBy("lang").agg(F.sum("n").alias("size"))
    least = F.when(F.col("pair"), F.greatest(F.lit(LEAST_PAIR), PAIR_SHARE * F.col("size"))).otherwise(F.greatest(F.lit(LEAST_WORD), WORD_SHARE * F.col("size")))
    known = counts.join(broadcast_if_small(sizes), "lang").where(F.col("n") >= least).select("lang", "pair", "code")
    if known.count() > MAX_MODEL:
        raise ValueError(f"the word order model has more than {MAX_MODEL} words and pairs: the texts have too many language tags")
    model: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    rows = known.toPandas()
    for lang, part in rows.groupby("lang"):
        model[lang] = tuple(np.sort(part["code"][part["pair"] == pair].to_numpy()) for pair in (False, True))
    return model


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def disorder(texts: list[list[int]], words: np.ndarray, pairs: np.ndarray) -> list[float]:
    """For each text (word codes) the share of neighbouring known words that are no frequent neighbours in their language; 0 where too few are known."""
    row = np.array([c for t in texts for c in (*t, 0)], dtype=np.int64)
    if len(row) < 2:
        return [0.0] * len(texts)
    known = _within(row, words)
    both = np.append(known[:-1] & known[1:], False)
    missing = both & ~np.append(_within(_pairs(row), pairs), True)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    seen, gone = (np.add.reduceat(x.astype(np.int64), starts) for x in (both, missing))
    return np.where(seen >= LEAST_NEIGHBOURS, gone / np.maximum(seen, 1), 0.0).tolist()


def _short(x: float) -> float:
    """Three significant digits: a statistic has few distinct values whatever the size of the corpus."""
    return float(f"{x:.3g}")


def statistics(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``doc_id, lang, digest`` and :data:`STATS` of every document, with :data:`SHARES`.

    ``lang`` is normalised to its lower-case primary tag, ``und`` where it is null. Shares are rounded to three
    decimals, counts and means to three digits. Null, empty and blank texts have null figures and stay in the result;
    rows are kept as they are, repeated ones too; an empty table gives an empty one; other columns are not read.
    ``lexicon`` is a table of fixed size; its common words are counted and refused beyond :data:`MAX_MODEL`.
    """
    spark = docs.sparkSession
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.lower(F.regexp_extract(F.trim(docs["lang"]), r"^[A-Za-z]+", 0)), F.lit("und")).alias("lang"), F.unhex(F.md5(docs["text"])).alias("digest"), docs["text"].alias("text"))
    common: dict[str, set] = {}
    listed = lexicon.where(F.col("is_common") & F.col("word").isNotNull()).select(F.lower("word").alias("word"), "lang").distinct()
    if listed.count() > MAX_MODEL:
        raise ValueError(f"the lexicon has more than {MAX_MODEL} common words")
    for r in listed.collect():
        common.setdefault(r.lang, set()).add(r.word)
    shared = spark.sparkContext.broadcast(({k: frozenset(v) for k, v in common.items()}, word_order(base)))
    kinds = [pa.int64(), pa.string(), pa.binary()] + [pa.float64()] * (len(STATS) + len(SHARES))

    def run(batches):
        common, model = shared.value
        everyone = frozenset().union(*common.values()) if common else frozenset()
        codes, nothing = _Codes(), (np.zeros(0, dtype=np.int64),) * 2
        for batch in batches:
            rows, coded = [], defaultdict(list)
            for doc, lang, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None or not text.strip():
                    rows.append([doc, lang, digest] + [None] * (len(STATS) + len(SHARES)))
                    continue
                words = lower_words(text)
                coded[lang].append((len(rows), codes.of(words)))
                n, size = len(words), len(text)
                letters = sum(map(len, words))
                tokens = text.split()
                spaces = size - sum(map(len, tokens))
                digits = sum(map(text.count, "0123456789")) if text.isascii() else len(_DIGITS.findall(text))
                lines = [x for x in text.split("\n") if x.strip()]
                known = common.get(lang, everyone)
                table, items = structure(text)
                rows.append([
                    doc, lang, digest, _short(n), _short(letters / n) if n else 0.0, round(max(0.0, 1 - (letters + spaces + digits) / size), 3), round(digits / size, 3),
                    round(sum(1 for x in lines if _ENDS.search(x.rstrip())) / len(lines), 3), round(sum(map(known.__contains__, words)) / n, 3) if n else 0.0,
                    round(len(set(words)) / n, 3) if n else 0.0, _short(n / len(lines)), round(table, 3), round(items, 3), round(junk_share(text, tokens, words, digits), 3), 0.0,
                ])
            for lang, texts in coded.items():
                for (at, _), share in zip(texts, disorder([c for _, c in texts], *model.get(lang, nothing))):
                    rows[at][-1] = round(share, 3)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=["doc_id", "lang", "digest", *STATS, *SHARES])

    return base.mapInArrow(run, "doc_id long, lang string, digest binary, " + ", ".join(f"{c} double" for c in [*STATS, *SHARES]))


#: Name of the group of all languages in the ranks; no tag has such a sign.
ALL = "*"


def exact_ranks(values: DataFrame, keys: list[str], value: str, count: str, partitions: int | None = None) -> DataFrame:
    """Adds ``below`` (rows with a smaller value) and ``total`` within ``keys`` to distinct ``value``s with their ``count``.

    Range-partitioned sorting with partition offsets: each partition cumulates its own sorted rows, and the totals
    of each key in the partitions before it are added. The offsets table has one row per partition and key.
    """
    order = [*keys, value]
    spread = values.repartitionByRange(partitions, *order) if partitions else values.repartitionByRange(*order)
    ranged = spread.select(*order, F.col(count).cast("long").alias("__n")).sortWithinPartitions(*order)

    def cumulate(batches):
        last, so_far, part = None, 0, None
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            n = batch.column(len(keys) + 1).to_pylist()
            below = []
            for key, c in zip(zip(*columns), n):
                if key != last:
                    last, so_far = key, 0
                below.append(so_far)
                so_far += c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(below, pa.int64()), pa.array([part] * len(n), pa.int32())], names=[*order, "__n", "__below", "__part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    local = written(ranged.mapInArrow(cumulate, fields + ", __below long, __part int"), "ranks")
    totals = local.groupBy(*keys, "__part").agg(F.sum("__n").alias("__here"))
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(*keys, "__part", F.coalesce(F.sum("__here").over(before), F.lit(0)).alias("__offset"), F.sum("__here").over(whole).alias("total"))
    return local.join(broadcast_if_small(offsets), [*keys, "__part"]).select(*order, F.col("__n").alias(count), (F.col("__below") + F.col("__offset")).alias("below"), "total")


#: Tails that speak for a kind: statistic -> weight, below 0 for the lower tail.
TAILS = {
    "junk": {"junk": 2, "end_mark_lines": -1, "common_words": -1, "distinct_words": -1},
    "table": {"table_share": 2, "digit_ratio": 1, "symbol_ratio": 1, "mean_word_length": 1, "end_mark_lines": -1, "common_words": -1, "mean_line_words": -1, "n_words": -1},
    "list": {"list_share": 2, "symbol_ratio": 1, "mean_word_length": 1, "end_mark_lines": -1, "common_words": -1, "mean_line_words": -1, "n_words": -1},
    "disorder": {"disorder": 2, "mean_line_words": 1, "end_mark_lines": -1, "symbol_ratio": -1},
}
#: Tail probability below which a value is no stronger evidence: the rarest of many texts would else stand out for the number of texts alone.
RAREST = 0.01
#: Standard deviations above the mean score of all texts from which a text is an outlier of a kind: few where a check
#: of the structure follows, many where the score alone decides.
DEVIATIONS = {"junk": 0.5, "table": 0.5, "list": 0.5, "disorder": 4.0}
#: Share of a text that is most of it.
MOST = 0.5
#: Parts that a hot value is split into where the ranks are too many to be broadcast.
SALT = 32


def _text_scores(stats: DataFrame, min_texts: int) -> DataFrame:
    """``lang, digest, outlier`` and one score a kind of the distinct texts of every language, written once."""
    names = [*STATS, *SHARES]
    # copies in one language have the same statistics; min() only picks them
    texts = written(stats.where(F.col("n_words").isNotNull()).groupBy("lang", "digest").agg(*[F.min(c).alias(c) for c in names]), "texts")
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n"))
    few = broadcast_if_small(sizes.where(F.col("n") < min_texts).select("lang", F.lit(ALL).alias("__all")))
    counts = _value_counts(texts.select("lang", *names))
    if not few.isEmpty():
        # a text that stands in several languages is one text here, but for a statistic that depends on the language
        spread = texts.select("digest", F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(c).alias("value")) for i, c in enumerate(names)])).alias("c"))
        everywhere = spread.select("digest", "c.stat", "c.value").distinct().groupBy("stat", "value").agg(F.count("*").alias("n"))
        counts = counts.join(few, "lang", "left_anti").unionByName(everywhere.withColumn("lang", F.lit(ALL)))
    ranks = exact_ranks(counts, ["lang", "stat"], "value", "n")
    low, high = (F.col("below") + F.col("n")) / F.col("total"), (F.col("total") - F.col("below")) / F.col("total")
    surprise = written(ranks.select(F.col("lang").alias("among"), "stat", "value", (-F.log(F.least(low, high))).alias("either"), (-F.log(F.greatest(low, F.lit(RAREST)))).alias("low"), (-F.log(F.greatest(high, F.lit(RAREST)))).alias("high")), "surprise")
    placed = texts.join(few, "lang", "left").select("lang", "digest", F.coalesce("__all", "lang").alias("among"), *names)
    if surprise.count() <= BROADCAST_ROWS:
        return written(_looked_up(placed, surprise), "scores")
    cells = placed.select("lang", "digest", "among", F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(c).alias("value")) for i, c in enumerate(names)])).alias("c")).select("lang", "digest", "among", "c.stat", "c.value")
    # values that most texts share are split over as many tasks as there are salts
    salted = surprise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    found = cells.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALT)).cast("int")).join(salted, ["among", "stat", "value", "salt"])

    def score(tails: dict[str, int]) -> Column:
        part = F.lit(0.0)
        for stat, weight in tails.items():
            part = F.when(F.col("stat") == names.index(stat), abs(weight) * F.col("high" if weight > 0 else "low")).otherwise(part)
        return F.sum(part)

    base = F.sum(F.when(F.col("stat") < len(STATS), F.col("either")))
    scored = found.groupBy("lang", "digest").agg(F.round(base, 6).alias("outlier"), *[F.round(score(t), 6).alias(f"score_{k}") for k, t in TAILS.items()])
    return written(scored, "scores")


def _value_counts(texts: DataFrame) -> DataFrame:
    """``lang, stat, value, n``: how many rows have which value, counted in each batch before the shuffle."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs)):
                mine = langs == lang
                for stat in range(1, batch.num_columns):
                    values, n = np.unique(batch.column(stat).to_numpy()[mine], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array([stat - 1] * len(values), pa.int32()), pa.array(values), pa.array(n, pa.int64())], names=["lang", "stat", "value", "n"])

    return texts.mapInArrow(run, "lang string, stat int, value double, n long").groupBy("lang", "stat", "value").agg(F.sum("n").alias("n"))


def _looked_up(placed: DataFrame, surprise: DataFrame) -> DataFrame:
    """The scores of ``placed`` with the surprises (of counted size) as sorted columns in every worker: no join, no shuffle."""
    names = [*STATS, *SHARES]
    ordered = surprise.orderBy("among", "stat", "value").toPandas()
    columns = {key: tuple(g[c].to_numpy() for c in ("value", "either", "low", "high")) for key, g in ordered.groupby(["among", "stat"])}
    shared = placed.sparkSession.sparkContext.broadcast(columns)
    fields = ["outlier", *[f"score_{k}" for k in TAILS]]

    def run(batches):
        for batch in batches:
            among = batch.column(2).to_numpy(zero_copy_only=False)
            out = np.zeros((len(fields), len(among)))
            for key in sorted(set(among)):
                mine = among == key
                for i, name in enumerate(names):
                    value, either, low, high = shared.value[key, i]
                    at = np.searchsorted(value, batch.column(3 + i).to_numpy()[mine])
                    if i < len(STATS):
                        out[0, mine] += either[at]
                    for k, tails in enumerate(TAILS.values(), 1):
                        if weight := tails.get(name):
                            out[k, mine] += abs(weight) * (high if weight > 0 else low)[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.round(o, 6)) for o in out]], names=["lang", "digest", *fields])

    return placed.mapInArrow(run, "lang string, digest binary, " + ", ".join(f"{f} double" for f in fields))


def outlier_scores(stats: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """``doc_id, score`` and one score a kind (:data:`TAILS`) of every document that has a text, one row per document.

    ``score`` adds up the surprise of all statistics: ``-ln`` of the smaller of the two tail probabilities (values at
    most, at least as large) among the distinct texts of the document's language, so copies count once, however many
    there are, and ties share one probability. The score of a kind adds up the one-sided tails that speak for it.
    Texts of a language with fewer than ``min_texts`` distinct ones are ranked among those of all languages.
    """
    scores = _text_scores(stats, min_texts)
    return stats.where(F.col("n_words").isNotNull()).join(scores, ["lang", "digest"]).select("doc_id", F.col("outlier").alias("score"), *[f"score_{k}" for k in TAILS])


def thresholds(scores: DataFrame, deviations: dict[str, float] | None = None) -> dict[str, float]:
    """Least score of each kind, from the distribution of the scores of all distinct texts."""
    d = deviations or DEVIATIONS
    row = scores.agg(*[F.avg(f"score_{k}").alias(f"m_{k}") for k in TAILS], *[F.stddev_pop(f"score_{k}").alias(f"s_{k}") for k in TAILS]).first()
    return {k: (row[f"m_{k}"] or 0.0) + d[k] * (row[f"s_{k}"] or 0.0) for k in TAILS}


def kinds(stats: DataFrame, deviations: dict[str, float] | None = None) -> DataFrame:
    """p9: ``doc_id, kind`` of the documents that are no prose.

    The structure that has the largest share of a text names the kind it may be; words in no order are junk where the
    text has no structure. A text is reported if its score for that kind is an outlier, ``deviations`` standard
    deviations above the mean of all texts; of tables, lists and known forms of junk it is then checked that they are
    most of the text.
    """
    stats = written(stats, "quality")
    scores = _text_scores(stats, MIN_TEXTS)
    least = thresholds(scores, deviations)
    share = F.greatest("junk", "table_share", "list_share")
    named = F.when(share == 0, "disorder").when(F.col("junk") == share, "junk").when(F.col("table_share") == share, "table").otherwise("list")
    texts = stats.where(F.col("n_words").isNotNull()).withColumn("__kind", named)
    outlier = F.coalesce(*[F.when(F.col("__kind") == k, F.col(f"score_{k}") >= t) for k, t in least.items()])
    candidates = texts.join(scores, ["lang", "digest"]).where(outlier)
    return candidates.where((F.col("__kind") == "disorder") | (share >= MOST)).select("doc_id", F.when(F.col("__kind") == "disorder", "junk").otherwise(F.col("__kind")).alias("kind"))
