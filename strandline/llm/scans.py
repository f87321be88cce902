"""Text of scanned pages to the running paragraphs that were printed.

1. Pages: lines at the edges that are running headers or page numbers are removed; lines are joined to paragraphs,
   across pages too; a word broken at a line end keeps or loses its hyphen by the evidence of the lexicon.
2. Misreadings: each unknown word type is joined in SQL with known words over *anagram hashes* (the sum of the fifth
   powers of the characters): a confusion such as ``m`` read as ``rn`` changes the hash by a fixed difference
   wherever it happens, so the hash minus the difference is an equality key. Candidates are ranked by the
   number of confusions, edit distance and the frequency of the known word.
3. The ranked corrections are applied to the words they were found for, joined by scan.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import broadcast_if_small, written

# What was printed and what it is misread as.
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("i", "l"), ("l", "i"), ("i", "1"), ("l", "1"), ("o", "0"), ("s", "5"), ("b", "6"), ("ó", "6"), ("g", "9"), ("z", "2"), ("b", "8"),
    ("t", "f"), ("f", "t"), ("u", "ii"), ("ii", "u"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("h", "b"), ("b", "h"), ("h", "li"), ("li", "h"), ("w", "vv"), ("vv", "w"),
    ("y", "v"), ("v", "y"), ("n", "u"), ("u", "n"), ("a", "o"), ("o", "a"), ("n", "ri"), ("k", "lc"), ("q", "g"), ("g", "q"), ("r", "n"), ("nn", "m"), ("in", "m"),
    ("é", "e"), ("è", "e"), ("ê", "e"), ("á", "a"), ("à", "a"), ("â", "a"), ("í", "i"), ("î", "i"), ("ó", "o"), ("ô", "o"), ("ú", "u"), ("û", "u"), ("ñ", "n"), ("ç", "c"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ü", "ii"), ("ß", "b"),
]
#: The marker of a line break inside a word whose hyphen is not decided yet.
BREAK = "\x1f"
#: Words up to which the lexicon is sent to all workers.
MAX_LEXICON = 1_000_000

_HYPHENS = "-‐‑¬\xad"
_WORD = re.compile(rf"[^\W_]+(?:[-{BREAK}][^\W_]+)*")
_NUMBER = re.compile(r"^[\dOoQlIiSsBZ]+(?:[.,\xa0/–-][\dOoQlIiSsBZ]+)*%?$")
_DIGITS = str.maketrans("OoQlIiSsBZ", "0001115582")
_PAGE_NUMBER = re.compile(r"^\W*(?:[^\W\d_]{3,7}\s+)?(?:[\dOolIS]{1,4}|[ivxlc1]{1,7})(?:\s*(?:/|von|of|de|sur)\s*[\dOolIS]{1,4})?\W*$", re.I)
_NUMBERED = re.compile(r"^(?:[\dOolIS]{1,4}|[ivxlc]{1,6})\s*[|·•–—]\s*\S.*$|^\S.*?(?:\s{2,}|\s*[|·•]\s*)(?:[\dOolIS]{1,4}|[ivxlc]{1,6})$")

#: A heading: few words without inner punctuation, beginning with a capital.
_TITLE = re.compile(r"^[A-ZÀ-Þ0-9][^\s.,;:]*(?: [^\s.,;:]+){0,7}$")
_HEAD = re.compile(r"^\S.*\S\s{3,}(?:[\dOolIS]{1,4}|[ivxlc]{1,6})$")


def _shape(line: str) -> str:
    """A header line without case, page number and the characters that are misread."""
    text = re.sub(r"^\W*[\dOolIS]{1,4}\s*\||\s{2,}[\dOolIS]{1,4}$", "", line.strip()).lower()
    return re.sub(r"[^\w]|[il1o0e c5s6t f]", "", text)


@lru_cache(maxsize=8192)
def _is_upper(line: str) -> bool:
    """A line in capitals. Every line is asked for several times in a row."""
    letters = sum(map(str.isalpha, line))
    return letters >= 3 and sum(map(str.isupper, line)) >= 0.75 * letters


_FOOT = re.compile(r"^(?:[\dOolIS]{1,4}|[ivxlc]{1,6})\s*[|·•–—]\s*\S.*$")


def _width(lines: list[str]) -> int:
    """The width that running text was broken at."""
    return max((len(x) for x in lines if x.strip() and not _is_upper(x) and not _HEAD.match(x.strip()) and not _FOOT.match(x.strip())), default=0)


def _loose(raw: str, following: list[str], width: int, margin: int = 2) -> bool:
    """A line that the next word would have fitted on was not broken there: it is no running text. Misreadings change lengths by up to two."""
    rest = next((x for x in following if x.strip()), "")
    return bool(rest) and raw.strip()[-1] not in _HYPHENS and len(raw) + 1 + len(rest.split()[0]) <= width - margin


def _pages(text: str) -> list[list[str]]:
    """Lines by page. Form feeds can be missing: a page also ends behind a foot line and before a head line."""
    pages = []
    whole = [[unicodedata.normalize("NFC", x.rstrip()) for x in p.split("\n")] for p in text.replace("\r\n", "\n").split("\f")]
    width = _width([x for p in whole for x in p])
    for page in whole:
        lines: list[str] = []
        for at, raw in enumerate(page):
            line = raw.strip()
            foot = line and not line.endswith(".") and (_PAGE_NUMBER.match(line) or _FOOT.match(line))
            head = line and not foot and not line.endswith(".") and (_HEAD.match(line) or _is_upper(line) or (_TITLE.match(line) and _loose(raw, page[at + 1 : at + 4], width, 10)))
            if head and any(x.strip() for x in lines):
                pages.append(lines)
                lines = []
            lines.append(raw)
            if foot:
                pages.append(lines)
                lines = []
        pages.append(lines)
    return [p for p in pages if any(x.strip() for x in p)]


def body_lines(text: str) -> list[list[str]]:
    """The lines of each page without furniture at its edges; blank lines inside a page stay."""
    pages = _pages(text)
    width = _width([x for p in pages for x in p])
    tops: dict[str, int] = {}
    for p in pages:
        filled = [x for x in p if x.strip()]
        for line in {*filled[:1], *filled[-1:]}:
            if s := _shape(line):
                tops[s] = tops.get(s, 0) + 1
    out = []
    for p in pages:
        lines = list(p)
        for top in (True, False):
            for _ in range(2):
                while lines and not lines[0 if top else -1].strip():
                    lines.pop(0 if top else -1)
                if not lines:
                    break
                raw = lines[0 if top else -1]
                line = raw.strip()
                if line.endswith(".") and not _PAGE_NUMBER.match(line):
                    break
                loose = top and _loose(raw, lines[1:4], width)
                if not line.endswith(".") and (_PAGE_NUMBER.match(line) or _NUMBERED.match(line) or _is_upper(line) or (tops.get(_shape(line), 0) >= 2 and len(line) < 0.9 * width) or loose):
                    lines.pop(0 if top else -1)
                else:
                    break
        while lines and not lines[0].strip():
            lines.pop(0)
        while lines and not lines[-1].strip():
            lines.pop()
        out.append(lines)
    return out


def _joined(lines: list[str], known: frozenset | set, start: str = "") -> str:
    """Lines as running text; a word broken at a line end is whole if a form of it is known, else it holds :data:`BREAK`."""
    now = start
    for raw in lines:
        line = " ".join(x for x in re.split(r"[ \t]+", raw) if x)
        if now and now[-1] in _HYPHENS and len(now) > 1 and now[-2].isalnum():
            head = _WORD.findall(now[:-1])[-1]
            tail = (_WORD.match(line) or [""])[0]
            whole, compound = (head + tail).lower(), f"{head}-{tail}".lower()
            now = now[:-1] + ("" if whole in known else "-" if compound in known else BREAK) + line
        else:
            now = f"{now} {line}" if now else line
    return now


def _sentence_count(text: str) -> int:
    return len(re.findall(r"\.(?= [A-ZÀ-Þ]|$)", text))


def paragraphs(text: str | None, known: frozenset | set) -> list[str]:
    """The paragraphs of a scan, across its pages. Every paragraph ends with a full stop; blank lines or indents begin new ones.

    At a page end with a full stop there may be neither: the paragraph has ended if the next word would have fitted
    on its last line; else the pieces belong together unless they make it longer, in sentences, than any paragraph
    that lies whole on a page of the scan.
    """
    if not text or not text.strip():
        return []
    pages = body_lines(text)
    width = _width([x for p in pages for x in p])
    blanks = indents = 0
    for p in pages:
        filled = [(i, x) for i, x in enumerate(p) if x.strip()]
        for (i, x), (j, y) in zip(filled, filled[1:]):
            if x.rstrip().endswith("."):
                blanks += j > i + 1
                indents += y[0] in " \t"
    spaced = blanks >= indents
    pieces: list[tuple[int, list[str]]] = []
    for number, p in enumerate(pages):
        blank, last = False, ""
        for raw in p:
            if not raw.strip():
                blank = True
                continue
            if not last or (last.rstrip().endswith(".") and (blank if spaced else raw[0] in " \t")):
                pieces.append((number, []))
            pieces[-1][1].append(raw)
            blank, last = False, raw
    whole = [_sentence_count(_joined(x, known)) for k, (n, x) in enumerate(pieces) if 0 < k < len(pieces) - 1 and pieces[k - 1][0] == n == pieces[k + 1][0]]
    longest = max(whole) if len(whole) >= 2 else None
    done: list[str] = []
    page, last = -1, ""
    for number, lines in pieces:
        ended = bool(done) and done[-1].endswith(".")
        if ended and number != page:
            if spaced:
                first = lines[0].split()[0]
                ended = len(last.rstrip()) + 1 + len(first) <= width or (longest is not None and _sentence_count(done[-1]) + _sentence_count(_joined(lines, known)) > longest)
            else:
                ended = lines[0][0] in " \t"
        if not done or ended:
            done.append(_joined(lines, known))
        else:
            done[-1] = _joined(lines, known, done[-1])
        page, last = number, lines[-1]
    return [unicodedata.normalize("NFC", d.replace("ﬁ", "fi").replace("ﬂ", "fl").replace("ﬀ", "ff").replace("ﬃ", "ffi").replace("ﬄ", "ffl")) for d in done]


def restore_numbers(paragraph: str, known) -> str:
    """Figures with letters that are read for digits; a token needs a digit and must not be a known word."""
    out = []
    for token in paragraph.split(" "):
        core = token.strip("()[]“”«»\"'.,;:!?")
        if core and any(c.isdigit() for c in core) and any(c.isalpha() for c in core) and _NUMBER.match(core) and core.lower() not in known:
            at = token.index(core)
            token = token[:at] + core.translate(_DIGITS) + token[at + len(core) :]
        out.append(token)
    return " ".join(out)


def _lexicon(lexicon: DataFrame):
    rows = lexicon.where(F.col("word").isNotNull()).select("lang", F.lower("word").alias("word"), F.coalesce("is_common", F.lit(False)).alias("c")).limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the lexicon has more than {MAX_LEXICON} words")
    words: dict[str, set] = {}
    common: dict[str, set] = {}
    for r in rows:
        words.setdefault(r.lang, set()).add(r.word)
        if r.c:
            common.setdefault(r.lang, set()).add(r.word)
    return lexicon.sparkSession.sparkContext.broadcast(({k: frozenset(v) for k, v in words.items()}, {k: frozenset(v) for k, v in common.items()}))


def _assembled(scans: DataFrame, shared) -> DataFrame:
    """``scan_no, lang, para_no, text``: paragraphs before the correction of words."""

    def run(batches):
        words, common = shared.value
        for batch in batches:
            rows = []
            for scan, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or not text.strip():
                    continue
                tokens = [w.lower() for w in _WORD.findall(text)]
                lang = max(sorted(common), key=lambda x: sum(t in common[x] for t in tokens), default="und")
                known = words.get(lang, frozenset())
                for i, p in enumerate(paragraphs(text, known)):
                    rows.append((scan, lang, i, restore_numbers(p, known)))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=["scan_no", "lang", "para_no", "text"])

    return scans.select(scans["scan_no"].cast("long").alias("scan_no"), scans["extracted_text"].alias("t")).mapInArrow(run, "scan_no long, lang string, para_no int, text string")


def _word_types(parts: DataFrame, shared) -> DataFrame:
    """``lang, word, known, n, capital``: types per batch, to be summed. ``capital``: occurrences inside a sentence with a capital."""

    def run(batches):
        words, _ = shared.value
        for batch in batches:
            found: dict[tuple, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = words.get(lang, frozenset())
                start = True
                for m in _WORD.finditer(text):
                    w = m[0]
                    low = w.lower()
                    if not any(c.isalpha() for c in low):
                        start = text[m.end() : m.end() + 1] == "."
                        continue
                    row = found.setdefault((lang, low, low in known), [0, 0, 0])
                    row[0] += 1
                    if not start:
                        row[1] += 1
                        row[2] += w[0].isupper()
                    start = text[m.end() : m.end() + 2] in (". ", ".")
            rows = [(*k, *v) for k, v in found.items()]
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=["lang", "word", "known", "n", "inside", "capital"])

    types = parts.select("lang", "text").mapInArrow(run, "lang string, word string, known boolean, n long, inside long, capital long")
    return types.groupBy("lang", "word", "known").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"), F.sum("capital").alias("capital"))


# code points are taken modulo 1,024 so that the sum of their fifth powers cannot overflow; the edit distance verifies
ANAGRAM = "aggregate(transform(split({0}, ''), c -> cast(ascii(c) % 1024 as bigint)), 0L, (a, c) -> a + c * c * c * c * c)"


def corrections(types: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``lang, word, fix, capital``: the best known word for each unknown type that has one.

    One confusion is tried first, two for what is left; the explode is by the fixed number of differences, never by
    the data. ``capital`` is the share of the fix's occurrences inside sentences that have a capital.
    """
    spark = types.sparkSession
    deltas = spark.createDataFrame(sorted(set(CONFUSIONS)), "printed string, seen string").selectExpr(f"{ANAGRAM.format('seen')} - {ANAGRAM.format('printed')} AS delta", "greatest(length(printed), length(seen)) AS cost").groupBy("delta").agg(F.min("cost").alias("cost"))
    known = types.where("known").select("lang", "word", F.col("n").alias("freq"), (F.col("capital") / F.greatest("inside", F.lit(1))).alias("capital"))
    lex = lexicon.where(F.col("word").isNotNull()).select("lang", F.lower("word").alias("fix")).distinct().join(known.withColumnRenamed("word", "fix"), ["lang", "fix"], "left").selectExpr("lang", "fix", "coalesce(freq, 0L) AS freq", "coalesce(capital, 0.0D) AS capital", f"{ANAGRAM.format('fix')} AS hash")
    lex = broadcast_if_small(lex)
    # a broken word may be whole or a compound
    unknown = types.where(~F.col("known") & (F.length("word") >= 2)).select("lang", "word", F.explode(F.array_distinct(F.array(F.replace("word", F.lit(BREAK), F.lit("")), F.replace("word", F.lit(BREAK), F.lit("-"))))).alias("form")).withColumn("hash", F.expr(ANAGRAM.format("form")))
    one = deltas.select("delta", "cost", F.lit(1).alias("steps")).unionByName(spark.createDataFrame([(0, 0, 0)], "delta long, cost int, steps int"))
    a, b = deltas.alias("a"), deltas.alias("b")
    two = a.join(b, F.expr("a.delta <= b.delta")).selectExpr("a.delta + b.delta AS delta", "a.cost + b.cost AS cost").groupBy("delta").agg(F.min("cost").alias("cost")).withColumn("steps", F.lit(2))

    def ranked(words: DataFrame, steps: DataFrame) -> DataFrame:
        table = [(r.delta, r.cost, r.steps) for r in steps.collect()]  # as many as there are fixed confusions, or pairs of them
        values = F.from_json(F.lit("[" + ",".join(f'{{"delta":{d},"cost":{c},"steps":{s}}}' for d, c, s in table) + "]"), "array<struct<delta:bigint,cost:int,steps:int>>")
        tried = words.select("lang", "word", "form", "hash", F.explode(values).alias("d")).select("lang", "word", "form", (F.col("hash") - F.col("d.delta")).alias("hash"), "d.cost", "d.steps")
        found = tried.join(lex, ["lang", "hash"]).withColumn("distance", F.levenshtein("form", "fix")).where("distance <= cost")
        best = Window.partitionBy("lang", "word").orderBy("steps", "distance", F.desc("freq"), "fix")
        return found.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("lang", "word", "fix", "capital")

    first = written(ranked(unknown, one), "scan-fixes")
    rest = unknown.join(first, ["lang", "word"], "left_anti").where(F.length("form") >= 5)
    return first.unionByName(ranked(rest, two))


def _apply(text: str, fixes: dict[str, tuple[str, float]]) -> str:
    out, at, start = [], 0, True
    for m in _WORD.finditer(text):
        w = m[0]
        hit = fixes.get(w.lower())
        if hit:
            fix, capital = hit
            if w[0].isupper() or (fix[0] != w[0].lower() and (start or capital > 0.5)):
                fix = fix[0].upper() + fix[1:]
            if len(w) > 2 and w.isupper():
                fix = fix.upper()
            out += [text[at : m.start()], fix]
            at = m.end()
        start = text[m.end() : m.end() + 2] in (". ", ".")
    return ("".join(out) + text[at:]).replace(BREAK, "")


def repaired(scans: DataFrame, lexicon: DataFrame) -> DataFrame:
    """p3: ``scan_no, para_no, para_text`` of every scan with text.

    Null, empty and blank texts give no row; a scan of furniture only gives none; a repeated row gives its
    paragraphs again; words without a known correction stay as read; other columns are not read; empty tables give
    an empty result. Corrections travel as (scan, word) rows only for scans that need one, so their number does
    not have to fit anywhere at once.
    """
    shared = _lexicon(lexicon)
    parts = written(_assembled(scans, shared), "scan-parts")
    types = written(_word_types(parts, shared), "scan-types")
    fixes = written(corrections(types, lexicon), "scan-corrections")
    words = parts.select("scan_no", "lang", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+(?:[-" + BREAK + r"][\p{L}\p{N}]+)*)"), 1), F.lower))).alias("word"))
    per_scan = words.join(broadcast_if_small(fixes), ["lang", "word"]).select("scan_no", "word", "fix", "capital").distinct().groupBy("scan_no").agg(F.collect_list(F.struct("word", "fix", "capital")).alias("fixes"))

    def run(batches):
        for batch in batches:
            texts = [_apply(t, {f["word"]: (f["fix"], f["capital"]) for f in fs or []}) for t, fs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["scan_no", "para_no", "para_text"])

    return parts.select("scan_no", "para_no", "text").join(per_scan, "scan_no", "left").select("scan_no", "para_no", "text", "fixes").mapInArrow(run, "scan_no long, para_no int, para_text string")
