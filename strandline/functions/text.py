"""Column functions on text, tokens, rule provenance and file names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_BREAK = r"[.!?]+\s+"
# Entity labels that make a token no content.
STOP_ENTITIES = ["COUNTRY", "DATE", "DURATION", "LOCATION", "MONEY", "NATIONALITY", "NUMBER", "ORDINAL", "ORGANIZATION", "PERSON", "PLACE", "SET", "STATE_OR_PROVINCE", "TIME", "TITLE"]


def sentences(text: Column) -> Column:
    """Pieces between end marks followed by white space; empty pieces are left out. Null for null."""
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: F.trim(s) != "")


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\s*\n\s*\n\s*"), lambda p: F.trim(p)), lambda p: p != "")


def words(text: Column) -> Column:
    """Lower-case ASCII words; the variant of tokenisation that both engines agree on."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def too_many_single_letters(tokens: Column, most: int = 10) -> Column:
    """True for debris: more than ``most`` one-letter tokens other than ``I``, ``a`` and ``A``."""
    return F.size(F.filter(tokens, lambda t: (F.length(t) == 1) & ~t.isin("I", "a", "A"))) > most


def content_words(tokens: Column, stops: list[str]) -> Column:
    """Tokens of more than one letter that are no stop words, in order."""
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*stops))


def canonical_name(tokens: Column, stops: list[str]) -> Column:
    """Content words joined by blanks; all words if none has content."""
    kept = content_words(tokens, stops)
    return F.array_join(F.when(F.size(kept) == 0, tokens).otherwise(kept), " ")


def found_by(parts: Column) -> Column:
    """Provenance of merged mentions: names of several ``a++b`` strings, each once, in order of appearance."""
    return F.array_join(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.split(p, r"\+\+")))), "++")


def rules(found: Column) -> Column:
    """Rule names of one provenance string, each once."""
    return F.array_distinct(F.split(found, r"\+\+"))


def before_first(text: Column, separator: str) -> Column:
    """Text before the first separator; all of it if there is none."""
    return F.substring_index(text, separator, 1)


def after_last(text: Column, separator: str) -> Column:
    """Text behind the last separator; all of it if there is none."""
    return F.substring_index(text, separator, -1)


def stem_adverb(adverb: Column) -> Column:
    """``heavily`` -> ``heavy``, ``severely`` -> ``severe``; other words stay."""
    return F.when(adverb.endswith("ily"), F.regexp_replace(adverb, "ily$", "y")).when(adverb.endswith("ly"), F.regexp_replace(adverb, "ly$", "")).otherwise(adverb)


def unescape_tsv(field: Column) -> Column:
    r"""``\n \t \r \\`` in a field to the characters they stand for; the backslash itself comes last."""
    out = field
    for code, char in (("\\\\", "\x00"), ("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\x00", "\\")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def escape_tsv(field: Column) -> Column:
    r"""Line ends, tabs and backslashes as ``\n \t \r \\``."""
    out = field
    for char, code in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def to_number(text: Column) -> Column:
    """Figure without ``~ % , < >``; null if the rest is none."""
    return F.regexp_replace(text, r"[~%,<>]", "").try_cast("double")


def quantity_class(text: Column) -> Column:
    """Frequency, approximation, minimum or maximum that a phrase states; null if none."""
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\b(daily|weekly|monthly|yearly|annually)\b|\b(per|every|each) (day|week|month|year)\b"), "frequency")
        .when(low.rlike(r"\b(about|approximately|around|roughly|nearly|almost|some)\b"), "approximation")
        .when(low.rlike(r"\b(at least|more than|no less than|minimum)\b"), "minimum")
        .when(low.rlike(r"\b(at most|less than|up to|no more than|maximum)\b"), "maximum")
    )


def file_parts(name: Column) -> Column:
    """``struct<base, distinguisher, extension>`` of ``base+2.jsonld``; the distinguisher is 0 where none is written."""
    leaf = after_last(name, "/")
    stem, ext = F.regexp_extract(leaf, r"^([^.]*)(.*)$", 1), F.regexp_extract(leaf, r"^([^.]*)(.*)$", 2)
    return F.struct(F.substring_index(stem, "+", 1).alias("base"), F.coalesce(F.regexp_extract(stem, r"\+(\d+)$", 1).try_cast("int"), F.lit(0)).alias("distinguisher"), F.regexp_replace(ext, r"^\.", "").alias("extension"))


def nfkc_with_offsets(text: Column) -> Column:
    """``struct<text, starts, ends>``: compatibility form, and for each of its characters the range of the original it came from."""

    @F.pandas_udf("text string, starts array<int>, ends array<int>")
    def normalise(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None:
                rows.append((None, None, None))
                continue
            parts = [unicodedata.normalize("NFKC", c) for c in t]
            at = [i for i, n in enumerate(parts) for _ in n]
            rows.append(("".join(parts), at, [i + 1 for i in at]))
        return pd.DataFrame(rows, columns=["text", "starts", "ends"])

    return normalise(text)


def edit_distance(a: str, b: str, substitute: bool = True, transpose: bool = False, free_case: bool = False) -> int:
    """Edit distance with switchable substitution, transposition of neighbours and change of case at no cost."""
    if free_case:
        a, b = a.lower(), b.lower()
    n, m = len(a), len(b)
    rows = [list(range(m + 1))]
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            best = min(rows[i - 1][j], row[j - 1]) + 1
            if a[i - 1] == b[j - 1]:
                best = min(best, rows[i - 1][j - 1])
            elif substitute:
                best = min(best, rows[i - 1][j - 1] + 1)
            if transpose and i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                best = min(best, rows[i - 2][j - 2] + 1)
            row[j] = best
        rows.append(row)
    return rows[n][m]


def matching_brackets(text: str) -> bool:
    """Whether each kind of bracket closes what it opens; kinds are independent of each other."""
    for opening, closing in ("()", "[]", "{}", "<>", "«»", "“”"):
        depth = 0
        for c in text:
            depth += (c == opening) - (c == closing)
            if depth < 0:
                return False
        if depth:
            return False
    return True


def primary_tag(lang: Column) -> Column:
    """The lower-case primary part of a language tag (``en`` of ``EN`` and ``en-XX``), ``und`` where it is null or has none."""
    tag = F.lower(F.regexp_extract(F.trim(lang), "^[A-Za-z]+", 0))
    return F.when(F.length(tag) > 0, tag).otherwise("und")


#: Function words that the other languages of the same script do not have, and their least share in an English text.
ENGLISH, ENGLISH_SHARE = ["the", "of", "and", "to", "that", "this", "from", "is", "for", "by"], 0.05


def english(docs: DataFrame) -> DataFrame:
    """The documents whose primary tag is ``en``, and of those without a tag the ones whose function words are English."""
    w = words(F.col("text"))
    share = F.size(F.filter(w, lambda x: x.isin(*ENGLISH))) / F.greatest(F.size(w), F.lit(1))
    return docs.where((primary_tag(F.col("lang")) == "en") | (primary_tag(F.col("lang")) == "und") & (share >= ENGLISH_SHARE))


class _Ascii(dict):
    """Code point -> ASCII text: Greek letters by their names, accented letters without accents, other characters a blank."""

    def __init__(self, keep_accents: bool):
        self.keep = keep_accents

    def __missing__(self, code: int) -> str:
        c = chr(code)
        name = unicodedata.name(c, "")
        if code < 0x80:
            out = c
        elif name.startswith("GREEK ") and " LETTER " in name:
            out = name.split(" LETTER ")[1].split(" WITH ")[0].lower().replace("final ", "").replace(" ", "")
        else:
            plain = unicodedata.normalize("NFKD", c)
            base = "".join(x for x in plain if ord(x) < 0x80)
            accented = c.isalpha() and base != "" and all(ord(x) < 0x80 or unicodedata.combining(x) for x in plain)
            out = c if accented and self.keep else base if base.strip() else " "
        self[code] = out
        return out


def sanitized(text: Column, keep_accents: bool = False) -> Column:
    """ASCII form of a text: Greek letters spelt out, accents removed unless kept, anything unknown a blank. Null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        table = _Ascii(keep_accents)
        return s.map(lambda x: x if x.isascii() else x.translate(table), na_action="ignore")

    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(run(text))


def document_text(text: Column, sentence_ends: Column) -> Column:
    """The text on one line but for a line break behind each sentence.

    Line breaks and form feeds become blanks; at each of ``sentence_ends`` (offsets behind the sentences) before the end
    of the text a blank becomes a line break. Other characters stand inside a word and stay.
    """
    flat = F.translate(text, "\n\f", "  ")
    at = lambda i: F.substr(flat, i + 1, F.lit(1))
    ends = F.filter(F.array_sort(F.array_distinct(sentence_ends)), lambda e: (e < F.length(flat)) & (at(e) == " "))
    pieces = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1)), F.concat(ends, F.array(F.length(flat))), lambda a, b: F.substr(flat, a + 1, b - a))
    return F.array_join(pieces, "\n")


def extract_number(tokens: Column, start: Column, stop: Column) -> Column:
    """``struct<start, stop, value>`` of the first run of NUMBER or PERCENT tokens of a span; null where there is none or it cannot be read.

    The norm of the run's first token is read, or the word itself where the run is one token.
    """
    numeric = lambda i: F.coalesce(F.get(tokens, i)["entity"].isin("NUMBER", "PERCENT"), F.lit(False))
    inside = F.filter(F.sequence(start, F.greatest(stop - 1, start)), lambda i: (i < stop) & numeric(i))
    first = F.get(inside, F.lit(0))
    gap = F.get(F.filter(F.sequence(first, F.greatest(stop, first)), lambda i: (i >= stop) | ~numeric(i)), F.lit(0))
    norm, word = to_number(F.get(tokens, first)["norm"]), to_number(F.get(tokens, first)["word"])
    value = F.coalesce(norm, F.when(gap == first + 1, word))
    return F.when(first.isNotNull() & value.isNotNull(), F.struct(first.alias("start"), gap.alias("stop"), value.alias("value")))
