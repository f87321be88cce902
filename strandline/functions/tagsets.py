"""Predicates on tags and entity clean-up on token arrays.

``tokens`` is ``array<struct<word, lemma, tag, entity, ...>>``; spans are half-open token ranges within it. Null tags
belong to no set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import STOP_ENTITIES

# Tags per language. A set is matched by prefix unless it is listed in WHOLE.
_ENGLISH = {
    "noun": ["N"], "verb": ["V"], "adjective": ["J"], "coordinating": ["CC", ",", "-LRB-", "-RRB-"], "final": ["N", "V", "J", "DT", "-RS", "-RR"],
    "content": ["N", "V", "J"], "no_content": ["VBN"], "vocabulary": ["N", "V", "J"], "invalid_edge": ["PRP", "IN", "TO", "DT", ","],
}
_PORTUGUESE = {
    "noun": ["NOUN", "PROPN"], "verb": ["V"], "adjective": ["ADJ"], "coordinating": ["CCONJ", ",", "-LRB-", "-RRB-"], "final": ["N", "PROPN", "V", "ADJ", "ADV", "-RS", "-RR"],
    "content": ["N", "PROPN", "V", "ADJ"], "no_content": [], "vocabulary": ["N", "PROPN", "V", "ADJ"], "invalid_edge": ["PRON", "DET", ","],
}
TAGS = {"english": _ENGLISH, "portuguese": _PORTUGUESE, "spanish": _PORTUGUESE}
WHOLE = {"english": {"coordinating", "no_content"}, "portuguese": {"coordinating", "noun", "adjective"}, "spanish": {"coordinating", "noun", "adjective"}}


def is_(kind: str, tag: Column, language: str = "english") -> Column:
    """Whether a tag belongs to a set, by prefix or as a whole."""
    values = TAGS[language][kind]
    if kind in WHOLE[language]:
        return F.coalesce(tag.isin(*values), F.lit(False))
    test = F.lit(False)
    for v in values:
        test = test | tag.startswith(v)
    return F.coalesce(test, F.lit(False))


def is_content(tag: Column, language: str = "english") -> Column:
    """Nouns, verbs and adjectives, without English past participles."""
    return is_("content", tag, language) & ~is_("no_content", tag, language) if TAGS[language]["no_content"] else is_("content", tag, language)


def has_content(tokens: Column, stops: list[str], language: str = "english") -> Column:
    """A noun somewhere, and a token with a lemma of more than one letter and a content tag that is neither a stop word nor a stop entity."""
    good = lambda t: (F.length(t["lemma"]) > 1) & is_content(t["tag"], language) & ~t["lemma"].isin(*stops) & ~F.coalesce(t["entity"].isin(*STOP_ENTITIES), F.lit(False))
    return F.exists(tokens, lambda t: is_("noun", t["tag"], language)) & F.exists(tokens, good)


def content_name(tokens: Column, stops: list[str], language: str = "english", excluded: list[str] | None = None) -> Column:
    """Words of content tokens joined by blanks; all words if there is none. Lemmas are tested, words come out, without ``excluded`` ones."""
    kept = F.filter(tokens, lambda t: is_("vocabulary", t["tag"], language) & ~t["lemma"].isin(*stops) & ~F.coalesce(t["entity"].isin(*STOP_ENTITIES), F.lit(False)) & ~t["word"].isin(*(excluded or [])))
    return F.array_join(F.transform(F.when(F.size(kept) == 0, tokens).otherwise(kept), lambda t: t["word"]), " ")


def trimmed(tokens: Column, start: Column, stop: Column, language: str = "english") -> Column:
    """``struct<start, stop>`` without edge tags at both ends; unchanged if nothing would be left."""
    inside = F.slice(tokens, start + 1, stop - start)
    good = F.filter(F.transform(inside, lambda t, i: F.when(~is_("invalid_edge", t["tag"], language), i)), lambda i: i.isNotNull())
    return F.when(F.size(good) > 0, F.struct((start + F.array_min(good)).alias("start"), (start + F.array_max(good) + 1).alias("stop"))).otherwise(F.struct(start.alias("start"), stop.alias("stop")))


def split_coordinated(tokens: Column, start: Column, stop: Column, language: str = "english") -> Column:
    """``array<struct<start, stop>>``: the parts of a span between coordinating tokens that do not follow an adjective.

    ``maize , beans and rice`` gives three parts; a list of adjectives before one noun stays whole. Of several
    coordinating tokens at the end the last stays as a part, as does a span of one such token.
    """
    splits = lambda i: is_("coordinating", F.get(tokens, i)["tag"], language) & ~((i > 0) & is_("adjective", F.get(tokens, F.greatest(i - 1, F.lit(0)))["tag"], language))
    cuts = F.filter(F.sequence(start, F.greatest(stop - 1, start)), splits)
    edges = F.zip_with(F.concat(F.array(start), F.transform(cuts, lambda i: i + 1)), F.concat(cuts, F.array(stop)), lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    last = stop - 1
    alone = (stop > start) & splits(last) & ((stop - start == 1) | splits(F.greatest(last - 1, F.lit(0))))
    parts = F.filter(edges, lambda e: e["stop"] > e["start"])
    return F.when(alone, F.concat(parts, F.array(F.struct(last.alias("start"), stop.alias("stop"))))).otherwise(parts)


def valid_final(tokens: Column, language: str = "english") -> Column:
    """Whether the last token may end an entity; a span without tokens may."""
    return (F.size(tokens) == 0) | is_("final", F.get(tokens, F.size(tokens) - 1)["tag"], language)


def valid_entity(tokens: Column, language: str = "english", longest: int = 50) -> Column:
    """A span that may be an entity: not too long, ends well, and holds a noun or verb outside stop entities, or starts with a determiner."""
    core = F.exists(tokens, lambda t: (is_("noun", t["tag"], language) | is_("verb", t["tag"], language)) & ~F.coalesce(t["entity"].isin(*STOP_ENTITIES), F.lit(False)))
    determined = F.lower(F.get(tokens, F.lit(0))["word"]).isin("this", "that", "these", "those")
    return (F.size(tokens) > 0) & (F.size(tokens) <= longest) & (core | determined) & valid_final(tokens, language)


def misparsed_trigger(words: Column, tags: Column) -> Column:
    """Triggers that are participles used as adjectives: one ``VBN`` token, ``diminished`` or ``limited``."""
    return (F.size(tags) == 1) & (F.get(tags, F.lit(0)) == "VBN") & F.lower(F.get(words, F.lit(0))).isin("diminished", "limited")
