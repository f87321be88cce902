"""A small deterministic annotator for English: tokens, tags, lemmas and chunks, without a parser.

It is meant for token rules and tests. Documents annotated elsewhere (with dependencies) are ingested instead; both
give ``tokens array<struct<word, lemma, tag, chunk, entity, start, stop>>`` and ``edges``. Offsets are code points.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"[^\W_]+(?:[-'’.,][^\W_]+)*|[^\w\s]|_")
_END = re.compile(r"(?<=[a-z0-9)”\"%])[.!?]+[”\")]*(?=\s+[A-Z“\"(]|\s*$)|\n\s*\n")

# Closed classes of words.
CLOSED = {
    "DT": "the a an this that these those every each some any no both all another",
    "IN": "of in on at by for with from after before because since without near across between during through into until around along towards against under over above below about as than if while although unless whether",
    "TO": "to", "CC": "and or but nor yet", "MD": "can could will would should may might must shall", "PRP": "he she it they we you i him her them us", "PRP$": "his its their our your my",
    "WDT": "which what", "WP": "who whom", "WRB": "when where why how", "EX": "there", "RB": "not now soon then still also yet once first only again", "VBZ": "is has does", "VBP": "are have do", "VBD": "was were had did fell rose lost left kept hit held said wrote met grew began drove sold led", "VB": "be cause protect offset",
    "JJ": "heavy severe rising local widespread chronic acute seasonal weak strong poor falling erratic limited prolonged sudden regional moderate persistent early delayed unexpected uneven recurrent higher fewer main new", "CD": "one two three four five six seven eight nine ten",
}
_CLOSED = {w: tag for tag, words in reversed(CLOSED.items()) for w in words.split()}
# Irregular lemmas.
LEMMAS = {"is": "be", "are": "be", "was": "be", "were": "be", "has": "have", "had": "have", "does": "do", "did": "do", "fell": "fall", "rose": "rise", "lost": "lose", "left": "leave", "kept": "keep", "held": "hold", "said": "say", "wrote": "write", "met": "meet", "grew": "grow", "began": "begin", "drove": "drive", "sold": "sell", "led": "lead"}
_SUFFIXES = [(re.compile(p), t) for p, t in ((r"ly$", "RB"), (r"ing$", "VBG"), (r"(ed)$", "VBD"), (r"(tion|sion|ment|ness|ity|ance|ence|age|ure|ism)s?$", "NN"), (r"(ous|ful|ive|al|ic|able|ible|less)$", "JJ"))]


def tag(word: str, first: bool, before: str) -> str:
    low = word.lower()
    if not word[0].isalnum():
        return "." if word[0] in ".!?" else "," if word[0] == "," else "SYM"
    if word[0].isdigit():
        return "CD"
    if low in _CLOSED:
        return _CLOSED[low]
    if word[0].isupper() and not first:
        return "NNP"
    for pattern, t in _SUFFIXES:
        if pattern.search(low) and len(low) > 4:
            if before in ("DT", "JJ", "PRP$", "IN"):
                return {"VBD": "JJ", "VBG": "NN"}.get(t, t)
            return t
    return "NNS" if low.endswith("s") and not low.endswith("ss") and len(low) > 3 else "NN"


def lemma(word: str, t: str) -> str:
    low = word.lower()
    if low in LEMMAS:
        return LEMMAS[low]
    if t == "NNS" and low.endswith("ies"):
        return low[:-3] + "y"
    if t == "NNS":
        return low[:-1]
    if t in ("VBD", "VBN", "VBG") and len(low) > 5:
        stem = low[:-2] if low.endswith("ed") else low[:-3]
        if len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
            return stem[:-1]
        return stem + "e" if re.search(r"(at|it|uc|us|bl|gg|er|v|s|z|g|c|as)$", stem) and not re.search(r"(ee|er|ss)$", stem) else stem
    return low


def annotate_sentence(text: str, offset: int = 0) -> list[dict]:
    """Tokens of one sentence."""
    out: list[dict] = []
    for m in _TOKEN.finditer(text):
        t = tag(m[0], not out, out[-1]["tag"] if out else "")
        np = t[0] in "NJ" or t in ("DT", "CD", "PRP$")
        kind = "NP" if np else "VP" if t[0] == "V" or t == "MD" else None
        inside = bool(out) and out[-1]["chunk"].endswith(kind or "-") and t not in ("DT", "PRP$")
        out.append({"word": m[0], "lemma": lemma(m[0], t), "tag": t, "chunk": f"{'I' if inside else 'B'}-{kind}" if kind else "O", "entity": "NUMBER" if t == "CD" else "O", "start": offset + m.start(), "stop": offset + m.end()})
    return out


def annotate(text: str | None) -> list[list[dict]]:
    """Annotated sentences of a text; none for null and blank texts."""
    out, at = [], 0
    text = text or ""
    for m in [*_END.finditer(text), None]:
        end = m.end() if m else len(text)
        if text[at:end].strip():
            out.append(annotate_sentence(text[at:end], at))
        at = end
    return out


SCHEMA = "sent_key string, doc_id long, sent_no int, tokens array<struct<word:string,lemma:string,tag:string,chunk:string,entity:string,start:int,stop:int>>, edges array<struct<src:int,dst:int,rel:string>>"


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``sent_key, doc_id, sent_no, tokens, edges`` (no edges) in one narrow stage; very long sentences (150 tokens) are left out as debris."""

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(f"{d}:{i}", d, i, s, []) for i, s in enumerate(annotate(t)) if len(s) < 150]
            token = pa.struct([(f, pa.string()) for f in ("word", "lemma", "tag", "chunk", "entity")] + [("start", pa.int32()), ("stop", pa.int32())])
            edge = pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("rel", pa.string())])
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(token), pa.list_(edge)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=["sent_key", "doc_id", "sent_no", "tokens", "edges"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
