"""Exact ids of a public byte-level BPE vocabulary by per-prefix dynamic programming.

Merging by rank has one property that makes it linear: in the encoding of a prefix the *last* token is unique,
and a token ``t`` ending at a prefix is that last token exactly if the last token of the prefix before ``t``
and ``t`` are *compatible*, that is, if merging the two token texts by rank keeps the border between them.
So for every prefix the vocabulary entries that end there are found with a suffix-matching automaton, the one
compatible with the stored last token in front of it is stored, and the ids follow from the back-pointers.

Pre-tokens repeat, so their ids are memoised per Python worker (bounded, cleared when full; results do not
depend on it). A text is first cut at single blanks, where a pre-token always starts.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a cut at a single blank would not be a pre-token border.
_WIDE = re.compile(r"\s  |  (?:\s|$)|[\x1c-\x1f\x85]")
MEMO = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """The vocabulary with its automaton, merge pairs and split table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.left = list(range(max(ids.values()) + 1))
        self.right = list(self.left)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rank_of = {}
        for rank, (a, b) in enumerate(pairs):
            t = ids[a + b]
            self.rank[ids[a], ids[b]] = rank
            # the first merge that makes a token is the one that is undone
            if self.left[t] == t:
                self.left[t], self.right[t] = ids[a], ids[b]
                rank_of[t] = rank
        self.made_at = [rank_of.get(t, -1) for t in range(len(self.left))]
        self.automaton = ahocorasick.Automaton()
        for text, t in ids.items():
            if t < len(self.left) and (len(text) == 1 or self.made_at[t] >= 0):
                self.automaton.add_word(text, (len(text), t))
        self.automaton.make_automaton()
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.ids = ids
        self.known_pairs: dict[tuple[int, int], bool] = {}
        self.pre_token = regex.compile(PATTERN)
        self.words = _Memo(self._word)
        self.pieces = _Memo(self._piece)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the texts of ``a`` and ``b`` by rank keeps the border between them.

        The merges that made the two tokens are undone from the latest on; the border falls if, at some state,
        the pair across it has a merge of lower rank than the next merge that the token sides still make.
        """
        key = (a, b)
        known = self.known_pairs.get(key)
        if known is None:
            if len(self.known_pairs) > 4 * MEMO:
                self.known_pairs.clear()
            known = self.known_pairs[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        made, rank, bound = self.made_at, self.rank, 1 << 60
        while True:
            across = rank.get((a, b))
            if across is not None and across < bound:
                return False
            ra, rb = made[a], made[b]
            if ra < 0 and rb < 0:
                return True
            # Of equal merges the leftmost is made first, so the later one to undo is the right side's. The bound is the
            # rank of the merge undone: an across-merge of the same rank lies to the right of the left side's (it comes
            # later and cannot take its parts), but to the left of the right side's (it comes first).
            if ra > rb:
                bound, a = ra, self.right[a]
            else:
                bound, b = rb + 1, self.left[b]

    def _word(self, word: str) -> tuple[int, ...]:
        text = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        whole = self.ids.get(text)
        if whole is not None and (len(text) == 1 or self.made_at[whole] >= 0):
            return (whole,)
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        compatible, done = self.compatible, -1
        for end, (length, t) in self.automaton.iter(text):
            if done == end:
                continue
            start = end + 1 - length
            if start == 0 or (last[start] >= 0 and compatible(last[start], t)):
                last[end + 1], size[end + 1], done = t, length, end
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return tuple(reversed(out))

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.words.__getitem__, self.pre_token.findall(piece))))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for null and empty text. Marker-like strings are plain text."""
        if not text:
            return []
        if _WIDE.search(text):
            return list(self._piece(text))
        first, *rest = text.split(" ")
        pieces = self.pieces
        return [*pieces[first], *chain.from_iterable([pieces[" " + p] for p in rest])]


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 48:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, loaded once per worker process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_corpus(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: one row per row of ``df``, in a single narrow stage without a shuffle.

    Null and empty texts give an empty list; repeated rows come out repeated; blank texts have the ids of their
    blanks; an empty table gives an empty table; other columns are not read. ``path`` must be readable by all
    executors.
    """

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1).to_pylist():
                flat.extend(v.encode(text))
                ends.append(len(flat))
                if len(v.known_pairs) > 4 * MEMO:
                    v.known_pairs.clear()
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")
