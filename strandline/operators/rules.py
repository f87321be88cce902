"""Rules over annotated sentences: token patterns and dependency patterns, read from YAML, applied sentence by sentence.

A sentence is local: it carries its tokens and dependency edges as arrays, so matching is one narrow Arrow stage
without a shuffle. Rules are data; they are parsed on the driver and compiled once per worker.

Rule fields: ``name, label (one or a list), priority ('1', '2+', '1-3'), type (token|dependency), pattern, action``.

Token patterns: ``[constraint]``, bare or quoted words, ``@Label`` and ``@name:Label`` (earlier mentions), groups,
``|``, ``? * + {n} {n,m}`` (with ``?`` for fewest), named groups ``(?<name> ...)``, look-around ``(?= ) (?! ) (?<= ) (?<! )``.
Constraints: ``field=value`` with ``field`` in ``word raw lemma tag chunk entity norm mention incoming outgoing``, ``value``
a word, a quoted string or ``/regex/``, joined by ``& | !`` and parentheses.
Dependency patterns: a line ``trigger = <token pattern>`` (or a first argument without a path: triggerless), then ``name: Label?*+{n,m} = path``;
a path is a sequence of ``rel``, ``>rel`` (to the dependent), ``<rel`` (to the governor), ``/regex/``, ``|``, groups, repetitions,
and ``[constraint]`` on the token reached.

Priorities are run in order; a priority with an open end is repeated until nothing new is found. Among alternatives
the first matches, repetition takes as much as it can; matches of one rule do not overlap, the leftmost first.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame

#: Rounds behind the last priority after which rules that feed on their own mentions are taken to have no end.
MAX_ROUNDS = 1000
TOKEN_FIELDS = ("word", "raw", "lemma", "tag", "chunk", "entity", "norm")
MENTIONS = "sent_key string, mention_no int, label string, labels array<string>, start int, stop int, trigger_start int, trigger_stop int, text string, args array<struct<role:string,mention_no:int>>, found_by string"
_LEX = re.compile(r"\s*(\(\?<[A-Za-z_]\w*>|\(\?<=|\(\?<!|\(\?=|\(\?!|\{\d*,?\d*\}|/(?:\\.|[^/\\])+/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|@[\w-]+(?::[\w-]+)?|[\[\]()|&!=?*+<>]|[^\s\[\]()|&!=?*+<>@{}/\"']+)")


class Sentence:
    """Annotated tokens with the edges both ways and the mentions found so far."""

    def __init__(self, fields: dict[str, list], edges: list[tuple[int, int, str]]):
        self.fields, self.n = fields, len(fields["word"])
        self.out: list[list[tuple[int, str]]] = [[] for _ in range(self.n)]
        self.inc: list[list[tuple[int, str]]] = [[] for _ in range(self.n)]
        for a, b, rel in edges or []:
            if 0 <= a < self.n and 0 <= b < self.n:
                self.out[a].append((b, rel))
                self.inc[b].append((a, rel))
        self.mentions: list[dict] = []

    def labelled(self, label: str) -> list[dict]:
        return [m for m in self.mentions if label in m["labels"]]


class _Words:
    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at : at + 30]!r}")
            self.items.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else None

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if got is None or (want is not None and got != want):
            raise ValueError(f"expected {want!r}, found {got!r}")
        self.at += 1
        return got


def _test(value: str) -> Callable[[str], bool]:
    if value[0] == "/" and len(value) > 1:
        pattern = re.compile(value[1:-1].replace("\\/", "/"))
        return lambda s: pattern.search(s) is not None
    if value[0] in "\"'":
        value = value[1:-1]
    return lambda s: s == value


def _constraint(w: _Words) -> Callable[[Sentence, int], bool]:
    def either():
        parts = [both()]
        while w.peek() == "|":
            w.take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else lambda s, i: any(p(s, i) for p in parts)

    def both():
        parts = [single()]
        while w.peek() == "&":
            w.take()
            parts.append(single())
        return parts[0] if len(parts) == 1 else lambda s, i: all(p(s, i) for p in parts)

    def single():
        if w.peek() == "!":
            w.take()
            inner = single()
            return lambda s, i: not inner(s, i)
        if w.peek() == "(":
            w.take()
            inner = either()
            w.take(")")
            return inner
        field = w.take()
        w.take("=")
        test = _test(w.take())
        if field == "mention":
            return lambda s, i: any(m["start"] <= i < m["stop"] and any(map(test, m["labels"])) for m in s.mentions)
        if field in ("outgoing", "incoming"):
            return lambda s, i: any(test(r) for _, r in (s.out if field == "outgoing" else s.inc)[i])
        if field not in TOKEN_FIELDS:
            raise ValueError(f"unknown field {field}")
        return lambda s, i: test(s.fields[field][i] or "") if field in s.fields else False

    return either()


# A compiled pattern is ``match(sentence, at, captures) -> iterator of (end, captures)``, best first.
Pattern = Callable[[Sentence, int, tuple], Iterator[tuple[int, tuple]]]


def _repeat(inner: Pattern, low: int, high: int | None, lazy: bool) -> Pattern:
    def match(s, at, caps, done=0):
        stop = done >= low
        if lazy and stop:
            yield at, caps
        if high is None or done < high:
            for end, c in inner(s, at, caps):
                if end != at:
                    yield from match(s, end, c, done + 1)
        if not lazy and stop:
            yield at, caps

    return match


def _quantified(w: _Words, inner: Pattern) -> Pattern:
    q = w.peek()
    if q in ("?", "*", "+") or q and q[0] == "{":
        w.take()
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(q, (0, 0))
        if q[0] == "{":
            a, comma, b = q[1:-1].partition(",")
            low, high = int(a or 0), (int(b) if b else None) if comma else int(a)
        lazy = w.peek() == "?"
        if lazy:
            w.take()
        return _repeat(inner, low, high, lazy)
    return inner


def _token_pattern(w: _Words) -> Pattern:
    def alternatives() -> Pattern:
        parts = [sequence()]
        while w.peek() == "|":
            w.take()
            parts.append(sequence())
        if len(parts) == 1:
            return parts[0]

        def match(s, at, caps):
            for p in parts:
                yield from p(s, at, caps)

        return match

    def sequence() -> Pattern:
        parts = []
        while w.peek() not in (None, ")", "|"):
            parts.append(_quantified(w, atom()))

        def match(s, at, caps, k=0):
            if k == len(parts):
                yield at, caps
            else:
                for end, c in parts[k](s, at, caps):
                    yield from match(s, end, c, k + 1)

        return match

    def atom() -> Pattern:
        t = w.take()
        if t == "[":
            test = (lambda s, i: True) if w.peek() == "]" else _constraint(w)
            w.take("]")
            return one(test)
        if t == "(":
            inner = alternatives()
            w.take(")")
            return inner
        if t.startswith("(?<") and t.endswith(">"):
            name, inner = t[3:-1], alternatives()
            w.take(")")

            def match(s, at, caps):
                for end, c in inner(s, at, caps):
                    yield end, (*c, (name, at, end, None))

            return match
        if t in ("(?=", "(?!", "(?<=", "(?<!"):
            inner = alternatives()
            w.take(")")
            want = t[-1] == "="
            if "<" in t:
                return lambda s, at, caps: iter([(at, caps)] if any(end == at for b in range(at + 1) for end, _ in inner(s, b, ())) is want else [])
            return lambda s, at, caps: iter([(at, caps)] if (next(inner(s, at, ()), None) is not None) is want else [])
        if t[0] == "@":
            name, _, label = t[1:].rpartition(":")

            def match(s, at, caps):
                for m in s.labelled(label):
                    if m["start"] == at:
                        yield m["stop"], (*caps, (name, m["start"], m["stop"], m["no"])) if name else caps

            return match
        test = _test(t)
        return one(lambda s, i: test(s.fields["word"][i]))

    def one(test) -> Pattern:
        return lambda s, at, caps: iter([(at + 1, caps)] if at < s.n and test(s, at) else [])

    out = alternatives()
    if w.peek() is not None:
        raise ValueError(f"unexpected {w.peek()!r}")
    return out


# A compiled path is ``walk(sentence, tokens) -> tokens``, in the order they are reached.
def _path(w: _Words) -> Callable[[Sentence, int], list[int]]:
    def alternatives():
        parts = [sequence()]
        while w.peek() == "|":
            w.take()
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else lambda s, i: list(dict.fromkeys(x for p in parts for x in p(s, i)))

    def sequence():
        parts = []
        while w.peek() not in (None, ")", "|"):
            parts.append(step())

        def walk(s, i):
            reached = [i]
            for p in parts:
                reached = list(dict.fromkeys(x for r in reached for x in p(s, r)))
            return reached

        return walk

    def step():
        t = w.take()
        if t == "(":
            inner = alternatives()
            w.take(")")
        elif t == "[":
            test = _constraint(w)
            w.take("]")
            return lambda s, i: [i] if test(s, i) else []
        elif t in ("(?=", "(?!"):
            ahead = alternatives()
            w.take(")")
            return lambda s, i: [i] if bool(ahead(s, i)) is (t == "(?=") else []
        else:
            back = t == "<"
            if t in ("<", ">"):
                t = w.take()
            test = _test(t)
            inner = lambda s, i, back=back, test=test: [j for j, r in (s.inc if back else s.out)[i] if test(r)]
        q = w.peek()
        if q in ("?", "*", "+") or q and q[0] == "{":
            w.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(q, (0, 0))
            if q[0] == "{":
                a, comma, b = q[1:-1].partition(",")
                low, high = int(a or 0), (int(b) if b else None) if comma else int(a)

            def repeated(s, i):
                level, found, seen, k = [i], [i] if low == 0 else [], {i}, 0
                while level and (high is None or k < high):
                    k += 1
                    level = [x for x in dict.fromkeys(y for r in level for y in inner(s, r)) if x not in seen]
                    seen.update(level)
                    if k >= low:
                        found += level
                return found

            return repeated
        return inner

    out = alternatives()
    if w.peek() is not None:
        raise ValueError(f"unexpected {w.peek()!r}")
    return out


_ARGUMENT = re.compile(r"^\s*([A-Za-z_]\w*)\s*:\s*([\w-]+)\s*([?*+]|\{\d*,?\d*\})?\s*(?:=\s*(.*))?$")


class Rule:
    def __init__(self, spec: dict):
        self.name = str(spec["name"])
        labels = spec["label"] if isinstance(spec.get("label"), list) else [spec.get("label", "Mention")]
        self.labels = [str(x) for x in labels]
        self.action = spec.get("action")
        low, sep, high = re.match(r"^(\d+)([+-]?)(\d*)$", str(spec.get("priority", 1))).groups()
        self.low, self.high = int(low), None if sep == "+" else int(high) if sep == "-" else int(low)
        self.token: Pattern | None = None
        self.arguments: list[tuple] = []
        lines = [re.sub(r"(^|\s)#.*$", "", x) for x in str(spec["pattern"]).splitlines()]
        if spec.get("type", "dependency") == "token":
            self.kind, self.token = "token", _token_pattern(_Words(" ".join(lines)))
            return
        self.kind, joined = "dependency", []
        for line in lines:
            if re.match(r"^\s*(trigger\s*=|[A-Za-z_]\w*\s*:\s*[\w-]+)", line):
                joined.append(line.strip())
            elif line.strip() and joined:
                joined[-1] += " " + line.strip()
        for line in joined:
            if line.startswith("trigger"):
                self.token = _token_pattern(_Words(line.partition("=")[2]))
                continue
            name, label, q, path = _ARGUMENT.match(line).groups()
            low, high = (1, 1) if q is None else {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(q, (1, 1))
            if q and q[0] == "{":
                a, comma, b = q[1:-1].partition(",")
                low, high = int(a or 0), (int(b) if b else None) if comma else int(a)
            self.arguments.append((name, label, low, high, q, _path(_Words(path)) if path else None))

    def active(self, priority: int) -> bool:
        return priority >= self.low and (self.high is None or priority <= self.high)

    def find(self, s: Sentence) -> list[dict]:
        """New mentions as ``start, stop, trigger, args``."""
        if self.kind == "token" or self.token is not None:
            hits, at = [], 0
            while at < s.n:
                hit = next(((e, c) for e, c in self.token(s, at, ()) if e > at), None)
                if hit:
                    hits.append((at, *hit))
                    at = hit[0]
                else:
                    at += 1
            if self.kind == "token":
                return [self._token(s, *h) for h in hits]
            return [m for a, e, _ in hits for m in self._events(s, range(a, e), (a, e), self.arguments, [])]
        # without a trigger the first argument is where the paths begin
        name, label, *_ = self.arguments[0]
        return [x for m in s.labelled(label) for x in self._events(s, range(m["start"], m["stop"]), None, self.arguments[1:], [(name, m["no"])])]

    def _token(self, s, start, stop, caps) -> dict:
        named = [c for c in caps if c[0] and c[0] != "trigger"]
        trigger = next(((c[1], c[2]) for c in caps if c[0] == "trigger"), None)
        args = []
        for name, a, b, no in named:
            if no is None:
                no = next((m["no"] for m in s.mentions if (m["start"], m["stop"]) == (a, b)), None)
                if no is None:
                    no = _add(s, {"labels": ["Span"], "start": a, "stop": b, "trigger": None, "args": []}, self.name)
            args.append((name, no))
        return {"start": start, "stop": stop, "trigger": trigger, "args": args}

    def _events(self, s, begin, trigger, arguments, bound) -> list[dict]:
        found = list(bound)
        for name, label, low, high, _, path in arguments:
            reached = list(dict.fromkeys(t for b in begin for t in path(s, b))) if path else list(begin)
            nos = list(dict.fromkeys(m["no"] for t in reached for m in s.labelled(label) if m["start"] <= t < m["stop"] and not (trigger and m["start"] <= trigger[0] and m["stop"] >= trigger[1] and m["trigger"] is None)))
            nos = nos[:high] if high is not None else nos
            if len(nos) < low:
                return []
            found += [(name, no) for no in nos]
        spans = [(s.mentions[no]["start"], s.mentions[no]["stop"]) for _, no in found] + ([trigger] if trigger else [])
        return [{"start": min(a for a, _ in spans), "stop": max(b for _, b in spans), "trigger": trigger, "args": found}] if spans else []


def _add(s: Sentence, m: dict, rule: str) -> int | None:
    key = (tuple(m["labels"]), m["start"], m["stop"], m["trigger"], tuple(m["args"]))
    for old in s.mentions:
        if old["key"] == key:
            if rule not in old["found_by"]:
                old["found_by"].append(rule)
            return None
    s.mentions.append(m | {"key": key, "no": len(s.mentions), "found_by": [rule]})
    return len(s.mentions) - 1


def _fill(value, variables: dict):
    """Template variables ``${ name }``; a list becomes alternatives of a regular expression."""
    if isinstance(value, str):
        text = value
        for _ in range(8):  # variables may hold variables
            new = re.sub(r"\$\{\s*([\w.-]+)\s*\}", lambda m: "|".join(map(str, v)) if isinstance(v := variables.get(m[1], m[0]), list) else str(v), text)
            if new == text:
                break
            text = new
        return text
    if isinstance(value, list):
        return [_fill(v, variables) for v in value]
    if isinstance(value, dict):
        return {k: _fill(v, variables) for k, v in value.items()}
    return value


def load_rules(text: str, variables: dict | None = None, read: Callable[[str], str] | None = None) -> list[dict]:
    """Rule specifications of a YAML grammar: ``vars``, ``rules``, and entries that ``import`` another file with own ``vars``."""
    doc = yaml.safe_load(text) or {}
    variables, rules, out = dict(variables or {}), doc, []
    if isinstance(doc, dict):
        own = doc.get("vars") or {}
        own = yaml.safe_load(read(own)) if isinstance(own, str) and read else own
        variables = own | variables
        rules = doc.get("rules") or []
    for r in rules:
        if "import" in r:
            if read is None:
                raise ValueError(f"cannot import {r['import']}")
            out += load_rules(read(r["import"]), variables | _fill(r.get("vars") or {}, variables), read)
        else:
            out.append(_fill(r, variables))
    return out


def compile_rules(specs: list[dict]) -> list[Rule]:
    return [Rule(s) for s in specs]


def ancestors(taxonomy, label: str) -> list[str]:
    """A label and its ancestors in a taxonomy of nested lists and maps."""

    def walk(node, path):
        if isinstance(node, list):
            for x in node:
                if found := walk(x, path):
                    return found
        elif isinstance(node, dict):
            for k, v in node.items():
                if k == label:
                    return [k, *path]
                if found := walk(v, [k, *path]):
                    return found
        elif node == label:
            return [label, *path]
        return None

    return walk(taxonomy, []) or [label]


def apply_rules(s: Sentence, rules: list[Rule], taxonomy=None) -> list[dict]:
    """Mentions of a sentence: priorities in order, open ones repeated until nothing new is found."""
    lineage: dict[str, list[str]] = {}
    priority, last = 1, max((max(r.low, r.high or 0) for r in rules), default=0)
    while True:
        before = len(s.mentions)
        for r in rules:
            if r.active(priority):
                labels = [x for label in r.labels for x in lineage.setdefault(label, ancestors(taxonomy, label))]
                for m in r.find(s):
                    _add(s, m | {"labels": list(dict.fromkeys(labels))}, r.name)
        if priority >= last and len(s.mentions) == before:
            return s.mentions
        if priority > last + MAX_ROUNDS:
            raise RecursionError("the rules keep finding new mentions")
        priority += 1


def find_mentions(sentences: DataFrame, specs: list[dict], taxonomy=None) -> DataFrame:
    """Mentions of ``sentences(sent_key, tokens array<struct<word, lemma, tag, chunk, entity, ...>>, edges array<struct<src, dst, rel>>)``.

    One row per mention, numbered within its sentence; arguments refer to these numbers. Null or empty tokens have no
    mentions; missing fields never match; a sentence that cannot be processed comes out without mentions, the rest go
    on. A repeated row repeats its mentions; an empty table gives an empty one.
    """
    compile_rules(specs)  # a rule that cannot be read fails here, on the driver
    payload = json.dumps([specs, taxonomy])

    def run(batches):
        specs, taxonomy = json.loads(payload)
        rules = compile_rules(specs)
        for batch in batches:
            rows = []
            for key, tokens, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not tokens:
                    continue
                try:
                    fields = {f: [t.get(f) for t in tokens] for f in TOKEN_FIELDS if f in tokens[0]}
                    s = Sentence(fields, [(e["src"], e["dst"], e["rel"]) for e in edges or []])
                    mentions = apply_rules(s, rules, taxonomy)
                except (RecursionError, TypeError, AttributeError, ValueError, KeyError, IndexError):
                    continue  # one sentence must not end the job: it comes out without mentions
                for m in mentions:
                    a, b = m["trigger"] or (None, None)
                    text = " ".join(str(w) for w in s.fields["word"][m["start"] : m["stop"]])
                    rows.append((key, m["no"], m["labels"][0], m["labels"], m["start"], m["stop"], a, b, text, [{"role": r, "mention_no": n} for r, n in m["args"]], "++".join(m["found_by"])))
            import pyarrow as pa

            names = ["sent_key", "mention_no", "label", "labels", "start", "stop", "trigger_start", "trigger_stop", "text", "args", "found_by"]
            i, t = pa.int32(), pa.string()
            kinds = [t, i, t, pa.list_(t), i, i, i, i, t, pa.list_(pa.struct([("role", t), ("mention_no", i)])), t]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(kinds)], names=names)

    return sentences.select("sent_key", "tokens", "edges").mapInArrow(run, MENTIONS)


def expand(start: int, stop: int, edges: list[tuple[int, int, str]], hops: int, valid_in: str, valid_out: str, invalid_out: str = r"$^", barrier: set[int] | None = None, n: int | None = None) -> tuple[int, int]:
    """The span of a mention widened over the dependency graph: first over governors, then over dependents, ``hops`` rounds each.

    Edges whose relation matches are walked; ``barrier`` holds tokens (triggers, avoided mentions) that are neither
    entered nor crossed.
    """
    barrier = barrier or set()
    reached = set(range(start, stop))
    for forward, valid, invalid in ((False, valid_in, r"$^"), (True, valid_out, invalid_out)):
        ok, bad = re.compile(valid), re.compile(invalid)
        frontier = set(reached)
        for _ in range(hops):
            step = {b if forward else a for a, b, r in edges if (a if forward else b) in frontier and ok.search(r) and not bad.search(r)}
            frontier = {t for t in step - reached if t not in barrier and not any(min(t, start) < x < max(t, stop - 1) for x in barrier)}
            reached |= frontier
    return min(reached), max(reached) + 1
