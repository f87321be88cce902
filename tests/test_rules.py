import pytest

from strandline.operators.rules import Sentence, apply_rules, compile_rules, expand, find_mentions, load_rules

TAXONOMY = [{"Entity": ["Concept"]}, {"Event": [{"Directed": ["Causal"]}, {"Change": ["Increase", "Decrease"]}]}]
GRAMMAR = r"""
vars:
  cause: [caus, trigger]
  trigger: "${ cause }|lead"
rules:
  - name: noun-phrase
    label: Concept
    priority: 1
    type: token
    pattern: |
      [tag=/^JJ|^VBN$/]* [tag=/^N/]+
  - name: increased
    label: Increase
    priority: 2
    type: token
    pattern: |
      (?<trigger> [lemma=increase & tag=VBN]) (?= [tag=/^N/])
  - name: fall-in
    label: Decrease
    priority: 2
    pattern: |
      trigger = [word=/(?i)^decreas/ & tag=/^N/]
      theme: Entity = nmod_in
  - name: verb-causal
    label: Causal
    priority: 3+
    pattern: |
      trigger = [lemma=/^(${ trigger })/ & !outgoing=neg]
      cause: Entity = >nsubj nmod_in?   # the head of what causes
      effect: Entity+ = dobj conj_and{,2}
"""


def sentence():
    words = "The decrease in rainfall caused significantly increased poverty and famine .".split()
    tags = "DT NN IN NN VBD RB VBN NN CC NN .".split()
    lemmas = "the decrease in rainfall cause significantly increase poverty and famine .".split()
    edges = [(4, 1, "nsubj"), (1, 3, "nmod_in"), (4, 7, "dobj"), (7, 6, "amod"), (7, 9, "conj_and"), (1, 0, "det"), (6, 5, "advmod")]
    return words, tags, lemmas, edges


def test_grammar():
    w, t, l, e = sentence()
    s = Sentence({"word": w, "tag": t, "lemma": l}, e)
    found = apply_rules(s, compile_rules(load_rules(GRAMMAR)), TAXONOMY)
    text = lambda m: " ".join(w[m["start"] : m["stop"]])
    by = {}
    for m in found:
        by.setdefault(m["labels"][0], []).append(m)
    assert [text(m) for m in by["Concept"]] == ["decrease", "rainfall", "increased poverty", "famine"]
    assert by["Concept"][0]["labels"] == ["Concept", "Entity"]
    (fall,) = by["Decrease"]
    assert [(r, text(found[n])) for r, n in fall["args"]] == [("theme", "rainfall")]
    assert by["Increase"][0]["trigger"] == (6, 7)
    (causal,) = by["Causal"]
    assert [(r, text(found[n])) for r, n in causal["args"]] == [("cause", "decrease"), ("effect", "increased poverty"), ("effect", "famine")]
    assert causal["trigger"] == (4, 5) and causal["labels"] == ["Causal", "Directed", "Event"]


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("a b", [(0, 2)]), ('"b" [word=/c|d/]', [(1, 3)]), ("[]{2}", [(0, 2), (2, 4)]), ("[word=/[abc]/]+", [(0, 3)]), ("[word=/[abc]/]+? [word=/[bcd]/]", [(0, 2), (2, 4)]), ("(?<= a) b (?! d)", [(1, 2)]),
        ("(a|c) [!word=x & (word=b | word=d)]", [(0, 2), (2, 4)]), ("z*", []), ("b (c d)?", [(1, 4)]), ("(?<x> a b) c", [(0, 2), (0, 3)]),
    ],
)
def test_token_patterns(pattern, want):
    s = Sentence({"word": list("abcd")}, [])
    found = apply_rules(s, compile_rules([{"name": "r", "label": "X", "type": "token", "pattern": pattern}]))
    assert [(m["start"], m["stop"]) for m in found] == want


def test_bad_rules_fail_on_the_driver():
    for pattern in ("[word=", "(a", "[nofield=x]", "a)"):
        with pytest.raises(ValueError):
            compile_rules([{"name": "r", "label": "X", "type": "token", "pattern": pattern}])


def test_imports_fill_variables():
    files = {"inner.yml": "- {name: '${ label }-r', label: '${ label }', type: token, pattern: '[word=/${ words }/]'}"}
    specs = load_rules("rules:\n  - import: inner.yml\n    vars: {label: Increase, words: [up, rise]}\n  - import: inner.yml\n    vars: {label: Decrease, words: down}\n", read=files.__getitem__)
    assert [(s["name"], s["pattern"]) for s in specs] == [("Increase-r", "[word=/up|rise/]"), ("Decrease-r", "[word=/down/]")]


def test_frame(spark):
    w, t, l, e = sentence()
    token = [dict(word=a, tag=b, lemma=c) for a, b, c in zip(w, t, l)]
    edge = [dict(src=a, dst=b, rel=r) for a, b, r in e]
    schema = "sent_key string, tokens array<struct<word:string,tag:string,lemma:string>>, edges array<struct<src:int,dst:int,rel:string>>, text string"
    df = spark.createDataFrame([("s1", token, edge, "x"), ("s2", None, None, "x"), ("s3", [], [], "x"), ("s4", token, None, "x")], schema)
    out = find_mentions(df, load_rules(GRAMMAR), TAXONOMY)
    got = {(r.sent_key, r.label, r.text, r.found_by) for r in out.collect()}
    assert ("s1", "Causal", "decrease in rainfall caused significantly increased poverty and famine", "verb-causal") in got
    assert {k for k, *_ in got} == {"s1", "s4"} and not any(k == "s4" and label == "Causal" for k, label, *_ in got)
    one = sorted(map(repr, out.collect()))
    assert sorted(map(repr, find_mentions(df.repartition(3), load_rules(GRAMMAR), TAXONOMY).collect())) == one
    assert find_mentions(df.limit(0), load_rules(GRAMMAR)).count() == 0


def test_expand():
    *_, e = sentence()
    assert expand(3, 4, e, 2, "nmod", "det|amod") == (0, 4)
    assert expand(7, 8, e, 2, "$^", "amod|advmod|conj") == (5, 10)
    assert expand(7, 8, e, 2, "$^", "amod|advmod|conj", "conj") == (5, 8)
    assert expand(3, 4, e, 2, "nmod|nsubj", "det", barrier={4}) == (0, 4)
