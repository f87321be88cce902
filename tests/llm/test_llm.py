import random

import numpy as np
import pytest

from strandline.session import written
from strandline.llm import leakage, neardup, quality, scans, sentences, tokens
from strandline.llm.queries import tokenizer_path

random.seed(11)


# 1 sentences


@pytest.mark.parametrize(
    "text,want",
    [
        ("It rose. Dr. Lee met J. M. Poe on 15 Jan. 2018. All left.", ["It rose.", "Dr. Lee met J. M. Poe on 15 Jan. 2018.", "All left."]),
        ("A heading\n\nIt fell by 4.5 points.The rest\nwas lost, etc. “Go!” she said. (They went.) All", ["A heading", "It fell by 4.5 points.", "The rest\nwas lost, etc.", "“Go!” she said.", "(They went.)", "All"]),
        ("He replied: “It is. It was.” Then it rained.", ["He replied: “It is. It was.”", "Then it rained."]),
        ("价格上涨了86.50%。观察组问：“还要多久？”没有人回答。“水没了！”李喊道。", ["价格上涨了86.50%。", "观察组问：“还要多久？”", "没有人回答。", "“水没了！”李喊道。"]),
        ("会は「いつまで？」と尋ねた。雨だ。", ["会は「いつまで？」と尋ねた。", "雨だ。"]),
        ("ราคาสูงขึ้นร้อยละ 18.97 ในปีนี้ ต่าง ๆ ที่ขาดน้ำ เขากล่าวว่า “ฝนตก น้ำท่วม” น้ำแห้ง", ["ราคาสูงขึ้นร้อยละ 18.97 ในปีนี้", "ต่าง ๆ ที่ขาดน้ำ", "เขากล่าวว่า “ฝนตก น้ำท่วม”", "น้ำแห้ง"]),
        ("सड़क बंद रही। श्री के. राम ने कहा।", ["सड़क बंद रही।", "श्री के. राम ने कहा।"]),
        ("Am 1. Januar begann der 2. Abschnitt. Es blieb.", ["Am 1. Januar begann der 2. Abschnitt.", "Es blieb."]),
        (None, []), ("", []), (" \n\t ", []), ("“never closed. Next one.", ["“never closed.", "Next one."]),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == want


def test_sentences_cover_all_but_white_space():
    for _ in range(400):
        t = "".join(random.choices(["a", "B", ". ", ".", "! ", "\n", "\n\n", "“", "”", "(", ")", " ", "7", "。", "ก", "é"], k=random.randint(0, 40)))
        spans = sentences.sentence_spans(t)
        at = 0
        for a, b in spans:
            assert not t[at:a].strip() and a < b and not t[a].isspace() and not t[b - 1].isspace()
            at = b
        assert not t[at:].strip()


def test_long_text_is_whole():
    t = "It rose again today. " * 20_000
    assert len(sentences.sentence_spans(t)) == 20_000


def test_sentences_frame(spark):
    df = spark.createDataFrame([(1, "It was. All left.", 5), (1, "It was. All left.", 5), (2, None, 5), (3, "", 5)], "rec_no long, extracted_text string, start_char int")
    assert sorted(tuple(r) for r in sentences.sentences(df).collect()) == [(1, 0, 7), (1, 0, 7), (1, 8, 17), (1, 8, 17)]
    assert sentences.sentences(df.limit(0)).count() == 0


# 2 near duplicates


def test_signatures_estimate_similarity():
    base = "".join(random.choices("abcdefghij", k=600))
    other = base[:500] + "".join(random.choices("abcdefghij", k=100))
    a, b = neardup.window_set(base), neardup.window_set(other)
    s = neardup.signatures([base, other])
    assert abs((s[0] == s[1]).mean() - len(a & b) / len(a | b)) < 0.2
    assert (neardup.signatures([other])[0] == s[1]).all()


def test_pairs_equal_brute_force(spark):
    rows, n = [], 0
    for _ in range(40):
        base = " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(60))
        for cut in random.sample(range(0, 200, 10), 4) + [0, 0]:
            rows.append((n, base[:-cut].upper() + "z" * (cut // 3) if cut else base, "x"))
            n += 1
    rows += [(n, None, "x"), (n + 1, "", "x"), (n + 2, "short", "x"), (n + 3, " " * 5000, "x")]
    df = spark.createDataFrame(rows, "rec_no long, extracted_text string, a string")
    sets = {r: neardup.window_set(neardup.normal_text(t)) for r, t, _ in rows if t and len(neardup.normal_text(t)) >= 200}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in neardup.pairs(df).collect()]
    assert len(got) == len(set(got))
    near = {p for p in want if len(sets[p[0]] & sets[p[1]]) >= 0.65 * len(sets[p[0]] | sets[p[1]])}
    assert set(got) <= want and near <= set(got) and len(got) >= 0.98 * len(want)
    members = neardup.components(df).collect()
    assert len(members) == len(sets)
    assert neardup.pairs(df.limit(0)).count() == 0


# 3 scans

LEX = [(w, "en", w in ("the", "of", "to", "in")) for w in "the of to in market-disruption household households modern prices rose near barn lamp fields fuel river left they all 2010 and again kept market weeks".split()] + [(w, "de", w in ("der", "die")) for w in ("der", "die", "stadt")]


def test_scan_paragraphs(spark):
    text = "THE MARKET\n\n  The prices rose in the rnodern house-\nholds of the river and rose again near market-\ndisruption. They left the bam in 2Ol0 and kept\n- 1 -\n\fThe market\n\nthe fields.\n   All rose.\n- 2 -"
    df = spark.createDataFrame([(1, text, "t"), (2, None, "t"), (3, "", "t"), (4, "12", "t")], "scan_no long, extracted_text string, text string")
    lex = spark.createDataFrame(LEX, "word string, lang string, is_common boolean")
    got = {(r.scan_no, r.para_no): r.para_text for r in scans.repaired(df, lex).collect()}
    assert got == {(1, 0): "The prices rose in the modern households of the river and rose again near market-disruption. They left the barn in 2010 and kept the fields.", (1, 1): "All rose."}
    assert scans.repaired(df.limit(0), lex).count() == 0


# 7 tokens


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return tokens.vocabulary(tokenizer_path()), t


def test_ids_equal_the_public_encoder(both):
    v, t = both
    parts = ["a", "the", " the", "  ", "   ", "\n", "é", "漢字", "<|endoftext|>", "'s", "\t", "१२", "!", "0", "123", "aaaa", " ", "²", "\x1c", "\x85", " ", "👍🏽", "ﬁ", "ing", "Straße", "กำ"]
    for _ in range(4000):
        s = "".join(random.choices(parts, k=random.randint(0, 12)))
        assert v.encode(s) == t.encode(s, add_special_tokens=False).ids, repr(s)
    words = [w for w in v.ids if w.isascii() and w.isalpha()]
    for _ in range(4000):
        s = "".join(random.choices(words, k=3))
        assert v.encode(s) == t.encode(s, add_special_tokens=False).ids, repr(s)
    s = "".join(random.choices("abc déf", k=200_000))
    assert v.encode(s) == t.encode(s, add_special_tokens=False).ids


def test_ids_frame(spark, both):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 0)], "doc_id long, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df, tokenizer_path()).collect()]
    ids = both[1].encode("hello world").ids
    assert sorted(got) == [(1, []), (2, []), (3, ids), (3, ids)]
    assert tokens.encode_corpus(df.limit(0), tokenizer_path()).count() == 0


# 8 leakage


def test_leaks(spark):
    item = "Alpha beta gamma delta épsilon zeta eta theta iota kappa lambda"
    gold = spark.createDataFrame([(1, item, "x"), (2, "too short to leak", "x"), (3, None, "x"), (4, item, "x")], "item_id long, item_text string, doc_id string")
    hit = "Intro. ALPHA, beta_gamma\n\ndelta épsilon-zeta; eta theta iota KAPPA! End."
    docs = spark.createDataFrame([(1, hit), (2, " ".join(item.split()[:9])), (3, None), (4, ""), (5, "beta " + item + " x" * 100_000), (6, "kappa iota theta eta zeta")], "doc_id long, text string")
    assert {tuple(r) for r in leakage.leaks(docs, gold).collect()} == {(1, 1), (1, 4), (5, 1), (5, 4)}
    out = {r.doc_id: r for r in leakage.remove_leaks(docs, gold).collect()}
    assert out[1].text == "Intro. ! End." and out[1].drop and out[3].text is None and out[2].removed_chars == 0 and not out[5].drop
    assert leakage.leaks(docs.limit(0), gold).count() == 0 and leakage.leaks(docs, gold.limit(0)).count() == 0


# 9 quality


def test_exact_ranks(spark):
    rows = [(random.choice("ab"), float(random.randint(0, 50)), random.randint(1, 4)) for _ in range(300)]
    table = {}
    for k, v, n in rows:
        table[k, v] = table.get((k, v), 0) + n
    df = spark.createDataFrame([(k, v, n) for (k, v), n in table.items()], "k string, v double, n long")
    for parts in (1, 7):
        got = {(r.k, r.v): (r.below, r.total) for r in quality.exact_ranks(df, ["k"], "v", "n", parts).collect()}
        assert got == {(k, v): (sum(n for (a, b), n in table.items() if a == k and b < v), sum(n for (a, _), n in table.items() if a == k)) for k, v in table}


def test_kinds(spark):
    nouns = "market town river spring people harvest road village winter trade field school".split()
    prose = lambda n: " ".join(f"The {random.choice(nouns)} of the {random.choice(nouns)} fell {random.choice(['again', 'late', 'early', 'soon'])} in {random.randint(1990, 2020)}, and the {random.choice(nouns)} did not come back to it." for _ in range(n))
    words = prose(3).lower().replace(".", "").replace(",", "").split()
    docs = [(i, prose(random.randint(2, 6)), "en") for i in range(60)]
    docs += [
        (100, "\n".join(f"- {w}{i} crate" for i, w in enumerate(words)), "en"), (101, "\n".join(f"{w} | {i}.5 | {i * 7} | 3" for i, w in enumerate(words)), "en"), (102, "error 404 " * 200, "en-XX"),
        (103, "".join(random.choices("#%&/{}[]<>=+*~^", k=500)), "en"), (104, None, "en"), (105, "", None), (106, "  \n ", "en"), (107, "Home | Menu | Login | Next | Search | Print | Home | Menu | Contact | About | Top | Share", "en"),
        (108, prose(4) + "\n\n- one\n- two\n- three", "en"), (109, " ".join("".join(random.choices("bcdfgklmnpqrstvwxz", k=7)) for _ in range(60)), "en"),
    ]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, score int")
    lex = spark.createDataFrame([("the", "en", True), ("of", "en", True)], "word string, lang string, is_common boolean")
    stats = quality.statistics(df, lex)
    assert stats.count() == len(docs)
    got = {r.doc_id: r.kind for r in quality.kinds(stats).collect()}
    assert got == {100: "list", 101: "table", 102: "junk", 103: "junk", 107: "junk", 109: "junk"}
    assert quality.kinds(quality.statistics(df.limit(0), lex)).count() == 0


def test_kinds_of_copied_texts_and_rare_languages(spark):
    rng = random.Random(5)
    nouns = "market town river spring people harvest road village winter trade field school".split()
    prose = lambda n: " ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} fell {rng.choice(['again', 'late', 'early'])} in {rng.randint(1990, 2020)}, and the {rng.choice(nouns)} did not come back to it." for _ in range(n))
    menu = "Home | Menu | Login | Next | Search | Print | Home | Menu | Contact | About | Top | Share"
    docs = [(i, prose(rng.randint(2, 4)), "en") for i in range(120)] + [(i, menu, "en") for i in range(200, 320)]  # one junk text holds half of the rows
    docs += [(400, "error 404 " * 200, "xx"), (401, menu, "yy"), (402, prose(3), "yy"), (200, prose(3), "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lex = spark.createDataFrame([("the", "en", True), ("of", "en", True)], "word string, lang string, is_common boolean")
    stats = quality.statistics(df, lex)
    got = sorted((r.doc_id, r.kind) for r in quality.kinds(stats).collect())
    assert got == [(i, "junk") for i in [*range(200, 320), 400, 401]]
    scores = quality.outlier_scores(stats).collect()
    assert len(scores) == len(docs) and len({r.score for r in scores if 200 < r.doc_id < 320}) == 1


def test_word_order_covers_all_texts_of_a_language(spark):
    rng = random.Random(3)
    line = "bara dono kelu mira tosa venu lipa goru hafe".split()
    rare = [" ".join(line[i % 9] for i in range(k, k + 18)) for k in range(9)]  # the words in their order
    mixed = " ".join(2 * line[::-1])
    docs = [(i, f"note {rng.randrange(10**9)}", "en") for i in range(12_000)]  # a bounded sample is mostly these
    docs += [(20_000 + i, f"{rare[i % 9]} x{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}", "yo") for i in range(30)]
    docs += [(30_000 + i, mixed, "yo") for i in range(4)]  # copies are no evidence for their own order
    lex = spark.createDataFrame([("the", "en", True)], "word string, lang string, is_common boolean")
    stats = quality.statistics(spark.createDataFrame(docs, "doc_id long, text string, lang string"), lex)
    got = {r.doc_id: r.disorder for r in stats.where("lang = 'yo'").collect()}
    assert all(got[30_000 + i] == 1.0 for i in range(4)) and all(got[20_000 + i] < 0.1 for i in range(30))


def test_neighbour_counts(spark, monkeypatch):
    texts = [("en", "a b a b"), ("en", "b a"), ("en", "a b a b"), ("fr", "a b a b"), ("en", None)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").selectExpr("doc_id", "lang", "unhex(md5(text)) AS digest", "text")
    codes = quality._Codes()
    a, b = codes["a"], codes["b"]
    ab, ba = quality._pairs(quality.np.array([a, b, a])).tolist()
    want = {("en", False, a): 3, ("en", False, b): 3, ("en", True, ab): 2, ("en", True, ba): 2, ("fr", False, a): 2, ("fr", False, b): 2, ("fr", True, ab): 2, ("fr", True, ba): 1}
    for held in (quality.HELD, 1):
        monkeypatch.setattr(quality, "HELD", held)
        assert {(r.lang, r.pair, r.code): r.n for r in quality.neighbour_counts(df).collect()} == want


def test_disorder_of_a_text_is_that_of_its_words():
    rng = random.Random(8)
    codes = quality._Codes()
    texts = [codes.of([rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 5, 40]))]) for _ in range(30)]
    words = quality.np.sort(quality.np.array(codes.of(list("abcdef"))))
    known = {tuple(codes.of([x, y])) for x in "abcdef" for y in "abc"}
    pairs = quality.np.sort(quality.np.array([quality._pairs(quality.np.array(p))[0] for p in known]))

    def brute(t):
        both = [(x, y) for x, y in zip(t, t[1:]) if {x, y} <= set(words.tolist())]
        return sum(p not in known for p in both) / len(both) if len(both) >= quality.LEAST_NEIGHBOURS else 0.0

    assert quality.disorder(texts, words, pairs) == [brute(t) for t in texts]


def test_words_in_no_order_are_told_by_the_score(spark):
    rng = random.Random(4)
    nouns = "market town river spring people harvest road village winter trade field school".split()
    verbs = "fell rose closed opened failed moved began ended".split()
    prose = lambda n: " ".join(f"The {rng.choice(nouns)} of this {rng.choice(nouns)} {rng.choice(verbs)} in spring, so every {rng.choice(nouns)} near it {rng.choice(verbs)} soon." for _ in range(n))
    docs = [(i, "\n".join(prose(1) for _ in range(rng.randint(2, 3))), "en") for i in range(400)]
    shuffled = [w.strip(".,").lower() for w in prose(6).split()]
    rng.shuffle(shuffled)
    docs.append((900, " ".join(shuffled), "en"))
    lex = spark.createDataFrame([("the", "en", True)], "word string, lang string, is_common boolean")
    stats = quality.statistics(spark.createDataFrame(docs, "doc_id long, text string, lang string"), lex)
    assert [tuple(r) for r in quality.kinds(stats).collect()] == [(900, "junk")]
    assert quality.kinds(stats, dict.fromkeys(quality.TAILS, -99.0)).count() > 300  # the score decides


def test_scores_are_the_same_where_ranks_are_too_many_to_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["rain", "the", "7", "field."]) for _ in range(rng.randint(1, 9))), rng.choice(["en", "fr"])) for i in range(200)]
    lex = spark.createDataFrame([("the", "en", True)], "word string, lang string, is_common boolean")
    stats = written(quality.statistics(spark.createDataFrame(docs, "doc_id long, text string, lang string"), lex), "stats")
    want = sorted(map(tuple, quality.outlier_scores(stats).collect()))
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, quality.outlier_scores(stats).collect())) == want


def test_large_test_sets_are_joined_with_the_same_result(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    gold = [(i, text(rng.choice([5, 10, 14, 400]))) for i in range(40)] + [(90, None)]
    docs = [(i, " ".join([text(8), *rng.choice(gold[:40])[1].split()[: rng.choice([9, 10, 12])], text(5)])) for i in range(80)]
    docs += [(500 + i, docs[0][1]) for i in range(40)] + [(900, None), (901, ""), (0, docs[1][1])]
    d, g = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(gold, "item_id long, item_text string")
    want = sorted(map(tuple, leakage.leaks(d, g).collect())), sorted(map(repr, leakage.remove_leaks(d, g).collect()))
    assert want[0]
    monkeypatch.setattr(leakage, "MAX_NGRAMS", 10)
    assert (sorted(map(tuple, leakage.leaks(d, g).collect())), sorted(map(repr, leakage.remove_leaks(d, g).collect()))) == want


@pytest.mark.parametrize(
    "text",
    [
        "Τι είναι αυτό; |Δεν ξέρω. |Πάμε.", "བོད་ལ་ཆར་པ་བབས། |ཆུ་བོ་རྒྱས་སོ། |ལམ་ཆད་སོ།", "ရေကြီးသည်။ |လမ်းပိတ်သည်။", "ទឹកឡើង។ |ផ្លូវបិទ។", "Kupił np. chleb, tj. bułkę. |Deszcz padał. |Noc.",
        "雨来了！|2021年，路断了。|3人走了。", "He has a; but few left. |They left.", "Is it no. 5? |12 came. |All went.",
    ],
)
def test_other_scripts_and_languages(text):
    plain = text.replace("|", "")
    assert [plain[a:b] for a, b in sentences.sentence_spans(plain)] == [p.strip() for p in text.split("|")]
