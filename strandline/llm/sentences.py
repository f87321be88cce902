"""Sentence boundaries for all languages and scripts with a linear-chain model and Viterbi decoding.

Characters are tagged *boundary* or *inside*. Only a run of end marks (with the closing quotes and brackets
behind it) or, in scripts that put no marks at the end, a blank can be a boundary, so the chain of a
paragraph has one node per such place and all other characters are inside. A node is scored by log-linear
weights on what stands before and behind it (character classes, known abbreviations, the shape of an unknown word)
and by transition weights on the tag, the kind and the distance of the node before: a boundary close behind another
is unlikely, and whether a quotation opened at a boundary tells a quotation that starts a sentence (and goes on after
it) from one that ends it. Places within quotes are no nodes: a quotation is never split.

The weights are fitted by the averaged structured perceptron on :data:`EXAMPLES`, marked paragraphs of the module; for
unpunctuated scripts they are marked sentences with their marks stripped and a blank left in their place.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations by what they need behind them.
TITLES = frozenset("dr dra drs mr mrs ms prof st ste gov gen col capt lt sgt rev hon sen rep pres sr sra srta d dña don m mm mme mlle mgr hr hrn fr frl dipl ing mag lic arq".split())
LEADING = frozenset("no nos nr núm num nro fig figs abb tab sec secs p pp pg pág págs pag s vol vols bd bde ch chap kap cap art arts cf vgl vg ca c approx aprox env bzw resp i.e e.g z.b d.h u.a v.a o.ä ex ej z u v vs co corp dept univ est tel av avda bld blvd rd op ed eds hrsg lfd ggf evtl ggü inkl exkl max min bes bspw sog".split())
TRAILING = frozenset("etc usw usf al a.m p.m ltd inc jr bros plc gmbh ss ff b.c a.d n.chr v.chr".split())
MONTH_ABBREVIATIONS = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago okt dez mrz dic".split())
GERMAN_MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split())

# German words before an ordinal number.
ORDINAL_LEADS = frozenset("der die das dem den des am vom zum im beim zur jeder jeden bis ab".split())

MARKS = ".!?…。！？．｡।॥؟۔።፧፨։།༎༑။។៕⸮᙮᠃᠉꓿꘎꛳\u037e"
OPENERS, CLOSERS = "“„«「『《〈‹", "”»」』》〉›"
#: In these scripts a blank can end a sentence.
_BLANK_SCRIPT = re.compile(r"[฀-๿຀-໿]")
#: A semicolon behind a Greek letter is a question mark.
_MARK_RUN = rf"[{re.escape(MARKS)}]+|(?<=[Ͱ-Ͽἀ-῿]);"
_PLACE = re.compile(_MARK_RUN + r"|[“”„«»「」『』‹›\"]")
_PLACE_OR_BLANK = re.compile(_MARK_RUN + r"|[“”„«»「」『』‹›\"]|[^\S\n]+")
_PARAGRAPH = re.compile(r"\r?\n[^\S\n]*(?:\r?\n\s*)")
_SPACE = re.compile(r"\s*")
_BRACKET = ")]）】》〉}"
_WIDE_MARKS = frozenset("。！？．｡")
_OWN_MARKS = frozenset(MARKS) - _WIDE_MARKS - frozenset(".!?…")
_CASELESS_LEAD = re.compile(r"[-‐–/(\[（¿¡'’‘]")


def _before(text: str, start: int, at: int, mark: str) -> str:
    """Class of what stands before an end mark at ``at``."""
    if mark[0] != "." or len(mark) > 1:
        return "ell" if "…" in mark or mark.startswith("..") else "mark"
    i = at
    while i > start and not text[i - 1].isspace() and text[i - 1] not in "“„«「『(（[":
        i -= 1
    word = text[i:at]
    low = word.lower().lstrip("¿¡'’‘")
    if "’" in low:
        low = low.rpartition("’")[2]
    last = low.rpartition("-")[2]
    if not last:
        return "none"
    c = word[-1]
    if "ऀ" <= c <= "ॿ" or "፠" <= c <= "፿" or "ሀ" <= c <= "ፚ":
        return "marked"  # these scripts have their own full stop
    if len(last) == 1 and last.isalpha():
        return "init" if c.isupper() or last == c and not c.islower() else "small"
    if low in TRAILING:
        return "trail"
    if last in TITLES:
        return "title"
    if last in LEADING or low in LEADING:
        return "lead"
    if last in MONTH_ABBREVIATIONS:
        return "month"
    if last.isdigit():
        before = text[max(start, i - 8) : i].split()
        return "ordinal" if len(last) < 3 and before and before[-1].lower() in ORDINAL_LEADS else "num"
    if "." in last:
        parts = last.split(".")
        return "dotted" if all(len(p) == 1 and p.isalpha() for p in parts) else "num" if parts[-1].isdigit() else "word"
    return "word"


def _behind(text: str, at: int, end: int) -> str:
    """Class of what follows from ``at`` on; ``end`` is the end of the paragraph."""
    if at >= end:
        return "end"
    c = text[at]
    if c.isupper():
        if text[at + 1 : at + 2].islower():
            j = at + 1
            while j < end and text[j].isalpha():
                j += 1
            if text[at:j] in GERMAN_MONTHS:
                return "gmonth"
        return "up"
    if c.islower():
        return "up" if at + 1 < end and text[at + 1].isupper() else "low"
    if c.isdigit():
        return "dig"
    if c in "“„«「『《‹(（[【¿¡\"":
        return "open"
    if c.isalpha():
        return "to" if c == "と" else "other"
    return "punct"


class Node:
    """A place that may be a boundary: ``end`` is the offset behind its marks and closers."""

    __slots__ = ("end", "key", "quoted", "opens", "shape")

    def __init__(self, end: int, key: tuple, quoted: str, opens: bool, shape: str = ""):
        self.end, self.key, self.quoted, self.opens, self.shape = end, key, quoted, opens, shape


def nodes(text: str, start: int, end: int) -> list[Node]:
    """The chain of one paragraph. Places within quotes are left out: they are always inside."""
    blanks = _BLANK_SCRIPT.search(text, start, end) is not None
    out: list[Node] = []
    closer, open_at, skip = None, 0, start
    for m in (_PLACE_OR_BLANK if blanks else _PLACE).finditer(text, start, end):
        at, stop = m.span()
        if at < skip:
            continue
        c = text[at]
        mark, quote = "", ""
        if c in MARKS or c == ";":
            mark = m[0]
        elif c.isspace():
            if closer is None and at > start and stop < end:
                a, b = text[at - 1], text[stop]
                if a == "\n" or b == "\n":
                    continue  # part of a line break, which never ends a sentence
                beside = "rep" if a in "ๆໆៗ" or b in "ๆໆៗ" else "num" if a.isdigit() or b.isdigit() else "open" if b in "“„«「『\"" else "plain"
                out.append(Node(at, ("blank", beside), "", beside == "open"))
            continue
        elif closer is None:
            # an opening quote counts only if its partner follows in the paragraph
            partner = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", '"': '"', "»": "«", "”": "”"}.get(c)
            if partner and any(text.find(p, stop, end) >= 0 for p in partner):
                closer, open_at = partner, at
            continue
        elif c in closer:
            quote, mark = ("end" if at > start and text[at - 1] in MARKS or at > start + 1 and text[at - 1].isspace() and text[at - 2] in MARKS else "plain"), ""
            closer = None
        else:
            continue
        if closer is not None:
            continue
        # closing quotes and brackets belong to the sentence they close
        while stop < end and text[stop] in _BRACKET:
            stop += 1
        if mark and stop < end and text[stop] == '"' and closer is None and stop + 1 < end and text[stop + 1].isspace():
            stop += 1
        if quote:
            while stop < end and text[stop] in MARKS:
                mark, stop = text[stop], stop + 1
        skip = stop
        if quote and not mark and quote == "plain" and not blanks:
            continue
        after = _SPACE.match(text, stop, end).end()
        gap = "sp" if after > stop else "no"
        behind = _behind(text, after, end)
        first = mark[:1] or text[at - 1 if not text[at - 1].isspace() else at - 2]
        style = "wide" if first in _WIDE_MARKS else "own" if first in _OWN_MARKS else "blank" if blanks else "latin"
        # behind a wide mark nothing stands between sentences, so a figure can begin the next one
        if gap == "no" and (behind in ("low", "punct") or behind == "dig" and style != "wide"):
            continue
        if quote and not (mark and quote == "plain"):
            lead = text[start:open_at].rstrip()[-1:]
            opened = "colon" if lead and lead in ":：" else "start" if not lead else "mid"
            out.append(Node(stop, ("quote", quote, behind, opened if behind in ("other", "to") else "", style), "colon" if opened == "colon" else "free", False))
        else:
            out.append(Node(stop, ("mark", _before(text, start, at, mark) if not quote else "mark", behind, gap, style), "", behind == "open" and text[after] in "“„«「『‹\"", _shape(text, start, at, mark) if not quote else ""))
    return out


_VOWELS = frozenset("aeiouyàáâãäåèéêëìíîïòóôõöùúûüýąęóıœæøůěőű")


def _shape(text: str, start: int, at: int, mark: str) -> str:
    """Form of the word before a single full stop, whatever its language: short words and words without vowels are often cut short."""
    if mark != ".":
        return ""
    i = at
    while i > start and text[i - 1].isalpha():
        i -= 1
    word = text[i:at].lower()
    if not word or not (word[0] in _VOWELS or "a" <= word[0] <= "ž"):
        return ""
    vowelless = not _VOWELS.intersection(word)
    return "" if len(word) > 3 and not vowelless else f"{min(len(word), 4)}{'-' if vowelless else ''}"


def _features(key: tuple) -> list[tuple]:
    kind = key[0]
    if kind == "blank":
        return [key]
    if kind == "quote":
        return [key, ("q", key[1], key[2]), ("q", key[2], key[3])]
    return [key, ("m", key[1], key[2]), ("b", key[1]), ("n", key[2], key[4]), ("w", key[4])]


def _node_features(node: Node) -> list[tuple]:
    """The features of a place and, where a list does not know the word, its shape before what follows."""
    some = _features(node.key)
    return some + [("s", node.shape, node.key[2])] if node.shape and node.key[1] == "word" else some


class Model:
    """Weights of the chain; ``decode`` is Viterbi over the tags boundary and inside."""

    def __init__(self):
        self.w: dict = defaultdict(float)
        self.memo: dict = {}

    def _score(self, node: Node) -> float:
        key = (node.key, node.shape)
        s = self.memo.get(key)
        if s is None:
            s = self.memo[key] = sum(self.w.get(f, 0.0) for f in _node_features(node))
        return s

    @staticmethod
    def _links(before: Node | None, node: Node, boundary_before: bool) -> list[tuple]:
        """Transition features of a boundary at ``node``: the tag and kind of the place before and how near it is."""
        links = []
        if before is not None and node.key[-1] == "latin":
            near = "near" if node.end - before.end < 7 else "far"
            links.append(("l", node.key[0], before.key[0], near, boundary_before))
        if node.quoted:
            # did the sentence start with the quotation?
            started = before is None if node.quoted == "free" and node.key[3] == "start" else before is not None and before.opens and boundary_before
            links.append(("t", node.key[2], "started" if started else node.quoted))
        return links

    def _link(self, before: Node | None, node: Node, boundary_before: bool) -> float:
        return sum(self.w.get(f, 0.0) for f in self._links(before, node, boundary_before))

    def decode(self, chain: list[Node]) -> list[bool]:
        if not chain:
            return []
        inside, boundary, back = 0.0, float("-inf"), []
        before = None
        for node in chain:
            emit = self._score(node)
            a, b = emit + self._link(before, node, False), emit + self._link(before, node, True)
            # score of tagging this node boundary, coming from inside and from boundary
            from_inside, from_boundary = inside + a, boundary + b
            back.append((from_boundary > from_inside, boundary > inside))
            inside, boundary = max(inside, boundary), max(from_inside, from_boundary)
            before = node
        tags, tag = [], boundary > inside
        for to_boundary, to_inside in reversed(back):
            tags.append(tag)
            tag = to_boundary if tag else to_inside
        return tags[::-1]

    def update(self, chain: list[Node], tags: list[bool], step: float) -> None:
        before, was = None, False
        for node, tag in zip(chain, tags):
            if tag:
                for f in _node_features(node) + self._links(before, node, was):
                    self.w[f] += step
            before, was = node, tag
        self.memo.clear()


def train(examples: list[str], rounds: int = 30) -> Model:
    """Averaged perceptron on paragraphs in which ``|`` marks the boundaries (``|`` at their end is implied)."""
    data = []
    for e in examples:
        text, ends = "", set()
        for part in e.split("|"):
            text += part
            ends.add(len(text.rstrip()))
        chain = nodes(text, 0, len(text))
        data.append((chain, [n.end in ends for n in chain]))
    model, total, n = Model(), defaultdict(float), 0
    for _ in range(rounds):
        for chain, gold in data:
            got = model.decode(chain)
            if got != gold:
                model.update(chain, gold, 1.0)
                model.update(chain, got, -1.0)
            n += 1
        for f, v in model.w.items():
            total[f] += v
    model.w = {f: v / rounds for f, v in total.items() if v}
    model.memo = {}
    return model


def stripped(sentences: list[str]) -> str:
    """A training paragraph for an unpunctuated script: the sentences without their marks, a blank in their place."""
    return "| ".join(s.rstrip(MARKS) for s in sentences)


EXAMPLES = [
    "The market fell in May. |The roads closed in March! |2,831 people left town. |85 came back. |Was it cold? |53 died. |(It ends by May.) |17 stay. |It sold 20. |The rest was lost. |The taux in mai. |Voir la page. |He left in the war. |The age of it all. |No one won the war! |Go on.",
    "The river rose fast. |Nobody had seen it before! |Was it safe? |People left. |12 houses fell. |Was it late?! |“So it was,” said Ann. |(They came back.) |They stayed!",
    "It grew by 4.5 points, i.e. by a lot. |See Fig. 2 and pp. 3–4 of vol. 5 (cf. Brown et al., 2010). |Dr. Smith of the institute met Gov. Jones on 15 Jan. 2018 near St. Mary clinic. |J. M. Brown wrote it. |The U.N. team and the Acme Co. Ltd. signed no agreement. |No. 7 on the list had approx. 9 visits.",
    "They had maize, beans, etc. |The rest was lost. |It began at 7 a.m. and ended at 4.30 p.m. |See Sec. 2.1 of the report. |pH values fell. |5 of them fell. |“Go.” |We counted rice etc. and left in Jan. |They met on 3 Feb. 2012 there.",
    "The group waited ... and then left. |He said “stop.” and walked on. |“We lost it all!” the woman shouted. |They asked, “Will it end soon?” but nobody answered. |She replied: “It is over.” |The market closed. |She replied: “It is over.” |“It was long,” he said, “and it hurt.” |All left.",
    "The trade fell.|Since May it rose.|The file is at www.site.example/data.v2.html for all. |Version 2.7.1 is out. |It was late.|“We left,” she said.|No one stayed. |It ended in August 2012. |383 left. |It ended at 4.30 p.m. |31 left. |He replied: “It is over.” |12 left. |It ended with “all.” |(So it was.) |“And then,” he said. |¿Qué? |It is in 2010. |It fell to 4.5. |So he said.",
    "Am 1. Januar begann der 2. Abschnitt. |Es sank auf 7. |Der Rat ging. |Dr. Meier traf am 3. Mai 2015 den Leiter. |Siehe Abb. 4 und S. 26 in Bd. 3 (vgl. Kern u. a., 2013). |Man fand z. B. Mais, ca. 6 Säcke bzw. 7 Prozent. |Es fehlten Hirse, Mais usw. |Der Rat half. |Der Rat fragte: „Wie lange noch?“ |Laut dem Rat ist es 20. |Die Lage blieb. |„Es kam!“, rief Hans. |„Es ging“, sagte er. |Nr. 5 der Liste blieb. |Es endete am 12. August 2019.",
    "Voir l’art. 6 et la p. 4 du vol. 2 (cf. Martin et al., 2022). |M. Petit et Mme Roux ont vu Lyon le 28 janv. 2012. |Le taux est de 30,1, p. ex. près de Lyon. |Le Dr. Blanc note env. 30 cas. |J.-K. Petit pense. |Quelle perte ! |Il a répondu : « Sans eau, rien. » |Personne ne savait. |Il dit : « Oui. » |« Non. » |On y trouve du mil, etc. |Les gens partent.",
    "El Sr. Gil y la Sra. Ruiz fueron. |Véase la fig. 28 y la pág. 7 del vol. 2 (cf. Gil et al., 2020). |La Dra. Sol anotó aprox. 5 casos, núm. 17 de la lista. |¿Por qué? |¡Qué pena! |Pasó, p. ej. en Lima. |El consejo respondió: «No hay.» |¿Quién sabe? |Hay mijo, etc. |El agua bajó.",
    "أغلقت الطرق بين المدن. |ارتفع السعر بنسبة 7.38 في المئة. |هل ينتهي؟ |كتب أ. د. سامي عن الماء. |زار د. سامي بلدة. |يا لها من خسارة! |أدى ذلك. |قال سامي: «أغلقت الطرق. ارتفع السعر.» |يخشى الناس. |انخفض من 37.5 إلى 29.6. |في عام 2009 تضررت. |12 أسرة.",
    "सड़क बंद रही। |क्या होगा? |कितनी हानि हुई! |श्री के. राम ने कहा। |डॉ. राम ने दौरा किया। |“वे आए। वे गए,” राम ने कहा। |“2020 में वे आए। वे गए,” राम ने कहा। |2020 में वे आए। |सूचकांक 89.39 पर आया।",
    "ከባድ ድርቅ ነው። |እንዴት ያለ ጉዳት! |ያበቃል? |ዶ/ር ሰመፈ ጎበኙ። |«ዝናብ ነው። ጎርፍ ነው።» አለ ሰመፈ። |መጠኑ ከ4.5 ወረደ። |«ዝናብ ነው።» አለ ሰመፈ። |በ2010 ነው።",
    "价格上涨了86.50%。|观察组问：“还要多久？”|没有人回答。|“水没了！”李喊道。|李说：“水没了。路断了。”|道路关闭。|干旱会结束吗？|2021年，雨来了。|《公报》第13期指出，雨来了！|李说：“雨来了。”|“水没了！”李喊道。|李说：“雨来了。”|《公报》说了。|合作社沉默了……然后走了。|“雨来了。”李说。",
    "“水没了！”李喊道。|道路关闭。|2021年，雨来了。|李走了！|12人留下。|“雨来了。”|2019年，路断了。|指数为3.5（图2）。|会结束吗？|5月以来没有雨。",
    "「水がない！」と叫んだ。|道は閉鎖された。|会は「いつまで？」と尋ねた。|「雨だ。水だ。」と述べた。|指数は下がった（図3.3参照）。|8月から雨だ！|「雨だ。」と述べた。|終わるのか？|彼は黙り……そして触れた。",
    "「雨だ。水だ。」と述べた。|8月から雨だ！",
    "«ዝናብ ነው። ጎርፍ ነው።» አለ ሰመፈ። |ከባድ ድርቅ ነው።",
    # scripts with marks of their own, and languages whose abbreviations are in no list
    "Ποιος ήρθε; |Κανείς δεν ήξερε. |Γιατί έφυγε; |Έπεσε η βροχή. |Το νερό ανέβηκε.",
    "བོད་ལ་ཆར་པ་བབས། |ཆུ་བོ་རྒྱས་སོ། |ལམ་ཆད་སོ།",
    "မိုးရွာသည်။ |ရေကြီးသည်။ |လမ်းပိတ်သည်။ |၁၂ အိမ်ပျက်သည်။",
    "ភ្លៀងធ្លាក់។ |ទឹកឡើង។ |ផ្លូវបិទ។ |១២ ផ្ទះបាត់។",
    "Kupił np. kukurydzę, tj. ziarno. |Rzeka wylała. |Deszcz padał dwa dni. |Wg rady zginęło ok. 30 owiec. |Woda opadła. |30 osób wyjechało. |Szkoła stoi przy ul. Polnej. |Dom ma 5 okien.",
    "De rivier steeg snel. |Men vond o.a. maïs, nl. 6 zakken. |Het begon om 7 uur. |De raad zag blz. 5 van dl. 2. |Het dorp is leeg. |Zij kwamen.",
    "Il fiume è salito. |Il sig. Rossi vide pag. 5 del vol. 2. |La strada è chiusa. |Tutti tacquero. |Mancava il riso ecc. |Poi venne la pioggia. |Ora è sera.",
    "Nehir yükseldi. |Bkz. s. 5 ve ör. 3. |Yol kapandı. |Köy boş. |Su çekildi. |12 ev yıkıldı.",
    "Río subió. |Řeka stoupla. |Viz např. str. 5 a obr. 3. |Cesta je zavřená. |Déšť padal dva dny. |Nyní je tma.",
    # unpunctuated: marks stripped, blanks left
    stripped(["ฝนตกหนัก.", "ราคาสูงขึ้นร้อยละ 18.97 ในปีนี้.", "ต่าง ๆ ที่ขาดน้ำ.", "ดร.สมชายไปเยือน.", "สมชายกล่าวว่า “ฝนตก น้ำท่วม”", "ถนนถูกปิด.", "น้ำแห้ง."]),
    stripped(["ดัชนีลดจาก 64.78 เป็น 30.63 จุด.", "เขากล่าวว่า “ราคาสูง ฝนตก”", "ราคาสูง.", "เขากล่าวว่า “ฝนตก”", "ฝนตก."]),
    "ฝนจะสิ้นสุดเมื่อใด? |ในปี 2015 มีฝน| ช่างน่าเสียดาย! |ฝนตก",
]

_model: Model | None = None


def model() -> Model:
    """The fitted model, once per worker process."""
    global _model
    if _model is None:
        _model = train(EXAMPLES)
    return _model


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """``(start, end)`` of every sentence in code points, without surrounding white space; none for null and blank text."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    m, at = model(), 0

    def paragraph(a: int, b: int) -> None:
        while b > a and text[b - 1].isspace():
            b -= 1
        a = _SPACE.match(text, a, b).end()
        if a >= b:
            return
        chain = nodes(text, a, b)
        start = a
        for node, boundary in zip(chain, m.decode(chain)):
            end = node.end
            while end > start and text[end - 1].isspace():
                end -= 1
            if boundary and end > start:
                out.append((start, end))
                start = _SPACE.match(text, node.end, b).end()
        if start < b:
            out.append((start, b))

    for gap in _PARAGRAPH.finditer(text):
        paragraph(at, gap.start())
        at = gap.end()
    paragraph(at, len(text))
    return out


def sentences(df: DataFrame, id_col: str = "rec_no", text_col: str = "extracted_text") -> DataFrame:
    """``rec_no, start_char, end_char``: one row per sentence, in a single narrow stage.

    Null, empty and blank texts give no row; a repeated row gives its sentences again; very long texts are
    decoded paragraph by paragraph; other columns are not read; an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in sentence_spans(text):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["rec_no", "start_char", "end_char"])

    return df.select(df[id_col].cast("long").alias("rec_no"), df[text_col].alias("t")).mapInArrow(run, "rec_no long, start_char int, end_char int")
