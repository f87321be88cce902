"""Query catalogue: each query is an operator over whole tables, with the equivalent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import scores as S
from strandline.functions import text as X
from strandline.operators import analytics as A
from strandline.operators import attachments as T
from strandline.operators import grounding as G
from strandline.operators import mentions as M
from strandline.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

STOPS = ["the", "of", "and", "to", "that", "this", "from", "in", "is", "for", "by", "at", "near", "after", "on"]
PHRASES = [("crop failure", "Event"), ("failure", "Event"), ("harvest delay", "Event"), ("delay", "Event"), ("fuel shortage", "Event"), ("local fuel shortage", "Event"), ("shortage", "Event"), ("locust damage", "Event"), ("transport costs", "Cost"), ("higher transport costs", "Cost"), ("income", "Cost")]
NEGATORS, NEGATED_PAIRS = ["nobody", "no", "not", "without", "unless"], [("is", "poor"), ("can", "offset")]
HINTS = ["expects", "doubts", "could", "should", "can", "unless", "expected"]
CAUSE_LABELS = ["Causal", "Correlation"]


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
# the normalised tag of a document, and the documents that are English by their tag or, without one, by their words
TAG = "coalesce(nullif(lower(regexp_extract(trim(lang), '^[A-Za-z]+')), ''), 'und')"
ENGLISH = f"(SELECT * FROM documents WHERE {TAG} = 'en' OR ({TAG} = 'und' AND len(list_filter({WORDS}, lambda x: x IN ({quoted(X.ENGLISH)})))::DOUBLE / greatest(len({WORDS}), 1) >= {X.ENGLISH_SHARE}))"
SENTENCES = "list_filter(string_split_regex(text, '[.!?]+\\s+'), lambda s: trim(s, ' ') <> '')"


@query("sentence_split_stats", f"SELECT lang, count(*) AS n_docs, sum(len({SENTENCES}))::BIGINT AS n_sentences, max(len({SENTENCES}))::BIGINT AS longest FROM documents WHERE text IS NOT NULL GROUP BY lang")
def _(spark, d):
    n = F.size(X.sentences(F.col("text"))).cast("long")
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_sentences"), F.max(n).alias("longest"))


@query("paragraph_stats", "SELECT source, count(*) AS n_docs, sum(len(list_filter(list_transform(string_split_regex(text, '[\\s\\x0b]*\\n[\\s\\x0b]*\\n[\\s\\x0b]*'), lambda p: trim(p, ' ')), lambda p: p <> '')))::BIGINT AS n_paragraphs FROM documents WHERE text IS NOT NULL GROUP BY source")
def _(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.size(X.paragraphs(F.col("text"))).cast("long")).alias("n_paragraphs"))


def _by_lang(docs):
    """Documents with their normalised tag, which the counts are grouped by."""
    return docs.withColumn("lang", X.primary_tag(F.col("lang")))


def _token_counts(docs, *keys):
    return docs.select(*keys, F.explode(X.words(F.col("text"))).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))


@query("token_counts_by_lang", f"SELECT lang, w AS word, count(*) AS n FROM (SELECT {TAG} AS lang, unnest({WORDS}) AS w FROM documents) GROUP BY lang, w")
def _(spark, d):
    return _token_counts(_by_lang(table(spark, d, "documents")), "lang")


@query(
    "sentence_length_filter",
    f"""SELECT doc_id, count(*) AS kept, sum(len(t))::BIGINT AS n_tokens FROM (
      SELECT doc_id, regexp_extract_all(s, '[^ ]+') AS t FROM (SELECT doc_id, unnest({SENTENCES}) AS s FROM documents))
    WHERE len(t) < 150 AND len(list_filter(t, lambda x: length(x) = 1 AND x NOT IN ('I', 'a', 'A'))) <= 10 GROUP BY doc_id""",
)
def _(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s")).select("doc_id", F.regexp_extract_all("s", F.lit("[^ ]+"), F.lit(0)).alias("t"))
    return s.where((F.size("t") < 150) & ~X.too_many_single_letters(F.col("t"))).groupBy("doc_id").agg(F.count("*").alias("kept"), F.sum(F.size("t").cast("long")).alias("n_tokens"))


@query("stopword_content_words", f"SELECT w AS word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({WORDS}) AS w FROM documents) WHERE length(w) > 1 AND w NOT IN ({quoted(STOPS)}) GROUP BY w")
def _(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(X.content_words(X.words(F.col("text")), STOPS)).alias("word"))
    # distinct per document first: both counts then combine map-side
    return w.groupBy("word", "doc_id").agg(F.count("*").alias("c")).groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


@query(
    "canonical_name",
    f"""SELECT canonical, count(*) AS n FROM (SELECT array_to_string(CASE WHEN len(list_filter(t, lambda x: length(x) > 1 AND x NOT IN ({quoted(STOPS)}))) = 0 THEN t
      ELSE list_filter(t, lambda x: length(x) > 1 AND x NOT IN ({quoted(STOPS)})) END, ' ') AS canonical FROM (SELECT regexp_extract_all(lower(mention_text), '[a-z]+') AS t FROM extractions WHERE mention_text IS NOT NULL)) GROUP BY canonical""",
)
def _(spark, d):
    return table(spark, d, "extractions").where("mention_text IS NOT NULL").select(X.canonical_name(X.words(F.col("mention_text")), STOPS).alias("canonical")).groupBy("canonical").agg(F.count("*").alias("n"))


@query(
    "gazetteer_longest_match",
    f"""WITH RECURSIVE lex(phrase, label) AS (VALUES {", ".join(f"('{p}', '{l}')" for p, l in PHRASES)}), t AS (SELECT doc_id, {WORDS} AS w FROM {ENGLISH} WHERE text IS NOT NULL),
    grams AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS start, w FROM t, (VALUES (1), (2), (3), (4)) AS k(n) WHERE len(w) >= n),
    hits AS (SELECT doc_id, label, start, start + n AS stop, phrase FROM (SELECT doc_id, n, start, array_to_string(w[start + 1 : start + n], ' ') AS phrase FROM grams) JOIN lex USING (phrase)),
    first AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, label, start ORDER BY stop DESC) = 1)
    SELECT doc_id, label, start::INTEGER AS start, stop::INTEGER AS stop, phrase FROM first
    QUALIFY coalesce(max(stop) OVER (PARTITION BY doc_id, label ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= start""",
)
def _(spark, d):
    return _gazetteer(X.english(table(spark, d, "documents")))


def _gazetteer(docs):
    words = docs.where("text IS NOT NULL").select("doc_id", X.words(F.col("text")).alias("w"))
    return M.gazetteer(words, ["doc_id"], F.col("w"), docs.sparkSession.createDataFrame(PHRASES, "phrase string, label string"))


TRIGGERS = [("increase", "^(rose|rise|rising|increas|doubl|intensif|worsen|aggravat)"), ("decrease", "^(fall|fell|reduc|limit|lost|eas)"), ("cause", "^(caus|trigger|becaus|due|owing)")]


@query("trigger_regex_classify", f"SELECT lang, kind, count(*) AS n, count(DISTINCT w) AS n_words FROM (SELECT lang, w, CASE {' '.join(f"WHEN regexp_matches(w, '{p}') THEN '{k}'" for k, p in TRIGGERS)} ELSE 'none' END AS kind FROM (SELECT {TAG} AS lang, unnest({WORDS}) AS w FROM documents)) GROUP BY lang, kind")
def _(spark, d):
    return _trigger_kinds(_by_lang(table(spark, d, "documents")), "lang")


def _trigger_kinds(docs, *keys):
    w = docs.select(*keys, F.explode(X.words(F.col("text"))).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("c"))
    kind = F.lit("none")
    for k, p in reversed(TRIGGERS):
        kind = F.when(F.col("w").rlike(p), k).otherwise(kind)
    return w.groupBy(*keys, kind.alias("kind")).agg(F.sum("c").alias("n"), F.count("*").alias("n_words"))


@query("token_pattern_bigram", f"SELECT lang, a, b, count(*) AS n FROM (SELECT lang, w[i] AS a, w[i + 1] AS b FROM (SELECT {TAG} AS lang, {WORDS} AS w, unnest(range(1, len({WORDS}))) AS i FROM documents)) WHERE b IN ('of', 'to', 'by') GROUP BY lang, a, b")
def _(spark, d):
    return _bigrams(_by_lang(table(spark, d, "documents")), "lang")


def _bigrams(docs, *keys):
    pairs = docs.select(*keys, X.words(F.col("text")).alias("w")).select(*keys, F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p"))
    return pairs.select(*keys, "p.a", "p.b").where(F.col("b").isin("of", "to", "by")).groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))


@query(
    "negation_parity",
    f"""SELECT doc_id, count(*) FILTER (WHERE k % 2 = 1) AS negated, count(*) AS sentences FROM (SELECT doc_id, len(list_filter(w, lambda x: x IN ({quoted(NEGATORS)})))
      + len(list_filter(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1] IN ({quoted(" ".join(p) for p in NEGATED_PAIRS)}))) AS k
      FROM (SELECT doc_id, regexp_extract_all(lower(s), '[a-z]+') AS w FROM (SELECT doc_id, unnest({SENTENCES}) AS s FROM {ENGLISH}))) GROUP BY doc_id""",
)
def _(spark, d):
    return _negation(X.english(table(spark, d, "documents")))


def _negation(docs):
    s = docs.select("doc_id", X.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    odd = F.filter("s", lambda x: M.negated(X.words(x), NEGATORS, NEGATED_PAIRS))
    # counted in each row's array first; rows of one id are then few
    return s.groupBy("doc_id").agg(F.sum(F.size(odd).cast("long")).alias("negated"), F.sum(F.size("s").cast("long")).alias("sentences"))


@query("hedging_scan", f"SELECT hint, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(list_filter({WORDS}, lambda x: x IN ({quoted(HINTS)}))) AS hint FROM {ENGLISH}) GROUP BY hint")
def _(spark, d):
    return _hedges(X.english(table(spark, d, "documents")))


def _hedges(docs):
    h = docs.select("doc_id", F.explode(M.hedges(X.words(F.col("text")), HINTS)).alias("hint"))
    return h.groupBy("hint", "doc_id").agg(F.count("*").alias("c")).groupBy("hint").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


@query(
    "coref_previous_sentence",
    """SELECT a.document_id, a.extraction_id AS anaphor_id, l.extraction_id AS antecedent_id FROM extractions a JOIN (
      SELECT * FROM extractions WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, sent_no ORDER BY length(mention_text) DESC NULLS LAST, extraction_id DESC) = 1) l
    ON a.document_id = l.document_id AND l.sent_no = a.sent_no - 1 WHERE split_part(lower(trim(a.mention_text)), ' ', 1) IN ('severe', 'rising', 'local', 'heavy')""",
)
def _(spark, d):
    e = table(spark, d, "extractions").select("document_id", "sent_no", "mention_text", F.col("extraction_id").alias("id"), F.length("mention_text").alias("stop"))
    return M.coreference(e, "document_id", "sent_no", "mention_text", ["severe", "rising", "local", "heavy"])


@query("event_chain_join", "SELECT l_orderkey, l_linenumber, l_partkey, datediff('day', o_orderdate, l_shipdate)::INTEGER AS lag_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 200 DAY")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 200 DAYS")).alias("stop"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return M.containing(li, o, ["l_orderkey"], "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey", F.datediff("l_shipdate", "start").alias("lag_days"))


@query(
    "interval_overlap_attach",
    """SELECT a.l_orderkey, a.l_linenumber AS line, b.l_linenumber AS other, a.l_partkey AS part, b.l_partkey AS other_part FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
    WHERE (a.l_linenumber < b.l_linenumber OR (a.l_linenumber = b.l_linenumber AND a.l_partkey < b.l_partkey)) AND a.l_shipdate < b.l_shipdate + INTERVAL 20 DAY AND b.l_shipdate < a.l_shipdate + INTERVAL 20 DAY""",
)
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.expr("INTERVAL 20 DAYS")).alias("stop"))
    b = x.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("l_partkey").alias("other_part"), F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    pairs = M.overlapping(x, b, ["l_orderkey"])
    return pairs.where("l_linenumber < other OR (l_linenumber = other AND l_partkey < other_part)").select("l_orderkey", F.col("l_linenumber").alias("line"), "other", F.col("l_partkey").alias("part"), "other_part")


@query(
    "interval_keep_longest",
    """WITH x AS (SELECT extraction_id, document_id, sent_no, extraction_type, (extraction_id % 13)::INTEGER AS start, (extraction_id % 13 + length(mention_text))::INTEGER AS stop FROM extractions WHERE mention_text IS NOT NULL AND document_id IS NOT NULL)
    SELECT extraction_id, start, stop FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.document_id = a.document_id AND b.sent_no = a.sent_no AND b.extraction_type = a.extraction_type AND b.start <= a.start AND b.stop >= a.stop
      AND (b.stop - b.start > a.stop - a.start OR (b.stop - b.start = a.stop - a.start AND b.extraction_id < a.extraction_id)))""",
)
def _(spark, d):
    x = table(spark, d, "extractions").where("mention_text IS NOT NULL AND document_id IS NOT NULL").select("extraction_id", "document_id", "sent_no", "extraction_type", (F.col("extraction_id") % 13).cast("int").alias("start"))
    x = x.join(table(spark, d, "extractions").select("extraction_id", F.length("mention_text").alias("n")), "extraction_id").withColumn("stop", F.col("start") + F.col("n"))
    return M.keep_longest(x, ["document_id", "sent_no", "extraction_type"], tie="extraction_id").select("extraction_id", "start", "stop")


@query(
    "most_complete_weight",
    """SELECT document_id, sent_no, extraction_id, weight FROM (SELECT document_id, sent_no, extraction_id, rule_name, 10 * coalesce(len(states), 0) + 100 * coalesce(len(mention_labels), 0) + length(mention_text) AS weight FROM extractions WHERE mention_text IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY document_id, sent_no ORDER BY weight DESC, rule_name ASC NULLS FIRST, extraction_id) = 1""",
)
def _(spark, d):
    e = table(spark, d, "extractions").where("mention_text IS NOT NULL")
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    weight = M.completeness(F.lit(0), F.lit(0), n("states"), n("mention_labels"), F.length("mention_text"))
    return M.most_complete(e, ["document_id", "sent_no"], weight.cast("long"), "rule_name", "extraction_id").select("document_id", "sent_no", "extraction_id", "weight")


STATE = "struct(x.state_type AS type, x.state_text AS trigger, cast(array() AS array<string>) AS quantifiers)"


@query("attachment_merge", "SELECT canonical_name, count(*) AS n_attachments, string_agg(state_type || ':' || state_text, ',' ORDER BY state_type, state_text) AS attachments FROM (SELECT DISTINCT canonical_name, s.state_type AS state_type, s.state_text AS state_text FROM (SELECT canonical_name, unnest(states) AS s FROM extractions)) WHERE state_type IS NOT NULL AND state_text IS NOT NULL GROUP BY canonical_name")
def _(spark, d):
    e = table(spark, d, "extractions").select("canonical_name", F.expr(f"transform(filter(states, x -> x.state_type IS NOT NULL AND x.state_text IS NOT NULL), x -> {STATE})").alias("a"))
    m = T.merged(e, ["canonical_name"], "a").select("canonical_name", F.filter("a", lambda x: x.isNotNull()).alias("a")).where(F.size("a") > 0)
    return m.select("canonical_name", F.size("a").cast("long").alias("n_attachments"), F.array_join(F.transform("a", lambda x: F.concat(x["type"], F.lit(":"), x["trigger"])), ",").alias("attachments"))


@query(
    "substring_trigger_filter",
    """WITH w AS (SELECT DISTINCT extraction_id, unnest(regexp_extract_all(lower(mention_text), '[a-z]+')) AS t FROM extractions)
    SELECT extraction_id, count(*) AS kept, string_agg(t, ',' ORDER BY t) AS triggers FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.extraction_id = a.extraction_id AND b.t <> a.t AND contains(b.t, a.t)) GROUP BY extraction_id""",
)
def _(spark, d):
    e = table(spark, d, "extractions").select("extraction_id", F.array_distinct(X.words(F.col("mention_text"))).alias("w"))
    a = F.transform("w", lambda t: F.struct(F.lit("word").alias("type"), t.alias("trigger"), F.array().cast("array<string>").alias("quantifiers")))
    kept = T.without_substrings(a)
    return e.where(F.size("w") > 0).select("extraction_id", F.size(kept).cast("long").alias("kept"), F.array_join(F.array_sort(F.transform(kept, lambda x: x["trigger"])), ",").alias("triggers"))


@query(
    "polarity_promote_inhibit",
    """WITH s AS (SELECT document_id, sent_no % 2 AS side, unnest(states, recursive := true) FROM extractions WHERE document_id IS NOT NULL),
    c AS (SELECT document_id, count(*) FILTER (WHERE side = 0 AND state_type = 'INC') >= count(*) FILTER (WHERE side = 0 AND state_type = 'DEC') AS cause_up,
      count(*) FILTER (WHERE side = 1 AND state_type = 'INC') >= count(*) FILTER (WHERE side = 1 AND state_type = 'DEC') AS effect_up FROM s GROUP BY document_id)
    SELECT document_id, cause_up, effect_up, CASE WHEN cause_up = effect_up THEN 'PROMOTE' ELSE 'INHIBIT' END AS polarity FROM c""",
)
def _(spark, d):
    s = table(spark, d, "extractions").where("document_id IS NOT NULL").select("document_id", (F.col("sent_no") % 2).alias("side"), F.explode("states").alias("s"))
    n = lambda side, kind: F.count_if((F.col("side") == side) & (F.col("s.state_type") == kind))
    c = s.groupBy("document_id").agg(S.is_increase(n(0, "INC"), n(0, "DEC")).alias("cause_up"), S.is_increase(n(1, "INC"), n(1, "DEC")).alias("effect_up"))
    return c.withColumn("polarity", S.relation_polarity(F.col("cause_up"), F.col("effect_up")))


@query(
    "simple_pairs_tsv",
    "SELECT row_number() OVER (ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS idx, p_name AS cause, s_name AS effect, o_orderpriority AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return A.numbered(j, ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "idx").select("idx", F.col("p_name").alias("cause"), F.col("s_name").alias("effect"), F.col("o_orderpriority").alias("label"))


@query(
    "cag_relevant_semi_join",
    f"""SELECT m.extraction_id, m.canonical_name FROM extractions m WHERE m.extraction_type = 'concept' AND EXISTS (SELECT 1 FROM extractions e WHERE e.extraction_type = 'relation' AND e.document_id = m.document_id AND e.sent_no = m.sent_no AND list_has_any(e.mention_labels, [{quoted(CAUSE_LABELS)}]))""",
)
def _(spark, d):
    e = table(spark, d, "extractions")
    edges = e.where("extraction_type = 'relation'").select(F.xxhash64("document_id", "sent_no").alias("edge_id"), "document_id", "sent_no", F.explode("mention_labels").alias("label"))
    mentions = e.where("extraction_type = 'concept'").select(F.col("extraction_id").alias("mention_id"), "canonical_name", "document_id", "sent_no")
    arguments = mentions.where("document_id IS NOT NULL AND sent_no IS NOT NULL").select(F.xxhash64("document_id", "sent_no").alias("edge_id"), "mention_id")
    return M.relevant(edges.where("document_id IS NOT NULL AND sent_no IS NOT NULL"), mentions, arguments, CAUSE_LABELS).select(F.col("mention_id").alias("extraction_id"), "canonical_name")


@query(
    "rule_summary",
    """WITH r AS (SELECT unnest(list_distinct(string_split(rule_name, '++'))) AS rule FROM extractions WHERE rule_name IS NOT NULL)
    SELECT coalesce(rule, 'TOTAL') AS rule, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 4) AS percent FROM r GROUP BY ROLLUP (rule)""",
)
def _(spark, d):
    r = table(spark, d, "extractions").where("rule_name IS NOT NULL").select(F.explode(X.rules(F.col("rule_name"))).alias("rule"))
    return A.shares(r, "rule")


@query("per_rule_inverted_index", "SELECT rule, count(*) AS n, min(extraction_id) AS first_id, max(extraction_id) AS last_id FROM (SELECT extraction_id, unnest(list_distinct(string_split(rule_name, '++'))) AS rule FROM extractions WHERE rule_name IS NOT NULL) GROUP BY rule")
def _(spark, d):
    r = table(spark, d, "extractions").where("rule_name IS NOT NULL").select("extraction_id", F.explode(X.rules(F.col("rule_name"))).alias("rule"))
    return r.groupBy("rule").agg(F.count("*").alias("n"), F.min("extraction_id").alias("first_id"), F.max("extraction_id").alias("last_id"))


@query("corpus_sort_ids", "SELECT extraction_id, row_number() OVER (ORDER BY document_id NULLS FIRST, sent_no NULLS FIRST, subtype NULLS FIRST, canonical_name NULLS FIRST, extraction_id) AS idx FROM extractions")
def _(spark, d):
    return A.numbered(table(spark, d, "extractions").select("extraction_id", "document_id", "sent_no", "subtype", "canonical_name"), ["document_id", "sent_no", "subtype", "canonical_name", "extraction_id"], "idx").select("extraction_id", "idx")


for _side, _sql in (
    ("only_left", "SELECT DISTINCT document_id FROM cdr EXCEPT SELECT document_id FROM extractions"),
    ("only_right", "SELECT DISTINCT document_id FROM extractions EXCEPT SELECT document_id FROM cdr"),
    ("both", "SELECT document_id FROM cdr INTERSECT SELECT document_id FROM extractions"),
):

    @query(f"set_diff_{_side}", _sql)
    def _(spark, d, side=_side):
        return A.id_sets(table(spark, d, "cdr").select("document_id"), table(spark, d, "extractions").select("document_id"), side)


BINS = [0, 200, 400, 600, 800, 1000, 1500, 2500, 5000]
BIN_SQL = "CASE " + " ".join(f"WHEN n < {b} THEN {i}" for i, b in enumerate(BINS)) + f" ELSE {len(BINS)} END"


@query("missing_outputs", f"SELECT {BIN_SQL} AS bin, count(*) AS missing FROM (SELECT coalesce(length(extracted_text), 0) AS n FROM cdr c WHERE NOT EXISTS (SELECT 1 FROM extractions e WHERE e.document_id = c.document_id)) GROUP BY bin")
def _(spark, d):
    c = table(spark, d, "cdr").select("document_id", F.coalesce(F.length("extracted_text"), F.lit(0)).alias("n"))
    return A.size_bins(c.join(table(spark, d, "extractions").select("document_id").distinct(), "document_id", "left_anti"), "n", BINS).groupBy("bin").agg(F.count("*").alias("missing"))


@query("size_bins", f"SELECT {BIN_SQL} AS bin, count(*) AS n_docs, sum(n)::BIGINT AS chars FROM (SELECT coalesce(n_chars, 0) AS n FROM documents) GROUP BY bin")
def _(spark, d):
    return A.size_bins(table(spark, d, "documents").select(F.coalesce("n_chars", F.lit(0)).alias("n")), "n", BINS).groupBy("bin").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("chars"))


@query("date_cutoff", "SELECT o_orderdate < TIMESTAMP '1997-04-01' AS early, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY early")
def _(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_orderdate") < F.lit("1997-04-01").cast("timestamp")).alias("early")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("facet_counts", "SELECT 'source' AS facet, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY event_type")
def _(spark, d):
    return A.facets(table(spark, d, "documents"), ["source"]).unionByName(A.facets(table(spark, d, "events"), ["event_type"]))


@query("full_text_match", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z])harvest([^a-z]|$)') AND regexp_matches(lower(text), '(^|[^a-z])delay([^a-z]|$)')")
def _(spark, d):
    return A.text_match(table(spark, d, "documents"), "text", ["harvest", "delay"]).select("doc_id")


@query("range_query", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 00:00:00'")
def _(spark, d):
    return table(spark, d, "events").where("ts > timestamp'2024-01-05 00:00:00' AND ts <= timestamp'2024-01-09 00:00:00'").select("event_id", "event_type")


@query("term_query", "SELECT doc_id, lang FROM documents WHERE source = 'src-zimoadroam'")
def _(spark, d):
    return table(spark, d, "documents").where("source = 'src-zimoadroam'").select("doc_id", "lang")


@query("json_path_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


DOT = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


# a stated query set, the ids divisible by 100, against all rows, the own one left out
PAIRS = f"SELECT a.vec_id, a.label, b.vec_id AS other, b.label AS node_label, printf('n%03d', b.vec_id) AS node, {DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"
RANKED = "row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, node)"


def _searched(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0")


def _every(spark, d):
    return table(spark, d, "embeddings").select(F.format_string("n%03d", "vec_id").alias("node"), F.col("embedding").alias("node_vec"))


def _neighbours(spark, d, k, nodes=None, least=None):
    return G.search(_searched(spark, d), _every(spark, d) if nodes is None else nodes, k, "vec_id", "embedding", least, own=F.format_string("n%03d", "id")).withColumnRenamed("id", "vec_id")


@query("vec_dot_topk", f"SELECT vec_id, node, score, rank FROM (SELECT *, {RANKED}::INTEGER AS rank FROM ({PAIRS})) WHERE rank <= 10")
def _(spark, d):
    return _neighbours(spark, d, 10)


@query("vec_threshold_slice", f"SELECT vec_id, node, score FROM (SELECT *, {RANKED} AS rank FROM ({PAIRS}) WHERE score >= 0.2) WHERE rank <= 3")
def _(spark, d):
    return _neighbours(spark, d, 3, least=0.2).select("vec_id", "node", "score")


@query(
    "vec_neg_penalty",
    f"""SELECT vec_id, node, score FROM (SELECT *, {RANKED} AS rank FROM (SELECT p.vec_id, p.node, round(CASE WHEN list_dot_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) > 0.5
      THEN greatest(-1.0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) - 0.2) ELSE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6) AS score
      FROM ({PAIRS}) p JOIN embeddings a ON a.vec_id = p.vec_id JOIN embeddings b ON b.vec_id = p.other LEFT JOIN embeddings c ON c.vec_id = p.other + 40)) WHERE rank <= 5""",
)
def _(spark, d):
    minus = table(spark, d, "embeddings").select(F.format_string("n%03d", F.col("vec_id") - 40).alias("node"), F.col("embedding").alias("node_neg"))
    return _neighbours(spark, d, 5, _every(spark, d).join(minus, "node", "left")).select("vec_id", "node", "score")


SIMILARITY = "round(1 - levenshtein(lower(name), lower(example)) / greatest(length(name), length(example), 1), 6)"


@query(
    "example_similarity",
    f"""SELECT name, node, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, node) AS rank FROM (SELECT name, node_path AS node, max({SIMILARITY}) AS score
      FROM (SELECT DISTINCT canonical_name AS name FROM extractions WHERE canonical_name IS NOT NULL), (SELECT node_path, unnest(examples) AS example FROM ontology_nodes) GROUP BY name, node_path)) WHERE rank <= 3""",
)
def _(spark, d):
    names = table(spark, d, "extractions").where("canonical_name IS NOT NULL").select(F.col("canonical_name").alias("name")).distinct()
    nodes = table(spark, d, "ontology_nodes").select(F.col("node_path").alias("node"), "examples")
    return G.by_examples(names, nodes, 3, "name", "name").select(F.col("id").alias("name"), "node", "score")


@query(
    "sieve_exact_regex_vector",
    f"""WITH names AS (SELECT DISTINCT canonical_name AS name FROM extractions WHERE canonical_name IS NOT NULL), nodes AS (SELECT node_path AS node, examples, patterns FROM ontology_nodes),
    one AS (SELECT name, node, 1.0 AS score, 1 AS stage FROM names JOIN nodes ON lower(name) = lower(replace(regexp_extract(node, '([^/]+)/?$', 1), '_', ' '))),
    two AS (SELECT DISTINCT name, node, 1.0 AS score, 2 AS stage FROM names, (SELECT node, unnest(patterns) AS p FROM nodes) WHERE name NOT IN (SELECT name FROM one) AND regexp_matches(name, '(?i)' || p)),
    three AS (SELECT name, node, max({SIMILARITY}) AS score, 3 AS stage FROM names, (SELECT node, unnest(examples) AS example FROM nodes) WHERE name NOT IN (SELECT name FROM one) AND name NOT IN (SELECT name FROM two) GROUP BY name, node)
    SELECT name, node, score::DOUBLE AS score, stage FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, node) AS rank FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) WHERE score >= 0.2) WHERE rank <= 2""",
)
def _(spark, d):
    names = table(spark, d, "extractions").where("canonical_name IS NOT NULL").select(F.col("canonical_name").alias("name")).distinct()
    nodes = table(spark, d, "ontology_nodes").select(F.col("node_path").alias("node"), "examples", "patterns")
    return G.sieve(names, nodes, 2, "name", "name", least=0.2).select(F.col("id").alias("name"), "node", "score", "stage")


@query(
    "combined_score",
    "SELECT extraction_id, round(0.75 * coalesce(node_score, 0) + 0.25 * coalesce(relevance, 0), 9) AS score FROM extractions",
)
def _(spark, d):
    return table(spark, d, "extractions").select("extraction_id", F.round(S.combined(F.coalesce("node_score", F.lit(0.0)), F.coalesce("relevance", F.lit(0.0))), 9).alias("score"))


@query("noisy_or", "SELECT document_id, round(1 - list_reduce(list_prepend(1.0::DOUBLE, list(1 - (node_score - 0.01) ORDER BY extraction_id)), lambda p, v: p * v), 6) AS score, count(*) AS n FROM extractions WHERE node_score IS NOT NULL GROUP BY document_id")
def _(spark, d):
    e = table(spark, d, "extractions").where("node_score IS NOT NULL")
    # a product is associative, so it is combined map-side instead of gathering the scores of a document
    return e.groupBy("document_id").agg(F.round(1 - F.product(1 - (F.col("node_score") - 0.01)), 6).alias("score"), F.count("*").alias("n"))


@query(
    "predicate_tuple_score",
    """SELECT document_id, sent_no, round(1 - (1.01 - 1.0 * a) * (1.01 - 0.5 * b), 6) AS score FROM (SELECT document_id, sent_no, max(node_score) FILTER (WHERE extraction_type = 'concept') AS a, max(node_score) FILTER (WHERE extraction_type = 'relation') AS b FROM extractions GROUP BY document_id, sent_no) WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def _(spark, d):
    best = lambda kind: F.max(F.when(F.col("extraction_type") == kind, F.col("node_score")))
    t = table(spark, d, "extractions").groupBy("document_id", "sent_no").agg(best("concept").alias("a"), best("relation").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return t.select("document_id", "sent_no", F.round(S.noisy_or(F.array(F.col("a"), 0.5 * F.col("b"))), 6).alias("score"))


@query(
    "ontology_pairwise_map",
    """WITH n AS (SELECT e.vec_id, printf('n%03d', e.vec_id) AS node, e.label, e.embedding::DOUBLE[] AS v, p.embedding::DOUBLE[] AS up FROM embeddings e LEFT JOIN embeddings p ON p.vec_id = e.vec_id // 10)
    SELECT id, node, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, node) AS rank FROM (SELECT a.node AS id, b.node, round(0.9 * list_dot_product(a.v, b.v) + 0.05 * coalesce(list_dot_product(a.up, b.up), 0), 6) AS score
      FROM n a, n b WHERE coalesce(a.label % 2 = 1, false) AND NOT coalesce(b.label % 2 = 1, false))) WHERE rank <= 3""",
)
def _(spark, d):
    # two vocabularies that share out the whole table: nodes of odd labels and all others
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    parent = e.select(F.col("vec_id").alias("p"), F.col("vec").alias("up"))
    nodes = e.join(parent, F.col("p") == F.floor(F.col("vec_id") / 10), "left").select(F.format_string("n%03d", "vec_id").alias("node"), "vec", F.array("vec", "up").alias("parents"), F.coalesce(F.pmod("label", F.lit(2)) == 1, F.lit(False)).alias("odd"))
    return G.map_nodes(nodes.where("odd").drop("odd"), nodes.where("NOT odd").drop("odd"), 3)


ADJECTIVES = [("heavy", 0.1, 0.02, 0.3), ("severe", 0.4, 0.03, 0.2), ("rising", -0.2, 0.01, 0.1), ("weak", -0.5, 0.02, 0.05)]


@query(
    "adjective_delta",
    f"""SELECT extraction_id, adjective, round(exp(intercept + mu * node_score + sigma * relevance) * relevance, 6) AS delta FROM extractions LEFT JOIN (VALUES {", ".join(map(str, ADJECTIVES))}) AS k(adjective, intercept, mu, sigma) ON adjective = split_part(lower(mention_text), ' ', 1)""",
)
def _(spark, d):
    k = F.broadcast(spark.createDataFrame(ADJECTIVES, "adjective string, intercept double, mu double, sigma double"))
    e = table(spark, d, "extractions").join(k, F.col("adjective") == X.before_first(F.lower("mention_text"), " "), "left")
    return e.select("extraction_id", "adjective", F.round(S.adjective_delta(F.col("intercept"), F.col("mu"), F.col("sigma"), F.col("node_score"), F.col("relevance")), 6).alias("delta"))


@query(
    "mrr_eval",
    f"""WITH f AS (SELECT vec_id, label, min(rank) FILTER (WHERE node_label = label AND rank <= 5) AS first FROM (SELECT *, {RANKED} AS rank FROM ({PAIRS})) GROUP BY vec_id, label)
    SELECT label, count(*) AS n, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f GROUP BY label""",
)
def _(spark, d):
    e = table(spark, d, "embeddings")
    ranked = _neighbours(spark, d, 5).join(e.select(F.format_string("n%03d", "vec_id").alias("node"), F.col("label").alias("node_label")), "node")
    return A.mean_reciprocal_rank(_searched(spark, d).select("vec_id", "label"), ranked, "vec_id", "label", "node_label")


@query(
    "prf_eval",
    """SELECT branch, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (
      SELECT split_part(node_path, '/', 2) AS branch, count(*) FILTER (WHERE node_score >= 0.5 AND relevance >= 0.5) AS tp, count(*) FILTER (WHERE node_score >= 0.5 AND NOT relevance >= 0.5) AS fp,
      count(*) FILTER (WHERE NOT node_score >= 0.5 AND relevance >= 0.5) AS fn FROM extractions WHERE node_path IS NOT NULL GROUP BY branch)""",
)
def _(spark, d):
    e = table(spark, d, "extractions").where("node_path IS NOT NULL").select(F.split_part("node_path", F.lit("/"), F.lit(2)).alias("branch"), (F.col("node_score") >= 0.5).alias("predicted"), (F.col("relevance") >= 0.5).alias("gold"))
    return A.precision_recall(e, ["branch"], "predicted", "gold")


@query(
    "season_nearest",
    """SELECT e.event_id, e.user_id, epoch_us(s.ts) AS ref_us FROM events e ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts WHERE e.event_type = 'purchase'""",
)
def _(spark, d):
    ev = table(spark, d, "events")
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast({c} AS timestamp_ntz))")
    rows = ev.where("event_type = 'purchase'").select("event_id", "user_id", us("ts").alias("at"))
    ref = ev.where("event_type = 'signup'").select("user_id", us("ts").alias("ref_at"))
    return M.nearest_before(rows, ref, ["user_id"], "at").select("event_id", "user_id", F.col("ref_at").alias("ref_us"))


@query(
    "time_containment_join",
    "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 365 DAY GROUP BY r_name",
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("stop"))
    x = M.containing(table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice"), o, ["l_orderkey"], "l_shipdate")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return x.join(c, "o_custkey").join(F.broadcast(n), "n_nationkey").groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(
    "date_expression_parse",
    f"""WITH v AS (SELECT DISTINCT unnest([extracted_metadata.CreationDate, extracted_metadata.ModDate, left(extracted_metadata.CreationDate, 4), left(extracted_metadata.ModDate, 7), 'P' || extracted_metadata.Pages || 'D', 'P' || extracted_metadata.Pages || 'M']) AS expr FROM cdr) SELECT expr, CAST(b AS VARCHAR) AS begins, CAST(e AS VARCHAR) AS ends FROM (SELECT expr,
      CASE WHEN regexp_matches(expr, '^\\d{{4}}$') AND expr <> '0000' THEN make_date(expr::INT, 1, 1) WHEN regexp_matches(expr, '^\\d{{4}}-\\d\\d$') THEN try_cast(expr || '-01' AS DATE) WHEN regexp_matches(expr, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN try_cast(expr AS DATE)
        WHEN regexp_matches(expr, '^P\\d+Y$') THEN (DATE '2018-06-15' - to_years(regexp_extract(expr, '\\d+')::INT))::DATE WHEN regexp_matches(expr, '^P\\d+M$') THEN (DATE '2018-06-15' - to_months(regexp_extract(expr, '\\d+')::INT))::DATE
        WHEN regexp_matches(expr, '^P\\d+W$') THEN DATE '2018-06-15' - 7 * regexp_extract(expr, '\\d+')::INT WHEN regexp_matches(expr, '^P\\d+D$') THEN DATE '2018-06-15' - regexp_extract(expr, '\\d+')::INT END AS b,
      CASE WHEN regexp_matches(expr, '^\\d{{4}}$') AND expr <> '0000' THEN make_date(expr::INT + 1, 1, 1) WHEN regexp_matches(expr, '^\\d{{4}}-\\d\\d$') THEN (try_cast(expr || '-01' AS DATE) + INTERVAL 1 MONTH)::DATE WHEN regexp_matches(expr, '^\\d{{4}}-\\d\\d-\\d\\d$') THEN try_cast(expr AS DATE) + 1
        WHEN regexp_matches(expr, '^P\\d+[YMWD]$') THEN DATE '2018-06-15' END AS e FROM v)""",
)
def _(spark, d):
    m = table(spark, d, "cdr").select("extracted_metadata.*")
    pages = lambda unit: F.concat(F.lit("P"), F.col("Pages").cast("string"), F.lit(unit))
    expressions = m.select(F.explode(F.array("CreationDate", "ModDate", F.left("CreationDate", F.lit(4)), F.left("ModDate", F.lit(7)), pages("D"), pages("M"))).alias("expr")).distinct()
    return A.date_expressions(expressions, "expr", "2018-06-15").select("expr", F.col("begins").cast("string").alias("begins"), F.col("ends").cast("string").alias("ends"))


@query(
    "dedupe_representative",
    """SELECT extraction_id, document_id, sent_no, mention_text FROM extractions QUALIFY row_number() OVER (PARTITION BY document_id, sent_no, extraction_type, subtype, mention_text ORDER BY len(string_split(rule_name, '++')) ASC NULLS FIRST, rule_name ASC NULLS FIRST, extraction_id) = 1""",
)
def _(spark, d):
    e = table(spark, d, "extractions")
    count = F.array_size(F.split("rule_name", r"\+\+"))
    return M.best_per(e, ["document_id", "sent_no", "extraction_type", "subtype", "mention_text"], count, F.col("rule_name"), F.col("extraction_id")).select("extraction_id", "document_id", "sent_no", "mention_text")


@query("relevance_top1", f"SELECT vec_id, CASE WHEN max(score) > 0.3 THEN max(score) ELSE 0 END AS relevance FROM ({PAIRS}) GROUP BY vec_id")
def _(spark, d):
    return _neighbours(spark, d, 1).select("vec_id", F.when(F.col("score") > 0.3, F.col("score")).otherwise(0.0).alias("relevance"))


@query(
    "found_by_merge",
    "SELECT canonical_name, string_agg(rule, '++' ORDER BY rule) AS found_by, count(*) AS n_rules FROM (SELECT DISTINCT canonical_name, unnest(string_split(rule_name, '++')) AS rule FROM extractions WHERE rule_name IS NOT NULL) GROUP BY canonical_name",
)
def _(spark, d):
    r = table(spark, d, "extractions").where("rule_name IS NOT NULL").select("canonical_name", F.explode(X.rules(F.col("rule_name"))).alias("rule")).distinct()
    return r.groupBy("canonical_name").agg(F.array_join(F.array_sort(F.collect_list("rule")), "++").alias("found_by"), F.count("*").alias("n_rules"))


@query(
    "incdec_sheet",
    """SELECT extraction_id, pos::INTEGER AS pos, s.state_type AS state_type, s.state_text AS state_text FROM (SELECT extraction_id, unnest(f) AS s, unnest(range(len(f))) AS pos FROM (SELECT extraction_id, list_filter(states, lambda x: x.state_type IN ('INC', 'DEC')) AS f FROM extractions) WHERE len(f) > 1)""",
)
def _(spark, d):
    from strandline.sources.exporters import changes_sheet

    return changes_sheet(table(spark, d, "extractions"))


@query("grounding_by_branch", "SELECT branch, is_leaf, count(*) AS n, round(avg(node_score), 6) AS mean_score, round(max(node_score), 6) AS best FROM extractions e JOIN ontology_nodes o USING (node_path) GROUP BY branch, is_leaf")
def _(spark, d):
    # the scores are combined per node before the join: the hot nodes never meet it row by row
    e = table(spark, d, "extractions").where("node_path IS NOT NULL").groupBy("node_path").agg(F.count("*").alias("n"), F.sum("node_score").alias("s"), F.count("node_score").alias("c"), F.max("node_score").alias("b"))
    j = e.join(table(spark, d, "ontology_nodes").select("node_path", "branch", "is_leaf"), "node_path")
    return j.groupBy("branch", "is_leaf").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("c"), 6).alias("mean_score"), F.round(F.max("b"), 6).alias("best"))


@query("combine_jobs", "SELECT id AS document_id, string_agg(o, ',' ORDER BY o) AS ontologies FROM (SELECT DISTINCT lower(regexp_replace(document_id, '[-\\s]', '', 'g')) AS id, unnest(ontologies) AS o FROM notices WHERE document_id IS NOT NULL) WHERE o IS NOT NULL GROUP BY id")
def _(spark, d):
    n = table(spark, d, "notices").where("document_id IS NOT NULL").select(F.lower(F.regexp_replace("document_id", r"[-\s]", "")).alias("document_id"), F.explode("ontologies").alias("o")).where("o IS NOT NULL").distinct()
    return n.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("o")), ",").alias("ontologies"))


@query("adverb_stem", f"SELECT DISTINCT w, CASE WHEN w LIKE '%ily' THEN regexp_replace(w, 'ily$', 'y') WHEN w LIKE '%ly' THEN regexp_replace(w, 'ly$', '') ELSE w END AS stem FROM (SELECT unnest({WORDS}) AS w FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select(F.explode(X.words(F.col("text"))).alias("w")).distinct().select("w", X.stem_adverb(F.col("w")).alias("stem"))


@query("file_name_parts", "SELECT file_no, regexp_extract(file_name, '([^/.]*)[^/]*$', 1) AS base, regexp_extract(file_name, '[^/.]*\\.([^/]*)$', 1) AS extension, count(*) AS n FROM meta_files GROUP BY ALL")
def _(spark, d):
    m = table(spark, d, "meta_files").select("file_no", X.file_parts(F.col("file_name")).alias("p"))
    return m.groupBy("file_no", F.col("p.base").alias("base"), F.col("p.extension").alias("extension")).agg(F.count("*").alias("n"))


@query("bag_difference", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM (SELECT l_returnflag, l_linestatus FROM lineitem EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity < 25) GROUP BY ALL")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    return A.bag_difference(li.select("flag", "status"), li.where("l_quantity < 25").select("flag", "status"))


@query("ontology_ancestors", "WITH RECURSIVE up(node_path, ancestor) AS (SELECT node_path, parent_path FROM ontology_nodes UNION SELECT up.node_path, o.parent_path FROM up JOIN ontology_nodes o ON o.node_path = up.ancestor) SELECT node_path, ancestor FROM up WHERE ancestor IS NOT NULL")
def _(spark, d):
    o = table(spark, d, "ontology_nodes")
    edges = o.where("parent_path IS NOT NULL").select(F.col("node_path").alias("mention_id"), F.col("parent_path").alias("argument_id"))
    found = M.reachable(edges, o.select(F.col("node_path").alias("mention_id")))
    return found.where("root <> mention_id").select(F.col("root").alias("node_path"), F.col("mention_id").alias("ancestor"))


@query(
    "cdr_document_dates",
    """SELECT rec_no, document_id, extracted_metadata.Title AS title, uri AS location, CAST(dct AS VARCHAR) AS dct FROM (SELECT *, coalesce(
      CASE WHEN regexp_matches(m, '^\\d{4}-\\d\\d-\\d\\d$') THEN try_cast(m AS DATE) WHEN regexp_matches(m, '^\\d{9,10}$') AND m::BIGINT > 0 THEN epoch_ms(m::BIGINT * 1000)::DATE END,
      CASE WHEN regexp_matches(c, '^\\d{4}-\\d\\d-\\d\\d$') THEN try_cast(c AS DATE) WHEN regexp_matches(c, '^\\d{9,10}$') AND c::BIGINT > 0 THEN epoch_ms(c::BIGINT * 1000)::DATE END) AS dct
      FROM (SELECT *, extracted_metadata.ModDate AS m, extracted_metadata.CreationDate AS c FROM cdr))""",
)
def _(spark, d):
    from strandline.sources.documents import document_date

    c = table(spark, d, "cdr")
    return c.select("rec_no", "document_id", F.col("extracted_metadata.Title").alias("title"), F.col("uri").alias("location"), F.coalesce(document_date(F.col("extracted_metadata.ModDate")), document_date(F.col("extracted_metadata.CreationDate"))).cast("string").alias("dct"))


@query("jsonld_export")
def _(spark, d):
    from strandline.sources.jsonld import corpus_documents

    return corpus_documents(table(spark, d, "cdr"), table(spark, d, "extractions"))


@query("stream_read_once", "SELECT count(DISTINCT id) AS documents, (SELECT count(*) FROM (SELECT DISTINCT lower(regexp_replace(document_id, '[-\\s\\x{a0}]+', '', 'g')), unnest(ontologies) AS o FROM notices WHERE document_id IS NOT NULL) WHERE o IS NOT NULL) AS pairs FROM (SELECT lower(regexp_replace(document_id, '[-\\s\\x{a0}]+', '', 'g')) AS id FROM notices)")
def _(spark, d):
    from strandline.streaming.exchange import read_once_counts

    return read_once_counts(spark, d)


@query("event_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    from strandline.streaming.exchange import streamed_windows

    w = streamed_windows(spark, d)
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query("event_chain", "SELECT c.document_id, c.extraction_id AS id, e.extraction_id AS effect_id FROM extractions c JOIN extractions e ON c.document_id = e.document_id AND c.sent_no = e.sent_no WHERE c.extraction_type = 'relation' AND e.extraction_type = 'concept' AND c.extraction_id <> e.extraction_id")
def _(spark, d):
    e = table(spark, d, "extractions").where("sent_no IS NOT NULL")
    causes = e.where("extraction_type = 'relation'").select("document_id", "sent_no", F.col("extraction_id").alias("id"), F.col("sent_no").alias("token"))
    effects = e.where("extraction_type = 'concept'").select("document_id", "sent_no", F.col("extraction_id").alias("effect_id"), F.col("sent_no").alias("start"), (F.col("sent_no") + 1).alias("stop"))
    return M.chained(causes, effects, ["document_id", "sent_no"]).select("document_id", "id", "effect_id")


CONNECTIVES = ["because of", "due to", "owing to"]


@query("rule_mentions", f"SELECT text, count(*) AS n FROM (SELECT w[i] || ' ' || w[i + 1] AS text FROM (SELECT {WORDS} AS w, unnest(range(1, len({WORDS}) - 1)) AS i FROM {ENGLISH})) WHERE text IN ({quoted(CONNECTIVES)}) GROUP BY text")
def _(spark, d):
    return _connectives(X.english(table(spark, d, "documents")))


def _connectives(docs):
    from strandline.operators.rules import find_mentions

    rule = {"name": "connective", "label": "Connective", "type": "token", "pattern": "(?<trigger> " + "|".join(CONNECTIVES) + ") (?= [])"}
    tokens = docs.select(F.col("doc_id").cast("string").alias("sent_key"), F.transform(X.words(F.col("text")), lambda w: F.struct(w.alias("word"))).alias("tokens"), F.expr("cast(array() AS array<struct<src:int,dst:int,rel:string>>)").alias("edges"))
    return find_mentions(tokens, [rule]).where("label = 'Connective'").groupBy("text").agg(F.count("*").alias("n"))


@query("annotated_tokens")
def _(spark, d):
    from strandline.functions.annotate import sentences

    s = sentences(X.english(table(spark, d, "documents")))
    return s.select(F.explode("tokens.tag").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("causal_edges")
def _(spark, d):
    from strandline.plans import pipeline

    return pipeline.edges(pipeline.mentions(X.english(table(spark, d, "documents"))))


@query("causal_graph")
def _(spark, d):
    from strandline.plans import pipeline

    return pipeline.causal_graph(pipeline.edges(pipeline.mentions(X.english(table(spark, d, "documents")))))


@query("compositional_slots")
def _(spark, d):
    from strandline.operators import compositional

    names = table(spark, d, "extractions").where("canonical_name IS NOT NULL").select(F.col("canonical_name").alias("name")).distinct()
    return compositional.ground(names, table(spark, d, "ontology_nodes").select(F.col("node_path").alias("node"), "branch"), "name", "name").withColumnRenamed("id", "name")


@query("time_expressions")
def _(spark, d):
    from strandline.operators.context import times

    docs = X.english(table(spark, d, "documents")).select("doc_id", "text", F.to_date("published_at").alias("dct"))
    return times(docs).select("doc_id", "start", "stop", "text", F.col("begins").cast("string").alias("begins"), F.col("ends").cast("string").alias("ends"))


@query("annotation_sheet")
def _(spark, d):
    from strandline.plans import pipeline
    from strandline.sources.exporters import annotation_sheet

    return annotation_sheet(pipeline.edges(pipeline.mentions(X.english(table(spark, d, "documents")))))


def _states():
    """Attachments of extractions; rows without a type are none."""
    return F.transform(F.filter(F.coalesce("states", F.expr("cast(array() AS array<struct<state_type:string,state_text:string>>)")), lambda s: s["state_type"].isNotNull()), lambda s: F.struct(s["state_type"].alias("type"), s["state_text"].alias("trigger"), F.array().cast("array<string>").alias("quantifiers")))


def _as_corpus(spark, d):
    """``extractions`` as the mentions of an annotated corpus, with their documents and (empty) sentences."""
    e = table(spark, d, "extractions").where("document_id IS NOT NULL AND sent_no IS NOT NULL")
    none = lambda kind: F.lit(None).cast(kind)
    mentions = e.select(
        "document_id", "sent_no", F.col("extraction_id").cast("int").alias("mention_no"), F.coalesce("subtype", F.lit("")).alias("label"), F.coalesce("mention_labels", F.array().cast("array<string>")).alias("labels"), F.lit(0).alias("start"), F.lit(1).alias("stop"), none("int").alias("trigger_start"),
        none("int").alias("trigger_stop"), F.col("mention_text").alias("text"), F.array().cast("array<struct<role:string,mention_no:int>>").alias("args"), F.col("rule_name").alias("found_by"), "canonical_name", "relevance", _states().alias("attachments"),
    )
    docs = table(spark, d, "cdr").select("document_id", F.col("extracted_metadata.Title").alias("title"), F.col("uri").alias("location"), none("string").alias("dct_text"), none("date").alias("dct_start"), none("date").alias("dct_end"))
    sentences = e.select("document_id", "sent_no").distinct().select("document_id", "sent_no", none("string").alias("text"), none("double").alias("relevance"), F.lit(None).cast("array<struct<word:string,tag:string,entity:string,start:int,stop:int,lemma:string,chunk:string,norm:string>>").alias("tokens"), F.lit(None).cast("array<struct<src:int,dst:int,rel:string>>").alias("edges"))
    return docs, sentences, mentions


KEPT_STATES = "len(list_filter(states, lambda s: s.state_type IS NOT NULL))"


@query("corpus_round_trip", f"SELECT document_id, sent_no, extraction_id::INTEGER AS mention_no, mention_text AS text, rule_name AS found_by, canonical_name, relevance, coalesce({KEPT_STATES}, 0)::INTEGER AS n_states FROM extractions WHERE document_id IS NOT NULL AND sent_no IS NOT NULL")
def _(spark, d):
    from strandline.sources import corpus

    _, _, m = corpus.read_corpus(corpus.write_corpus(*_as_corpus(spark, d)))
    return m.select("document_id", "sent_no", "mention_no", "text", "found_by", "canonical_name", "relevance", F.size("attachments").alias("n_states"))


@query("mention_json_round_trip", "SELECT document_id, sent_no, subtype AS label, rule_name AS found_by, count(*) AS n FROM (SELECT DISTINCT document_id, sent_no, coalesce(subtype, '') AS subtype, rule_name, mention_labels FROM extractions WHERE document_id IS NOT NULL AND sent_no IS NOT NULL) GROUP BY ALL")
def _(spark, d):
    from strandline.sources import corpus

    m = corpus.read_mentions_json(corpus.mentions_json(_as_corpus(spark, d)[2]))
    return m.groupBy("document_id", "sent_no", "label", "found_by").agg(F.count("*").alias("n"))


@query("metadata_keys", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(payload)) AS key FROM meta_files WHERE json_valid(payload)) GROUP BY key")
def _(spark, d):
    from strandline.sources.dimensions import metadata_keys

    return metadata_keys(table(spark, d, "meta_files"), F.col("payload"))


@query("attachment_words", "SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(states, lambda s: s.state_text), lambda t: t IS NOT NULL)) AS word FROM extractions) GROUP BY word")
def _(spark, d):
    e = table(spark, d, "extractions").select(F.explode(_states()).alias("a")).where("a.trigger IS NOT NULL")
    named = F.struct(F.col("a.trigger").alias("trigger"), F.col("a.quantifiers").alias("quantifiers"), F.lit(None).cast("string").alias("text"))
    return e.select(F.explode(T.words_of(named)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    "document_time_attached",
    f"""SELECT extraction_id, (coalesce({KEPT_STATES}, 0) + CASE WHEN dct IS NOT NULL AND coalesce(len(list_filter(states, lambda s: s.state_type = 'TIMEX')), 0) = 0 THEN 1 ELSE 0 END)::INTEGER AS n
    FROM extractions LEFT JOIN (SELECT document_id, min("timestamp") AS dct FROM cdr WHERE "timestamp" IS NOT NULL GROUP BY document_id) USING (document_id)""",
)
def _(spark, d):
    e = table(spark, d, "extractions").select("extraction_id", F.col("document_id").alias("doc_id"), _states().alias("attachments"))
    docs = table(spark, d, "cdr").where("document_id IS NOT NULL").select(F.col("document_id").alias("doc_id"), F.col("timestamp").alias("dct"))
    return T.with_document_time(e, docs).select("extraction_id", F.size("attachments").alias("n"))


@query(
    "quantified_changes",
    f"""SELECT extraction_id AS mention_id, s.state_text AS quantifier, round(exp(intercept + mu * 2.0 + sigma * 0.5) * 0.5, 6) AS delta FROM (SELECT extraction_id, unnest(list_filter(states, lambda s: s.state_type = 'QUANT')) AS s FROM extractions)
    LEFT JOIN (VALUES {", ".join(map(str, ADJECTIVES))}) AS k(adjective, intercept, mu, sigma) ON adjective = lower(s.state_text)""",
)
def _(spark, d):
    k = spark.createDataFrame(ADJECTIVES, "adjective string, intercept double, mu double, sigma double")
    m = table(spark, d, "extractions").select(F.col("extraction_id").alias("mention_id"), _states().alias("attachments"))
    return T.quantified(m, k, 2.0, 0.5).select("mention_id", "quantifier", F.round("delta", 6).alias("delta"))


@query(
    "expandable_concepts",
    """SELECT extraction_id AS mention_no FROM extractions c WHERE extraction_type = 'concept' AND len(list_filter(states, lambda s: s.state_type IN ('INC', 'DEC', 'QUANT', 'POS', 'NEG'))) > 0
    AND NOT EXISTS (SELECT 1 FROM extractions e WHERE e.extraction_type = 'relation' AND e.document_id = c.document_id AND e.canonical_name = c.canonical_name)""",
)
def _(spark, d):
    from strandline.operators.reshape import expandable_concepts

    e = table(spark, d, "extractions")
    named = F.xxhash64("document_id", "canonical_name").cast("string")
    key = F.when(F.col("document_id").isNotNull() & F.col("canonical_name").isNotNull(), named).alias("sent_key")
    m = e.where("extraction_type = 'concept'").select(key, F.col("extraction_id").alias("id"), F.lit(0).alias("mention_no"), F.lit("Concept").alias("label"), F.array(F.lit("Concept")).alias("labels"), _states().alias("attachments"))
    edges = e.where("extraction_type = 'relation'").select(key, F.lit(0).alias("mention_no")).where("sent_key IS NOT NULL")
    return expandable_concepts(m, edges).select(F.col("id").alias("mention_no"))


@query(
    "gold_rejects",
    """SELECT extraction_id AS row_no FROM extractions e WHERE NOT EXISTS (SELECT 1 FROM cdr c WHERE c.document_id = e.document_id AND contains(c.extracted_text, e.mention_text))
    OR canonical_name IS NULL OR mention_text IS NULL""",
)
def _(spark, d):
    from strandline.sources.dimensions import gold_sheet

    e = table(spark, d, "extractions")
    entities = e.select(F.col("extraction_id").alias("row_no"), F.col("document_id").alias("sent_key"), F.when(F.col("canonical_name").isNotNull(), F.col("mention_text")).alias("entity"))
    texts = table(spark, d, "cdr").where("document_id IS NOT NULL").select(F.col("document_id").alias("sent_key"), F.col("extracted_text").alias("text"))
    nodes = e.where("canonical_name IS NOT NULL AND mention_text IS NOT NULL").select(F.col("mention_text").alias("id"), F.lit("wm/any").alias("node"), F.lit(1.0).alias("score")).distinct()
    return gold_sheet(entities, texts, nodes)[1].select("row_no")
