"""Queries of the llm operators; each reads its whole tables."""

from __future__ import annotations

import importlib.util
import os

from strandline.llm.leakage import leaks
from strandline.llm.neardup import components, pairs
from strandline.llm.quality import kinds, outlier_scores, statistics
from strandline.llm.scans import repaired
from strandline.llm.sentences import sentences
from strandline.llm.tokens import encode_corpus
from strandline.session import table, written


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file: ``$PUBLIC_TOKENIZERS`` or the installed package of that purpose."""
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def p1_found(spark, sf_dir):
    return sentences(table(spark, sf_dir, "cdr"))


def p2_found(spark, sf_dir):
    return pairs(table(spark, sf_dir, "cdr"))


def p2_classes(spark, sf_dir):
    return components(table(spark, sf_dir, "cdr"))


def p3_found(spark, sf_dir):
    return repaired(table(spark, sf_dir, "scans"), table(spark, sf_dir, "lexicon"))


def p7_ids(spark, sf_dir):
    return encode_corpus(table(spark, sf_dir, "documents"), tokenizer_path())


def p8_found(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "gold_items"))


def p9_found(spark, sf_dir):
    return kinds(statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lexicon")))


def p9_statistics(spark, sf_dir):
    return statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lexicon")).drop("digest")


def p9_outliers(spark, sf_dir):
    return outlier_scores(written(statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lexicon")), "quality"))


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics, "p9_outliers": p9_outliers, "p1_found": p1_found, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p7_ids": p7_ids, "p8_found": p8_found}
_GRAMS = "array_to_string(w[i : i + 9], ' ') AS gram"


def _words_of(column: str) -> str:
    return f"regexp_extract_all(lower(nfc_normalize({column})), '[\\p{{L}}\\p{{N}}]+')"


# every window of every text is compared: an exact check of the searches
SQL: dict[str, str] = {
    "p2_found": """WITH t AS (SELECT rec_no, regexp_replace(lower(extracted_text), '[ \\t\\r\\n]', '', 'g') AS s FROM cdr WHERE extracted_text IS NOT NULL),
      w AS MATERIALIZED (SELECT DISTINCT rec_no, hash(substr(s, i, 8)) AS h FROM (SELECT rec_no, s, unnest(range(1, length(s) - 6)) AS i FROM t WHERE length(s) >= 200)),
      n AS (SELECT rec_no, count(*) AS n FROM w GROUP BY rec_no),
      p AS (SELECT a.rec_no AS rec_a, b.rec_no AS rec_b, count(*) AS k FROM w a JOIN w b ON a.h = b.h AND a.rec_no < b.rec_no GROUP BY ALL)
      SELECT rec_a, rec_b FROM p JOIN n x ON x.rec_no = rec_a JOIN n y ON y.rec_no = rec_b WHERE k >= 0.6 * (x.n + y.n - k)""",
    "p8_found": f"""WITH g AS (SELECT DISTINCT item_id, {_GRAMS} FROM (SELECT item_id, {_words_of("item_text")} AS w, unnest(range(1, len({_words_of("item_text")}) - 8)) AS i FROM gold_items)),
      d AS (SELECT DISTINCT doc_id, {_GRAMS} FROM (SELECT doc_id, {_words_of("text")} AS w, unnest(range(1, len({_words_of("text")}) - 8)) AS i FROM documents))
      SELECT DISTINCT doc_id, item_id FROM d JOIN g USING (gram)""",
}
