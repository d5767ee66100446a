"""Operator 10, quality rules: line-first cleaning.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a document
that loses more than half of its words with them is rejected. Base statistics of the whole text reject it too.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; a line without words is
neither judged nor counted; repeated rows and equal doc_ids are judged row by row; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "we use cookies", "javascript", "lorem ipsum", "powered by", "subscribe to our newsletter",
    "tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialité", "mentions légales",
    "alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "datenschutzerklärung", "impressum",
    "todos los derechos reservados", "bajo licencia", "términos de uso", "política de privacidad", "aviso legal",
)
#: A phrase fails a line of at most so many words; in a longer one it is a mention.
BOILERPLATE_WORDS = 30
#: Lines of these words alone are navigation.
NAVIGATION = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "next", "previous", "back",
    "back to top", "read more", "share", "contact", "contact us", "about", "about us", "sitemap", "help", "faq",
    "accueil", "connexion", "rechercher", "suivant", "précédent", "retour", "partager", "à propos", "aide", "plan du site",
    "startseite", "anmelden", "suche", "weiter", "zurück", "teilen", "kontakt", "über uns", "hilfe",
    "inicio", "menú", "iniciar sesión", "buscar", "siguiente", "anterior", "volver", "compartir", "contacto", "acerca de", "ayuda",
)
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
#: A line of fewer words than this must end as a sentence does.
SHORT_LINE = 5
TERMINAL = ".!?:;,\"')…”»"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
    "n_failed_lines long, n_clean_words long, base_failed boolean, kept boolean, clean_text string"
)
#: Rows of a frame handed on; cleaned texts of a whole batch aren't held at once.
FRAME = 256
_SPACE = b" \t\n\r\x0b\x0c"
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)))
_NAV = frozenset(NAVIGATION)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    key, width = a, 1
    while width < window:  # 8 = 2 * 2 * 2: a window's rank comes from the ranks of its halves
        key = key[:-width] * (int(key.max()) + 1) + key[width:]
        width *= 2
        key = np.unique(key, return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_fails(line: str, words: int) -> bool:
    """The three rules for one line with words."""
    marks = sum(map(line.count, SYMBOLS)) + line.count("!")
    if 10 * marks > 3 * words and marks > 1:
        return True
    low = line.strip(" \t\r\x0b\x0c").lower()
    if words < SHORT_LINE and (low in _NAV or low[-1] not in TERMINAL):
        return True
    return words <= BOILERPLATE_WORDS and _BOILER.search(low) is not None


def judge(text: str | None) -> tuple:
    """SCHEMA's values for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    repeats = repeated_words(words)
    seen: set[str] = set()
    lines = failed = dup = clean = 0
    out = []
    for line in text.split("\n"):
        k = len(line.encode("utf-8", "surrogatepass").split())
        if not k:
            out.append(line)
            continue
        lines += 1
        dup += line in seen
        seen.add(line)
        if line_fails(line, k):
            failed += 1
        else:
            clean += k
            out.append(line)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEATED_PERCENT * n
    return n, word_chars, n_symbols, dup, repeats, lines, failed, clean, base, not base and 2 * clean >= n, "\n".join(out)


def quality_report(text: str | Column) -> Column:
    """A struct of SCHEMA's values for each text.

    Results leave in frames of FRAME rows. The function counts as nondeterministic so that a filter on its result doesn't
    make Spark run it a second time below the filter.
    """

    def report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for at in range(0, len(texts), FRAME):
                yield pd.DataFrame([judge(x) for x in texts.array[at : at + FRAME]], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return F.pandas_udf(report, SCHEMA).asNondeterministic()(text)


def with_quality(docs: DataFrame, text: str | Column = "text", out: str = "quality") -> DataFrame:
    """docs with one struct column more: the statistics, the verdict and the cleaned text."""
    return docs.withColumn(out, quality_report(text))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents kept, with their cleaned text; all columns of docs, n_chars (if there) follows the text."""
    rows = small_batches(docs).select(F.struct(*docs.columns).alias("doc"), quality_report("text").alias("q")).filter("q.kept")
    new = {"text": F.col("q.clean_text"), "n_chars": F.length("q.clean_text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = with_quality(table(spark, sf_dir, "documents", "doc_id", "text"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_failed_lines n_clean_words base_failed kept".split()
    return q.select("doc_id", *[f"quality.{c}" for c in names])


def _like(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p.replace(chr(39), 2 * chr(39))}')" for p in phrases) + ")"


ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (SELECT row_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT row_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) > 8)),
twice AS (SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, s) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT row_id, count(DISTINCT j) AS n FROM (SELECT row_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY row_id),
lines AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
judged AS (
  SELECT row_id, row_number() OVER (PARTITION BY row_id, line ORDER BY i) > 1 AS dup, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k,
    len(regexp_extract_all(line, '[#*$%&|<>!]')) AS marks, lower(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS low
  FROM lines),
verdicts AS (
  SELECT *, (10 * marks > 3 * k AND marks > 1)
    OR (k < {SHORT_LINE} AND (low IN ({", ".join(f"'{p}'" for p in NAVIGATION)}) OR right(low, 1) NOT IN ('.', '!', '?', ':', ';', ',', '"', '''', ')', '…', '”', '»')))
    OR (k <= {BOILERPLATE_WORDS} AND {_like("low", BOILERPLATE)}) AS failed
  FROM judged WHERE k > 0),
per AS (SELECT row_id, count(*) AS n_lines, count(*) FILTER (dup) AS dups, count(*) FILTER (failed) AS n_failed, coalesce(sum(k) FILTER (NOT failed), 0) AS clean FROM verdicts GROUP BY row_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_failed, 0)::BIGINT AS n_failed_lines,
    coalesce(clean, 0)::BIGINT AS n_clean_words
  FROM words LEFT JOIN repeats USING (row_id) LEFT JOIN per USING (row_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * n_clean_words >= n_words AS kept
FROM base
"""
