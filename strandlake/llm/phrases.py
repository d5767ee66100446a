"""Operator 11, phrases whose words stand together more often than their parts let expect, counted by marginalisation.

Each place of a piece is counted once, with the longest window that begins there: its word and the next ones as columns,
padded with nulls behind the piece's end. One ROLLUP over these columns sums shorter and shorter prefixes, and so yields the
frequencies of all phrases of one to MOST words. The columns of following words come from the piece's own array, shifted
(arrays_zip pads it), so no word is shuffled to be put beside its neighbour.

Before windows are counted, they are cut before the first pair or triple of neighbours that is surely too rare, and single words
that are too rare count for the language alone: words, pairs and the triples of two kept pairs are counted by the bucket of
their hash, and a bucket below the least frequency holds none that counts. Buckets grow with the input up to MOST_BUCKETS, a
bitmap of 16 MB; beyond that fewer windows are cut and more are shuffled, the result stays the same.

Defined cases: a null text is empty; a null lang is `und`; a piece of fewer words than a phrase holds none of it; equal scores
are ordered by frequency, then by the phrase's bytes; equal rows count as often as they occur; no table, no rows; other columns
are left out. All counts are exact, scores are computed in decimals of 38 digits (their products need 34 at 10**11 words).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table

#: The longest phrase in words, the least frequency, and how many phrases of a language are returned.
MOST, LEAST, TOP = 5, 100, 2000
#: What ends a piece.
ENDS = r"[.,;:!?\x0A-\x0D]"
UNKNOWN = "und"
#: Buckets of pairs: about one for so many bytes of text, and at most so many.
BUCKET_BYTES, MOST_BUCKETS = 64, 1 << 27
#: Longs in a page of the bitmap.
PAGE = 64

c = F.col
_WINDOW = [f"w{k}" for k in range(1, MOST + 1)]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all of a text in ASCII at once, letter by letter in others."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, words) of every piece."""
    split = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.explode(F.split("text", ENDS)).alias("piece"))
    words = F.array_remove(F.split(F.replace(lower_ascii(c("piece")), F.lit("\t"), F.lit(" ")), " "), "")
    return split.select("lang", words.alias("words"))


def windows(pieces: DataFrame, longest: int = MOST) -> DataFrame:
    """(lang, w1, w2, ...): each place with its word and the next ones, null behind the piece's end."""
    shifted = [F.slice("words", F.lit(k + 1), F.size("words")).alias(f"w{k + 1}") for k in range(longest)]
    return pieces.select("lang", F.inline(F.arrays_zip(c("words"), *shifted[1:])).alias(*_WINDOW[:longest]))


def _bucket(buckets: int, *words: str) -> Column:
    return F.xxhash64("lang", *words).bitwiseAND(F.lit(buckets - 1).cast("bigint"))


def _held(bits: Column, bucket: Column) -> Column:
    page = F.get(bits, F.shiftright(bucket, 12).cast("int"))
    return F.call_function("shiftright", F.get(page, F.shiftright(bucket, 6).bitwiseAND(PAGE - 1).cast("int")), bucket.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def full_buckets(found: DataFrame, buckets: int, least: int) -> DataFrame:
    """One row, `bits`: pages of whole numbers, a bit for each bucket that occurs in found (bucket) at least `least` times."""
    full = found.groupBy("bucket").count().filter(c("count") >= least)
    longs = full.groupBy(F.shiftright("bucket", 6).alias("long")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), c("bucket").bitwiseAND(63).cast("int"))).alias("bits"))
    filled = longs.groupBy(F.floor(c("long") / PAGE).alias("page")).agg(F.map_from_entries(F.collect_list(F.struct(c("long") % PAGE, "bits"))).alias("held"))
    every = found.sparkSession.range(-(-buckets // (64 * PAGE))).withColumnRenamed("id", "page").join(filled, "page", "left")
    none = F.lit(0).cast("bigint")
    page = F.transform(F.sequence(none, F.lit(PAGE - 1).cast("bigint")), lambda k: F.coalesce(F.element_at(c("held"), k), none))
    paged = every.select("page", page.alias("bits"))
    return paged.agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "bits"))), lambda x: x["bits"]).alias("bits"))


def counted_windows(pieces: DataFrame, buckets: int, least: int) -> DataFrame:
    """(lang, w1, ..., n): the windows, each as long as its pairs and triples may be frequent, and how often each occurs."""
    pairs = windows(pieces, 2).filter("w2 IS NOT NULL").select(_bucket(buckets, "w1", "w2").alias("bucket"))
    two = materialize(full_buckets(pairs, buckets, least), "frequent-pairs").scalar()
    triple = F.when(c("w3").isNotNull() & _held(two, _bucket(buckets, "w1", "w2")) & _held(two, _bucket(buckets, "w2", "w3")), _bucket(buckets, "w1", "w2", "w3"))
    others = windows(pieces, 3).select(F.explode(F.array(_bucket(buckets, "w1"), triple)).alias("bucket")).filter("bucket IS NOT NULL")
    rest = materialize(full_buckets(others, buckets, least), "frequent-triples").scalar()
    longer = _held(rest, _bucket(buckets, "w1"))
    columns = [F.when(longer, c("w1")).alias("w1")]
    for k in range(1, MOST):
        a, b = _WINDOW[k - 1 : k + 1]
        longer = longer & c(b).isNotNull() & _held(two, _bucket(buckets, a, b))
        if k > 1:
            longer = longer & _held(rest, _bucket(buckets, *_WINDOW[k - 2 : k + 1]))
        columns.append(F.when(longer, c(b)).alias(b))
    return windows(pieces).select("lang", *columns).groupBy("lang", *_WINDOW).agg(F.count("*").alias("n"))


def frequencies(counted: DataFrame, least: int) -> DataFrame:
    """(lang, size, words, f): every phrase of one to MOST words that occurs `least` times, and the count of all words at size 0."""
    size = (MOST - (F.length(F.regexp_replace(F.bin(F.grouping_id("lang", *_WINDOW)), "0", "")))).alias("size")
    rolled = counted.rollup("lang", *_WINDOW).agg(F.sum("n").alias("f"), size)
    # a prefix that ends behind the window is the shorter one's: it is counted there
    words = F.filter(F.array(*_WINDOW), lambda w: w.isNotNull())
    found = rolled.filter(c("lang").isNotNull() & (c("f") >= F.when(c("size") > 0, least).otherwise(0)))
    return found.withColumn("words", words).filter(F.size("words") == c("size")).select("lang", "size", "words", "f")


def scored(found: DataFrame) -> DataFrame:
    """Candidates (lang, words, a, n, score, l, r) from frequencies(): the lowest-scoring of the cuts of each."""
    totals = found.filter("size = 0").select("lang", c("f").alias("n"))
    held = found.filter("size > 0").select("lang", F.array_join("words", " ").alias("part"), "f")
    cuts = found.filter("size > 1").select("lang", "words", c("f").alias("a"), F.explode(F.sequence(F.lit(1), c("size") - 1)).alias("k"))
    first = F.array_join(F.slice("words", F.lit(1), c("k")), " ")
    rest = F.array_join(F.slice("words", c("k") + 1, F.size("words")), " ")
    cuts = cuts.withColumns({"first": first, "rest": rest})
    cuts = cuts.join(held.select("lang", c("part").alias("first"), c("f").alias("l")), ["lang", "first"]).join(held.select("lang", c("part").alias("rest"), c("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(broadcast_if_small(totals), "lang")
    wide = {x: c(x).cast("decimal(19,0)") for x in ("a", "n", "l", "r")}
    cuts = cuts.withColumns({"over": (wide["a"] * wide["n"]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), "under": (wide["l"] * wide["r"]).cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("CAST(over AS DECIMAL(38,0)) div under"))
    best = cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "words", "a", "n", "cut.score", "cut.l", "cut.r")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, covered_percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang); a phrase goes if a longer one has covered_percent of its frequency."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = min(MOST_BUCKETS, 1 << max(16, (size // BUCKET_BYTES).bit_length()))
    found = materialize(frequencies(materialize(counted_windows(pieces(docs), buckets, least), "windows"), least), "phrases")
    candidates = materialize(scored(found), "candidates")
    inner = [F.slice("words", F.lit(k + 1), F.lit(n)) for n in range(2, MOST) for k in range(MOST - n + 1)]
    parts = F.filter(F.array_distinct(F.array(*inner)), lambda x: (F.size(x) > 1) & (F.size(x) < F.size("words")))
    covers = candidates.filter(F.size("words") > 2).select("lang", F.explode(parts).alias("words"), c("a").alias("f"))
    covers = covers.groupBy("lang", "words").agg(F.max("f").alias("f"))
    kept = candidates.join(covers, ["lang", "words"], "left").filter(c("f").isNull() | (100 * c("f") < covered_percent * c("a")))
    kept = kept.withColumn("phrase", F.array_join("words", " "))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).filter(c("rank") <= top).select("lang", c("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents", "text", "lang"))


_PARTS = " UNION ALL ".join(f"SELECT lang, n, words, words[1:{k}] AS l_words, words[{k + 1}:] AS r_words, {k} AS k, a FROM wide WHERE len(words) > {k}" for k in range(1, MOST))
_GRAMS = " UNION ALL ".join(f"SELECT lang, words[i:i + {k - 1}] AS words FROM (SELECT lang, words, unnest(range(1, len(words) - {k - 2})) AS i FROM pieces WHERE len(words) >= {k})" for k in range(1, MOST + 1))
_INNER = " UNION ALL ".join(f"SELECT lang, words[{k + 1}:{k + n}] AS words, a FROM wide WHERE len(words) > {n} AND len(words) >= {k + n}" for n in range(2, MOST) for k in range(MOST - n + 1))

ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{ENDS}')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, words, count(*)::HUGEINT AS f FROM ({_GRAMS}) GROUP BY lang, words HAVING count(*) >= {LEAST}),
wide AS (SELECT f.lang, words, f AS a, n FROM f JOIN totals USING (lang) WHERE len(words) > 1),
cuts AS (
  SELECT p.lang, p.words, p.a, p.n, k, l.f AS l, r.f AS r, (1000 * p.a * p.n) // (l.f * r.f) AS score
  FROM ({_PARTS}) p JOIN f l ON l.lang = p.lang AND l.words = p.l_words JOIN f r ON r.lang = p.lang AND r.words = p.r_words),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
covered AS (SELECT lang, words, max(a) AS longer FROM ({_INNER}) GROUP BY lang, words),
kept AS (SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.words = b.words WHERE c.longer IS NULL OR 100 * c.longer < 100 * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= {TOP}"""
