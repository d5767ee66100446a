"""Operator 2, benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Test items are the indexed documents, passages of training text the queries. Term weights are BM25's, divided by the
item's own total, so a score is the share of an item's weight that the passage holds and one threshold serves all items.
Postings are cut into blocks of neighbouring items with a maximum each: blocks whose maxima can't reach the threshold are
skipped, and inside a block cursors leap to pivots. Every item above the threshold is then verified: the passage must
hold enough of the 5-word shingles of the item's question and of its answer, or of those of the whole item,
so that an edited or missing part doesn't hide the rest.

An item has one text: its last sentences with a third of its words or more are the answer, its last third of words where that
takes all sentences; the rest is the question. Passages are as long as two of the longest items and start every longest item, so an item's text always lies whole in one.

Items are indexed in blocks of bounded bytes, each broadcast alone, with document frequencies over all items. A pass over the
texts searches HELD blocks, so a worker's memory doesn't grow with the benchmark; the driver's does, by about its texts' size.

Defined cases: null or empty texts and items match nothing; equal items are each reported; repeated rows are judged row by
row; long texts are walked passage by passage; without items nothing matches; other columns are carried by `drop_leaks`.
"""

from __future__ import annotations

import math
import re
from collections import Counter, OrderedDict
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_batches, table

K1, B = 1.2, 0.75
THRESHOLD, QUESTION_OVERLAP, ANSWER_OVERLAP, WHOLE_OVERLAP = 0.5, 0.5, 0.5, 0.5
SHINGLE, ITEMS_A_BLOCK, INDEX_BYTES = 5, 4, 2 << 20
#: Indexes that a worker holds at once; items of more blocks take further passes over the texts.
HELD = 4
HITS = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def parts_of(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer words of an item."""
    sentences = [w for s in _SENTENCE.split(text or "") if (w := words_of(s))]
    words = [w for s in sentences for w in s]
    cut = len(words)
    for own in reversed(sentences):
        if 3 * (len(words) - cut) >= len(words):
            break
        cut -= len(own)
    if cut <= 0:
        cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[str], passage: list[str]) -> float:
    """The share of the part's shingles in the passage; a part of fewer words is one shingle, an empty one is all there."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    own = shingles(part, n)
    return len(own & shingles(passage, n)) / len(own)


_reached = itemgetter(0)


class ImpactIndex:
    """Postings with normalized BM25 weights, in blocks of items."""

    def __init__(self, items: list[tuple[int, str]], frequencies: dict[str, int], n_items: int, mean_words: float):
        rows = [(i, w, *parts_of(t)) for i, t in items if (w := words_of(t))]
        self.ids, self.parts = [r[0] for r in rows], [r[2:] for r in rows]
        self.longest = max((len(r[1]) for r in rows), default=1)
        postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, words, _, _) in enumerate(rows):
            raw = {}
            for term, tf in Counter(words).items():
                idf = math.log(1 + (n_items - frequencies[term] + 0.5) / (frequencies[term] + 0.5))
                raw[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
            total = sum(raw.values())
            for term, w in raw.items():
                postings.setdefault(term, []).append((k, w / total))
        self.terms = {t: n for n, t in enumerate(postings)}
        self.bound = np.zeros(len(self.terms) + 1)  # the last: words of no item
        self.blocks: list[dict[int, list[tuple[int, float]]]] = []
        self.tops: list[dict[int, float]] = []
        self.maxima: list[tuple[np.ndarray, np.ndarray]] = []
        for n, own in enumerate(postings.values()):
            by: dict[int, list[tuple[int, float]]] = {}
            for k, w in own:
                by.setdefault(k // ITEMS_A_BLOCK, []).append((k, w))
            self.blocks.append(by)
            self.tops.append({block: max(w for _, w in x) for block, x in by.items()})
            self.maxima.append((np.fromiter(by, np.int64), np.fromiter(self.tops[-1].values(), np.float64)))
            self.bound[n] = max(w for _, w in own)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items with a score of threshold or more for the distinct terms."""
        least = threshold - 1e-9
        if not terms or self.bound[terms].sum() < least:
            return []
        own_blocks = [self.maxima[t][0] for t in terms]
        met = np.concatenate(own_blocks)
        upper = np.bincount(met, np.concatenate([self.maxima[t][1] for t in terms]))
        candidates = np.flatnonzero(upper >= least).tolist()
        if not candidates:
            return []
        owner = np.repeat(terms, [len(x) for x in own_blocks])
        found = []
        for block in candidates:
            # cursors: the item reached, the place in the postings, the postings, their maximum
            cursors = [[own[0][0], 0, own, self.tops[t][block]] for t in owner[met == block].tolist() for own in (self.blocks[t][block],)]
            cursors.sort(key=_reached)
            while cursors:
                reach = 0.0
                for c in cursors:
                    reach += c[3]
                    if reach >= least:
                        break
                else:
                    break
                pivot, score, done = c[0], 0.0, False
                # only cursors up to the pivot move; those before it leap to it
                for c in cursors:
                    if c[0] > pivot:
                        break
                    at, own = c[1], c[2]
                    while at < len(own) and own[at][0] < pivot:
                        at += 1
                    if at < len(own) and own[at][0] == pivot:
                        score += own[at][1]
                        at += 1
                    if at < len(own):
                        c[0], c[1] = own[at][0], at
                    else:
                        c[3], done = -1.0, True
                if done:
                    cursors = [c for c in cursors if c[3] >= 0]
                cursors.sort(key=_reached)
                if score >= least:
                    found.append((pivot, score))
        return found

    def leaks(self, text: str | None, threshold: float, question: float, answer: float, whole: float = WHOLE_OVERLAP) -> list[dict]:
        """The verified items in a text, each with its best passage's figures."""
        words = words_of(text)
        none, get = len(self.terms), self.terms.get
        if not words or not none:
            return []
        ids = np.array([get(w, none) for w in words])
        step, n = self.longest, len(words)
        starts = np.arange(0, max(1, n - step), step)
        ends = np.minimum(starts + 2 * step, n)
        sums = np.concatenate([[0.0], np.cumsum(self.bound[ids])])
        best: dict[int, dict] = {}
        # repeats of a word count again here, so the sum is at least the bound that search() needs
        for k in np.flatnonzero(sums[ends] - sums[starts] >= threshold - 1e-9).tolist():
            a, b = int(starts[k]), int(ends[k])
            terms = np.unique(ids[a:b])
            for item, score in self.search(terms[terms < none].tolist(), threshold):
                passage, (q_words, r_words) = words[a:b], self.parts[item]
                q, r = overlap(q_words, passage), overlap(r_words, passage)
                held = (q >= question and r >= answer) or overlap(q_words + r_words, passage) >= whole
                if held and (q + r, score) > best.get(item, {"key": (-1, 0)})["key"]:
                    best[item] = {"key": (q + r, score), "item_id": self.ids[item], "score": round(score, 6), "question_overlap": q, "answer_overlap": r}
        return [{k: v for k, v in x.items() if k != "key"} for _, x in sorted(best.items())]


#: In each Python worker: the broadcast values last met and their indexes. Holding a value keeps later ones from taking its place.
_held: OrderedDict[int, tuple[tuple, ImpactIndex]] = OrderedDict()


def _built(index: Broadcast) -> ImpactIndex:
    """The index, made once for a value in each Python worker while it is among the last HELD."""
    value = index.value
    if id(value) not in _held:
        while len(_held) >= HELD:
            _held.popitem(last=False)
        _held[id(value)] = value, ImpactIndex(*value)
    _held.move_to_end(id(value))
    return _held[id(value)][1]


def _passes(indexes: list[Broadcast]) -> list[list[Broadcast]]:
    return [indexes[at : at + HELD] for at in range(0, len(indexes), HELD)]


def _stored_by_block(df: DataFrame, name: str) -> DataFrame:
    """df in the shared folder, a folder for each block, so that reading one block reads no other."""
    path = scratch_path(df.sparkSession, name)
    df.repartition("block").write.partitionBy("block").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def item_blocks(benchmark: DataFrame) -> list[Broadcast]:
    """The items in blocks of about INDEX_BYTES, each broadcast with what BM25 needs of all items.

    Items are cut into words once and stored by block, as are the terms of each block with their frequencies over all items; the driver draws one block at
    a time. Rows are dealt one by one, so repeated items don't meet in one block.
    """
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    if not size:
        return []
    n_blocks = math.ceil(size / INDEX_BYTES)
    words = F.pandas_udf(lambda texts: pd.Series([words_of(x) for x in texts]), "array<string>")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    listed = _stored_by_block(dealt.select("item_id", "text", words("text").alias("words"), "block"), "items")
    n, mean = listed.agg(F.count("*"), F.avg(F.size("words"))).first()
    terms = listed.select("block", F.explode(F.array_distinct("words")).alias("term")).groupBy("block", "term").count()
    frequencies = terms.groupBy("term").agg(F.sum("count").alias("n"))
    found = _stored_by_block(terms.join(frequencies, "term").select("term", "n", "block"), "item-terms")
    out = []
    for block in range(n_blocks):
        own = [(r.item_id, r.text) for r in listed.filter(F.col("block") == block).select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]
        df = dict(map(tuple, found.filter(F.col("block") == block).select("term", "n").toLocalIterator()))
        if own:
            out.append(spark.sparkContext.broadcast((own, df, n, mean)))
    return out


def leaks_of(text: str | Column, indexes: list[Broadcast], threshold: float = THRESHOLD, question: float = QUESTION_OVERLAP, answer: float = ANSWER_OVERLAP) -> Column:
    """HITS for each text, of HELD indexes at most."""
    found = F.array().cast(HITS)
    for index in indexes:
        found = F.concat(found, F.pandas_udf(_searcher(index, threshold, question, answer), HITS)(text))
    return found


def _searcher(index: Broadcast, threshold: float, question: float, answer: float):
    def search(texts: pd.Series) -> pd.Series:
        own = _built(index)
        return pd.Series([own.leaks(x, threshold, question, answer) for x in texts], dtype="object")

    return search


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, as they are, without those that hold a test item."""
    rows = small_batches(docs).select(F.struct(*docs.columns).alias("doc"))
    for own in _passes(item_blocks(benchmark)):
        rows = rows.withColumn("leaks", leaks_of(F.col("doc.text"), own)).filter(F.size("leaks") == 0).select("doc")
    return rows.select("doc.*")


def found_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each row of docs and item found in it."""
    none = docs.limit(0).select("doc_id", F.explode(F.array().cast(HITS)).alias("leak"))
    for own in _passes(item_blocks(benchmark)):
        none = none.unionByName(docs.select("doc_id", F.explode(leaks_of("text", own)).alias("leak")))
    return none.select("doc_id", "leak.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and test item found in it."""
    return found_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
