"""Operator 9, token counts: byte-pair merging with a heap over a linked list.

A piece of text starts as its bytes, the last one marked as the word's end. Again and again the adjacent pair of the
lowest rank is popped and merged; the piece has as many tokens as it had symbols less the merges. No ids are made.

Defined cases: a null or empty text has no bytes and no tokens; special strings count as one token each; repeated rows
are counted row by row; texts are never cut, and a piece is held alone in memory, so long texts need no more than
their own size besides the bounded cache.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "word_bpe_49k.json"
OVER_LIMIT = 2048
CACHE_ENTRIES = 1_500_000
#: Capitals whose small letters the library knows and this Python's str.lower() doesn't.
_LATE_CAPITALS = str.maketrans({0xA7CB: 0x0264, 0xA7DC: 0x019B})
#: Control characters that str.split() takes for white space and the vocabulary's pattern does not.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable stand-in for each byte in the vocabulary: itself if visible in Latin-1, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in visible}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class PairCounter(dict):
    """Tokens of a run without white space; bounded caches of such runs and of their pieces."""

    def __init__(self, path: str):
        super().__init__()
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        self.pieces: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        name = lambda s: self.ids.setdefault(s, len(self.ids))
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[name(a), name(b)] = (rank, name(a + b))
        for x in self.letters:
            name(x), name(x + self.end)
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))

    def merged(self, piece: str) -> int:
        """Symbols left of one piece."""
        raw = piece.encode("utf-8", "replace")
        symbols = [self.ids[self.letters[b]] for b in raw[:-1]] + [self.ids[self.letters[raw[-1]] + self.end]]
        n = left = len(symbols)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        find, heap = self.merges.get, []
        for i in range(n - 1):
            if m := find((symbols[i], symbols[i + 1])):
                heap.append((m[0], i, symbols[i], symbols[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue  # one of the two has merged since
            symbols[i], symbols[j] = new, -1
            left -= 1
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if m := find((new, symbols[k])):
                    heapq.heappush(heap, (m[0], i, new, symbols[k], m[1]))
            if (p := prev[i]) >= 0 and (m := find((symbols[p], new))):
                heapq.heappush(heap, (m[0], p, symbols[p], new, m[1]))
        return left

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(_LATE_CAPITALS)  # no special rule for a final sigma
        text = text.lower()
        if text.isalpha():
            return self.piece(text)
        if text[-1:] in (".", ",") and text[:-1].isalpha():
            return self.piece(text[:-1]) + 1
        return sum(map(self.piece, self.pattern.findall(text)))

    def piece(self, piece: str) -> int:
        if (n := self.pieces.get(piece)) is None:
            if len(self.pieces) > CACHE_ENTRIES:
                self.pieces.clear()
            self.pieces[piece] = n = self.merged(piece)
        return n

    def __missing__(self, run: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        self[run] = n = self.plain(run)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" in text and (found := len(self.special.findall(text))):
            return found + sum(map(self.count, self.special.split(text)))
        if _ODD_SPACE.search(text):
            return self.plain(text)
        get = self.__getitem__
        return sum(map(get, text.split()))


@cache
def counter(path: str) -> PairCounter:
    """One for each Python worker, kept between its tasks."""
    return PairCounter(path)


def token_count(text: str | Column, path: str | None = None) -> Column:
    """Tokens of each text under the vocabulary file at path, which every executor must hold at the same place."""
    path = path or public_tokenizers.path(VOCABULARY)

    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([counter(path).count(x) for x in texts], dtype="int64")

    return F.pandas_udf(tokens, "long")(text)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_count("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)
