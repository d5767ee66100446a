"""Operator 8, n-gram Jaccard join: prefix filters under several global token orders.

A document's set are its distinct word shingles. Two sets of the wanted similarity share at least k tokens among the first
|x| - ceil(t |x|) + k of each under any order that holds for all documents. Candidates must pass that under three orders;
then the sets themselves are compared. Each order sorts tokens known to be frequent last, by magnitude, and the rest by a keyed
hash; the list of frequent tokens only shapes the orders, so the result doesn't depend on it.

1. Equal sets become one node. All further work is on nodes.
2. Nodes that share their first token under one of three plain hashes are held against a few leaders of that group, pairs in
   proportion to the nodes. Those with a good part of their sketches (smallest hashes) in common are kin; chains of kin are
   families. Kin whose prefixes meet under all three orders are verified; what proves similar forms the first components.
3. Inside a family, nodes of different components are compared block by block, in tasks of bounded size: the prefixes of a block
   under the three orders give its candidates, the sets themselves decide.
4. Across families, prefixes under the first order give the candidates; those under the second and third must meet too.

So every link found has passed the three filters and the comparison of the sets. Families, the dense part, never become rows of
pairs, and pairs across them are rare. Every link between different components is found; which links inside a component are
looked at doesn't change it.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; texts of fewer words than a shingle
are one shingle; repeated rows are linked (their smallest doc_id is their own); a null doc_id never is a component_id unless
the component has no other; other columns are not read, `keep_one` carries them.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, small_batches, table
from .graph import components

ORDERS = 3
#: A token is listed as frequent by a task that meets it in this share of its documents, and 3 times; the list holds so many at most.
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_TOKENS, CHUNK_TOKENS = 1 / 2000, 3, 500_000, 1_000_000
#: Prefixes are so much longer that pairs must share this many of their tokens, or all that similar sets need to share.
SHARED = 3
#: Kin share this part of their sketches of so many smallest hashes; nodes of a family meet in blocks of so many.
KIN_PERCENT, SKETCH, BLOCK, BLOCK_TOKENS = 60, 32, 512, 500_000
#: Groups of nodes with an equal first token are dealt over so many tasks.
SALTS = 8
CACHE_WORDS, CACHE_SETS = 100_000, 16
#: Rows of a frame of signatures handed on; those of a whole batch aren't held at once.
FRAME = 512
_K = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def _mix(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (x ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def tokens_of(text: str | None, n: int) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _K + h[i : len(h) - n + 1 + i]
    out = _mix(out, np.uint64(n))
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def shingle_set(text: str | None, n: int) -> set[bytes]:
    words = words_of(text)
    n = min(n, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def prefix_length(size: int, percent: int) -> int:
    """Any set that is similar enough shares SHARED tokens with these first ones, or all it must share if these are fewer."""
    return min(size, size + percent * size // -100 + SHARED)


def frequent_tokens(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that tasks find frequent, sorted, and the magnitudes of their summed counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= max(FREQUENT_LEAST, int(len(held) * FREQUENT_SHARE))
            return pd.DataFrame({"token": tokens[often].view(np.int64), "times": times[often]})

        for batch in batches:
            for text in batch["text"].array:
                own = tokens_of(text, n)
                held.append(own)
                size += len(own)
                if size > CHUNK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        pa.default_memory_pool().release_unused()

    counted = docs.select("text").mapInPandas(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    top = counted.orderBy(F.desc("times"), "token").limit(FREQUENT_TOKENS).toPandas()
    tokens = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    place = np.argsort(tokens)
    return tokens[place], np.log2(top["times"].to_numpy(dtype=np.float64)[place] + 1).astype(np.uint64)


def prefixes_of(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The plain hashes of a set's tokens under each order, and its prefixes: frequent tokens last, by magnitude."""
    often, magnitude = frequent
    level = np.zeros(len(own), dtype=np.uint64)
    if len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        level = np.where(often[at] == own, magnitude[at], np.uint64(0))
    p, plains, prefixes = prefix_length(len(own), percent), [], []
    for seed in _SEEDS:
        plain = _mix(own, seed)
        plains.append(plain)
        keys = (level << np.uint64(56)) | (plain >> np.uint64(8))
        prefixes.append(own[np.argpartition(keys, p - 1)[:p]] if p < len(own) else own)
    return plains, prefixes


def signatures(docs: DataFrame, frequent: Broadcast, n: int, percent: int) -> DataFrame:
    """A row for each row of docs: doc_id, text_key, node (digest of the set, null if empty), n_shingles and the prefixes."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frequent.value
        for batch in (whole.iloc[at : at + FRAME] for whole in batches for at in range(0, len(whole), FRAME)):
            rows = []
            for text in batch["text"].array:
                own = tokens_of(text, n)
                m = len(own)
                if not m:
                    rows.append((None, 0, None, None, None, None, None))
                    continue
                plains, prefixes = prefixes_of(own, known, percent)
                firsts = np.array([own[np.argmin(x)] for x in plains])
                sketch = np.partition(plains[0], SKETCH - 1)[:SKETCH] if m > SKETCH else plains[0]
                # for the second and third order half of a hash is enough: a chance match costs one comparison
                rest = [(x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in (sketch, *prefixes[1:])]
                rows.append((hashlib.blake2b(own.tobytes(), digest_size=16).digest(), m, firsts.view(np.int64), prefixes[0].view(np.int64), *rest))
            out = pd.DataFrame(rows, columns=["node", "n_shingles", "firsts", "prefix_1", "sketch_0", "prefix_2", "prefix_3"])
            out.insert(0, "text_key", batch["text_key"].array)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out
        pa.default_memory_pool().release_unused()  # the worker lives on in later stages

    keyed = docs.select("doc_id", "text", text_key().alias("text_key"))
    return keyed.mapInPandas(sign, "doc_id long, text_key binary, node binary, n_shingles long, firsts array<long>, prefix_1 array<long>, sketch_0 array<int>, prefix_2 array<int>, prefix_3 array<int>")


def text_key() -> F.Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def texts_of(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the nodes in ids: one text for each."""
    wanted = materialize(nodes.join(ids.distinct(), "id").select("id", "text_key"), "wanted")
    keys = wanted.select("text_key")
    rows = docs.select("text", text_key().alias("text_key")).join(broadcast_if_small(keys), "text_key", "left_semi")
    texts = rows.groupBy("text_key").agg(F.first("text").alias("text"))
    return materialize(texts.join(wanted, "text_key").select("id", "text"), "texts")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as wanted."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: OrderedDict[int, set[bytes]] = OrderedDict()

        def of(key: int, text: str) -> set[bytes]:
            if key not in sets:
                sets[key] = shingle_set(text, n)
                if len(sets) > CACHE_SETS:
                    sets.popitem(last=False)
            sets.move_to_end(key)
            return sets[key]

        for batch in batches:
            out = []
            for a, b, left, right in zip(*(batch[c].array for c in ("a", "b", "left", "right")), strict=True):
                x, y = of(a, left), of(b, right)
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInPandas(check, "a long, b long")


def _similar_sizes(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))


def _with_prefixes(pairs: DataFrame, nodes: DataFrame, prefixes: tuple[str, ...], sizes: bool = False) -> DataFrame:
    """pairs (a, b) with the named prefixes of both, as a_1, b_1 and so on; with sizes, also size_a and size_b."""
    ids = _ends(pairs).distinct()
    known = nodes.select("id", "n_shingles", *prefixes).join(broadcast_if_small(ids), "id", "left_semi")
    for end in ("a", "b"):
        size = [F.col("n_shingles").alias(f"size_{end}")] if sizes else []
        pairs = pairs.join(known.select(F.col("id").alias(end), *size, *[F.col(p).alias(f"{end}_{p[-1]}") for p in prefixes]), end)
    return pairs


def _meets(percent: int) -> F.Column:
    """Whether pairs with the prefixes of both ends pass all three filters."""
    need = F.least(F.lit(SHARED), F.ceil(percent * F.greatest("size_a", "size_b") / 100))
    return (F.size(F.array_intersect("a_1", "b_1")) >= need) & F.arrays_overlap("a_2", "b_2") & F.arrays_overlap("a_3", "b_3")


def _links_within(docs: DataFrame, nodes: DataFrame, grouped: DataFrame, frequent: Broadcast, n: int, percent: int) -> DataFrame:
    """Links (a, b) that join the different labels inside each family of grouped (id, family, label, size).

    A family's most frequent label needs no comparisons inside itself: its members are dealt into blocks on one side, all others
    into blocks on the other; each pair of blocks with different labels is a group of at most about 2 * BLOCK texts, and fewer
    where these are long.
    """
    sizes = grouped.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    split = sizes.groupBy("family").agg(F.count("*").alias("labels"), F.max(F.struct("n", "tokens", "label")).alias("most"), F.sum("n").alias("all"), F.sum("tokens").alias("all_tokens"))
    blocks = lambda rows, tokens: F.greatest(F.ceil(rows / BLOCK), F.ceil(tokens / BLOCK_TOKENS)).cast("int")
    main, rest = blocks(F.col("most.n"), F.col("most.tokens")), blocks(F.col("all") - F.col("most.n"), F.col("all_tokens") - F.col("most.tokens"))
    split = split.filter("labels > 1").select("family", F.col("most.label").alias("main"), main.alias("main_blocks"), rest.alias("rest_blocks"))
    split = materialize(split, "split")
    own = grouped.join(broadcast_if_small(split), "family").withColumn("rest", F.col("label") != F.col("main"))
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("rest_blocks")).otherwise(F.col("main_blocks"))).cast("int"))
    upto = lambda count: F.sequence(F.lit(0), count - 1)
    to_main = F.transform(upto(F.col("main_blocks")), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("left"), F.col("block").alias("right")))
    to_rest = F.transform(upto(F.col("rest_blocks")), lambda i: F.struct(F.lit(1).alias("kind"), F.least(i, F.col("block")).alias("left"), F.greatest(i, F.col("block")).alias("right")))
    from_main = F.transform(upto(F.col("rest_blocks")), lambda i: F.struct(F.lit(0).alias("kind"), F.col("block").alias("left"), i.alias("right")))
    meets = F.when(F.col("rest"), F.concat(to_main, to_rest)).otherwise(from_main)
    dealt = own.select("id", "family", "label", "rest", "block", F.explode(meets).alias("meet"))
    # of a pair of blocks, one is on the left; a block that meets itself is on both sides
    left = F.when(F.col("meet.kind") == 0, ~F.col("rest")).otherwise(F.col("block") == F.col("meet.left"))
    dealt = dealt.withColumn("is_left", left).withColumn("both", (F.col("meet.kind") == 1) & (F.col("meet.left") == F.col("meet.right"))).drop("rest", "block")
    texts = texts_of(docs, nodes, own.select("id"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        ids, labels, found = rows["id"].tolist(), rows["label"].to_numpy(), []
        sets = [tokens_of(t, n) for t in rows["text"]]
        prefixes = [prefixes_of(x, frequent.value, percent)[1] for x in sets]
        if rows["both"].iloc[0]:
            left = right = np.arange(len(ids))
        else:
            left, right = np.flatnonzero(rows["is_left"].to_numpy()), np.flatnonzero(~rows["is_left"].to_numpy())
        if not len(left) or not len(right):
            return pd.DataFrame(found, columns=["a", "b"])
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        larger = np.maximum(sizes[left][:, None], sizes[right][None, :])
        apart = labels[left][:, None] != labels[right][None, :]
        meet = apart & (100 * np.minimum(sizes[left][:, None], sizes[right][None, :]) >= percent * larger)
        for order, least in enumerate((np.minimum(SHARED, -(-percent * larger // 100)), 1, 1)):
            if meet.any():
                meet &= shared_counts([prefixes[i][order] for i in left], [prefixes[i][order] for i in right]) >= least
        root: dict[int, int] = {}

        def of(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        if not meet.any():
            return pd.DataFrame(found, columns=["a", "b"])
        some, other = np.flatnonzero(meet.any(axis=1)), np.flatnonzero(meet.any(axis=0))
        left, right, meet = left[some], right[other], meet[np.ix_(some, other)]
        common = shared_counts([sets[i] for i in left], [sets[i] for i in right])
        similar = meet & (100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common))
        own: dict[int, set[bytes]] = {}
        for x, y in np.argwhere(similar).tolist():
            i, j = int(left[x]), int(right[y])
            a, b = of(int(labels[i])), of(int(labels[j]))
            if a == b:
                continue
            if i not in own:
                own = {i: shingle_set(rows["text"].iloc[i], n)}  # pairs come row by row, so one set is enough
            one, two = own[i], shingle_set(rows["text"].iloc[j], n)
            both = len(one & two)
            if 100 * both >= percent * (len(one) + len(two) - both):
                root[max(a, b)] = min(a, b)
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(found, columns=["a", "b"])

    return dealt.join(texts, "id").groupBy("family", "meet").applyInPandas(compare, "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of token arrays without repeats, left by right, by products of incidence matrices."""
    width, total = 4096, np.zeros((len(left), len(right)), dtype=np.float32)
    sides = [(np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x)) for x in (left, right)]
    tokens = np.intersect1d(*(np.unique(t) for _, t in sides), assume_unique=True)
    placed = []
    for owner, own in sides:
        at = np.minimum(np.searchsorted(tokens, own), max(0, len(tokens) - 1))
        known = tokens[at] == own if len(tokens) else np.zeros(len(own), dtype=bool)
        owner, at = owner[known], at[known]
        by = np.argsort(at, kind="stable")
        placed.append((owner[by], at[by]))
    for low in range(0, len(tokens), width):
        parts = []
        for (owner, at), n in zip(placed, total.shape, strict=True):
            a, b = np.searchsorted(at, [low, low + width])
            m = np.zeros((n, min(width, len(tokens) - low)), dtype=np.float32)
            m[owner[a:b], at[a:b] - low] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total.astype(np.int64)


def classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, node, n_shingles) of docs (doc_id, text), and the nodes (node, members, n_links > 0 as linked, label, min_id, component_id)."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(small_batches(docs), n))
    rows = materialize(signatures(docs, frequent, n, percent), "signatures")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("members"), F.min("doc_id").alias("min_id"),
        F.first(F.struct("text_key", "n_shingles", "firsts", "prefix_1", "sketch_0", "prefix_2", "prefix_3")).alias("s"),
    )
    # ids are given once, as the nodes are stored
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("id"), "node", "members", "min_id", "s.*"), "nodes")

    # kin: nodes whose sketches overlap well with that of a leader of a group of equal smallest hashes
    firsts = nodes.select("id", F.col("n_shingles").alias("size"), F.posexplode("firsts").alias("order", "token"))
    leaders = firsts.groupBy("order", "token").agg(F.count("*").alias("n"), F.array_distinct(F.array(F.min("id"), F.max("id"), F.min_by("id", "size"), F.max_by("id", "size"))).alias("leaders")).filter("n > 1")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    stars = firsts.withColumn("salt", salt).join(leaders, ["order", "token", "salt"]).select("id", F.explode("leaders").alias("leader")).filter("id <> leader")
    stars = materialize(stars.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), "stars")
    shared = F.size(F.array_intersect("a_0", "b_0"))
    kin = materialize(_with_prefixes(stars, nodes, ("sketch_0",)).filter(100 * shared >= KIN_PERCENT * F.least(F.size("a_0"), F.size("b_0"))).select("a", "b"), "kin")
    families = components(kin)
    wide = _with_prefixes(kin, nodes, ("prefix_1", "prefix_2", "prefix_3"), sizes=True)
    close = materialize(wide.filter(_similar_sizes("size_a", "size_b", percent) & _meets(percent)).select("a", "b"), "close")
    near = materialize(verified(close, texts_of(docs, nodes, _ends(close)), n, percent), "near")
    labels = components(near)

    # within families, nodes of different components meet in blocks
    grouped = materialize(nodes.select("id", F.col("n_shingles").alias("size"), "text_key").join(families.withColumnRenamed("label", "family"), "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "families")
    found = materialize(_links_within(docs, nodes, grouped, frequent, n, percent), "within")
    if not found.isEmpty():
        near = near.union(found)
        labels = components(near)

    # across families, prefixes must share so many tokens under the first order, and some under each of the others
    slim = nodes.select("id", F.col("n_shingles").alias("size"), "prefix_1").join(broadcast_if_small(families), "id", "left").withColumn("family", F.coalesce("label", "id"))
    held = slim.select(F.explode("prefix_1").alias("token"), "id", "size", "family")
    mixed = materialize(held.groupBy("token").agg(F.min("family").alias("low"), F.max("family").alias("high")).filter("low <> high").select("token"), "mixed")
    held = materialize(held.join(broadcast_if_small(mixed), "token", "left_semi"), "held")
    other = held.select("token", F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("family").alias("family_b"))
    met = held.join(other, (held["token"] == other["token"]) & (held["id"] < other["b"]) & (held["family"] != other["family_b"]) & _similar_sizes("size", "size_b", percent))
    met = met.groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("shared"), F.max(F.greatest("size", "size_b")).alias("size"))
    met = materialize(met.filter(F.col("shared") >= F.least(F.lit(SHARED), F.ceil(percent * F.col("size") / 100))).select("a", "b"), "met")
    met = _with_prefixes(met, nodes, ("prefix_2", "prefix_3")).filter(F.arrays_overlap("a_2", "b_2") & F.arrays_overlap("a_3", "b_3")).select("a", "b")
    met = materialize(met, "candidates")
    more = materialize(verified(met, texts_of(docs, nodes, _ends(met)), n, percent), "more")
    if not more.isEmpty():
        labels = components(near.union(more))
    named = nodes.select("id", "node", "members", "min_id").join(broadcast_if_small(labels), "id", "left")
    named = named.withColumn("linked", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", "id"))
    lowest = named.filter("linked").groupBy("label").agg(F.min("min_id").alias("low"))
    named = named.join(broadcast_if_small(lowest), "label", "left").withColumn("component_id", F.when(F.col("linked"), F.col("low")).otherwise(F.col("min_id")))
    return rows.select("doc_id", "text_key", "node", "n_shingles"), materialize(named.drop("low"), "named")


def _grouped(named: DataFrame) -> DataFrame:
    """The nodes that stand for more than one row, with a broadcast hint if they are few."""
    own = named.filter("linked OR members > 1")
    return broadcast_if_small(own)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, named = classes(table(spark, sf_dir, "documents", "doc_id", "text"), 4, 85)
    known = rows.join(_grouped(named.select("node", "component_id", "linked", "members")), "node", "left")
    return known.select("doc_id", "n_shingles", F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component: the smallest doc_id's (nulls last), of the smallest text digest if several.

    Rows without words are linked with nothing and all stay. All columns of docs are kept.
    """
    rows, named = classes(docs.select("doc_id", "text"), n, percent)
    grouped = _grouped(named.select("node", "label", "linked", "members"))
    ranked = rows.join(grouped, "node").select("label", "node", "text_key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key").alias("rank"))
    chosen = ranked.groupBy("label").agg(F.min("rank").alias("rank")).select(F.col("rank.doc_id").alias("id"), F.col("rank.text_key").alias("text_key"))
    chosen = materialize(chosen.withColumn("chosen", F.lit(True)), "chosen")
    members = materialize(ranked.select("text_key").distinct().withColumn("grouped", F.lit(True)), "members")
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("id"), text_key().alias("text_key"))
    own = own.join(broadcast_if_small(members), "text_key", "left")
    small = broadcast_if_small(chosen.withColumnRenamed("text_key", "key"))
    own = own.join(small, own["id"].eqNullSafe(small["id"]) & (own["text_key"] == small["key"]), "left")
    alone = own.filter("grouped IS NULL").select("doc.*")
    # rows of one id and text differ in other columns at most: the first in the order of their JSON stands for all
    kept = own.filter("grouped AND chosen").groupBy("text_key").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc.*")
    return alone.unionByName(kept)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT row_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT row_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT row_id, count(*) AS n FROM shingles GROUP BY row_id),
common AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.row_id < b.row_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.row_id = a JOIN sizes y ON y.row_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT row_id, row_id FROM words UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM words w LEFT JOIN sizes USING (row_id) JOIN reach r ON r.a = w.row_id JOIN words o ON o.row_id = r.b GROUP BY w.row_id, w.doc_id, n
"""
