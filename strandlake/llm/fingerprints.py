"""Operator 13, document fingerprints by one-permutation MinHash, in DataFrame functions alone.

A text's five-word shingles (fewer words: the whole sequence as one) are hashed once; the top bits of a hash name its bin
and a bin keeps its smallest hash. An empty bin takes over the value of a filled one, drawn by hashes of the empty bin alone
(optimal densification): draws go on until a filled bin is met, after PROBES of them the filled bin of the smallest joint
hash is taken. The fingerprint packs the BITS low-order bits of all bins; likeness corrects the share of equal bins for
values that agree by chance.

Defined cases: a null text is empty; a text without words has the empty fingerprint, alike to another of its kind (1) and to
nothing else (0); equal texts have equal fingerprints; rows of one doc_id follow each other by text, equal rows are
interchangeable; null ids come last in descending order; the next document of the last is the first, of a single one itself;
no table, no rows; other columns are left out. Doc_ids are whole numbers. Rows of one id lie in one range, sorted on disk where
they outgrow memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, table

SHINGLE = 5
#: What parts words besides the space.
SPACES = "\t\n\x0b\x0c\r"
#: Bins, and the low-order bits kept of each; sixteen values of four bits fill a whole number.
BINS, BITS = 256, 4
PROBES = 16
#: Bytes of text in a range of doc_ids, about; ranges follow at most so many quantiles, beyond which each is cut evenly.
RANGE_BYTES, QUANTILES = 8 << 20, 256

_PER_LONG = 64 // BITS
_REST = 64 - (BINS.bit_length() - 1)
_MASK = (1 << _REST) - 1
#: The largest hash of every bin, in the order of signed numbers; a shingle that hashes to it (2**-56) counts as none.
_LAST = [(b << _REST) + _MASK for b in range(-BINS // 2, BINS // 2)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, within a higher-order function too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; plain replacements and one split take two thirds of a regular expression's time."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n)))


def bins(hashes: Column) -> Column:
    """The low-order bits of each bin's smallest hash, null for an empty bin."""
    every = F.sort_array(F.concat(hashes, F.lit(_LAST).cast("array<bigint>")))

    def own(x: Column) -> Column:
        return F.shiftright(x, _REST)

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (own(x) != own(F.get(s, i - 1))))

    low = F.lit((1 << BITS) - 1).cast("bigint")
    rest = F.lit(_MASK).cast("bigint")
    return F.transform(let(every, smallest), lambda x: F.when(x.bitwiseAND(rest) != rest, x.bitwiseAND(low)))


def densify(sparse: Column) -> Column:
    """bins without nulls; at least one must be filled."""
    mask = F.lit(BINS - 1).cast("bigint")

    def dense(values: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(values, j).isNotNull())

        def value(v: Column, i: Column, filled: Column) -> Column:
            draws = [F.get(values, F.xxhash64(i, F.lit(a)).bitwiseAND(mask).cast("int")) for a in range(PROBES)]
            least = F.array_min(F.transform(filled, lambda j: F.xxhash64(i, j).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(j.cast("bigint"))))
            return F.coalesce(v, *draws, F.get(values, least.bitwiseAND(mask).cast("int")))

        return let(filled, lambda f: F.transform(values, lambda v, i: value(v, i, f)))

    return let(sparse, dense)


def pack(dense: Column) -> Column:
    """The bins as an array of whole numbers, the first bin highest."""
    places = F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1))
    one = lambda g: F.aggregate(F.slice(dense, g * _PER_LONG + 1, _PER_LONG), F.lit(0).cast("bigint"), lambda s, v: F.shiftleft(s, BITS).bitwiseOR(v))
    return F.transform(places, one)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text, an empty array for one without words."""
    packed = lambda w: let(densify(bins(shingle_hashes(w))), pack)
    return let(words(text), lambda w: F.when(F.size(w) > 0, packed(w)).otherwise(F.array().cast("array<bigint>")))


def as_text(packed: Column) -> Column:
    """The fingerprint in hexadecimal digits, one a bin."""
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity behind two fingerprints: (share of equal bins - 2**-BITS) / (1 - 2**-BITS), 0 at least."""
    lowest = F.lit(sum(1 << (BITS * k) for k in range(_PER_LONG))).cast("bigint")

    def different(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        any_bit = bits
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(bits, k))
        return F.bit_count(any_bit.bitwiseAND(lowest))

    unequal = F.aggregate(F.zip_with(a, b, different), F.lit(0), lambda s, x: s + x)
    chance = 1 / 2**BITS
    corrected = F.greatest(F.lit(0.0), (1 - unequal / BINS - chance) / (1 - chance))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), corrected).otherwise((F.size(a) == F.size(b)).cast("double"))


def _cells(ids: DataFrame, n: int, key: str = "doc_id") -> Column | None:
    """A whole number that doesn't fall as the key grows, about n of them; null keys come below all. None without a key."""
    quantiles = min(n, QUANTILES)
    pieces = -(-n // quantiles)
    found = ids.agg(F.percentile_approx(key, [k / quantiles for k in range(quantiles)], 100 * QUANTILES), F.min(key), F.max(key)).first()
    if found[1] is None:
        return None
    low = sorted({found[1], *found[0]})
    high = [*low[1:], found[2] + 1]
    at = F.size(F.filter(F.lit(low).cast("array<bigint>"), lambda b: b <= F.col(key))) - 1
    first, end = (F.get(F.lit(side).cast("array<bigint>"), at) for side in (low, high))
    inner = F.least(F.lit(pieces - 1).cast("bigint"), F.floor((F.col(key) - first) / ((end - first) / pieces)).cast("bigint")) if pieces > 1 else F.lit(0).cast("bigint")
    return F.when(F.col(key).isNull(), F.lit(-1).cast("bigint")).otherwise(at * pieces + inner)


def with_next(rows: DataFrame, ids: DataFrame, n_ranges: int, *carried: str) -> DataFrame:
    """rows (doc_id, ...) with `next_<c>` for each carried column: its value in the next row by descending doc_id, of the last the first's.

    Rows are sorted within ranges of doc_ids; the largest id of a range, one row each, says which rows also go to the range before.
    ids holds the doc_ids alone, cheap to read again.
    """
    cell = _cells(ids, n_ranges)
    cell = F.lit(-1).cast("bigint") if cell is None else cell
    largest = ids.groupBy(cell.alias("cell")).agg(F.max("doc_id").alias("head"))
    by_cell = Window.orderBy("cell")
    # the range above takes the rows of this one's largest id; the lowest range takes those of the highest one
    above = F.coalesce(F.lead("cell").over(by_cell), F.min("cell").over(Window.partitionBy()))
    heads = largest.select("head", above.alias("guest_of"))
    met = rows.withColumn("cell", cell).join(broadcast_if_small(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left").drop("head")
    own = F.struct(F.col("cell").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("guest_of").alias("range"), F.lit(True).alias("guest"))
    places = F.when(F.col("guest_of").isNull(), F.array(own)).otherwise(F.array(own, guest))
    dealt = met.withColumn("place", F.explode(places)).select("*", "place.*").drop("place", "cell", "guest_of")
    down = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    found = dealt.withColumns({f"next_{x}": F.lead(x).over(down) for x in carried})
    return found.filter(~F.col("guest")).drop("range", "guest")


def compare_next(docs: DataFrame) -> DataFrame:
    """From (doc_id, text): fingerprints of the texts, of the edited texts and how alike they and neighbours are."""
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    rows = docs.select("doc_id", text.alias("text"), fingerprint(text).alias("print"))
    followed = with_next(rows, docs.select("doc_id"), max(1, size // RANGE_BYTES), "text", "print")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    told = followed.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    told = told.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "print", "next_print", fingerprint(F.col("edited")).alias("edited_print"))
    return told.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents", "doc_id", "text"))
