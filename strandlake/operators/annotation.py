"""Which special reference a read belongs to: seed regions choose the place, an alignment there decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import pairwise
from strandlake.functions.sequence import kmer_rows, reverse_complement
from strandlake.operators.evidence import seed_regions
from strandlake.storage import broadcast_if_small, dealt_by_work, materialize

c = F.col
#: A two_bit_key holds so many bases at most.
_KEY = 31


def best_cover_pairs(regions: DataFrame) -> DataFrame:
    """(query, begin, length, other_begin, other_length, cover): of each query the two regions (query, begin, length, ...) that cover most of it together.

    Regions go by begin, then end; two of them cover min(both lengths, from the first's begin to the second's end). Of equal covers the earliest first
    region counts, then the latest second one. Each region finds its best earlier one by running maxima over a sorted sweep, so no pairs are made:
    of those that end before it the longest, of those that reach it the one that begins first.
    """
    rank = F.row_number().over(Window.partitionBy("query").orderBy("begin", "length"))
    own = regions.filter("length > 0").select("query", "begin", "length", rank.alias("k"))
    at = F.explode(F.array(F.struct(c("begin").alias("at"), F.lit(0).alias("told")), F.struct((c("begin") + c("length") - 1).alias("at"), F.lit(1).alias("told")))).alias("e")
    events = own.select("query", "begin", "length", "k", at).select("query", "begin", "length", "k", "e.*")
    so_far = Window.partitionBy("query").rowsBetween(Window.unboundedPreceding, 0)
    longest = F.max(F.when(c("told") == 1, F.struct("length", (-c("k")).alias("k"), "begin"))).over(so_far.orderBy("at", "told"))
    earliest = F.min(F.when(c("told") == 1, F.struct("begin", "k", "length"))).over(so_far.orderBy(F.desc("at"), F.desc("told")))
    met = events.withColumns({"apart": longest, "across": earliest}).filter("told = 0")
    pair = lambda k, first, length, cover: F.struct(cover.alias("cover"), (-k).alias("first"), c("k").alias("second"), first.alias("begin"), length.alias("length"), c("begin").alias("other_begin"), c("length").alias("other_length"))
    apart = F.when(c("apart").isNotNull(), pair(-c("apart.k"), c("apart.begin"), c("apart.length"), c("apart.length") + c("length")))
    across = F.when(c("across.k") < c("k"), pair(c("across.k"), c("across.begin"), c("across.length"), c("begin") + c("length") - c("across.begin")))
    found = met.select("query", F.greatest(apart, across).alias("p")).filter("p IS NOT NULL").groupBy("query").agg(F.max("p").alias("p"))
    return found.select("query", "p.begin", "p.length", "p.other_begin", "p.other_length", "p.cover")


def special_hits(reads: DataFrame, library: DataFrame, k: int = 7, least: int = 20, required: int = 50) -> DataFrame:
    """(id, ref_id, turned, score, begin, length): the special reference of each read (id, read) that has one in library (ref_id, seq).

    On either strand the longest run of k-mer hits, the first by reference and place if several, must have `least` bases; the read is aligned to that
    reference's part within a read's length of it and must score as `required` matches do. The read's own strand goes first. A library beyond what is
    broadcast is joined by shuffles. A run of k-mer hits with `least` bases is an equal stretch of both, so it is looked for by its longer k-mers, of which
    few are shared by chance. Alignments are dealt into tasks by cells.
    """
    least = max(k, least)
    k = min(least, _KEY)
    strands = F.explode(F.array(F.struct(F.lit(False).alias("turned"), c("read").alias("seq")), F.struct(F.lit(True).alias("turned"), reverse_complement(c("read")).alias("seq")))).alias("s")
    both = reads.select("id", strands).select("id", "s.*")
    seeds = kmer_rows(library.select(c("ref_id").alias("ref"), "seq"), "seq", k).withColumnRenamed("pos", "ref_pos")
    asked = kmer_rows(both, "seq", k).select(F.struct("id", "turned").alias("query"), c("pos").alias("query_pos"), "kmer")
    hits = asked.join(broadcast_if_small(seeds), "kmer").select("query", "ref", "query_pos", "ref_pos")
    row = F.struct((-c("length")).alias("n"), "ref", "ref_begin", "begin")
    best = seed_regions(hits, k, least).groupBy("query").agg(F.min(row).alias("b")).select("query.*", "b.*")
    placed = best.join(both, ["id", "turned"]).join(broadcast_if_small(library.select(c("ref_id").alias("ref"), c("seq").alias("bases"))), "ref")
    n = F.length("seq")
    low = F.greatest(c("ref_begin") - n, F.lit(0))
    part = F.substring(c("bases"), (low + 1).cast("int"), (c("ref_begin") + n - low + 1).cast("int"))
    pairs = materialize(placed.select("id", "turned", "ref", "n", "begin", "seq", part.alias("part")), "placed-reads")
    dealt = dealt_by_work(pairs, pairs.agg(F.sum(F.length("part").cast("double") * n)).first()[0])
    aligned = dealt.withColumn("score", pairwise.local_score(c("part"), c("seq"), never="N")).filter(c("score") >= 2 * required)
    first = F.struct("turned", "ref", "score", "begin", (-c("n")).alias("length"))
    return aligned.groupBy("id").agg(F.min(first).alias("x")).select("id", c("x.ref").alias("ref_id"), "x.turned", "x.score", "x.begin", "x.length")
