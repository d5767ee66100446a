"""K-mers of long and odd texts against plain ones."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strandlake.functions import sequence as S


def _plain(text, k):
    return [(i, text[i : i + k]) for i in range(len(text) - k + 1) if set(text[i : i + k]) <= set("ACGT")]


def test_kmers_of_long_and_odd_texts(spark, monkeypatch):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ACGTACGTACGTN") for _ in range(n)) for n in (0, 1, 6, 7, 8, 63, 64, 65, 200, 5000)] + [None, "ACGTéACGTACGT", "acgtACGTACG", "ACGT\U0001f600ACGTACGTAA"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    key = lambda x: sum("ACGT".index(b) * 4 ** (len(x) - 1 - j) for j, b in enumerate(x))
    for k in (1, 3, 7, 16):
        want = sorted((i, p, key(x)) for i, t in enumerate(texts) for p, x in _plain(t or "", k))
        assert sorted(map(tuple, S.kmer_rows(df, "seq", k).select("id", "pos", "kmer").collect())) == want
        assert dict(map(tuple, S.kmer_counts(df, "seq", k).collect())) == Counter(x for _, _, x in want)
        for window in (1, 16, 100):
            monkeypatch.setattr(S, "WINDOW", window)
            assert sorted(x for w in S._windows(texts, k) for x in zip(*map(list, w), strict=True)) == want


def test_kmers_of_one_long_text_in_time_that_grows_with_it(spark):
    # each k-mer was looked for from the text's beginning: 2e11 steps here
    text = "".join(random.Random(7).choice("ACGT") for _ in range(600_000))
    df = spark.createDataFrame([(1, text)], "id int, seq string")
    assert S.kmer_counts(df, "seq", 7).agg(F.sum("n")).first()[0] == len(text) - 6
