"""Texts reach Python in batches that the operators bound by bytes."""

import pandas as pd

from strandlake import storage
from strandlake.llm import quality, suffix_dedup


def test_texts_reach_python_in_small_batches(spark):
    limit = storage._BATCH_LIMIT
    own = spark.conf.get(limit, None)
    texts = spark.range(8000, numPartitions=1).selectExpr("id AS doc_id", "repeat('some text ', 300) AS text")

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["text"].str.len().sum())]})

    try:
        for operator in (suffix_dedup.repeated_runs, quality.keep_good):
            spark.conf.unset(limit)
            operator(texts.limit(3))
            found = [r.n for r in texts.mapInPandas(sizes, "n long").collect()]
            assert sum(found) == 8000 * 3000 and max(found) <= storage.BATCH_BYTES + 3000
        # a session's own limit stays
        spark.conf.set(limit, "9m")
        storage.small_batches(texts)
        assert spark.conf.get(limit) == "9m"
    finally:
        spark.conf.set(limit, own) if own else spark.conf.unset(limit)
