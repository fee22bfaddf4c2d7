"""The fit of quality_rules reads all labelled rows."""

import zlib
from collections import defaultdict

import numpy as np
import zstandard

from lucerna.llm import quality_rules


def test_fit_takes_every_labelled_text(spark):
    """More good texts than the 40,000 that were once read; the limits are exact quantiles of all of them."""
    n = 60_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat_ws(' ', md5(cast(id as string)), repeat(md5(cast(id % 977 as string)), cast(id % 7 as int))) as text")
    labels = docs.selectExpr("doc_id", "1 as quality")
    rows = quality_rules.training_rows(docs, labels)
    z, held = zstandard.ZstdCompressor(level=3), defaultdict(list)
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            held[quality_rules.band_of(len(r.text))].append(len(r.text) / len(z.compress(r.text.encode())))
    assert rows.count() == sum(map(len, held.values())) > 47_000
    limits = quality_rules.fit(rows)
    for band, found in held.items():
        assert np.isclose(limits.bands[band][1], np.quantile(found, 0.998), rtol=1e-12)


def test_fit_of_few_or_no_rows_is_the_default(spark):
    few = spark.createDataFrame([(3, 1.0 + k / 100) for k in range(19)], "band int, ratio double")
    assert quality_rules.fit(few) == quality_rules.fit(few.limit(0)) == quality_rules.LIMITS
