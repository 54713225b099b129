"""Range numbers against a plain search."""

import bisect

from ratemill.operators import correlate as C


def test_range_numbers_by_halving(spark):
    cuts = [float(i) for i in range(0, 2 * C.QUANTILES, 2)]
    values = [-1.0, 0.0, 1.0, 2.0, 1021.0, 1022.0, 2 * C.QUANTILES - 2.0, 2 * C.QUANTILES + 5.0]
    for some in (cuts, cuts[:1], cuts[:700]):
        df = spark.createDataFrame([(some, v) for v in values], "cuts array<double>, v double")
        found = {r["v"]: r["n"] for r in df.select("v", C.range_number("cuts", "v").alias("n")).collect()}
        assert found == {v: 2 * bisect.bisect_left(some, v) + (v in some) for v in values}
