import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadweave.operators import evaluation, reports, tables


@pytest.mark.parametrize("buckets", [2, 5, 200])
def test_percentiles_by_selection(spark, buckets):
    """Groups of one row, of one value, with a third of equal values, of nulls alone; a null group."""
    r = np.random.default_rng(3)
    rows = [("a", float(x)) for x in r.normal(size=301).round(2)] + [("a", 0.5)] * 150 + [("b", 7.0)] + [(None, 2.0)] * 9 + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    ps = {f"p{k}": k / 100 for k in (0, 10, 50, 99, 100)}
    got = {x.g: x for x in tables.percentiles_of(df, ["g"], "v", {n: tables.share(p) for n, p in ps.items()}, buckets).collect()}
    assert set(got) == {"a", "b", None}
    for g in got:
        values = [v for x, v in rows if x == g]
        assert got[g].n == len(values)
        assert [got[g][n] for n in ps] == pytest.approx([np.quantile(values, p) for p in ps.values()])
    one = tables.percentiles_of(df.drop("g"), [], "v", {"mid": tables.share(0.5)}, buckets).collect()
    assert len(one) == 1 and one[0].mid == pytest.approx(np.median([v for _, v in rows if v is not None]))
    exact = df.where("g IS NOT NULL").groupBy("g").agg(F.percentile("v", F.lit(0.37)).alias("p")).where("p IS NOT NULL")
    assert {x.g: x.p for x in exact.collect()} == pytest.approx({x.g: x.p for x in tables.percentiles_of(df, ["g"], "v", {"p": tables.share(0.37)}, buckets).where("g IS NOT NULL").collect()})


def test_running_counts(spark):
    rows = [(k % 3 or None, float(k * 7 % 11)) for k in range(200)] + [(1, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for by in ([], ["g"]):
        for r in tables.running_counts(df, by, "v", 4).collect():
            mine = [v for g, v in rows if v is not None and (not by or g == r.g)]
            assert (r.n, r.before) == (mine.count(r.v), sum(v < r.v for v in mine))


def test_no_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    assert evaluation.percentiles(df.where("g = 'a'"), ["g"], "v").count() == 0
    assert {(r.g, r.n, r.p50) for r in reports.profile(df, ["g"], "v", (0.5,)).collect()} == {("a", 0, None), ("b", 1, 1.0)}
    assert [r.bin for r in evaluation.binned(spark.createDataFrame([(0.0,), (-1.0,)], "v double"), "v").collect()] == ["zero", "zero"]
    with pytest.raises(Exception, match="not above 0"):
        reports.positive_percentile(df.where("g = 'a'"), "v", 0.9).collect()
    assert math.isclose(reports.positive_percentile(df, "v", 0.9).first().top, 1.0)
