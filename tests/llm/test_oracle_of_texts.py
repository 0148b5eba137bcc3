"""The text queries that have SQL, against DuckDB on the smallest tables; classifiers against scalar scorers."""

import math
import numbers
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridregimes.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    number = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, numbers.Number) else v  # noqa: E731  a null makes a column of integers one of floats
    plain = lambda df: sorted(str(tuple(map(number, row))) for row in df[cols].itertuples(index=False, name=None))
    assert plain(got.toPandas()) == plain(want)


def test_scores_against_scalar_scorers(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    trees = quality.fit_quality(docs, labels, quality.remainder(F.col("doc_id"), 4) != 2)
    for r in queries.QUERIES["op1_quality"](spark, SF).collect():
        x, margin = np.array(quality.statistics(texts[r.doc_id]), np.float32), trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(x[feature[node]] > threshold[node])
            margin += value[node - len(feature)]
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9) and r.predicted == int(r.score >= 0.7)
    at, weight, bias = toxicity.fit_toxicity(docs, labels, quality.remainder(F.col("doc_id"), 3) != 1)
    weights = dict(zip(at.tolist(), weight.tolist()))
    for r in queries.QUERIES["op3_toxicity"](spark, SF).collect():
        margin = bias + sum(weights.get(p, 0.0) for p in set(toxicity.positions(texts[r.doc_id]).tolist()))
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(max(margin, -35), 35))), abs=1e-9) and r.predicted == int(r.score >= 0.7)
