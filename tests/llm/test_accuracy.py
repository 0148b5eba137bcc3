"""Held-out accuracy of the classifiers on the driver's tables."""

import os
import zlib

import pytest

from gridregimes.llm import queries

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def auc(scores):
    good, bad = ([s for s, y in scores if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("name", "label", "parts", "left_out", "least"), [("op1_quality", "quality", 4, 2, 0.98), ("op3_toxicity", "toxic", 3, 1, 0.93)])
def test_held_out(spark, name, label, parts, left_out, least):
    rows = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == left_out) for r in rows)
    held = [r for r in rows if r.held_out]
    assert auc([(r.score, r[label]) for r in held]) >= least
    assert sum(r.predicted == r[label] for r in held) >= 0.9 * len(held)
    assert not [r for r in held if label == "toxic" and r.predicted and not r.toxic]
