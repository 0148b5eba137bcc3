"""The pipeline's stages on small tables, against brute force."""

import random
import re

import pytest

import corpus_pipeline

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    good = [" ".join(rng.choices(words, k=rng.randint(20, 90))) + "." for _ in range(60)]
    bad = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in rng.choices(words, k=40)) for _ in range(40)]
    near = [" ".join([*g.split()[:-1], "other."]) for g in good[:8] if len(g.split()) > 60]
    item = " ".join(rng.choices(words, k=14))
    leaked = [f"{good[40 + i]} {item} {good[50 + i]}" for i in range(3)]
    texts = [*good, *bad, *good[:5], *(g.upper() for g in good[5:8]), *near, *leaked]
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, NAMES).repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}", texts, item


def test_stages(spark, made):
    folder, texts, item = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept[name] = sorted(r.doc_id for r in out.collect())
        docs = spark.createDataFrame(out.collect(), NAMES)
    assert not [i for i in kept["quality"] if re.search(r"[#$%]", texts[i])]
    assert len([i for i in kept["quality"] if i < 60]) >= 57
    groups = {}
    for i in kept["quality"]:
        groups[texts[i].lower()] = max(i, groups.get(texts[i].lower(), -1))
    assert kept["exact_dedup"] == sorted(groups.values())

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    root = {i: i for i in kept["exact_dedup"]}

    def find(x):
        return x if root[x] == x else find(root[x])

    sets = {i: shingles(texts[i]) for i in root}
    for a in root:
        for b in root:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert kept["near_dedup"] == sorted({find(i) for i in root})
    assert kept["decontamination"] == [i for i in kept["near_dedup"] if item not in texts[i].lower()]
    packed = corpus_pipeline.pack(spark, docs, folder)
    assert sorted({r.doc_id for r in packed.collect()}) == kept["decontamination"]


def test_run(spark, made):
    folder, texts, _ = made
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"] and 20 < out.select("doc_id").distinct().count() <= 60


def test_stages_on_nulls_and_no_rows(spark, made):
    folder, *_ = made
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0)], NAMES)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert name == "packing" or out.columns == docs.columns
            out.collect()


def test_stages_on_repeated_rows_null_ids_and_clashing_columns(spark, made):
    folder, texts, item = made
    long = max(texts[:60], key=len)
    near = " ".join([*long.split()[:-1], "changed."])
    rows = [(5, long), (5, long), (None, long), (9, near), (9, near), (None, near), (3, ""), (None, None), (None, item), (4, f"x {item} y")]
    more = {c: "x" for c in ("row", "id", "sha", "own", "found", "node", "key")}
    docs = spark.createDataFrame([(i, t, "en", "s", 0, *more.values()) for i, t in rows], NAMES + "".join(f", {c} string" for c in more))

    def run(stage):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {tuple(r[c] for c in more) for r in out.collect()} <= {tuple(more.values())}
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    good = run(corpus_pipeline.keep_quality)
    assert all((good.count(r) == rows.count(r)) for r in good)
    assert run(corpus_pipeline.drop_copies) == sorted([(5, long), (9, near), (3, ""), (None, item), (4, f"x {item} y")], key=str)
    assert run(corpus_pipeline.drop_near_copies) == sorted([r for r in rows if r[0] != 9], key=str)
    assert run(corpus_pipeline.drop_benchmark) == sorted([r for r in rows if item not in (r[1] or "")], key=str)
    packed = corpus_pipeline.pack(spark, docs, folder).select("doc_id", "start", "doc_tokens").where("start = 0").collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(str(i) for i, _ in rows) and sorted(r.doc_tokens for r in packed)[:2] == [1, 1]
