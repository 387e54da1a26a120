"""The classifier on held-out labels, and the pipeline's stages against the operators' own results."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossloom.llm import decontam, quality, simhash_dedup, stages

SF = "/root/testdata/sf0.01"


def test_logistic_regression_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - 2 * x[:, 1] > 0).astype(float)
    assert ((quality.apply(quality.fit_logistic(x, y), x) > 0) == (y > 0)).mean() > 0.97


def test_co_training_passes_on_and_uses_both_views():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.5).astype(float)
    word = lambda v: np.array([1 if v else 2, *rng.integers(10, 40, 3)])
    sets, meta = [word(v) for v in y], rng.normal(size=(400, 2)) + 3 * y[:, None]
    hidden = (rng.random(300) < 0.5).astype(float)
    head = quality.co_train(sets, meta, y, [word(v) for v in hidden], rng.normal(size=(300, 2)) + 3 * hidden[:, None])
    assert head.passed_on > 50
    assert ((head.probability([word(v) for v in hidden], rng.normal(size=(300, 2)) + 3 * hidden[:, None]) > 0.5) == (hidden > 0)).mean() > 0.98


def slow_logistic(x, y, ridge):
    """Weights that minimise the loss with a ridge penalty, by plain Newton steps; the constant comes last."""
    x = [[*row, 1.0] for row in x]
    d = len(x[0])
    w = [0.0] * d
    for _ in range(25):
        p = [1 / (1 + math.exp(-max(-35.0, min(35.0, sum(a * b for a, b in zip(row, w, strict=True)))))) for row in x]
        pen = [ridge] * (d - 1) + [1e-3]
        grad = [sum(row[j] * (q - t) for row, q, t in zip(x, p, y, strict=True)) + pen[j] * w[j] for j in range(d)]
        hess = [[sum(row[i] * row[j] * q * (1 - q) for row, q in zip(x, p, strict=True)) + (pen[i] if i == j else 0) for j in range(d)] for i in range(d)]
        step = np.linalg.solve(np.array(hess), np.array(grad))
        w = [a - b for a, b in zip(w, step, strict=True)]
        if max(abs(step)) < 1e-6:
            break
    return w


def slow_dot(w, row):
    return sum(a * b for a, b in zip(w, row, strict=False)) + w[-1]


def slow_co_train(sets, meta, y, pool_sets, pool_meta):
    """The classifier by its description, one document at a time: returns a function from (words, meta) to a probability."""
    seen, aside = Counter(), []
    for t in y:
        seen[t] += 1
        aside.append(seen[t] % 4 == 0)
    fit = [i for i in range(len(y)) if not aside[i]]
    held = [i for i in range(len(y)) if aside[i]]
    n, gains = len(fit), {}
    for word in {w for i in fit for w in sets[i]}:
        cells = Counter((word in sets[i], y[i]) for i in fit)
        count = sum(c for (has, _), c in cells.items() if has)
        if quality.LEAST_DOCUMENTS <= count <= n - quality.LEAST_DOCUMENTS:
            ones = sum(y[i] for i in fit)
            margin = lambda has, t: (count if has else n - count) * (ones if t else n - ones)  # noqa: E731, B023
            gains[word] = sum(c / n * math.log(c * n / margin(has, t)) for (has, t), c in cells.items())
    words = sorted(sorted((w for w in gains if gains[w] > 0), key=lambda w: (-gains[w], w))[: quality.TEXT_FEATURES])
    rows = {"text": lambda s, m: [1.0 if w in s else 0.0 for w in words], "meta": lambda s, m: list(m)}
    given = {v: [(rows[v](sets[i], meta[i]), y[i]) for i in fit] for v in rows}
    free = {v: set(range(len(pool_sets))) for v in rows}
    share = sum(y[i] for i in fit) / n
    for k in range(quality.ROUNDS + 1):
        w = {v: slow_logistic([r for r, _ in given[v]], [t for _, t in given[v]], quality.RIDGE) for v in rows}
        if k == quality.ROUNDS:
            break
        for view, other in (("text", "meta"), ("meta", "text")):
            scale = slow_logistic([[slow_dot(w[view], rows[view](sets[i], meta[i]))] for i in held], [y[i] for i in held], 1e-2)
            p = [1 / (1 + math.exp(-slow_dot(scale, [slow_dot(w[view], rows[view](s, m))]))) for s, m in zip(pool_sets, pool_meta, strict=True)]
            for label in (1.0, 0.0):
                sure = [q if label else 1 - q for q in p]
                best = sorted((i for i in free[other] if sure[i] >= quality.SURE), key=lambda i: (-sure[i], i))[: max(1, int(quality.PASSED_ON * (share if label else 1 - share)))]
                free[other] -= set(best)
                given[other] += [(rows[other](pool_sets[i], pool_meta[i]), label) for i in best]
    views = lambda s, m: [slow_dot(w[v], rows[v](s, m)) for v in ("text", "meta")]
    both = slow_logistic([views(sets[i], meta[i]) for i in held], [y[i] for i in held], 1e-1)
    return lambda s, m: 1 / (1 + math.exp(-slow_dot(both, views(s, m))))


def test_co_training_matches_plain_python():
    rng = np.random.default_rng(3)
    made = lambda y: ({1 if rng.random() < 0.2 + 0.6 * y else 2, *map(int, rng.integers(10, 16, 3))}, rng.normal(size=2) + 1.5 * y)
    y = [float(v) for v in rng.random(120) < 0.4]
    known, pool = [made(v) for v in y], [made(float(v)) for v in rng.random(60) < 0.4]
    arrays = lambda rows: ([np.array(sorted(s)) for s, _ in rows], np.array([m for _, m in rows]))
    head = quality.co_train(*arrays(known), np.array(y), *arrays(pool))
    slow = slow_co_train([s for s, _ in known], [m for _, m in known], y, [s for s, _ in pool], [m for _, m in pool])
    assert head.passed_on > 0
    fresh = [made(float(i % 2)) for i in range(50)]
    assert head.probability(*arrays(fresh)) == pytest.approx([slow(s, m) for s, m in fresh], abs=1e-6)


def test_an_id_with_many_rows_counts_once(spark):
    rows = [(i, f"{'bad' if i % 2 else 'good'} text number {i}", "en", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    many = docs.unionByName(spark.createDataFrame([rows[0]] * 500 + [rows[50]] * 500, docs.schema))
    a, b = quality.fit(docs, labels)["quality"], quality.fit(many, labels)["quality"]
    assert (a.both == b.both).all() and (a.text == b.text).all()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = quality.classify(docs, quality.fit(docs, labels.filter(~held))).join(labels.filter(held), "doc_id").select("quality", "toxic", quality.is_kept().alias("kept")).collect()
    clean = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    low = [r.kept for r in got if r.quality == 0]
    assert len(clean) > 50 and sum(clean) / len(clean) > 0.95
    assert len(low) > 5 and sum(low) / len(low) < 0.15


def test_rare_classes_are_fitted(spark):
    docs = spark.createDataFrame([(i, "vile @@## words " * 9 if i % 100 == 0 else f"plain words of kind {i % 7}", "en", "s") for i in range(1000)], "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 100 == 0).cast("int").alias("toxic"))
    for rows in (4000, 100):
        got = quality.classify(docs, quality.fit(docs, labels, rows=rows)).filter(~quality.is_kept())
        assert sorted(r.doc_id for r in got.collect()) == list(range(0, 1000, 100))


def test_without_labels_all_is_kept(spark):
    docs = spark.createDataFrame([(1, "a", None, None, 1), (None, None, "en", "s", None), (3, "x" * 200_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, p int")
    for labels in ([], [(1, None, None), (1, 1, 0)], [(i, 1, 0) for i in range(9)]):
        y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = quality.classify(docs, quality.fit(docs, y), out="q").filter(quality.is_kept("q"))
        assert got.count() == 3 and "p" in got.columns
    assert quality.classify(docs.limit(0), quality.fit(docs.limit(0), y)).count() == 0


@pytest.fixture(scope="module")
def wild(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "en", "a", 1), (4, text, "en", "a", 1), (4, text, "en", "a", 1), (4, "other words altogether", "en", None, 1), (None, None, None, None, None), (None, "", "fr", "b", 0), (9, "some more text of its own", "fr", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_one_of_each_group_stays(spark, wild):
    got = stages.dedup_stage(spark, wild, SF)
    assert got.columns == wild.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("4", wild.first().text), ("4", "other words altogether"), ("None", got.filter("doc_id is null").first().text), ("9", "some more text of its own")])
    assert stages.dedup_stage(spark, wild.limit(0), SF).count() == 0


def test_near_copies_of_the_benchmark_go(spark):
    words = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text.split()
    # no run of 13 words is without an edit
    edited = " ".join("edited" if i % 10 == 5 else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, edited), (2, "some words that are in no item of the benchmark at all, not even nearly so")], "doc_id long, text string")
    assert [r.n_hit for r in decontam.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()] == [0, 0]
    assert [r.doc_id for r in stages.decontamination_stage(spark, docs, SF).collect()] == [2]


def test_passages_in_long_documents_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, long), (None, None)], "doc_id long, text string")
    assert [r.doc_id for r in stages.decontamination_stage(spark, docs, SF).orderBy("doc_id").collect()] == [None, 2]


def test_mixing_repeats_documents(spark, wild):
    rows = stages.mixing_stage(spark, wild, SF)
    assert rows.columns == wild.columns
    n = Counter((r.doc_id, r.text) for r in rows.collect())
    assert all(v <= 2 * (2 if k == (4, wild.first().text) else 1) for k, v in n.items())
    assert (None, None) not in n and (None, "") not in n
    assert sum(len(t.split()) * v for (_, t), v in n.items()) > 100


def test_pipeline_against_its_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        kept[name] = (docs, rows)
        docs = spark.createDataFrame(rows, out.schema)
    before, after = kept["near_dedup"]
    found = simhash_dedup.near_duplicates(before).collect()
    assert sorted(r.doc_id for r in after) == sorted({r.component_id for r in found})
    before, after = kept["decontamination"]
    bad = {r.doc_id for r in decontam.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.n_hit}
    # items have at least 13 words, so any occurrence is one of a whole window
    assert bad and sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before.collect() if r.doc_id not in bad)
    mixed, final = kept["mixing"][1], kept["sharding"][1]
    assert sorted(r.doc_id for r in mixed) == sorted(r.doc_id for r in final)
    shards = {}
    assert all(shards.setdefault(r.doc_id, r.shard) == r.shard for r in final)
    result = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.shard) for r in result.collect()) == sorted((r.doc_id, r.shard) for r in final)


@pytest.mark.parametrize("empty", ["", "labels", "documents labels benchmark"])
def test_pipeline_of_odd_tables(spark, wild, tmp_path, empty):
    tables = {
        "documents": wild,
        "labels": spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, None), (1, ""), (None, "other words altogether")], "item_id long, text string"),
    }
    for name, df in tables.items():
        (df.limit(0) if name in empty.split() else df).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*wild.columns, "shard"]
    texts = {r.text for r in got.collect()}
    # the labels' only class is low quality, which rejects all; without labels all are kept, but for the benchmark's and those without words
    assert texts == ({wild.first().text, "some more text of its own"} if empty == "labels" else set())


def test_long_texts_are_fitted_and_scored(spark):
    rows = [(i, ("plain words and more " if i % 2 else "@@ ## zz ") * (20_000 if i < 4 else 5), "en", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = quality.classify(docs, quality.fit(docs, labels)).filter(quality.is_kept())
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == list(range(1, 40, 2))
