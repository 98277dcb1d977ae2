import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import EXTRA, frame
from tests.llm.test_exact_and_mixing import expected_groups, norm
from tests.llm.test_near_and_license import brute
from tests.llm.test_toxicity import labelled


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A fixture with toxic documents, exact and near copies, and repeated ids."""
    rnd = random.Random(4)
    rows, labels = labelled(400, 3)
    rows = [(d, t, "en", ["a", "b", None][d % 3]) for d, t, *_ in rows]
    clean = [r for r in rows if r[0] % 5]
    for i, r in enumerate(clean[:40]):
        rows.append((1000 + i, r[1].replace(" ", "\t"), "en", "a"))
    for i, r in enumerate(c for c in clean if len(c[1].split()) > 60):
        w = r[1].split()
        w[rnd.randrange(len(w))] = "changed"
        rows.append((2000 + i, " ".join(w), "en", "b"))
    rows += [(5000, None, None, None), (5001, "", "en", "a"), (None, "without an id " * 9, "en", "a")]
    path = tmp_path_factory.mktemp("pipeline")
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 0, y) for d, y in labels], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return str(path)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in EXTRA})
    rows = {r.doc_id: r for r in docs.collect()}

    kept = stage("toxicity")(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert {r.doc_id for r in left} >= {d for d, r in rows.items() if not re.search("(?i)vile|rotten|grubx", r.text or "")}
    assert sum(bool(re.search("(?i)vile|rotten|grubx", r.text or "")) for r in left) <= 4

    once = stage("exact_dedup")(spark, kept, sf_dir)
    assert once.columns == docs.columns
    want = expected_groups([(r.doc_id, r.text) for r in left])
    assert sorted(map(str, (r.doc_id for r in once.collect()))) == sorted(
        str(r.doc_id) for r in left if want[norm(r.text)][0] == r.doc_id)

    apart = stage("near_dedup")(spark, once, sf_dir)
    assert apart.columns == docs.columns
    rows_in = [(r.doc_id, r.text) for r in once.collect()]
    assert sorted(str(r.doc_id) for r in apart.collect()) == sorted(
        str(d) for (d, _, _, keep), n in brute(rows_in, 5, 80).items() if keep for _ in range(n))

    mixed = stage("mixing")(spark, apart, sf_dir)
    assert mixed.columns == docs.columns
    from lendflow.llm import mixing
    copies = {r.doc_id: r.copies for r in mixing.mix(apart).collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in copies.items() if n}

    packed = stage("packing")(spark, mixed, sf_dir)
    assert packed.where("start = 0").count() == mixed.count()


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 100 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)


def test_empty_tables(spark, tmp_path):
    frame(spark, [], extra=False).withColumn("n_chars", F.lit(0).cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_stage_keeps_columns_with_dots(spark, corpus):
    docs = frame(spark, corpus, extra=False).withColumn("x.y", F.lit(1))
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
