import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lendflow.llm import toxicity
from tests.llm.conftest import frame


def enumerate_chain(emit, moves):
    """Marginals by summing over all state sequences; the state before the first word is clean."""
    total, toxic = 0.0, np.zeros(len(emit))
    for states in itertools.product((0, 1), repeat=len(emit)):
        weight, last = 0.0, 0
        for e, s in zip(emit, states, strict=True):
            weight += moves[last, s] + e * s
            last = s
        total += np.exp(weight)
        toxic += np.exp(weight) * np.array(states)
    return toxic / total


def test_marginals_by_enumeration(monkeypatch):
    rnd = np.random.default_rng(0)
    for chunk in (1, 2, 3, 5, 64):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        for _ in range(6):
            lengths = rnd.integers(0, 9, 5)
            emit, moves = rnd.normal(0, 2, lengths.sum()), rnd.normal(0, 1, (2, 2))
            first = np.concatenate([[0], np.cumsum(lengths)])
            got = toxicity.marginals(emit, first, moves)
            for a, b in zip(first[:-1], first[1:], strict=True):
                assert np.allclose(got[a:b], enumerate_chain(emit[a:b], moves))


def test_long_chain_stays_finite():
    emit = np.tile([30.0, -30.0, 5.0], 40_000)
    p = toxicity.marginals(emit, np.array([0, len(emit)]), np.array([[0.0, -8.0], [-8.0, 8.0]]))
    assert np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all()


def labelled(n=900, seed=1):
    rnd = random.Random(seed)
    words, bad = ["w%d" % i for i in range(700)], ["vile", "rotten", "grubx%s"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = [rnd.choice(words) for _ in range(rnd.randrange(5, 120))], i % 5 == 0
        if toxic:
            for _ in range(2):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad).replace("%s", rnd.choice("abcdefg") * 2).upper() + ",")
        rows.append((i, " ".join(text), None, None))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = labelled()
    df = spark.createDataFrame(labels + [(None, 1), (3, None), (10 ** 6, 1)], "doc_id long, toxic int")
    return toxicity.fit(frame(spark, rows), df)


def test_held_out_documents_and_spans(spark, model):
    rows, labels = labelled()
    truth = dict(labels)
    got = toxicity.score(frame(spark, rows), model, out="p", spans="found").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and sum((r.p >= 0.5) == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in got:
        for s in r.found:
            word = r.text.encode()[s.start:s.end].decode()
            assert word.isalnum() and s.marginal >= 0.5
    hits = [r.text.encode()[s.start:s.end].decode().lower()[:4] for r in got for s in r.found]
    assert sum(h in ("vile", "rott", "grub") for h in hits) >= 0.95 * len(hits) and len(hits) > 200


def test_fold(spark):
    df = spark.createDataFrame([(i,) for i in range(-3, 50)], "doc_id long")
    for r in df.select("doc_id", toxicity.fold(F.col("doc_id")).alias("f")).collect():
        assert r.f == zlib.crc32(str(r.doc_id).encode()) % 5


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rows, labels = labelled()
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    schema = "doc_id long, toxic int"
    a = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, schema))
    b = toxicity.fit(frame(spark, rows), spark.createDataFrame(flipped, schema))
    assert (a.weights == b.weights).all() and a.slope == b.slope and a.offset == b.offset


def test_odd_rows(docs, no_ids, corpus, empty, model):
    for df, n in ((docs, len(corpus)), (no_ids, len(corpus) + 8), (empty, 0)):
        got = toxicity.score(df, model, out="p").collect()
        assert len(got) == n and all(0 <= r.p <= 1 for r in got)
    low = {r.text: r.p for r in toxicity.score(docs, model, out="p").collect()}
    assert low[None] == low[""] < 0.5
    assert toxicity.score(docs, model, out="p").columns == [*docs.columns, "p"]
    with pytest.raises(ValueError):
        toxicity.score(docs, model, out="score")


def test_without_labels(spark, docs, empty):
    schema = "doc_id long, toxic int"
    none = toxicity.fit(docs, spark.createDataFrame([], schema))
    clean = toxicity.fit(docs, spark.createDataFrame([(i, 0) for i in range(100)], schema))
    toxic = toxicity.fit(docs, spark.createDataFrame([(i, 1) for i in range(100)], schema))
    for m, want in ((none, 0.0), (clean, 0.0), (toxic, 1.0)):
        assert {r.p for r in toxicity.score(docs, m, out="p").collect()} == {want}
    assert toxicity.fit(empty, spark.createDataFrame([(1, 1)], schema)).constant == 0.0


def test_a_long_text_costs_the_sample_only_itself(spark):
    rows, labels = labelled()
    schema, budget = "doc_id long, toxic int", 600_000
    want = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, schema))
    ids = spark.range(10 ** 6, 10 ** 6 + 4000).where(toxicity.fold(F.col("id")) != 0)
    first = ids.orderBy(F.xxhash64("id")).first().id       # before the other ids in the order of the hash
    for y in (0, 1):
        more = spark.createDataFrame([*labels, (first, y)], schema)
        got = toxicity.fit(frame(spark, [*rows, (first, "long " * budget, None, None)]), more, sample_bytes=budget)
        assert got.constant is None and (got.weights == want.weights).all()


def test_both_classes_labelled_but_no_sample_is_an_error(spark):
    rows, labels = labelled(60)
    df = spark.createDataFrame(labels, "doc_id long, toxic int")
    with pytest.raises(ValueError, match="both classes"):
        toxicity.fit(frame(spark, rows), df, sample_bytes=10)
    with pytest.raises(ValueError, match="both classes"):
        toxicity.fit(frame(spark, [(d + 10 ** 6, t, None, None) for d, t, *_ in rows]), df)


def test_only_near_copies_leave_the_sample():
    rnd = random.Random(4)
    words = ["w%d" % i for i in range(5000)]
    notice, rows = [rnd.choice(words) for _ in range(30)], [None, "", None]
    for i in range(120):
        text = [rnd.choice(words) for _ in range(70)] + notice                  # one notice in all
        rows.append(" ".join(text))
        if i % 4 == 0:
            text[rnd.randrange(5, 60)] = "changed"                              # 91 of 101 shingles in common
            rows.append(" ".join(text).upper())
        if i % 4 == 1:
            for k in range(3, 70, 8):
                text[k] = "changed%d" % k
            rows.append(" ".join(text))
    sets = [{tuple((r or "").lower().split()[i:i + 5]) for i in range(len((r or "").split()) - 4)} for r in rows]
    want, kept = [], []
    for s in sets:
        want.append(not s or not any(len(s & k) >= 0.8 * len(s | k) for k in kept))
        if s and want[-1]:
            kept.append(s)
    got = toxicity.distinct_rows(pa.table({"body": pa.array(rows)}))
    assert got.tolist() == want and sum(want) == 3 + 120 + 30
    assert not len(toxicity.distinct_rows(pa.table({"body": pa.array([], type=pa.string())})))
