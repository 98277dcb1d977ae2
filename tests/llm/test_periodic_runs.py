import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from conftest import SF001
from lendflow.llm import periodic_runs
from lendflow.llm.queries import op11_periodic_runs

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    border = [0] * len(w)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def brute_runs(w, least=24, periods=3):
    """Every run, straight from its definition: for each q the maximal stretches of period q."""
    found = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, periods * q) and smallest_period(w[i:i + length]) == q:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = set()
    for s, n, q in runs:
        gone.update(range(s + q, s + n))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in
           ("".join("%d,%d,%d\n" % r for r in runs), brute_collapsed(w, runs))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def cyclic_texts(seed, count):
    rnd = random.Random(seed)
    out = []
    for _ in range(count):
        w = []
        for _ in range(rnd.randrange(1, 5)):
            letters = "abc"[:rnd.randrange(1, 4)]
            w += [rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 9))]
            w += ([rnd.choice(letters) for _ in range(rnd.randrange(1, 23))] * rnd.randrange(1, 12))[:rnd.randrange(1, 150)]
        out.append(" ".join(w))
    return out


FIBONACCI = ["a", "ab"]
while len(FIBONACCI[-1]) < 400:
    FIBONACCI.append(FIBONACCI[-1] + FIBONACCI[-2])

SPECIAL = [None, "", " \t\n", "one", "x " * 23, "x " * 24, "x " * 1000, "a b " * 11 + "a", "a b " * 12,
           "a b c d e f g h i " * 2 + "a b c d e f g h", "a b c d e f g h i " * 3, "x\n" * 30 + "y " + "x\t" * 30,
           "é ß " * 20, "a a b " * 40 + "a b b " * 40, " ".join(FIBONACCI[-1]),
           ("p q r s t " * 30 + "z ") * 4, "Ab ab " * 20]


@pytest.mark.parametrize("least, periods", [(24, 3), (6, 3), (5, 4)])
def test_runs_equal_the_definition(spark, least, periods):
    texts = SPECIAL + cyclic_texts(least, 150)
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    docs = frame(spark, rows).repartition(3)
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs, least=least, periods=periods).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        runs = brute_runs(w, least, periods)
        assert [tuple(r) for r in got[i].runs] == runs, t
        assert got[i].collapsed == brute_collapsed(w, runs)
        assert got[i].n_words == len(w)


def test_query_equals_brute_force(spark):
    got = op11_periodic_runs(spark, SF001)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(brute_row(*r) for r in docs)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(r[1] > 0 for r in want) > 3


def test_digests_over_small_rows(spark, tmp_path):
    """The query's digests over cyclic, empty, repeated and null rows."""
    texts = SPECIAL + cyclic_texts(1, 120)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += rows[-1:] + [(None, "x " * 40, None, None)]
    frame(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(r[0], r[1]) for r in rows), key=repr)


def test_empty_table_repeated_rows_and_clashing_names(spark, docs, empty, no_ids, corpus):
    assert periodic_runs.find_runs(empty).collect() == []
    assert periodic_runs.with_cycles(empty).collect() == []
    got = periodic_runs.find_runs(no_ids).collect()
    assert len(got) == no_ids.count()
    named = docs.withColumnRenamed("text", "runs.text").withColumnRenamed("doc_id", "collapsed")
    again = periodic_runs.find_runs(named, text="runs.text", doc_id="collapsed").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, periodic_runs.find_runs(docs).collect()))
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, periods=2)


def test_long_text_beside_short_ones(spark):
    rnd = random.Random(3)
    block = [str(rnd.randrange(10**6)) for _ in range(50_000)]
    w = block * 4 + [str(rnd.randrange(10**6)) for _ in range(20_000)] + ["z"] * 100
    rows = [(1, " ".join(w), None, None), (2, "q " * 30, None, None), (3, " ".join(block), None, None)]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.find_runs(frame(spark, rows)).collect()}
    assert got == {1: [(0, 200_000, 50_000), (220_000, 100, 1)], 2: [(0, 30, 1)], 3: []}
