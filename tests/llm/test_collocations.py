import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from conftest import SF01
from lendflow.llm import collocations
from lendflow.llm.oracle import SQL
from lendflow.llm.queries import op12_collocations
from lendflow.plans.check import compare, duck_connection

from .conftest import frame

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, most, top):
    """Every phrase counted, every cut tried, every longer candidate looked at."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and a >= f[p[i:j]]}
        ranked = []
        for p, a in found.items():
            if p in held:
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                        for k in range(1, len(p)))
            ranked.append((score, a, " ".join(p), left, right))
        ranked.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, total[lang], score)
                for i, (score, a, p, left, right) in enumerate(ranked[:top])]
    return sorted(out)


def table(seed, texts=120):
    """Skewed words, set phrases, pieces, odd white space, three languages and none."""
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(40)] + ["É", "A", "b\x1c"]
    phrases = ["new york city", "of the", "x y z u v w", "The End", "a a a", "of"]
    rows = []
    for i in range(texts):
        parts = []
        for _ in range(rnd.randrange(0, 60)):
            parts.append(rnd.choice(phrases) if rnd.random() < 0.4 else words[int(40 * rnd.random() ** 3)])
            parts.append(rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b"]))
        rows.append((i, "".join(parts), [None, "en", "fr", "und", "en"][i % 5], None))
    return rows + [(900, None, "en", None), (901, "", "de", None), (902, " .\n", None, None)] + rows[:3]


def mined(spark, rows, **options):
    got = collocations.mine(frame(spark, rows).repartition(3), **options)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed, least, most, top", [(1, 5, 5, 2000), (2, 3, 5, 10), (3, 4, 4, 3), (4, 10, 2, 7)])
def test_equals_brute_force(spark, seed, least, most, top):
    rows = table(seed)
    assert mined(spark, rows, least=least, most=most, top=top) == brute([r[1:3] for r in rows], least, most, top)


def test_rounds_do_not_change_the_answer(spark):
    rows = table(5)
    want = brute([r[1:3] for r in rows], 4, 5, 6)
    for shares in ((1.0,), (0.01, 0.05, 0.2, 0.5, 1.0)):
        assert mined(spark, rows, least=4, top=6, shares=shares) == want


def test_bounds_prune_common_first_words(spark, monkeypatch):
    """A first word too common for the list is never expanded."""
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["the", "the", "the", "of"]) if rnd.random() < 0.7 else rnd.choice(
        ["p q r", "s t", "u v", "m o"]) for _ in range(80)), "en", None) for i in range(100)]
    opened, plain = [], collocations._expanded

    def spy(codes, words, front, least, most):
        opened.append({r.word for r in words.join(front, ["lang", "key"], "left_semi").collect()})
        return plain(codes, words, front, least, most)
    monkeypatch.setattr(collocations, "_expanded", spy)
    got = mined(spark, rows, least=20, top=3, shares=(0.2, 1.0))
    assert got == brute([r[1:3] for r in rows], 20, 5, 3)
    assert "the" not in set().union(*opened)


def test_ties_at_the_end_of_the_list(spark):
    rows = [(i, ". ".join(f"{a}{k} {b}{k}" for k in range(6) for a, b in (("x", "y"),)), "en", None) for i in range(5)]
    for top in (1, 3, 6):
        assert mined(spark, rows, least=5, top=top) == brute([r[1:3] for r in rows], 5, 5, top)


def test_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(3 * 10**12 + 1, 9 * 10**15 + 7, 3 * 10**12 + 5, 10**6 + 3)], "a long, n long, l long, r long")
    a, n, left, right = big.first()
    assert big.selectExpr(collocations.SCORE).first()[0] == 1000 * a * n // (left * right)


def test_empty_tables_and_clashing_names(spark, docs, empty, corpus):
    assert collocations.mine(empty).collect() == []
    assert mined(spark, [(1, None, None, None), (2, "a b", "en", None)]) == []
    named = docs.drop("score").withColumnRenamed("text", "words.f").withColumnRenamed("lang", "score")
    got = collocations.mine(named, text="words.f", lang="score", least=3)
    assert sorted(tuple(r) for r in got.collect()) == brute([r[1:3] for r in corpus], 3, 5, 2000)


def test_codes_stand_in_short_rows(spark):
    """A long text has many rows, cut between its pieces: a batch of them stays small, and the answer is the same."""
    rnd = random.Random(11)
    def prose(pieces):
        return ". ".join(" ".join(rnd.choice("a b c d e rare%d" % rnd.randrange(10**6)) if rnd.random() < 0.1 else rnd.choice("abcde")
                                  for _ in range(rnd.randrange(1, 12))) for _ in range(pieces))
    rows = [(1, prose(3000), "en", None), (2, prose(2), "fr", None), (3, "a", "en", None), (4, prose(900), None, None)]
    docs = frame(spark, rows).selectExpr("coalesce(lang, 'und') AS lang", "text AS body").coalesce(1)
    words = collocations.word_counts(docs).where("f >= 20")
    codes = [(r.lang, r.codes) for r in collocations.coded(docs, collocations.Members.of(words)).collect()]
    assert all(c[0] == 0 and len(c) <= collocations.ROW_CODES + 24 for _, c in codes)
    assert {x for x, _ in codes} == {"en", "und"}               # the French text has no frequent word
    occurrences = Counter((lang, key) for lang, c in codes for key in c if key)
    assert {k: f for k, f in occurrences.items() if f >= 20} == {(r.lang, r.key): r.f for r in words.collect()}
    assert mined(spark, rows, least=20, top=50) == brute([r[1:3] for r in rows], 20, 5, 50)


def test_query_equals_its_sql(spark):
    r = compare(spark, SF01, "op12_collocations", op12_collocations, SQL["op12_collocations"], duck_connection(SF01))
    assert r["status"] == "ok", r


def test_rows_leave_a_task_by_small_batches():
    rows = 2 * collocations.OUT_ROWS + 5
    batches = [pa.RecordBatch.from_pydict({"key": list(range(lo, hi)), "codes": [[k] for k in range(lo, hi)]})
               for lo, hi in ((0, rows), (rows, rows + 1), (rows + 1, rows + 1))]
    out = list(collocations._handed_on(iter(batches)))
    assert max(b.num_rows for b in out) == collocations.OUT_ROWS
    assert [r for b in out for r in b.to_pylist()] == [{"key": k, "codes": [k]} for k in range(rows + 1)]


def test_slices_of_a_task_are_summed_before_they_leave_it():
    rng, want, batches = random.Random(3), Counter(), []
    for _ in range(60):
        rows = Counter((rng.choice([None, "en", "de"]), rng.randint(0, 40)) for _ in range(50))
        want.update(rows)
        batches.append(pa.RecordBatch.from_pydict({"lang": [k[0] for k in rows], "key": [k[1] for k in rows],
                                                   "f": list(rows.values())}))
    for most, at_most in ((1, 60 * 50), (200, 60 * 50 // 2), (10_000, len(want))):
        out, got = list(collocations._summed(iter(batches), most)), Counter()
        assert all(b.schema == batches[0].schema for b in out) and sum(b.num_rows for b in out) <= at_most
        for b in out:
            for r in b.to_pylist():
                got[r["lang"], r["key"]] += r["f"]
        assert got == want
    assert list(collocations._summed(iter([]))) == []
    empty = batches[0].slice(0, 0)
    assert sum(b.num_rows for b in collocations._summed(iter([empty, empty]))) == 0
