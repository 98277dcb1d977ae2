import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lendflow.llm import exact_dedup, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    return {body: (min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0], len(g))
            for body, g in groups.items()}


def check_exact(df, rows, **kw):
    want = expected_groups(rows)
    got = exact_dedup.exact_dedup(df, **kw).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == Counter(
        (d, *want[norm(t)], d == want[norm(t)][0], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t, *_ in rows)
    return got


def test_exact(docs, corpus):
    check_exact(docs, corpus)


def test_exact_null_ids(no_ids, corpus):
    check_exact(no_ids, corpus + [(None, *r[1:]) for r in corpus[:8]])


def test_small_buckets_split(docs, corpus):
    got = check_exact(docs, corpus, capacity=2, max_depth=8)
    assert len({r.bucket for r in got}) > 8


def test_directory_splits_only_overfull_buckets(spark):
    # 3 bits: prefix 0 holds 5 entries, prefix 1 one, prefixes 4 to 7 one each.
    entries = spark.createDataFrame([(0,)] * 5 + [(1,), (4,), (5,), (6,), (7,)], "prefix int")
    got = {r.prefix: (r.depth, r.bucket) for r in exact_dedup.directory(entries, 4, 3).collect()}
    assert got == {0: (3, 0), 1: (3, 1), 4: (1, 4), 5: (1, 4), 6: (1, 4), 7: (1, 4)}


def test_extreme_ids(spark):
    rows = [(-2 ** 63, "a b", None, None), (2 ** 63 - 1, "ab", None, None), (None, "a  b ", None, None),
            (None, "zz", None, None), (0, "q", None, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    check_exact(df, rows)


def test_chained_keys_are_told_apart(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []
    assert exact_dedup.keep_one(empty).collect() == []


def test_keep_one_gives_whole_rows(docs, corpus):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    want = expected_groups(corpus)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        (d, t) for d, t, *_ in corpus if want[norm(t)][0] == d)


# --- mixing ------------------------------------------------------------------------------------------
def water_fill(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def check_mix(df, rows, **kw):
    got = mixing.mix(df, **kw).collect()
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(
        (r[0], r[3], n) for r, n in zip(rows, size, strict=True))
    sizes = Counter()
    for r, n in zip(rows, size, strict=True):
        sizes[r[3]] += n
    target = water_fill(sizes, kw.get("weights", mixing.WEIGHTS), kw.get("share", 1.5), 2)
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert sum(taken.values()) <= sum(target.values()) + 1e-6
    for s, t in target.items():
        assert taken[s] < t + longest[s] and taken[s] > t - max(longest.values())
    return sorted((repr(r) for r in got))


def test_mix(docs, corpus):
    assert check_mix(docs, corpus) == check_mix(docs, corpus)


def test_mix_does_not_depend_on_layout_or_buckets(docs, corpus):
    one = check_mix(docs, corpus)
    assert check_mix(docs.repartition(7), corpus, per_bucket=2) == one
    assert check_mix(docs.coalesce(1), corpus, per_bucket=10 ** 6) == one


def test_mix_other_weights_and_null_ids(no_ids, corpus):
    check_mix(no_ids, corpus + [(None, *r[1:]) for r in corpus[:8]], weights=(1, 5), share=0.4)


def test_mix_serves_in_proportion(spark):
    rows = [(i, "a " * 10, None, "x" if i % 3 else "y") for i in range(600)]
    df = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, source string")
    got = check_mix(df, [(d, t, None, s) for d, t, _, s in rows], weights=(1, 1), share=0.3)
    assert len(got) == 600


def test_mix_empty(empty):
    assert mixing.mix(empty).collect() == []
