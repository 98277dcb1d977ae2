import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lendflow.llm import license_scan, near_dedup
from lendflow.llm.components import connected_components
from tests.llm.conftest import frame

FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text, width, lower=True):
    raw = (text or "").encode()
    w = (raw.translate(FOLD) if lower else raw).split()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width, percent):
    sets = {(d, t or ""): shingles(t, width) for d, t, *_ in rows if d is not None}
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    items = list(sets.items())
    for i, ((a, _), x) in enumerate(items):
        for (b, _), y in items[:i]:
            if x and y and len(x & y) * 100 >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    out = Counter()
    for d, t, *_ in rows:
        n = len(shingles(t, width))
        c = d if d is None or not n else find(d)
        out[d, n, c, d == c] += 1
    return out


def run(df, **kw):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(df, **kw).collect())


@pytest.mark.parametrize("width,threshold", [(3, 0.85), (5, 0.8), (1, 0.5)])
def test_corpus(docs, corpus, width, threshold):
    assert run(docs, width=width, threshold=threshold) == brute(corpus, width, round(100 * threshold))


def test_blocks_agree(docs, corpus):
    assert run(docs, block_rows=4) == brute(corpus, 5, 80)
    assert run(docs, block_bytes=2000) == brute(corpus, 5, 80)


def test_null_ids_and_empty(no_ids, corpus, empty):
    assert run(no_ids) == brute(corpus + [(None, *r[1:]) for r in corpus[:8]], 5, 80)
    assert not run(empty)


def test_cloud_of_near_copies(spark):
    """Copies that are near the original but hardly near each other, and exact copies of some."""
    rnd = random.Random(5)
    base = ["b%d" % i for i in range(200)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rnd.randrange(14)):
            w[rnd.randrange(200)] = "x%d" % rnd.randrange(10 ** 6)
        rows.append((rnd.randrange(10 ** 5) * 1000 + i, " ".join(w), None, None))
    rows += [(10 ** 9 + i, rows[i % 5][1].replace(" ", "\n"), None, None) for i in range(300)]
    assert run(frame(spark, rows), width=3, threshold=0.85, block_rows=50) == brute(rows, 3, 85)


def test_estimate_is_near_the_similarity():
    rnd = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.85, 0.95):
        both = rnd.integers(0, 2 ** 63, int(2000 * share)).astype(np.uint64)
        rest = [rnd.integers(0, 2 ** 63, (2000 - len(both)) // 2).astype(np.uint64) for _ in range(2)]
        h = [np.unique(np.concatenate([both, x])) for x in rest]
        at = np.cumsum([0, len(h[0]), len(h[1])])
        regs = near_dedup.densified(near_dedup.registers(np.concatenate(h), at, 512))
        got = near_dedup.estimate(regs[0], regs[1:], len(h[0]), np.array([len(h[1])]))[0]
        assert abs(got - share) < 5 * math.sqrt(share * (1 - share) / 512) + 0.01


def test_registers_keep_zeros_and_mantissa_of_the_least():
    h = np.arange(1, 4000, dtype=np.uint64)
    regs = near_dedup.registers(h, np.array([0, len(h)]), 16)[0]
    g = near_dedup.mix64(h ^ np.uint64(0xD6E8FEB86659FD93)).tolist()
    least = {}
    for x in g:
        b = (x >> 32) * 16 >> 32
        least[b] = min(least.get(b, 1 << 32), x & 0xFFFFFFFF)
    for b, v in least.items():
        zeros = 32 - v.bit_length()
        assert regs[b] == (zeros << 10) | (((v << zeros) & 0x7FFFFFFF) >> 21)


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    edges += [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    label = {}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = start
                todo += near[x]
    df = spark.createDataFrame(edges + [(None, 4)], "a long, b long")
    assert {r.id: r.component for r in connected_components(df).collect()} == label
    assert connected_components(df.where("a < 0")).collect() == []


# --- licenses ----------------------------------------------------------------------------------------
LETTERS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words5(text):
    w = LETTERS.findall(text or "")
    w = [x.encode().translate(FOLD) for x in w]
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_licenses(rows, notices):
    out = Counter()
    for d, t, *_ in rows:
        s = words5(t)
        for key, body in notices:
            own = set(words5(body))
            if not own:
                continue
            reach = 1 << (len(own) - 1).bit_length()
            at = [i for i, x in enumerate(s) if x in own]
            best = max((len({s[j] for j in at if i <= j < i + reach}) for i in at), default=0)
            if best and best >= math.ceil(round(0.8 * len(own), 9)):
                out[d, key, len(own), best] += 1
    return out


def test_license_scan(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(150):
        filler = ["f%d" % rnd.randrange(3000) for _ in range(rnd.randrange(200))]
        body = rnd.choice(license_scan.NOTICES)[1].split()
        for _ in range(rnd.randrange(5)):                 # some notices are altered, some beyond a match
            body[rnd.randrange(len(body))] = "altered"
        cut = rnd.randrange(len(filler) + 1)
        text = " ".join(filler[:cut] + (body if i % 3 else []) + filler[cut:])
        rows.append((i, text.upper() if i % 7 == 0 else text, None, None))
    rows += [(500, None, None, None), (501, "", None, None), (None, license_scan.NOTICES[0][1], None, None), rows[1],
             (502, "\n".join(b for _, b in license_scan.NOTICES), None, None)]
    got = license_scan.scan(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.template, r.template_shingles, r.matched) for r in got) == brute_licenses(
        rows, license_scan.NOTICES)
    assert {r.template for r in got} == {k for k, _ in license_scan.NOTICES}
    for r in got:
        assert r.containment == r.matched / r.template_shingles and 0 <= r.start_word < r.end_word


def test_license_short_templates_passes_and_empty(spark, docs, empty, monkeypatch):
    assert license_scan.scan(empty).collect() == []
    assert license_scan.scan(docs, notices=()).collect() == []
    assert license_scan.scan(docs, notices=[("none", " .,")]).collect() == []
    notices = [("short", "All rights, reserved"), ("long", "a b c d e f g h")]
    rows = [(1, "all RIGHTS reserved!", None, None), (2, "x all rights reserved", None, None), (3, "z a b c d e f g h", None, None)]
    monkeypatch.setattr(license_scan, "PASS_TEMPLATES", 1)
    got = license_scan.scan(frame(spark, rows), notices)
    assert sorted((r.doc_id, r.template) for r in got.collect()) == [(1, "short"), (3, "long")]


def test_bands_guarantee():
    for block in (1, 2, 4, 8, 16, 64, 256):
        for m in range(block // 2 + 1, block + 1):
            hit = license_scan.needed(m)
            jaccard = hit / (license_scan.window_shingles(block) + m - hit)
            assert (1 - jaccard) ** license_scan.bands(block) <= license_scan.MISS * 1.0001
