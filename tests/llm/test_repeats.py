import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from lendflow.llm import anchors, substring_dedup, suffix_dedup
from tests.llm.conftest import frame

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, span, words):
    """Per row (id, n, removed, spans, digest), every row of an id as the same document."""
    seen, out = {}, {}
    for d, t in sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}):
        body = t.encode()
        unit = WORD.findall(body) if words else body
        gone, own = np.zeros(len(unit), dtype=bool), {}
        for i in range(len(unit) - span + 1):
            s = tuple(unit[i:i + span]) if words else unit[i:i + span]
            if s in seen or (not words and s in own):
                gone[i:i + span] = True
            own[s] = True
        seen.update(own)
        kept = b" ".join(w for w, g in zip(unit, gone, strict=True) if not g) if words else bytes(
            b for b, g in zip(body, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d, t] = (len(unit), int(gone.sum()), *(() if words else (runs,)), hashlib.sha256(kept).hexdigest())
    for r in rows:
        if r[0] is None:
            unit = WORD.findall((r[1] or "").encode()) if words else (r[1] or "").encode()
            kept = b" ".join(unit) if words else unit
            out[None, r[1] or ""] = (len(unit), 0, *(() if words else (0,)), hashlib.sha256(kept).hexdigest())
    return Counter((r[0], *out[r[0], r[1] or ""]) for r in rows)


def run(df, words, **kw):
    fn = substring_dedup.remove_repeated_words if words else suffix_dedup.remove_repeated_bytes
    return Counter(tuple(r) for r in fn(df, **kw).collect())


@pytest.mark.parametrize("words", [True, False])
def test_corpus(docs, corpus, words):
    assert run(docs, words) == brute(corpus, 50 if words else 100, words)


@pytest.mark.parametrize("words", [True, False])
def test_short_spans_and_shards(docs, corpus, words):
    span, width = (5, 2) if words else (12, 5)
    assert run(docs, words, span=span, width=width, shard_bytes=3000) == brute(corpus, span, words)


@pytest.mark.parametrize("words", [True, False])
def test_null_ids(no_ids, corpus, words):
    rows = corpus + [(None, *r[1:]) for r in corpus[:8]]
    assert run(no_ids, words) == brute(rows, 50 if words else 100, words)


@pytest.mark.parametrize("words", [True, False])
def test_empty(empty, words):
    assert not run(empty, words)


@pytest.mark.parametrize("words", [True, False])
def test_random_overlaps(spark, words):
    rnd = random.Random(11)
    pool = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [pool[rnd.randrange(6)][rnd.randrange(20):rnd.randrange(40, 80)] for _ in range(rnd.randint(0, 4))]
        rows.append((rnd.randrange(10 ** 6) * 100 + i, " ".join(parts), None, None))
    span, width = (8, 3) if words else (15, 6)
    assert run(frame(spark, rows).repartition(5), words, span=span, width=width) == brute(rows, span, words)


def test_one_id_two_texts_do_not_mix(spark):
    a, b = "abcdefghij" * 20, "klmnopqrst" * 20
    rows = [(1, a, None, None), (2, a, None, None), (2, b, None, None)]
    got = suffix_dedup.remove_repeated_bytes(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 200, 190), (2, 200, 190), (2, 200, 200)]


def test_hot_passage(spark):
    rnd = random.Random(2)
    passage = " ".join("p%d" % i for i in range(80))
    rows = [(i, " ".join("u%d" % rnd.randrange(10 ** 9) for _ in range(10)) + " " + passage + " tail%d" % i, None, None)
            for i in range(900)]
    assert run(frame(spark, rows), True) == brute(rows, 50, True)
    assert run(frame(spark, rows), False) == brute(rows, 100, False)


@pytest.mark.parametrize("words", [True, False])
def test_contexts_of_a_hot_gram_do_not_meet_in_one_task(spark, words):
    rnd = random.Random(3)
    passage, sides = " ".join("p%d" % i for i in range(80)), ["s%d t%d u%d" % (i, i, i) for i in range(5)]
    rows = [(i, " ".join("u%d" % rnd.randrange(10 ** 9) for _ in range(40)) + " " + rnd.choice(sides) + " " + passage + " "
             + rnd.choice(sides) + " tail%d " % i + ("" if i % 7 else passage), None, None) for i in range(500)]
    span, width, most = (50, 12, 20_000) if words else (100, 40, 8_000)
    module = substring_dedup if words else suffix_dedup

    def search(doc, place, bodies):
        assert sum(map(len, bodies)) < 4 * most
        return module.repeats(doc, place, bodies, span)
    scheme = anchors.Scheme(span, width, words, substring_dedup.word_codes if words else suffix_dedup.byte_codes)
    finish = substring_dedup.Words() if words else suffix_dedup.Bytes()
    named = frame(spark, rows).select("doc_id", F.col("text").alias("body"))
    marked = anchors.marked_documents(named, scheme, finish)
    _, hot = anchors.context_bytes(marked.where("checks is not null"), finish, most)
    got = anchors.removed(marked, scheme, search, finish, most)
    assert len(hot) and Counter(tuple(r) for r in got.collect()) == brute(rows, span, words)


# --- the parts ---------------------------------------------------------------------------------------
def test_induced_order_and_common_prefixes():
    rnd = np.random.default_rng(0)
    for _ in range(150):
        depth, sigma = int(rnd.integers(3, 12)), int(rnd.integers(1, 4))
        text = np.concatenate([rnd.integers(1, sigma + 1, int(rnd.integers(1, 120))), [0]]).astype(np.int16)
        order = suffix_dedup.Induction(text, sigma + 1, depth, budget=int(rnd.integers(0, 500)))   # 0: all on disk
        got = [(int(a), int(n)) for at, lcp in order.blocks() for a, n in zip(at, lcp, strict=True)]
        assert sorted(a for a, _ in got) == list(range(len(text)))
        t = text.tolist()
        for (a, _), (b, n) in zip(got, got[1:], strict=False):
            assert t[a:a + depth] >= t[b:b + depth]
            same = 0
            while same < depth and t[a + same:a + same + 1] == t[b + same:b + same + 1] != []:
                same += 1
            assert same == n


def test_index_finds_all_occurrences():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        sigma, length = int(rnd.integers(2, 9)), int(rnd.integers(1, 6))
        text = np.append(rnd.integers(1, sigma, int(rnd.integers(length, 200))), 0)
        index = substring_dedup.Index(text, sigma, length)
        end = np.arange(length, len(text))
        matched, low, high = index.search(text, end, length)
        t = text.tolist()
        for e, m, a, b in zip(end.tolist(), matched.tolist(), low.tolist(), high.tolist(), strict=True):
            want = [i for i in range(len(t)) if t[i:i + m] == t[e - m:e]]
            assert sorted(index.order[a:b].tolist()) == want and (m == length or len(want) == 1)


def test_groups_are_found_block_by_block(monkeypatch):
    rnd = random.Random(5)
    bodies = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(6, 60))) for _ in range(40)] + [b"a" * 50]
    doc, place, seen, want = np.arange(len(bodies)), np.zeros(len(bodies), np.int64), set(), set()
    for d, body in enumerate(bodies):
        for i in range(len(body) - 5):
            if body[i:i + 6] in seen:
                want.add((d, i, i + 6))
            seen.add(body[i:i + 6])
    sizes, groups = [], suffix_dedup.whole_groups

    def spied(blocks, span):
        for at, group in groups(blocks, span):
            sizes.append((len(at), int(np.bincount(group).max())))
            yield at, group
    monkeypatch.setattr(suffix_dedup, "whole_groups", spied)
    for block in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        sizes.clear()
        got = list(zip(*(x.tolist() for x in suffix_dedup.repeats(doc, place, bodies, 6)), strict=True))
        assert len(got) == len(set(got)) and set(got) == want
        assert sum(n for n, _ in sizes) == sum(map(len, bodies)) + len(bodies) + 1
        assert len(sizes) > 20 or block > 7
