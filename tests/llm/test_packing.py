import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lendflow.llm import packing


def reference_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.vocabulary_path(packing.TOKENIZER))
    return [np.array(x.ids + [1], dtype="<u4") for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(got, rows, length):
    wanted = sorted((d, len(i), i.tobytes()) for (d, *_), i in zip(rows, reference_ids([r[1] for r in rows]), strict=True))
    pieces = defaultdict(list)
    for r in got:
        assert 1 <= r.length <= length
        pieces[r.doc_id, r.doc_tokens].append(r)
    count = defaultdict(int)
    for d, n, _ in wanted:
        count[d, n] += 1
    assert set(pieces) == set(count)
    crc = defaultdict(set)
    for d, n, body in wanted:
        for at in range(0, n, length):
            piece = body[4 * at:4 * (at + length)]
            crc[d, n].add((at, len(piece) // 4, zlib.crc32(piece)))
    for key, rows_ in pieces.items():
        assert {(r.start, r.length, r.ids_crc32) for r in rows_} == crc[key]
        assert len(rows_) == sum(-(-key[1] // length) for _ in range(count[key]))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return sequences


def test_pack_documents(docs, corpus):
    got = packing.pack_documents(docs).collect()
    sequences = check(got, corpus, 2048)
    total = sum(r.length for r in got)
    assert len(sequences) <= total / 2048 * 1.2 + 1


def test_short_sequences_and_small_groups(docs, corpus):
    check(packing.pack_documents(docs, length=64, per_group=5).collect(), corpus, 64)


def test_without_ranks_the_same(docs):
    path = packing.vocabulary_path(packing.TOKENIZER)
    a = packing.encode(docs).collect()
    b = packing.encode(docs, tokenizer=path).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("text", [" " * 300_000 + "a", "a" * 100_000, "1​" * 20_000, "<|endoftext|>" * 3])
def test_odd_texts_by_both_ways(text):
    path, ranks = packing.vocabulary_path(packing.TOKENIZER), packing.vocabulary_path(packing.RANKS)
    assert packing.Encoder.of(path, ranks).ids(text).tolist() == packing.Encoder.of(path, None).ids(text).tolist()


def test_first_fit_decreasing_is_first_fit():
    rnd = random.Random(3)
    for _ in range(50):
        sizes = np.array(sorted((rnd.randint(1, 50) for _ in range(rnd.randint(1, 80))), reverse=True))
        where, offset = packing.first_fit_decreasing(sizes, 50)
        room = []
        for size, w, o in zip(sizes.tolist(), where.tolist(), offset.tolist(), strict=True):
            at = next((i for i, r in enumerate(room) if r >= size), len(room))
            if at == len(room):
                room.append(50)
            assert (w, o) == (at, 50 - room[at])
            room[at] -= size


def test_sequences_hold_the_ids(docs, corpus):
    packed = packing.pack(packing.encode(docs, length=128, with_ids=True), 128)
    rows = packing.sequences(packed, 128, pad_id=7).collect()
    assert sum(r.n_ids for r in rows) == sum(map(len, reference_ids([r[1] for r in corpus])))
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == (r.n_ids if r.n_ids & (r.n_ids - 1) == 0 else 128)
        assert (ids[r.n_ids:] == 7).all()


def test_null_ids_and_empty(no_ids, empty):
    got = packing.pack_documents(no_ids).collect()
    assert sum(r.doc_id is None for r in got) >= 8
    assert packing.pack_documents(empty).collect() == []
