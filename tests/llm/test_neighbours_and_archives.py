import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lendflow.llm import archives, neighbours


def vectors(n=1500, dim=16, seed=0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim)).astype(np.float32)
    x[100:400] = x[100]                                    # one very common vector
    x[400:420] *= 50
    return [(int(i) * 5, [float(v) for v in row]) for i, row in enumerate(x)]


def brute(rows, every, top):
    ok = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
          if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:top]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cell string")


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_all_cells_visited_is_exact(spark):
    rows = vectors()
    odd = [(7, None), (20, []), (40, [0.0] * 16), (60, [float("nan")] * 16), (80, [None] + [1.0] * 15),
           (None, [1.0] * 16), (3, [float("inf")] * 16), (11, [1.0] * 3)]
    keep = [r for r in rows if r[0] not in {20, 40, 60, 80}]
    got = collect(neighbours.search(table(spark, keep + odd), share=1.0, block=200, query_block=20))
    want = brute(keep, 20, 20)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [v for _, v, _ in found] == [v for v, _ in want[q]]
        assert np.allclose([s for _, _, s in found], [s for _, s in want[q]])


def test_recall_with_part_of_the_cells(spark):
    rows = vectors(4000, 32, 1)
    got = collect(neighbours.search(table(spark, rows, "double"), share=0.4, least=1, block=500))
    want = brute(rows, 20, 20)
    hits = sum(len({v for v, _ in want[q]} & {v for _, v, _ in got[q]}) for q in want)
    assert hits >= 0.85 * 20 * len(want)


def test_recall_of_the_registered_settings(spark, tmp_path):
    """20,000 vectors without any clusters, the hardest case: parts of the cells, and tiles of them."""
    x = np.random.default_rng(8).normal(size=(20_000, 32))
    ids = np.arange(len(x))
    pq.write_table(pa.table({"vec_id": ids, "embedding": list(x)}), f"{tmp_path}/embeddings.parquet")
    got = collect(neighbours.search(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), every=100))
    asked = ids[ids % 100 == 0]
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-near, axis=1)[:, :20]
    hits = sum(len(set(w.tolist()) & {v for _, v, _ in got[q]}) for q, w in zip(asked.tolist(), want, strict=True))
    assert hits >= 0.9 * want.size


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (5, [1.0, 1.0])]
    got = collect(neighbours.search(table(spark, rows)))
    assert {q: [v for _, v, _ in f] for q, f in got.items()} == {0: [20, 5], 20: [0, 5]}
    assert neighbours.search(table(spark, [])).collect() == []
    assert neighbours.search(table(spark, [(0, None)])).collect() == []
    assert collect(neighbours.search(table(spark, [(0, [3.0]), (1, [2.0]), (2, [5.0])]))) == {
        0: [(1, 2, 15.0), (2, 1, 6.0)]}


def test_heap_visits_cells_in_order():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        near = [rnd.normal(size=7), rnd.normal(size=7)]
        sizes = rnd.integers(0, 4, 49)
        cells = neighbours.visit(near, sizes, int(sizes.sum()))
        total = (near[0][:, None] + near[1][None, :]).ravel()
        assert sorted(cells) == np.flatnonzero(sizes).tolist()
        assert (np.diff(total[cells]) >= 0).all()
        some = neighbours.visit(near, sizes, 5)
        assert some == cells[:len(some)] and sizes[some].sum() >= min(5, sizes.sum())


# --- archives ----------------------------------------------------------------------------------------
def pages():
    long = "<html>" + "é" * 600 + "</html>"
    edge = "a" * 1000
    rows = [(1, "http://a/b c", long), (2, None, long), (9, "http://x/ü?q=1#f", long), (3, "", None), (4, "http://e", ""),
            (5, "u", edge), (6, "v", edge), (7, "w", edge[1:]), (8, "w", edge[1:]), (None, "n", long), (None, "n", edge + "!"),
            (10, "t", "\r\n\r\nWARC/1.1\r\nfiledesc://x 1 1 1 1\n" * 40), (11, "z", "x\n" * 5000), (9, "http://x/ü?q=1#f", long)]
    return rows + [(100 + i, f"http://h/{i}", f"<p>{i % 7}</p>" * 300) for i in range(60)]


def check(spark, df, rows, **kw):
    by = {}
    for p, _, h in rows:
        by.setdefault(h or "", []).append(p)
    want = Counter()
    for p, _, h in rows:
        body = (h or "").encode()
        ids = [x for x in by[h or ""] if x is not None]
        holder = max(ids) if ids and len(body) >= 1000 else p
        revisit = holder != p
        want[p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", holder if revisit else None] += 1
    got = archives.round_trip(df, **kw).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def frame(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, path string")


@pytest.mark.parametrize("archive_bytes", [500, 1 << 22])
def test_round_trip(spark, archive_bytes):
    check(spark, frame(spark, pages()).repartition(3), pages(), archive_bytes=archive_bytes)


def test_no_pages(spark):
    assert archives.round_trip(frame(spark, [])).collect() == []


def test_both_arc_versions_parse():
    records = [("http://a/x y", 1, b"one\n\n"), ("http://b", None, b""), ("http://c", 3, "ü".encode() * 9)]
    for version in (1, 2):
        raw = archives.arc_head(version, "f.arc")
        for url, page, payload in records:
            raw += archives.arc_record(version, "f.arc", len(raw), url, page, payload)
        for body in (raw, raw[:-1]):
            got = [(h["URL"], *archives.split_http(b)[1:]) for _, h, b in archives.parse_arc(body)]
            assert [(u, p, f.get("X-Page-Id")) for u, p, f in got] == [
                (u, p, None if k is None else str(k)) for u, k, p in records]
    mixed = (archives.arc_head(1, "a") + archives.arc_record(1, "a", 0, "u", 1, b"p")
             + archives.arc_head(2, "b") + archives.arc_record(2, "b", 0, "v", 2, b"q"))
    assert [h["URL"] for _, h, _ in archives.parse_arc(mixed)] == ["u", "v"]


def test_broken_archives_are_refused():
    whole = archives.arc_head(1, "a") + archives.arc_record(1, "a", 0, "u", 1, b"payload")
    for bad in (whole[:-4], whole + b"no fields here\n", whole + b"no end"):
        with pytest.raises(ValueError):
            list(archives.parse_arc(bad))
    with pytest.raises(ValueError):
        list(archives.parse_warc(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_warc_fields():
    _, header, block = next(archives.parse_arc(archives.arc_head(1, "a") + archives.arc_record(1, "a", 0, "http://u", 4, b"p" * 5)))
    (response, body), = archives.parse_warc(archives.warc_record(header, block, None))
    assert response["WARC-Type"] == "response" and response["WARC-Date"] == "2024-01-01T00:00:00Z" and body == block
    assert response["WARC-Record-ID"].startswith("<urn:uuid:") and response["WARC-Payload-Digest"].startswith("sha1:")
    (revisit, head), = archives.parse_warc(archives.warc_record(header, block, {"id": "<urn:x>", "url": "http://v"}))
    assert revisit["WARC-Refers-To"] == "<urn:x>" and revisit["WARC-Payload-Digest"] == response["WARC-Payload-Digest"]
    assert head == block[:-5]


def test_a_page_whose_url_looks_like_a_version_block(spark):
    rows = [(1, "filedesc://x.arc", "a" * 2000), (2, "http://b", "a" * 2000), (3, "filedesc://y", None)]
    got = archives.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [
        (1, 2000, "revisit", 2), (2, 2000, "response", None), (3, 0, "response", None)]
