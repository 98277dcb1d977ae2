"""Where long repeats can be: the lossless part that both repeat removers share.

A repeat is a run of ``span`` symbols (bytes or words) that occurs twice.  Of every run's ``width``-symbol
grams the one with the smallest hash, the leftmost of equals, is an anchor.  A run's anchor depends on its
symbols alone, so two occurrences of a run share an anchor at the same place: a run whose anchor occurs
once occurs once.  An anchor's context is the stretch of all runs that hold it.

* Occurrences whose contexts are equal need no search: all but the first are repeats as a whole.  They
  are told apart by 64-bit digests of the gram and of the context, first among a task's own rows, so
  thousands of copies reach the shuffle as one row per batch.
* What remains are anchors with several different contexts.  Only these contexts, one each, are handed
  to the search for partial repeats (`removed`).
* A gram whose contexts alone would overfill a shard is not searched in one task: every run around it is
  told apart by two 64-bit digests, and runs meet in an aggregate that keeps the earliest of equal ones
  (`crowded_repeats`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendflow.llm.common import _powers, mix64, stored, text_slices

_PLACE = np.uint64((1 << 28) - 1)    # low bits of a gram's rank: its place, so that the leftmost wins
MARK, CHECK = 0, 1


@dataclass(frozen=True)
class Scheme:
    """``span`` symbols make a repeat, ``width`` a gram; ``across``: only repeats of other documents
    count.  ``symbols(raw, offsets)`` gives the symbols' 64-bit codes and each row's first symbol."""
    span: int
    width: int
    across: bool
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which ``digest`` gets the hash of any stretch in constant time."""
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[:-1] + up[:-1], out=total[1:])
    return total, down


def digest(total: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def context(place: np.ndarray, begin: np.ndarray, end: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Stretch of all runs that hold the gram at ``place`` and lie within ``begin`` to ``end``."""
    return np.maximum(begin, place + scheme.width - scheme.span), np.minimum(end, place + scheme.span)


def anchors(total: np.ndarray, down: np.ndarray, first: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Places of all anchors, in order; rows are bounded by ``first`` (+ the total)."""
    n, grams = len(total) - 1, scheme.span - scheme.width + 1
    if n < scheme.span:
        return np.zeros(0, np.int64)
    at = np.arange(n - scheme.width + 1)
    gram = (total[scheme.width:] - total[:n - scheme.width + 1]) * down[:n - scheme.width + 1]
    least = (mix64(gram) & ~_PLACE) | at.astype(np.uint64)
    size = 1
    while 2 * size <= grams:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < grams:
        least = np.minimum(least[:len(least) - (grams - size)], least[grams - size:])
    inside = np.zeros(len(least), dtype=bool)              # runs that do not cross rows
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        inside[a:max(a, b - scheme.span + 1)] = True
    return np.unique((least[inside] & _PLACE).astype(np.int64))


def _earlier_copies(gram, ctx, doc, place, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by (gram, ctx, doc, place): which start a new gram, which a new (gram, ctx), and
    which repeat an earlier equal context."""
    new_gram = np.ones(len(gram), dtype=bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new = new_gram.copy()
    new[1:] |= ctx[1:] != ctx[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    copy = doc > doc[head]
    if not across:
        copy |= place > place[head]
    return new_gram, new, copy


def occurrences(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(gram, ctx, doc, place, copy) of every anchor of ``docs`` (doc_id, body); ``copy`` where the same
    context stands earlier in the same batch."""
    names = ["gram", "ctx", "doc", "place", "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(zero_copy_only=False), []
            for lo, hi, raw, offsets in text_slices(batch, "body"):
                codes, first = scheme.symbols(raw, offsets)
                total, down = sums(codes)
                at = anchors(total, down, first, scheme)
                row = np.searchsorted(first, at, side="right") - 1
                a, b = context(at, first[row], first[row + 1], scheme)
                parts.append((digest(total, down, at, at + scheme.width), digest(total, down, a, b),
                              ids[lo + row], at - first[row]))
            if not parts:
                continue
            gram, ctx, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, doc, ctx, gram))
            gram, ctx, doc, place = gram[order], ctx[order], doc[order], place[order]
            if scheme.across:                              # a document counts once, wherever it repeats itself
                own = np.ones(len(gram), dtype=bool)
                own[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1]) | (doc[1:] != doc[:-1])
                gram, ctx, doc, place = gram[own], ctx[own], doc[own], place[own]
            _, _, copy = _earlier_copies(gram, ctx, doc, place, scheme.across)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc), pa.array(place),
                 pa.array(copy)], names=names)

    return docs.where("doc_id is not null").select("doc_id", "body").mapInArrow(
        run, "gram long, ctx long, doc long, place long, copy boolean")


def classified(found: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc, place, kind, gram, ctx) of the anchors that matter: MARK, whose context repeats an earlier
    one, and CHECK, the first of each context of an anchor that has several."""
    names = ["doc", "place", "kind", "gram", "ctx"]

    def whole_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Cut the sorted stream between grams."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1], side="left"))
            if cut or (held and held[-1].column(0)[0].as_py() != int(gram[0])):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_grams(batches):
            gram, ctx, doc, place = (table[c].to_numpy() for c in range(4))
            new_gram, new, copy = _earlier_copies(gram, ctx, doc, place, scheme.across)
            group = np.cumsum(new_gram) - 1
            several = np.bincount(group, new)[group] > 1
            if scheme.across:                              # and in several documents
                low, high = np.full(group[-1] + 1, doc.max()), np.full(group[-1] + 1, doc.min())
                np.minimum.at(low, group, doc)
                np.maximum.at(high, group, doc)
                several &= (low < high)[group]
            copy |= table["copy"].to_numpy(zero_copy_only=False)
            keep = copy | several
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[keep]), pa.array(place[keep]), pa.array(np.where(copy[keep], MARK, CHECK).astype(np.int32)),
                 pa.array(gram[keep]), pa.array(ctx[keep])], names=names)

    # A known copy needs no company: dealt by its own place, copies do not pile up on their gram.
    key = F.when(F.col("copy"), F.xxhash64("doc", "place")).otherwise(F.col("gram"))
    dealt = found.repartition(key).sortWithinPartitions("gram", "ctx", "doc", "place")
    return dealt.mapInArrow(run, "doc long, place long, kind int, gram long, ctx long")


def pair_keys(gram: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return mix64(mix64(gram) ^ ctx)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the stretches a to b, as maximal ones in order (touching ones join)."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > reach[:-1]
    return a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def packed(flat: np.ndarray) -> bytes:
    return np.ascontiguousarray(flat, dtype=np.int64).tobytes()


def marked_documents(docs: DataFrame, scheme: Scheme, finish: Callable) -> DataFrame:
    """Every document once: doc_id, body (null where nothing can be repeated), marks (binary pairs of
    symbol places already known to be repeats), checks (binary triples gram, from, to of contexts to
    search) and, for documents that are done, the columns of ``finish``.

    ``finish(raw, a, b)`` gives a document's result columns as a tuple from its bytes and the symbol
    stretches to remove.
    """
    spots = stored(classified(occurrences(docs, scheme), scheme), "repeat-spots")
    per_doc = spots.groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_list(F.struct("place", "kind", "gram", "ctx")).alias("spots"))    # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [one(part, i) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, type=t) for c, t in zip(
                        zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.binary(), *finish.types), strict=True))],
                    names=["doc_id", "body", "marks", "checks", *finish.names])

    def one(part: pa.RecordBatch, i: int) -> tuple:
        body = part.column(1)[i].as_py() or b""
        nothing = np.zeros(0, np.int64)
        if not part.column(2)[i].is_valid:
            return (None, None, None, *finish(body, nothing, nothing))
        spot = part.column(2)[i].values
        place, kind, gram, ctx = (spot.field(k).to_numpy() for k in range(4))
        codes, first = scheme.symbols(np.frombuffer(body, dtype=np.uint8), np.array([0, len(body)]))
        total, down = sums(codes)
        end = len(codes)
        if scheme.across:                                  # every place of the document that has the context
            at = anchors(total, down, first, scheme)
            a, b = context(at, np.zeros_like(at), np.full_like(at, end), scheme)
            known = pair_keys(gram.view(np.uint64), ctx.view(np.uint64))
            here = pair_keys(digest(total, down, at, at + scheme.width), digest(total, down, a, b))
            order = np.argsort(known)
            found = np.minimum(np.searchsorted(known[order], here), len(known) - 1)
            ok = known[order][found] == here
            kind, gram = kind[order][found], gram[order][found]
        else:
            # A row that shares its id with another text has none of the other's anchors.
            ok = (place >= 0) & (place + scheme.width <= end)
            place, kind, gram, ctx = place[ok], kind[ok], gram[ok], ctx[ok]
            a, b = context(place, np.zeros_like(place), np.full_like(place, end), scheme)
            ok = (digest(total, down, place, place + scheme.width).view(np.int64) == gram) & (
                digest(total, down, a, b).view(np.int64) == ctx)
        a, b, kind, gram = a[ok], b[ok], kind[ok], gram[ok]
        marks = merged(a[kind == MARK], b[kind == MARK])
        if (kind == CHECK).any():
            checks = np.stack([gram, a, b], axis=1)[kind == CHECK]
            return (body, packed(np.stack(marks, axis=1)), packed(checks), *[None] * len(finish.names))
        return (None, None, None, *finish(body, *marks))

    named = docs.select("doc_id", F.col("body").cast("binary").alias("body"))
    joined = named.join(per_doc, "doc_id", "left").select("doc_id", "body", "spots")
    schema = ", ".join(["doc_id long, body binary, marks binary, checks binary", *finish.schema])
    return stored(joined.mapInArrow(run, schema), "repeat-documents")


def context_bytes(open_docs: DataFrame, finish: Callable, most: int) -> tuple[int, np.ndarray]:
    """Bytes of all contexts to search, and in order the grams with more than ``most`` bytes of them (so
    at most one for every ``most`` bytes)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                grams, sizes = [], []
                for body, checks in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    gram, a, b = np.frombuffer(checks, dtype=np.int64).reshape(-1, 3).T
                    grams.append(gram)
                    sizes += map(len, finish.cut(body, a, b))
                gram, which = np.unique(np.concatenate(grams), return_inverse=True)
                size = np.bincount(which, sizes).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(size)], names=["gram", "size"])

    sizes = open_docs.select("body", "checks").mapInArrow(count, "gram long, size long").groupBy("gram").agg(
        F.sum("size").alias("size"))
    total, hot = sizes.agg(F.sum("size"), F.collect_list(F.when(F.col("size") > most, F.col("gram")))).first()
    return total or 0, np.sort(np.array(hot, dtype=np.int64))


def crowded_repeats(open_docs: DataFrame, scheme: Scheme, hot: np.ndarray) -> DataFrame:
    """(doc_id, found) of the runs around the grams ``hot`` that an earlier run equals.

    Equal runs share an anchor, so all of them are here.  No task holds a gram's runs: the earliest of
    equal ones is an aggregate, and it is joined back.
    """
    span = scheme.span

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py()
                gram, a, b = np.frombuffer(batch.column(2)[i].as_py(), dtype=np.int64).reshape(-1, 3).T
                ours = np.isin(gram, hot)
                if not ours.any():
                    continue
                a, b = merged(a[ours], b[ours] - span + 1)             # where the runs start
                at = np.concatenate([np.arange(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                codes, _ = scheme.symbols(np.frombuffer(body, dtype=np.uint8), np.array([0, len(body)]))
                keys = [digest(*sums(c), at, at + span).view(np.int64) for c in (codes, mix64(codes + np.uint64(1)))]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, keys), pa.array(np.full(len(at), batch.column(0)[i].as_py())), pa.array(at)],
                    names=["run", "proof", "doc", "place"])

    found = stored(open_docs.select("doc_id", "body", "checks").mapInArrow(
        runs, "run long, proof long, doc long, place long"), "crowded-runs")
    own = F.struct("doc") if scheme.across else F.struct("doc", "place")
    earliest = (found.groupBy("run", "proof").agg(F.min(own).alias("least"), F.max(own).alias("most"))
                .where("least < most").select("run", "proof", "least"))
    later = found.join(earliest, ["run", "proof"]).where(own > F.col("least"))
    per_doc = later.groupBy("doc").agg(F.collect_set("place").alias("places"))       # bounded by the text

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                at = batch.column(1)[i].values.to_numpy()
                rows.append(packed(np.stack(merged(at, at + span), axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=pa.binary())],
                                             names=["doc_id", "found"])

    return per_doc.mapInArrow(pack, "doc_id long, found binary")


def removed(marked: DataFrame, scheme: Scheme, search: Callable, finish: Callable, shard_bytes: int) -> DataFrame:
    """Finish the documents that still have contexts to search.

    Contexts are dealt to shards by their gram, so all that can hold a common run around it meet;
    a shard holds about ``shard_bytes`` of them, and grams with more than that are left to
    `crowded_repeats`.  ``cut(body, a, b)`` gives a context's bytes; ``search(contexts)`` takes
    (doc, place, bytes) columns of a shard and gives (doc, from, to).
    """
    open_docs = marked.where("checks is not null")
    size, hot = context_bytes(open_docs, finish, shard_bytes)
    shards = max(1, -(-size // shard_bytes))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py()
                gram, a, b = np.frombuffer(batch.column(2)[i].as_py(), dtype=np.int64).reshape(-1, 3).T
                if len(hot):
                    rest = ~np.isin(gram, hot)
                    gram, a, b = gram[rest], a[rest], b[rest]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.uint64) % np.uint64(shards), type=pa.uint64()).cast(pa.int64()),
                     pa.array(np.full(len(a), batch.column(0)[i].as_py())), pa.array(a),
                     pa.array(finish.cut(body, a, b), type=pa.binary())], names=["shard", "doc", "place", "body"])

    def run(table: pa.Table) -> pa.Table:
        doc, a, b = search(table["doc"].to_numpy(), table["place"].to_numpy(), table["body"].to_pylist())
        order = np.lexsort((a, doc))
        doc, a, b = doc[order], a[order], b[order]
        cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        rows = [packed(np.stack(merged(x, y), axis=1)) for x, y in zip(np.split(a, cut[1:]), np.split(b, cut[1:]),
                                                                     strict=True)] if len(doc) else []
        return pa.table([pa.array(doc[cut]), pa.array(rows, type=pa.binary())], names=["doc_id", "found"])

    dealt = open_docs.select("doc_id", "body", "checks").mapInArrow(
        contexts, "shard long, doc long, place long, body binary")
    found = dealt.groupBy("shard").applyInArrow(run, "doc_id long, found binary")
    if len(hot):
        found = found.unionByName(crowded_repeats(open_docs, scheme, hot))
    found = found.groupBy("doc_id").agg(F.collect_list("found").alias("found"))       # bounded by the text

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                parts = [batch.column(2)[i].as_py(), *(batch.column(3)[i].as_py() or [])]
                a, b = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, 2) for x in parts]).T
                rows.append(finish(batch.column(1)[i].as_py(), *merged(a, b)))
            columns = list(zip(*rows, strict=True)) or [()] * len(finish.names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=t) for c, t in zip(columns, finish.types, strict=True))],
                names=["doc_id", *finish.names])

    closed = (open_docs.select("doc_id", "body", "marks").join(found, "doc_id", "left")
              .mapInArrow(close, ", ".join(["doc_id long", *finish.schema])))
    return marked.where("checks is null").select("doc_id", *finish.names).unionByName(closed)
