"""Toxic spans by a linear-chain conditional random field over words.

Words are maximal runs of ASCII letters and digits and of non-ASCII bytes.  A word's features are its
whole form and its byte prefixes, hashed to ``2**bits`` weights.  Labels say which documents are toxic, not where, so
the labelled words the field is trained on come from the labelled documents: a word of a toxic document
is a toxic token if one of its features occurs in enough toxic documents and hardly in clean ones.  The
field then weighs features and transitions together, and forward-backward gives every word's marginal
probability to be toxic.  A document's evidence is the marginals' noisy-or in log form; a logistic map
fitted on training documents the field has not seen turns it into a score.

The model is fitted on at most ``per_class`` toxic and ``2 * per_class`` clean labelled documents (in
order of a hash of the id); scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

from lendflow.llm.common import mix64, text_slices, word_prefix_hashes, word_spans
from lendflow.llm.near_dedup import shingle_sets

PER_CLASS = 600                      # toxic documents in the training sample (and twice as many clean)
SAMPLE_BYTES = 1 << 23               # text bytes of the training sample, at most; a third is for toxic ones
BITS = 20
PREFIXES = (4, 5, 6)                 # bytes; 0 (the whole word) is always there
CHUNK = 64                           # words handled in one step of the chain's recursion
SUPPORT = 3                          # toxic documents a feature must occur in to label words
SURPRISE = 20.0                      # its likelihood ratio statistic against occurring alike in both
ODDS = 2.0                           # and its log odds of occurring in toxic documents

_INK = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _INK[_a:_b] = True


@dataclass
class Model:
    """Weights of the hashed features (score of the toxic state, the last one is the bias), transition
    scores (from, to) and the logistic map from a document's evidence to its score."""
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    offset: float = -1.0
    constant: float | None = None    # score of every document when there was nothing to learn from


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """(feature ids of shape (words, kinds), word starts, word ends, first word of each row)."""
    starts, ends, first = word_spans(raw, offsets, _INK)
    hashes = word_prefix_hashes(raw, starts, ends, PREFIXES)
    shift = np.uint64(64 - bits)
    cols = [(mix64(h + np.uint64(k + 1)) >> shift).astype(np.int32) for k, h in enumerate(hashes)]
    return np.stack(cols, axis=1), starts, ends, first


def emissions(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    score = np.full(len(ids), weights[-1], dtype=np.float64)
    for column in ids.T:
        score += weights[column]
    return np.clip(score, -30, 30)


# --- the chain ---------------------------------------------------------------------------------------
def messages(emit: np.ndarray, first: np.ndarray, moves: np.ndarray):
    """Forward-backward: for every word the messages before it, through it (both from the left) and into
    it from the right, each a (2, words) array of (clean, toxic) up to a factor.  ``emit`` is the toxic
    state's score per word and ``first`` each row's first word (+ the total); the state before a row is
    clean.

    Rows are laid out as lanes of ``CHUNK`` words.  A lane acts on the state before it as a 2x2 matrix,
    so all lanes' matrices are found together, then carried along each row, and then all words'
    messages are found together from their lane's incoming one: exact for rows of any length.
    """
    length = np.diff(first)
    lanes = -(-length // CHUNK)
    base = np.concatenate([[0], np.cumsum(lanes)])
    row = np.repeat(np.arange(len(length)), length)
    place = np.arange(int(first[-1])) - first[:-1][row]
    cell = place % CHUNK, base[:-1][row] + place // CHUNK
    total = int(base[-1])
    up = np.ones((CHUNK, total))
    up[cell] = np.exp(emit)
    (m00, m01), (m10, m11) = np.exp(moves)
    some = lanes > 0
    heads, many, ends = base[:-1][some], lanes[some], (length[some] - 1) % CHUNK
    tails = heads + many - 1
    by_end = [tails[ends == t] for t in range(CHUNK)]       # lanes whose row ends at word t
    order = np.argsort(-many, kind="stable")
    heads, many = heads[order], many[order]

    def ahead(x, t):                                        # through word t, from the left
        return np.stack([x[0] * m00 + x[1] * m10, (x[0] * m01 + x[1] * m11) * up[t]])

    def behind(x, t):                                       # through word t, from the right
        toxic = x[1] * up[t]
        return np.stack([x[0] * m00 + toxic * m01, x[0] * m10 + toxic * m11])

    def incoming(step, left: bool) -> np.ndarray:
        """The message into every lane."""
        clean, toxic = np.zeros((2, total)), np.zeros((2, total))          # from either state
        clean[0] = toxic[1] = 1
        for t in range(CHUNK) if left else range(CHUNK - 1, -1, -1):
            if not left:
                clean[:, by_end[t]], toxic[:, by_end[t]] = [[1], [0]], [[0], [1]]
            clean, toxic = step(clean, t), step(toxic, t)
            scale = 1 / (clean[0] + clean[1] + toxic[0] + toxic[1])
            clean *= scale
            toxic *= scale
        got = np.ones((2, total))
        state = np.ones((2, len(heads)))
        state[1] = 0 if left else 1
        for k in range(int(many[0])):
            alive = int(np.searchsorted(-many, -k, side="left"))          # rows with more than k lanes
            at = heads[:alive] + (k if left else many[:alive] - 1 - k)
            state = state[:, :alive]
            got[:, at] = state
            state = clean[:, at] * state[0] + toxic[:, at] * state[1]
            state /= state[0] + state[1]
        return got

    before, through, after = (np.empty((2, CHUNK, total)) for _ in range(3))
    single = int(many[0]) == 1
    state = np.ones((2, total))
    state[1] = 0
    state = state if single else incoming(ahead, True)
    for t in range(CHUNK):
        before[:, t] = state
        state = ahead(state, t)
        state /= state[0] + state[1]
        through[:, t] = state
    state = np.ones((2, total)) if single else incoming(behind, False)
    for t in range(CHUNK - 1, -1, -1):
        state[:, by_end[t]] = 1
        after[:, t] = state
        state = behind(state, t)
        state /= state[0] + state[1]
    return tuple(x[:, cell[0], cell[1]] for x in (before, through, after))


def marginals(emit: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for every word."""
    if not len(emit):
        return np.zeros(0)
    _, through, after = messages(emit, first, moves)
    both = through * after
    return both[1] / (both[0] + both[1])


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row, -log of the probability that no word is toxic, in units that stay finite."""
    total = np.concatenate([[0.0], np.cumsum(-np.log1p(-np.minimum(p, 1 - 1e-9)))])
    return np.log1p(total[first[1:]] - total[first[:-1]])


# --- fitting -----------------------------------------------------------------------------------------
def label_words(ids: np.ndarray, doc: np.ndarray, toxic: np.ndarray, support: int = SUPPORT,
                surprise: float = SURPRISE, odds: float = ODDS) -> np.ndarray:
    """Which words are labelled toxic: those of toxic documents with a feature that at least ``support``
    toxic documents have, that is significantly (``surprise``) and much (``odds``) more often in them."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    hit = np.zeros(len(ids), dtype=bool)
    if not n_toxic or not n_clean:
        return hit
    for column in ids.T:
        pairs = np.unique(column.astype(np.int64) * len(toxic) + doc)
        feature, where = pairs // len(toxic), toxic[pairs % len(toxic)]
        size = int(feature.max(initial=0)) + 1
        pos = np.bincount(feature[where], minlength=size)
        neg = np.bincount(feature[~where], minlength=size)
        gain = np.log((pos + 0.5) / (n_toxic + 1)) - np.log((neg + 0.5) / (n_clean + 1))
        share = n_toxic / (n_toxic + n_clean)
        both = np.maximum(pos + neg, 1)
        ratio = 2 * (pos * np.log(np.maximum(pos, 1) / (both * share))
                     + neg * np.log(np.maximum(neg, 1) / (both * (1 - share))))
        hit |= ((pos >= support) & (gain >= odds) & (ratio >= surprise))[column]
    return hit & toxic[doc]


def fit_field(ids: np.ndarray, first: np.ndarray, labels: np.ndarray, bits: int = BITS,
              rounds: int = 12, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the penalised likelihood of the labelled words, by gradient
    steps scaled with each feature's curvature."""
    _, kinds, kind = np.unique(ids[:, 0], return_index=True, return_inverse=True)    # distinct words
    own = ids[kinds]
    weights, moves = np.zeros((1 << bits) + 1), np.zeros((2, 2))
    weights[-1] = np.log((labels.sum() + 1) / (len(labels) + 2))
    was = np.concatenate([[0], labels[:-1].astype(int)])
    was[first[:-1][np.diff(first) > 0]] = 0                 # the state before a row is clean
    seen = np.bincount(was * 2 + labels, minlength=4).reshape(2, 2)
    step = 1.0 / (ids.shape[1] + 2)
    for _ in range(rounds):
        emit = emissions(own, weights)[kind]
        before, through, after = messages(emit, first, moves)
        both = through * after
        p = both[1] / (both[0] + both[1])
        slope = labels - p
        # A word's curvature p(1 - p) vanishes where the field is surely wrong; its error bounds it there.
        bend = np.maximum(p * (1 - p), np.abs(slope) / 8)
        slope_of, bend_of = np.bincount(kind, slope), np.bincount(kind, bend)
        grad, curve = -penalty * weights[:-1], np.full(1 << bits, penalty)
        for column in own.T:
            grad += np.bincount(column, slope_of, minlength=1 << bits)
            curve += np.bincount(column, bend_of, minlength=1 << bits)
        weights[:-1] += step * grad / curve
        weights[-1] += step * slope.sum() / bend.sum()
        del grad, curve
        del through, both, bend
        after[1] *= np.exp(emit)
        pair = [[before[i] * after[j] * np.exp(moves[i, j]) for j in (0, 1)] for i in (0, 1)]
        whole = pair[0][0] + pair[0][1] + pair[1][0] + pair[1][1]
        got = np.array([[(x / whole).sum() for x in row] for row in pair])
        moves += step * (seen - got - penalty * moves) / (0.25 * np.maximum(seen, got) + penalty)
        moves[0, 0] = 0.0                                   # fixes the scale; the bias covers the rest
    return weights, moves


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, penalty: float = 0.05) -> tuple[float, float]:
    """Slope and offset of a weakly penalised logistic regression on one variable."""
    a, b = 1.0, -1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = p * (1 - p) + 1e-9
        grad = np.array([((y - p) * x).sum() - penalty * a, (y - p).sum() - penalty * b])
        bend = np.array([[(h * x * x).sum() + penalty, (h * x).sum()], [(h * x).sum(), h.sum() + penalty]])
        da, db = np.linalg.solve(bend, grad)
        a, b = a + float(np.clip(da, -2, 2)), b + float(np.clip(db, -2, 2))
    return a, b


FOLDS = 5                            # labels are learned from all folds but 0


def fold(doc_id: Column) -> Column:
    """Fold of a document: the CRC-32 of its id as text, mod ``FOLDS``; fold 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _shortest_first() -> WindowSpec:
    own = Window.partitionBy(F.col("y") == 1).orderBy("size", "h", "doc_id")
    return own.rowsBetween(Window.unboundedPreceding, 0)


SIMILARITY = 0.8                     # of shingle sets, from which on a row is a near copy


def distinct_rows(table: pa.Table, width: int = 5, similarity: float = SIMILARITY) -> np.ndarray:
    """Which rows are no near copies of an earlier kept one: the Jaccard similarity of their shingle sets
    is less than ``similarity`` (exact; the table is the training sample)."""
    sets = []
    for batch in table.combine_chunks().to_batches():
        for _, _, raw, offsets in text_slices(batch, "body"):
            h, at = shingle_sets(raw, offsets, width, True)
            sets += np.split(h, at[1:-1])
    size = np.array([len(x) for x in sets], dtype=np.int64)
    names, codes = np.unique(np.concatenate(sets), return_inverse=True) if sets else (size, size)
    mine, kept = np.zeros(len(names), dtype=bool), np.zeros(len(codes), dtype=np.int64)
    owner, keep, used, at = np.zeros(len(codes), dtype=np.int32), np.ones(len(sets), dtype=bool), 0, 0
    for row, n in enumerate(size.tolist()):
        own = codes[at:at + n]
        at += n
        mine[own] = True
        both = np.bincount(owner[:used][mine[kept[:used]]], minlength=row)      # shingles shared with each row
        mine[own] = False
        keep[row] = not n or not (both >= similarity * (size[:row] + n - both))[both > 0].any()
        if keep[row]:
            kept[used:used + n], owner[used:used + n] = own, row
            used += n
    return keep


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
        per_class: int = PER_CLASS, bits: int = BITS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on a bounded sample of the labelled documents whose id's remainder is not the held-out one.

    The sample is the first ``per_class`` toxic and ``2 * per_class`` clean labelled ids in the order
    of a hash; it alone reaches the driver.  A third of ``sample_bytes`` is for the texts of the toxic
    ones and the rest for the clean ones; of a class that needs more, only its longest texts are left out.
    Null labels are no labels.  If all labels are of one class, or ``docs`` is empty, every score is the
    share of toxic ones in the sample; if both classes have labels but one has no text in the sample, there
    is no model (ValueError).
    """
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    counted = rows.groupBy((F.col("y") == 1).alias("t")).agg(F.count(F.lit(1))).collect()    # two rows
    n_all = {bool(t): n for t, n in counted}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = (rows.where("y = 1").orderBy(*order).limit(per_class)
              .unionByName(rows.where("y <> 1").orderBy(*order).limit(2 * per_class)))
    found = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
             .join(F.broadcast(chosen), "doc_id")           # at most 3 * per_class ids
             .select("body", F.coalesce(F.octet_length("body"), F.lit(0)).alias("size"), "y",
                     F.xxhash64("doc_id").alias("h"), "doc_id"))
    room = F.when(F.col("y") == 1, F.lit(sample_bytes // 3)).otherwise(F.lit(sample_bytes - sample_bytes // 3))
    sample = (found.withColumn("upto", F.sum("size").over(_shortest_first())).where(F.col("upto") <= room)
              .select("h", "doc_id", "body", "y").toArrow()
              .sort_by([("h", "ascending"), ("doc_id", "ascending")]).drop_columns("doc_id"))
    y = np.asarray(sample["y"].to_pylist()) == 1
    if y.all() or not y.any():
        if len(n_all) == 2 and not docs.isEmpty():
            raise ValueError(f"labels of both classes, but the training sample has {int(y.sum())} toxic and "
                             f"{int((~y).sum())} clean documents (texts missing or over {sample_bytes} bytes)")
        return Model(np.zeros(1), np.zeros((2, 2)), constant=float(y.mean()) if len(y) else 0.0)
    own = distinct_rows(sample.select(["body"]))            # copies would pass for repeated evidence
    sample, y = sample.filter(pa.array(own)), y[own]
    calibrate = (np.asarray(sample["h"].to_pylist(), dtype=np.int64) >> 8) % 4 == 0
    parts = []
    for keep in (~calibrate, calibrate):
        table = sample.filter(pa.array(keep)).combine_chunks()
        ids, first = [], [np.zeros(1, np.int64)]
        for batch in table.to_batches():
            for _, _, raw, offsets in text_slices(batch, "body"):
                f, _, _, at = features(raw, offsets, bits)
                ids.append(f)
                first.append(at[1:] + first[-1][-1])
        parts.append((np.concatenate(ids) if ids else np.zeros((0, len(PREFIXES) + 1), np.int32),
                      np.concatenate(first), y[keep]))
    (ids, first, toxic), (more, more_first, more_toxic) = parts
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    weights, moves = fit_field(ids, first, label_words(ids, doc, toxic), bits)
    model = Model(weights.astype(np.float32), moves)
    x = evidence(marginals(emissions(more, weights), more_first, moves), more_first)
    if len(x) and more_toxic.any() and not more_toxic.all():
        model.slope, model.offset = fit_logistic(x, more_toxic.astype(float))
        # The sample holds more toxic documents than the labels do: back to their share.
        model.offset += float(np.log(n_all[True] / n_all[False]) - np.log(y.sum() / (~y).sum()))
    return model


# --- scoring -----------------------------------------------------------------------------------------
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                 T.StructField("marginal", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity", spans: str | None = None,
          bits: int = BITS) -> DataFrame:
    """``docs`` with ``out``, the probability that the document is toxic, and with ``spans`` the words
    whose marginal is at least one half: their UTF-8 byte offsets (start, end) in the text and marginals.

    One row per input row, whatever its other columns; a null or empty text has no words and gets the
    score of no evidence.  ``out`` and ``spans`` must not be columns of ``docs``.
    """
    clash = {out, spans} & set(docs.columns)
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    schema = T.StructType(docs.schema.fields + [T.StructField(out, T.DoubleType())]
                          + ([T.StructField(spans, SPAN)] if spans else []))
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)        # 2^bits weights: bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, marks = np.full(batch.num_rows, m.constant if m.constant is not None else 0.0), []
            one = pa.RecordBatch.from_arrays([batch.column(at)], names=["body"])
            for lo, hi, raw, offsets in text_slices(one, "body"):
                if m.constant is not None:
                    marks += [[]] * (hi - lo)
                    continue
                ids, starts, ends, first = features(raw, offsets, bits)
                p = marginals(emissions(ids, m.weights), first, m.moves)
                z = np.clip(m.slope * evidence(p, first) + m.offset, -30, 30)
                scores[lo:hi] = 1 / (1 + np.exp(-z))
                if spans:
                    hit = np.flatnonzero(p >= 0.5)
                    which = np.searchsorted(first, hit, side="right") - 1
                    found: list[list[dict]] = [[] for _ in range(hi - lo)]
                    for w, r in zip(hit.tolist(), which.tolist(), strict=True):
                        found[r].append({"start": int(starts[w] - offsets[r]), "end": int(ends[w] - offsets[r]),
                                         "marginal": float(p[w])})
                    marks += found
            cols = [*batch.columns, pa.array(scores)]
            if spans:
                cols.append(pa.array(marks, type=pa.list_(pa.struct(
                    [("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)
