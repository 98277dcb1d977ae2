"""Phrase collocations by best-first branch and bound over prefixes.

A phrase of two to ``most`` words scores, over its cuts in a first part and a rest, the least
1000 * a * n / (l * r): a counts the phrase, l and r the parts, n all words of its language.  The rest occurs at
least as often as the phrase, so no phrase that begins with a prefix scores above 1000 * n / f(prefix), and
the count of its first word alone bounds a whole tree of phrases.

The frontier holds the first words that are not expanded yet, best bound (rarest word) first.  A round expands
the best of them, up to a share of the corpus, and prunes those whose bound lies below the score of the
language's ``top``-th survivor so far.  Growth is by length: an occurrence is counted only where its
prefix is frequent, its last word is frequent and its first word is on the frontier.  When no first word
is left whose bound reaches the threshold, nothing unexpanded can enter the list, nor tie with its end.

Two passes read the texts: one counts the words, one codes them (digests of the frequent words in order, a 0
for each border of a piece and for each rarer word, which no candidate holds).  All later ones read the codes, cut at
borders into short rows: Arrow takes rows by their number, on both sides of a worker's pipe.  Their
tasks emit one row per distinct phrase of some slices, summed before and after the shuffle, so a phrase held by a
third of all rows costs a task one row.  Which phrases are frequent travels to the tasks as a bitmap of at
most ``MOST_BITS`` bits; a bit set by another phrase only lets more be counted.  Words and phrases are told
apart by 64-bit digests that begin with their language; two frequent ones under one digest raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendflow.llm.common import mix64, stored, text_slices, word_hashes, word_spans

LEAST, MOST, TOP = 100, 5, 2000
NO_LANG = "und"
SHARES = (1 / 8, 1.0)              # of a language's words that begin a phrase, by round
MOST_BITS = 1 << 28
STEP = 16                            # histogram cells a doubling
ROW_CODES = 1 << 7                   # codes in a row, or a little more: up to its next border
SLICE_CODES = 1 << 18
HELD_ROWS = 1 << 19                  # counts of slices that a task sums before they leave it
OUT_ROWS = 1 << 15                   # rows that leave a task at a time

_PIECE = np.zeros(256, dtype=bool)
_PIECE[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_LETTER = ~_PIECE
_LETTER[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NEXT = np.uint64(0xD1342543DE82EF95)

# Products pass 64 bits: 38 decimal digits hold them.
SCORE = ("(1000 * (CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))))"
         " div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")

WORDS = "lang string, key long, word string, f long"
CODES = "lang string, codes array<long>"
COUNTS = "lang string, key long, f long"
DESCRIBED = ("lang string, key long, a long, before_lo long, before_hi long, after_lo long, after_hi long, "
             "words array<long>, parts array<struct<left:long,right:long>>")


# --- texts to words and codes -----------------------------------------------------------------------
def _digests(raw: np.ndarray, offsets: np.ndarray, langs: list[str], lang_of: np.ndarray):
    """Digest, start, end and row of every word of a slice, and each row's first word (+ the total)."""
    starts, ends, first = word_spans(raw, offsets, _LETTER)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    salt = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                                    "little") for x in langs], dtype=np.uint64)
    words = mix64(word_hashes(raw, starts, ends, lower=True) ^ salt[lang_of[row]])
    words[words == 0] = 1                    # 0 is a border
    return words, starts, ends, row, first


def _gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as strings, A-Z folded."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    body = _LOWER[raw[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body))


def _named(langs: list[str], codes: np.ndarray) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), pa.array(langs, pa.string())).cast(pa.string())


def _summed(counts: Iterator[pa.RecordBatch], most: int = HELD_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of all slices of a task with equal ones (but for ``f``, the last column) summed, some ``most`` at a
    time: a row costs more once it has left Python."""
    def total(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        keys = held[0].schema.names[:-1]
        sums = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("f", "sum")])
        return sums.select([*keys, "f_sum"]).rename_columns([*keys, "f"]).combine_chunks().to_batches()

    held, rows = [], 0
    for batch in counts:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        held = total(held)
        pa.default_memory_pool().release_unused()
        rows = sum(b.num_rows for b in held)
        if rows > most // 2:
            yield from held
            held, rows = [], 0
    if held:
        yield from total(held)


def _handed_on(out: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``out`` by at most ``OUT_ROWS`` rows.  A worker lives on after its task: it keeps no freed memory."""
    for batch in out:
        for lo in range(0, batch.num_rows, OUT_ROWS):
            yield batch.slice(lo, OUT_ROWS)
    batch = None
    pa.default_memory_pool().release_unused()


def _over_texts(docs: DataFrame, schema: str, work: Callable[..., pa.RecordBatch], after=iter) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_slices(batch, "body"):
                coded = pc.dictionary_encode(batch.column("lang").slice(lo, hi - lo))
                yield work(raw, offsets, coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False))
    return docs.mapInArrow(lambda batches: _handed_on(after(run(batches))), schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, word, f) of every word of ``docs`` (lang, body)."""
    def work(raw, offsets, langs, lang_of):
        words, starts, ends, row, _ = _digests(raw, offsets, langs, lang_of)
        keys, first, count = np.unique(words, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [_named(langs, lang_of[row[first]]), pa.array(keys.view(np.int64)),
             _gathered(raw, starts[first], ends[first]).cast(pa.string()), pa.array(count.astype(np.int64))],
            names=["lang", "key", "word", "f"])
    return _over_texts(docs, WORDS, work, _summed).groupBy("lang", "key", "word").agg(F.sum("f").alias("f"))


def coded(docs: DataFrame, words_in: Members) -> DataFrame:
    """(lang, codes) of every text that holds a frequent word: their digests, and single 0s for what lies between.  A
    long text has several rows; each begins with a 0."""
    def work(raw, offsets, langs, lang_of):
        words, starts, _, row, first = _digests(raw, offsets, langs, lang_of)
        n = len(words)
        frequent = words_in.has(words)
        piece = np.cumsum(_PIECE[raw])[starts] if n else np.zeros(0, np.int64)
        joined = np.zeros(n, dtype=bool)         # the word goes on where the one before it ended
        joined[1:] = frequent[1:] & frequent[:-1] & (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        kept = np.flatnonzero(frequent)
        size = 2 - joined[kept]                  # a 0 before the word, or none
        at = np.cumsum(size) - 1
        codes = np.zeros(int(size.sum()), np.uint64)
        codes[at] = words[kept]
        filled = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(kept, first)]
        border = np.flatnonzero(codes == 0)
        text = np.searchsorted(filled, border, side="right") - 1
        block = (border - filled[text]) // ROW_CODES
        cut = np.ones(len(border), dtype=bool)
        cut[1:] = (text[1:] != text[:-1]) | (block[1:] != block[:-1])
        lists = pa.ListArray.from_arrays(pa.array(np.append(border[cut], len(codes)), pa.int32()),
                                         pa.array(codes.view(np.int64)))
        return pa.RecordBatch.from_arrays([_named(langs, lang_of[text[cut]]), lists], names=["lang", "codes"])
    return _over_texts(docs, CODES, work)


class Codes:
    """The codes of some rows after one another; every row begins with a 0."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, langs: list[str], lang_of: np.ndarray):
        self.word, self.first, self.langs, self.lang_of = codes, first, langs, lang_of
        border = np.append(np.flatnonzero(codes == 0), len(codes))
        self.room = np.zeros(len(codes), np.int64)               # words from here to the next border
        inside = np.flatnonzero(codes)
        self.room[inside] = border[np.searchsorted(border, inside)] - inside
        self._keys = {1: codes}

    def keys(self, size: int) -> np.ndarray:
        """Digest of the ``size`` words from each place on (of no meaning where the piece ends before)."""
        if size not in self._keys:
            last = self.word[size - 1:]
            self._keys[size] = mix64(self.keys(size - 1)[:len(last)] * _NEXT + last)
        return self._keys[size]

    def places(self, size: int) -> np.ndarray:
        return np.flatnonzero(self.room >= size)

    def lang(self, at: np.ndarray) -> pa.Array:
        return _named(self.langs, self.lang_of[np.searchsorted(self.first, at, side="right") - 1])


class Members:
    """A set of digests as a bitmap: every member is found, another digest rarely."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    @classmethod
    def of(cls, rows: DataFrame, key: str = "key") -> Members:
        """The bitmap is filled by an aggregate, block by block; its bytes, at most ``MOST_BITS`` / 8, are what reaches the
        driver, by one job (an iterator would take a job a partition)."""
        count = rows.count()
        size = min(MOST_BITS, max(1 << 15, 1 << (16 * count - 1).bit_length()))
        place = F.col(key).bitwiseAND(F.lit(size - 1)) + 1
        blocks = (rows.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
                  .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")))
        bits = np.zeros(size // 8, np.uint8)
        for b, block in blocks.collect():
            bits[(b - 1) * 4096:b * 4096] = np.frombuffer(block, np.uint8)
        return cls(bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys & self.mask
        bit = self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)
        return (bit & 1).astype(bool)


def _over_codes(codes: DataFrame, schema: str, work: Callable[[Codes], pa.RecordBatch], after=iter) -> DataFrame:
    """``work`` on rows of about ``SLICE_CODES`` codes at a time (a longer row: alone)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, langs = batch.column("codes"), pc.dictionary_encode(batch.column("lang"))
            offsets = lists.offsets.to_numpy()
            body, names = lists.values.to_numpy().view(np.uint64), langs.dictionary.to_pylist()
            lang_of = langs.indices.to_numpy()
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_CODES, side="right")) - 1)
                yield work(Codes(body[offsets[lo]:offsets[hi]], offsets[lo:hi] - offsets[lo], names, lang_of[lo:hi]))
                lo = hi
    return codes.mapInArrow(lambda batches: _handed_on(after(run(batches))), schema)


def _tally(codes: DataFrame, chosen: Callable[[Codes], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(lang, key, f): exact counts of the (places, digests) that ``chosen`` gives for every slice."""
    def work(part: Codes) -> pa.RecordBatch:
        at, keys = (np.concatenate(x) for x in zip(*chosen(part), strict=True))
        unique, first, count = np.unique(keys, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([part.lang(at[first]), pa.array(unique.view(np.int64)),
                                           pa.array(count.astype(np.int64))], names=["lang", "key", "f"])
    return _over_codes(codes, COUNTS, work, _summed).groupBy("lang", "key").agg(F.sum("f").alias("f"))


def grown(codes: DataFrame, sizes: tuple[int, ...], starts_in: Members, prefixes_in: Members | None) -> DataFrame:
    """Counts of the phrases of these sizes of frequent words whose first word is in ``starts_in`` and whose prefix of
    ``sizes[0] - 1`` words is in ``prefixes_in`` (when it has two words or more)."""
    base = sizes[0] - 1

    def chosen(part: Codes):
        at = part.places(sizes[0])
        at = at[starts_in.has(part.word[at])]
        if prefixes_in is not None:
            at = at[prefixes_in.has(part.keys(base)[at])]
        for size in sizes:
            at = at[part.room[at] >= size]
            yield at, part.keys(size)[at]
    return _tally(codes, chosen)


def counts_of(codes: DataFrame, sizes: range, wanted: Members) -> DataFrame:
    """Counts of the phrases of these sizes in ``wanted``."""
    def chosen(part: Codes):
        for size in sizes:
            at = part.places(size)
            keys = part.keys(size)[at]
            here = wanted.has(keys)
            yield at[here], keys[here]
    return _tally(codes, chosen)


def described(codes: DataFrame, most: int, members: Members, starts_in: Members) -> DataFrame:
    """Every phrase in ``members`` with its count, its words, the digests of its parts at every cut, and the smallest and
    largest digest of the words before and after it (0 at a border or a rarer word): equal ones that are not 0 mean
    that one longer phrase holds every occurrence."""
    def work(part: Codes) -> pa.RecordBatch:
        signed = part.word.view(np.int64)
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(9)]
        cuts = [np.zeros((0, 2), np.int64)]
        starts = part.places(2)
        starts = starts[starts_in.has(part.word[starts])]
        for size in range(2, most + 1):
            starts = starts[part.room[starts] >= size]
            keys = part.keys(size)[starts]
            here = members.has(keys)
            at, keys = starts[here], keys[here]
            if not len(at):
                continue
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            before = signed[at - 1]                          # a row begins with a border
            after = np.where(part.room[at] == size, 0, signed[np.minimum(at + size, len(signed) - 1)])
            one = at[cut]
            for column, values in zip(columns, (
                    one, keys[cut].view(np.int64), np.diff(np.r_[cut, len(at)]),
                    np.minimum.reduceat(before, cut), np.maximum.reduceat(before, cut),
                    np.minimum.reduceat(after, cut), np.maximum.reduceat(after, cut),
                    signed[one[:, None] + np.arange(size)].ravel(), np.full(len(cut), size)), strict=True):
                column.append(values)
            cuts.append(np.stack([np.stack([part.keys(k)[one], part.keys(size - k)[one + k]], axis=1)
                                  for k in range(1, size)], axis=1).reshape(-1, 2).view(np.int64))
        at, *rows, words, size = (np.concatenate(c) for c in columns)
        both = np.concatenate(cuts)
        spans = [pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()) for n in (size, size - 1)]
        pairs = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["left", "right"])
        return pa.RecordBatch.from_arrays(
            [part.lang(at), *map(pa.array, rows), pa.ListArray.from_arrays(spans[0], pa.array(words)),
             pa.ListArray.from_arrays(spans[1], pairs)], names=[c.split()[0] for c in DESCRIBED.split(", ")])

    return (_over_codes(codes, DESCRIBED, work).groupBy("lang", "key")
            .agg(F.sum("a").alias("a"), F.min("before_lo").alias("before_lo"), F.max("before_hi").alias("before_hi"),
                 F.min("after_lo").alias("after_lo"), F.max("after_hi").alias("after_hi"),
                 F.first("parts").alias("parts"),
                 F.when(F.min("words") == F.max("words"), F.min("words"))
                 .otherwise(F.raise_error(F.lit("two phrases share a digest"))).alias("words")))


def scored(candidates: DataFrame, lefts: DataFrame, rights: DataFrame) -> DataFrame:
    """(lang, key, words, a, l, r, n, score) by the lowest-scoring cut, ties to the earliest."""
    cuts = candidates.select("lang", "key", "words", "a", "n", F.posexplode("parts").alias("cut", "part"))
    cuts = cuts.select("lang", "key", "words", "a", "n", "cut", "part.left", "part.right")
    cuts = cuts.join(lefts.select("lang", F.col("key").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(rights.select("lang", F.col("key").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    best = cuts.groupBy("lang", "key").agg(
        F.min(F.struct(F.expr(SCORE).alias("score"), "cut", "l", "r", "words", "a", "n")).alias("best"))
    return best.select("lang", "key", "best.words", "best.a", "best.l", "best.r", "best.n", "best.score")


def with_text(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` with their phrase: its words joined by one space."""
    each = rows.select("lang", "key", F.posexplode("words").alias("place", "one"))
    each = each.join(words.select("lang", F.col("key").alias("one"), "word"), ["lang", "one"])
    texts = each.groupBy("lang", "key").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("in_order"))
    return rows.join(texts.select("lang", "key", F.array_join("in_order.word", " ").alias("phrase")), ["lang", "key"])


def _cell(x: str):
    return F.floor(F.log2(F.greatest(F.col(x), F.lit(1)).cast("double")) * STEP).cast("int")


def thresholds(scores: DataFrame, top: int) -> DataFrame:
    """(lang, floor): a score that the ``top``-th best of its language reaches; no row for a language with fewer.  A
    histogram of scores is summed, not sorted: a language has at most a thousand cells."""
    cells = scores.groupBy("lang", _cell("score").alias("cell")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("score").alias("low"))
    upto = Window.partitionBy("lang").orderBy(F.col("cell").desc())
    return (cells.withColumn("upto", F.sum("rows").over(upto)).where(F.col("upto") >= top)
            .groupBy("lang").agg(F.max("low").alias("floor")))


def frontier_limits(words: DataFrame, share: float) -> DataFrame:
    """(lang, last): the cell of counts up to which a language's rarest frequent words make up ``share`` of its words
    (the last cell, when all of them make up less)."""
    cells = words.groupBy("lang", "cell", "n").agg(F.sum("f").alias("f"))
    upto = Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("f").over(upto), F.lit(0)))
    return cells.where(F.col("ahead") < share * F.col("n")).groupBy("lang").agg(F.max("cell").alias("last"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST, top: int = TOP,
         shares: tuple[float, ...] = SHARES) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score, by score, then a (both
    descending), then phrase.

    Texts are lower-cased (A-Z), cut at ``. , ; : ! ?`` and line ends into pieces and those at spaces and tabs into words;
    a phrase lies in one piece.  Candidates have 2 to ``most`` words and occur at least ``least`` times, overlaps
    included; one that lies in a longer candidate of the same count is dropped.  A null language is ``und``; null,
    empty and blank texts have no words; repeated rows count as often as they stand; other columns are not read; without
    candidates there are no rows.  Products are exact (38 decimal digits)."""
    docs = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("body"))
    counts = stored(word_counts(docs), "words")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counts.where(F.col("f") >= least).join(totals, "lang").withColumn("cell", _cell("f"))
    words = stored(words, "frequent-words")
    if not words.groupBy("key").count().where("count > 1").isEmpty():
        raise RuntimeError("two words share a digest")
    codes = stored(coded(docs, Members.of(words)), "codes")
    survivors, floors, done = None, None, None
    for share in shares:
        limit = frontier_limits(words, share)
        front = words.join(limit, "lang").where(F.col("cell") <= F.col("last"))
        if floors is not None:
            front = front.join(done, "lang", "left").where(F.col("cell") > F.coalesce("done", F.lit(-1)))
            front = front.join(floors, "lang", "left").where(
                F.expr("1000 * CAST(n AS DECIMAL(19, 0)) div f") >= F.coalesce("floor", F.lit(0)))
        front = stored(front.select("lang", "key"), "frontier")
        done = limit.withColumnRenamed("last", "done")
        if front.isEmpty():
            continue
        found = stored(_expanded(codes, words, front, least, most), "collocations")
        survivors = found if survivors is None else survivors.unionByName(found)
        floors = stored(thresholds(survivors, top), "floors")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    if survivors is None:
        survivors, floors = _no_rows(docs), _no_rows(docs).select("lang", F.col("score").alias("floor"))
    rows = survivors.join(floors, "lang", "left").where(F.col("score") >= F.coalesce("floor", F.lit(0)))
    return (with_text(rows, words).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def _no_rows(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame(
        [], "lang string, key long, words array<long>, a long, l long, r long, n long, score long")


def _expanded(codes: DataFrame, words: DataFrame, front: DataFrame, least: int, most: int) -> DataFrame:
    """The surviving candidates that begin with a word of ``front``, scored."""
    starts_in = Members.of(front)
    levels, prefixes_in = [], None
    for sizes in _steps(most):
        level = grown(codes, sizes, starts_in, prefixes_in).where(F.col("f") >= least)
        level = stored(level, f"grown-{sizes[0]}")
        if level.isEmpty():
            break
        levels.append(level)
        prefixes_in = Members.of(level)
    if not levels:
        return _no_rows(codes)
    known = levels[0]
    for level in levels[1:]:
        known = known.unionByName(level)
    all_found = described(codes, most, Members.of(known), starts_in).where(F.col("a") >= least)
    # The bitmap of first words may hold others: their phrases belong to another round.
    first = F.get(F.col("parts"), F.lit(0))["left"]
    all_found = all_found.withColumn("first", first).join(
        front.select("lang", F.col("key").alias("first")), ["lang", "first"], "left_semi")
    all_found = stored(all_found, "described")
    inside = ((F.col("before_lo") == F.col("before_hi")) & (F.col("before_lo") != 0)
              | (F.col("after_lo") == F.col("after_hi")) & (F.col("after_lo") != 0))
    kept = all_found.where((F.size("words") == most) | ~inside)
    totals = words.groupBy("lang").agg(F.max("n").alias("n"))
    kept = kept.select("lang", "key", "words", "a", "parts").join(totals, "lang")
    # Rests of two words or more begin elsewhere: counted where a survivor has them.
    rests = kept.select(F.explode(F.expr("slice(parts, 1, size(parts) - 1).right")).alias("key"))
    singles = words.select("lang", "key", "f")
    rights = counts_of(codes, range(2, most), Members.of(rests)) if most > 2 else singles.limit(0)
    lefts = singles.unionByName(all_found.select("lang", "key", F.col("a").alias("f")))
    return scored(kept, lefts, singles.unionByName(rights))


def _steps(most: int) -> list[tuple[int, ...]]:
    """Lengths counted together: two, three, then all longer ones (few places have a frequent prefix of three words)."""
    return [s for s in ((2,), (3,), tuple(range(4, most + 1))) if s and s[0] <= most]
