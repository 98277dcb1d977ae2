"""Names of a directory found in free text (P10, X4): every name, in any row's text.

A name occurs where its words (runs of letters and digits, in any case) follow one another; what stands between
two of them does not matter.  All names are looked for at once: a trie of names over word hashes, whose states
(hashes of the words read so far) are kept as a bitmap of bounded size instead of a table.  Each text is walked
from each of its words for as long as the trie goes on, which for nearly all words ends at once.  Only the places
where a name may end leave their row; there they meet the names in a join on the words themselves, so a
chance hit of the bitmap costs a row of that join and never changes a result.

The directory is never broadcast: the bitmap has 16 bits per state up to ``MAX_BITS`` (32 MB).  Beyond some 30
million names it fills up and lets more chance hits through; results stay the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendflow import params as P
from lendflow.session import materialize

WORD, BREAK = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
MIN_BITS, MAX_BITS = 15, 28              # powers of two
BITS_PER_STATE = 16
SALTS = 32                               # parts that the places of a frequent name are spread over
FREQUENT, MOST_FREQUENT = 1 << 14, 1000  # a name with so many places, and one in so many of all places, is frequent

_BLOCK = 15                              # 2^15 bits to a row of Spark's bitmap aggregate
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_GOES_ON, _ENDS = np.uint64(0), np.uint64(0x5851F42D4C957F2D)
SPANS = "array<struct<start:int,n:int>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x) -> Column:
    """The lower-cased words of a text (null for null)."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def person_key(x) -> Column:
    """The words of a name, joined by single spaces: equal keys are one person's name to this module."""
    return F.array_join(words(x), " ")


def _hashes(x) -> Column:
    return F.transform(F.regexp_extract_all(_c(x), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))


# --- the trie as a bitmap -----------------------------------------------------------------------------
def _step(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    state = (state ^ word) * _STEP
    return state ^ (state >> np.uint64(29))


def _spots(state: np.ndarray, kind: np.uint64, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a state that goes on, or at which a name ends."""
    first = (state ^ kind) * _SPREAD
    second = (first ^ (first >> np.uint64(31))) * _STEP
    return first >> np.uint64(64 - bits), second >> np.uint64(64 - bits)


def _walk(lists: pa.ListArray):
    """Word hashes of all lists, and for each the end of its list and its list's start."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    return flat, offsets, np.repeat(offsets[1:], sizes), np.repeat(offsets[:-1], sizes)


def _state_bits(bits: int):
    def emit(batches):
        for batch in batches:
            flat, offsets, _, _ = _walk(batch.column(0))
            at, ends = offsets[:-1].copy(), offsets[1:]
            state = np.zeros(len(at), np.uint64)
            while len(at):
                state = _step(state, flat[at])
                done = at + 1 == ends
                spots = [*_spots(state, _GOES_ON, bits), *_spots(state[done], _ENDS, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(spots).astype(np.int64))], ["bit"])
                at, ends, state = at[~done] + 1, ends[~done], state[~done]
    return emit


class NameTrie:
    """Names (person, n, hashes), written once, and the bitmap of their trie (broadcast to the executors)."""

    def __init__(self, directory: DataFrame, name: str = "real_name"):
        spark = directory.sparkSession
        distinct = directory.select(person_key(f"`{name}`").alias("person")).where("person <> ''").distinct()
        self.names = materialize(distinct.withColumn("hashes", F.transform(F.split("person", " "), lambda w: F.xxhash64(w)))
                                 .withColumn("n", F.size("hashes")), "names")
        size = self.names.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("names"),
                              F.coalesce(F.max("n"), F.lit(0)).alias("longest")).first()
        states = size.words + size.names
        self.longest = size.longest
        self.bits = min(max((states * BITS_PER_STATE).bit_length(), MIN_BITS), MAX_BITS)
        found = self.names.select("hashes").mapInArrow(_state_bits(self.bits), "bit long")
        blocks = (found.groupBy(F.shiftright("bit", _BLOCK).cast("int").alias("block"))
                  .agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit((1 << _BLOCK) - 1))).alias("bitmap")))
        bitmap = np.zeros(1 << (self.bits - 3), np.uint8)
        width = 1 << (_BLOCK - 3)
        for row in blocks.collect():                         # at most 8,192 rows of 4 KB
            bitmap[row.block * width:(row.block + 1) * width] = np.frombuffer(row.bitmap, np.uint8)
        self.bitmap = spark.sparkContext.broadcast(bitmap)

    def spans(self, text) -> Column:
        """Where names may stand in a text: (first word, words), exact but for chance hits of the bitmap."""
        bitmap, bits, longest = self.bitmap, self.bits, self.longest

        def scan(hashes: pa.Array) -> pa.Array:
            table = bitmap.value

            def has(state, kind):
                one, two = _spots(state, kind, bits)
                return (((table[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8))
                         & (table[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)

            flat, offsets, ends, starts = _walk(hashes)
            at, state = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
            found, lengths = [], []
            for depth in range(1, longest + 1):
                state = _step(state, flat[at + depth - 1])
                alive = has(state, _GOES_ON)
                at, state = at[alive], state[alive]
                over = has(state, _ENDS)
                found.append(at[over])
                lengths.append(np.full(int(over.sum()), depth, np.int32))
                alive = at + depth < ends[at]
                at, state = at[alive], state[alive]
                if not len(at):
                    break
            place = np.concatenate(found) if found else np.zeros(0, np.int64)
            n = np.concatenate(lengths) if lengths else np.zeros(0, np.int32)
            order = np.argsort(place, kind="stable")
            place, n = place[order], n[order]
            marks = pa.StructArray.from_arrays([pa.array((place - starts[place]).astype(np.int32)), pa.array(n)],
                                               names=["start", "n"])
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(place, offsets).astype(np.int32)), marks)

        return F.arrow_udf(scan, SPANS)(F.coalesce(_hashes(text), F.array().cast("array<bigint>")))


# --- occurrences --------------------------------------------------------------------------------------
def _staged(rows: DataFrame, trie: NameTrie, text: str) -> DataFrame:
    """Rows, their number and the places to look at, written once: numbers and places stay what they are."""
    return materialize(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
                                   F.monotonically_increasing_id().alias("rid"),
                                   trie.spans(f"`{text}`").alias("places")), "people")


def _salts(persons: DataFrame) -> tuple[Column, Column]:
    """For the columns person and rid the part that a place goes to, and the parts that its name goes to: one, but for
    the frequent names (at most ``MOST_FREQUENT``, found by their counts)."""
    total = persons.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    frequent = persons.where(F.col("places") > max(FREQUENT, total // MOST_FREQUENT))
    names = [r[0] for r in frequent.select(F.xxhash64("person")).collect()]
    spread = F.xxhash64("person").isin(names) if names else F.lit(False)
    return (F.when(spread, F.pmod("rid", F.lit(SALTS)).cast("int")).otherwise(0),
            F.when(spread, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))


def _occurrences(staged: DataFrame, trie: NameTrie, text: str, *keep: str, wanted: Column | None = None) -> DataFrame:
    """(rid, start, n, person) and the kept columns of every occurrence of a name, of those ``wanted`` (a condition on
    these columns) only."""
    # The outer transform binds the words once for all places of a text.
    marked = F.transform(F.array(words(f"row.`{text}`")), lambda ws: F.transform("places", lambda p: F.struct(
        p["start"].alias("start"), p["n"].alias("n"),
        F.array_join(F.slice(ws, p["start"] + 1, p["n"]), " ").alias("person"))))[0]
    places = (staged.where(F.size("places") > 0)
              .select("rid", *[F.col(f"row.`{c}`").alias(c) for c in keep], F.inline(marked)))
    places = materialize(places if wanted is None else places.where(wanted), "places")
    persons = materialize(places.groupBy("person").agg(F.count(F.lit(1)).alias("places")), "persons")
    part, parts = _salts(persons)
    real = (persons.join(trie.names.select("person").hint("merge"), "person", "left_semi")
            .select("person", F.explode(parts).alias("salt"))
            .hint("merge"))                                  # Spark's estimate leaves the salts out: never broadcast
    return places.withColumn("salt", part).join(real, ["person", "salt"], "left_semi").drop("salt")


def find_people(rows: DataFrame, directory: DataFrame, text: str, keep=(), name: str = "real_name",
                trie: NameTrie | None = None, wanted: Column | None = None) -> DataFrame:
    """Every occurrence of every directory name in ``text``: (rid, the columns of ``keep``, start, n, person),
    start and n in words, rid a number of the row.  Overlapping occurrences all count.  Null and empty texts and
    names without a word give none; a name that stands twice in the directory is one name.  ``wanted``, a condition on
    the columns of the result, leaves out others before they meet the names."""
    trie = trie or NameTrie(directory, name)
    if not trie.longest:
        return rows.limit(0).select(F.lit(0).cast("long").alias("rid"), *[f"`{c}`" for c in keep],
                                    F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("person"))
    return _occurrences(_staged(rows, trie, text), trie, text, *keep, wanted=wanted)


def _rebuilt(texts: pa.Array, sizes: pa.Array, leads: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts with every stretch of overlapping occurrences replaced.  ``sizes``: code points of the words and of what is
    between them, in turn; ``leads``: whether a word comes first."""
    if not len(texts):
        return pa.array([], pa.string())

    def flat(lists):
        return lists.to_numpy(zero_copy_only=False).astype(np.int64)

    base = np.concatenate(([0], np.cumsum(flat(sizes.value_lengths()))))            # the first piece of each text
    ahead = np.concatenate(([0], np.cumsum(flat(sizes.flatten()))))                 # code points before each piece
    text_of = np.repeat(np.arange(len(texts)), flat(spans.value_lengths()))
    marks = spans.flatten()
    lo = (base[:-1] + 1 - flat(leads))[text_of] + 2 * flat(marks.field("start"))    # pieces of an occurrence: lo up to hi
    hi = lo + 2 * flat(marks.field("n")) - 1
    order = np.argsort(lo, kind="stable")
    lo, hi, text_of = lo[order], np.maximum.accumulate(hi[order]), text_of[order]
    first = np.flatnonzero(np.concatenate(([True], lo[1:] >= hi[:-1])) if len(lo) else np.zeros(0, bool))
    text_of, lo, hi = text_of[first], lo[first], hi[np.append(first[1:], len(hi)) - 1]
    start = ahead[base[text_of]]
    lows, highs = (ahead[lo] - start).tolist(), (ahead[hi] - start).tolist()
    stretches = np.searchsorted(text_of, np.arange(len(texts) + 1)).tolist()
    out = []
    for text, i, j in zip(texts.to_pylist(), stretches, stretches[1:]):
        new, done = [], 0
        for k in range(i, j):
            new += (text[done:lows[k]], P.MASKED_PERSON)
            done = highs[k]
        out.append("".join(new) + text[done:])
    return pa.array(out, pa.string())


def mask_people(rows: DataFrame, directory: DataFrame, text: str, name: str = "real_name",
                trie: NameTrie | None = None) -> DataFrame:
    """``rows`` with each occurrence of a directory name in ``text`` replaced by ``<PERSON>``, overlapping
    ones (those that share a word) by one.  All rows and other columns stay, repeated rows too; null stays null.
    Structured PII goes first (``mask_pii``): a mail address may hold the words of a name.  The text is used
    several times, so a costly expression should be written before (``session.materialize``)."""
    trie = trie or NameTrie(directory, name)
    if not trie.longest:
        return rows
    staged = _staged(rows, trie, text)
    spans = (_occurrences(staged, trie, text).groupBy("rid")
             .agg(F.collect_list(F.struct("start", "n")).alias("spans")).withColumnRenamed("rid", "hit"))
    old = F.col(f"row.`{text}`")

    def back(df: DataFrame, new: Column) -> DataFrame:
        return df.select(*[(new if c == text else F.col(f"row.`{c}`")).alias(c) for c in rows.columns])

    pieces = F.regexp_extract_all(old, F.lit(f"{WORD}|{BREAK}"), F.lit(0))
    sizes = F.transform(pieces, lambda p: F.length(p))
    masked = F.arrow_udf(_rebuilt, "string")(old, sizes, old.rlike(f"^{WORD}"), F.col("spans"))
    some = staged.where(F.size("places") > 0)
    touched = some.join(spans, F.col("rid") == F.col("hit"))
    chance = some.join(spans, F.col("rid") == F.col("hit"), "left_anti")
    return back(staged.where(F.size("places") == 0), old).union(back(chance, old)).union(back(touched, masked))


def people_leaks(rows: DataFrame, directory: DataFrame, text_columns, name: str = "real_name",
                 own: str | None = None) -> DataFrame:
    """(column_name, n_rows): per text column the rows (``application_id`` tells whose) that hold a directory
    name which is no part of the application's own (the column ``own`` of the rows, when they have met the directory
    already).  Columns without such a row are absent."""
    if own is None:
        own = "_own"
        rows = rows.join(directory.select("application_id", F.col(f"`{name}`").alias(own)), "application_id", "left")
    stacked = (rows.select(person_key(f"`{own}`").alias("own"),
                           *[F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(text_columns)])
               .select("own", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_t{i}").alias("text"))
                                                 for i, c in enumerate(text_columns)]))))
    spaced = [F.concat(F.lit(" "), F.coalesce(c, F.lit("")), F.lit(" ")) for c in (F.col("own"), F.col("person"))]
    found = find_people(stacked, directory, "text", ("column_name", "own"), name, wanted=~F.contains(*spaced))
    return (found.select("column_name", "rid").distinct()
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows")))
