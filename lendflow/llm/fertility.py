"""Quality rules on tokeniser fertility.

Two public vocabularies read every whole text.  The byte-level one gives characters per token and the entropy of the
text's tokens, in parts of the logarithm of their number (the most it could be); the piece vocabulary
gives the share of tokens that fall back to single bytes (white space apart).  Text in the language a document
claims sits in a narrow band of each; key smashing, mixed encodings, dumps and endless repetition do not.

The bands come from the corpus itself, per language and script: the median, and ``REACH`` times the distance
between the quartiles to either side, wider for short texts as their figures scatter more.  Figures are whole
thousandths, so a band is read off exact counts of a bounded number of values, the same in every run; a language
with few documents leans on its script's band with the weight of ``LEAN`` documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendflow.llm.common import mix64, shingle_hashes, stored, text_slices, word_hashes, word_spans
from lendflow.llm.packing import RANKS, TOKENIZER, Encoder, vocabulary_path

PIECES = "piece_bpe_32k.model"
LEAST_WORDS, MOST_REPEATED = 50, 50      # words; percent of words in repeated windows
WINDOW = 3                               # words
REACH = 3.0                              # quartile distances
LEAN = 32                                # documents
SHORT = 500                              # tokens: at this length a band is wider by the square root of two
NO_LANG = "und"
# Smallest distance between quartiles that counts, in thousandths: chars per token, fallback, entropy.
FIGURES = {"chars_per_token": 20, "fallback": 5, "entropy": 20}
SYMBOLS = b"#*$%&|<>"

# First code points of the blocks of common scripts; what is not listed is "other".
SCRIPTS = ((0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"),
           (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"),
           (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
           (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
           (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"))
_BLOCKS = np.array([b for b, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_CODE = np.array([_NAMES.index(n) for _, n in SCRIPTS])

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("doc_id long, lang string, script string, " + ", ".join(f"{c} long" for c in COUNTS)
            + ", n_tokens long, " + ", ".join(f"{c} long" for c in FIGURES))

_CONTINUED = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


@lru_cache(maxsize=4)
def _pieces(path: str):
    """The piece model of a task's worker, and which of its ids are bytes other than ASCII white space."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    space = {f"<0x{b:02X}>" for b in b" \t\n\x0b\x0c\r"}
    return model, np.array([model.is_byte(i) and model.id_to_piece(i) not in space for i in range(model.get_piece_size())])


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The figures of ``COUNTS`` for every text of a slice."""
    starts, ends, first = word_spans(raw, offsets)
    rows, words = len(offsets) - 1, np.diff(first)
    total = np.concatenate([[0], np.cumsum(~_CONTINUED[raw])])
    chars = np.concatenate([[0], np.cumsum(total[ends] - total[starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    # Windows of a text that begin at two places or more, each marking its words.
    keys, at = shingle_hashes(word_hashes(raw, starts, ends), first, WINDOW)
    row = np.repeat(np.arange(rows), np.diff(at))
    place = first[:-1][row] + np.arange(len(keys)) - at[:-1][row]
    whole = words[row] >= WINDOW
    keys, place = mix64(keys[whole] ^ mix64(row[whole].astype(np.uint64) + np.uint64(1))), place[whole]
    _, group, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = place[count[group] > 1]
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, again, 1)
    np.add.at(depth, again + WINDOW, -1)
    marked = np.concatenate([[0], np.cumsum(np.cumsum(depth[:-1]) > 0)])
    lines = np.zeros(rows, np.int64)
    for i in range(rows):
        seen: set[bytes] = set()
        for line in raw[offsets[i]:offsets[i + 1]].tobytes().split(b"\n"):
            if line in seen:
                lines[i] += 1
            elif line.strip():
                seen.add(line)
    return [words, np.diff(chars[first]), np.diff(symbols[offsets]), lines, np.diff(marked[first])]


def script_of(text: str) -> str:
    """The script that most letters of a text belong to (ties: first by name); ``none`` without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ascii_letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    count = np.bincount(_CODE[np.searchsorted(_BLOCKS, points[points >= 0xC0], side="right") - 1], minlength=len(_NAMES))
    count[_NAMES.index("latin")] += int(ascii_letter.sum())
    return _NAMES[int(count.argmax())] if count.any() else "none"


def token_figures(ids: np.ndarray, chars: int, pieces: np.ndarray, is_byte: np.ndarray) -> tuple[int, int, int, int]:
    """Tokens, then in thousandths: characters per token, share of byte fallback, entropy of the tokens as a part of
    the logarithm of their number (1000 for fewer than two)."""
    n = len(ids)
    if n == 0:
        return 0, 0, 0, 1000
    share = np.unique(ids, return_counts=True)[1] / n
    entropy = float(-(share * np.log2(share)).sum()) / math.log2(n) if n > 1 else 1.0
    fallback = int(is_byte[pieces].sum()) * 1000 // len(pieces) if len(pieces) else 0
    return n, 1000 * chars // n, fallback, math.floor(1000 * entropy + 0.5)


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", tokenizer: str | None = None,
            ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang (null: ``und``), script, the counts of ``COUNTS``, n_tokens and the
    figures of ``FIGURES`` in thousandths.  One pass over whole texts, a text at a time; null and empty texts have
    no words and no tokens.  Without paths the public vocabularies are taken."""
    path, ranks = (tokenizer, ranks) if tokenizer else (vocabulary_path(TOKENIZER), vocabulary_path(RANKS))
    piece_path = pieces or vocabulary_path(PIECES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (model, is_byte) = Encoder.of(path, ranks), _pieces(piece_path)
        for batch in batches:
            for lo, hi, raw, offsets in text_slices(batch, "body"):
                scripts, figures = [], []
                for i in range(hi - lo):
                    body = raw[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    scripts.append(script_of(body))
                    figures.append(token_figures(encoder.ids(body), len(body),
                                                 np.asarray(model.encode(body, num_threads=1), np.int64), is_byte))
                columns = base_counts(raw, offsets) + [np.array(c, np.int64) for c in zip(*figures, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("lang").slice(lo, hi - lo),
                     pa.array(scripts, pa.string()), *[pa.array(c, pa.int64()) for c in columns]],
                    names=[c.split()[0] for c in MEASURES.split(", ")])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("body"))
    return rows.mapInArrow(read, MEASURES)


def with_base(measured: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed``: too few words, or too many of them in repeated windows."""
    return measured.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def bands(measured: DataFrame, lean: int = LEAN) -> DataFrame:
    """(lang, script, then centre and width of every figure) over the rows that pass the base rules.  The values of a figure
    are counted, not sorted: a group has at most some thousands of them, whatever its rows."""
    passed = measured.where(~F.col("base_failed") & (F.col("n_tokens") > 0))
    figure = F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("value")) for c in FIGURES]))
    cells = (passed.select("lang", "script", figure.alias("f")).groupBy("lang", "script", "f.figure", "f.value")
             .agg(F.count(F.lit(1)).alias("rows")))
    own = _quartiles(cells, "lang", "script", "figure")
    wide = _quartiles(cells.groupBy("script", "figure", "value").agg(F.sum("rows").alias("rows")), "script", "figure")
    both = own.join(wide.select("script", "figure", F.col("median").alias("wide_median"), F.col("spread").alias("wide_spread")),
                    ["script", "figure"])

    def leant(name: str):
        return (F.col(name) * F.col("total") + F.col(f"wide_{name}") * lean) / (F.col("total") + lean)
    pairs = both.groupBy("lang", "script").agg(*[
        F.max(F.when(F.col("figure") == c, x)).alias(f"{c}_{n}")
        for c, least in FIGURES.items()
        for n, x in (("centre", leant("median")), ("width", F.greatest(leant("spread"), F.lit(float(least)))))])
    return pairs


def _quartiles(cells: DataFrame, *group: str) -> DataFrame:
    w = Window.partitionBy(*group)
    upto = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumns({"upto": F.sum("rows").over(upto), "total": F.sum("rows").over(w)})
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("value"))).alias(f"q{k}") for k in (1, 2, 3)]
    return ranked.groupBy(*group, "total").agg(*at).select(
        *group, "total", F.col("q2").alias("median"), (F.col("q3") - F.col("q1")).alias("spread"))


def judge(measured: DataFrame, found: DataFrame, reach: float = REACH) -> DataFrame:
    """``measured`` with ``reasons`` (figures outside their band, as ``figure:low`` or ``figure:high``) and ``kept``."""
    rows = measured.join(found, ["lang", "script"], "left")
    scale = F.lit(reach) * F.sqrt(1 + F.lit(float(SHORT)) / F.greatest(F.col("n_tokens"), F.lit(1)))
    checks = []
    for c in FIGURES:
        room = scale * F.col(f"{c}_width")
        if c != "fallback":                      # no text is worse for fewer bytes
            checks.append((f"{c}:low", F.col(c) < F.col(f"{c}_centre") - room))
        checks.append((f"{c}:high", F.col(c) > F.col(f"{c}_centre") + room))
    reasons = F.filter(F.array(*[F.when(x, F.lit(n)) for n, x in checks]), lambda r: r.isNotNull())
    rows = rows.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return rows.drop(*[f"{c}_{n}" for c in FIGURES for n in ("centre", "width")])


def quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", reach: float = REACH) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts of ``COUNTS``, base_failed, kept, then lang, script, n_tokens, the
    figures and the reasons.  ``kept`` is false for a text that fails the base rules, else whether all its figures lie in the
    bands of its language and script.  Null, empty and short texts fail; repeated rows are judged alike and count as
    often as they stand; other columns are not read; an empty table gives no rows."""
    measured = stored(with_base(measure(docs, text, doc_id, lang)), "fertility")
    return judge(measured, bands(measured), reach).select(
        "doc_id", *COUNTS, "base_failed", "kept", "lang", "script", "n_tokens", *FIGURES, "reasons")
