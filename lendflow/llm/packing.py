"""Packing documents into fixed-length token sequences.

Documents are tokenised and cut into pieces of at most ``length`` ids.  Whole-length pieces are sequences
of their own; the rest are dealt to randomised groups of about ``per_group`` pieces, and each group is
packed by first-fit decreasing: a tournament tree over the capacities left in the group's bins finds the
first bin that still holds a piece in logarithmic time.  Groups are bounded and independent.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendflow.llm.common import bucket_count, stored

LENGTH = 2048                        # ids of a sequence
END_ID = 1                           # appended to every document
PER_GROUP = 4096                     # pieces of a packing group, about
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_LOADED: dict[tuple[str, str | None], Encoder] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


class Encoder:
    """Ids of a text by a tokenizer file.  With the ranks of the same vocabulary, its pair merging runs in
    a faster library; texts that library refuses (white space runs of some 100,000) go to the tokenizer."""

    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark runs one task per core already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            if len(merges) + len(special) != self.tokenizer.get_vocab_size():
                raise ValueError(f"{ranks} is not the vocabulary of {path}")
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges,
                                          special_tokens=special)

    @classmethod
    def of(cls, path: str, ranks: str | None) -> Encoder:
        """The task's own copy, kept for the next task of the same worker."""
        if (path, ranks) not in _LOADED:
            _LOADED[path, ranks] = cls(path, ranks)
        return _LOADED[path, ranks]

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:
                pass
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None,
           ranks: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens (and ids: binary, unsigned
    32-bit little-endian, ``with_ids``).  A null or empty text has the one id ``end_id``.  Without a
    ``tokenizer`` the public one of ``TOKENIZER`` is taken, with its ranks."""
    path, ranks = (tokenizer, ranks) if tokenizer else (vocabulary_path(TOKENIZER), vocabulary_path(RANKS))
    names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(path, ranks), np.asarray([end_id], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encoder.ids(body.as_py() or ""), end])
                for at in range(0, len(ids), length):
                    piece = ids[at:at + length].tobytes()
                    rows.append((key, at, len(piece) // 4, zlib.crc32(piece), len(ids), *([piece] * with_ids)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.binary() if n == "ids" else pa.int64())
                 for n, c in zip(names, columns, strict=True)], names=names)

    schema = PIECES + (", ids binary" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, schema)


class Bins:
    """First-fit over bins of one capacity: a tournament tree whose inner nodes hold the largest room
    left below them."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)
        self.used = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with ``size`` left, which shrinks by it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had, at = room[node], node - self.leaves
        room[node] = had - size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        self.used = max(self.used, at + 1)
        return at, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; ``sizes`` must be in decreasing order and at most ``capacity``."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    whole = int((sizes == capacity).sum())                  # they come first and fill a bin each
    where[:whole] = np.arange(whole)
    bins = Bins(max(1, len(sizes) - whole), capacity)
    for i, size in enumerate(sizes[whole:].tolist(), whole):
        at, had = bins.place(size)
        where[i], offset[i] = whole + at, capacity - had
    return where, offset


def pack(pieces: DataFrame, length: int = LENGTH, per_group: int = PER_GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset (gapless from 0 within a sequence).

    Sequences hold at most ``length`` ids.  Ties in size go by doc_id, then start.  Empty in, empty out.
    """
    pieces = stored(pieces, "pieces")
    groups = bucket_count(pieces.count(), per_group)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))

    def one(group: tuple, rows: pa.Table) -> pa.Table:
        size, start = rows["length"].to_numpy(), rows["start"].to_numpy()
        ids = rows["doc_id"].combine_chunks()
        order = np.lexsort((start, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), -size))
        where, offset = first_fit_decreasing(size[order], length)
        return (rows.drop(["pack_group"]).take(pa.array(order))
                .append_column("sequence_id", pa.array((group[0].as_py() << 32) + where))
                .append_column("offset", pa.array(offset)))

    return dealt.groupBy("pack_group").applyInArrow(one, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids binary, n_ids): the pieces of each sequence joined and padded to ``length``
    ids, except where their number is a power of two.  ``packed`` must carry the pieces' ids; a
    sequence has at most ``length`` of them, so a group is bounded."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        body = b"".join(rows.sort_values("offset")["ids"])
        n = len(body) // 4
        fill = 0 if n & (n - 1) == 0 else length - n
        body += np.full(fill, pad_id, dtype="<u4").tobytes()
        return pd.DataFrame({"sequence_id": rows["sequence_id"].iloc[:1], "ids": [body], "n_ids": [n]})
    return (packed.select("sequence_id", "offset", "ids").groupBy("sequence_id")
            .applyInPandas(one, "sequence_id long, ids binary, n_ids long"))


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None,
                   ranks: str | None = None, length: int = LENGTH, end_id: int = END_ID,
                   per_group: int = PER_GROUP) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A null or empty text is its end id alone; null and repeated doc_ids are packed like any other; other
    columns are ignored; an empty input gives an empty result.
    """
    return pack(encode(docs, text, doc_id, tokenizer, ranks, length, end_id), length, per_group)
