"""Best-two-fit packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import functools
import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import Recent, checkpointed, lean, written

CAPACITY = 2048
#: Pieces that one task packs together: a group wastes one sequence at most more than the whole would.
GROUP_PIECES = 16_384
#: Words kept with their ids in a Python worker, twice at most.
CACHE_WORDS = 150_000


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@functools.cache
def plain_ends() -> frozenset[str]:
    """Letters and digits below U+0250 that stay one of these in lower case: after them punctuation is split off."""
    return frozenset(c for c in map(chr, range(0x250)) if c.isalnum() and len(c.lower()) == 1 and c.lower().isalnum() and unicodedata.is_normalized("NFC", c))


class WordIds(Recent):
    """The ids of each word as little-endian bytes.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its words, one after the other.  It composes
    characters, puts them in lower case and splits punctuation from a letter or
    digit before it, so ``Word,`` has the ids of ``word`` and of ``,``.  That is
    used only where neither step can change the other: marks are split off
    after ``plain_ends``, and letters are lowered in words without a character
    from U+0300 on, the first that composes with one before it.
    """

    MARKS = b".,;:!?"

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(most)
        self.tokenizer, self.ends = Tokenizer.from_file(path), plain_ends()

    def make(self, word: bytes) -> bytes:
        stem = word.rstrip(self.MARKS)
        if stem and len(stem) < len(word) and stem.decode()[-1] in self.ends:
            return self[stem] + self[word[len(stem) :]]
        # In UTF-8 characters from U+0300 on begin with 0xCC or more.  Special tokens are found before letters are lowered.
        if max(word) < 0xCC and b"<|" not in word and (low := word.lower()) != word:
            return self[low]
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def word_ids(path: str, most: int = CACHE_WORDS) -> WordIds:
    return WordIds(path, most)


def text_ids(text: bytes | None, path: str, most: int = CACHE_WORDS) -> bytes:
    """Ids of a text in UTF-8 and the closing id 0, four bytes each."""
    ids = word_ids(path, most)
    return b"".join([*map(ids.__getitem__, (text or b"").split()), b"\0\0\0\0"])


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row, on demand with its ids; null text is empty and so one id.

    Only documents longer than ``capacity`` are cut.  Null ids stay null and
    other columns are left out.
    """
    schema = PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4 * capacity
        for batch in batches:
            rows, parts = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = text_ids(text.as_py(), path, cache_words)
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        parts.append(part)
            if rows:
                columns = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), PIECES, strict=True)]
                if with_ids:
                    ends = pa.array(np.cumsum([0, *(r[3] for r in rows)]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(parts), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), out)


def best_two_fit(lengths: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions in ``lengths``, each with a sum of at most ``capacity``.

    A bin opens with the longest document left and is filled greedily with the
    longest that fits.  Then, if room is left, its smallest document (never the
    one it opened with) goes back for the two documents whose sum comes nearest
    to the room that this leaves, if they fill more of it.  Equal lengths are
    taken in the order of their positions.
    """
    waiting: dict[int, list[int]] = defaultdict(list)
    for k in sorted(range(len(lengths)), key=lambda k: -k):
        waiting[lengths[k]].append(k)
    there = 0  # bit n: a document of length n waits
    for n in waiting:
        there |= 1 << n

    def longest(limit: int) -> int:
        return (there & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 else -1

    def take(n: int) -> int:
        nonlocal there
        k = waiting[n].pop()
        if not waiting[n]:
            there &= ~(1 << n)
        return k

    def give(n: int, k: int) -> None:
        nonlocal there
        waiting[n].append(k)
        there |= 1 << n

    out = []
    while there:
        n = there.bit_length() - 1
        bin_, sizes, gap = [take(n)], [n], max(0, capacity - n)
        while (n := longest(gap)) > 0:
            bin_.append(take(n))
            sizes.append(n)
            gap -= n
        if gap and len(bin_) > 1:
            small = sizes[-1]
            room, best, pair = gap + small, small, None
            b = longest(room - 1)
            while b > 0 and 2 * b >= best:
                c = longest(min(b, room - b))
                if c == b and len(waiting[b]) < 2:
                    c = longest(b - 1)
                if c > 0 and b + c > best:
                    best, pair = b + c, (b, c)
                    if best == room:
                        break
                b = longest(b - 1)
            if pair:
                k = bin_.pop()
                bin_ += [take(pair[0]), take(pair[1])]
                give(small, k)
        out.append(bin_)
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Pieces go to groups by the hash of their row number, so that groups are
    even whatever the ids and lengths are, and each group is packed in one
    task, by lengths alone.  Repeated rows are packed as rows of their own; an
    empty table gives an empty result.
    """
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row").reset_index(drop=True)
        lengths = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, bin_ in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in bin_:
                sequence[i], offset[i] = k, at
                at += lengths[i]
        rows["sequence_id"] = (rows["group"].to_numpy(np.int64) << 32) | sequence
        rows["offset"] = offset
        return rows[["row", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    grouped = pieces.select("row", "doc_id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long").alias("group"))
    return grouped.groupBy("group").applyInPandas(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | Callable[[], str] = default_tokenizer, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Tokenize ``docs`` and pack the pieces: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    See ``tokenized_pieces`` and ``pack_pieces``.  Null texts are empty, null ids stay null, rows with the same id are
    documents of their own, and other columns of ``docs`` are left out, whatever their names.
    """
    pieces = tokenized_pieces(docs, path() if callable(path) else path, capacity, id_col, text_col, cache_words)
    return pack_pieces(checkpointed(pieces.withColumn("row", F.monotonically_increasing_id())), capacity, group_pieces).drop("row")


def pack_with_ids(docs: DataFrame, path: str | Callable[[], str] = default_tokenizer, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, cache_words: int = CACHE_WORDS) -> DataFrame:
    """As ``pack_documents``, with the ids of each piece (array<int>) and row, a number of the piece.

    Rows that share a document's id, as copies in a mix do, are told apart by
    row: pieces of one copy follow one another in it.  Packing moves lengths
    only; ids join their places by row.
    """
    pieces = tokenized_pieces(docs, path() if callable(path) else path, capacity, id_col, text_col, cache_words, True)
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()))
    return pack_pieces(pieces, capacity, group_pieces).join(pieces.select("row", "ids"), "row")


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as packed pieces with their ids: what a trainer reads.

    Null and empty texts are one id, the closing 0; documents without an id and
    those that share one are kept, told apart by row; an empty table gives an
    empty result.
    """
    return pack_with_ids(docs)
