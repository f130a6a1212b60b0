"""Operator 4: best-fit packing of tokenised documents, hierarchically.

Each task tokenises its documents and best-fits the pieces into bins; bins that
are nearly full are final.  The others become items of the next round: a tree
merge deals them to fewer tasks, which best-fit whole bins into one another.
A task never holds more than ``chunk`` items, however large its input.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendorlake.llm.common import fresh, stash

CAPACITY = 2048
END_ID = 0
#: Pieces that are best-fitted together where sequences keep an order.
WINDOW = 1024
TOKENIZER = "byte_bpe_50k"

_MEMBER = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
                        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                        T.StructField("ids_crc32", T.LongType()), T.StructField("offset", T.LongType())])
_BIN = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("members", T.ArrayType(_MEMBER))])


#: White space without end breaks the fast encoder's pattern matcher (its stack, at
#: a million); texts with this much in a row go to the ``tokenizers`` file itself.
LONG_RUN = 20_000


class Tokenizer:
    """Token ids of the public byte-level BPE, from its rank file: the ids of the
    ``tokenizers`` file of the same vocabulary, several times faster."""

    special, special_id = "<|endoftext|>", 50256

    def __init__(self, name: str = TOKENIZER):
        import base64
        import public_tokenizers as public
        import tiktoken
        self._name, self._plain = name, None
        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        self._bpe = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if len(text) > LONG_RUN and re.search(r"\s{%d}" % LONG_RUN, text):
            if self._plain is None:
                import public_tokenizers as public
                from tokenizers import Tokenizer as Plain
                self._plain = Plain.from_file(public.path(f"{self._name}.json"))
            return self._plain.encode(text, add_special_tokens=False).ids
        head, *rest = text.split(self.special)       # as the json file does: one id of its own
        out = self._bpe.encode_ordinary(head)
        for part in rest:
            out.append(self.special_id)
            out += self._bpe.encode_ordinary(part)
        return out


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but, maybe, the first."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by falling size, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0                                         # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins


def _flush(items: list[tuple[int, list[tuple]]], capacity: int) -> pa.RecordBatch:
    bins = best_fit([size for size, _ in items], capacity)
    flat = [m for b in bins for i in b for m in items[i][1]]
    ends = np.cumsum([0] + [sum(len(items[i][1]) for i in b) for b in bins], dtype=np.int32)
    doc, piece, start, length, crc = zip(*flat)
    before = np.cumsum((0,) + length, dtype=np.int64)
    offset = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    members = pa.StructArray.from_arrays(
        [pa.array(c, k) for c, k in zip((doc, piece, start, length, crc, offset), kinds)],
        names=[f.name for f in _MEMBER])
    return pa.RecordBatch.from_arrays(
        [pa.array([sum(items[i][0] for i in b) for b in bins], pa.int32()),
         pa.ListArray.from_arrays(pa.array(ends), members)], names=["size", "members"])


def _tokenise(capacity: int, chunk: int, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokenizer(tokenizer)
        items: list = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode.ids(text.as_py() or "") + [END_ID], dtype="<u4")
                for n, (start, size) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start:start + size].tobytes())
                    items.append((size, [(doc, n, start, size, crc)]))
                if len(items) >= chunk:
                    yield _flush(items, capacity)
                    items = []
        if items:
            yield _flush(items, capacity)
    return run


def _merge(capacity: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list = []
        for batch in batches:
            for size, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                items.append((size, [tuple(m.values())[:-1] for m in members]))
                if len(items) >= chunk:
                    yield _flush(items, capacity)
                    items = []
        if items:
            yield _flush(items, capacity)
    return run


_PLACED = T.StructType([*_BIN.fields, T.StructField("place", T.LongType()), T.StructField("nth", T.IntegerType())])


def _flush_placed(items: list, places: list[tuple[int, int]], n: int, capacity: int) -> pa.RecordBatch:
    """Bins of the first ``n`` items, which go, each with the least place in it."""
    bins = best_fit([size for size, _ in items[:n]], capacity)
    packed = _flush(items[:n], capacity)             # the same bins: best_fit has no chance in it
    least = [min(places[i] for i in b) for b in bins]
    del items[:n], places[:n]
    return pa.RecordBatch.from_arrays(
        [*packed.columns, pa.array([p for p, _ in least], pa.int64()), pa.array([n for _, n in least], pa.int32())],
        names=[f.name for f in _PLACED])


def _pack_windows(capacity: int, window: int, tokenizer: str):
    """Bins of at most ``window`` pieces at a time, rows (key, text, position)
    being sorted by position; each with its least position and the piece there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokenizer(tokenizer)
        items: list = []
        places: list[tuple[int, int]] = []
        for batch in batches:
            for doc, text, place in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = np.array(encode.ids(text.as_py() or "") + [END_ID], dtype="<u4")
                for n, (start, size) in enumerate(cut(len(ids), capacity)):
                    items.append((size, [(doc, n, start, size, zlib.crc32(ids[start:start + size].tobytes()))]))
                    places.append((place, n))
                while len(items) >= window:
                    yield _flush_placed(items, places, window, capacity)
        if items:
            yield _flush_placed(items, places, len(items), capacity)
    return run


def _merge_windows(capacity: int, chunk: int):
    """``_merge`` for bins with places, sorted by them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list = []
        places: list[tuple[int, int]] = []
        for batch in batches:
            for size, members, *place in zip(*(c.to_pylist() for c in batch.columns)):
                items.append((size, [tuple(m.values())[:-1] for m in members]))
                places.append(tuple(place))
                if len(items) >= chunk:
                    yield _flush_placed(items, places, len(items), capacity)
        if items:
            yield _flush_placed(items, places, len(items), capacity)
    return run


def pack_in_order(docs: DataFrame, position: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                  tokenizer: str = TOKENIZER, window: int = WINDOW, nearly_full: float = 0.99, chunk: int = 50_000) -> DataFrame:
    """What ``pack`` returns, with the sequences in the order of ``position`` (one
    number per row, all distinct): pieces are best-fitted within windows of
    consecutive positions, bins that are not nearly full then in ``pack``'s merge
    rounds, neighbours together, and sequence ids rise with the least position in a
    sequence.  A prefix of the sequences thus holds a prefix of the rows, but for a
    window and the few bins that were left open.
    """
    if not 1 <= capacity <= 1 << 20:
        raise ValueError("capacity out of range")
    rows = docs.select(F.col(key).cast("long"), text, F.col(position).cast("long").alias(fresh(docs, "_place")))
    rows = rows.repartitionByRange(rows.columns[2]).sortWithinPartitions(rows.columns[2])
    bins = stash(rows.mapInArrow(_pack_windows(capacity, window, tokenizer), _PLACED), "bins")

    def merge(open_bins: DataFrame, tasks: int) -> DataFrame:
        near = open_bins.repartitionByRange(tasks, "place", "nth").sortWithinPartitions("place", "nth")
        return near.mapInArrow(_merge_windows(capacity, chunk), _PLACED)

    packed = _merged(bins, capacity, nearly_full, chunk, merge)
    return _exploded(packed.repartitionByRange("place", "nth").sortWithinPartitions("place", "nth"))


def _merged(bins: DataFrame, capacity: int, nearly_full: float, chunk: int,
            merge: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """All bins after the merge rounds of those that are not nearly full.

    Rounds go on while such bins are left, each with at most about ``chunk`` of them
    to a task, until one task has seen all of them or a round saves less than one
    bin in 1000 (bins that fit nowhere)."""
    enough = int(capacity * nearly_full)
    done = [bins.where(F.col("size") >= enough)]
    open_bins = bins.where(F.col("size") < enough)
    count = open_bins.count()
    while count > 1:
        tasks = -(-count // chunk)
        merged = stash(merge(open_bins, tasks), "merged")
        done.append(merged.where(F.col("size") >= enough))
        open_bins, before = merged.where(F.col("size") < enough), count
        count, saved = open_bins.count(), before - merged.count()
        if tasks == 1 or saved * 1000 < before:
            break
    done.append(open_bins)
    return reduce(DataFrame.unionByName, done)


def _exploded(bins: DataFrame) -> DataFrame:
    return bins.withColumn("sequence_id", F.monotonically_increasing_id()).select(
        "sequence_id", F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         tokenizer: str = TOKENIZER, nearly_full: float = 0.99, chunk: int = 50_000) -> DataFrame:
    """Every piece of every document, with its sequence and place there.

    A document is its ids and one END_ID; documents longer than ``capacity`` are
    cut, the first piece taking the odd length.  Returns doc_id, piece, start,
    length, ids_crc32, sequence_id, offset.  Null text: empty, one id.  Null
    keys, repeated rows: packed like others.  An empty table gives no rows.

    Bins that are not nearly full are merged in rounds (``_merged``).
    """
    if not 1 <= capacity <= 1 << 20:
        raise ValueError("capacity out of range")
    bins = stash(docs.select(F.col(key).cast("long"), text).mapInArrow(_tokenise(capacity, chunk, tokenizer), _BIN), "bins")

    def merge(open_bins: DataFrame, tasks: int) -> DataFrame:
        return open_bins.repartition(tasks).mapInArrow(_merge(capacity, chunk), _BIN)

    return _exploded(_merged(bins, capacity, nearly_full, chunk, merge))
