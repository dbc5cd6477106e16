"""Packing of tokenised documents into sequences of equal length by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stforecast.llm.shared import query, table
from stforecast.llm.tokens import encoded

VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
CRC_SCHEMA = SCHEMA.replace("ids binary", "ids_crc32 long")


def closest_fill(lengths: list[int], counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length sum closest to ``target`` from below.

    Subset sums are the bits of one integer. Each length is offered in portions of 1, 2, 4 ...
    of its count; the sums before each portion are kept, so that the choice can be traced back.
    """
    sums, mask, steps = 1, (1 << (target + 1)) - 1, []
    for length in lengths:
        if length > target:
            continue
        left, portion = min(counts[length], target // length), 1
        while left:
            take = min(portion, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left, portion = left - take, portion * 2
        if sums >> target & 1:
            break
    total, used = sums.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] += take
            total -= length * take
    return dict(used)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Bins as (how many of each length, how often), the largest length left always taken first."""
    counts = {k: n for k, n in counts.items() if n}
    lengths = sorted(counts, reverse=True)
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        fill = closest_fill(lengths, counts, capacity - largest)
        counts[largest] += 1
        fill[largest] = fill.get(largest, 0) + 1
        times = min(counts[k] // n for k, n in fill.items())
        yield fill, times
        for k, n in fill.items():
            counts[k] -= n * times
        lengths = [k for k in lengths if counts[k]]


def cut_ends(pieces: list[tuple[int, int, int]], capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (document, start, length) put end to end and cut into full sequences; what is left
    over into powers of two, which need no padding."""
    total, size = sum(p[2] for p in pieces), capacity
    out, room = [], 0
    for doc, start, length in pieces:
        while length:
            if not room:
                size = capacity if total >= capacity else 1 << (total.bit_length() - 1)
                room, total = size, total - size
            part = min(length, room)
            out.append((doc, start, part))
            start, length, room = start + part, length - part, room - part
            if not room:
                yield out
                out = []


def plan_window(tokens: list[int], capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) for documents of so many tokens."""
    rests = defaultdict(list)
    for doc, n in enumerate(tokens):
        for start in range(0, n - capacity + 1, capacity):
            yield [(doc, start, capacity)]
        if n % capacity:
            rests[n % capacity].append(doc)
    loose = []
    for fill, times in minimum_bin_slack({k: len(v) for k, v in rests.items()}, capacity):
        for _ in range(times):
            bin_ = [(doc := rests[k].pop(), tokens[doc] - k, k) for k, n in fill.items() for _ in range(n)]
            if sum(p[2] for p in bin_) == capacity:
                yield bin_
            else:
                loose += bin_
    yield from cut_ends(loose, capacity)


def pack(
    docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 1, capacity: int = 2048, window: int = 8192,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A document is the ids of
    its whole text (null: none) and then ``end_id``, so an empty one is one token. It is cut at
    multiples of ``capacity``; what remains of each document is packed whole by minimum bin
    slack among the ``window`` documents that a task holds at a time. Bins that it cannot fill
    are cut: their pieces run on end to end, and the last part of a window is cut at powers of
    two. Every sequence is then full or a power of two. A null doc_id stays null; rows that
    repeat a doc_id are documents of their own. An empty table gives no pieces.

    Returns doc_id, start, length, ids (little-endian unsigned 32 bit; their CRC-32 as ids_crc32
    instead without ``with_ids``, taken where they are), doc_tokens, sequence_id
    (the task's number times 2^40 plus a count, unique, not dense) and offset in the sequence.
    Nothing is shuffled: a task tokenises, plans and writes its own rows, one window at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []  # runs of documents, each with where they start
        edges: list[np.ndarray] = []
        held = tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, tokens
            flat = np.concatenate(ids).astype("<u4")
            sizes = np.concatenate([np.diff(e) for e in edges])
            at = np.concatenate([[0], np.cumsum(sizes)])
            doc, start, length, sequence = [], [], [], []
            for pieces in plan_window(sizes.tolist(), capacity):
                for d, s, n in pieces:
                    doc.append(d)
                    start.append(s)
                    length.append(n)
                    sequence.append(number)
                number += 1
            doc, start, length, sequence = (np.array(x, np.int64) for x in (doc, start, length, sequence))
            before = np.cumsum(length) - length
            first = np.searchsorted(sequence, sequence)  # sequences follow each other
            raw = memoryview(flat).cast("B")
            begin = (at[doc] + start) * 4
            cut = [raw[a:b] for a, b in zip(begin.tolist(), (begin + length * 4).tolist(), strict=True)]
            third = pa.array(cut, pa.binary()) if with_ids else pa.array([zlib.crc32(c) for c in cut], pa.int64())
            known = pa.concat_arrays(names).take(pa.array(doc))
            out = [known, pa.array(start), pa.array(length), third, *map(pa.array, (sizes[doc], sequence, before - before[first]))]
            for one in (names, ids, edges):
                one.clear()
            held = tokens = 0
            return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for doc_id, flat, starts in encoded(batch, vocabulary, end_id):
                names.append(doc_id)
                ids.append(flat)
                edges.append(starts)
                held, tokens = held + len(doc_id), tokens + len(flat)
                if held >= window or tokens >= window * capacity:
                    yield flush()
        if held:
            yield flush()

    schema = SCHEMA if with_ids else CRC_SCHEMA
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
