"""Best-two-fit packing of token pieces into sequences.

Only lengths decide a packing, so the plan is made from the histogram of lengths (at most `capacity` entries at any size of corpus):
a bin is filled greedily, largest piece first; then its smallest piece makes room for the two unpacked pieces that fill the
expanded gap most tightly, if they fill it better. A bin pattern is repeated while the pieces for it last, which gives the
same bins as packing one by one and bounds the plan by about capacity x ln(capacity) patterns.

Pieces get their place by rank among pieces of the same length: the rank within the writing task plus the count in earlier
tasks, so no task ever sorts all pieces of a length. Null or empty texts are one piece that holds the end id alone. Repeated rows are
packed once each.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_ids import ByteIds
from .common import as_bytes, map_arrow, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, task_rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones behind a first that may be shorter."""
    first = n_ids % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Encode every whole text, append the end id and cut; ranks are within the task and the length."""

    def make():
        ids, end, seen = ByteIds(path), np.array([end_id], "<u4").tobytes(), Counter()
        task = TaskContext.get().partitionId()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, at = [], []
            for k, text in enumerate(as_bytes(batch.column(1))):
                coded = ids.encode(text).tobytes() + end
                for piece, (start, length) in enumerate(cut(len(coded) // 4, capacity)):
                    rows.append((piece, start, length, zlib.crc32(coded[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
                    at.append(k)
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), *[pa.int64()] * 5)
            return pa.record_batch([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"])

        return each

    return map_arrow(docs.select("doc_id", "text"), make, PIECES)


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a bin, number of such bins), in packing order."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left[length] = n
    sizes = np.arange(capacity + 1)
    plan = []
    while left.any():
        largest = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # the largest unpacked length up to each length
        room, pattern = capacity, Counter()
        while room and (size := int(largest[room])):
            used = min(int(left[size]) - pattern[size], room // size)
            pattern[size] += used
            room -= used * size
            if pattern[size] == left[size]:
                largest = np.maximum.accumulate(np.where(left - np.array([pattern.get(int(s), 0) for s in sizes]) > 0, sizes, 0)) if room else largest
        if room:
            smallest = min(s for s, k in pattern.items() if k)
            free = left.copy()
            for s, k in pattern.items():
                free[s] -= k
            gap = room + smallest
            first = sizes[1:gap][free[1:gap] > 0]
            if len(first):
                below = np.maximum.accumulate(np.where(free > 0, sizes, 0))
                second = below[gap - first]
                alone = (second == first) & (free[first] < 2)  # one piece can't be both
                second = np.where(alone, below[np.maximum(first - 1, 0)], second)
                sums = np.where(second > 0, first + second, 0)
                best = int(np.argmax(sums))
                if sums[best] > smallest:
                    pattern[smallest] -= 1
                    pattern[int(first[best])] += 1
                    pattern[int(second[best])] += 1
        pattern = {s: k for s, k in sorted(pattern.items(), reverse=True) if k}
        times = min(int(left[s]) // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[s] -= k * times
        plan.append((pattern, times))
    return plan


def place(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces in a bin, offset of the first) in order of rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length, k in pattern.items():
            found.setdefault(length, []).append((ranks[length], sequence, k, offset))
            ranks[length] += k * times
            offset += k * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """A row per piece with its sequence and offset."""
    pieces = stored(token_pieces(docs, capacity, end_id, path), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = stored(by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")), "ranks")
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = place(best_two_fit(histogram, capacity))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                rows = places[int(size)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                within = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + within // row[:, 2]
                offset[at] = row[:, 3] + within % row[:, 2] * size
            return pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        return each

    # the counts grow with tasks x lengths, so they are merged, never broadcast
    ranked = pieces.join(before.select("length", "task", "before").hint("merge"), ["length", "task"])
    return map_arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("task_rank")).alias("rank")), make, PLACED)
