"""Packing by cutting-stock column generation.

Documents of more tokens than a sequence are cut into full pieces and a remainder; the remainder is
cut once more where it passes a multiple of ``GRAIN``.  Pieces of whole grains fill sequences with
each other, and the pieces below one grain are small enough to leave little over.  A histogram of pieces by size class (at most ``capacity / unit`` rows
whatever the corpus) goes to the driver, where a linear program over patterns is solved by column
generation: a revised simplex keeps a basis of patterns, its duals price sizes, and a knapsack
dynamic program over the capacity finds the pattern that is worth most.  Pattern counts are rounded
down, what is left over (a few items a class) is packed first-fit by size, and pieces, ranked within
their class by a distributed rank, take the places of their class in the patterns.

Defined cases: null and empty texts are the end id alone; repeated rows are packed as often as they
occur; an empty table gives an empty result; further columns are ignored; ties are broken by all of
a piece's columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .encoding import shared_encoder
from .ranks import rank_within
from .scratch import Scratch, unused
from .worker import lean

CAPACITY, UNIT, END_ID = 2048, 4, 1
#: Remainders are cut at their last multiple of so many tokens.
GRAIN = 256
ROUNDS = 4000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(sizes: np.ndarray, capacity: int, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``sizes`` tokens (1 at least): the row, start and length of each piece."""
    full = (sizes - 1) // capacity
    rest = sizes - full * capacity
    twice = (rest > grain) & (rest < capacity) & (rest % grain > 0)
    count = full + 1 + twice
    row = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * capacity
    last = np.flatnonzero(nth == (count - 1)[row])
    last = last[twice[row[last]]]
    start[last] = sizes[row[last]] - rest[row[last]] % grain
    follows = np.append(start[1:], 0)
    end = np.where(np.append(row[1:] == row[:-1], False), follows, sizes[row])
    return row, start, end - start


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, grain: int = GRAIN) -> DataFrame:
    """Pieces of each document: start, length, digest of its ids (and the ids)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, ids, ends in shared_encoder(tokenizer_path).flat(batch.column(1), end_id):
                sizes = np.diff(ends)
                row, start, length = cuts(sizes, capacity, grain)
                at = ends[row] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[i:j]) for i, j in zip((4 * at).tolist(), (4 * (at + length)).tolist())]
                columns = [batch.column(0).take(pa.array(a + row)), *(pa.array(c, pa.int64()) for c in (start, length, crc, sizes[row]))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECE + ", ids array<int>" * with_ids)


def best_pattern(value: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: how often to take each size 1..len(value)."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    sizes = np.flatnonzero(value > 1e-12) + 1
    worth = value[sizes - 1]
    for c in range(1, capacity + 1):
        fit = int(np.searchsorted(sizes, c, side="right"))
        best[c], pick[c] = best[c - 1], 0
        if fit:
            total = best[c - sizes[:fit]] + worth[:fit]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-12:
                best[c], pick[c] = total[k], sizes[k]
    pattern, c = np.zeros(len(value), np.int64), capacity
    while c > 0:
        if pick[c]:
            pattern[pick[c] - 1] += 1
            c -= pick[c]
        else:
            c -= 1
    return pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan by array rows (threaded LAPACK can hang in a process that started a JVM)."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def solve(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, covering ``demand[i]`` items of size ``i + 1`` exactly.

    The linear program is min sum(x) with A x = demand over all patterns.  The basis starts with one
    homogeneous pattern a size; each round prices, replaces one column and updates the inverse.
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    m, need = len(sizes), demand[sizes - 1].astype(float)
    fit = capacity // sizes
    basis, inverse = np.diag(fit.astype(float)), np.diag(1.0 / fit)
    x = inverse @ need
    value = np.zeros(capacity)
    floor = float(need @ sizes) / capacity
    for step in range(rounds):
        dual = inverse.sum(axis=0)
        value[:] = 0
        value[sizes - 1] = dual
        column = best_pattern(value, capacity)[sizes - 1].astype(float)
        gain = float(dual @ column)
        # Farley's bound: the optimum is at least sum(x) / gain.
        if gain <= 1 + 1e-9 or x.sum() / gain >= x.sum() * (1 - 1e-4) or x.sum() <= floor * (1 + 1e-5):
            break
        d = inverse @ column
        rows = d > 1e-9
        if not rows.any():
            break
        ratio = np.where(rows, x / np.where(rows, d, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = column
        if step % 400 == 399:
            inverse = inverted(basis)
        else:
            row = inverse[leave] / d[leave]
            inverse -= np.outer(d, row)
            inverse[leave] = row
        x = np.maximum(inverse @ need, 0)
    used, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        pattern = np.zeros(len(demand), np.int64)
        pattern[sizes - 1] = basis[:, j].round().astype(np.int64)
        times = int(x[j] + 1e-7)
        if pattern.any():
            times = min(times, int((left[pattern > 0] // pattern[pattern > 0]).min()))
        if times and pattern.any():
            used.append((pattern, times))
            left -= times * pattern
    return used + first_fit(left, capacity)


def first_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Packs the items left by rounding: largest first, each time the largest that still fits."""
    left, out = left.copy(), []
    while left.any():
        pattern, room = np.zeros(len(left), np.int64), capacity
        while room:
            fits = np.flatnonzero(left[:room])
            if not len(fits):
                break
            k = int(fits[-1])
            n = min(int(left[k]), room // (k + 1))
            pattern[k] += n
            left[k] -= n
            room -= n * (k + 1)
        repeat = int((left[pattern > 0] // pattern[pattern > 0]).min()) if pattern.any() else 0
        left -= repeat * pattern
        out.append((pattern, 1 + repeat))
    return out


def places(patterns: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """Runs of places by class: from ``first`` on, ``per`` places a sequence from ``sequence`` on."""
    runs, sequence, filled = [], 0, {}
    for pattern, times in patterns:
        for k in np.flatnonzero(pattern):
            first = filled.get(k, 0)
            runs.append((k + 1, first, int(pattern[k]), sequence))
            filled[k] = first + times * int(pattern[k])
        sequence += times
    runs.sort()
    columns = list(zip(*runs)) or [[]] * 4
    return {n: np.array(c, np.int64) for n, c in zip(("size", "first", "per", "sequence"), columns)}


def pack(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces; further columns stay, unless they have these two names."""
    spark = cut.sparkSession
    tables = Scratch(spark, "packing")
    cut = cut.drop("sequence_id", "offset")
    own, nth = unused(cut, "__size"), unused(cut, "__rank")
    rows = tables.table("pieces", cut).withColumn(own, F.ceil(F.col("length") / F.lit(unit)).cast("long"))
    demand = np.zeros(capacity // unit, np.int64)
    for size, count in rows.groupBy(own).agg(F.count(F.lit(1))).collect():  # at most capacity / unit rows
        demand[size - 1] = count
    runs = places(solve(demand, capacity // unit))
    start = {int(k): int(i) for i, k in reversed(list(enumerate(runs["size"])))}
    stop = {int(k): int(i) + 1 for i, k in enumerate(runs["size"])}
    shared = spark.sparkContext.broadcast((runs, start, stop))  # a few thousand runs at most
    ranked = rank_within(tables, "rank", rows, own, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"], nth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, start, stop = shared.value
        for batch in batches:
            size, rank = batch.column(own).to_numpy(), batch.column(nth).to_numpy()
            sequence = np.empty(len(size), np.int64)
            for k in np.unique(size):
                at, a, b = size == k, start[int(k)], stop[int(k)]
                run = a + np.searchsorted(runs["first"][a:b], rank[at], side="right") - 1
                sequence[at] = runs["sequence"][run] + (rank[at] - runs["first"][run]) // runs["per"][run]
            yield batch.append_column("sequence_id", pa.array(sequence, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    placed = ranked.mapInArrow(place, f"{kinds}, sequence_id long")
    inside = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", nth).rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop(own, nth)
