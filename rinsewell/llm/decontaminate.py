"""Benchmark decontamination: seeds of few words, then Smith-Waterman alignment.

Seeds are pairs of words that stand one or two apart, in the test items and in the documents alike. Between two words of
an alignment that match, one after the other, may stand words that differ, are missing or are new, each for a cost of one.
With more than one between every two, an alignment's score is two at most; each pair with none or one is a seed that both
sides share and adds two at most. So an alignment of ``threshold`` times the best score of an item of n words holds
``threshold * n - 1`` seeds at least, and is nowhere longer than the cost left allows. Places where as many seeds of
an item stand together are passages; the many places of a frequent seed alone are none. This loses nothing, however a copy
was edited. Passages that hold too few of the item's words to reach the threshold are passed over, which loses nothing either;
the others are aligned with the item word by word, and the score is the share of the best score that an unchanged copy
would reach, so edited and paraphrased copies count. What stands before and after an alignment that counts is aligned
again, so that several copies in one passage are all found.

Words are compared without ASCII case and without ASCII punctuation at their ends. The benchmark is
worked off in blocks of at most ``BLOCK_CHARS`` characters; a block's items and seeds are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsewell.functions.names import col

from .words import Words, mix, slices, words

SEED_WORDS = 3  # of an item at least
APART = (1, 2)  # the words of a seed
THRESHOLD = 0.4
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_CHARS = 20_000_000
_CELLS = 1 << 19  # of alignments made at once
_HITS = 1 << 21  # pairs of a place and an item that are looked at at once
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _normal(column: pa.Array) -> tuple[Words, np.ndarray]:
    found = words(column)
    for _ in range(4):
        found.ends -= (found.ends - found.starts > 1) & _PUNCTUATION[found.data[found.ends - 1]]
        found.starts += (found.ends - found.starts > 1) & _PUNCTUATION[found.data[np.minimum(found.starts, len(found.data) - 1)]]
    return found, found.hashes(lower=True)


def _pairs(hashes: np.ndarray, apart: int) -> np.ndarray:
    return mix(hashes[:-apart] * _STEP + hashes[apart:])


@dataclass
class Items:
    """A block of test items: their words, and where their seeds stand."""

    ids: list
    words: list[np.ndarray]
    size: np.ndarray
    seeds: np.ndarray  # distinct, sorted
    key: np.ndarray  # number of the seed * number of items + index of the item, sorted
    at: np.ndarray  # the seed's place in the item

    @staticmethod
    def of(rows: pa.Table) -> Items:
        found, hashes = _normal(rows.column("text").combine_chunks())
        own = [hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        seed, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, h in enumerate(own):
            for apart in APART if len(h) >= SEED_WORDS else ():
                pairs = _pairs(h, apart)
                seed.append(pairs)
                item.append(np.full(len(pairs), i))
                at.append(np.arange(len(pairs)))
        seeds, number = np.unique(np.concatenate(seed), return_inverse=True)
        key, at = number * len(own) + np.concatenate(item), np.concatenate(at)
        order = np.argsort(key, kind="stable")
        return Items(rows.column("item").to_pylist(), own, np.array([len(w) for w in own], np.int64), seeds, key[order], at[order])


def _places(found: Words, hashes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the seeds in the texts, and which seed each is."""
    places, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    passes = np.zeros(1 << 20, bool)
    passes[seeds >> np.uint64(44)] = True
    for apart in APART:
        if len(hashes) <= apart or not len(seeds):
            continue
        own = _pairs(hashes, apart)
        place = np.flatnonzero(passes[own >> np.uint64(44)])
        at = np.minimum(np.searchsorted(seeds, own[place]), len(seeds) - 1)
        same = (seeds[at] == own[place]) & (found.doc[place] == found.doc[place + apart])
        places.append(place[same])
        which.append(at[same])
    return np.concatenate(places), np.concatenate(which)


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> list[tuple[float, int, int]]:
    """For each pair: the share of the item's best score, and the words of the passage that align, as a range."""
    rows, width = max(map(len, passages)), max(map(len, items))
    left = np.zeros((len(items), rows), np.uint64)
    right = np.zeros((len(items), width), np.uint64)
    inside = np.zeros((len(items), width), bool)
    for i, (passage, item) in enumerate(zip(passages, items, strict=True)):
        left[i, : len(passage)], right[i, : len(item)], inside[i, : len(item)] = passage, item, True
    size = np.array([len(p) for p in passages])
    # A cell is its score, in units of 2**32, less the place where its alignment starts: one maximum keeps both.
    unit = 1 << 32
    steps = -GAP * unit * np.arange(width, dtype=np.int64)
    above = np.zeros((len(items), width + 1), np.int64)
    best, stop = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    for row in range(rows):
        fresh = -row
        score = np.where((left[:, row, None] == right) & inside, MATCH * unit, MISMATCH * unit)
        cell = np.maximum(above[:, :-1] + score, above[:, 1:] + GAP * unit)
        np.maximum(cell, fresh, out=cell)
        cell = np.maximum.accumulate(cell + steps, axis=1) - steps
        cell = np.where(cell + row < unit // 2, fresh - 1, cell)
        top = cell.max(axis=1)
        better = ((top + unit - 1) >> 32 > (best + unit - 1) >> 32) & (row < size)
        best, stop = np.where(better, top, best), np.where(better, row + 1, stop)
        above = np.concatenate([np.full((len(items), 1), fresh - 1), cell], axis=1)
    scores = (best + unit - 1) >> 32
    starts = scores * unit - best
    return [(s / (MATCH * len(item)), int(a), int(b)) for s, a, b, item in zip(scores.tolist(), starts, stop, items, strict=True)]


def _passages(found: Words, hashes: np.ndarray, items: Items, threshold: float) -> list[list[int]]:
    """(row, item, first word, last word + 1) wherever enough seeds of an item stand together, joined where they overlap."""
    places, which = _places(found, hashes, items.seeds)
    out: list[list[int]] = []
    n = len(items.words)
    ranges = [(0, n)] if len(places) else []
    while ranges:
        low, high = ranges.pop()
        first = np.searchsorted(items.key, which * n + low)
        times = np.searchsorted(items.key, which * n + high) - first
        if times.sum() > _HITS and high - low > 1:  # a frequent seed of very many items: some items at a time
            ranges += [(low, (low + high) // 2), ((low + high) // 2, high)]
            continue
        place = np.repeat(places, times)
        entry = np.repeat(first, times) + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)
        out += _together(found, place, items.key[entry] % n, items.at[entry], items.size, threshold)
    return out


def _together(found: Words, place: np.ndarray, item: np.ndarray, at: np.ndarray, sizes: np.ndarray, threshold: float) -> list[list[int]]:
    row = found.doc[place]
    order = np.lexsort((at, place, item, row))
    place, item, at, row = place[order], item[order], at[order], row[order]
    size = sizes[item]
    need = np.maximum(1, np.ceil(threshold * size - 1 - 1e-9)).astype(np.int64)
    spare = np.floor(MATCH * (1 - threshold) * size + 1e-9).astype(np.int64)  # words that differ, are missing or are new
    last = np.arange(len(place)) + need - 1
    inside = last < len(place)
    last = np.where(inside, last, 0)
    enough = inside & (row[last] == row) & (item[last] == item) & (place[last] - place <= size + spare)
    # Of each that has enough after it, all of these count.
    marks = np.zeros(len(place) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(enough), 1)
    np.add.at(marks, last[enough] + 1, -1)
    some = np.cumsum(marks[:-1]) > 0
    place, item, at, row, size, spare = (x[some] for x in (place, item, at, row, size, spare))
    low = np.maximum(found.first[row], place - at - spare)
    high = np.minimum(found.first[row + 1], place - at + size + spare)
    order = np.lexsort((low, item, row))
    out: list[list[int]] = []
    for r, i, a, b in zip(*(x[order].tolist() for x in (row, item, low, high)), strict=True):
        if out and out[-1][0] == r and out[-1][1] == i and a < out[-1][3]:
            out[-1][3] = max(out[-1][3], b)
        else:
            out.append([r, i, a, b])
    return out


def _shared(passage: np.ndarray, item: np.ndarray) -> float:
    """The share of the item's words that the passage holds: no alignment of the two scores more."""
    return np.count_nonzero(np.isin(item, passage)) / len(item)


def _leaks(docs: DataFrame, items, threshold: float, schema: T.StructType) -> DataFrame:
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        for batch in batches:
            for part in slices(batch, "text"):
                found, hashes = _normal(part.column("text"))
                passages, rows = _passages(found, hashes, own, threshold), []
                while passages:
                    passages = [(r, i, a, b) for r, i, a, b in passages if _shared(hashes[a:b], own.words[i]) >= threshold]
                    rest, at = [], 0
                    while at < len(passages):
                        stop, width, high = at, 0, 0
                        while stop < len(passages):
                            _, i, a, b = passages[stop]
                            width, high = max(width, len(own.words[i])), max(high, b - a)
                            if stop > at and (stop + 1 - at) * max(width, high) > _CELLS:
                                break
                            stop += 1
                        group = passages[at:stop]
                        scores = align([hashes[a:b] for _, _, a, b in group], [own.words[i] for _, i, _, _ in group])
                        for (r, i, a, b), (score, low, high) in zip(group, scores, strict=True):
                            if score >= threshold:
                                rows.append((r, own.ids[i], int(a + low - found.first[r]), high - low, score))
                                rest += [(r, i, a, a + low), (r, i, a + high, b)]
                        at = stop
                    passages = rest
                if rows:
                    row, item, first, n, score = zip(*rows, strict=True)
                    keys = part.column(0).take(pa.array(row))
                    arrays = [keys, pa.array(item, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(score, pa.float64())]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_id, first_word, n_words, score: a row for each passage of a document that aligns with a test item
    at ``threshold`` or more.

    ``benchmark`` has item_id and text. Null and empty texts, and items of fewer than SEED_WORDS words, match
    nothing; all others are found wherever they reach the threshold, which must be more than a third. Repeated rows on either side give rows of their own. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(col(key).alias("key"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType)])
    for name in ("item_id", "first_word", "n_words"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("score", T.DoubleType())
    tests = benchmark.select(F.col("item_id").cast("long").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    found = None
    for block in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        items = spark.sparkContext.broadcast(Items.of(part.toArrow()))
        leaks = _leaks(rows, items, threshold, schema)
        found = leaks if found is None else found.unionByName(leaks)
    return spark.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no test item leaked. Rows that share a key share their fate; rows without
    a key are judged together."""
    leaked = find_leaks(docs, benchmark, threshold, key, text).select(col(key).alias("__rw_key")).distinct()
    return docs.join(leaked, col(key).eqNullSafe(F.col("__rw_key")), "left_anti")
