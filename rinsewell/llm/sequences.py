"""Codes of word sequences, counted over all texts and looked up in tables of any size.

Texts are written in blocks of bounded size. A block asks about its distinct codes, in order and packed: one row for each
shard, which is a range of codes and has all that is asked about it. A shard answers each row about the codes that it knows;
the answers meet the texts of their block again. So only distinct codes are moved, at 6 bytes or so each, and no
task holds more than a block or a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsewell.functions.names import col

from .tables import keep
from .words import slices

BLOCK_BYTES = 8 << 20  # of text; a longer text is a block of its own
SHARD_BYTES = 8 << 20  # of text, for each shard
ROW_CODES = 1 << 14  # in a packed row at most: Java keeps values of half a megabyte and more apart from others, which wastes its memory

ASKED = "shard long, block long, level int, codes binary, n binary"
KNOWN = "shard long, block long, level int, codes binary, own binary, n binary"
HELD = "kind int, shard long, lang long, codes binary, data binary"

Taken = Callable[[np.ndarray], list[np.ndarray]]


def pack(values: np.ndarray) -> bytes:
    """64-bit integers byte by byte, the lowest of all first, as many as the greatest has, and how many these are."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(planes.T).tobytes() + bytes([width])


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, len(data) - 1).reshape(data[-1], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.uint64).ravel()


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes in order, by the steps between them."""
    return pack(np.diff(codes, prepend=np.uint64(0)))


def unpack_codes(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def in_blocks(rows: DataFrame, text: str, files: int) -> DataFrame:
    """``rows``, written with the block that each is in (column ``block``)."""
    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, at):
                own = part.column(at).nbytes
                if size and size + own > BLOCK_BYTES:
                    block, size = block + 1, 0
                size += own
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, block))], schema.names)

    return keep(rows.coalesce(files).mapInArrow(run, schema))


def text_bytes(rows: DataFrame, text: str) -> int:
    return rows.agg(F.coalesce(F.sum(F.octet_length(col(text).cast("string"))), F.lit(0))).first()[0]


def shard_bits(size: int) -> int:
    """The bits of a code that name its shard, for so many bytes of text."""
    return max(1, int(size // SHARD_BYTES).bit_length())


def shard_of(code: Column, bits: int) -> Column:
    return F.shiftrightunsigned(code, 64 - bits)


def asked(block: int, level: int, codes: np.ndarray, n: np.ndarray, bits: int) -> pa.Table:
    """The rows in which a block asks about the distinct ``codes``, given in order, and says how many of each it has."""
    shards = (codes >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(shards, prepend=-1))
    ends = np.append(starts, len(codes))[1:]
    size = len(starts)
    return pa.table(
        {
            "shard": pa.array(shards[starts]),
            "block": pa.array(np.full(size, block, np.int64)),
            "level": pa.array(np.full(size, level, np.int32)),
            "codes": pa.array([pack_codes(codes[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()),
            "n": pa.array([pack(n[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()),
        }
    )


def ask(rows: DataFrame, text: str, bits: int, find: Callable[[pa.RecordBatch], list[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """What the blocks of ``rows`` ask: ``find`` gives, for each level, the codes of a slice and which of them count."""
    at, of = rows.columns.index(text), rows.columns.index("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            blocks = batch.column(of).to_numpy()
            starts = np.flatnonzero(np.diff(blocks, prepend=-1))
            for a, b in zip(starts.tolist(), np.append(starts, len(blocks))[1:].tolist(), strict=True):
                if held and block != blocks[a]:
                    yield from merged(int(block), held, bits).to_batches()
                    held = []
                block = blocks[a]
                held += [find(x) for x in slices(batch.slice(a, b - a), at)]
        if held:
            yield from merged(int(block), held, bits).to_batches()

    return rows.mapInArrow(run, ASKED)


def merged(block: int, held: list, bits: int) -> pa.Table:
    """What a block asks; ``held`` has, for each slice and level, the codes and which of them count."""
    tables = []
    for found in zip(*held, strict=True):
        codes, n = np.unique(np.concatenate([codes[counts] for _, codes, counts in found]), return_counts=True)
        others = distinct(np.concatenate([codes[~counts] for _, codes, counts in found]))
        at = np.searchsorted(codes, others)
        new = np.append(codes, np.uint64(0))[at] != others
        new |= at == len(codes)
        others, at = others[new], at[new]
        tables.append(asked(block, found[0][0], np.insert(codes, at, others), np.insert(n, at, 0), bits))
    return pa.concat_tables(tables)


def counted(asks: DataFrame, least: Callable[[int], int]) -> DataFrame:
    """The answers to ``asks``: of each row the codes that occur often enough in all blocks (``least(level)`` times), which of
    them no row before asked about, and the numbers of these."""

    def run(table: pa.Table) -> pa.Table:
        codes = [unpack_codes(x) for x in table.column("codes").to_pylist()]
        sizes, every = [len(x) for x in codes], np.concatenate(codes)
        order = np.argsort(every)
        starts = new_at(every[order])
        n = np.concatenate([unpack(x) for x in table.column("n").to_pylist()]).astype(np.int64)
        total, own = np.empty(len(every), np.int64), np.zeros(len(every), bool)
        if len(every):
            total[order] = np.repeat(np.add.reduceat(n[order], starts), np.diff(np.append(starts, len(every))))
            own[np.minimum.reduceat(order, starts)] = True
        out, end = {"codes": [], "own": [], "n": []}, 0
        for size, level in zip(sizes, table.column("level").to_pylist(), strict=True):
            at = slice(end, end + size)
            kept = total[at] >= least(level)
            out["codes"].append(pack_codes(every[at][kept]))
            out["own"].append(np.packbits(own[at][kept]).tobytes())
            out["n"].append(pack(total[at][kept & own[at]]))
            end += size
        return pa.table({**{x: table.column(x) for x in ("shard", "block", "level")}, **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    return asks.groupBy("shard").applyInArrow(run, KNOWN)


def owned(known: DataFrame) -> DataFrame:
    """The part of the answers about which no other row asked before: each code once, with its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [pack_codes(_owned(*x)) for x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes, pa.binary()), batch.column(5)], ["shard", "block", "level", "codes", "n"])

    return known.mapInArrow(run, ASKED)


def _owned(codes: bytes, own: bytes) -> np.ndarray:
    every = unpack_codes(codes)
    return every[np.unpackbits(np.frombuffer(own, np.uint8), count=len(every)).astype(bool)]


def distinct(values: np.ndarray) -> np.ndarray:
    """The values in order, each once: sorted, where ``np.unique`` hashes, which takes many times as long and much memory."""
    ordered = np.sort(values)
    return ordered[new_at(ordered)]


def new_at(ordered: np.ndarray) -> np.ndarray:
    """The places of the first of each of the values, which are in order."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def dealt(kind: int, lang: int, codes: np.ndarray, columns: list[np.ndarray], bits: int, shards: np.ndarray | None = None) -> pa.Table:
    """``codes`` and what stands by them as packed rows, one or more for each shard; codes are in order within a shard and may repeat."""
    shards = codes >> np.uint64(64 - bits) if shards is None else shards
    shards = shards.astype(np.int64)
    new = np.diff(shards, prepend=-1) != 0
    new[::ROW_CODES] = True
    starts = np.flatnonzero(new)
    ends, size = np.append(starts, len(codes))[1:], len(starts)
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    return pa.table(
        {
            "kind": pa.array(np.full(size, kind, np.int32)),
            "shard": pa.array(shards[starts]),
            "lang": pa.array(np.full(size, lang, np.int64)),
            "codes": pa.array([pack_codes(codes[a:b]) for a, b in spans], pa.binary()),
            "data": pa.array([b"".join(pack(x[a:b]) for x in columns) for a, b in spans], pa.binary()),
        }
    )


def gathered(rows: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    """The codes of all packed ``rows`` of that kind, and the ``width`` columns that stand by them."""
    found = [np.zeros((width + 1, 0), np.uint64)]
    for own, codes, data in zip(*(rows.column(x).to_pylist() for x in ("kind", "codes", "data")), strict=True):
        if own == kind:
            code = unpack_codes(codes)
            found.append(np.vstack([code, *unpack_columns(data, width, len(code))]))
    return list(np.concatenate(found, axis=1))


def unpack_columns(data: bytes, width: int, size: int) -> list[np.ndarray]:
    """``width`` packed columns of ``size`` values, which stand one after the other."""
    out, end = [], len(data)
    for _ in range(width):
        start = end - 1 - data[end - 1] * size
        out.append(unpack(data[start:end]))
        end = start
    return out[::-1]


def looked_up(asks: DataFrame, table: DataFrame, read: Callable[[pa.Table], tuple[np.ndarray, Taken]], names: tuple[str, ...]) -> DataFrame:
    """What ``table`` says of the codes that are asked for, by block. ``table`` has packed rows by ``shard``, of which ``read`` gives
    the codes, in order and each once, and what takes the values ``names`` of those at some places."""

    def run(asks: pa.Table, own: pa.Table) -> pa.Table:
        code, taken = read(own)
        out = {x: [] for x in ("shard", "block", "codes", *names)}
        for shard, block, data in zip(*(asks.column(x).to_pylist() for x in ("shard", "block", "codes")), strict=True):
            wanted = unpack_codes(data)
            at = np.searchsorted(code, wanted)  # both in order, so the search moves on in short steps
            at, wanted = at[at < len(code)], wanted[at < len(code)]
            at = at[code[at] == wanted]
            new = (shard, block, pack_codes(code[at]), *(pack(x.view(np.uint64)) for x in taken(at)))
            for held, value in zip(out.values(), new, strict=True):
                held.append(value)
        return pa.table({k: pa.array(v, pa.int64() if k in ("shard", "block") else pa.binary()) for k, v in out.items()})

    schema = ", ".join(["shard long", "block long", "codes binary", *(f"{x} binary" for x in names)])
    return asks.select("shard", "block", "codes").groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(run, schema)


def with_answers(rows: DataFrame, answers: DataFrame, run: Callable[[int, pa.Table, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """``run(block, rows, answers)`` for each block."""

    def whole(key: tuple, own: pa.Table, found: pa.Table) -> pa.Table:
        return run(key[0].as_py(), own, found)

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(whole, schema)


def answered(answers: pa.Table, *names: str, kind: type = float) -> tuple[np.ndarray, ...]:
    """Of the codes in all answers to a block: the codes in order, and what stands by them in the columns ``names``, of that ``kind``."""
    answers = answers.sort_by("shard")
    found = [np.concatenate([np.zeros(0, np.uint64), *map(unpack_codes, answers.column("codes").to_pylist())])]
    for name in names:
        found.append(np.concatenate([np.zeros(0, kind), *(unpack(x).view(kind) for x in answers.column(name).to_pylist())]))
    codes = found[0]
    if (codes[1:] <= codes[:-1]).any():  # answers of several levels, or to a block that two tasks read
        _, first = np.unique(codes, return_index=True)
        found = [x[first] for x in found]
    return tuple(found)


class Places:
    """The places of ordered codes, which are hashes: their first bits lead near them."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        bits = max(1, min(24, self.size.bit_length()))
        # Codes of one shard have their first bits in common.
        low, high = (int(codes[0]), int(codes[-1])) if self.size else (0, 0)
        self.low, self.high = np.uint64(low), np.uint64(high)
        self.shift = np.uint64(max(0, (high - low).bit_length() - bits))
        steps = np.arange(((high - low) >> int(self.shift)) + 1, dtype=np.uint64) << self.shift
        self.starts = np.searchsorted(codes, steps + self.low)
        self.codes = np.append(codes, np.uint64((1 << 64) - 1))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted code; the number of all codes for those that are not there."""
        out = np.full(len(wanted), self.size)
        if not self.size:
            return out
        inside = np.flatnonzero((wanted >= self.low) & (wanted <= self.high))
        asked = wanted[inside]
        at = self.starts[(asked - self.low) >> self.shift]
        behind = np.flatnonzero(self.codes[at] < asked)
        while len(behind):
            at[behind] += 1
            behind = behind[self.codes[at[behind]] < asked[behind]]
        same = self.codes[at] == asked
        out[inside[same]] = at[same]
        return out


def parts(rows: pa.Table, text: str) -> Iterator[pa.RecordBatch]:
    """The rows of a block in slices."""
    for batch in rows.combine_chunks().to_batches():
        yield from slices(batch, text)

