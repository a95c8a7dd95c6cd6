"""SimHash near-duplicates: fingerprints that differ in few bits, linked through Gray-order indexes.

Fingerprints within ``max_distance`` bits agree on at least two of ``max_distance + 2`` segments of their bits,
so each distinct fingerprint is dealt to one block per pair of segments. In a block they are sorted by
Gray rank; runs of neighbours form nodes, nodes of nodes form the levels above. A node keeps the bits on
which all below it agree; what an upper node holds is taken out of those below. A search adds up
differences from the top down, and drops a whole group once they exceed the distance, or once all of it is
known to be linked to the searching fingerprint. Each block yields a spanning forest, never all pairs.

Blocks of more than ``BLOCK`` fingerprints are split into parts, and each two parts meet in a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsewell.functions.names import col

from .components import components
from .rows import with_text
from .tables import files_for, keep, text_key, without
from .words import slices

SEED = 42
BLOCK = 20_000  # fingerprints of a block before it is split
FANOUT = 16  # children of a node
SEARCHES = 64  # made at once

_EDGES = "a long, b long"


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits of a text; 0 for one without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined, n = b" ".join(found), len(found)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, found), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - shingle + 1].tolist()
        parts = [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of the whole text as a long. Null and empty texts have 0. A column
    already named like the new one is replaced; rows and other columns stay."""
    base = without(docs, name)
    schema = T.StructType([*base.schema.fields, T.StructField(name, T.LongType())])
    width = len(base.columns)
    rows, at = with_text(docs, base.columns, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).cast(pa.binary()).to_pylist()
                found = np.fromiter((fingerprint(t or b"", shingle) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(found.view(np.int64))], schema.names)

    return rows.mapInArrow(run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the binary reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Distinct codes in Gray order, under levels of nodes that hold the bits their children share."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        ones, zeros = self.codes, ~self.codes
        self.ones, known = [ones], [ones | zeros]
        while len(ones) > FANOUT:
            starts = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            self.ones.append(ones)
            known.append(ones | zeros)
        # What a node adds to the node above it.
        self.bits = [own & ~above[np.arange(len(own)) // FANOUT] for own, above in zip(known, known[1:], strict=False)]
        self.bits.append(known[-1])
        self.label = np.arange(len(codes))
        self._groups()

    def _groups(self) -> None:
        """For each node, the component of all codes below it, or -1 if there are several."""
        self.common = [self.label]
        for _ in self.ones[1:]:
            below = self.common[-1]
            starts = np.arange(0, len(below), FANOUT)
            low, high = np.minimum.reduceat(below, starts), np.maximum.reduceat(below, starts)
            self.common.append(np.where(low == high, low, -1))

    def _search(self, first: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of the codes from place ``first`` on to codes of other components."""
        asked = np.arange(first, min(first + SEARCHES, len(self.codes)))
        top = len(self.ones[-1])
        who, node = np.repeat(asked, top), np.tile(np.arange(top), len(asked))
        apart = np.zeros(len(who), np.uint8)
        for level in range(len(self.ones) - 1, -1, -1):
            apart = apart + np.bitwise_count((self.codes[who] ^ self.ones[level][node]) & self.bits[level][node])
            stay = (apart <= distance) & (self.common[level][node] != self.label[who])
            who, node, apart = who[stay], node[stay], apart[stay]
            if level:
                size = len(self.ones[level - 1])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                who, apart = np.repeat(who, FANOUT), np.repeat(apart, FANOUT)
                if len(node) and node[-1] >= size or size % FANOUT:
                    inside = node < size
                    who, node, apart = who[inside], node[inside], apart[inside]
        return who, node

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while (open_ := self.label[a] != self.label[b]).any():
            one, two = self.label[a[open_]], self.label[b[open_]]
            above = np.arange(len(self.label))
            np.minimum.at(above, np.maximum(one, two), np.minimum(one, two))
            while ((further := above[above]) != above).any():
                above = further
            self.label = above[self.label]

    def forest(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges that connect all codes which chains of links of at most ``distance`` bits connect."""
        for first in range(0, len(self.codes), SEARCHES):
            a, b = self._search(first, distance)
            if len(a):
                self._unite(a, b)
                self._groups()
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.codes[at], self.codes[self.label[at]]


def _blocks(codes: DataFrame, distance: int) -> DataFrame:
    """block columns and fp: each fingerprint once per pair of segments."""
    edges = [round(i * 64 / (distance + 2)) for i in range(distance + 3)]
    masks = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:], strict=False)]
    pairs = [a | b for a, b in combinations(masks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    keys = F.array(*(F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))
    rows = codes.select("fp", F.explode(keys).alias("k")).select("fp", "k.pair", "k.bits")
    large = rows.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    rows = rows.join(large, ["pair", "bits"], "left")
    parts = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    rows = rows.select("fp", "pair", "bits", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    return rows.select("fp", "pair", "bits", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))


def _links(codes: DataFrame, distance: int) -> DataFrame:
    block = ["pair", "bits", "one", "two"]

    def found(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate(held)
        return GrayIndex(codes).forest(distance) if len(codes) > 1 else (codes[:0], codes[:0])

    def out(edges) -> pa.RecordBatch:
        a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (list(zip(*edges, strict=True)) or [(), ()]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None  # of the block that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in block]
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            new = np.zeros(len(fp), bool)
            for values in columns:
                new[1:] |= values[1:] != values[:-1]
            new[0] = name != tuple(c[0] for c in columns)
            starts = np.flatnonzero(new)
            edges = []
            held.append(fp[: starts[0]].copy() if len(starts) else fp.copy())
            if len(starts):
                edges.append(found(held))
                sizes = np.diff(starts)
                for at in np.flatnonzero(sizes > 1).tolist():
                    edges.append(found([fp[starts[at] : starts[at + 1]]]))
                held = [fp[starts[-1] :].copy()]
            name = tuple(c[-1] for c in columns)
            yield out(edges)
        if held:
            yield out([found(held)])

    dealt = _blocks(codes, distance).repartition(*block).sortWithinPartitions(*block)
    return dealt.mapInArrow(run, _EDGES)


def groups(docs: DataFrame, max_distance: int = 4, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, fingerprint, group, component_id, a row for each row of ``docs``.

    ``group`` is a fingerprint that stands for the component; ``component_id`` is its smallest doc_id (null if
    it has none). Texts without words have fingerprint 0 and are linked like any others. Written to the shared
    folder, since every text is hashed only once.
    """
    rows = docs.select(col(key).alias("doc_id"), text_key(col(text)).alias("text_key"), col(text).alias("__rw_value"))
    files = files_for(docs)
    rows = keep(fingerprints(rows, shingle, "__rw_value").drop("__rw_value"), files)
    codes = rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    linked = components(_links(codes.select("fp"), max_distance), files)
    codes = codes.join(linked, F.col("fp") == F.col("node"), "left")
    codes = codes.select("fp", "least", F.coalesce("root", "fp").alias("group"))
    ids = codes.groupBy("group").agg(F.min("least").alias("component_id"))
    named = codes.select("fp", "group").join(ids, "group").select(F.col("fp").alias("fingerprint"), "group", "component_id")
    return rows.join(named, "fingerprint")


def one_of_each(docs: DataFrame, max_distance: int = 4, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null comes last)."""
    found = groups(docs, max_distance, shingle, key, text)
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # An id may be repeated; of one component and id, the least text stays.
    chosen = chosen.groupBy("group", "doc_id").agg(F.min("text_key").alias("text_key")).select(
        F.col("doc_id").alias("__rw_id"), F.col("text_key").alias("__rw_key")
    )
    rows = docs.withColumn("__rw_text", text_key(col(text)))
    same = F.col("__rw_text").eqNullSafe(F.col("__rw_key")) & col(key).eqNullSafe(F.col("__rw_id"))
    kept = rows.join(chosen, same, "left_semi")
    return kept.dropDuplicates([key, "__rw_text"]).drop("__rw_text")
