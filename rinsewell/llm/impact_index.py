"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are integers. A block of the index holds, per dimension, the postings (row, value) of its vectors in order
of value, cut into segments of equal quantised value. For a query, the contribution of a segment is bounded by
the query's component times the segment's extreme value; segments of all dimensions are processed from the highest
quantised impact down, adding to one accumulator per vector. What a vector may still gain is at most, per dimension
it has not been met in, the bound of the next segment there. Processing stops once it is proven that no more than
``RESCORED`` vectors can be among the best k (or all is processed); these are scored exactly.

Queries are packed into blocks too; each meets each block of the index by a join on the block's number, and the
best k of every block are merged by a ranked window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinsewell.functions.names import col

from .tables import keep

BLOCK = 16_384  # vectors of an index block
QUERIES = 256  # of a query block
LEVELS = 64  # quantised values of a dimension
ROUNDS = (8, 5, 3, 2, 1, 0)  # impact levels at which it may be proven that enough was seen, of twice the first
RESCORED = 64
SCALE = 1024


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, v: floor(scale * x) of every component. Without rows whose id or vector is null, or whose vector holds
    null or a value that is not finite."""
    x = col(vector).cast("array<double>")
    rows = vectors.select(col(key).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    return rows.where(~F.exists("x", lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")))).select(
        "id", F.transform("x", lambda a: F.floor(a * scale)).alias("v")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """A row per vector; shorter ones are filled up with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """n, ids, v: up to ``size`` vectors of one task per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0

        def out() -> pa.RecordBatch:
            width = max(v.shape[1] for v in vectors)
            whole = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors])
            columns = [pa.array([len(whole)], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([whole.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["n", "ids", "v"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - held)
                ids.append(part.column(0).to_numpy())
                vectors.append(_matrix(part.column(1)))
                at, held = at + part.num_rows, held + part.num_rows
                if held == size:
                    yield out()
                    ids, vectors, held = [], [], 0
        if held:
            yield out()

    return rows.select("id", "v").mapInArrow(run, "n int, ids binary, v binary")


class Block:
    """Postings of up to BLOCK vectors, by dimension in order of value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        columns = vectors.T
        self.order = np.argsort(columns, axis=1, kind="stable")
        self.sorted = np.take_along_axis(columns, self.order, axis=1)
        self.low, self.high = self.sorted[:, 0], self.sorted[:, -1]
        # Segments: postings of one quantised value. Their edges, as places in the sorted postings.
        step = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        edges = self.low[:, None] + step[:, None] * np.arange(LEVELS + 1)
        self.edges = np.stack([np.searchsorted(own, at) for own, at in zip(self.sorted, edges, strict=True)])
        self.edges[:, -1] = len(ids)

    def _impacts(self, query: np.ndarray) -> np.ndarray:
        """For each dimension and segment the most that its values add to the score, over the dimension's least."""
        first = np.minimum(self.edges[:, :-1], len(self.ids) - 1)
        last = np.maximum(self.edges[:, 1:] - 1, first)
        a = np.take_along_axis(self.sorted, first, 1) * query[:, None]
        b = np.take_along_axis(self.sorted, last, 1) * query[:, None]
        least = np.minimum(self.low * query, self.high * query)
        return np.maximum(a, b) - least[:, None]

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k, ties to smaller ids; without rows of the id ``own``."""
        n, dims = self.vectors.shape
        query = np.concatenate([query, np.zeros(max(0, dims - len(query)), np.int64)])[:dims]
        impacts = self._impacts(query)
        least = np.minimum(self.low * query, self.high * query)
        gains = self.sorted * query[:, None] - least[:, None]
        others = self.ids != own
        possible = np.flatnonzero(others)
        total = np.zeros(n, np.int64)
        used = np.flatnonzero(query)
        up = query > 0  # the highest impacts stand at the end of the postings
        rows = np.arange(dims)
        done = np.where(up, n, 0)  # postings met so far: from here on, or up to here
        highest = int(impacts.max(initial=0))
        for part in ROUNDS:
            if len(possible) <= max(k, RESCORED):
                break
            floor = highest * part // ROUNDS[0] // 2
            # Impacts rise with the value if the component is positive, and fall otherwise.
            below = (impacts < floor).sum(axis=1)
            level = np.where(up, below, LEVELS - below)
            place = self.edges[rows, level]
            low, high = np.minimum(place, done).tolist(), np.maximum(place, done).tolist()
            for d in used.tolist():
                if low[d] < high[d]:
                    total[self.order[d, low[d] : high[d]]] += gains[d, low[d] : high[d]]
            done = place
            # What is left per dimension, and so per vector that has not been met there.
            rest = np.zeros(dims, np.int64)
            more = used[np.where(up, level > 0, level < LEVELS)[used]]
            rest[more] = impacts[more, np.where(up, level - 1, level)[more]]
            candidates = total[possible]
            kth = np.partition(candidates, -k)[-k] if len(candidates) >= k else np.iinfo(np.int64).min
            near = candidates + rest.sum() >= kth
            possible, candidates = possible[near], candidates[near]
            if 4 * len(possible) > n:
                continue  # too many for a closer look to pay
            values = self.vectors[possible]
            edge = self.sorted[rows, np.where(up, np.minimum(done, n - 1), np.maximum(done - 1, 0))]
            unseen = np.where(up, (values < edge) | (done == n), (values > edge) | (done == 0))
            possible = possible[candidates + unseen @ rest >= kth]
        scores = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][best], scores[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for each of ``queries`` (both as ``quantised``).

    Rows that share the query's id are not its candidates. Ties go to smaller ids. Equal queries count once; fewer
    candidates than k give fewer rows; empty tables none. Vectors of different lengths are compared as if filled up
    with zeros. Components must fit 32 bits.
    """
    index = keep(_packed(vectors, BLOCK).withColumn("block", F.monotonically_increasing_id()))
    asked = _packed(queries.dropDuplicates(["id", "v"]), QUERIES).withColumn("asked", F.monotonically_increasing_id())
    asked = keep(asked.select("asked", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v")))
    numbers = [row["block"] for row in index.select("block").toLocalIterator()]  # one in BLOCK rows, or one per task
    pairs = asked.withColumn("block", F.explode(F.lit(numbers).cast("array<long>"))).join(index, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                block = Block(ids, np.frombuffer(row["v"], np.int64).reshape(len(ids), -1))
                own = np.frombuffer(row["q_ids"], np.int64)
                found = [block.search(q, i, k) for q, i in zip(np.frombuffer(row["q_v"], np.int64).reshape(len(own), -1), own.tolist(), strict=True)]
                sizes = [len(f[0]) for f in found]
                columns = [
                    pa.array(np.full(sum(sizes), row["asked"])),
                    pa.array(np.repeat(np.arange(len(own)), sizes)),
                    pa.array(np.repeat(own, sizes)),
                    pa.array(np.concatenate([f[0] for f in found])),
                    pa.array(np.concatenate([f[1] for f in found])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["asked", "number", "query_id", "vec_id", "score"])

    schema = "asked long, number long, query_id long, vec_id long, score long"
    found = pairs.select("asked", "q_ids", "q_v", "ids", "v").mapInArrow(run, schema)
    best = Window.partitionBy("asked", "number").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
