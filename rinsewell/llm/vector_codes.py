"""Compression of vectors to one code per part, trained and encoded over anchors hierarchies.

Every vector of integers is cut into equal parts; each part position has a codebook of entries, and the code of a part
is its nearest entry. Vectors are packed into blocks. Within a block each part position has a metric tree, built
middle-out: about the square root of n anchors take over the points nearest to them (the triangle inequality says
which points a new anchor cannot take), the anchors' own points become subtrees in the same way, and the subtrees are
merged in pairs, those first whose common ball is smallest. A ball caches its centre, radius, sum and count.

An assignment goes down the tree. A ball inherits the entries that may be nearest to some of its points; an entry goes
if another is nearer to every point of the ball. Where one entry is left, the ball is wholly owned and its cached sum
and count are all a codebook needs; in a leaf the remaining entries are compared point by point. All comparisons that
decide are made on exact integers, the radius is rounded up.

Trees are written once and read in each round. A round sends its sums, one per entry and component, to the driver.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsewell.functions.names import col

from .tables import keep, without

BLOCK = 4096  # vectors that share trees
LEAF = 128  # points of a ball that are compared one by one
SCALE = 1024
LIMIT = 1 << 24  # components are smaller, so that squared distances and sums fit 64 bits
_SAFE = float(1 << 52)  # whole numbers below are exact in floating point
_V = "__rw_vector"


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``a`` to each row of ``b``."""
    largest = max(abs(int(edge)) for x in (a, b) for edge in (x.min(initial=0), x.max(initial=0)))
    if 4 * a.shape[1] * largest * largest < _SAFE:  # sums of floating-point products are exact here
        x, y = a.astype(np.float64), b.astype(np.float64)
        return (np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ y.T) + np.einsum("ij,ij->i", y, y)).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    for i, row in enumerate(b.astype(np.int64)):
        apart = a - row
        out[:, i] = np.einsum("ij,ij->i", apart, apart)
    return out


def anchors(points: np.ndarray, k: int) -> np.ndarray:
    """The anchor, 0 to k - 1, of each point. Each new anchor is the point farthest from its own; fewer than ``k`` if
    all points have become anchors or copies of one."""
    distance = np.sqrt(squares(points, points[:1])[:, 0])
    owner, at = np.zeros(len(points), np.int64), [0]
    while len(at) < k:
        farthest = int(np.argmax(distance))
        if distance[farthest] == 0:
            break
        pivot = points[farthest : farthest + 1]
        apart = np.sqrt(squares(points[at], pivot)[:, 0])
        open_ = np.flatnonzero(2 * distance >= apart[owner])  # all others are surely nearer to their own anchor
        new = np.sqrt(squares(points[open_], pivot)[:, 0])
        nearer = new < distance[open_]
        taken = open_[nearer]
        owner[taken], distance[taken] = len(at), new[nearer]
        at.append(farthest)
    return owner


class _Builder:
    """Balls of a tree; ``rows`` of a ball are the points in it, by their place in the block."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre, self.radius, self.total, self.rows, self.below = [], [], [], [], []

    def ball(self, rows: np.ndarray, total: np.ndarray, below: tuple[int, int] | tuple) -> int:
        centre = np.floor_divide(total, len(rows))
        widest = squares(self.points[rows], centre[None])[:, 0].max()
        for kept, value in zip((self.centre, self.radius, self.total, self.rows, self.below), (centre, float(np.sqrt(widest)) * (1 + 1e-9), total, rows, below), strict=True):
            kept.append(value)
        return len(self.rows) - 1

    def build(self, rows: np.ndarray) -> int:
        if len(rows) > LEAF:
            owner = anchors(self.points[rows], int(np.ceil(np.sqrt(len(rows)))))
            order = np.argsort(owner, kind="stable")
            groups = np.split(rows[order], np.flatnonzero(np.diff(owner[order])) + 1)
            if len(groups) > 1:
                return self.merge([self.build(group) for group in groups])
        return self.ball(rows, self.points[rows].sum(axis=0), ())

    def merge(self, roots: list[int]) -> int:
        """One ball of all, by merging the two whose common ball is smallest, until one is left."""
        centre = np.array([self.centre[r] for r in roots], np.float64)
        radius = np.array([self.radius[r] for r in roots])
        common = np.sqrt(squares(centre.astype(np.int64), centre.astype(np.int64))) + radius[:, None] + radius
        np.fill_diagonal(common, np.inf)
        roots = list(roots)
        for _ in range(len(roots) - 1):
            i, j = divmod(int(np.argmin(common)), len(roots))
            a, b = roots[i], roots[j]
            roots[i] = self.ball(np.concatenate([self.rows[a], self.rows[b]]), self.total[a] + self.total[b], (a, b))
            centre[i], radius[i] = self.centre[roots[i]], self.radius[roots[i]]
            common[j, :] = common[:, j] = np.inf
            apart = centre - centre[i]
            new = np.sqrt(np.einsum("ij,ij->i", apart, apart)) + radius + radius[i]
            new[np.isinf(common[i])] = np.inf
            common[i, :] = common[:, i] = new
        return roots[i]


class Book:
    """The entries of a part, how far they are apart, and which of them are the first of their kind: of equal entries
    the first is always chosen."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.apart = np.sqrt(squares(entries, entries))
        self.first = np.zeros(len(entries), bool)
        self.first[np.unique(entries, axis=0, return_index=True)[1]] = True


@dataclass
class Tree:
    """Points in the order of the tree, and its balls, each before those below it."""

    points: np.ndarray
    place: np.ndarray  # of each point in the block
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    first: np.ndarray  # the points of a ball are first:last
    last: np.ndarray
    below: np.ndarray  # two balls, or -1

    @staticmethod
    def of(points: np.ndarray) -> Tree:
        builder = _Builder(points)
        order = [builder.build(np.arange(len(points)))]
        for ball in order:
            order.extend(builder.below[ball])
        number = {ball: i for i, ball in enumerate(order)}
        place = builder.rows[order[0]]
        where = np.empty(len(place), np.int64)
        where[place] = np.arange(len(place))
        first = np.array([where[builder.rows[ball][0]] for ball in order])
        return Tree(
            points[place],
            place,
            np.array([builder.centre[ball] for ball in order]),
            np.array([builder.radius[ball] for ball in order]),
            np.array([builder.total[ball] for ball in order]),
            first,
            first + [len(builder.rows[ball]) for ball in order],
            np.array([[number[child] for child in builder.below[ball]] or [-1, -1] for ball in order]),
        )

    def packed(self) -> bytes:
        small = {name: value.astype(np.int32) if value.dtype == np.int64 and name != "total" else value for name, value in vars(self).items()}
        if np.abs(self.points).max(initial=0) < 1 << 15:
            small["points"] = self.points.astype(np.int16)
        return pickle.dumps(small, protocol=5)

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        found = pickle.loads(data)  # written by ``packed``
        return Tree(**{name: value.astype(np.int64) if value.dtype.kind == "i" else value for name, value in found.items()})

    def assign(self, book: Book) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The entry of each point, -1 within wholly owned balls, and these balls with their entry. Ties go to
        the lower entry."""
        codes, owned = np.full(len(self.points), -1), []
        candidates, balls = book.first[None], np.array([0])
        while len(balls):
            away = np.where(candidates, squares(self.centre[balls], book.entries), np.iinfo(np.int64).max)
            best = away.argmin(axis=1)
            nearest = away[np.arange(len(balls)), best]
            # |x - e|^2 - |x - best|^2 is at least its value at the centre less 2 radius |e - best|.
            reach = 2 * self.radius[balls, None] * book.apart[best] * (1 + 1e-9)
            candidates = candidates & (away - nearest[:, None] <= reach)
            single = candidates.sum(axis=1) == 1
            owned += zip(balls[single].tolist(), best[single].tolist(), strict=True)
            leaf = self.below[balls, 0] < 0
            for i in np.flatnonzero(leaf & ~single):
                few = np.flatnonzero(candidates[i])
                low, high = self.first[balls[i]], self.last[balls[i]]
                codes[low:high] = few[squares(self.points[low:high], book.entries[few]).argmin(axis=1)]
            inner = ~leaf & ~single
            candidates = np.repeat(candidates[inner], 2, axis=0)
            balls = self.below[balls[inner]].ravel()
        return codes, owned

    def sums(self, book: Book, into: np.ndarray) -> None:
        """Add, for each entry, the sum of its points and, in the last column, their number."""
        codes, owned = self.assign(book)
        for ball, entry in owned:
            into[entry, :-1] += self.total[ball]
            into[entry, -1] += self.last[ball] - self.first[ball]
        single = codes >= 0
        np.add.at(into[:, :-1], codes[single], self.points[single])
        into[:, -1] += np.bincount(codes[single], minlength=len(into))

    def codes(self, book: Book) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each point and its squared distance, in the order of the block."""
        codes, owned = self.assign(book)
        for ball, entry in owned:
            codes[self.first[ball] : self.last[ball]] = entry
        apart = self.points - book.entries[codes]
        out = np.empty((2, len(codes)), np.int64)
        out[:, self.place] = codes, np.einsum("ij,ij->i", apart, apart)
        return out[0], out[1]


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """A row per vector; shorter ones are filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _blocks(rows: DataFrame, carried: T.StructType, parts: int, width: int) -> DataFrame:
    """rows, trees: up to BLOCK rows without their vectors, and the tree of each part."""
    schema = T.StructType([T.StructField("rows", T.ArrayType(carried)), T.StructField("trees", T.ArrayType(T.BinaryType()))])
    step = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                vectors = _padded(block.column(0), width)
                trees = [Tree.of(np.ascontiguousarray(vectors[:, p * step : (p + 1) * step])).packed() for p in range(parts)]
                struct = pa.array(block.column(1))
                held = pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([held, pa.array([trees], pa.list_(pa.binary()))], ["rows", "trees"])

    return rows.mapInArrow(run, schema)


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: componentwise floor(sum / count); unused entries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(book), book.shape[1] + 1), np.int64) for book in books]
        known = list(map(Book, books))
        for batch in batches:
            for trees in batch.column(0):
                for tree, book, into in zip(trees, known, sums, strict=True):
                    Tree.unpacked(tree.as_py()).sums(book, into)
        for p, into in enumerate(sums):
            entry, at = np.nonzero(np.broadcast_to(into[:, -1:] > 0, into.shape))
            columns = [pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(into[entry, at])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "total"])

    partial = blocks.select("trees").mapInArrow(run, "part int, entry int, place int, total long")
    found = partial.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in found}
    new = [book.copy() for book in books]
    for (p, entry, at), total in totals.items():
        if at < new[p].shape[1]:
            new[p][entry, at] = total // totals[p, entry, new[p].shape[1]]
    return new


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows with ``code`` and ``error`` in place of their vector, and the codebook of each part.

    Components become floor(scale * x). Codebooks start with the parts of the ``entries`` (at most 256) rows of the smallest
    ``key``, ties by the vector, null last; each of ``rounds`` rounds assigns all parts and moves every used entry to
    floor(sum / count). ``code`` has two hex digits a part, ``error`` is the sum of squared distances.

    Rows whose vector is null or holds null, NaN or an infinity are left out; all others stay, repeated ones too. Shorter
    vectors count as filled up with zeros, to a length that all parts share. Without rows there are no codebooks.
    A component of 2**24 or more after scaling ends the run with an error, as sums would not fit.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hex digits names 1 to 256 entries")
    base = without(vectors, "code", "error")
    others = [col(name) for name in base.columns if name != vector]
    carried = T.StructType([base.schema[name] for name in base.columns if name != vector])
    x = col(vector).cast("array<double>")
    rows = base.where(x.isNotNull() & ~F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a) == float("inf"))))
    rows = rows.select(F.transform(x, lambda a: F.floor(a * scale)).alias(_V), F.struct(*others).alias("rows"))
    size = rows.agg(F.max(F.size(_V)), F.max(F.greatest(F.abs(F.array_max(_V)), F.abs(F.array_min(_V))))).first()
    if (size[1] or 0) >= LIMIT:
        raise ValueError(f"components must be below {LIMIT / scale} in size: scale them first")
    out = T.StructType([*carried.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if size[0] is None:
        return base.select(*others, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), []
    width = max(1, -(-size[0] // parts)) * parts
    first = rows.orderBy(F.col("rows").getField(key).asc_nulls_last(), _V).limit(entries).select(_V).collect()
    start = np.array([row[0] + [0] * (width - len(row[0])) for row in first], np.int64)
    books = np.split(start, parts, axis=1)
    blocks = keep(_blocks(rows, carried, parts, width))
    for _ in range(rounds):
        books = _round(blocks, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = list(map(Book, books))
        for batch in batches:
            for held, trees in zip(batch.column(0), batch.column(1), strict=True):
                found = [Tree.unpacked(tree.as_py()).codes(book) for tree, book in zip(trees, known, strict=True)]
                text = np.stack([codes for codes, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                columns = [*held.values.flatten(), pa.array(codes, pa.string()), pa.array(sum(error for _, error in found), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return blocks.mapInArrow(run, out), books


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the error summed over the rows of equal label, nulls together."""
    coded = without(coded, "label_error")
    sums = coded.groupBy(col(label).alias("__rw_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, col(label).eqNullSafe(F.col("__rw_label"))).select(*map(col, coded.columns), "label_error")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of all entries, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
