"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, first byte, last byte) over two buffers that never change: its text and the
sentinels. Cutting splits a descriptor in two, an arrangement permutes the descriptors and puts a sentinel before
each, the inverse permutation restores the text. Only descriptors are moved; bytes are read once, as they are
streamed into a hash or an output. Buffers are Arrow's own: a text is not copied to be cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsewell.functions.names import col

from .tables import without
from .words import slices, text_bytes

# The sentinels of prefix, middle and suffix, and the order of the three in each form.
SENTINELS = (b"<P>", b"<M>", b"<S>")
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}

_TEXT, _SENTINEL = 0, 1
_SENTINELS = memoryview(b"".join(SENTINELS))
_ANY_SENTINEL = re.compile(b"|".join(map(re.escape, SENTINELS)))
PIECES = T.ArrayType(T.StructType([T.StructField("buffer", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_ARROW_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))


class PieceTable:
    """Descriptors, in order, over a text and the sentinels."""

    def __init__(self, text: memoryview, pieces: list[tuple[int, int, int]] | None = None):
        self.text = text
        self.pieces = [(_TEXT, 0, len(text))] if pieces is None else pieces

    def cut(self, *places: int) -> PieceTable:
        """With a descriptor that begins at each of the places (rising, in bytes); one may be empty."""
        pieces, rest, at = [], list(self.pieces), 0
        for place in places:
            while rest and at + rest[0][2] - rest[0][1] < place:
                pieces.append(rest.pop(0))
                at += pieces[-1][2] - pieces[-1][1]
            buffer, start, stop = rest[0]
            pieces.append((buffer, start, start + place - at))
            rest[0], at = (buffer, start + place - at, stop), place
        return PieceTable(self.text, pieces + rest)

    def arranged(self, order: tuple[int, ...], marked: bool = False) -> PieceTable:
        """The descriptors in another order; ``marked``: after the sentinel of their old place."""
        pieces = []
        for place in order:
            if marked:
                start = sum(map(len, SENTINELS[:place]))
                pieces.append((_SENTINEL, start, start + len(SENTINELS[place])))
            pieces.append(self.pieces[place])
        return PieceTable(self.text, pieces)

    def __iter__(self) -> Iterator[memoryview]:
        for buffer, start, stop in self.pieces:
            yield (_SENTINELS if buffer else self.text)[start:stop]

    def digest(self) -> str:
        found = hashlib.sha256()
        for piece in self:
            found.update(piece)
        return found.hexdigest()

    def rendered(self) -> bytes:
        return b"".join(self)


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(sorted(range(len(order)), key=order.__getitem__))


def restored(output: memoryview, form: str) -> PieceTable:
    """The text in an output: it is cut at its sentinels, which go, and the pieces go back to their places."""
    table = PieceTable(output)
    if form not in FORMS:
        return table
    marks = [m.span() for m in _ANY_SENTINEL.finditer(output)]
    if [bytes(output[a:b]) for a, b in marks] != [SENTINELS[place] for place in FORMS[form]]:
        raise ValueError(f"not an output of form {form}")
    return table.cut(*(place for mark in marks for place in mark)).arranged((2, 4, 6)).arranged(inverse(FORMS[form]))


def _drawn(seed: int, key: str) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def _code_points(text: np.ndarray) -> int:
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def _transformed(text: np.ndarray, key: str, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    ends = np.flatnonzero(text == 10) + 1
    units = np.concatenate([[0], ends, [len(text)] if len(text) and text[-1] != 10 else []]).astype(np.int64)  # where they begin
    n = len(units) - 1
    h1, h2, h3, h4 = _drawn(seed, key)
    table = PieceTable(memoryview(text))
    if not n or _ANY_SENTINEL.search(table.text) or h3 % 100 >= fim_percent:
        return n, "plain", None, None, table
    form = "spm" if h4 % 100 < spm_percent else "psm"
    low, high = (int(units[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, form, _code_points(text[:low]), _code_points(text[low:high]), table.cut(low, high).arranged(FORMS[form], marked=True)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", fim_percent: int = 100, spm_percent: int = 50, seed: int = 7) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``pieces``, ``output`` and ``output_sha256``.

    A text (null: empty) is cut into n lines, ends included; prefix, middle and suffix are made of whole lines, the borders
    drawn from a hash of ``seed`` and the key, as are the form and whether the text stays ``plain``. An empty text is
    plain, and so is one that holds a sentinel. ``pieces`` are the descriptors of the output, in bytes: buffer 0 is the
    text, 1 the sentinels. Rows of equal key and text have equal results; a null key counts as an empty one. No rows
    give no rows. Columns of ``docs`` named like the new ones give way to them.
    """
    new = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "pieces": PIECES, "output": T.StringType(), "output_sha256": T.StringType()}
    base = without(docs, *new)
    schema = T.StructType([*base.schema.fields, *(T.StructField(name, kind) for name, kind in new.items())])
    width, names = len(base.columns), list(schema.names)
    rows = base.select("*", F.coalesce(col(key).cast("string"), F.lit("")).alias("__rw_key"), col(text).cast("string").alias("__rw_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, width + 1):
                data, ends = text_bytes(part.column(width + 1))
                found = [
                    _transformed(data[ends[i] : ends[i + 1]], own, seed, fim_percent, spm_percent)
                    for i, own in enumerate(part.column(width).to_pylist())
                ]
                n, form, prefix, middle, tables = map(list, zip(*found, strict=True))
                pieces = [[dict(zip(("buffer", "start", "stop"), piece, strict=True)) for piece in table.pieces] for table in tables]
                columns = [
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    pa.array(pieces, _ARROW_PIECES),
                    _strings(table.rendered() for table in tables),
                    pa.array([table.digest() for table in tables], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *columns], names)

    return rows.mapInArrow(run, schema)


def restore(docs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``docs`` with ``restored`` and ``restored_sha256``: the text rebuilt from an output and its form alone.

    A null output counts as empty, a form that is null or unknown as plain; an output whose sentinels do not fit
    its form is an error.
    """
    new = {"restored": T.StringType(), "restored_sha256": T.StringType()}
    base = without(docs, *new)
    schema = T.StructType([*base.schema.fields, *(T.StructField(name, kind) for name, kind in new.items())])
    width, names = len(base.columns), list(schema.names)
    rows = base.select("*", col(form).alias("__rw_form"), col(output).cast("string").alias("__rw_output"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, width + 1):
                data, ends = text_bytes(part.column(width + 1))
                tables = [restored(memoryview(data[ends[i] : ends[i + 1]]), own) for i, own in enumerate(part.column(width).to_pylist())]
                columns = [_strings(table.rendered() for table in tables), pa.array([table.digest() for table in tables], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *columns], names)

    return rows.mapInArrow(run, schema)


def _strings(texts: Iterator[bytes]) -> pa.Array:
    """As Spark's strings, whatever their bytes."""
    return pa.array(list(texts), pa.binary()).view(pa.string())
