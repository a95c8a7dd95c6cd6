"""Byte-level BPE encoding and decoding.

Tokens' bytes are read as Latin-1, so that one pyahocorasick automaton over them finds every token in a
piece in one pass. The encoder starts from the longest token at each place and steps back to shorter ones
where two neighbours could not stand side by side after the merges. Whether they could is found by undoing
their last merges, and remembered per pair, so a piece takes time linear in its length and the result is
that of merging in rank order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import added
from .tables import without
from .words import slices

CACHED_TEXTS = 1 << 18  # of pieces of text and their ids, per worker, and as many older ones; others are encoded again
CACHED_CHARS = 64


def read_ranks(path: str) -> bytes:
    """The rank file (a line per token: base64, space, rank) as it is."""
    with open(path, "rb") as file:
        return file.read()


class Encoder:
    """Texts to ids and back; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: bytes, pattern: str):
        import ahocorasick

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        names = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(names.values()) + 1
        self.token = [b""] * size
        for token, rank in names.items():
            self.token[rank] = token
        self.pieces = regex.compile(pattern).findall
        self.by_text: dict[str, int] = {token.decode("latin-1"): rank for token, rank in names.items()}
        self.automaton = ahocorasick.Automaton()
        for text, rank in self.by_text.items():
            self.automaton.add_word(text, (rank, len(text)))
        self.automaton.make_automaton()
        self.length = [len(token) for token in self.token]
        self.shorter = [-1] * size  # the longest other token that a token begins with
        for text, rank in self.by_text.items():
            for n in range(len(text) - 1, 0, -1):
                if (found := self.by_text.get(text[:n])) is not None:
                    self.shorter[rank] = found
                    break
        self.merged: dict[tuple[int, int], int] = {}
        self.halves = [(rank, rank) for rank in range(size)]  # a token that no merge makes is its own half
        self.fits: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(names.items(), key=lambda x: x[1]):
            self._learn(token.decode("latin-1"), rank)
        self.fits = {}  # what was found while merges were still missing
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.packed_pieces: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}

    def _learn(self, text: str, rank: int) -> None:
        """Find the merge that makes this token out of earlier ones."""
        left = self.shorter[rank]
        while left >= 0:
            right = self.by_text.get(text[self.length[left] :], -1)
            if 0 <= left < rank and 0 <= right < rank and self._compatible(left, right):
                self.merged[left, right] = rank
                self.halves[rank] = (left, right)
                return
            left = self.shorter[left]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging stops with these two side by side: no earlier merge would have joined across.

        Merges are undone from the latest on; at each state the two tokens that touch must not have a merge
        that was due before the one just undone.
        """
        before = len(self.token) + 1
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    inner = self.halves[left][1]
                    if inner != left:
                        before, left = left, inner
                        break
                    before = right + 1
                else:
                    inner = self.halves[right][0]
                    if inner != right:
                        before, right = right + 1, inner
                        break
                    before = left
                undo_left = not undo_left
            else:
                return True

    def piece(self, text: str) -> list[int]:
        """The ids of one piece (one match of the pattern)."""
        text = text.encode().decode("latin-1")
        if (whole := self.by_text.get(text)) is not None:
            return [whole]
        n = len(text)
        longest = [-1] * (n + 1)
        for end, (rank, length) in self.automaton.iter(text):
            start = end + 1 - length
            if longest[start] < 0 or self.length[longest[start]] < length:
                longest[start] = rank
        open_at, out, at, fits, length, shorter = [True] * (n + 1), [], 0, self.fits, self.length, self.shorter
        token = longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                if open_at[at + length[token]]:
                    if last < 0:
                        break
                    known = fits.get((last, token))
                    if known is None:
                        known = fits[last, token] = self._compatible(last, token)
                    if known:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            elif last < 0:
                raise ValueError("the ranks do not cover every byte")
            else:
                open_at[at] = False
                token = out.pop()
                at -= length[token]
        if len(fits) > CACHED_TEXTS:
            fits.clear()
        return out

    def _packed(self, text: str) -> bytes:
        known, out = self.packed_pieces, []
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.older_pieces.get(piece)
                if ids is None:
                    ids = np.array(self.piece(piece), "<u4").tobytes()
                if len(piece) <= CACHED_CHARS:
                    if len(known) >= CACHED_TEXTS:
                        self.older_pieces, self.packed_pieces = known, {}
                        known = self.packed_pieces
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _part(self, part: str, space: str) -> bytes | None:
        """The ids of a part between single spaces, or None if it touches other white space.

        A single space between two other characters always begins a match of the pattern, so such parts
        can be encoded, and remembered, on their own.
        """
        if not part or part[0].isspace() or part[-1].isspace():
            return None
        found = self.older.get(space + part) or self._packed(space + part)
        if len(part) <= CACHED_CHARS:
            if len(self.cache) >= CACHED_TEXTS:
                self.older, self.cache = self.cache, {}
            self.cache[space + part] = found
        return found

    def parts(self, text: str) -> list[bytes]:
        """The ids of a text, as packed parts to be joined."""
        if not text:
            return []
        known = self.cache.get
        first, *rest = text.split(" ")
        texts = [first, *map(" ".__add__, rest)]
        found = list(map(known, texts))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    ids = self._part(texts[i][1:] if i else first, " " if i else "")
                    if ids is None:
                        return [self._packed(text)]
                    found[i] = ids
        return found

    def rest(self) -> None:
        """Between tasks a worker keeps the newer texts only."""
        self.older, self.older_pieces = {}, {}

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_encoders: dict[int, Encoder] = {}


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder per worker process."""
    key = hash((ranks, pattern))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids``: the token ids of the whole text, packed as little-endian unsigned 32-bit integers; and under the
    name ``decoded``, if given, the bytes that these ids decode to, by the same worker.

    Null and empty texts have no ids (zero bytes). Special tokens are ordinary text. Rows, repeated ones
    too, keep their other columns; a column already named like the new one is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: its size does not follow the data

    def rows(texts):
        own = encoder(shared.value, pattern)
        packed = [b"".join(own.parts(text or "")) for text in texts]
        return [(p, own.decode(p)) for p in packed] if decoded else [(p,) for p in packed]

    new = {name: (T.BinaryType(), pa.binary()) for name in (ids, decoded) if name}
    return added(df, text, new, rows, lambda: encoder(shared.value, pattern).rest())


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes that the ids stand for. Null ids decode to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    base = without(df, decoded)
    schema = T.StructType([*base.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = encoder(shared.value, pattern).decode
        for batch in batches:
            for part in slices(batch, at):
                got = pa.array([back(packed or b"") for packed in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, got], schema.names)

    at = base.columns.index(ids)
    return base.mapInArrow(run, schema)


def lengths(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """Add ``n_tokens``: the number of ids of the whole text; 0 for null and empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def rows(texts):
        parts = encoder(shared.value, pattern).parts
        return [(sum(map(len, parts(text or ""))) // 4,) for text in texts]

    return added(df, text, {n_tokens: (T.LongType(), pa.int64())}, rows, lambda: encoder(shared.value, pattern).rest())
