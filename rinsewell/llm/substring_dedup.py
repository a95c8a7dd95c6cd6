"""Substring de-duplication: words covered by a long word sequence that also starts elsewhere.

Places that may repeat are found by anchors. Of the ``ANCHOR``-word sequences inside a window of
``min_words`` words, the one with the least hash is the window's anchor; equal windows have equal anchors
at equal places. Consecutive windows with one anchor form a site: a segment that holds exactly these
windows. A window that repeats does so within two sites of one anchor, and every window lies in one site.

- An anchor seen once: nothing in its site repeats.
- An anchor whose sites are all equal: each window in them repeats.
- Other anchors are dealt to reference shards, each distinct segment once, with its number of sites. The
  segments of a shard are fed into a suffix automaton over words that counts the occurrences of each state;
  the segments stream past it, and at each place the longest suffix with a second occurrence is the matching
  statistic. Spans of ``min_words`` or more are removed, at every site of the segment.

A shard is a run of whole anchors of bounded size: an automaton of the whole corpus could be neither built nor
broadcast. An anchor with more than ``HOT`` distinct segments is split further, into their windows, which are
counted with partial sums. Only which words are compared is decided by anchors; whether they are equal is decided
on all words of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsewell.functions.names import col

from .rows import with_text
from .tables import files_for, keep, without
from .words import grams, mix, ranges, slices, text_bytes, words

ANCHOR = 8  # words of an anchor; the denser the longer
HOT = 4_000  # distinct segments of an anchor that one shard may hold
SHARD_WORDS = 50_000  # words in an automaton

_SITES = "fp long, seg long, key long, place long"
_SEGMENTS = "fp long, seg long, n long, hot boolean, words binary"
_SPANS = "fp long, seg long, first int, last int"


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its least, the first of equals. Width 1 or more."""
    at = np.arange(len(values))
    size, least = 1, values
    while 2 * size <= width:
        left, right = least[:-size], least[size:]
        at = np.where(right < left, at[size:], at[:-size])
        least, size = np.minimum(left, right), 2 * size
    rest = width - size
    if rest:
        at = np.where(least[rest:] < least[:-rest], at[rest:], at[:-rest])
    return at


def _sites(hashes: np.ndarray, doc: np.ndarray, min_words: int):
    """(anchor, hash of the segment, first word, words, row) of each site."""
    if len(hashes) < min_words:
        return None
    anchor = min(ANCHOR, min_words)
    least = grams(hashes, anchor)
    at = _leftmost_least(least, min_words - anchor + 1)
    windows = np.flatnonzero(doc[: len(at)] == doc[min_words - 1 :])  # those within one text
    if not len(windows):
        return None
    at = at[windows]
    begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[windows][1:] != doc[windows][:-1])]))
    first = windows[begins]
    last = windows[np.concatenate([begins[1:], [len(windows)]]) - 1] + min_words
    at = at[begins]
    seg = mix(ranges(hashes, first, last) + (at - first).astype(np.uint64))
    return least[at], seg, first, last - first, doc[first]


def _anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per site. ``place`` packs the text's tag, the first word and the number of words (16, 32 and 16 bits):
    these rows are the bulk of what is shuffled."""
    names = ["fp", "seg", "key", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"))
                sites = _sites(found.hashes(), found.doc, min_words)
                if sites is None:
                    continue
                fp, seg, first, length, row = sites
                tag = part.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                place = tag << 48 | (first - found.first[row]) << 16 | length
                columns = [pa.array(fp.view(np.int64)), pa.array(seg.view(np.int64)), part.column("key").take(pa.array(row)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, _SITES)


class Automaton:
    """Suffix automaton of several sequences, with the occurrences of each state's sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.seen = [0]

    def add(self, sequence: list[int], times: int) -> None:
        following, link, length, seen = self.next, self.link, self.length, self.seen
        last = 0
        for symbol in sequence:
            known = following[last].get(symbol)
            if known is not None and length[known] == length[last] + 1:
                last = known
                seen[last] += times
                continue
            state = -1
            if known is None:
                state = len(following)
                following.append({})
                link.append(0)
                length.append(length[last] + 1)
                seen.append(times)
                at = last
                while at >= 0 and symbol not in following[at]:
                    following[at][symbol] = state
                    at = link[at]
                if at < 0:
                    last = state
                    continue
            else:
                at = last
            target = following[at][symbol]
            if length[target] != length[at] + 1:
                copy = len(following)
                following.append(dict(following[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                seen.append(0)
                link[target] = copy
                while at >= 0 and following[at].get(symbol) == target:
                    following[at][symbol] = copy
                    at = link[at]
                target = copy
            if state >= 0:
                link[state] = target
                last = state
            else:
                last = target
                seen[last] += times

    def count(self) -> None:
        """Add up the occurrences of longer sequences that end with a shorter one."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.seen[self.link[state]] += self.seen[state]

    def repeated(self, sequence: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal spans of ``sequence`` (one that was added) covered by sequences of ``least`` symbols or
        more that occur twice."""
        spans, state = [], 0
        following, link, length, seen = self.next, self.link, self.length, self.seen
        for end, symbol in enumerate(sequence, 1):
            state = following[state][symbol]
            at = state
            matched = end if end < length[at] else length[at]
            while at > 0 and seen[at] < 2:
                at = link[at]
                matched = length[at]
            if matched >= least:
                if spans and spans[-1][1] >= end - matched:
                    spans[-1] = (min(spans[-1][0], end - matched), end)
                else:
                    spans.append((end - matched, end))
        return spans


def _matched(segments: DataFrame, min_words: int) -> DataFrame:
    """Spans that repeat, within the segments of each anchor."""

    def shard(held: dict[tuple[int, int], tuple[int, bytes]]) -> pa.RecordBatch:
        number: dict[int, int] = {}
        automaton = Automaton()
        sequences = {}
        for name, (n, packed) in held.items():
            sequences[name] = [number.setdefault(h, len(number)) for h in np.frombuffer(packed, np.int64).tolist()]
            automaton.add(sequences[name], n)
        automaton.count()
        rows = [(*name, *span) for name, sequence in sequences.items() for span in automaton.repeated(sequence, min_words)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["fp", "seg", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, anchor = {}, 0, None
        for batch in batches:
            for fp, seg, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fp != anchor and size >= SHARD_WORDS:
                    yield shard(held)
                    held, size = {}, 0
                anchor = fp
                if (fp, seg) not in held:  # rows of one text bring the same segment
                    held[fp, seg] = n, packed
                    size += len(packed) // 8
        if held:
            yield shard(held)

    dealt = segments.select("fp", "seg", "n", "words").repartition("fp").sortWithinPartitions("fp")
    return dealt.mapInArrow(run, _SPANS)


def _segments(docs: DataFrame) -> DataFrame:
    """The word hashes of the sites that ``hints`` (structs of fp, seg, n, hot, place) name in each text."""
    names = [part.split()[0] for part in _SEGMENTS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column("text"))
                hashes = found.hashes()
                rows = []
                for i, hints in enumerate(part.column("hints").to_pylist()):
                    own = hashes[found.first[i] : found.first[i + 1]]
                    for hint in hints:
                        start = hint["place"] >> 16 & 0xFFFFFFFF
                        segment = own[start : start + (hint["place"] & 0xFFFF)]
                        rows.append((hint["fp"], hint["seg"], hint["n"], hint["hot"], segment.tobytes()))
                if rows:
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, _SEGMENTS)


def _windows(segments: DataFrame, min_words: int) -> DataFrame:
    """Spans that repeat, for anchors with very many segments: every window of theirs is counted by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("words"))
            hashes, ends = np.frombuffer(data, np.uint64), ends // 8
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = np.flatnonzero(row[: max(0, len(row) - min_words + 1)] == row[min_words - 1 :])
            if not len(at):
                continue
            one, two = ranges(hashes, at, at + min_words), ranges(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at, at + min_words)
            own = pa.array(row[at])
            columns = [
                pa.array(one.view(np.int64)),
                pa.array(two.view(np.int64)),
                *(batch.column(c).take(own) for c in ("fp", "seg", "n")),
                pa.array((at - ends[row[at]]).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["one", "two", "fp", "seg", "n", "first"])

    rows = segments.dropDuplicates(["fp", "seg"]).select("fp", "seg", "n", "words")
    rows = rows.mapInArrow(run, "one long, two long, fp long, seg long, n long, first int")
    twice = rows.groupBy("one", "two").agg(F.sum("n").alias("n")).where("n > 1").select("one", "two")
    found = rows.join(twice, ["one", "two"], "left_semi")
    return found.select("fp", "seg", "first", (F.col("first") + min_words).alias("last"))


def _keys(text) -> tuple:
    """Eighty bits that stand for a text in the tables of sites and spans."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text).bitwiseAND(F.lit(0x7FFF)).cast("int")


def repeated_spans(docs: DataFrame, min_words: int = 35, text: str = "text") -> DataFrame:
    """key, tag, spans: for each distinct text with words to remove, its ``_keys`` and the spans (first word, last
    word + 1), in any order and overlapping.

    Every occurrence is removed, the first too. Two rows with one text are two texts. Null, empty and short
    texts have no windows; an empty table gives no rows.
    """
    key, tag = _keys(col(text))
    keyed = docs.select(key.alias("key"), tag.alias("tag"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    sites = _anchors(keyed, min_words)
    anchors = sites.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high"))
    anchors = anchors.where("n > 1").select("fp", (F.col("low") != F.col("high")).alias("open"))
    files = files_for(docs)
    # Dealt anew, so that adaptive execution may split the sites of an anchor that very many texts have.
    anchors = anchors.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    again = keep(sites.join(anchors, "fp"), files)
    tag = F.shiftrightunsigned("place", 48).cast("int").alias("tag")
    start = F.shiftrightunsigned("place", 16).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    stop = start + F.col("place").bitwiseAND(F.lit(0xFFFF)).cast("int")
    equal = again.where("not open").select("key", tag, start.alias("first"), stop.alias("last"))
    # One site stands for all equal ones.
    chosen = again.where("open").groupBy("fp", "seg").agg(F.count(F.lit(1)).alias("n"), F.min_by("place", "key").alias("place"), F.min("key").alias("key"))
    large = chosen.groupBy("fp").agg(F.count(F.lit(1)).alias("distinct")).where(F.col("distinct") > HOT).select("fp", F.lit(True).alias("hot"))
    chosen = chosen.join(large, "fp", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    hints = chosen.groupBy("key", tag).agg(F.collect_list(F.struct("fp", "seg", "n", "hot", "place")).alias("hints"))
    segments = keep(_segments(keyed.join(hints, ["key", "tag"])), files)
    spans = _matched(segments.where("not hot"), min_words).unionByName(_windows(segments.where("hot"), min_words))
    spans = again.where("open").join(spans, ["fp", "seg"])
    spans = spans.select("key", tag, (start + F.col("first")).alias("first"), (start + F.col("last")).alias("last"))
    return spans.unionByName(equal).groupBy("key", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _cut(text: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by one space."""
    found = text.split()
    edges = np.zeros(len(found) + 1, np.int32)
    for span in spans:
        edges[span["first"]] += 1
        edges[span["last"]] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    kept = [word for word, stays in zip(found, keep.tolist(), strict=True) if stays]
    return len(found), len(found) - len(kept), b" ".join(kept)


def remove_repeated(docs: DataFrame, min_words: int = 35, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text: the words that stay, joined by one space.

    All rows and columns stay, repeated rows too, save columns already named like the new ones. A text without
    words gives 0, 0 and an empty text.
    """
    base = without(docs, "n_words", "n_removed", "kept_text")
    new = [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType()),
    ]
    schema = T.StructType([*base.schema.fields, *new])
    spans = repeated_spans(docs, min_words, text).toDF("__rw_key", "__rw_tag", "__rw_spans")
    keyed, at = with_text(docs, base.columns, text)
    key, tag = _keys(col(keyed.columns[at]))
    rows = keyed.withColumns({"__rw_key": key, "__rw_tag": tag}).join(spans, ["__rw_key", "__rw_tag"], "left")
    rows = rows.select(*(col(c) for c in keyed.columns), "__rw_spans")
    width = len(base.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).cast(pa.binary()).to_pylist()
                got = [_cut(x or b"", s or ()) for x, s in zip(texts, part.columns[-1].to_pylist(), strict=True)]
                n, gone, kept = zip(*got, strict=True)
                new = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *new], schema.names)

    return rows.mapInArrow(run, schema)
