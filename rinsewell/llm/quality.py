"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is trained on trusted rows (labelled of good quality, not toxic): all texts with an even hash. The others give the
quantile of perplexity per language above which a document is rejected. Trigrams are dealt by their context and counted; pairs
of words, dealt by their hash, and words follow from them. The model is a table of these counts, packed by shards of hashes, of any
size: blocks of texts look their n-grams up in it, and every document is scored once, on its whole text. Counts and
texts are worked off in ranges, and what was kept for one of them is dropped with it, so that little is on disk at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsewell.functions.names import col

from .rows import with_text
from .sequences import (
    BLOCK_BYTES,
    HELD,
    Places,
    Taken,
    answered,
    ask,
    dealt,
    distinct,
    gathered,
    in_blocks,
    looked_up,
    new_at,
    parts,
    shard_bits,
    text_bytes,
    with_answers,
)
from .tables import drop, files_for, keep, keep_dealt, without
from .words import mix, slices, words

TRAIN_CHARS = math.inf  # of trusted text per language: all of it
QUANTILE = 0.99
BINS = 10_000  # of perplexity, for each factor of e
RANGE_BITS = 12  # of the hash, for the ranges that the sample is taken from
_BEGIN, _END, _UNSEEN = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0x082EFA98EC4E6C89)
_STEP = np.uint64(0x9E3779B97F4A7C15)
RANGES = 8  # of texts, which are scored one after the other
TRAIN_RANGES = 4  # of shards, which are counted one after the other
SHARD_BITS = 4  # at least

# What packed rows hold: n-grams of one to three words, by length, and what leads there.
_TRIGRAMS, _CONTEXTS, _PAIRS, _FIRST, _LAST, _SUMS = range(4, 10)
_NAMES = ("n", "total", "once", "twice", "more")
_SUM_NAMES = ("n1", "n2", "n3", "n4", "words", "total")
_COUNTED = f"{HELD}, level int, {', '.join(f'{x} long' for x in _SUM_NAMES)}"


@dataclass
class Model:
    """``rows``: packed and in buckets by shard, of which ``bits`` of a hash tell; n-grams of one and two words (kind 1 and 2) with their number, and as
    contexts, with the sum of the numbers of what follows and how many of these are one, two, and more; those of three words (kind 3)
    with their number. ``taken``: of each language (by its key) and length, what is taken from the numbers one, two, and more;
    ``root``: of each language the sum of the numbers of words, and the chance of a word never seen."""

    rows: DataFrame
    bits: int
    taken: dict[int, list[list[float]]]
    root: dict[int, tuple[float, float]]


def _hashes(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Hashes of each token (words and one end per text) and of its contexts; each language has its own."""
    found = words(part.column("text"))
    salts = np.array([xxhash.xxh64_intdigest((lang or "").encode(), 1) for lang in part.column("lang").to_pylist()], np.uint64)
    sizes = np.diff(found.first) + 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    end = starts + sizes - 1
    inner = np.ones(len(doc), bool)
    inner[end] = False
    word = np.empty(len(doc), np.uint64)
    word[inner] = found.hashes()
    word[end] = _END
    word = mix(word ^ salts[doc])
    begin = mix(_BEGIN ^ salts)

    def before(values: np.ndarray) -> np.ndarray:
        moved = np.empty_like(values)
        moved[1:] = values[:-1]
        moved[starts] = begin
        return moved

    one = before(word)
    two = before(one)
    return {"word": word, "one": one, "first": two, "doc": doc, "starts": starts, "salts": salts}


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _STEP + second)


def _unseen(salts: np.ndarray) -> np.ndarray:
    """The key under which the model has a language's unseen words, and by which it knows the language."""
    return mix(_UNSEEN ^ salts)


def _trigrams(docs: DataFrame, bits: int, part: tuple[int, int]) -> DataFrame:
    """The trigrams of blocks of texts, dealt by the context of two words: packed, with the second word, the third, and the number. Of
    the contexts only those whose shards are in ``part`` (first, last)."""
    first, last = part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows in slices(batch, "text"):
                held.append(found(rows))
                size += rows.column(1).nbytes
                if size >= BLOCK_BYTES:
                    yield from block(held)
                    held, size = [], 0
        yield from block(held)

    def found(rows: pa.RecordBatch) -> np.ndarray:
        all_of = _hashes(rows)
        ab = _pair(all_of["first"], all_of["one"])
        shard = ab >> np.uint64(64 - bits)
        own = np.flatnonzero((shard >= first) & (shard <= last))
        return np.vstack([_unseen(all_of["salts"])[all_of["doc"][own]], *(x[own] for x in (ab, all_of["one"], all_of["word"]))])

    def block(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            lang, ab, b, c = np.concatenate(held, axis=1)
            for key in distinct(lang):
                own = lang == key
                at, n = _grouped(ab[own], c[own])
                yield from dealt(_TRIGRAMS, _signed(key), ab[own][at], [b[own][at], c[own][at], n], bits).to_batches()

    return docs.select("lang", "text").mapInArrow(run, HELD)


def _grouped(*keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, or pair of keys, in order of the first; and how often it occurs, or the sum of ``n``."""
    code = _pair(*keys) if len(keys) > 1 else keys[0]
    order = np.argsort(code)
    starts = new_at(code[order])
    if n is None:
        n = np.diff(np.append(starts, len(order)))
    elif len(order):
        n = np.add.reduceat(n[order], starts)
    at, n = order[starts], n.astype(np.uint64)
    if len(keys) > 1:
        order = np.argsort(keys[0][at])
        at, n = at[order], n[order]
    return at, n


def _signed(key: np.uint64) -> int:
    return int(np.asarray(key, np.uint64).view(np.int64))


def _follow(context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The contexts, each once, in order; sums of the numbers of what follows, and how many are one, two, and more."""
    order = np.argsort(context, kind="stable")  # mostly in order
    context, n = context[order], n[order]
    starts = new_at(context)
    return context[starts], [np.add.reduceat(x, starts, dtype=np.uint64) if len(n) else n for x in (n, n == 1, n == 2, n > 2)]


def _sums(lang: int, level: int, n: np.ndarray) -> pa.Table:
    """How many n-grams have the numbers one to four, how many there are, and the sum of their numbers."""
    values = [*((n == k).sum() for k in (1, 2, 3, 4)), len(n), n.sum()]
    columns = {"kind": _SUMS, "shard": 0, "lang": lang, "codes": None, "data": None, "level": level, **dict(zip(_SUM_NAMES, map(int, values), strict=True))}
    return pa.table({k: pa.array([v], pa.int32() if k in ("kind", "level") else pa.binary() if v is None else pa.int64()) for k, v in columns.items()})


def _counted(rows: DataFrame, count: Callable[[int, pa.Table], list[pa.Table]]) -> DataFrame:
    """``count`` for the packed rows of each shard and language."""
    names = [x.split()[0] for x in _COUNTED.split(", ")]

    def run(key: tuple, own: pa.Table) -> pa.Table:
        done = pa.concat_tables(count(key[1].as_py(), own), promote_options="default")
        for name in names:
            if name not in done.column_names:
                done = done.append_column(name, pa.nulls(done.num_rows, pa.int32() if name == "level" else pa.int64()))
        return done.select(names)

    return rows.groupBy("shard", "lang").applyInArrow(run, _COUNTED)


def _count_three(bits: int) -> Callable[[int, pa.Table], list[pa.Table]]:
    def count(lang: int, rows: pa.Table) -> list[pa.Table]:
        ab, b, c, n = gathered(rows, _TRIGRAMS, 3)
        at, n = _grouped(ab, c, n=n)
        ab, b, c = ab[at], b[at], c[at]
        codes = _pair(ab, c)
        order = np.argsort(codes)
        contexts, sums = _follow(ab, n)
        pairs, before = _grouped(b, c)
        b, c = b[pairs], c[pairs]
        shard = _pair(b, c) >> np.uint64(64 - bits)
        to = np.argsort(shard, kind="stable")
        return [
            dealt(3, lang, codes[order], [n[order]], bits),
            dealt(_CONTEXTS, lang, contexts, sums, bits),
            dealt(_PAIRS, lang, b[to], [c[to], before[to]], bits, shard[to]),
            _sums(lang, 3, n),
        ]

    return count


def _merged(codes: np.ndarray, n: np.ndarray, contexts: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes in order, each once, with their numbers as n-grams and their sums as contexts, 0 for what they are not."""
    every = distinct(np.append(codes, contexts))
    columns = [np.zeros(len(every), np.uint64) for _ in range(1 + len(sums))]
    columns[0][np.searchsorted(every, codes)] = n
    at = np.searchsorted(every, contexts)
    for column, values in zip(columns[1:], sums, strict=True):
        column[at] = values
    return every, columns


def _count_two(bits: int) -> Callable[[int, pa.Table], list[pa.Table]]:
    def count(lang: int, rows: pa.Table) -> list[pa.Table]:
        contexts, *sums = gathered(rows, _CONTEXTS, 4)
        b, c, n = gathered(rows, _PAIRS, 2)
        at, n = _grouped(b, c, n=n)
        b, c = b[at], c[at]
        last, times = _grouped(c)
        codes, columns = _merged(_pair(b, c), n, contexts, sums)
        return [dealt(2, lang, codes, columns, bits), dealt(_FIRST, lang, *_follow(b, n), bits), dealt(_LAST, lang, c[last], [times], bits), _sums(lang, 2, n)]

    return count


def _count_one(bits: int) -> Callable[[int, pa.Table], list[pa.Table]]:
    def count(lang: int, rows: pa.Table) -> list[pa.Table]:
        b, *sums = gathered(rows, _FIRST, 4)
        c, n = gathered(rows, _LAST, 1)
        at, times = _grouped(c, n=n)
        contexts = b[_grouped(b)[0]]
        sums = [_grouped(b, n=x)[1] for x in sums]
        codes, columns = _merged(c[at], times, contexts, sums)
        return [dealt(1, lang, codes, columns, bits), _sums(lang, 1, times)]

    return count


def _packed(bits: int) -> Callable[[int, pa.Table], list[pa.Table]]:
    def packed(lang: int, rows: pa.Table) -> list[pa.Table]:
        done = []
        for kind, width in ((1, 5), (2, 5), (3, 1)):
            codes, *columns = gathered(rows, kind, width)
            order = np.argsort(codes)
            done.append(dealt(kind, lang, codes[order], [x[order] for x in columns], bits))
        return done

    return packed


def _ranges(size: int, shards: int) -> list[tuple[int, int]]:
    """Ranges of shards, first and last: ``TRAIN_RANGES`` of them, or fewer if blocks are."""
    n = max(1, min(TRAIN_RANGES, size // BLOCK_BYTES, shards))
    return [(i * shards // n, (i + 1) * shards // n - 1) for i in range(n)]


def _discount(n: list[int]) -> list[float]:
    """What is taken from counts of one, two, and three or more, by how many counts are one to four."""
    y = n[0] / max(n[0] + 2 * n[1], 1)
    return [min(max(k - (k + 1) * y * n[k] / max(n[k - 1], 1), 0.1), k - 0.1) for k in (1, 2, 3)]


def train(docs: DataFrame, bits: int = SHARD_BITS) -> Model:
    """The model of the given rows (lang, text); ``bits``: for the shards, at least. ``docs`` is read ``TRAIN_RANGES`` times."""
    files = files_for(docs)
    size = text_bytes(docs, "text")
    bits = max(bits, SHARD_BITS, shard_bits(size))
    parts = _ranges(size, 1 << bits)
    three = [keep(_counted(_trigrams(docs, bits, part), _count_three(bits)), files, by="kind") for part in parts]
    led = reduce(DataFrame.unionByName, three).where(F.col("kind").isin(_CONTEXTS, _PAIRS))
    two = [keep(_counted(led.where(F.col("shard").between(*part)), _count_two(bits)), files, by="kind") for part in parts]
    for kind in (_CONTEXTS, _PAIRS):
        drop(*three, only=f"kind={kind}")
    led = reduce(DataFrame.unionByName, two).where(F.col("kind").isin(_FIRST, _LAST))
    one = keep(_counted(led, _count_one(bits)), files, by="kind")
    for kind in (_FIRST, _LAST):
        drop(*two, only=f"kind={kind}")
    every = reduce(DataFrame.unionByName, [one, *two, *three])
    taken, root = {}, {}
    sums = every.where(F.col("kind") == _SUMS).groupBy("lang", "level").agg(*(F.sum(x).alias(x) for x in _SUM_NAMES))
    for r in sums.collect():
        d = taken.setdefault(r.lang, [[]] * 4)
        d[r.level] = _discount([r.n1, r.n2, r.n3, r.n4])
        if r.level == 1:
            gone = d[1][0] * r.n1 + d[1][1] * r.n2 + d[1][2] * (r.words - r.n1 - r.n2)
            root[r.lang] = (float(r.total), gone / r.total / (r.words + 1))
    # Each shard of contexts has told of trigrams in all shards; what is read for each range of texts has one row of a shard, language and kind.
    names = ["kind", "shard", "lang", "codes", "data"]
    rows = keep_dealt(every.where(F.col("kind").isin(1, 2, 3)).select(names), "shard", lambda x: _counted(x, _packed(bits)).select(names))
    drop(one, *two, *three)
    return Model(rows, bits, taken, root)


def _read(rows: pa.Table) -> tuple[np.ndarray, Taken]:
    """Codes of packed rows of the model, and what takes their numbers as n-grams, and as contexts their totals and how many follow once,
    twice, and more often; 0 for what they are not."""
    codes, n, *follow = (np.concatenate(x) for x in zip(*(gathered(rows, level, 5) for level in (1, 2)), strict=True))
    three, times = gathered(rows, 3, 1)
    last = len(codes)
    codes, n, follow = np.append(codes, three), np.append(n, times), [np.append(x, np.uint64(0)) for x in follow]
    order = np.argsort(codes)

    def taken(at: np.ndarray) -> list[np.ndarray]:
        own = order[at]
        return [n[own], *(x[np.minimum(own, last)] for x in follow)]

    return codes[order], taken


def perplexities(docs: DataFrame, model: Model, langs: list[str], text: str = "text", lang: str = "lang", only: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``only``, with n_tokens (words and one end) and perplexity of the whole text; null
    counts as empty. ``langs``: the languages that the model was trained on; texts of others ask for nothing.

    Written to the shared folder, by ``RANGES`` of the hashes of texts, or fewer if there are fewer blocks: each reads ``docs`` anew and
    keeps its own texts only while it looks their n-grams up.
    """
    base = without(docs.select(*only) if only else docs, "n_tokens", "perplexity")
    schema = T.StructType([*base.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    width, files, trained = len(base.columns), files_for(docs), set(langs)
    rows, at = with_text(docs.withColumn("__rw_spoken", F.coalesce(col(lang).cast("string"), F.lit(""))), [*base.columns, "__rw_spoken"], text)
    name, bits = rows.columns[at], model.bits
    numbers = {key: i for i, key in enumerate(model.root)}
    tokens, floor = np.array([*model.root.values(), (1, 1e-7)], float).T  # 1e-7: of a language that was not trained
    gone = np.zeros((4, len(numbers) + 1, 4))  # by level, language, and number
    for key, i in numbers.items():
        gone[1:, i, 1:] = model.taken[key][1:]
    ranges = max(1, min(RANGES, text_bytes(rows, name) // BLOCK_BYTES))

    def texts(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        return _hashes(pa.RecordBatch.from_arrays([part.column("__rw_spoken"), part.column(name)], ["lang", "text"]))

    def find(part: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
        found = texts(part)
        known = np.array([x in trained for x in part.column("__rw_spoken").to_pylist()], bool)
        own, salts = known[found["doc"]], found["salts"][known]
        begin = mix(_BEGIN ^ salts)
        word, two = found["word"], _pair(found["one"], found["word"])
        three = _pair(_pair(found["first"], found["one"]), word)
        levels = [np.concatenate([word[own], begin]), np.concatenate([two[own], _pair(begin, begin)]), three[own]]
        return [(i, codes, np.zeros(len(codes), bool)) for i, codes in enumerate(levels)]

    def score(block: int, own: pa.Table, answers: pa.Table) -> pa.Table:
        codes, *values = answered(answers, *_NAMES, kind=np.int64)
        place = Places(codes)
        n, total, *follow = (np.append(x, 0) for x in values)
        done = []
        for part in parts(own, name):
            found = texts(part)
            lang = np.array([numbers.get(x, len(numbers)) for x in _unseen(found["salts"]).view(np.int64).tolist()], int)[found["doc"]]
            starts, begin = found["starts"], mix(_BEGIN ^ found["salts"])
            word, two = place(found["word"]), place(_pair(found["one"], found["word"]))
            three = place(_pair(_pair(found["first"], found["one"]), found["word"]))

            def seen(at: np.ndarray, level: int, lang: np.ndarray) -> np.ndarray:
                return n[at] - gone[level, lang, np.minimum(n[at], 3)]

            out = floor[lang]
            out = np.where(n[word] > 0, seen(word, 1, lang) / tokens[lang] + out, out)
            # The context of a token ends with the token before it.
            for level, shorter, first, longer in ((2, word, begin, two), (3, two, _pair(begin, begin), three)):
                at = np.empty_like(shorter)
                at[1:] = shorter[:-1]
                at[starts] = place(first)
                some = np.flatnonzero(total[at] > 0)
                at, spoken = at[some], lang[some]
                left = sum((x[at] * gone[level, spoken, k] for k, x in enumerate(follow, 1)), np.zeros(len(some))) / total[at]
                out[some] = seen(longer[some], level, spoken) / total[at] + left * out[some]
            sizes = np.diff(np.append(starts, len(out)))
            new = [pa.array(sizes.astype(np.int64)), pa.array(10 ** (-np.add.reduceat(np.log10(out), starts) / sizes))]
            done.append(pa.RecordBatch.from_arrays([*part.columns[:width], *new], schema.names))
        if not done:  # answers to a block of which there are no rows
            done = [pa.RecordBatch.from_arrays([*(x.combine_chunks() for x in own.columns[:width]), pa.array([], pa.int64()), pa.array([], pa.float64())], schema.names)]
        return pa.Table.from_batches(done)

    part, scored = F.pmod(F.xxhash64(col(name)), F.lit(ranges)), []
    for i in range(ranges):
        some = in_blocks(rows.where(part == i), name, files)
        found = looked_up(ask(some, name, bits, find), model.rows, _read, _NAMES)
        scored.append(keep(with_answers(some, found, score, schema), files))
        drop(some)
    return reduce(DataFrame.unionByName, scored)


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id").distinct()


def _hashed(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("h", F.xxhash64("text"))


def _reached(facts: DataFrame) -> DataFrame:
    """The rows of ``facts`` (lang, late, h, size) that the bound on the sample can reach, and few others.

    Sizes are summed by ranges of hashes first, so that no task orders all texts of a language.
    """
    own = Window.partitionBy("lang")
    early = facts.where(F.col("late") == 0).withColumn("range", F.shiftright("h", 64 - RANGE_BITS))
    before = F.coalesce(F.sum("size").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = early.groupBy("lang", "range").agg(F.sum("size").alias("size")).withColumn("before", before)
    ranges = ranges.where(F.col("before") <= TRAIN_CHARS).select("lang", "range")
    early = early.join(ranges, ["lang", "range"], "left_semi").drop("range")
    # Each of the others has more than a tenth of the bound.
    late = facts.where(F.col("late") > 0).withColumn("n", F.row_number().over(own.orderBy("late", "h"))).where(F.col("n") <= 10).drop("n")
    return early.unionByName(late)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, h, text: trusted texts to train on, one of each language at least.

    Texts with an even hash are in it, up to ``TRAIN_CHARS`` if that is a bound, and those with an odd one are held out, but for the first of a language
    without even ones; of two texts or more one is always held out. With
    a bound they come by hash; those of more than a tenth of
    the bound come last, short ones first, so that none of them ends the sample before the others had their turn.
    """
    rows = _hashed(docs)
    facts = rows.select("doc_id", "lang", F.length("text").alias("size"), "h").join(_trusted(labels), "doc_id")
    facts = facts.groupBy("lang", "h").agg(F.greatest(F.max("size"), F.lit(100)).cast("long").alias("size"))
    bounded = TRAIN_CHARS < math.inf
    late = F.when(F.col("size") > TRAIN_CHARS // 10, F.col("size")).otherwise(F.lit(0)) if bounded else F.lit(0)
    facts = facts.withColumn("late", late.cast("long"))
    facts = facts.withColumn("place", F.struct(F.pmod("h", F.lit(2)).alias("odd"), "late", "h"))
    facts = kept = keep(facts, files_for(docs))  # read twice
    ends = facts.groupBy("lang").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    may = facts.join(ends, "lang").where((F.col("place") == F.col("first")) | ((F.col("place.odd") == 0) & (F.col("place") < F.col("last"))))
    chosen = may.select("lang", "h")
    if bounded:
        order = Window.partitionBy("lang").orderBy("late", "h")
        placed = _reached(may).select("lang", "late", "h", F.row_number().over(order).alias("n"), F.sum("size").over(order).alias("total"))
        chosen = placed.where((F.col("total") <= TRAIN_CHARS) | (F.col("n") == 1)).select("lang", "h")
    texts = rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    texts = keep(texts, files_for(docs))
    drop(kept)
    return texts


def _thresholds(scored: DataFrame, labels: DataFrame, trained: DataFrame, quantile: float) -> DataFrame:
    """lang, threshold: the quantile over all trusted texts that are not ``trained`` on, each counted once; ``scored`` has
    doc_id, lang, h, perplexity.

    Texts are counted by narrow bins of perplexity, whose number has a bound. The threshold is the greatest perplexity in
    the bin that the quantile falls in.
    """
    held = scored.select("doc_id", "lang", "h", "perplexity").join(_trusted(labels), "doc_id")
    held = held.join(trained.select("lang", "h"), ["lang", "h"], "left_anti")
    held = held.groupBy("lang", "h").agg(F.max("perplexity").alias("perplexity"))
    bins = held.groupBy("lang", F.floor(F.log("perplexity") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("perplexity").alias("most"))
    every = Window.partitionBy("lang")
    bins = bins.select("lang", "most", F.sum("n").over(every.orderBy("bin")).alias("upto"), F.sum("n").over(every).alias("all"))
    return bins.where(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(F.min("most").alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, with_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with n_tokens, perplexity, threshold and keep.

    ``labels`` has doc_id, quality, toxic. keep is false where the perplexity exceeds the threshold of the language:
    the quantile over all trusted texts held out from training. Languages with fewer than two trusted texts have no
    threshold, and their rows stay. Null language is a language of its own. All rows stay, with repeated ones; columns already named
    like the new ones are replaced. Every text is scored once, and the result is kept as a table until thresholds
    are known: without the texts, if they are not wanted back (``with_text``).
    """
    base = without(docs, "n_tokens", "perplexity", "threshold", "keep")
    sample = _sample(docs, labels)
    langs = [r["lang"] for r in sample.select("lang").distinct().collect()]
    model = train(sample, shard_bits(text_bytes(base, "text") // RANGES))
    trained = keep(sample.select("lang", "h"), files_for(sample))
    drop(sample)
    own = [name for name in base.columns if with_text or name.lower() != "text"]
    facts = {"__rw_lang": F.coalesce("lang", F.lit("")), "__rw_h": F.xxhash64(F.coalesce("text", F.lit("")))}
    rows = perplexities(base.withColumns(facts), model, langs, only=[*own, *facts])
    drop(model.rows)
    scored = rows.select("doc_id", F.col("__rw_lang").alias("lang"), F.col("__rw_h").alias("h"), "perplexity")
    limits = keep(_thresholds(scored, labels, trained, quantile).withColumnRenamed("lang", "__rw_of"), 1)
    drop(trained)
    rows = rows.join(limits, F.col("__rw_lang") == F.col("__rw_of"), "left").drop("__rw_of", *facts)
    return rows.withColumn("keep", ~F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False)))
