"""Removal of lines that many documents hold.

Lines are exploded, normalised and hashed to 128 bits; the documents of each hash are counted, hash and document dealt
together first, so that a line of a third of all documents is counted by many tasks. Only hashes travel: what goes
back to a document is the list of places of the lines that it loses, and the lines that stay are put together again
by their places. Hashes over the threshold are not broadcast unless adaptive execution has measured them to be few;
a join on a hot hash is split by it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinsewell.functions.names import col

from .tables import text_key, without

_SPACE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case; other letters stay as they are."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc, text_key, place: the places, from 0, of the lines that go, for each document and text that loses some."""
    value = F.coalesce(col(text).cast("string"), F.lit(""))
    # The key is made before the lines are exploded, once a text and not once a line.
    rows = docs.select(col(key).alias("doc"), text_key(col(text)).alias("text_key"), _lines(value).alias("lines"))
    exploded = rows.select("doc", "text_key", F.posexplode("lines").alias("place", "line"))
    long = exploded.where(F.length("line") >= min_chars).select("doc", "text_key", "place", line_key(F.col("line")).alias("line"))
    hashed = long.where(F.length("line") >= min_chars).select(
        "doc", "text_key", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )
    common = hashed.groupBy("h1", "h2").agg(F.count_distinct(F.struct("doc")).alias("n"), F.max("doc").alias("largest"))
    # Dealt anew, so that adaptive execution may split the lines of a hash that very many documents hold.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = common.where(F.col("n") >= min_docs).select("h1", "h2", "largest").repartition(tasks)
    gone = hashed.join(common, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("largest")))
    return gone.groupBy("doc", "text_key").agg(F.collect_set("place").alias("place"))


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A text is split at ``\\n``; a null or empty one is one empty line. The lines of a key (see ``line_key``) of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold go, all of them, except in the document of
    the largest ``key``. The other lines stay, joined by ``\\n``.

    Rows that share a key are one document, null being one too and smaller than all others; repeated rows have equal
    results. No rows give no rows. Columns of ``docs`` named like the new ones give way to them.
    """
    base = without(docs, "n_lines", "n_dropped", "kept_text")
    gone = repeated_lines(docs, key, text, min_chars, min_docs)
    value = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = base.select("*", text_key(col(text)).alias("__rw_key"), _lines(value).alias("__rw_lines"))
    gone = gone.withColumnsRenamed({"doc": "__rw_doc", "text_key": "__rw_text", "place": "__rw_place"})
    rows = rows.join(gone, col(key).eqNullSafe(F.col("__rw_doc")) & (F.col("__rw_key") == F.col("__rw_text")), "left")
    lines, dropped = F.col("__rw_lines"), F.coalesce("__rw_place", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)  # in order
    return rows.select(
        *map(col, base.columns),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda at: F.get(lines, at)), "\n").alias("kept_text"),
    )
