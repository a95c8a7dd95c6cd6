"""Chat formatting: records of different layouts to one text with marked turns and a loss mask.

A record's layout is told by a fingerprint: the hash of the nested field paths, of those that any layout knows, at
which it has a value. A table maps fingerprints to declarative mappings, which say where turns, roles and texts lie.
Everything is DataFrame functions.

The template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts ``<|`` gets a backslash between its
two characters (one more, if there are some already), so control strings occur in marks alone and each text can
be read back. Roles have ``%``, ``<`` and line ends percent-coded.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinsewell.functions.names import col

START, STOP = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns``: (role, path) in order, for a record of single fields; or ``each``: (list, role field, text field).
    A path in ``optional`` may be missing or null. ``roles`` renames roles.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.each:
            items, role, text = self.each
            return [*(path for _, path in self.turns), f"{items}[].{role}", f"{items}[].{text}"]
        return [path for _, path in self.turns]

    def fingerprints(self) -> list[str]:
        must = [p for p in self.paths() if p not in self.optional]
        return [fingerprint([*must, *some]) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]


MAPPINGS = (
    Mapping("messages", (("system", "system"),), ("messages", "role", "content"), ("system",)),
    Mapping("conversations", (("system", "system"),), ("conversations", "from", "value"), ("system",), (("human", "user"), ("gpt", "assistant"))),
    Mapping("prompt and completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), None, ("system",)),
    Mapping("prompt and response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), None, ("system",)),
    Mapping("question and answer", (("system", "system"), ("user", "question"), ("assistant", "answer")), None, ("system",)),
    Mapping("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), None, ("system", "input")),
)
#: A table with a row per turn; its rows are gathered by conversation.
ROWS = Mapping("rows by turn", (("", "conv_id"), ("", "turn"), ("", "role"), ("", "text")))


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, above: str = "") -> list[str]:
    """Paths of all fields of a schema; ``[]`` stands for the elements of a list."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{above}.{f.name}" if above else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{above}[]")
    return [above]


def _has(path: str) -> Column:
    if "[]." in path:
        items, inner = path.split("[].")
        return F.coalesce(F.exists(col(items), lambda x: x[inner].isNotNull()), F.lit(False))
    return col(path).isNotNull()


def _role(role: Column, mapping: Mapping) -> Column:
    out = role
    for old, new in mapping.roles:
        out = F.when(role == old, new).otherwise(out)
    return out


def _turns(mapping: Mapping, there: set[str]) -> Column:
    kind = F.array().cast(TURNS)
    parts = []
    for role, path in mapping.turns:
        if path in there:
            turn = F.array(F.struct(F.lit(role).alias("role"), F.coalesce(col(path).cast("string"), F.lit("")).alias("text")))
            parts.append(F.when(col(path).isNotNull(), turn).otherwise(kind))
    if mapping.each:
        items, role, text = mapping.each
        parts.append(
            F.transform(
                col(items),
                lambda x: F.struct(
                    _role(F.coalesce(x[role].cast("string"), F.lit("")), mapping).alias("role"),
                    F.coalesce(x[text].cast("string"), F.lit("")).alias("text"),
                ),
            )
        )
    return F.concat(*parts).cast(TURNS)


def canonical(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout`` (the mapping's name) and ``turns`` (array of role and text).

    Records may be of any mix of layouts; their fields are (nested) columns, other columns are left alone. Both
    new columns are null where no mapping has the record's fingerprint. Null roles and texts are empty.
    """
    there = {p for p in field_paths(records.schema)}
    known = sorted({p for m in mappings for p in m.paths() if p in there})
    usable = [m for m in mappings if all(p in there for p in m.paths() if p not in m.optional)]
    base = records.select(*(col(c) for c in records.columns if c not in ("layout", "turns")))
    if not usable:
        return base.withColumns({"layout": F.lit(None).cast("string"), "turns": F.lit(None).cast(TURNS)})
    present = F.array_compact(F.array(*(F.when(_has(p), p) for p in known)))
    rows = base.withColumn("__rw_fp", F.sha2(F.array_join(F.array_sort(present), "\n").cast("binary"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in usable:
        fits = F.col("__rw_fp").isin(m.fingerprints())
        layout, turns = F.when(fits, m.name).otherwise(layout), F.when(fits, _turns(m, there)).otherwise(turns)
    return rows.withColumns({"layout": layout, "turns": turns}).drop("__rw_fp")


def gathered(rows: DataFrame) -> DataFrame:
    """conv_id, turns of a table with a row per turn, in order of turn (ties: of role, then text; null comes first).

    The table is known by the fingerprint of its field paths, whatever other columns it has. A conversation is one
    value, as its text will be.
    """
    known = [p for p in ROWS.paths() if p in field_paths(rows.schema)]
    if fingerprint(known) not in ROWS.fingerprints():
        raise ValueError(f"no mapping for a table with the fields {field_paths(rows.schema)}")
    own = rows.select(
        col("conv_id"), F.struct(col("turn"), *(F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).alias("t")
    )
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return own.groupBy("conv_id").agg(turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _coded(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def _plain(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def formatted(records: DataFrame, turns: str = "turns") -> DataFrame:
    """``records`` with ``formatted`` and ``loss_mask``: for each turn the characters to train on, as an offset into
    the turn's part of the text and a length; 0 for other roles than the assistant's. No turns, empty text."""
    base = records.select(*(col(c) for c in records.columns if c not in ("formatted", "loss_mask")))
    own = F.coalesce(col(turns), F.array().cast(TURNS))
    head = lambda t: F.concat(F.lit(START), _coded(t["role"]), F.lit("\n"))
    text = F.array_join(F.transform(own, lambda t: F.concat(head(t), escape(t["text"]), F.lit(STOP))), "")
    mask = F.transform(
        own,
        lambda t: F.struct(
            F.length(head(t)).alias("offset"), F.when(t["role"] == TRAINED, F.length(escape(t["text"]))).otherwise(0).alias("length")
        ),
    )
    return base.withColumns({"formatted": text, "loss_mask": mask})


def _parts(text: Column) -> Column:
    parts = F.split(text, STOP.replace("|", r"\|"), -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    return F.transform(
        _parts(text),
        lambda p: F.struct(
            _plain(F.substring(F.substring_index(p, "\n", 1), len(START) + 1, 1 << 30)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )


def read_loss(text: Column, mask: Column) -> Column:
    """All text under the mask, as it was before it was escaped."""
    return F.array_join(F.zip_with(_parts(text), mask, lambda p, m: unescape(F.substr(p, m["offset"] + 1, m["length"]))), "")
