"""Chat formatting by schema fingerprints.

Input layouts differ: message arrays, prompt and response columns,
instruction triples, one row per turn.  The nested field paths of a schema are
hashed to a fingerprint, the fingerprint selects a declarative mapping, and
the mapping is compiled to column expressions that give canonical turns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
_HEAD_BREAK = "<|nl|>"

_TURNS = "array<struct<role:string,text:string>>"


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths, lower case, arrays marked ``[]``; leaf types don't count."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How one layout gives turns.

    ``messages``: (array column, role field, text field).  ``fields``: (role, column) in order, empty optional ones left out.
    ``rows``: (order column, role column, text column) of a layout with a row per turn.
    ``paths``: those whose fingerprint selects the mapping; other columns of the data are ignored.
    """

    name: str
    paths: tuple[str, ...]
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    rows: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


#: Names that layouts use for the canonical roles.
ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

MAPPINGS = (
    Mapping("turn_rows", ("turn", "role", "text"), rows=("turn", "role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), messages=("messages", "role", "content"), roles=ROLES),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value"), roles=ROLES),
    Mapping("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction", ("instruction", "input", "output"), optional=("input",),
            fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), optional=("system",),
            fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)

REGISTRY = {fingerprint(list(m.paths)): m for m in MAPPINGS}


def select_mapping(schema: T.StructType, registry: dict[str, Mapping] | None = None) -> Mapping:
    """The mapping whose paths are all in ``schema``: that of the same fingerprint, or else, with extra columns
    present, the one whose fingerprint is that of the most of the schema's paths."""
    registry = REGISTRY if registry is None else registry
    have = field_paths(schema)
    if (m := registry.get(fingerprint(have))) is not None:
        return m
    within = [m for m in registry.values() if set(m.paths) <= set(have) and registry.get(fingerprint(list(m.paths))) is m]
    if not within:
        raise ValueError(f"no mapping for the field paths {sorted(have)}")
    return max(within, key=lambda m: (len(m.paths), m.name))


def _named(schema: T.StructType, name: str) -> str:
    """The field's name as the schema writes it; fingerprints don't tell cases apart, and neither do mappings."""
    return name if name in schema.names else next(f for f in schema.names if f.lower() == name)


def canonical_turns(df: DataFrame, key: str = "conv_id", mapping: Mapping | None = None) -> DataFrame:
    """``(key, turns)``; null texts and roles become empty strings, a null message array has no turns and
    a null message in one is no turn.

    Rows per turn are put in order of (turn, role, text): nulls first, ties and
    repeated rows kept, one conversation per key, null keys together.  The other layouts give one conversation
    per row.
    """
    m = mapping or select_mapping(df.schema)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def role(c: Column) -> Column:
        c = text(c)
        for a, b in m.roles:
            c = F.when(c == a, b).otherwise(c)
        return c

    if m.rows:
        order, who, what = m.rows
        one = F.struct(F.col(order).alias("o"), role(F.col(who)).alias("role"), text(F.col(what)).alias("text"))
        rows = df.select(F.col(key).alias(key), one.alias("one")).groupBy(key).agg(F.array_sort(F.collect_list("one")).alias("all"))
        turns = F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
        return rows.select(key, turns.cast(_TURNS).alias("turns"))
    if m.messages:
        array = _named(df.schema, m.messages[0])
        who, what = (_named(df.schema[array].dataType.elementType, x) for x in m.messages[1:])
        turns = F.transform(F.coalesce(F.filter(array, lambda x: x.isNotNull()), F.array().cast(df.schema[array].dataType)),
                            lambda x: F.struct(role(x[who]).alias("role"), text(x[what]).alias("text")))
    else:
        each = [F.when((text(F.col(c)) != "") if c in m.optional else F.lit(True), F.struct(F.lit(r).alias("role"), text(F.col(c)).alias("text")))
                for r, c in m.fields]
        turns = F.filter(F.array(*each), lambda x: x.isNotNull())
    return df.select(F.col(key).alias(key), turns.cast(_TURNS).alias("turns"))


def escape(c: Column) -> Column:
    """No ``<|`` is left: one backslash goes into every ``<``, backslashes, ``|``; so it can be taken out again."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def format_chat(turns: DataFrame, key: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """``(key, formatted, sizes)``: the marked text and, for each turn, the code points of the turn, its head and
    its body and whether the loss mask is set on the body."""
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(_HEAD_BREAK)), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learn).alias("learn")))
    tail = END + "\n"
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(tail)
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    sizes = F.transform("parts", lambda p: F.struct(size(p).cast("long").alias("n"), F.length(p["head"]).cast("long").alias("head"),
                                                    F.length(p["body"]).cast("long").alias("body"), p["learn"].alias("learn")))
    return turns.select(key, parts.alias("parts")).select(key, text.alias("formatted"), sizes.alias("sizes"))


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, unescaped."""
    import re

    undo = lambda s: re.sub(r"<\\(\\*)\|", r"<\1|", s)
    out = []
    for part in formatted.split(END + "\n")[:-1]:
        head, _, body = part.partition("\n")
        out.append((undo(head[len(START):].replace(_HEAD_BREAK, "\n")), undo(body)))
    return out


def chat_digest(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Reads formatted conversations back: turns from the marks, what is learnt from the mask."""

    def digest(batches):
        import re

        undo = re.compile(r"<\\(\\*)\|")
        for b in batches:
            rows = []
            for text, sizes in zip(b.column(1), b.column(2)):
                text, at, mask = text.as_py(), 0, []
                for s in sizes.as_py():
                    if s["learn"]:
                        mask.append((at + s["head"], s["body"]))
                    at += s["n"]
                turns = parse_chat(text)
                all_turns, loss, n = hashlib.sha256(), hashlib.sha256(), 0
                for role, body in turns:
                    all_turns.update(f"{role}\n{body}\n".encode())
                for start, size in mask:
                    body = undo.sub(r"<\1|", text[start:start + size])
                    n += len(body)
                    loss.update(body.encode())
                rows.append((len(turns), all_turns.hexdigest(), n, loss.hexdigest(), len(text)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]],
                names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema[key].dataType.simpleString()
    return formatted.select(key, "formatted", "sizes").mapInArrow(digest, f"{key} {kind}, {_DIGEST}")


#: The conversation that op4 adds: its texts look like the template.
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"

ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>')) + 1
      + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
