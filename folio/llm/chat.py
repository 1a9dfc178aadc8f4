"""Chat formatting by schema fingerprints, in DataFrame operations only.

A record's fingerprint for a mapping is the hash of its nested field paths, sorted, out of those that the mapping names;
the mapping of the most paths whose own hash it is turns the layout into canonical turns (role, text). Fields beyond it
change nothing. Turns are then written in one template with a loss mask, and can be read back from the output exactly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Declarative mappings by the nested field paths of a layout. `list`: a list of turns and its fields. `fields`: one
#: turn a field, in this order; a field pair is joined by a blank line, and an empty or absent field makes no turn.
MAPPINGS: dict[str, dict] = {
    "openai": {"paths": ["messages", "messages[].role", "messages[].content"], "list": ("messages", "role", "content")},
    "sharegpt": {"paths": ["conversations", "conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    "dialogue": {"paths": ["turns", "turns[].role", "turns[].text"], "list": ("turns", "role", "text")},
    "alpaca": {"paths": ["instruction", "input", "output"], "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "instruction": {"paths": ["instruction", "output"], "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_response": {"paths": ["instruction", "response"], "fields": [("user", ["instruction"]), ("assistant", ["response"])]},
    "prompt": {"paths": ["prompt", "completion"], "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"paths": ["prompt", "response"], "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    "system_prompt": {"paths": ["system", "prompt", "response"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "question": {"paths": ["question", "answer"], "fields": [("user", ["question"]), ("assistant", ["answer"])]},
    "rows": {"paths": ["conv_id", "turn", "role", "text"], "rows": ("conv_id", "turn", "role", "text")},
}
#: Roles of other layouts as canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}

LISTS = sorted({m["list"][0] for m in MAPPINGS.values() if "list" in m})


def fingerprint(paths: list[str], named: list[str]) -> str:
    """SHA-256 of the sorted paths out of those named."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(named))).encode()).hexdigest()


#: Mappings by their own fingerprints, those of the most paths first.
BY_PRINT = {fingerprint(m["paths"], m["paths"]): name for name, m in sorted(MAPPINGS.items(), key=lambda x: -len(x[1]["paths"]))}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; [] stands for the elements of a list."""
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        named = [(f"{at}.{f.name}" if at else f.name, f.dataType) for f in kind]
        return [p for name, held in named for p in (name, *schema_paths(held, name))]
    return []


def json_paths(record: Column) -> Column:
    """The nested field paths of a JSON record, computed row by row."""
    none = F.array().cast("array<string>")
    top = F.coalesce(F.json_object_keys(record), none)

    def within(name: str) -> Column:
        # The fields of all elements; a list without elements lacks none of those that its mapping names.
        held = F.from_json(F.get_json_object(record, f"$.{name}"), "array<string>")
        named = [p for m in MAPPINGS.values() if "list" in m and m["list"][0] == name for p in m["paths"] if "[]" in p]
        keys = F.flatten(F.transform(held, lambda x: F.coalesce(F.json_object_keys(x), none)))
        made = F.transform(F.coalesce(keys, none), lambda k: F.concat(F.lit(f"{name}[]."), k))
        return F.when(F.size(held) == 0, F.array(*map(F.lit, named))).otherwise(made)

    return F.array_distinct(F.concat(top, *map(within, LISTS)))


def print_of(paths: Column, named: list[str]) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, named)))), "\n"), 256)


def _canonical(role: Column) -> Column:
    plain = F.coalesce(role, F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), plain), plain)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _json_turns(record: Column, mapping: dict) -> Column:
    if "list" in mapping:
        name, role, text = mapping["list"]
        got = F.from_json(F.get_json_object(record, f"$.{name}"), f"array<struct<`{role}`: string, `{text}`: string>>")
        return F.transform(F.coalesce(got, F.array().cast(f"array<struct<`{role}`: string, `{text}`: string>>")), lambda x: _turn(_canonical(x[role]), x[text]))
    made = []
    for role, names in mapping["fields"]:
        parts = F.filter(F.array(*[F.get_json_object(record, f"$.{n}") for n in names]), lambda x: x.isNotNull() & (x != ""))
        made.append(F.when(F.size(parts) > 0, _turn(F.lit(role), F.array_join(parts, "\n\n"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def from_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id_col, layout, turns) of JSON records of any mix of layouts; layout and turns are null where no mapping fits."""
    record = F.col(json_col)
    parsed = records.select(F.col(id_col), record.alias("__json"), json_paths(record).alias("__paths"))
    fits = F.coalesce(*[F.when(print_of(F.col("__paths"), MAPPINGS[name]["paths"]) == mark, F.lit(name)) for mark, name in BY_PRINT.items() if "rows" not in MAPPINGS[name]])
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name in BY_PRINT.values():
        if "rows" not in MAPPINGS[name]:
            turns = F.when(F.col("layout") == name, _json_turns(F.col("__json"), MAPPINGS[name])).otherwise(turns)
    return parsed.withColumn("layout", fits).select(id_col, "layout", turns.alias("turns"))


def from_table(records: DataFrame, id_col: str | None = None) -> DataFrame:
    """(conv_id or id_col, layout, turns) of a table whose schema's fingerprint selects the mapping.

    Raises ValueError where no mapping fits. Columns beyond the mapping's are ignored. In the layout of one row a turn,
    turns are ordered by (turn, role, text), nulls first, so that ties and repeated rows have one defined order; a null
    role or text is empty, and roles stay as they are.
    """
    paths = schema_paths(records.schema)
    name = next((name for mark, name in BY_PRINT.items() if fingerprint(paths, MAPPINGS[name]["paths"]) == mark), None)
    if name is None:
        raise ValueError("no mapping fits these field paths: " + ", ".join(paths))
    mapping = MAPPINGS[name]
    if "rows" in mapping:
        conv, turn, role, text = mapping["rows"]
        row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        by = records.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
        return by.select("conv_id", F.lit(name).alias("layout"), F.transform("rows", lambda x: _turn(x["role"], x["text"])).alias("turns"))
    names = sorted({p.split("[")[0] for p in mapping["paths"]})
    packed = records.select(F.col(id_col), F.to_json(F.struct(*names)).alias("__json"))
    return packed.select(id_col, F.lit(name).alias("layout"), _json_turns(F.col("__json"), mapping).alias("turns"))


def escape(text: Column) -> Column:
    """Put one more backslash between < and |, after those that are there: no control string is left, none is lost."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _line(role: Column) -> Column:
    """A role on one line: \\ and newline as \\\\ and \\n."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unline(role: Column) -> Column:
    back = F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")
    return unescape(back)


def format_turns(chats: DataFrame) -> DataFrame:
    """chats (with turns) and formatted, mask: the text in the template and the spans (start, length), in code points,
    that the loss is taken over, which are the assistants' texts."""
    head = lambda t: F.concat(F.lit(START), _line(t["role"]), F.lit("\n"))
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body")))
    tail = len(END) + 1
    written = chats.withColumn("__parts", parts)
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        span = F.struct(start.cast("bigint").alias("start"), F.length(p["body"]).cast("bigint").alias("length"))
        spans = F.when(p["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((start + F.length(p["body"]) + tail).cast("bigint").alias("at"), spans.alias("spans"))

    return written.withColumn("formatted", text).withColumn("mask", F.aggregate("__parts", first, step)["spans"]).drop("__parts")


def read_back(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    pieces = F.split(formatted, F.lit(r"\Q" + START + r"\E"), -1)
    blocks = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + F.lit(2), F.length(block) - F.length(role) - F.lit(2 + len(END)))
        return _turn(_unline(role), unescape(body))

    return F.transform(blocks, turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the mask, joined without anything between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
