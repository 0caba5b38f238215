r"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come as JSON or VARIANT of many layouts. A record's fingerprint is the
hash of its sorted nested field paths; a table of declarative mappings, keyed by
fingerprint, says where the turns are: in a list of messages (with the paths of
role and text and names for roles) or in fixed fields, one turn each. Rows of
(conversation, turn, role, text) are gathered, and the fingerprint is that of the
gathered turns' fields, values emptied; the mapping that it finds reads the turns as they are: JSON and VARIANT, whose
limits (128 MiB a record, 20,000,000 characters a string) no conversation must
meet, are not on that way. Records of unknown layout come out with a null mapping;
one that starts as an object and cannot be read, be it broken or above those
limits, raises an error.

Template of a turn:  ### <role>: <text></turn>  and a line feed. Control strings
inside roles and texts are escaped reversibly: a backslash doubles, `#` becomes
`\#` and `</` becomes `<\/`; roles also escape `:`. So neither mark can occur
inside a turn, and dropping one backslash of each pair restores the original.
The loss mask covers the assistant's texts. `spans` says where it is: for each turn
the places (in characters of the formatted string) where the turn begins and where
its text starts, the text's length there, and whether the mask covers it.

A conversation is one formatted string, so its rows meet in one group; that is
the operator's result itself, not a choice of plan. Everything before it, and
the reading back, is row by row.

Defined results: a null text is empty, a null role is "unknown"; turns with equal
numbers are ordered by role, then text; repeated rows are repeated turns; a null
conv_id is a conversation of its own; a null turn number comes first; a very long
text or conversation of rows stays whole as long as its one string fits the task
(Spark's limit is 2 GB); an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SHUT = "### ", "</turn>\n"
_TURNS = "array<struct<role string, text string>>"
#: The schema of a record as deep as field paths go; anything deeper is another layout.
#: Possessive, so that matching takes no stack however many fields there are.
_FLAT = "^OBJECT<(?:[^<>]++|(?<=ARRAY|OBJECT)<[^<>]*+>|(?<=ARRAY)<OBJECT<[^<>]*+>>)*+>$"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: `paths` are all its field paths. Either a
    list at `turns` with `role` and `text` inside, or `fields` of (role, field)."""

    name: str
    paths: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprint(self) -> Column:
        return F.sha2(F.lit("\n".join(sorted(self.paths))), 256)

    def named(self, listed: Column) -> Column:
        """Role and text of listed turns (structs with this layout's fields)."""
        named = F.create_map(*[F.lit(x) for pair in self.roles for x in pair]) if self.roles else None
        role = lambda t: F.coalesce(named[t[self.role]], t[self.role]) if named is not None else t[self.role]
        return F.transform(listed, lambda t: F.struct(role(t).alias("role"), t[self.text].alias("text")))

    def read(self, record: Column) -> Column:
        """The canonical turns of a VARIANT record of this layout."""
        if self.turns is None:
            got = [F.struct(F.lit(r).alias("role"), F.try_variant_get(record, f"$.{f}", "string").alias("text")) for r, f in self.fields]
            return F.filter(F.array(*got), lambda t: t["text"].isNotNull() & ((t["role"] == "assistant") | (t["text"] != "")))
        return self.named(F.try_variant_get(record, f"$.{self.turns}", f"array<struct<`{self.role}`: string, `{self.text}`: string>>"))


#: The field paths of turns gathered from rows.
ROW_PATHS = ("turns", "turns[]", "turns[].turn", "turns[].role", "turns[].text")

MAPPINGS = (
    Mapping("messages", ("messages", "messages[]", "messages[].role", "messages[].content"), "messages"),
    Mapping("conversations", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("rows", ROW_PATHS, "turns", "role", "text"),
    Mapping("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system_prompt_response", ("system", "prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
)


def field_paths(json: Column) -> Column:
    """Sorted distinct field paths of a JSON object, two levels of nesting deep
    (an object in an object, or the objects in a list); mappings are for records
    without anything deeper."""

    def keys(value: Column) -> Column:
        return F.coalesce(F.json_object_keys(value), F.array())

    def inner(name: Column) -> Column:
        value = F.try_element_at(F.from_json(json, "map<string,string>"), name)
        listed = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>"))
        below = F.when(listed.isNotNull(), F.concat(F.array(F.concat(name, F.lit("[]"))), F.transform(F.flatten(F.transform(listed, keys)), lambda k: F.concat(name, F.lit("[]."), k))))
        held = F.transform(F.when(F.ltrim(value).startswith("{"), keys(value)), lambda k: F.concat(name, F.lit("."), k))
        return F.concat(F.array(name), F.coalesce(below, held, F.array()))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(keys(json), inner))))


def fingerprint(json: Column) -> Column:
    return F.sha2(F.array_join(field_paths(json), "\n"), 256)


def _clean(turns: str) -> Column:
    return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("unknown")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def canonical(records: DataFrame, json: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with layout (the mapping's name or null) and turns."""
    parsed, lost = F.try_parse_json(F.col(json)), F.lit("a JSON record cannot be read: it is broken or above the limits of 128 MiB a record and 20,000,000 characters a string")
    unread = F.ltrim(F.col(json)).startswith("{") & (parsed.isNull() | F.from_json(F.col(json), "map<string,string>").isNull())
    known = records.withColumn("_print", F.when(unread, F.raise_error(lost).cast("string")).when(F.regexp_like(F.schema_of_variant(parsed), F.lit(_FLAT)), fingerprint(F.col(json)))).withColumn("_record", parsed)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for m in mappings:
        hit = F.col("_print") == m.fingerprint()
        layout, turns = F.when(hit, F.lit(m.name)).otherwise(layout), F.when(hit, m.read(F.col("_record")).cast(_TURNS)).otherwise(turns)
    return known.withColumn("layout", layout).withColumn("turns", turns).withColumn("turns", _clean("turns")).drop("_print", "_record")


def canonical_rows(rows: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, layout, turns and spans of rows of turns, gathered in order and
    never turned into one text. Each conversation's fingerprint is taken from its
    turns' fields and looked up in the mappings, as a record's is; one of unknown
    layout has neither layout, turns nor spans."""
    # a turn's layout is its JSON with all values emptied, so no limit on records is met; a conversation has few
    layout = F.to_json(F.struct(*[F.lit("").alias(n) for n in ("turn", "role", "text") if n in rows.columns]))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = rows.select("conv_id", turn.alias("t"), layout.alias("keys")).select("conv_id", "t.*", "keys")
    # places are running sums, so that no conversation is too long for them; the grouping takes the same exchange
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(_piece(F.col("role"), F.col("text"))).cast("long")
    begin = F.coalesce(F.sum("size").over(before), F.lit(0).cast("long"))
    placed = each.withColumn("size", size).withColumn("begin", begin)
    kept = F.struct("turn", "role", "text", "begin")
    record = F.concat(F.lit('{"turns":['), F.array_join(F.array_sort(F.collect_set("keys")), ","), F.lit("]}"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("turns"), fingerprint(record).alias("_print"))
    spans = F.transform("turns", lambda t: _span(t["begin"], t["role"], t["text"]))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for m in mappings:
        if m.turns == "turns" and {m.role, m.text} <= {"role", "text"}:  # others name fields that gathered turns do not have
            hit = F.col("_print") == m.fingerprint()
            name, turns = F.when(hit, F.lit(m.name)).otherwise(name), F.when(hit, m.named(F.col("turns")).cast(_TURNS)).otherwise(turns)
    return grouped.select("conv_id", name.alias("layout"), turns.alias("turns"), F.when(name.isNotNull(), spans).alias("spans"))


def _escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("#", "\\#"), ("</", "<\\/")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(_escape(role), F.lit(":"), F.lit("\\:")), F.lit(": "))


def _piece(role: Column, text: Column) -> Column:
    return F.concat(_head(role), _escape(text), F.lit(SHUT))


def _span(begin: Column, role: Column, text: Column) -> Column:
    return F.struct(begin.alias("begin"), (begin + F.length(_head(role))).alias("start"), F.length(_escape(text)).cast("long").alias("length"), (role == "assistant").alias("loss"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: _piece(t["role"], t["text"])), "")


def spans_of(turns: Column) -> Column:
    """The spans of the turns of one record."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,start:bigint,length:bigint,loss:boolean>>").alias("out"))
    step = lambda a, t: F.struct((a["at"] + F.length(_piece(t["role"], t["text"]))).alias("at"), F.concat(a["out"], F.array(_span(a["at"], t["role"], t["text"]))).alias("out"))
    return F.aggregate(turns, start, step, lambda a: a["out"])


def parse(formatted: Column) -> Column:
    """The turns of a formatted string. No escaped text holds </turn>, and no
    escaped role a bare colon, so both cuts are sure. The role's pattern is
    possessive: a role of any length is read without recursion."""
    parts = F.filter(F.split(formatted, SHUT, -1), lambda p: p != "")
    head = r"(?s)^### ((?:[^:\\]++|\\.)*+): (.*)$"
    return F.transform(parts, lambda p: F.struct(_unescape(F.regexp_extract(p, head, 1)).alias("role"), _unescape(F.regexp_extract(p, head, 2)).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, cut out of the formatted string by the spans
    and unescaped; cut turn by turn, so that the time is linear."""
    cut = lambda p, s: F.when(s["loss"], _unescape(F.substr(p, (s["start"] - s["begin"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_compact(F.zip_with(F.filter(F.split(formatted, SHUT, -1), lambda p: p != ""), spans, cut))


def format_records(records: DataFrame, json: str = "record") -> DataFrame:
    """records with layout, turns, formatted and spans."""
    return canonical(records, json).withColumns({"formatted": render(F.col("turns")), "spans": spans_of(F.col("turns"))})


def format_rows(rows: DataFrame) -> DataFrame:
    """conv_id, layout, turns, formatted and spans of rows of turns."""
    return canonical_rows(rows).withColumn("formatted", render(F.col("turns")))


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns for conversations, read back from the output."""
    spark = rows.sparkSession
    probe = "### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\" + probe).alias("text"))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(extra)
    back = format_rows(every).select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:') || ': '
  || replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') || '</turn>' || chr(10) AS f FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(f))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
