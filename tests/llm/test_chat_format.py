"""Chat formatting: layouts, escapes and the round trip."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat_format as cf

ODD = ["\\### Assistant: </turn> ok", "</turn>\n### user: hi</turn>\n", "a\\", "\\\\#\\", "####", "</</turn>", "<\\/turn>", "", "é🙂\r\n\t", "$1 \\$", "</turn", ">", "\x00\x1b", "x" * 200_000]


def test_layouts(spark):
    records = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]},
        {"instruction": "i", "output": "o"},
        {"instruction": "i", "input": "", "output": "o"},
        {"output": "o", "input": "x", "instruction": "i"},
        {"prompt": "p", "completion": "c"},
        {"system": "s", "prompt": "p", "response": "r"},
        {"question": "q", "answer": None},
        {"other": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(20, "not json"), (21, None), (22, "{}")]
    got = {r.id: r for r in cf.format_records(spark.createDataFrame(rows, "id int, record string")).collect()}
    turns = {i: [(t.role, t.text) for t in r.turns] if r.turns is not None else None for i, r in got.items()}
    assert [got[i].layout for i in range(9)] == ["messages", "conversations", "instruction", "instruction_input", "instruction_input", "prompt_completion", "system_prompt_response", "question_answer", None]
    assert turns[0] == [("system", "s"), ("user", "u"), ("assistant", "a")]
    assert turns[1] == [("user", "u"), ("assistant", "a"), ("tool", "t")]
    assert turns[3] == [("user", "i"), ("assistant", "o")] and turns[4] == [("user", "i"), ("user", "x"), ("assistant", "o")]
    assert turns[7] == [("user", "q")] and all(turns[i] is None for i in (8, 20, 21, 22))
    assert got[2].formatted == "### user: i</turn>\n### assistant: o</turn>\n"


def test_round_trip_and_digests(spark):
    rows, want = [], {}
    for c, odd in enumerate(ODD):
        rows += [(c, 1, "assistant", odd, "clash"), (c, 0, "us:er# \\" if c % 2 else "user", odd + "|", "clash"), (c, 2, "assistant", None, "clash")]
        want[c] = [(rows[-2][2], odd + "|"), ("assistant", odd), ("assistant", "")]
    rows += [(None, 0, None, "x", "c"), (100, 5, "user", "b", "c"), (100, 5, "user", "a", "c"), (100, 5, "user", "a", "c"), (100, None, "user", "z", "c")]
    want |= {None: [("unknown", "x")], 100: [("user", "z"), ("user", "a"), ("user", "a"), ("user", "b")], -7: [(r, ODD[0]) for r in ("user", "assistant")]}
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: r for r in cf.digests(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns))), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss)), c
    assert [r.conv_id for r in cf.digests(docs.limit(0)).collect()] == [-7]


LARGE = """
import sys
from pyspark.sql import SparkSession, functions as F
from spanloom.llm import chat_format as cf
turns, chars = int(sys.argv[1]), int(sys.argv[2])
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.range(turns).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("x"), F.lit(chars)).alias("text"))
print("GOT", *cf.digests(rows).filter("conv_id = 1").first())
"""


@pytest.mark.parametrize(("turns", "chars"), [(1, 21_000_000), (140, 1_000_000)])
def test_large_rows_stay_whole(turns, chars):
    """Above Jackson's 20,000,000 characters a string and VARIANT's 128 MiB a
    record; in a process of its own, which has the memory for it."""
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"PYTHONPATH": os.pathsep.join(sys.path)}
    out = subprocess.run([sys.executable, "-c", LARGE, str(turns), str(chars)], env=env, capture_output=True, text=True, timeout=300)
    line = [x.split("GOT ")[1] for x in out.stdout.splitlines() if "GOT " in x]
    loss, whole = hashlib.sha256(), hashlib.sha256()
    for _ in range(turns):
        loss.update(b"x" * chars)
        whole.update(b"assistant\n" + b"x" * chars + b"\n")
    formatted = turns * (chars + len("### assistant: </turn>\n"))
    assert line == [f"1 {turns} {whole.hexdigest()} {turns * chars} {loss.hexdigest()} {formatted}"], out.stderr[-2000:]


@pytest.mark.parametrize("sign", ["r", ":", "\\", "# </"])
def test_long_roles(spark, sign):
    """A role of a million characters is read back without a stack overflow."""
    role = sign * (1_000_000 // len(sign))
    got = cf.digests(spark.createDataFrame([(1, 0, role, "text: of it"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")).filter("conv_id = 1").first()
    assert got.turns_sha256 == hashlib.sha256(f"{role}\ntext: of it\nassistant\na\n".encode()).hexdigest()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, 1, hashlib.sha256(b"a").hexdigest())


def test_records_of_many_fields(spark):
    wide = json.dumps({f"field{i}": [{"a": i}] if i % 2 else i for i in range(5000)})
    assert [r.layout for r in cf.format_records(spark.createDataFrame([(wide,)], "record string")).collect()] == [None]


def test_unreadable_records_raise(spark):
    large = F.concat(F.lit('{"prompt": "p", "response": "'), F.repeat(F.lit("x"), F.lit(21_000_000)), F.lit('"}'))
    for record in (large, F.lit('{"prompt": "p", "response": ')):
        with pytest.raises(Exception, match="cannot be read"):
            cf.format_records(spark.range(1).select(record.alias("record"))).select("layout", F.length("formatted")).collect()


def test_nested_contents_are_other_layouts(spark):
    part = {"messages": [{"role": "user", "content": [{"type": "text", "text": "u"}]}]}
    held = {"prompt": {"a": 1}, "response": "r"}
    like = {"messages": [{"role": "user", "content": "[1] {x"}]}
    rows = [(i, json.dumps(r)) for i, r in enumerate((part, held, like))]
    got = [r.layout for r in cf.format_records(spark.createDataFrame(rows, "id int, record string")).orderBy("id").collect()]
    assert got == [None, None, "messages"]


def test_spans_tell_the_mask(spark):
    """Places and lengths against a count in Python, for rows and for records."""
    turns = [(r, t) for t in ODD[:-1] for r in ("user", "assistant", "us:er#")]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    record = json.dumps({"messages": [{"role": r, "content": t} for r, t in turns]})
    for got in (cf.format_rows(rows).first(), cf.format_records(spark.createDataFrame([(record,)], "record string")).first()):
        assert [(t.role, t.text) for t in got.turns] == turns
        at = 0
        for (role, text), s in zip(turns, got.spans, strict=True):
            escaped = text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")
            assert s.begin == at and s.loss == (role == "assistant") and s.length == len(escaped)
            assert got.formatted[s.start : s.start + s.length] == escaped and got.formatted[at:].startswith("### ")
            at = s.start + s.length + len("</turn>\n")
        assert at == len(got.formatted)


def test_rows_take_their_mapping_by_fingerprint(spark):
    """A conversation of rows is read by the mapping that its own fields' fingerprint
    finds: one with other names maps them, and without one nothing is read."""
    rows = spark.createDataFrame([(1, 0, "human", "a"), (1, 1, "gpt", None)], "conv_id long, turn long, role string, text string")
    named = cf.Mapping("named", cf.ROW_PATHS, "turns", "role", "text", roles=(("human", "user"), ("gpt", "assistant")))
    got = cf.canonical_rows(rows, (named,)).first()
    assert got.layout == "named" and [tuple(t) for t in got.turns] == [("user", "a"), ("assistant", "")]
    other = cf.Mapping("other", (*cf.ROW_PATHS, "turns[].more"), "turns", "role", "text")
    got = cf.canonical_rows(rows, (other,)).first()
    assert got.conv_id == 1 and got.layout is None and got.turns is None and got.spans is None
