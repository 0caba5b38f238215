"""The keyed state of streamed logs, without a stream."""

import json
import random

import pandas as pd
import pytest

from spanloom.streaming import incremental


class _Store:
    """A MapState that counts what is written to it."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key], self.writes = value, self.writes + 1

    def removeKey(self, key):
        self.held.pop(key, None)


class _Handle(dict):
    def getMapState(self, name, *schema):  # noqa: N802
        return self.setdefault(name, _Store())


def _shuffled_logs(logs, spawns):
    lines = []
    for i in range(logs):
        for n in range(spawns):
            lines.append((f"f{i}#1", 2 * n, json.dumps({"id": 1, "kind": "file", "path": f"p{i}-{n}", "files": [{"path": f"p{i}-{n}"}]}), None))
            lines.append((f"f{i}#1", 2 * n + 1, json.dumps({"id": 0, "kind": "spawn", "outs": [{"outputId": 1}]}), f"raw{n}"))
    random.Random(1).shuffle(lines)
    return lines


@pytest.mark.parametrize("in_memory", [10_000, 20])
def test_lines_of_one_batch_wait_in_memory(monkeypatch, in_memory):
    """Far more lines of a group than are taken at once, in no order."""
    monkeypatch.setattr(incremental, "_AT_ONCE", 50)
    monkeypatch.setattr(incremental, "_IN_MEMORY", in_memory)
    handle, reader, lines = _Handle(), incremental.LogReader(0), _shuffled_logs(20, 30)
    reader.init(handle)
    frame = pd.DataFrame(lines, columns=["inv", "seq", "doc", "raw"])
    frames = (frame[i : i + 10].reset_index(drop=True) for i in range(0, len(frame), 10))
    got = pd.concat(reader.handleInputRows((1,), frames, None))
    want = {(f"f{i}#1", 2 * n + 1): (f"raw{n}", [f"p{i}-{n}"]) for i in range(20) for n in range(30)}
    assert {(r.inv, r.seq): (r.raw, json.loads(r.doc)["listed"]) for r in got.itertuples()} == want and len(got) == len(want)
    assert (handle["waiting"].writes == 0) == (in_memory > len(lines))
    assert not handle["waiting"].held and handle["pages"].writes <= incremental._PAGES


def test_lines_of_another_batch_wait_in_the_store():
    handle, reader, lines = _Handle(), incremental.LogReader(0), _shuffled_logs(3, 4)
    reader.init(handle)
    frame = pd.DataFrame(lines, columns=["inv", "seq", "doc", "raw"])
    late = frame["seq"] == 0
    first = pd.concat(reader.handleInputRows((1,), iter([frame[~late]]), None))
    assert first.empty and len(handle["waiting"].held) == len(frame[~late])
    rest = pd.concat(reader.handleInputRows((1,), iter([frame[late]]), None))
    assert len(rest) == 12 and not handle["waiting"].held
