"""JSONL files read by split hold the same records as a plain walk over their lines."""

import json
import random

import pytest

from postmill.sources import records


def walk(text):
    """Records of a file, line by line: a cut record waits for at most five more lines."""
    out, held = [], []

    def parsed(s):
        try:
            return json.loads(s)
        except ValueError:
            return None

    for line in text.removeprefix("﻿").split("\n"):
        line = line.removesuffix("\r")
        if line.strip(" ") == "":
            continue
        alone, joined = parsed(line), parsed("\\n".join([*held, line]))
        if joined is not None or alone is not None:
            out.append(joined if joined is not None else alone)
            held = []
        elif (held or line.startswith("{")) and len(held) < 6 - 1:
            held.append(line)
        else:
            held = []
    return [r for r in out if isinstance(r, dict)]


def lines(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        row = json.dumps({"id": i, "title": "x" * r.randrange(30)})
        kind = r.random()
        if kind < 0.5:
            out.append(row)
        elif kind < 0.75:  # cut inside a string, into two to eight lines
            pieces = [f"part {j}" for j in range(r.randrange(2, 9))]
            out += (f'{{"id": {i}, "title": "' + "\n".join(pieces) + '"}').split("\n")
        else:
            out.append(r.choice(["", "   ", "junk", "{", '{"id": 1, "title": "open', '"}', "[broken", '{"a": {', "\r"]))
    return "\n".join(out) + r.choice(["", "\n"])


@pytest.mark.parametrize("size", [160, 1 << 20])
def test_splits_hold_what_a_walk_finds(spark, tmp_path, size):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    texts = {f"f{i}.jsonl": lines(i, 50) for i in range(5)} | {"bom.jsonl": "﻿" + lines(7, 5), "empty.jsonl": "", "crlf.jsonl": '{"id": 1}\r\n{"id": 2, "title": "a\r\nb"}\r\n'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        raw = records.read_raw(spark, [str(tmp_path / n) for n in texts])
        got = raw.selectExpr("raw_file", "position", "to_json(record) as r").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        mine = [json.loads(r.r) for r in sorted((r for r in got if r.raw_file.endswith("/" + name)), key=lambda r: r.position)]
        assert mine == walk(text), name
    assert sum(len(walk(t)) for t in texts.values()) > 100


def test_a_long_run_of_broken_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("{\n" * 500 + '{"id": 1}\n' + '{"id": "\n' * 7 + '"}\n')
    text = (tmp_path / "b.jsonl").read_text()
    got = [json.loads(r.r) for r in records.read_raw(spark, [str(tmp_path / "b.jsonl")]).selectExpr("to_json(record) as r").collect()]
    assert got == walk(text)
