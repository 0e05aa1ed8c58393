"""JSON arrays in byte ranges: every cut gives the elements that a whole parse gives."""

import json
import random

import pytest

from leadweave.sources import arrays

SCHEMA = "n long, s string, sub struct<a: array<string>>"


def hard(r, n):
    bits = ['"', "\\", "[", "]", "{", "}", ",", "é", "😀", "\n", " ", '\\"', "x"]
    text = lambda k: "".join(r.choice(bits) for _ in range(r.randint(0, k)))
    return [{"n": i, "s": text(9), "sub": {"a": [text(5) for _ in range(r.randint(0, 3))]}} for i in range(n)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d, r = tmp_path_factory.mktemp("arrays"), random.Random(2)
    for i, (indent, ascii_) in enumerate(((2, False), (None, True), (None, False))):
        (d / f"{i}.json").write_text(json.dumps(hard(r, 60), indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    (d / "long.json").write_text(json.dumps([{"n": 7, "s": '\\"' * 3000 + "],[", "sub": None}, {"n": 8, "s": None, "sub": {"a": []}}]))
    (d / "empty.json").write_text(" [ ] ")
    (d / "none.json").write_text("")
    return d


@pytest.mark.parametrize("split,read", [(1 << 20, 1 << 20), (97, 64), (13, 7), (701, 1 << 20)])
def test_cuts(spark, folder, split, read, monkeypatch):
    monkeypatch.setattr(arrays, "READ_BYTES", read)  # of this process: the tasks keep theirs
    files = sorted(str(x) for x in folder.glob("*.json"))
    import pandas as pd

    want = [x for f in files if f[-9:] != "none.json" for x in json.loads(open(f, encoding="utf-8").read())]
    plain = []  # without Spark, so that the reads are small, too
    for f in files:
        size = len(open(f, "rb").read())
        ranges = pd.DataFrame([(f"file:{f}", a, min(a + split, size)) for a in range(0, size, split)], columns=["path", "start", "stop"])
        if len(ranges):
            s = next(arrays._survey(iter([ranges])))
            quotes = s["quotes"].cumsum().shift(fill_value=0) % 2
            step = s["out"].where(quotes == 0, s["inside"])
            s = s.assign(quotes=quotes, depth=step.cumsum().shift(fill_value=0))
            plain += [(x.source_file, x.at, x.raw) for d in arrays._elements(iter([s])) for x in d.itertuples()]
    key = lambda x: (x["n"], json.dumps(x))
    assert sorted((json.loads(x[2]) for x in plain), key=key) == sorted(want, key=key)
    if split > 13:
        good, bad = arrays.json_array_records(spark, str(folder / "*.json"), SCHEMA, split)
        rows = [{"n": x.n, "s": x.s, "sub": x.sub and x.sub.asDict()} for x in good.collect()]
        assert sorted(rows, key=key) == sorted(want, key=key) and bad.count() == 0


def test_rejects(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1}, 5, {"n": "x"}, {"n": 2, "other": [1]}, {"n" 3}, null, {"n": 4},, {"n": 9')
    (tmp_path / "b.json").write_text('{"n": 6}')
    (tmp_path / "c.json").write_text("﻿\n[{\"n\": 7}]", encoding="utf-8")
    good, bad = arrays.json_array_records(spark, str(tmp_path / "*.json"), SCHEMA, 11)
    assert sorted(x.n for x in good.collect()) == [1, 2, 4, 7]
    assert sorted(x.raw for x in bad.collect()) == sorted(["5", '{"n": "x"}', '{"n" 3}', "null", "", '{"n": 9', '{"n": 6}'])


def test_written_arrays(spark, tmp_path):
    d = spark.range(0, 5000, 1, 3).selectExpr("id AS n", "repeat('\"[', int(id % 4)) AS s", "named_struct('a', array(string(id), NULL)) AS sub")
    arrays.write_arrays(d, str(tmp_path / "out"))
    good, bad = arrays.json_array_records(spark, str(tmp_path / "out"), SCHEMA, 5000)
    assert bad.count() == 0 and sorted(good.drop("source_file", "at").collect()) == sorted(d.collect())
    assert len(json.loads(next((tmp_path / "out").glob("part-*")).read_text())) > 1000
    parts = good.select("at").rdd.getNumPartitions()
    assert parts > 1
    arrays.write_arrays(d.limit(0), str(tmp_path / "nothing"))
    assert arrays.json_array_records(spark, str(tmp_path / "nothing"), SCHEMA)[0].count() == 0
