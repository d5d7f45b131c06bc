"""JSON files cut by byte range, against the json module."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evenhand.sources import readers as R
from evenhand.sources import sinks as S
from evenhand.sources.split_json import json_entries

NASTY = ['"', "\\", '\\"', "[", "]", "{", "}", ",", ":", "é", "😀", "\n", "\\\\", '",', '"]', ""]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, False, rng.randrange(-99, 99), 1.5])
    if kind < 4:
        return "".join(rng.choice(NASTY) for _ in range(rng.randrange(6)))
    if kind < 6:
        return {rng.choice(NASTY) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


@pytest.mark.parametrize("range_bytes", [1, 3, 17, 1 << 20])
def test_ranges_that_cut_strings_and_escapes(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    array = [value(rng) for _ in range(25)] + ["\\" * 70 + '"']
    keyed = {f'k{i}"\\{rng.choice(NASTY)}': value(rng) for i in range(25)}
    (tmp_path / "a.json").write_text(json.dumps(array, ensure_ascii=False, indent=rng.choice([None, 1])), encoding="utf-8")
    (tmp_path / "k.json").write_text(json.dumps(keyed, ensure_ascii=False, indent=2), encoding="utf-8")
    for name in ("empty", "list", "map", "blank"):
        (tmp_path / f"{name}.json").write_text({"empty": "", "list": "[ ]", "map": "{}", "blank": " \n"}[name])
    rows = json_entries(spark, str(tmp_path), range_bytes).orderBy("file", "at").collect()
    assert all(r["problem"] is None for r in rows), [r for r in rows if r["problem"]]
    a = [json.loads(r["value"]) for r in rows if r["file"].endswith("a.json")]
    k = [(r["key"], json.loads(r["value"])) for r in rows if r["file"].endswith("k.json")]
    assert a == array and k == list(keyed.items()) and len(rows) == len(a) + len(k)


@pytest.mark.parametrize("range_bytes", [2, 1000])
def test_problems_are_kept(spark, tmp_path, range_bytes):
    (tmp_path / "1.json").write_text('[1,,{"a" 2},tru,[3]]')
    (tmp_path / "2.json").write_text('{"a": 1, "b": {"c": [1, 2')
    (tmp_path / "3.json").write_text('note [1] [2] rest')
    (tmp_path / "4.json").write_bytes(b'["\xff", 5, ]')
    (tmp_path / "5.json").write_text('{"a": 1, "a": 2}')
    rows = json_entries(spark, str(tmp_path), range_bytes).orderBy("file", "at").collect()
    got = [[(r["key"], r["value"].strip(), r["problem"]) for r in rows if r["file"].endswith(f"{i}.json")] for i in range(1, 6)]
    assert got[0] == [(None, "1", None), (None, "", "blank"), (None, '{"a" 2}', "text"), (None, "tru", "text"), (None, "[3]", None)]
    assert got[1] == [("a", "1", None), (None, '"b": {"c": [1, 2', "truncated")]
    assert "".join(v for _, v, p in got[2] if p == "outside").replace(" ", "") == "noterest" and [v for _, v, p in got[2] if p is None] == ["1", "2"]
    assert got[3][1:] == [(None, "5", None), (None, "", "blank")] and got[3][0][2] == "text"
    assert got[4] == [("a", "1", None), ("a", "2", None)]


def test_arrays_keep_what_does_not_fit_the_schema(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"x": 1.5, "g": "a"}, {"x": "no", "g": "b"}, {"x" 2}, {"g": "c"}]')
    rows = R.read_json_array(spark, str(tmp_path), "x double, g string", 5).collect()
    got = sorted((r["x"] or 0, r["g"] or "", r[R.BAD] or "") for r in rows)
    assert got == [(0, "", '{"x" 2}'), (0, "b", '{"x": "no", "g": "b"}'), (0, "c", ""), (1.5, "a", "")]
    assert R.read_json_records(spark, str(tmp_path), "x double, g string").count() == 2


def test_framed_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([(f'k"{i}\\', i, None if i % 3 else "x,]}\n") for i in range(50)], "k string, n int, t string").repartition(3)
    S.write_keyed_json(df, "k", str(tmp_path / "k"))
    S.write_json_array(df, str(tmp_path / "a"))
    S.write_json_array(df.limit(0), str(tmp_path / "none"))
    keyed = R.read_keyed_json(spark, str(tmp_path / "k"), "struct<n:int,t:string>", "k", 40).select("k", "record.*")
    array = R.read_json_records(spark, str(tmp_path / "a"), "k string, n int, t string")
    for back in (keyed, array):
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert json_entries(spark, str(tmp_path / "none")).count() == 0
    for p in (tmp_path / "k").glob("part-*"):
        json.loads(p.read_text())


def test_ranges_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(list(range(5000))))
    entries = json_entries(spark, str(tmp_path), 256)
    assert entries.agg(F.sum(F.col("value").cast("int"))).first()[0] == sum(range(5000))
    assert entries.rdd.getNumPartitions() > 1


def test_marks_of_any_run_of_backslashes(monkeypatch):
    """Quotes after odd runs are skipped, also where a run began before the bytes; no list as long as the bytes is made."""
    import itertools

    from evenhand.sources import split_json as J

    longest = []
    keep = J.np.flatnonzero
    monkeypatch.setattr(J.np, "flatnonzero", lambda x: longest.append(len(keep(x))) or keep(x))
    J.marks(b'a' * 5000 + b'\\"', False)
    assert max(longest) < 10
    for text in itertools.product(b'a"\\', repeat=6):
        for escaped in (False, True):
            want, odd = [], escaped
            for i, c in enumerate(text):
                if c == 0x22 and not odd:
                    want.append(i)
                odd = c == 0x5C and not odd
            assert J.marks(bytes(text), escaped)[0].tolist() == want
