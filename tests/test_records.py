"""Records of large files against reading each file whole."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listingflow.functions.json_repair import split_records
from listingflow.sources import readers
from listingflow.sources import records as scans
from listingflow.sources.records import Scanner, read_pieces


def records(n, seed=0):
    rng = random.Random(seed)
    odd = ['}{"', "a\\", '\\"', "{[", "]\n[", "line\nfeed", "é日本 😀", "", "\\u0041", "},{", '"'] 
    return [{"id": i, "t": rng.choice(odd) * rng.randint(0, 3) + str(i), "n": {"x": [rng.choice(odd), {"y": None}]}, "e": [{}, []]} for i in range(n)]


LAYOUTS = {
    "minified": lambda r: json.dumps(r, ensure_ascii=False, separators=(",", ":")),
    "pretty": lambda r: json.dumps(r, indent=2),
    "one_a_line": lambda r: "[\n" + ",\n".join(map(json.dumps, r)) + "\n]\n",
    "flush_left": lambda r: json.dumps(r, indent=0),
    "objects": lambda r: "".join(json.dumps(x, indent=2) + "\n" for x in r),
    "side_by_side": lambda r: "".join(map(json.dumps, r)),
    "mixed": lambda r: json.dumps(r[:7]) + "\n" + "".join(json.dumps(x, ensure_ascii=False) + "\r\n" for x in r[7:]) + json.dumps(r[:3], indent=1),
    "blank_ends": lambda r: "﻿ \n" + json.dumps(r) + " \n ",
}


@pytest.fixture
def many_ranges(spark):
    """Byte ranges of 1500 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_files_of_every_layout_equal_whole_reading(spark, tmp_path, many_ranges):
    made = records(150)
    for name, layout in LAYOUTS.items():
        (tmp_path / f"{name}.json").write_text(layout(made), newline="")
    long = [{"id": 0, "t": "x{[" * 3000, "n": [{"a": "}" * 2000}] * 3}, {"id": 1}]  # records over many ranges
    (tmp_path / "long.json").write_text(json.dumps(long))
    (tmp_path / "none.json").write_text("")
    found, files = read_pieces(spark, str(tmp_path))
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["_file"].rsplit("/", 1)[1], []).append((r["_place"], json.loads(r["text"]), r["damaged"]))
    for name in [*LAYOUTS, "long"]:
        want = [json.loads(x) for x in split_records((tmp_path / f"{name}.json").read_text())]
        assert sorted(got[f"{name}.json"], key=lambda x: x[0]) == [(i, v, False) for i, v in enumerate(want)], name
    about = {r["_file"].rsplit("/", 1)[1]: (r["head"], r["open"], r["n_damaged"]) for r in files.collect()}
    assert about.pop("objects.json") == about.pop("side_by_side.json") == ("{", False, 0) and "none.json" not in about
    assert set(about.values()) == {("[", False, 0)}
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 64


def test_damaged_records_are_reported_and_cost_no_other(spark, tmp_path, many_ranges):
    good = [json.dumps(r, indent=1) for r in records(40, 3)]
    bad = ['{"a": "no end of the string\n', '{"a": {"b": 1}\n', '{"a": 1 "b": 2}\n', '{a: 1}\n', '{"a": [1, 2\n', '{"a": "x}" }}}\n', '{"a": tru}\n']
    text = "".join(g + "\n" + bad[i % len(bad)] for i, g in enumerate(good))
    (tmp_path / "a.json").write_text(text + '{"cut": {"off": 1}')
    found, files = read_pieces(spark, str(tmp_path))
    rows = found.collect()
    kept = [json.loads(r["text"]) for r in sorted((r for r in rows if not r["damaged"]), key=lambda r: r["_place"])]
    extra = {"a": "x}"}  # too many ends harm nothing
    assert [k for k in kept if k != extra] == [json.loads(g) for g in good] and kept.count(extra) == sum(i % 7 == 5 for i in range(40))
    damaged = [r["text"] for r in rows if r["damaged"]]
    assert len(damaged) == sum(i % 7 != 5 for i in range(40)) + 1 and '{"cut": {"off": 1}' in damaged and all(r["_place"] is None for r in rows if r["damaged"])
    assert files.first()["n_damaged"] == len(damaged)
    for size in ("300", "100000"):  # the same whatever the ranges
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert sorted(map(tuple, read_pieces(spark, str(tmp_path))[0].collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_states_joined_by_a_shuffle(spark, tmp_path, many_ranges, monkeypatch):
    monkeypatch.setattr("listingflow.sources.records.BROADCAST_RANGES", 0)
    made = records(120, 5)
    (tmp_path / "a.json").write_text(json.dumps(made))
    (tmp_path / "b.json").write_text("".join(json.dumps(x, indent=2) for x in made))
    got = read_pieces(spark, str(tmp_path))[0].where("not damaged")
    for name in "ab":
        rows = got.where(F.col("_file").endswith(f"{name}.json")).orderBy("_place").collect()
        assert [json.loads(r["text"]) for r in rows] == made and [r["_place"] for r in rows] == list(range(120))


def test_effects_of_pieces_compose():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(['{', '}', '[', ']', '"', '\\', '\n', ',', 'a', ' ', ':', '\n{', '\n[']) for _ in range(60))
        pieces = [p + "}" for p in text.split("}")]
        whole = Scanner(known=True)
        for p in pieces:
            list(whole.feed(p))
        at = rng.randint(0, len(pieces))
        before = Scanner(known=True)
        for p in pieces[:at]:
            list(before.feed(p))
        after = Scanner(in_string=before.in_string)
        for p in pieces[at:]:
            list(after.feed(p))
        left = "" if after.known else before.stack[: max(0, len(before.stack) - after.pops)]
        assert (left + after.stack, after.in_string) == (whole.stack, whole.in_string), repr(text)


def test_array_files_are_whole_or_bad(spark, tmp_path, many_ranges):
    files = {"good": '[{"id": "1"}, 5, {"id": "2"}]', "object": '{"id": "3"}', "blank": " \n", "open": '[{"id": "4"}', "damaged": '[{"id": "5"}, {"id" "6"}]', "numbers": "[1, 2]", "text": "none"}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, bad = readers.read_arrays(spark, f"{tmp_path}/*.json")
    assert [(r["_file"], r["id"], r["_place"]) for r in rows.orderBy("_place").collect()] == [("good.json", "1", 0), ("good.json", "2", 1)]
    assert {r["_file"][:-5]: r["reason"] for r in bad.collect()} == {"object": "not an array", "blank": "empty", "open": "not an array", "damaged": "not an array", "numbers": "no records", "text": "not an array"}
    assert {r["id"] for r in readers.read_records(spark, str(tmp_path)).select("url", "_extra.id").collect()} == {"1", "2", "3", "4", "5"}
    assert [tuple(r) for r in readers.damaged_records(spark, str(tmp_path)).collect()] == [("damaged.json", '{"id" "6"}')]


def test_effect_of_a_range_is_a_small_row():
    text = '{"a": [' * 50_000 + "}" * 10
    batch = pa.RecordBatch.from_pydict({"_file": ["f"] * 11, "_start": [9] * 11, "_size": [10**6] * 11, "value": text.split("}")})
    (row,) = scans._summarise(iter([batch]))
    assert row.nbytes < 500 and row["n_bytes"][0].as_py() == len(text) + 1
    assert (row["depth0"][0].as_py(), row["outer0"][0].as_py(), row["pops0"][0].as_py()) == (100_000 - 11, "{[", 0)  # a brace ends the last piece too


def test_events_are_the_same_in_any_chunks(monkeypatch):
    rng = random.Random(4)
    atoms = ["{", "}", "[", "]", '"', "\\", "\n", "\n{", ",\n[", '{"a": 1}', '{"k": {"z": [{"x": [[]]}]}}', '"}{"', '[{"b": "\\""}]', "\r\n"]
    for _ in range(200):
        pieces = "".join(rng.choice(atoms) for _ in range(50)).split("}")
        batch = pa.RecordBatch.from_pydict({"_file": ["f"] * len(pieces), "_start": [0] * len(pieces), "value": pieces})
        found = []
        for size in (1, 40, 1 << 20):  # one piece at a time is bracket by bracket
            monkeypatch.setattr(scans, "CHUNK", size)
            scan, base, events = Scanner(), 0, []
            for *_, part, n_bytes in scans._by_range(iter([batch]), ["_file", "_start"]):
                events += [(what, base + at) for what, at in scan.feed(part + "}")]
                base += n_bytes
            found.append((events, scan.in_string, scan.stack, scan.known, scan.pops))
        assert found[0] == found[1] == found[2]
