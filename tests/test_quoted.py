"""Quoted line breaks: many ranges of a file against Spark's reader of whole files."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from tidesift.sources.delimited import read_table
from tidesift.sources.quoted import QuotedFiles, can_split, ends_inside

NAMES = ["a", "b", "c"]


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def field(rng, long=False):
    words = ["x", "é", "12", 'a "b" c', "line\nbreak", "win\r\nbreak", "a,b", '"', "", "\n\n", "tail\n", "日本"]
    text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
    return text + ("\nlong , \"part\" " * 30 if long else "")


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def write(path, rows, end="\n", head=True, encoding="utf-8", last=True):
    lines = [",".join(NAMES)] * head + [",".join(r) for r in rows]
    data = (end.join(lines) + end * last).encode(encoding)
    path.write_bytes(data)


def rows_of(rng, n, mixed=True):
    out = []
    for i in range(n):
        plain = rng.random() < 0.4
        out.append([str(i), "plain" if plain else quoted(field(rng, rng.random() < 0.1)), quoted(field(rng)) if rng.random() < 0.5 else "p"])
    return out if mixed else [[v.replace("\r", "") for v in row] for row in out]


def whole(spark, path, head=True):
    """Spark's own reader, one task a file."""
    names = [f"{n} string" for n in NAMES]
    options = {"multiLine": True, "header": head, "escape": '"', "nullValue": "\u0001", "emptyValue": ""}
    return sorted(map(tuple, spark.read.options(**options).schema(", ".join(names)).csv(path).collect()), key=repr)


def ours(spark, path, head=True, **more):
    quoted = QuotedFiles(spark, [path], ",", "utf-8")
    records = quoted.records({h: 0 for h in quoted.heads()} if head else None)
    shape = ", ".join(f"{n} string" for n in NAMES)
    options = {"multiLine": "true", "escape": '"', "nullValue": "\u0001", "emptyValue": ""}
    parsed = records.select(F.from_csv("record", F.lit(shape), options).alias("r")).select("r.*")
    return quoted, sorted(map(tuple, parsed.collect()), key=repr)


@pytest.mark.parametrize("end,head,last", [("\n", True, True), ("\r\n", True, False), ("\n", False, False)])
def test_ranges_of_random_files(spark, tmp_path, small_ranges, end, head, last):
    rng = random.Random(len(end) + head)
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(3):
        # a first record with other line breaks misleads Spark's reader about the line ends of the file
        write(folder / f"f{i}.csv", rows_of(rng, 60, mixed=head), end, head, last=last)
    found, got = ours(spark, str(folder), head)
    assert found.ranges.count() > 60 and found.ranges.filter("state = 1").count() > 10
    assert found.lines.rdd.getNumPartitions() > 30
    assert got == whole(spark, str(folder), head)
    assert len(got) == 180


def test_read_table_in_many_tasks(spark, tmp_path, small_ranges):
    rng = random.Random(9)
    folder = tmp_path / "files"
    folder.mkdir()
    rows = rows_of(rng, 40)
    write(folder / "a.csv", rows)
    (folder / "b.csv").write_text("﻿c,extra,a\n1,\"two\nlines\",3\n4,5\n1,2,3,4\n", encoding="utf-8")
    (folder / "empty.csv").write_text("")
    (folder / "c.csv.gz").write_bytes(gzip.compress(b"a,b,c\n7,\"in\nside\",8\n"))
    got = read_table(spark, str(folder), multi_line=True, file_column="file")
    assert set(got.columns) == {"a", "b", "c", "extra", "file"}
    found = {(r["file"].rsplit("/", 1)[1], r["a"]): r for r in got.collect()}
    assert len(found) == 40 + 2 + 1
    assert found["b.csv", "3"]["extra"] == "two\nlines" and found["b.csv", None]["c"] == "4"
    assert found["c.csv.gz", "7"]["b"] == "in\nside"
    plain = {r["a"]: (r["b"], r["c"]) for r in spark.createDataFrame(whole(spark, str(folder / "a.csv")), NAMES).collect()}
    missing = {"", "NA", None}
    for (file, a), r in found.items():
        if file == "a.csv":
            assert (r["b"], r["c"]) == tuple(None if v in missing else v for v in plain[a])


def test_other_charsets_and_bad_lines(spark, tmp_path, small_ranges):
    (tmp_path / "l.csv").write_bytes("a;b\n1;\"é\nü\"\n2;x;y;z\n".encode("latin-1"))
    rows = read_table(spark, str(tmp_path / "l.csv"), sep=";", encoding="latin1", multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("1", "é\nü")]
    with pytest.raises(Exception, match="more fields"):
        read_table(spark, str(tmp_path / "l.csv"), sep=";", encoding="latin1", multi_line=True, bad_lines="error").collect()
    (tmp_path / "w.csv").write_bytes("a,b\n1,\"x\ny\"\n".encode("utf-16"))
    rows = read_table(spark, str(tmp_path / "w.csv"), encoding="utf-16", columns=["a", "b"], multi_line=True).collect()
    assert ("1", "x\ny") in [tuple(r) for r in rows]
    assert can_split("cp437") and not can_split("utf-16") and not can_split("none such")


def test_states_of_lines():
    def scan(text, inside):
        """A character at a time."""
        state = "quoted" if inside else "start"
        i = 0
        while i < len(text):
            c = text[i]
            if state == "start":
                state = "quoted" if c == '"' else "start" if c == "," else "plain"
            elif state == "plain":
                state = "start" if c == "," else "plain"
            elif c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    state = "plain"
            i += 1
        return state == "quoted"

    rng = random.Random(4)
    for _ in range(20_000):
        line = "".join(rng.choice('"",ab') for _ in range(rng.randint(0, 9)))
        for inside in (False, True):
            assert ends_inside(line.encode(), inside, b",") == scan(line, inside), (line, inside)
