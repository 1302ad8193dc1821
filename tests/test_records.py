"""CSV records cut in parallel against the reader that takes whole files; JSON files of both kinds in one folder."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from escalade.sources import io as IO
from escalade.sources import records as C


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="") as f:
        f.write(text)


def field(rng):
    x = "".join(rng.choice(["a", "b", " ", ",", '"', "\n", "\n\n", "é"]) for _ in range(rng.randrange(30)))
    return '"' + x.replace('"', '""') + '"' if rng.random() < 0.7 or any(c in x for c in ',"\n') or x != x.strip() else x


@pytest.mark.parametrize("block", [64, 200, 5000])
def test_rows_equal_the_whole_file_reader(spark, tmpdir_path, block):
    rng = random.Random(block)
    for n in range(3):
        write(f"{tmpdir_path}/t.csv", f"p{n}.csv", "id,text,note\n" + "".join(f"{n}-{i},{field(rng)},{field(rng)}\n" for i in range(60)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(block))
    try:
        got = IO.read_table(spark, f"{tmpdir_path}/t.csv")
        tasks = spark.read.text(f"{tmpdir_path}/t.csv").rdd.getNumPartitions()
        rows = sorted(tuple("" if v is None else v for v in r) for r in got.collect())
    finally:
        spark.conf.set(key, before)
    want = spark.read.options(header=True, multiLine=True, escape='"', quote='"').csv(f"{tmpdir_path}/t.csv")
    assert got.columns == want.columns and (tasks > 30 or block > 64)
    assert rows == sorted(tuple("" if v is None else v for v in r) for r in want.collect())


def test_one_record_over_many_blocks_and_odd_files(spark, tmpdir_path):
    long = "x, y\n" * 300
    write(f"{tmpdir_path}/l.csv", "a.csv", f'id,text\r\n1,"{long}"\r\n\r\n2,"say ""hi"""\r\n3,"open')
    write(f"{tmpdir_path}/l.csv", "b.csv", "id,text\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = {r.id: r.text for r in IO.read_table(spark, f"{tmpdir_path}/l.csv").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got["1"] == long and got["2"] == 'say "hi"' and len(got) == 3
    write(f"{tmpdir_path}/d.csv", "a.csv", "id,text\n1,a\n")
    write(f"{tmpdir_path}/d.csv", "b.csv", "text,id\n1,a\n")
    with pytest.raises(ValueError, match="different headers"):
        C.read_csv(spark, f"{tmpdir_path}/d.csv")


def test_json_arrays_and_lines_in_one_folder(spark, tmpdir_path):
    rows = [{"id": i, "text": f"line\n{i}"} for i in range(6)]
    write(f"{tmpdir_path}/j.json", "a.json", json.dumps(rows[:3], indent=1))
    write(f"{tmpdir_path}/j.json", "b.json", "\n" + "\n".join(json.dumps(r) for r in rows[3:]) + "\n")
    got = IO.read_table(spark, f"{tmpdir_path}/j.json").orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == [(r["id"], r["text"]) for r in rows]
