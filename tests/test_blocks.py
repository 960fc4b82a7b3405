"""CSV files and JSON arrays read in blocks: the same records as Python's readers, wherever blocks begin."""
import csv
import io
import json
import os
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from marrow.sources import blocks, tables
from marrow.streaming.ingest import scratch


@contextmanager
def splits(spark, size):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in zip(keys, (size, 1, 1)):
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


CELLS = ["", "a", "plain", 'say "hi"', "two\nlines", "\n\n", "x,y", "é中😀", '"', '","', "long " * 9, "end\n", '\n"\n']


@pytest.mark.parametrize("size", [23, 64, 300, 100000])
def test_csv_records_in_blocks_of_any_size(spark, size):
    rng, root, want = random.Random(size), scratch(spark, "blocks"), []
    for k in range(4):
        names = rng.sample(["text", "n", "other"], 3)
        body, eol = io.StringIO(), rng.choice(["\n", "\r\n"])
        w = csv.writer(body, lineterminator=eol, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        w.writerow(names)
        for i in range(rng.randint(0, 40)):
            row = {"text": rng.choice(CELLS) + "!", "n": i, "other": rng.choice(CELLS)}
            w.writerow([row[c] for c in names])
            want.append((f"c{k % 2}", f"{k}.csv", row["text"], i))
        text = body.getvalue()
        write(f"{root}/c{k % 2}/facebook/{k}.csv", text if rng.random() < 0.5 else text.rstrip("\r\n"))
    with splits(spark, size):
        df = tables.read_platform_csv(spark, root, "facebook", "text STRING, n INT")
        got = df.collect()
    assert sorted((r.category, r.file, r.text, r.n) for r in got) == sorted(want)
    by_file = {}
    for r in sorted(got, key=lambda r: (r.pos.file, r.pos.row)):
        by_file.setdefault(r.file, []).append(r.n)
    assert all(v == list(range(len(v))) for v in by_file.values())  # places give the order
    assert len({r.pos for r in got}) == len(got)


def values(rng, depth=0):
    pick = rng.randrange(6 if depth < 2 else 4)
    text = rng.choice(["", "a}b", '"}{[', "\\", '\\"', "x\ny", "é😀", "]}", "{" * 5, "word " * 8])
    return [text, rng.randrange(9), None, text, {"k": values(rng, depth + 1), "}": text} if pick == 4 else 1,
            [values(rng, depth + 1) for _ in range(2)] if pick == 5 else 2][pick]


@pytest.mark.parametrize("size", [17, 50, 333, 100000])
def test_json_arrays_in_blocks_of_any_size(spark, size):
    rng, root, want = random.Random(size + 1), scratch(spark, "blocks"), []
    for k in range(6):
        rows = [{"id": i, "text": rng.choice(["", "}", '"', "a\\"]) + str(i), "more": values(rng)} for i in range(rng.randint(0, 25))]
        form = k % 3
        text = (json.dumps(rows, ensure_ascii=False, indent=4) if form == 0 else json.dumps(rows) if form == 1
                else "".join(json.dumps(r) + "\n" for r in rows))
        want += [(f"t{k % 2}", f"s{k}", r["id"], r["text"]) for r in rows]
        write(f"{root}/t{k % 2}/s{k}.json", text + rng.choice(["", "\n"]))
    with splits(spark, size):
        got = tables.read_json_folder(spark, root, "id INT, text STRING", lanes=True).collect()
    assert {r.lane for r in got} == {"ok"}
    assert sorted((r.task, r.split, r.id, r.text) for r in got) == sorted(want)
    order = sorted(got, key=lambda r: (r.file, r.place))
    assert all(a.file != b.file or a.id < b.id for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("size", [20, 100000])
def test_cut_off_and_broken_objects_stay_in_lane_error(spark, size):
    root = scratch(spark, "blocks")
    write(f"{root}/cut.json", '[{"id": 1, "text": "a}"},\n {"id": 2, "text": "b"')
    write(f"{root}/string.json", '[{"id": 3, "text": "c"}, {"id": 4, "text": "never clo}sed}')
    write(f"{root}/bad.json", '[{"id": 5}, {"id": x}, {"id": 6}]')
    write(f"{root}/none.json", "[]")
    write(f"{root}/empty.json", "")
    with splits(spark, size):
        got = tables.read_json_rows(spark, root, "id INT, text STRING", lanes=True).collect()
        assert len(tables.read_json_rows(spark, root, "id INT, text STRING").collect()) == len(got)
    assert sorted(r.id for r in got if r.lane == "ok") == [1, 3, 5, 6]
    assert sorted(r.raw for r in got if r.lane == "error") == ['{"id": 2, "text": "b"', '{"id": 4, "text": "never clo}sed}', '{"id": x}']


def test_blocks_grow_with_the_dump_and_short_files_share_a_task(spark):
    from marrow.plans.q_sources import small_splits
    root = scratch(spark, "blocks")
    write(f"{root}/long.txt", json.dumps([{"id": i, "text": "x" * 90} for i in range(40000)]))
    for k in range(60):
        write(f"{root}/cut/{k}.txt", '[{"id":')
    size = os.path.getsize(f"{root.removeprefix('file:')}/long.txt")
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.txt"}
    for total, most in ((size, (size >> 16) + 62), (1 << 28, 10), (1 << 40, 2)):
        with small_splits(spark, total):
            assert 1 <= blocks._pieces(spark, root, blocks.BRACE, **options).rdd.getNumPartitions() <= most
            recs, table = blocks.records(spark, root, blocks.BRACE, **options)
            assert recs.count() == 40000 + 60 + 1  # the bracket that ends the array
            assert table.where("first IS NOT NULL").isEmpty()


def test_one_file_is_read_by_many_tasks(spark):
    root = scratch(spark, "blocks")
    write(f"{root}/t/one.json", json.dumps([{"id": i, "text": "x" * 50} for i in range(400)]))
    write(f"{root}/c/facebook/one.csv", "text,n\n" + "".join(f'"line\n{i}",{i}\n' for i in range(2000)))
    with splits(spark, 2000):
        pieces = blocks._pieces(spark, f"{root}/t/one.json", blocks.BRACE)
        assert pieces.rdd.getNumPartitions() > 5 and pieces.select("block").distinct().count() > 5
        assert tables.read_json_rows(spark, f"{root}/t/one.json", "id INT").agg(F.sum("id")).first()[0] == 399 * 200
        rows = tables.read_platform_csv(spark, root, "facebook", "text STRING, n INT")
        assert rows.agg(F.sum("n"), F.count_if(F.col("text") == F.concat(F.lit("line\n"), "n"))).first()[:] == (1999 * 1000, 2000)
