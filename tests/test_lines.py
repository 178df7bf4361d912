import json
import os
import random

import pytest

from failurelens.sources import files, lines
from failurelens.streaming import streams


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture()
def folder(tmp_dir):
    rng = random.Random(3)
    for k in range(3):
        body = "".join(rng.choice(["\n", "  \n", f"line {k} {i} é{'x' * rng.randrange(40)}\r\n", f"l{i}\n"]) for i in range(120))
        write(f"{tmp_dir}/in/part-{k}.txt", body + ("no end" if k == 1 else ""))
    write(f"{tmp_dir}/in/_SUCCESS", "skipped")
    write(f"{tmp_dir}/in/.hidden/x.txt", "skipped")
    return tmp_dir + "/in"


def plain(folder):
    out = []
    for k in range(3):
        path, at = f"{folder}/part-{k}.txt", 0
        for line in open(path, "rb").read().split(b"\n"):
            if line.strip():
                out.append((path, at, (k << 44) + at, line.decode().removesuffix("\r")))
            at += len(line) + 1
    return out


@pytest.mark.parametrize("split", [1, 7, 100, 1 << 20])
def test_every_line_once_for_any_split(spark, folder, split):
    got = files.positioned(spark, folder, split).orderBy("seq").collect()
    assert [tuple(r) for r in got] == plain(folder)


def test_long_lines_over_blocks(spark, tmp_dir, monkeypatch):
    text = b"a" * 5000 + b"\n" + b"b" * 7 + b"\n\n" + b"c" * 9000
    with open(tmp_dir + "/x.txt", "wb") as f:
        f.write(text)
    monkeypatch.setattr(lines, "BLOCK", 64)
    for split in (3, 4999, 5001, 1 << 20):
        got = [r for p in lines.ranges(tmp_dir + "/x.txt", 0, 0, len(text), split)
               for b in lines.batches(tmp_dir, p, False) for r in b.to_pylist()]
        assert [(r["offset"], len(r["value"])) for r in got] == [(0, 5000), (5001, 7), (5010, 9000)]


def test_filters_choose_files_and_ranges(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan
    reader = lines.LinesReader(folder, 50, False)
    everything = len(reader.partitions())
    list(reader.pushFilters([EqualTo(("file",), f"{folder}/part-1.txt"), GreaterThan(("seq",), (1 << 44) + 200),
                             LessThan(("seq",), (1 << 44) + 400)]))
    kept = reader.partitions()
    assert 3 <= len(kept) <= 5 < everything and {p.file for p in kept} == {f"{folder}/part-1.txt"}


def test_filtered_rows_and_one_scan(spark, folder):
    df = files.positioned(spark, folder, 64)
    want = [r for r in plain(folder) if r[2] >= (1 << 44) + 300]
    got = df.where(f"seq >= {(1 << 44) + 300}").orderBy("seq")
    assert [tuple(r) for r in got.collect()] == want
    plan = files.buffer_lines(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Exchange" not in plan


def test_empty_missing_whole_and_compressed(spark, tmp_dir):
    assert files.positioned(spark, tmp_dir + "/none").collect() == []
    write(f"{tmp_dir}/e/a.json", "")
    assert files.positioned(spark, tmp_dir + "/e").collect() == []
    write(f"{tmp_dir}/d/a.json", b'{"a":\n 1}')
    write(f"{tmp_dir}/d/b.json", b"\xff\n")
    assert [r.value for r in files.positioned(spark, tmp_dir + "/d", whole=True).orderBy("seq").collect()] == \
        ['{"a":\n 1}', "�\n"]
    write(f"{tmp_dir}/z/a.gz", b"x")
    with pytest.raises(Exception, match="compressed"):
        files.positioned(spark, tmp_dir + "/z").collect()


def test_buffer_lines_keep_given_numbers(spark, tmp_dir):
    write(f"{tmp_dir}/b/a.json", '{"problem": "p", "weight": 2.0}\n\n{"seq": 7, "problem": "q"}\n')
    got = files.buffer_lines(spark, tmp_dir + "/b").orderBy("problem").collect()
    assert [(r.seq, r.problem, r.weight) for r in got] == [(0, "p", 2.0), (7, "q", None)]


def test_stream_takes_new_files_and_appended_lines(spark, tmp_dir):
    path, out, check = tmp_dir + "/log", tmp_dir + "/out", tmp_dir + "/check"

    def event(i):
        return json.dumps({"event": "e", "task_id": str(i), "timestamp": "2024-01-01T00:00:00+00:00"})

    def turn():
        stream = streams.event_line_stream(spark, path).select("seq", "task_id")
        q = stream.writeStream.option("checkpointLocation", check).format("parquet").option("path", out) \
            .trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.seq, r.task_id) for r in spark.read.parquet(out).collect())

    write(f"{path}/b.json", event(1) + "\n" + event(2) + "\n" + event(3)[:9])
    assert [t for _, t in turn()] == ["1", "2"]
    write(f"{path}/b.json", event(3)[9:] + "\n")
    write(f"{path}/a.json", event(4) + "\n")
    rows = turn()
    # the file that was seen first keeps its number, though its name is later
    assert [t for _, t in rows] == ["1", "2", "3", "4"] and rows[-1][0] == 1 << 44
    assert turn() == rows
    assert sorted(r.task_id for r in streams.event_lines(spark, path).collect()) == ["1", "2", "3", "4"]
