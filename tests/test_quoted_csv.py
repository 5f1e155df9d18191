"""The splittable CSV reader against Python's csv module, over splits of many sizes."""

import csv
import random

import pytest

from tidetrace.sinks import writers as wr
from tidetrace.sources import saved as sv
from tidetrace.sources.quoted_csv import column_names, read_quoted_csv

PARTS = ["plain", "#MAGA rocks", "# Target: no", "a,b", 'say "hi"', "", "line\nbreak", '# Datasets: x\n"q"\n', "tail\r\nx",
         "ünï 😀", '"', ",", "\n\n\n", "x" * 50, "''", "#", "\\", '\\"']


@pytest.fixture
def split_bytes(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_bytes(n):
        for name in names:
            spark.conf.set(name, str(n))
    yield set_bytes
    for n, v in before.items():
        spark.conf.set(n, v)


def write(path, rows, lead="", columns=("id", "a", "b"), end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(lead)
        w = csv.writer(f, lineterminator=end)
        w.writerow(columns)
        w.writerows(rows)


@pytest.mark.parametrize("size", [200, 5_000, 1 << 27])
def test_equals_the_csv_module_for_any_split(spark, tmp_path, split_bytes, size):
    rng = random.Random(size)

    def cell():
        return " ".join(rng.choice(PARTS) for _ in range(rng.randint(0, 4)))

    rows = [[("#" if i % 5 == 0 else "") + str(i), cell(), cell()] for i in range(400)]
    rows[7][1] = "a cell of many splits\n" * 300
    write(tmp_path / "a.csv", rows[:200], '# Analysis Results - Generated now\n# Target: he said "x\n\n# Threshold: 0.5\n\n')
    write(tmp_path / "b.csv", rows[200:300], end="\r\n")
    write(tmp_path / "c.csv", [[c, a, b] for a, b, c in rows[300:]], columns=("b", "id", "a"))
    split_bytes(size)
    df = read_quoted_csv(spark, [str(tmp_path / f"{x}.csv") for x in "abc"], comments=True)
    got = df.collect()
    assert sorted((r.id, r.a or "", r.b or "") for r in got) == sorted(map(tuple, rows))
    assert {tuple(r.lead) for r in got if r.source_path.endswith("a.csv")} == {
        ("# Analysis Results - Generated now", '# Target: he said "x', "# Threshold: 0.5")}
    assert all(r.lead == [] for r in got if not r.source_path.endswith("a.csv"))
    assert len({(r.source_path, r.source_block, r.source_line) for r in got}) == 400
    if size == 200:
        assert len({(r.source_path, r.source_block) for r in got}) > 50


def test_odd_files(spark, tmp_path, split_bytes):
    (tmp_path / "a.csv").write_bytes(b'x,,x\n1,2,3\n"open\ncell')  # ends inside a cell
    (tmp_path / "b.csv").write_bytes(b"\n\n")
    (tmp_path / "c.csv").write_bytes(b"x\n\n\nlast without line end")
    split_bytes(1 << 20)
    df = read_quoted_csv(spark, [str(tmp_path / f"{x}.csv") for x in "abc"])
    got = sorted((r["x"] or "", r["_c1"], r["x.2"]) for r in df.collect())
    assert got[0] == ("1", "2", "3") and ("last without line end", None, None) in got and len(got) == 3
    assert column_names('a,"b\nc",a,a,') == ["a", "b\nc", "a.2", "a.3", "_c4"]


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_export_files_come_back_whole(spark, tmp_path, limit):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "#tag", "# Total Records: 9", 'q"', "a\r\nb", " x "]), i / 3) for i in range(120)]
    df = spark.createDataFrame(rows, "post_id long, Tweet string, `similarity, rounded` double")
    run = spark.createDataFrame([("r", "2024-01-01", "2024-01-02", "two\nlines: \"x", 0.0, ["a.csv", "b.csv"], 120)],
                                "run_id string, startDate string, endDate string, targetNarrative string, threshold double, "
                                "selectedDatasets array<string>, totalRecords long").selectExpr("*", "current_timestamp() generatedAt")
    files = wr.export_files(df, run, str(tmp_path / "e"), max_file_bytes=limit)
    assert (files > 5) == (limit == 300)
    got = sv.read_exported(spark, str(tmp_path / "e")).collect()
    assert sorted((int(r.post_id), r.Tweet, float(r["similarity, rounded"])) for r in got) == rows
    assert all(r.count_matches and r.targetNarrative == 'two lines: "x' and r.selectedDatasets == ["a.csv", "b.csv"]
               and r.threshold == 0.0 and (r.startDate, r.endDate) == ("2024-01-01", "2024-01-02") for r in got)
    assert len({r.file for r in got}) == files
    one = spark.createDataFrame([(None,), ("",), ("x",)], "Tweet string")
    wr.export_files(one, run, str(tmp_path / "one"))
    assert sorted(r.Tweet or "" for r in sv.read_exported(spark, str(tmp_path / "one")).collect()) == ["", "", "x"]
