"""CSV files against pandas, cut into splits of a few bytes so that records go over their ends."""

import random

import pandas as pd
import pytest

from tabulark.sources.csv_records import QuoteScanner, parsed
from tabulark.sources.datasets import load_csv

FIXTURE = '''id,text,mark,"a ""name""",whole
1,"a ""b"" c",x,1.5,true
2,"two
lines",NA,-2e3,FALSE

3,,n/a,,True
4,"comma, and ""quote""",5" pipe,.5,true
  \t
5,"ab"c,"NA",7,false
6,"
""
",last,inf,true
'''


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("96b", "1b", "8")):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def rows(df):
    """All values as text, missing ones as None."""
    return sorted([tuple(None if v is None else str(v) for v in r) for r in df.collect()], key=repr)


def pandas_rows(path, **more):
    frame = pd.read_csv(path, dtype=str, **more)
    return sorted([tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False)], key=repr)


def write(tmp_path, text, name="data.csv"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def strings(spark, path, **more):
    names = pd.read_csv(path, nrows=0).columns
    return load_csv(spark, path, schema=", ".join(f"`c{i}` string" for i in range(len(names))), **more)


@pytest.mark.parametrize("ends", ("\n", "\r\n"))
def test_fixture(spark, tmp_path, tiny_splits, ends):
    path = write(tmp_path, FIXTURE.replace("\n", ends))
    assert rows(strings(spark, path)) == pandas_rows(path)
    df = load_csv(spark, path)
    assert df.columns == list(pd.read_csv(path, nrows=0).columns)
    assert dict(df.dtypes) == {"id": "int", "text": "string", "mark": "string", 'a "name"': "double", "whole": "boolean"}
    assert [r[0] for r in df.filter("text is null").select("id").collect()] == [3]
    assert df.filter("id = 6").first()['a "name"'] == float("inf")


@pytest.mark.parametrize("seed", range(4))
def test_random_files(spark, tmp_path, tiny_splits, seed):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(['"', ",", "\n", "a", "b", " ", "é", "\r\n", "NA"]) for _ in range(rng.randrange(9)))
    lines = ["x,y,z"]
    for _ in range(40):
        parts = []
        for _ in range(3):
            value = cell()
            plain = value.replace("\n", "").replace("\r", "").replace(",", "").lstrip('"')
            parts.append(plain if rng.random() < 0.4 else '"' + value.replace('"', '""') + '"' + rng.choice(("", "", "tail")))
        lines.append(",".join(parts))
    path = write(tmp_path, "\n".join(lines) + rng.choice(("", "\n")))
    assert rows(strings(spark, path)) == pandas_rows(path)


def test_splits_that_lie_inside_one_field(spark, tmp_path, tiny_splits):
    long = "\n".join(f'line {i}, with ""quotes""' for i in range(60))
    path = write(tmp_path, f'a,b\n1,"{long}"\n2,"{long}"\n3,x\n')
    lines = spark.read.option("lineSep", "\n").text(path)
    assert lines.rdd.getNumPartitions() > 20
    assert rows(strings(spark, path)) == pandas_rows(path)


def test_types(spark, tmp_path):
    path = write(tmp_path, "i,l,f,b,t,n,big\n1,3000000000,1,True,1,,99999999999999999999\n,2,2.5,,x,NA,1\n 7 ,3,1e3,false,2024-01-01,null,2\n")
    df = load_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "boolean", "string", "double", "string"]
    assert df.collect()[2]["i"] == 7 and df.filter("i is null").count() == 1
    typed = load_csv(spark, path, schema="i long, l string, f string, b boolean, t date, n string, big double")
    assert [t for _, t in typed.dtypes] == ["bigint", "string", "string", "boolean", "date", "string", "double"]
    assert typed.filter("t is not null").count() == 1


def test_headers_marks_and_lengths(spark, tmp_path):
    path = write(tmp_path, "﻿a;a;;A\n1;2\n'x';NA;-;q\n", "odd.csv")
    df = load_csv(spark, path, sep=";", na_marks=("-",))
    assert df.columns == ["a", "a.1", "Unnamed: 2", "A.2"]
    assert rows(df) == sorted([("1", "2", None, None), ("'x'", "NA", None, "q")], key=repr)
    with pytest.raises(ValueError, match="3 fields"):
        load_csv(spark, write(tmp_path, "a,b\n1,2\n1,2,3\n", "long.csv"))
    assert load_csv(spark, write(tmp_path, "a,b\n", "only_header.csv")).columns == ["a", "b"]
    assert load_csv(spark, write(tmp_path, "", "empty.csv")).columns == []


def test_a_folder_with_a_header_in_each_file(spark, tmp_path):
    for i in range(3):
        write(tmp_path, f'a,b\n{i},"x\n{i}"\n', f"part{i}.csv")
    assert rows(load_csv(spark, str(tmp_path))) == [(str(i), f"x\n{i}") for i in range(3)]
    write(tmp_path, "a,c\n1,2\n", "other.csv")
    with pytest.raises(ValueError, match="different headers"):
        load_csv(spark, str(tmp_path))


def test_scanner_agrees_with_whole_parse(spark, tmp_path, tiny_splits):
    scan = QuoteScanner(",")
    assert not scan.inside_after('a"b,c', False) and scan.inside_after('a,"b', False) and not scan.inside_after('b",c', True)
    assert scan.inside_after('b","c', True) and scan.inside_after('""', True) and not scan.inside_after('"""",x', False)
    path = write(tmp_path, "a\n1\n2\n")
    assert sorted(r["fields"] for r in parsed(spark, path).collect()) == [["1"], ["2"], ["a"]]
