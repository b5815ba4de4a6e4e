"""CSV with quoted newlines: split reading equals Spark's own reading of whole files."""

import random

import pytest

from postloom.sources.files import scan_samples_csv
from postloom.sources.quoted import csv_records, read_quoted_csv

SCHEMA = "a STRING, b STRING, c STRING"


def _field(rng):
    text = "".join(rng.choice(["x", "é", " ", ",", "\n", '"', "\n\n", "word ", " ", "\t"]) for _ in range(rng.randrange(12)))
    if any(c in text for c in ',\n"') or rng.random() < 0.3:
        return '"' + text.replace('"', '""') + '"'
    return text


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_split_files_give_the_rows_of_whole_files(spark, tmp_path, seed, end):
    rng = random.Random(seed)
    for k in range(3):
        rows = [",".join(_field(rng) for _ in range(3)) for _ in range(400)]
        rows[7] = '"' + "long\nfield " * 900 + '",,'  # over several splits
        rows.insert(3, "")
        text = ("﻿" if k == 0 else "") + end.join(["a,b,c", *rows]) + (end if k else "")
        (tmp_path / f"{k}.csv").write_text(text, encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = csv_records(spark, str(tmp_path))
        assert lines.select("file", "record").distinct().count() == lines.count()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted(map(str, read_quoted_csv(spark, str(tmp_path), SCHEMA).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    reader = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    assert got == sorted(map(str, reader.csv(str(tmp_path)).collect()))


def test_samples_read_split_or_whole(spark, tmp_path):
    path = tmp_path / "s.csv"
    body = 'post_id,source_id,source,text,label\n 1 ,a, vk ,"line one\nline ""two"" with more than thirty",1\n2,b,tg,short,0\n3,c,tg,"' + "y" * 40 + '", 0 \n'
    path.write_text("﻿" + body, encoding="utf-8")
    both = [sorted(map(tuple, scan_samples_csv(spark, str(path), split=s).collect())) for s in (True, False)]
    assert both[0] == both[1] and [r[0] for r in both[0]] == ["1", "3"]
    (tmp_path / "empty.csv").write_text("")
    assert scan_samples_csv(spark, str(tmp_path / "empty.csv")).count() == 0
