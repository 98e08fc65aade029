"""Ordered exports against the standard library's writer, byte for byte."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from siltstone.sources import manifests, ordered_csv


@pytest.fixture
def uncoalesced(spark):
    """Ranges stay parts of their own, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(columns, rows):
    out = io.StringIO(newline="")
    w = csv.DictWriter(out, fieldnames=columns, lineterminator="\r\n", extrasaction="ignore")
    w.writeheader()
    w.writerows(rows)
    return "﻿".encode() + out.getvalue().encode()


def joined(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.iterdir()) if p.suffix == ".csv")


def test_parts_are_the_plain_file(spark, tmp_path, uncoalesced):
    r = random.Random(4)
    columns = ["code", "text", "n"]
    rows = [{"code": r.choice("abc"), "text": r.choice(["", None, 'q"', "x,y", "l\nm", "c\r\nd", " é 🙂", "plain"]), "n": i, "more": "no"} for i in range(3000)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "code string, text string, n int, more string").repartition(7)
    ordered_csv.write(df, f"file://{tmp_path}/out", columns, ["code", F.desc("n")])
    want = plain(columns, [{k: "" if v is None else v for k, v in x.items()} for x in sorted(rows, key=lambda x: (x["code"], -x["n"]))])
    assert joined(tmp_path / "out") == want and len(list((tmp_path / "out").iterdir())) > 2
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="FileExistsError|out"):
        ordered_csv.write(df, str(tmp_path / "out"), columns, ["n"])
    assert joined(tmp_path / "out") == want and [p.name for p in tmp_path.iterdir()] == ["out"]
    ordered_csv.write(df.limit(0), str(tmp_path / "out"), columns, ["n"], overwrite=True)
    assert joined(tmp_path / "out") == plain(columns, [])


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 990, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("code"), "id")
    with pytest.raises(Exception, match="broken"):
        ordered_csv.write(df, str(tmp_path / "out"), ["code"], ["id"])
    assert list(tmp_path.iterdir()) == []


def test_full_manifest_is_in_business_order(spark, tmp_path):
    items = spark.createDataFrame([(2, "b", "GBIF", 1), (1, "b", "GBIF", 1), (3, "a", "OBIS", 1), (4, "z", "A", 0)], "item_id int, code string, source_dataset string, sort_order int")
    manifests.write_full_manifest(items.withColumns({"creator": F.lit('x "y"'), "license": F.lit(None).cast("string")}), str(tmp_path / "m"), "item_id")
    got = list(csv.DictReader(io.StringIO(joined(tmp_path / "m").decode("utf-8-sig"), newline="")))
    assert [x["image_id"] for x in got] == ["4", "3", "1", "2"] and list(got[0]) == list(manifests.MANIFEST)
    assert got[0] | {"creator": 'x "y"', "license": "", "status": "CANDIDATE", "split": "UNASSIGNED", "whole_fish": "REVIEW", "seafood_code": "z"} == got[0]
