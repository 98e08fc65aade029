"""Import rows, export batches, receipts and scalar rules on small cases with known results."""

import datetime
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.functions import rules, text
from siltstone.operators import batches, imports, summaries
from siltstone.plans import catalogue, exchange
from siltstone.sources import manifests

DATA = "/root/testdata/sf0.001"
GOOD = {
    "seafood_code": "TUNA", "source_dataset": "gbif", "source_record_id": "7", "source_url": "https://gbif.org/7", "image_url": "https://img.gbif.org/7.jpg", "creator": "Jane", "license": "CC-BY",
    "license_url": "", "attribution": "", "source_location": "", "source_date": "",
}


def normalised(spark, *changes, extra=None):
    rows = [(i, *[{**GOOD, **c}[f] for f in imports.FIELDS], (extra or {}).get(i)) for i, c in enumerate(changes)]
    schema = "row long, " + ", ".join(f"{f} string" for f in imports.FIELDS) + ", extra map<string,string>"
    return {r.row: r for r in imports.normalise(spark.createDataFrame(rows, schema), (".gbif.org", ".inaturalist.org")).collect()}


def test_first_problem_of_a_row(spark):
    cases = [
        ({}, None, None), ({"creator": "x" * 513, "license": "none"}, "FIELD_TOO_LONG", "parse_errors"), ({"seafood_code": "CON"}, "INVALID_SPECIES", "invalid_species"), ({"seafood_code": "a\x01", "license": ""}, "INVALID_CONTROL_CHARACTER", "parse_errors"),
        ({"source_dataset": None}, "UNSUPPORTED_SOURCE", "invalid_sources"), ({"source_record_id": " "}, "MISSING_SOURCE_IDENTITY", "parse_errors"), ({"source_url": " "}, "MISSING_URL", "missing_urls"), ({"image_url": "https://a b.gbif.org"}, "UNSAFE_URL", "missing_urls"),
        ({"image_url": "https://img.gbif.org/\x01"}, "INVALID_CONTROL_CHARACTER", "missing_urls"), ({"license_url": "HTTP://localhost/"}, "INVALID_LICENSE_URL", "invalid_licenses"), ({"source_dataset": "INATURALIST"}, "UNSAFE_URL", "missing_urls"),
        ({"image_url": "https://img.gbif.org:444/7"}, "UNSAFE_URL", "missing_urls"), ({"image_url": "https://evil.org/7"}, "UNAPPROVED_IMAGE_HOST", "missing_urls"), ({"license": "CC-BY-ND"}, "INVALID_LICENSE", "invalid_licenses"), ({"license": None}, "INVALID_LICENSE", "invalid_licenses"),
        ({"creator": "\x02", "license": None}, "INVALID_CONTROL_CHARACTER", "parse_errors"), ({"source_location": "\x7f"}, "INVALID_CONTROL_CHARACTER", "parse_errors"), ({"source_url": "https://gbif.org" + "?" + "q" * 2031}, "FIELD_TOO_LONG", "parse_errors"),
    ]
    got = normalised(spark, *[c for c, _, _ in cases])
    assert [(got[i].problem, got[i].counter) for i in range(len(cases))] == [(p, k) for _, p, k in cases]
    assert got[12].host == "evil.org" and got[12].attribution is None


def test_values_of_a_good_row(spark):
    got = normalised(
        spark, {"license": "cc_by-sa 4.0", "creator": " A\n B ", "source_date": "about 7 Mar 2017"}, {"creator": None, "source_date": "long ago"},
        {"source_dataset": "INATURALIST", "image_url": "HTTPS://Static.iNaturalist.org/photos/1/medium.JPEG?5#x"}, {},
        extra={0: {" depth ": " 3  m ", "local_Path": "x", "Review_notes": "y", "empty": " ", "none": None, "sha256": "z"}, 3: {"big": "é" * 40_000}},
    )
    assert (got[0].license, got[0].creator, got[0].attribution, got[0].metadata, got[0].observed_on) == ("CC-BY-SA-4.0", "A B", "A B", {"depth": "3 m"}, datetime.date(2017, 3, 7))
    assert (got[1].attribution, got[1].warning, got[1].metadata) == ("GBIF 7", "UNPARSED_SOURCE_DATE", {"raw_source_date": "long ago"})
    assert (got[2].preview_url, got[2].original_url) == ("https://static.inaturalist.org/photos/1/large.jpeg?5", "https://static.inaturalist.org/photos/1/original.jpeg?5")
    assert got[2].raw_urls == {"image_url": "HTTPS://Static.iNaturalist.org/photos/1/medium.JPEG?5#x"}
    assert got[3].problem == "METADATA_TOO_LARGE"
    assert normalised(spark, {})[0].raw_urls == {}


def test_metadata_limit_to_the_byte(spark):
    # {"k": "..."} has nine bytes beside the value
    got = normalised(spark, {}, {}, extra={0: {"k": "a" * (65_536 - 9)}, 1: {"k": "a" * (65_536 - 8)}})
    assert [got[i].problem for i in (0, 1)] == [None, "METADATA_TOO_LARGE"]


def test_commit_needs_the_preview_that_holds(spark):
    state = spark.createDataFrame([("a", "1")], "identity string, material string")
    rows = spark.createDataFrame([(1, "NEW"), (2, "EXACT_DUPLICATE"), (3, "DUPLICATE_IMAGE_URL")], "row long, outcome string")
    said = imports.preview(rows, state, ["INVALID_SPECIES"])
    assert tuple(imports.commit(said, said).first()) == ("COMMITTED", 3, 1, 1, 1, 0)
    later = imports.preview(rows, state.unionAll(state), ["INVALID_SPECIES"])
    assert tuple(imports.commit(said, later).first()) == ("IMPORT_PREVIEW_STALE", 3, 0, 0, 0, 0)
    none = imports.preview(rows.filter("row > 1"), state, ["INVALID_SPECIES"])
    assert imports.commit(none, none, skip_blocking=True).first().status == "IMPORT_NO_VALID_ROWS"
    empty = imports.preview(rows.limit(0), state.limit(0), ["INVALID_SPECIES"])
    assert imports.commit(empty, empty).first().status == "IMPORT_PREVIEW_BLOCKED"
    full = spark.createDataFrame([(1, "b"), (2, "a")], "row long, identity string")
    went = imports.commit(said, said)
    assert [r.identity for r in imports.inserted(full, rows, went, state).collect()] == ["b"]
    assert imports.inserted(full, rows, imports.commit(said, later), state).isEmpty()
    done = state.unionByName(spark.createDataFrame([("b", "2")], state.schema))
    assert imports.inserted(full, rows, went, done).isEmpty()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
def test_commit_without_new_rows_equals_its_sql(spark, tmp_path):
    # the earlier import (row 0) has the only url, so no row is NEW
    texts = ["a", "b", "c", "b"]
    spark.createDataFrame([(i, x, "en", "web", 1) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for t in ("nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(catalogue.ORACLE["import_commit"])
    want = [dict(zip([c[0] for c in found.description], r)) for r in found.fetchall()]
    assert [r.asDict() for r in exchange.import_commit(spark, str(tmp_path)).collect()] == want
    assert want == [{"status": "IMPORT_NO_VALID_ROWS", "total": 3, "inserted": 0, "skipped_exact": 0, "skipped_url_duplicates": 0, "skipped_blocking": 0}]


def test_purge_of_expired_previews(spark):
    previews = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1 + i)) for i in range(5)], "preview_id long, expires_at timestamp")
    left = imports.purge(previews, F.lit("2024-01-04").cast("timestamp"), most=2)
    assert sorted(r.preview_id for r in left.collect()) == [2, 3, 4]


@pytest.fixture(scope="module")
def exported(spark):
    deltas = spark.createDataFrame([(i, "ADD", "t" * 10) for i in (1, 2, 10, 11)], "item_id long, action string, target string")
    made = spark.createDataFrame(
        [(1, "ALL", "pending", datetime.datetime(2024, 1, 9)), (2, "ALL", "pending", datetime.datetime(2024, 1, 1)), (3, "X", "completed", datetime.datetime(2024, 1, 9))], "batch_id long, scope string, status string, expires_at timestamp"
    )
    items = spark.createDataFrame([(1, 2, "pending"), (2, 10, "pending"), (1, 11, "succeeded"), (3, 1, "pending")], "batch_id long, item_id long, status string")
    return deltas, made, items


def test_batch_of_what_no_live_batch_holds(spark, exported):
    now = F.lit("2024-01-02").cast("timestamp")
    said, rows = batches.create(*exported, "ALL", now, F.octet_length("target"), most_bytes=20)
    assert [r.item_id for r in rows.orderBy("running_bytes").collect()] == [1, 10]  # as text, 11 comes third
    assert tuple(said.first()) == ("CREATED", 2, datetime.datetime(2024, 1, 9))
    assert batches.create(*exported, "ALL", now, F.octet_length("target"), most_bytes=5)[0].first().status == "EXPORT_ROW_TOO_LARGE"
    said, rows = batches.create(*exported, "X", now, F.octet_length("target"))
    assert said.first().status == "EXPORT_SCOPE_OVERLAP" and rows.isEmpty()
    deltas, made, items = exported
    assert batches.create(deltas.filter("item_id = 2"), made, items, "ALL", now, F.octet_length("target"))[0].first().status == "NO_WORK"


def test_abandon_and_archive(spark, exported):
    _, made, _ = exported
    assert [(r.status, r.problem) for r in batches.abandon(made, F.lit(3)).orderBy("batch_id").collect()] == [("pending", None), ("pending", None), ("completed", "EXPORT_BATCH_COMPLETED")]
    assert batches.abandon(made, F.lit(1)).filter("batch_id = 1").first().status == "expired"
    archived = batches.archive(made.withColumn("archived", F.col("batch_id") == 2), F.lit(True)).orderBy("batch_id").collect()
    assert [(r.status, r.archived) for r in archived] == [("expired", True), ("pending", True), ("completed", True)]


def test_receipt_is_rejected_as_a_whole(spark):
    sha = "a" * 64
    stored = spark.createDataFrame([(1, "ADD", "PENDING", None, "images/T/1.image", None), (2, "REMOVE", "SUCCEEDED", sha, "_removed/2.jpg", "_removed/2.jpg")], "k long, action string, status string, sha256 string, target string, path string")
    payload = lambda *rows: spark.createDataFrame(list(rows), "k long, status string, sha256 string, path string")
    said = lambda p: {r.problem: r.n for r in batches.receipt_rejections(stored, p, ["k"]).collect()}
    good = payload((1, "SUCCEEDED", sha.upper(), "images/T/1.PNG"), (2, "SUCCEEDED", sha, "_removed/2.jpg"))
    assert said(good) == {} and batches.accepted(good, batches.receipt_rejections(stored, good, ["k"])).count() == 2
    bad = payload((1, "SUCCEEDED", sha, "images/T/1.exe"), (1, "FAILED", None, None), (2, "FAILED", None, None), (3, "FAILED", None, None))
    assert said(bad) == {"RECEIPT_PATH_INVALID": 1, "RECEIPT_DUPLICATE_ITEM": 1, "RECEIPT_SUCCESS_CONFLICT": 1, "RECEIPT_ITEM_NOT_IN_BATCH": 1}
    assert batches.accepted(bad, batches.receipt_rejections(stored, bad, ["k"])).isEmpty()
    assert said(payload((1, "SUCCEEDED", None, None))) == {"RECEIPT_HASH_INVALID": 1}
    assert said(payload().limit(0)) == {}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["receipt_rejections", "receipt_state", "receipt_lists"])
def test_receipts_deal_lines_out_before_they_sort_them(spark, name):
    plan = getattr(exchange, name)(spark, DATA)._jdf.queryExecution().sparkPlan().toString().split("\n")
    scans = [n for n, line in enumerate(plan) if "FileScan parquet" in line]
    assert scans
    for n in scans:
        above = next(line for line in reversed(plan[:n]) if any(x in line for x in ("Exchange", "Sort", "WindowGroupLimit")))
        assert "REPARTITION_BY_COL" in above


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["receipt_rejections", "receipt_state", "receipt_lists"])
def test_receipts_sort_lines_once(spark, name):
    plan = getattr(exchange, name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    anew = name == "receipt_rejections"  # its payload has other keys than its lines, so it is dealt out and sorted by them
    assert 0 < plan.count("- Sort [") == plan.count("- FileScan parquet") + anew
    assert name != "receipt_lists" or "Aggregate" not in plan  # no task keeps the keys that it has named


def test_receipt_lists_name_an_item_once(spark):
    after = spark.createDataFrame([(1, 1, "SUCCEEDED"), (2, None, "SUCCEEDED"), (3, 1, "PENDING"), (4, 1, "SUCCEEDED")], "a long, b int, status string")
    payload = spark.createDataFrame([(1, 1, "FAILED"), (1, 1, "SUCCEEDED"), (1, 1, "SUCCEEDED"), (2, None, "SUCCEEDED"), (2, None, "SUCCEEDED"), (3, 1, "FAILED")], "a long, b int, status string")
    assert sorted((r.a, r.b, r.list) for r in batches.receipt_lists(after, payload, ["a", "b"]).collect()) == [(1, 1, "accepted"), (2, None, "accepted"), (3, 1, "pending")]


def test_a_repeated_item_is_one_rejection(spark):
    stored = spark.createDataFrame([("a", "ADD", "PENDING", None, "images/a.image", None)], "k string, action string, status string, sha256 string, target string, path string")
    payload = spark.createDataFrame([("a", "FAILED", None, None)] * 3 + [("b", "FAILED", None, None)] * 2, "k string, status string, sha256 string, path string")
    assert {r.problem: r.n for r in batches.receipt_rejections(stored, payload, ["k"]).collect()} == {"RECEIPT_DUPLICATE_ITEM": 2, "RECEIPT_ITEM_NOT_IN_BATCH": 2}


def test_path_parts_of_long_names(spark):
    # with a pattern for both ends each run of dots was searched once for each of its dots
    rng = random.Random(5)
    names = ["a" + "." * 200_000 + "b", "a" + "." * 200_000, "é" * 200_000 + "b", "", "._", "a" * 127 + ".", "a" * 127 + "._b", "a" * 128 + "é"]
    names += ["".join(rng.choice("aB-._é\n 例") * rng.choice((1, 1, 3, 90)) for _ in range(rng.randrange(12))) for _ in range(300)]
    plain = lambda x: (re.sub("[^A-Za-z0-9_.-]+", "_", x).strip("._") or "x")[:128]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, t string").select("i", rules.path_part(F.col("t"), "x").alias("p")).orderBy("i").collect()
    assert [r.p for r in rows] == [plain(x) for x in names]


def test_receipt_paths(spark):
    ok = lambda path, expected, action: spark.range(1).select(rules.receipt_path_ok(F.lit(path), F.lit(expected), F.lit(action)).alias("x")).first().x
    assert ok("images/T/1.webp", "images/T/1.image", "ADD") and ok("a/b.jpg", "a/b.jpg", "MOVE")
    for path in ("images/U/1.webp", "images/T/2.webp", "images/T/1.txt", "/images/T/1.jpg", "images/T/../T/1.jpg", "images\\T\\1.jpg", "images/T/1", "images/T/1.jpg\n"):
        assert not ok(path, "images/T/1.image", "ADD"), path
    assert not ok("images/T/1.jpg", "images/T/1.image", "MOVE")


def test_positions_of_a_cancelled_receipt(spark):
    manifest = spark.createDataFrame([(i, 10 + i) for i in range(4)], "position long, k long")
    said = lambda r, cancelled: {x.problem: x.n for x in batches.receipt_against_manifest(r, manifest, ["k"], cancelled=cancelled).collect()}
    prefix = manifest.filter("position < 2")
    assert said(prefix, True) == {} and said(prefix, False) == {"COUNT_MISMATCH": 2}
    assert said(manifest.withColumn("k", F.col("k") * 2).unionAll(spark.createDataFrame([(9, 1)], manifest.schema)), True) == {"ITEM_MISMATCH": 5}


def test_items_passed_on(spark):
    state = spark.createDataFrame([(1, 1, True, 5), (2, 1, True, 6), (3, 1, False, 7), (4, 1, False, 8), (5, 1, True, None), (6, 1, True, 9)], "item_id long, version int, active boolean, open_member long")
    asked = spark.createDataFrame([(1, 1, 20), (2, 1, 20), (3, 1, 21), (4, 1, None), (5, 1, None), (6, 2, None), (7, 1, None)], "item_id long, version int, member long")
    reviewed = spark.createDataFrame([(9, 20, True)], "item_id long, member long, current boolean")
    members = spark.createDataFrame([(20, True), (21, True)], "member long, active boolean")
    got = {r.item_id: (r.open_member, r.version, r.outcome) for r in summaries.pass_on(state, asked, reviewed, members).collect()}
    assert got == {
        1: (20, 2, "TRANSFERRED"), 2: (6, 1, "REVIEWER_NOT_ELIGIBLE"), 3: (7, 1, "SPECIES_NOT_ACTIVE"), 4: (None, 2, "RELEASED"), 5: (None, 1, "CANDIDATE_NOT_OPEN"), 6: (9, 1, "STALE_CANDIDATE_VERSION"), 7: (None, None, "NOT_FOUND"),
    }
    knows = spark.createDataFrame([(1, 20, False)], reviewed.schema)
    assert summaries.pass_on(state, asked.filter("item_id = 1"), knows, members).first().outcome == "REVIEWER_NOT_ELIGIBLE"


def test_channels_first(spark):
    got = spark.range(1).select(rules.channels_first(F.array(*[F.lit(x) for x in (255, 0, 51, 9, 0, 255, 102, 9)]), (0.5, 0.0, 0.2), (0.5, 1.0, 0.2)).alias("x"), rules.channels_first(F.array(F.lit(1)), (0, 0, 0), (1, 1, 1)).alias("y")).first()
    assert got.x == pytest.approx([1.0, -1.0, 0.0, 1.0, 0.0, 1.0]) and got.y is None
    assert spark.range(1).select(rules.channels_first(F.array().cast("array<int>"), (0, 0, 0), (1, 1, 1)).alias("x")).first().x == []
    with pytest.raises(ValueError):
        rules.channels_first(F.array(), (0, 0, 0), (1, 0, 1))


def test_names_dates_and_errors(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    assert [one(rules.file_name(F.lit(x))) for x in ("C:\\a b\\ü*.csv", "..", None, "y" * 300)] == ["ü_.csv", "candidates.csv", "candidates.csv", "y" * 255]
    assert [one(rules.path_part(F.lit(x), "none")) for x in ("a b/ü.", "__", None)] == ["a_b", "none", "none"]
    assert one(rules.millis_date(F.lit(1_583_020_799_999))) == "2020-02-29"
    assert [one(rules.error_category(F.lit("operation"), F.lit(x))) for x in ("ADD_RECOVERY_INVALID", "UNEXPECTED_OPERATION_FAILURE", "X")] == ["INVALID_IMAGE", "UNEXPECTED_ERROR", "OPERATION_ERROR"]
    assert one(rules.source_bucket(F.lit("x"), F.lit(None).cast("string"))) == ("host:unknown", 1.0)
    assert one(rules.import_licence(F.lit("PUBLIC-DOMAIN-1.0"))) == "PUBLIC-DOMAIN-1.0" and one(rules.import_licence(F.lit("used by permission"))) is None
    assert [str(one(text.source_date(F.lit(x)))) for x in ("2020-02-30", "1.2.2020x", "on 3 JAN 2020", "5 Foo 2020")] == ["None", "2020-02-01", "2020-01-03", "None"]


def test_canonical_manifest_round_trip(spark, tmp_path):
    row = lambda i, **c: tuple({**dict.fromkeys(manifests.CANONICAL, ""), "candidate_id": f"0000000{i}-0000-0000-0000-000000000000", "review_id": "0" * 8 + "-0000-0000-0000-" + "0" * 12, "review_version": "1", "relative_path": f"images/T/{i}.jpg", "sha256": "a" * 64, "creator": 'a "b", c', **c}.values())
    schema = ", ".join(f"{c} string" for c in manifests.CANONICAL)

    def saved(name, *rows):
        path = str(tmp_path / name)
        manifests.write_canonical(spark.createDataFrame(list(rows), schema), path)
        return path

    got = manifests.read_canonical(spark, saved("good", row(3), row(1), row(2)))
    assert sorted(tuple(r) for r in got.fillna("").collect()) == [row(1), row(2), row(3)]
    for name, rows, code in (("twice", [row(1), row(1)], "REPEATED"), ("case", [row(1), row(2, relative_path="images/t/1.JPG")], "REPEATED"), ("up", [row(1, relative_path="../1.jpg")], "BAD_PATH"), ("hash", [row(1, sha256="A" * 64)], "BAD_HASH")):
        with pytest.raises(manifests.BadFile, match=code):
            manifests.read_canonical(spark, saved(name, *rows))
    assert [[r.id for r in c] for c in manifests.chunks(spark.range(5).orderBy(F.desc("id")), 2)] == [[4, 3], [2, 1], [0]]


def test_collector_configuration(spark, tmp_path):
    rows = spark.createDataFrame([("B", "b", "b", "Bb", 2, None, None, None, None), ("A", "a", "a", "Aa", 1, 5, None, "Category:X", None)], "seafood_code string, name_zh string, name_en string, scientific_name string, candidate_count long, inat_taxon_id long, gbif_taxon_key long, commons_category string, fish_vista_filter string")
    (tmp_path / "c.json").write_text(manifests.config_json(rows).first().value)
    back = manifests.read_config(spark, str(tmp_path / "c.json")).collect()
    assert [(r.seafood_code, r.commons_category) for r in back] == [("A", "Category:X"), ("B", "Category:Bb")]
