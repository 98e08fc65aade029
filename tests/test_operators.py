"""Operators, functions, readers and streams on small cases with known results."""

import hashlib
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scores, text, urls
from siltstone.operators import classify, counts, latest, metrics, progress, sync
from siltstone.sources import manifests, parsers
from siltstone.streaming import limiter


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_progress_of_a_seeded_review(spark):
    category = spark.createDataFrame([(1, True), (2, False)], "category_id long, active boolean")
    item = spark.createDataFrame([(i, 1, i != 6, 3 if i == 4 else None) for i in range(1, 7)] + [(7, 2, True, None)], "item_id long, category_id long, active boolean, open_member long")
    current = spark.createDataFrame([(1, "APPROVED"), (2, "APPROVED"), (3, "REJECTED"), (6, "APPROVED"), (7, "UNSURE")], "item_id long, decision string")
    got = progress.overview(item, category, current).first()
    assert (got.total, got.reviewed, got.open, got.pending, got.share, got.percent) == (5, 3, 1, 1, 0.6, 60.0)
    assert {r.decision: r.n for r in progress.decisions(item, category, current).collect()} == {"APPROVED": 2, "REJECTED": 1, "UNSURE": 0}
    empty = progress.overview(item.limit(0), category, current).first()
    assert (empty.total, empty.reviewed, empty.open, empty.pending, empty.share, empty.percent) == (0, 0, 0, 0, 0.0, 0.0)


def test_page_limits(spark):
    df = spark.range(5)
    assert [r.id for r in progress.page(df, [F.col("id")], 2, 3).collect()] == [3, 4]
    with pytest.raises(ValueError):
        progress.page(df, [F.col("id")], 101)


def test_softmax_and_ranking(spark):
    r = one(spark, scores.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("a"), scores.softmax(F.array().cast("array<double>")).alias("b"), scores.softmax(F.array(F.lit(float("inf")))).alias("c"), scores.resized(F.lit(400), F.lit(200), 256).alias("d"), scores.resized(F.lit(333), F.lit(200), 256).alias("e"))
    assert r.a == [0.5, 0.5] and r.b is None and r.c is None and tuple(r.d) == (512, 256) and tuple(r.e) == (426, 256)
    z = F.array(*[F.lit(math.log(p)) for p in (0.3, 0.25, 0.2, 0.15, 0.1)])
    r = one(spark, scores.ranked(z).alias("r"), scores.status(scores.ranked(z), 0.2999).alias("s"), scores.status(scores.ranked(F.array(*[F.lit(0.0)] * 5)), 0.3).alias("t"))
    assert [x["class"] for x in r.r][:3] == [0, 1, 2] and r.s == "CANDIDATES" and r.t == "LOW_CONFIDENCE"


def test_text_functions(spark):
    r = one(
        spark, text.human(F.lit("a\r\n b\t c ")).alias("a"), text.human(F.lit("a\x01b")).alias("b"), text.html_text(F.lit("<p>x &amp; <b>y</b></p>")).alias("c"), text.contains_name(F.lit("A Gadus morhua, big"), "gadus morhua").alias("d"),
        text.contains_name(F.lit("Gadus morhuaX"), "gadus morhua").alias("e"), text.is_safe_code(F.lit("CON")).alias("f"), text.is_safe_code(F.lit("COD_1")).alias("g"), text.is_safe_path(F.lit("images/A/b.jpg")).alias("h"),
        text.is_safe_path(F.lit("images/../b")).alias("i"), *[text.source_date(F.lit(x)).cast("string").alias(f"d{i}") for i, x in enumerate(("2024-02-03T10:00", "3.2.2024", "taken 3 February 2024", "soon", "2024-02-31"))],
        text.casefold(F.lit("Straße")).alias("j"), text.attribute(F.lit('<img alt="q" src="a?b&amp;c">'), "src").alias("k"), text.redacted(F.create_map(F.lit("api_token"), F.lit("x"), F.lit("n"), F.lit("1"))).alias("l"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == ("a b c", None, "x & y", True, False, False, True, True, False)
    assert [r.d0, r.d1, r.d2, r.d3, r.d4] == ["2024-02-03"] * 3 + [None, None] and r.j == "strasse" and r.k == "a?b&c" and r.l == {"api_token": "[REDACTED]", "n": "1"}


@pytest.mark.parametrize(("given", "want"), [("http://A.Example.org", "https://a.example.org/"), ("https://a.org/x?q=1#f", "https://a.org/x?q=1#f"), ("https://u@a.org/", None), ("https://localhost/", None), ("https://10.0.0.1/", None), ("ftp://a.org", None), ("https://a.invalid/", None), ("https://single/", None)])
def test_url_normalisation(spark, given, want):
    assert one(spark, urls.normalized(F.lit(given)).alias("u")).u == want


def test_url_parts(spark):
    u = F.lit("http://Host.org:443/p/a.JPG?utm_source=x&b=2&gclid=1&c=3#frag")
    r = one(spark, urls.canonical(u).alias("a"), urls.without_tracking(u).alias("b"), urls.image_suffix(u).alias("c"), urls.large_photo(F.lit("https://x.org/photos/7/square.jpg?1")).alias("d"), urls.host_allowed(F.lit("a.b.org"), [".b.org"]).alias("e"), urls.host_allowed(F.lit("xb.org"), [".b.org", "c.org"]).alias("f"))
    assert r.a == "https://host.org/p/a.JPG?utm_source=x&b=2&gclid=1&c=3" and r.b == "https://host.org:443/p/a.JPG?b=2&c=3" and (r.c, r.d, r.e, r.f) == (".jpg", "https://x.org/photos/7/large.jpg", True, False)


@pytest.mark.parametrize(("given", "want"), [("cc-by-nc", "CC-BY-NC"), ("https://creativecommons.org/licenses/by-sa/4.0/", "CC-BY-SA"), ("CC0", "CC0"), ("http://creativecommons.org/publicdomain/zero/1.0/", "CC0"), ("Public domain", "PUBLIC-DOMAIN"), ("CC BY-ND 2.0", "CC-BY-ND"), ("all rights reserved", ""), (None, ""), ("Photo by J. Smith", ""), ("used by permission", ""), ("attribution required", ""), ("not cc0 licensed", ""), ("CC BY 4.0 (International)", "CC-BY"), ("under cc-by-nc-sa-3.0", "CC-BY-NC-SA"), ("http://creativecommons.org/licenses/by/4.0/deed.de", "CC-BY")])
def test_licences(spark, given, want):
    r = one(spark, urls.licence(F.lit(given).cast("string")).alias("l"), urls.licence_allowed(F.lit(given).cast("string")).alias("ok"))
    assert r.l == want and r.ok == (want in urls.LICENCES)


def by_loop(rows, existing, valid):
    """The classification as a loop over rows."""
    seen, by_url, out = {}, {}, []
    old_identity = {}
    for r in existing:
        old_identity.setdefault(r[2], r[4])
    old_url = {}
    for r in existing:
        old_url.setdefault(r[3], set()).add(r[1])
    for row, category, identity, url, material in rows:
        if category not in valid:
            out.append((row, "INVALID_SPECIES", None))
        elif identity in seen:
            first = seen[identity]
            out.append((row, "EXACT_DUPLICATE", first[0]) if material == first[1] else (row, "CONFLICTING_SOURCE_IDENTITY", None))
        else:
            seen[identity] = (row, material)
            if identity in old_identity:
                out.append((row, "EXACT_DUPLICATE" if material == old_identity[identity] else "CONFLICTING_SOURCE_IDENTITY", None))
            elif url in old_url:
                out.append((row, "DUPLICATE_IMAGE_URL" if old_url[url] == {category} else "CONFLICTING_IMAGE_SPECIES", None))
            elif url in by_url:
                first = by_url[url]
                out.append((row, "DUPLICATE_IMAGE_URL" if category == first[1] else "CONFLICTING_IMAGE_SPECIES", first[0]))
            else:
                by_url[url] = (row, category)
                out.append((row, "NEW", None))
    return out


def test_classification_equals_the_loop(spark):
    r = random.Random(2)
    make = lambda n, start: [(start + i, r.choice("abcz"), f"i{r.randrange(25)}", r.randrange(12), f"m{r.randrange(3)}") for i in range(n)]
    rows, existing = make(160, 1000), [x for x in {e[2]: e for e in make(10, 0)}.values()]
    schema = "row long, category string, identity string, url long, material string"
    got = classify.classify(spark.createDataFrame(rows, schema), spark.createDataFrame(existing, schema), spark.createDataFrame([(c,) for c in "abc"], "category string"))
    want = by_loop(rows, existing, set("abc"))
    assert sorted((x.row, x.outcome, x.related_row) for x in got.collect()) == sorted(want)
    assert {o for _, o, _ in want} == {"NEW", "INVALID_SPECIES", "EXACT_DUPLICATE", "CONFLICTING_SOURCE_IDENTITY", "DUPLICATE_IMAGE_URL", "CONFLICTING_IMAGE_SPECIES"}


@pytest.mark.parametrize("seed", range(3))
def test_bounded_details_equal_the_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.random() < 0.4) for i in range(40)]
    kept, want = [], []
    for row, blocking in rows:
        if len(kept) < 12:
            kept.append((row, blocking))
        elif blocking and any(not b for _, b in kept):
            last = max(i for i, (_, b) in enumerate(kept) if not b)
            del kept[last]
            kept.append((row, blocking))
    want = sorted(kept)
    got = counts.bounded_details(spark.createDataFrame(rows, "row long, blocking boolean"), most=12)
    assert sorted((x.row, x.blocking) for x in got.collect()) == want


def test_chunks_end_at_rows_or_bytes(spark):
    df = spark.range(10).select("id", F.lit(10).alias("n"))
    take = lambda rows, size: counts.bounded_chunk(df, ["id"], F.col("n"), rows, size, header=5).count()
    assert (take(4, 1000), take(100, 35), take(100, 34), take(100, 5)) == (4, 3, 2, 0)


def test_delta_truth_table(spark):
    rows = []
    wanted, local = [], []
    for i, (desired, last, changed, moved, review) in enumerate(itertools.product((True, False), (None, "ADD", "REMOVE"), (True, False), (True, False), (True, False))):
        wanted.append((i, "N1", desired, 7))
        if last:
            local.append((i, last, "N2" if moved else "N1", 8 if review else 7, changed, ".jpg"))
        present = last == "ADD"
        action = None
        if desired:
            action = "ADD" if not present or changed else "MOVE" if moved else "ADD" if review else None
        elif present:
            action = "REMOVE"
        if action:
            suffix = ".jpg" if last else ".image"
            previous = f"images/{'N2' if moved else 'N1'}/{i}{suffix}" if action in ("MOVE", "REMOVE") or (present and changed) else None
            rows.append((i, action, f"_removed/{i}{suffix}" if action == "REMOVE" else f"images/N1/{i}{suffix}", previous))
    got = sync.deltas(spark.createDataFrame(wanted, "item_id long, code string, desired boolean, review_id long"), spark.createDataFrame(local, "item_id long, action string, local_code string, review_id long, original_changed boolean, suffix string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)


def test_receipts_are_applied_once(spark):
    stored = spark.createDataFrame([(1, "PENDING", None, None), (2, "PENDING", None, None), (3, "SUCCEEDED", "x", None)], "k long, status string, sha256 string, error string")
    payload = spark.createDataFrame([(1, "SUCCEEDED", "a"), (2, "FAILED", None), (3, "SUCCEEDED", "x")], "k long, status string, sha256 string")
    done = sync.apply_receipt(stored, payload, ["k"])
    want = [(1, "SUCCEEDED", "a", None), (2, "PENDING", None, "SYNC_FAILED"), (3, "SUCCEEDED", "x", None)]
    assert sorted(tuple(r) for r in done.collect()) == want
    assert sorted(tuple(r) for r in sync.apply_receipt(done, payload, ["k"]).collect()) == want
    bad = spark.createDataFrame([(3, "FAILED", None), (3, "SUCCEEDED", "y"), (9, "SUCCEEDED", "z")], "k long, status string, sha256 string")
    assert {r.problem: r.n for r in sync.receipt_problems(stored, bad, ["k"]).collect()} == {"REPEATED": 1, "UNKNOWN": 1, "CHANGED_SUCCESS": 1, "FAILED_AFTER_SUCCESS": 1}


def test_canonical_merge_fences_generations(spark):
    canonical = spark.createDataFrame([(i, 5, "p") for i in range(1, 7)], "item_id long, version long, path string")
    ops = spark.createDataFrame([(1, 4, "ADD", "q"), (2, 5, "ADD", "p"), (3, 5, "ADD", "q"), (4, 6, "REMOVE", None), (5, 6, "ADD", "q"), (9, 1, "ADD", "n"), (2 + 100, 3, "REMOVE", None)], "item_id long, version long, action string, path string")
    got = {r.item_id: (r.version, r.path, r.outcome) for r in sync.canonical_merge(canonical, ops, ["path"]).collect()}
    assert got == {1: (5, "p", "SKIPPED"), 2: (5, "p", "REPEATED"), 3: (5, "p", "CONFLICT"), 4: (6, None, "REMOVED"), 5: (6, "q", "REPLACED"), 6: (5, "p", "UNCHANGED"), 9: (1, "n", "ADDED"), 102: (3, None, "REMOVED")}


def test_resume_keeps_progress_where_identity_agrees(spark):
    rows = spark.createDataFrame([(1, "a", None, None), (2, "b", None, None)], "k long, i string, j string, done string")
    old = spark.createDataFrame([(1, "a", None, "yes"), (2, "c", None, "yes")], "k long, i string, j string, done string")
    assert {r.k: r.done for r in latest.carry_forward(rows, old, "k", ["i", "j"], ["done"]).collect()} == {1: "yes", 2: None}


def test_metrics_of_a_small_confusion(spark):
    df = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.4), (1, 1, 0.8), (1, 1, 0.6)], "label int, predicted int, confidence double")
    got = {r["class"]: r for r in metrics.by_class(df).collect()}
    assert got[0].precision == 1 and got[0].recall == 0.5 and got[1].precision == pytest.approx(2 / 3) and got[1].recall == 1
    swept = metrics.sweep(df, [0.5, 0.7])
    assert [(r.n_above, r.coverage, r.precision) for r in swept.orderBy("threshold").collect()] == [(3, 0.75, 1.0), (2, 0.5, 1.0)]
    assert metrics.recommended(swept).first().threshold == 0.5
    weights = metrics.class_weights(spark.createDataFrame([(0, 52), (1, 101)], "class int, n long")).collect()
    assert sum(r.weight for r in weights) == pytest.approx(2) and weights[0].weight / weights[1].weight == pytest.approx(math.sqrt(101 / 52))
    a = spark.createDataFrame([(1, [0.1, 0.9])], "k int, z array<double>")
    b = spark.createDataFrame([(1, [0.15, 0.85])], "k int, z array<double>")
    r = metrics.parity(a, b, "k", "z").first()
    assert r.error == pytest.approx(0.05) and r.same_order


def test_export_files_are_read_as_a_whole_or_not_at_all(spark, tmp_path):
    uuid = "00000000-0000-0000-0000-00000000000{}"
    row = lambda i, **k: {"batch_id": uuid.format(9), "candidate_id": uuid.format(i), "review_id": uuid.format(i), "receipt_token": "t" * 24, "action": "ADD", "review_version": "1", "species_code": "COD", "target_relative_path": f"images/COD/{uuid.format(i)}.jpg", "image_origin_allowlist": '["a.org"]', "preview_url": "https://a.org/1.jpg", "original_url": "HTTPS://A.org/2?x", "source_url": "https://b.org", "license": "CC0", "attribution": 'says "hi",\nand more'} | k

    def write(name, rows, columns=manifests.EXPORT):
        quote = lambda v: '"' + v.replace('"', '""') + '"'
        (tmp_path / name).write_text("\r\n".join([",".join(columns), *[",".join(quote(r.get(c, "")) for c in columns) for r in rows]]) + "\r\n", encoding="utf-8-sig")
        return str(tmp_path / name)

    good = manifests.load_export(spark, write("good.csv", [row(1), row(2)]))
    assert good.count() == 2 and good.first()["attribution"].startswith('says "hi",\n')
    for name, rows, columns, code in (("a.csv", [row(1), row(1)], manifests.EXPORT, "REPEATED"), ("b.csv", [row(1, action="DROP")], manifests.EXPORT, "BAD_ACTION"), ("c.csv", [row(1)], manifests.EXPORT[::-1], "HEADER_ORDER"), ("d.csv", [row(1), row(2, receipt_token="u" * 24)], manifests.EXPORT, "MIXED_BATCH")):
        with pytest.raises(manifests.BadFile, match=code):
            manifests.load_export(spark, write(name, rows, columns))
    broken = {"BAD_PATH": {"target_relative_path": "images/../x.jpg"}, "BAD_SHAPE": {"action": "MOVE"}, "BAD_CODE": {"species_code": "NUL"}, "BAD_URL": {"preview_url": "https://other.org/a"}, "BAD_VERSION": {"review_version": "9223372036854775808"}, "BAD_TEXT": {"license": " "}, "TOO_LONG": {"creator": "x" * 4097}, "BAD_HOSTS": {"image_origin_allowlist": "[]"}}
    rows = spark.createDataFrame([(k, *[row(1, **c).get(x, "") for x in manifests.EXPORT]) for k, c in broken.items()], ", ".join(f"{x} string" for x in ("code", *manifests.EXPORT)))
    assert all(r.code in r.found for r in rows.select("code", manifests.export_problems(rows).alias("found")).collect())
    body = (tmp_path / "good.csv").read_bytes()
    for name, raw, code in (("q", body + b'a"b,', "QUOTE_IN_FIELD in record 4"), ("t", body + b"a,b\n", "RAGGED in record 4"), ("u", body + b"\xff", "BAD_ENCODING"), ("v", body + b"x" * manifests.EXPORT_BYTES, "FILE_TOO_LARGE")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(manifests.BadFile, match=code):
            manifests.load_export(spark, str(tmp_path / name))
    lenient = manifests.read_manifest(spark, write("m.csv", [{"image_id": "x", "extra": "y"}], ["image_id", "extra"]))
    assert lenient.columns == list(manifests.MANIFEST) and lenient.first()["image_id"] == "x" and lenient.first()["status"] == ""
    assert manifests.read_manifest(spark, str(tmp_path / "none.csv")).count() == 0


def test_receipt_files_are_bounded_before_they_are_parsed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifests, "RECEIPT_BYTES", 3000)
    monkeypatch.setattr(manifests, "RECEIPT_ITEMS", 3)
    item = {"candidate_id": "1", "status": "SUCCEEDED", "sha256": "a", "relative_path": "p ]]]]]]]]]]"}
    bodies = {
        "good": json.dumps({"batch_id": "b", "items": [item, {"status": "FAILED", "error": "\\"}]}), "bom": "\ufeff" + json.dumps({"batch_id": "b", "items": []}), "large": json.dumps({"batch_id": "b" * 3000, "items": []}),
        "deep": '{"batch_id": "b", "items": ' + "[" * 9 + "]" * 9 + "}", "many": json.dumps({"batch_id": "b", "items": [item] * 4}), "key": json.dumps({"batch_id": "b", "items": [], "more": 1}), "inner": json.dumps({"batch_id": "b", "items": [item | {"x": 1}]}),
        "open": '{"batch_id": "b", "items": [', "none": "", "list": "[]",
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body.encode())
    (tmp_path / "bytes").write_bytes(b'{"batch_id": "\xff", "items": []}')
    report, items = manifests.receipt_files(spark, str(tmp_path))
    got = {x.file.rsplit("/", 1)[1]: (x.problem, x.n_items) for x in report.collect()}
    codes = {"large": "BODY_TOO_LARGE", "deep": "TOO_DEEP", "many": "TOO_MANY_ITEMS", "key": "UNKNOWN_KEY", "inner": "UNKNOWN_KEY", "open": "BAD_JSON", "list": "BAD_JSON", "bytes": "BAD_ENCODING"}
    assert got == {k: (c, None) for k, c in codes.items()} | {"good": (None, 2), "bom": (None, 0)}  # an empty file has no rows
    assert {x.file.rsplit("/", 1)[1]: x.sha256 for x in report.collect()} == {k: None if k == "large" else hashlib.sha256((tmp_path / k).read_bytes()).hexdigest() for k in got}
    assert [(x.position, x.relative_path, x.problem) for x in items.orderBy("position").collect()] == [(0, item["relative_path"], None), (1, None, None)]


def test_receipts_and_configurations(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"batch_id": "b", "items": [{"candidate_id": "1", "status": "SUCCEEDED", "sha256": "a", "relative_path": "p"}, {"candidate_id": "2", "status": "FAILED", "sha256": "a", "error": "e"}, {"candidate_id": "3", "status": "?"}]}))
    items = manifests.read_receipt(spark, str(tmp_path / "r.json"))
    assert [r.problem for r in items.orderBy("position").collect()] == [None, "BAD_FAILURE", "BAD_STATUS"]
    assert json.loads(manifests.receipt_json(items).first().value)["items"][1]["candidate_id"] == "2"
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 2, "species": [{"seafood_code": "COD", "scientific_name": "Gadus morhua"}]}))
    r = manifests.read_config(spark, str(tmp_path / "c.json")).first()
    assert r.commons_category == "Category:Gadus morhua" and r.fish_vista_filter == "Gadus morhua"
    (tmp_path / "d.json").write_text(json.dumps({"schema_version": 1, "species": []}))
    with pytest.raises(manifests.BadFile):
        manifests.read_config(spark, str(tmp_path / "d.json"))


def parsed(spark, parser, schema, records, *more):
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))
    return parser(df, "COD", "Gadus morhua", *more).collect()


def test_source_parsers(spark):
    rows = parsed(spark, parsers.inat, parsers.INAT, [{"id": 1, "uri": "u", "taxon": {"name": "Gadus morhua"}, "photos": [{"id": 5, "url": "https://x.org/5/square.jpg", "license_code": "cc-by"}, {"id": 6, "url": "https://x.org/6/square.jpg"}]}, {"id": 2, "taxon": {"name": "Other"}, "photos": [{"id": 7, "url": "v", "license_code": "cc0"}]}])
    assert [(r.source_record_id, r.image_url, r.license) for r in rows] == [("obs:1/photo:5", "https://x.org/5/large.jpg", "CC-BY")]
    assert rows[0].image_id.startswith("COD-") and len(rows[0].image_id) == 20
    rows = parsed(spark, parsers.gbif, parsers.GBIF, [{"key": 3, "species": "Gadus morhua L.", "media": [{"identifier": "https://a.org/1.jpg", "license": "http://creativecommons.org/licenses/by/4.0/"}, {"type": "Sound", "identifier": "s", "license": "cc0"}]}])
    assert [(r.source_record_id, r.source_taxon_match) for r in rows] == [("occ:3/media:https://a.org/1.jpg", "EXACT")]
    rows = parsed(spark, parsers.commons, parsers.COMMONS, [{"pageid": 4, "imageinfo": [{"mime": "image/jpeg", "url": "https://c.org/x.jpg", "extmetadata": {"LicenseShortName": {"value": "CC BY-SA 4.0"}, "Artist": {"value": "<b>A &amp; B</b>"}}}]}])
    assert [(r.license, r.creator) for r in rows] == [("CC-BY-SA", "A & B")]
    rows = parsed(spark, parsers.ala, parsers.ALA, [{"uuid": "u", "scientificName": "gadus  Morhua", "license": "CC-BY", "images": ["i", "j"], "imageUrl": "https://d.org/i", "recordedBy": ["P", "Q"], "eventDate": 0}], "https://proxy/")
    assert [(r.image_url, r.creator, r.source_date) for r in rows] == [("https://d.org/i", "P, Q", "1970-01-01"), ("https://proxy/j", "P, Q", "1970-01-01")]
    rows = parsed(spark, parsers.obis, parsers.OBIS, [{"id": "o", "scientificName": "Gadus morhua", "license": "CC0", "associatedMedia": "https://e.org/1.jpg|http://e.org/2.jpg;https://e.org/3.jpg"}])
    assert [r.source_record_id for r in rows] == ["occ:o/media:1", "occ:o/media:2"]
    rows = parsed(spark, parsers.smithsonian, parsers.SMITHSONIAN, [{"id": "s", "content": {"indexedStructured": {"scientific_name": ["Gadus morhua"]}, "descriptiveNonRepeating": {"online_media": {"media": [{"type": "Images", "content": "https://f.org/1", "usage": {"access": "CC0"}}, {"type": "Images", "content": "https://f.org/2", "usage": {"access": "other"}}]}}}}])
    assert [r.image_url for r in rows] == ["https://f.org/1"]
    rows = parsed(spark, parsers.vista, parsers.VISTA, [{"standardized_species": "gadus morhua", "license": "CC BY", "file_name": "f", "original_url": "https://g.org/f.jpg", "arkid": ""}])
    assert [r.source_record_id for r in rows] == ["f"]


def test_rows_of_sources_have_every_manifest_column(spark):
    def row(parser, schema, record, *more, n=0):
        rows = [x.asDict() for x in parsed(spark, parser, schema, [record], *more, "Cod")]
        assert all(tuple(x) == manifests.MANIFEST for x in rows)
        x = rows[n]
        blank = {c: "" for c in manifests.MANIFEST} | {"seafood_code": "COD", "app_label": "Cod", "scientific_name": "Gadus morhua", "image_context": "REVIEW", "whole_fish": "REVIEW", "exact_species_verified": "REVIEW", "split": "UNASSIGNED", "status": "CANDIDATE"}
        digest = hashlib.sha256(f"COD|{x['source_dataset']}|{x['source_record_id']}".encode()).hexdigest()[:16]
        assert x["image_id"] == f"COD-{digest}"
        return {k: v for k, v in x.items() if v != blank[k] and k != "image_id"}

    name = "Gadus  MORHUA"
    assert row(parsers.inat, parsers.INAT, {"id": 1, "taxon": {"name": name}, "quality_grade": "research", "place_guess": "P", "time_observed_at": "2020-01-02T03:04", "user": {"login": "u"}, "photos": [{"id": 2, "url": "https://x.org/2/medium.jpg?1", "license": "CC0"}]}) == {
        "source_dataset": "INATURALIST", "source_record_id": "obs:1/photo:2", "source_taxon_match": "EXACT", "source_url": "https://www.inaturalist.org/observations/1", "image_url": "https://x.org/2/large.jpg?1", "creator": "u", "license": "CC0", "source_observation_quality": "research",
        "source_location": "P", "source_date": "2020-01-02T03:04", "original_group_id": "INATURALIST-OBS-1",
    }
    assert row(parsers.gbif, parsers.GBIF, {"key": 3, "scientificName": "Other", "basisOfRecord": "B", "countryCode": "NO", "stateProvince": "S", "year": 1999, "media": [{"type": "Still Image", "references": "https://r.org/1", "title": "T <i>x</i>", "license": "cc-by-nc"}]}) == {
        "source_dataset": "GBIF", "source_record_id": "occ:3/media:T <i>x</i>", "source_taxon_match": "QUERY_TAXON", "source_url": "https://www.gbif.org/occurrence/3", "image_url": "https://r.org/1", "license": "CC-BY-NC", "license_url": "cc-by-nc", "attribution": "T x", "source_observation_quality": "B",
        "source_country": "NO", "source_location": "S", "source_date": "1999", "original_group_id": "GBIF-OCC-3",
    }
    meta = {k: {"value": v} for k, v in {"UsageTerms": "CC BY-SA", "LicenseUrl": "https://l.org", "Attribution": "by <b>A</b>", "DateTime": "2001"}.items()}
    assert row(parsers.commons, parsers.COMMONS, {"pageid": 4, "title": "File:A b*~é.jpg", "imageinfo": [{"url": "https://c.org/x.jpg", "extmetadata": meta}]}) == {
        "source_dataset": "WIKIMEDIA_COMMONS", "source_record_id": "page:4:File:A b*~é.jpg", "source_taxon_match": "EXACT_CATEGORY", "source_url": "https://commons.wikimedia.org/wiki/File%3AA_b%2A~%C3%A9.jpg", "image_url": "https://c.org/x.jpg", "license": "CC-BY-SA", "license_url": "https://l.org",
        "attribution": "by A", "source_date": "2001", "original_group_id": "COMMONS-PAGE-4",
    }
    assert row(parsers.ala, parsers.ALA, {"id": " k ", "scientificName": name, "license": "CC-BY", "imageUrl": "https://d.org/i", "recordedBy": ["P <b>Q</b>", " ", "R"], "basisOfRecord": "B", "country": "AU", "locality": "L", "eventDate": 86400000000}, "https://proxy/") == {
        "source_dataset": "ATLAS_OF_LIVING_AUSTRALIA", "source_record_id": "occ:k/image:primary", "source_taxon_match": "EXACT", "source_url": "https://biocache.ala.org.au/occurrences/k", "image_url": "https://d.org/i", "creator": "P Q, R", "license": "CC-BY", "license_url": "CC-BY", "attribution": "P Q, R",
        "source_observation_quality": "B", "source_country": "AU", "source_location": "L", "source_date": "1972-09-27", "original_group_id": "ALA-OCC-k",
    }
    assert row(parsers.obis, parsers.OBIS, {"occurrenceID": "o", "scientificName": name, "license": "CC0", "associatedMedia": ["http://e.org/0", " https://e.org/1"], "recordedBy": "W", "eventDate": "May 2001", "references": "https://f.org"}) == {
        "source_dataset": "OBIS", "source_record_id": "occ:o/media:1", "source_taxon_match": "EXACT", "source_url": "https://f.org", "image_url": "https://e.org/1", "creator": "W", "license": "CC0", "license_url": "CC0", "attribution": "W", "source_date": "May 2001", "original_group_id": "OBIS-OCC-o",
    }
    media = [{"type": "sound", "content": "https://f.org/0", "usage": {"access": "CC0"}}, {"type": "Image", "guid": "g", "content": " https://f.org/1", "usage": {"access": "cc0"}}]
    assert row(parsers.smithsonian, parsers.SMITHSONIAN, {"id": "s", "content": {"indexedStructured": {"scientific_name": ["Other", name]}, "descriptiveNonRepeating": {"record_link": "http://r.org", "online_media": {"media": media}}}}) == {
        "source_dataset": "SMITHSONIAN_OPEN_ACCESS", "source_record_id": "record:s/media:g", "source_taxon_match": "EXACT", "source_url": "https://r.org", "image_url": "https://f.org/1", "creator": "Smithsonian Institution", "license": "CC0", "license_url": "https://creativecommons.org/publicdomain/zero/1.0/",
        "attribution": "Smithsonian Institution", "source_observation_quality": "MUSEUM_COLLECTION", "original_group_id": "SMITHSONIAN-RECORD-s", "image_context": "MUSEUM",
    }
    splits = parsers.vista_splits({k: spark.createDataFrame([(name, "CC BY", f"{k}/a b.jpg", "me")], "standardized_species string, license string, file_name string, source string") for k in ("train", "val", "test")})
    full = spark.createDataFrame([], parsers.VISTA).unionByName(splits, allowMissingColumns=True)
    got = {x.source_split: x for x in parsers.vista(full, "COD", "Gadus morhua", "https://repo/", "Cod").collect()}
    assert sorted(got) == ["test", "train", "val"] and tuple(got["val"].asDict()) == manifests.MANIFEST
    assert (got["val"].image_url, got["val"].source_record_id, got["val"].attribution, got["val"].original_group_id, got["val"].image_context) == ("https://repo/val/a%20b.jpg?download=true", "val/a b.jpg", "me", "FISH-VISTA-val/a b.jpg", "MUSEUM")


def test_photo_pages(spark):
    block = """<div class='ngdl-photo ngdl-photo--list' data-photo-modal-id="7" id="photo-%s">
      <a href="/photos/item?q=a&amp;page=0"><div class="c-field c-field--name-media-ngdl-photo">
        <img %s src="/small.jpg" /></div></a>
      <a class="media-download-link" href="%s">Download</a></div>"""
    page = "<html><div id='top'>" + "".join(
        block % x
        for x in (
            ("1", 'title="A cod (Gadus morhua) (Image credit: NOAA/NMFS/SEFSC)" alt="A cod"', "/media/photo-1"),
            ("2", 'title="A cod (Gadus morhua) (Image credit: Courtesy of NOAA friends)"', "/media/photo-2"),
            ("3", 'title="A cod (Gadus morhuae) (Image credit: NOAA)"', "/media/photo-3"),
            ("4", 'alt="Gadus morhua (Image credit: PIFSC)"', "https://h.org/full.jpg"),
            ("5", 'title="Gadus morhua"', "/media/photo-5"),
            ("6", 'title="Gadus morhua (Image credit: NOAA)"', "http://h.org/plain.jpg"),
        )
    )
    rows = parsers.noaa(spark.createDataFrame([(page,)], "html string"), "COD", "Gadus morhua").collect()
    assert [(r.source_record_id, r.image_url, r.creator, r.license, r.source_dataset) for r in rows] == [
        ("photo:photo-1", "https://www.noaa.gov/media/photo-1", "NOAA/NMFS/SEFSC", "PUBLIC-DOMAIN", "NOAA_PHOTO_LIBRARY"),
        ("photo:photo-4", "https://h.org/full.jpg", "PIFSC", "PUBLIC-DOMAIN", "NOAA_PHOTO_LIBRARY"),
    ]
    assert rows[0].source_url == "https://www.noaa.gov/photos/item?q=a&page=0"


def test_failure_limiter_locks_and_clears(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    seconds = [(0, "f"), (10, "f"), (20, "f"), (30, "f"), (40, "f"), (50, "f"), (55, "s"), (60, "f"), (1000, "f")]
    rows = [(1, start + timedelta(seconds=t), i, k == "f", k == "s") for i, (t, k) in enumerate(seconds)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, failure boolean, success boolean")
    got = [(r.seq, r.streak, r.locked) for r in sync.failure_locks(df, "300 SECONDS").orderBy("seq").collect()]
    assert got == [(0, 1, False), (1, 2, False), (2, 3, False), (3, 4, False), (4, 5, True), (5, 6, True), (7, 1, False), (8, 1, False)]


def test_replays_within_the_watermark_are_dropped(spark, tmp_path):
    from datetime import datetime

    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 1))], "id long, ts timestamp").write.parquet(folder)
    stream = limiter.deduplicated(spark.readStream.schema("id long, ts timestamp").parquet(folder), ["id"], "ts", "1 minute")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_quota_is_filled_source_by_source(spark):
    rows = [(i, "g", "a" if i % 3 == 0 else "b") for i in range(12)] + [(50, "h", "b"), (51, "h", "c")]
    df = spark.createDataFrame(rows, "row long, category string, source string")
    got = counts.quota_fill(df, "category", "source", "row", ["a", "b"], 6)
    assert sorted((r.category, r.row) for r in got.collect()) == [("g", 0), ("g", 1), ("g", 2), ("g", 3), ("g", 6), ("g", 9), ("h", 50)]
    groups = spark.createDataFrame([("g",), ("h",), ("i",)], "category string")
    assert {r.category: r.missing for r in counts.shortfall(got, groups, "category", 6).collect()} == {"g": 0, "h": 5, "i": 6}


def test_entry_and_registry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1
