"""The block-wise CSV reader against character-by-character and library readers, whatever the blocks' size."""

import csv
import io
import random

import pytest

from siltstone.sources import strict_csv
from siltstone.sources.strict_csv import Dialect


def plain(raw: bytes, rfc: bool, most: int):
    """Records before the first error, the error and its record."""
    text = raw.decode("utf-8-sig")
    records, fields, now, state, i = [], [], "", "row", 0
    bad = lambda code: (records, code, len(records) + 1)
    while i < len(text):
        c = text[i]
        i += 1
        if state in ("start", "row") and c == '"':
            state = "quoted"
        elif state == "quoted" and c != '"':
            now += c
        elif state == "quoted":
            state = "after"
        elif state == "after" and c == '"':
            now, state = now + c, "quoted"
        elif c == ",":
            fields, now, state = [*fields, now], "", "start"
        elif c in "\r\n":
            if c == "\r" and text[i : i + 1] == "\n":
                i += 1
            elif c == "\r" and rfc:
                return bad("BARE_CR")
            records.append([] if state == "row" else [*fields, now])
            fields, now, state = [], "", "row"
        elif state == "after":
            return bad("AFTER_QUOTE")
        elif c == '"' and rfc:
            return bad("QUOTE_IN_FIELD")
        else:
            now, state = now + c, "field"
        if len(now) > most:
            return bad("LONG_FIELD")
    if state == "quoted":
        return bad("OPEN_QUOTE")
    if state != "row":
        records.append([*fields, now])
    return records, None, None


def texts(many: int, longest: int):
    r = random.Random(4)
    out = [b"", b"\n", b"\r\n", b"a", b'"', b'""', b'"a', b'a,"b\nc",d\r\n', b"\xef\xbb\xbfa,b\n1,2", b"a\rb", b"a\r", b'"x"\r', b'"a"b\n', b'a"b\n', b'x,"' + b"l\n" * 60 + b'"\ny\n', b'"' + b"q" * 40 + b'"\n' + b"q" * 41 + b"\nz\n", "é,ß\n".encode(), b"\n\na\n\n", b'"a\rb"\rc\nd']
    for kind in range(many):
        n = r.choice([5, 30, longest])
        if kind % 2:  # mostly sound
            rows = [[r.choice(["", "a", "bé", 'q"', "x\ny", "c\r\nd", "\re", ",", "word " * 3]) for _ in range(r.choice([1, 2, 3]))] for _ in range(n // 3)]
            text = r.choice(["\n", "\r\n"]).join(",".join('"' + f.replace('"', '""') + '"' if set(f) & set('",\r\n') or r.random() < 0.2 else f for f in x) for x in rows)
            if r.random() < 0.5:
                at = r.randrange(len(text) + 1)
                text = text[:at] + r.choice(['"', "\r", '"\n', "x"]) + text[at:]
        else:
            text = "".join(r.choice('aé,,""\r\n\n') for _ in range(n))
        out.append(text.encode())
    return out


@pytest.mark.parametrize("size,run", [(9, 1024), (33, 2), (None, 1024)])
@pytest.mark.parametrize("rfc", [False, True])
def test_any_block_size_gives_the_plain_result(spark, tmp_path, monkeypatch, size, run, rfc):
    monkeypatch.setattr(strict_csv, "RUN", run)
    if run == 2:
        monkeypatch.setattr(strict_csv, "BROADCAST_BLOCKS", 0)
    most, said = 40, texts(16, 60) if size else texts(250, 200)
    for i, t in enumerate(said):
        (tmp_path / f"{i:04d}.csv").write_bytes(t)
    got = strict_csv.read(spark, str(tmp_path), Dialect(rfc, most), size)
    files = {int(r["file"][-8:-4]): r for r in got.files.collect()}
    records = {}
    for r in got.records.collect():
        assert records.setdefault(int(r["file"][-8:-4]), {}).setdefault(r["record"], r["fields"]) is r["fields"]
    assert sorted(files) == list(range(len(said)))
    for i, t in enumerate(said):
        want, error, at = plain(t, rfc, most)
        f = files[i]
        assert (f["records"], f["error"], f["error_record"], f["size"], f["newlines"], f["valid"]) == (len(want), error, at, len(t), t.count(b"\n"), True), t
        assert [records.get(i, {}).get(n + 1) for n in range(len(want))] == want, t
        assert len(records.get(i, {})) == len(want), t
        if not rfc:  # the library stops at the same place
            csv.field_size_limit(most)
            rows = []
            try:
                rows.extend(iter(csv.reader(io.StringIO(t.decode("utf-8-sig"), newline=""), strict=True)))
                assert error is None, t
            except csv.Error:
                assert error is not None, t
            finally:
                csv.field_size_limit(131_072)
            assert rows == want, t


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n\xff,1\n")
    got = strict_csv.read(spark, str(tmp_path))
    assert got.files.first()["valid"] is False and got.records.count() == 0
