"""CSV files judged and read in blocks, as a strict reader would do it from their first byte.

A task scans a block (a split of a file, cut after a line end) without knowing whether it begins inside a quoted field, so
it scans twice: as if outside and as if inside. What a block does when entered either way is a small summary, and summaries
compose: in runs of ``RUN`` blocks, then over the runs of a file. That gives each block its state and its first record's
number, and each file its first error. A second scan parses every block with what it is entered with; records that cross
blocks are put together by record number. A file of any size is read by as many tasks as it has blocks, and the result
doesn't depend on where they are cut.

Records end with CRLF, LF or, unless ``rfc``, a bare CR. Errors, at the first of which a file's records end: OPEN_QUOTE,
AFTER_QUOTE (text after a closing quote), LONG_FIELD, and with ``rfc`` QUOTE_IN_FIELD and BARE_CR.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.scratch import written

OUT, IN = 0, 1
#: Blocks that one task composes.
RUN = 1024
#: Blocks whose starts are broadcast.
BROADCAST_BLOCKS = 100_000
#: Lines parsed together.
_CHUNK = 2048


@dataclass(frozen=True)
class Dialect:
    rfc: bool = False
    """Whether quotes inside unquoted fields and bare CRs are errors."""
    field_chars: int = 131_072


@dataclass(frozen=True)
class Effect:
    """What text does that is entered in one state: where it ends, records that end in it, its first error after ``at`` records.

    head: characters of the field that it is entered in; closed: whether that field ends in it; tail: of the field open at its end.
    """

    end: int
    records: int = 0
    head: int = 0
    closed: bool = False
    tail: int = 0
    error: str | None = None
    at: int = 0

    def then(self, outside: Effect, inside: Effect, most: int) -> Effect:
        """This, then text with these effects."""
        if self.error:
            return self
        if self.end == OUT:
            return replace(outside, records=self.records + outside.records, at=self.records + outside.at, head=self.head, closed=self.closed)
        n = self.records
        if self.tail + inside.head > most:
            return replace(self, error="LONG_FIELD", at=n)
        head, closed = (self.head, True) if self.closed else (self.tail + inside.head, inside.closed)
        tail = inside.tail if inside.closed else self.tail + inside.head
        return replace(inside, records=n + inside.records, at=n + inside.at, head=head, closed=closed, tail=tail)


class Scanner:
    """Takes a file's lines one by one from a known state."""

    def __init__(self, dialect: Dialect, state: int, carried: int = 0) -> None:
        self.dialect, self.entered, self.state = dialect, state, state
        self.records, self.field, self.error, self.at = 0, carried, None, 0
        self.closed, self.head = state == OUT, 0
        self._stop = re.compile(rb'[,\r"]' if dialect.rfc else rb"[,\r]")
        #: Of the last line: where its first and last record end.
        self.first, self.last = -1, -1

    def effect(self) -> Effect:
        return Effect(self.state, self.records, self.head if self.closed else self.field, self.closed, self.field if self.state == IN else 0, self.error, self.at)

    def _fail(self, code: str) -> None:
        self.error, self.at = code, self.records

    def _grow(self, some: bytes) -> None:
        self.field += len(some) if some.isascii() else len(some.decode(errors="replace"))
        if self.field > self.dialect.field_chars:
            self._fail("LONG_FIELD")

    def _close(self) -> None:
        if not self.closed:
            self.closed, self.head = True, self.field
        self.field = 0

    def _record(self, at: int) -> None:
        self.records += 1
        self.state, self.last = OUT, at
        if self.first < 0:
            self.first = at

    def line(self, raw: bytes) -> None:
        """``raw`` without its LF."""
        if self.error:
            return
        self.first = self.last = -1
        size = len(raw)
        if self.state == OUT and b'"' not in raw and size <= self.dialect.field_chars and raw.find(b"\r", 0, size - 1) < 0:
            return self._record(size)
        at, quoted = 0, self.state == IN
        while not self.error:
            if not quoted and raw[at : at + 1] == b'"':
                at, quoted = at + 1, True
            if quoted:
                self.state = IN
                end = raw.find(b'"', at)
                self._grow(raw[at:] + b"\n" if end < 0 else raw[at:end])
                if self.error or end < 0:
                    return
                after = raw[end + 1 : end + 2]
                if after == b'"':
                    self._grow(b'"')
                    at = end + 2
                    continue
                if after not in (b"", b",", b"\r"):
                    return self._fail("AFTER_QUOTE")
                self._close()
                quoted, stop = False, end + 1
            else:
                found = self._stop.search(raw, at)
                stop = found.start() if found else size
                self._grow(raw[at:stop])
                if self.error:
                    return
                if raw[stop : stop + 1] == b'"':
                    return self._fail("QUOTE_IN_FIELD")
                self._close()
            at = stop + 1
            if stop >= size - (raw[stop : stop + 1] == b"\r"):
                return self._record(size)
            if raw[stop : stop + 1] == b"\r":
                if self.dialect.rfc:
                    return self._fail("BARE_CR")
                self._record(at)


def _text(spark: SparkSession, path: str, block_bytes: int | None) -> DataFrame:
    """Physical lines, cut into blocks of at most so many bytes and a line, or of Spark's own size."""
    if block_bytes:
        spark = spark.newSession()  # its setting must not cut other tables
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block_bytes))
    return spark.read.option("lineSep", "\n").text(path)


def _lines(text: DataFrame) -> DataFrame:
    """Lines with their file and block, in order within a block."""
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, pa.RecordBatch, bytes]]:
    """Key, row and batch of each line, and the line."""
    for b in batches:
        keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        for i, (k, raw) in enumerate(zip(keys, b.column(2), strict=True)):
            yield k, i, b, raw.as_py()


_EFFECT = "struct<end:int,records:bigint,head:bigint,closed:boolean,tail:bigint,error:string,at:bigint>"
_EFFECT_ARROW = pa.struct([("end", pa.int32()), ("records", pa.int64()), ("head", pa.int64()), ("closed", pa.bool_()), ("tail", pa.int64()), ("error", pa.string()), ("at", pa.int64())])
_BLOCK = f"file string, block long, bytes long, lines long, valid boolean, cr boolean, outside {_EFFECT}, inside {_EFFECT}"


def blocks(text: DataFrame, dialect: Dialect) -> DataFrame:
    """A row for each block: bytes and lines, whether it is UTF-8, whether its last line ends with CR, and its two effects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, lines, valid, raw, both = None, 0, 0, True, b"", None

        def row() -> pa.RecordBatch:
            values = [[now[0]], [now[1]], [size], [lines], [valid], [raw.endswith(b"\r")], *([asdict(x.effect())] for x in both)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), _EFFECT_ARROW, _EFFECT_ARROW), strict=True)], names=["file", "block", "bytes", "lines", "valid", "cr", "outside", "inside"])

        for key, _, _, line in _in_blocks(batches):
            if key != now:
                if now:
                    yield row()
                now, size, lines, valid, both = key, 0, 0, True, (Scanner(dialect, OUT), Scanner(dialect, IN))
            raw = line
            size, lines = size + len(raw) + 1, lines + 1
            if valid and not raw.isascii():
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    valid = False
            for x in both:
                x.line(raw)
        if now:
            yield row()

    return _lines(text).mapInArrow(run, _BLOCK)


def _effects(table: pa.Table, name: str) -> list[Effect]:
    return [Effect(**x) for x in table.column(name).to_pylist()]


def _runs(blocks_: DataFrame, dialect: Dialect) -> DataFrame:
    """blocks_ (with ``run``) composed: a row for each run, with the columns of a block."""

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        both = [None, None]
        for o, i in zip(_effects(table, "outside"), _effects(table, "inside"), strict=True):
            both = [x.then(o, i, dialect.field_chars) if x else first for x, first in zip(both, (o, i), strict=True)]
        last = table.num_rows - 1
        total = lambda c: sum(table.column(c).to_pylist())
        values = [table.column("file")[0].as_py(), table.column("block")[0].as_py(), total("bytes"), total("lines"), all(table.column("valid").to_pylist()), table.column("cr")[last].as_py(), *map(asdict, both)]
        return pa.table({c: pa.array([v], t) for c, v, t in zip(("file", "block", "bytes", "lines", "valid", "cr", "outside", "inside"), values, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), _EFFECT_ARROW, _EFFECT_ARROW), strict=True)})

    return blocks_.groupBy("file", "run").applyInArrow(lambda t: together(t.drop_columns("run")), _BLOCK)


_ENTERED = f"file string, block long, entered {_EFFECT}"


def _entered(rows: DataFrame, keys: list[str], dialect: Dialect) -> DataFrame:
    """What the text before each row does, from ``before`` (null: a file's begin) on; rows of a group are one after another."""

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        start = table.column("before")[0].as_py() if "before" in table.column_names else None
        now = Effect(**start) if start else Effect(OUT, closed=True)
        out = []
        for o, i in zip(_effects(table, "outside"), _effects(table, "inside"), strict=True):
            out.append(asdict(now))
            now = now.then(o, i, dialect.field_chars)
        return pa.table({"file": table.column("file"), "block": table.column("block"), "entered": pa.array(out, _EFFECT_ARROW)})

    return rows.groupBy(*keys).applyInArrow(walk, _ENTERED)


@dataclass(frozen=True)
class Parsed:
    """files: file, size, newlines, valid (UTF-8), records (before the first error), error, error_record. records: file, record (from 1), fields."""

    files: DataFrame
    records: DataFrame


def read(spark: SparkSession, path: str, dialect: Dialect = Dialect(), block_bytes: int | None = None) -> Parsed:
    text = _text(spark, path, block_bytes)
    found = written(blocks(text, dialect), "csv-blocks", spark)
    # a run spans RUN blocks of the longest length
    longest = text.agg(F.max("_metadata.file_block_length")).first()[0] or 1
    numbered = found.withColumn("run", F.floor(F.col("block") / (RUN * longest)))
    runs = written(_runs(numbered, dialect), "csv-runs")
    before = written(_entered(runs, ["file"], dialect), "csv-before")
    starts = numbered.join(before.select("file", F.floor(F.col("block") / (RUN * longest)).alias("run"), F.col("entered").alias("before")), ["file", "run"])
    starts = written(_entered(starts, ["file", "run"], dialect), "csv-starts")
    files = written(_verdicts(spark, path, runs, before, dialect), "csv-files")
    return Parsed(files, written(_records(spark, _lines(text), starts, files, dialect), "csv-records"))


def _verdicts(spark: SparkSession, path: str, runs: DataFrame, before: DataFrame, dialect: Dialect) -> DataFrame:
    """The first error of each file; a file's last run says how it ends."""

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records, errors, numbers = [], [], []
            for r in b.to_pylist():
                e = Effect(**r["entered"]).then(Effect(**r["outside"]), Effect(**r["inside"]), dialect.field_chars) if r["entered"] else Effect(OUT)
                error, at = e.error, e.at
                if not error and e.end == IN:
                    error, at = "OPEN_QUOTE", e.records
                elif not error and dialect.rfc and r["cr"] and r["open"]:
                    error, at = "BARE_CR", e.records - 1
                records.append(at if error else e.records)
                errors.append(error)
                numbers.append(at + 1 if error else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file", "size", "newlines", "valid")), pa.array(records, pa.int64()), pa.array(errors, pa.string()), pa.array(numbers, pa.int64())], names=["file", "size", "newlines", "valid", "records", "error", "error_record"])

    ends = runs.join(before, ["file", "block"]).groupBy("file").agg(F.max(F.struct("block", "cr", "entered", "outside", "inside")).alias("last"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"), F.bool_and("valid").alias("valid"))
    there = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"))
    # empty files are in Spark's list of a path, but have no rows; lists write file:/ or file:///
    name = lambda f: F.regexp_replace(F.coalesce(F.try_url_decode(f), F.col(f)), "^([a-z0-9]+):/+", "$1:/")
    listed = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "listed string").withColumn("name", name("listed"))
    there = listed.join(there.withColumn("name", name("file")), "name", "left").select(F.coalesce("file", "listed").alias("file"), F.coalesce("size", F.lit(0).cast("long")).alias("size"))
    # a byte-order mark isn't among a file's lines, a line end after its last line is
    unended = (F.col("bytes") - F.col("size")).isin(1, -2)
    rows = there.join(ends, "file", "left").select("file", "size", F.coalesce(F.col("lines") - F.when(unended, 1).otherwise(0), F.lit(0).cast("long")).alias("newlines"), F.coalesce("valid", F.lit(True)).alias("valid"), "last.cr", F.coalesce(unended, F.lit(False)).alias("open"), "last.entered", "last.outside", "last.inside")
    return rows.mapInArrow(end, "file string, size long, newlines long, valid boolean, records long, error string, error_record long")


def _parsed(text: str, most: int) -> list[list[str]]:
    csv.field_size_limit(most)
    return list(csv.reader(io.StringIO(text, newline=""), strict=True))


def _records(spark: SparkSession, lines: DataFrame, starts: DataFrame, files: DataFrame, dialect: Dialect) -> DataFrame:
    told = starts.join(files.filter("valid").select("file", "error_record"), "file").select("file", "block", "entered", F.coalesce("error_record", F.lit(2**62)).alias("stop"))
    told = told.filter("entered.error IS NULL AND entered.records + 1 < stop")
    if (n := told.count()) <= BROADCAST_BLOCKS:
        rows = lines.join(F.broadcast(told), ["file", "block"])
    else:
        numbered = lines.withColumn("n", F.monotonically_increasing_id()).join(told.hint("merge"), ["file", "block"])
        rows = numbered.repartition(n, "file", "block").sortWithinPartitions("file", "block", "n").drop("n")
    rows = rows.select("file", "block", "line", F.col("entered.end").alias("state"), F.col("entered.records").alias("before"), F.col("entered.tail").alias("carried"), "stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scanner, stop, first = None, None, 0, 0
        whole: list[bytes] = []  # lines of whole records, the first of number ``first``
        part: list[bytes] = []  # of a record that is open
        inherited = False
        out: list[tuple] = []

        def done() -> None:
            """The block's whole records, and what is left of a record that is open at its end."""
            parse()
            if part and base + scanner.records + 1 < stop and not scanner.error:
                out.append((now[0], base + scanner.records + 1, now[1], b"\n".join(part), None))

        def parse() -> None:
            nonlocal whole, first
            if whole:
                got = _parsed(b"\n".join(whole).decode() + "\n", dialect.field_chars)
                out.extend((now[0], first + i, None, None, x) for i, x in enumerate(got) if first + i < stop)
                whole, first = [], first + len(got)

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "record", "part", "raw", "fields"])
                out = []

        base = 0
        for key, i, b, raw in _in_blocks(batches):
            if key != now:
                if now:
                    done()
                state, base, carried, stop = (b.column(c)[i].as_py() for c in (3, 4, 5, 6))
                now, scanner, first, whole, part = key, Scanner(dialect, state, carried), base + 1, [], []
                inherited = state == IN
            if scanner.error or first >= stop:
                continue
            scanner.line(raw)
            if inherited:
                if scanner.first < 0:
                    part.append(raw)
                    continue
                out.append((now[0], first, now[1], b"\n".join([*part, raw[: scanner.first]]), None))
                part, inherited, first = [], False, first + 1
                raw, ended = raw[scanner.first :], scanner.last - scanner.first
                if not raw and ended == 0:
                    continue
            else:
                ended = scanner.last
            if scanner.error:
                if ended > 0:
                    whole += [*part, raw[:ended]]
                part = []
            elif scanner.state == OUT:
                whole += [*part, raw]
                part = []
            elif ended > 0:
                whole += [*part, raw[:ended]]
                part = [raw[ended:]]
            else:
                part.append(raw)
            if len(whole) >= _CHUNK:
                parse()
            if len(out) >= _CHUNK:
                yield from sent()
        if now:
            done()
        yield from sent()

    told = written(rows.mapInArrow(run, "file string, record long, part long, raw binary, fields array<string>"), "csv-parts", spark)
    parts = told.filter("part IS NOT NULL").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("part", "raw"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b"\n".join(x["raw"] for x in t).decode() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_parsed(t + "\n", dialect.field_chars)[0] for t in texts], pa.list_(pa.string()))], names=["file", "record", "fields"])

    crossing = parts.mapInArrow(join, "file string, record long, fields array<string>")
    return told.filter("part IS NULL").select("file", "record", "fields").unionByName(crossing)

