"""Secret scanning with multipart credential linking.

A scan of every whole text finds base spans (assignments, access identifiers, long hexadecimal runs), which always
count, and weak candidates, which look like parts of a credential but are common in ordinary text: short access
identifiers, mixed-case key material and endpoints. The scope of a weak candidate is what starts ``SCOPE_CHARS`` or less
before or after its start, with one gap of blank lines between at most. An interval join puts each part (base or weak)
into the scopes that contain its start; a weak candidate is reported only if its scope also holds complementary parts:
key material needs an identifier or an endpoint, an identifier needs key material, an endpoint needs both.

Texts are joined by content, so equal texts are linked once however many rows hold them, and a scope holds no more parts
than fit into its length: nothing grows with the square of a text or a group. Nulls: a null text counts as empty. Repeated rows get equal spans.
An empty table gives an empty result. Extra columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.storage import written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Equal to taking AKIA[A-Z0-9]+ and [0-9a-f]+ and dropping short ones: both take a whole run from its first possible start.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: One of these is in every assignment, in either case.
KEYWORDS = ("passw", "secret", "token", "api")
#: Weak candidates.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIDA|AROA|GOOG|AIza)[A-Za-z0-9]{8,}(?![A-Za-z0-9])")
IDENTIFIER_HINTS = ("AKIA", "ASIA", "AIDA", "AROA", "GOOG", "AIza")
MATERIAL = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
LONG_RUN = re.compile(r"[A-Za-z0-9+/_-]{32}")
ENDPOINT = re.compile(r"(?:https?|s3|gs|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9][A-Za-z0-9.:@/_-]*")

KINDS = ("assign", "access", "hex", "identifier", "material", "endpoint")
#: What a span can be in a credential. An assignment and a hexadecimal run can be key material.
ROLE = {"assign": "material", "access": "identifier", "hex": "material", "identifier": "identifier", "material": "material", "endpoint": "endpoint"}
SCOPE_CHARS = 2000
BLANK = re.compile(r"\n(?:[\x20\t\r]*\n)+")
#: Width of the bins of the interval join.
BIN = 4096

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind's number, end), ordered by start, then kind."""
    lower = text.lower()
    out = []
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates outside the base spans."""
    out = []
    if any(k in text for k in IDENTIFIER_HINTS):
        out += [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    if LONG_RUN.search(text):
        out += [(m.start(), 4, m.end()) for m in MATERIAL.finditer(text)]
    if "://" in text:
        out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    free, i, reach = [], 0, 0
    for s in sorted(out):
        while i < len(base) and base[i][0] < s[2]:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= s[0]:
            free.append(s)
    return free


def scopes(text: str, weak: list[Span]) -> list[tuple[int, int]]:
    """The scope of each weak candidate: within ``SCOPE_CHARS`` of its start, in its block or the one before or after."""
    cuts = [0, *(m.end() for m in BLANK.finditer(text)), len(text)]
    out = []
    for start, _, _ in weak:
        i = bisect_right(cuts, start)  # its block ends at cuts[i]
        out.append((max(cuts[max(0, i - 2)], start - SCOPE_CHARS), min(cuts[min(i + 1, len(cuts) - 1)], start + SCOPE_CHARS + 1)))
    return out


def written_as(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FOUND = "text_key binary, n_assign long, n_access long, n_hex long, base_sha256 string, base string, weak array<struct<kind:string,start:long,end:long,scope_start:long,scope_end:long>>, parts array<struct<kind:string,start:long>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and what one pass over each whole text finds; parts only where there are weak candidates."""
    schema = docs.select("doc_id").schema
    for field in docs.sparkSession.createDataFrame([], _FOUND).schema:
        schema = schema.add(field)
    arrow = [
        pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
        pa.list_(pa.struct([("kind", pa.string()), *[(name, pa.int64()) for name in ("start", "end", "scope_start", "scope_end")]])), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64())])),
    ]

    def one(text: str) -> tuple:
        base = base_spans(text)
        weak = weak_spans(text, base)
        said, n = written_as(base), [sum(k == i for _, k, _ in base) for i in range(3)]
        key = hashlib.blake2b(text.encode(), digest_size=16).digest() if weak else None
        parts = [{"kind": KINDS[k], "start": a} for a, k, _ in sorted(base + weak)] if weak else []
        scoped = [{"kind": KINDS[k], "start": a, "end": b, "scope_start": x, "scope_end": y} for (a, k, b), (x, y) in zip(weak, scopes(text, weak), strict=True)] if weak else []
        return key, *n, hashlib.sha256(said.encode()).hexdigest(), said, scoped, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(t.as_py() or "") for t in b.column(1)]
            columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def linked(found: DataFrame) -> DataFrame:
    """text_key, added: the weak candidates whose scope holds complementary parts, one row a text that has any."""
    texts = found.filter(F.size("weak") > 0).groupBy("text_key").agg(F.first("weak").alias("weak"), F.first("parts").alias("parts"))
    texts = written(texts, "weak-texts")
    roles = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])
    bin_of = lambda c: F.floor(F.col(c) / BIN)
    parts = texts.select("text_key", F.inline("parts")).select("text_key", "start", roles[F.col("kind")].alias("role"), bin_of("start").alias("bin"))
    weak = texts.select("text_key", F.inline("weak")).withColumnRenamed("start", "at").withColumn("bin", F.explode(F.sequence(bin_of("scope_start"), F.floor((F.col("scope_end") - 1) / BIN))))
    within = (F.col("start") >= F.col("scope_start")) & (F.col("start") < F.col("scope_end"))
    has = lambda role: F.max(F.col("role") == role).alias(role)
    held = weak.join(parts, ["text_key", "bin"]).filter(within).groupBy("text_key", "at", "kind", "end").agg(has("identifier"), has("material"), has("endpoint"))
    enough = (
        F.when(F.col("kind") == "identifier", F.col("material"))
        .when(F.col("kind") == "material", F.col("identifier") | F.col("endpoint"))
        .otherwise(F.col("identifier") & F.col("material"))
    )
    return held.filter(enough).groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("start"), "kind", "end"))).alias("added"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every row."""
    found = written(scan(docs), "secrets")
    added = linked(found)
    # rows without weak candidates, nearly all, have no key and take no part in the join
    joined = found.filter("text_key IS NOT NULL").join(added, "text_key", "left")
    joined = joined.unionByName(found.filter("text_key IS NULL").withColumn("added", F.lit(None).cast(added.schema["added"].dataType)))
    order = F.array(*[F.lit(k) for k in KINDS])
    parsed = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("long").alias("start"), F.array_position(order, F.split_part(x, F.lit(":"), F.lit(1))).alias("n"), x.alias("said")))
    more = F.transform("added", lambda a: F.struct(a["start"].alias("start"), F.array_position(order, a["kind"]).alias("n"), F.concat_ws(":", a["kind"], a["start"].cast("string"), a["end"].cast("string")).alias("said")))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(F.array_sort(F.concat(parsed, more))["said"], ","))
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_linked"))
