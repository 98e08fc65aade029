"""Compression-distance classification of toxicity.

Two zstandard dictionaries are trained separately: one on windows of ordinary text, one on those windows of toxic text
that hold byte runs far commoner there than in ordinary text. A text is cut into windows of one and of six words. Each
window is compressed with the ordinary dictionary, and with the toxic one followed by the ordinary one (so that ordinary
words cost the same with both); the bytes that the toxic dictionary saves measure what only toxic text has. A logistic
curve, calibrated on labelled documents that the measuring dictionaries have not seen and weighed as the labels occur,
turns a document's savings into a score; the threshold is one of this score.

Dictionaries and curve are fitted on a bounded sample (``Fit.sample`` documents of each label, the first by hash); every
document and every window of it is scored. Nulls: a null text counts as empty and gets the score of a text without
windows; a null doc_id is scored and held out or not like the text "" would be. Repeated rows get equal scores.
Without labels of both kinds every score is the share of toxic ones among the labels that there are (0 without any);
with so few that no byte run stands out, all documents get about that share. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.storage import scope, unused, written


@dataclass(frozen=True)
class Fit:
    #: Documents of each label at most, for dictionaries and calibration together.
    sample: int = 1000
    #: Longer documents are not used for fitting.
    most_bytes: int = 32768
    #: Bytes of a document used for training at most: so much of its windows, spread evenly.
    sample_bytes: int = 16384
    ordinary_bytes: int = 8192
    toxic_bytes: int = 1024
    #: Words in a window: every text is cut into windows of each size.
    window_words: tuple[int, ...] = (1, 6)
    #: A byte run counts as toxic if it is in so many and such a share of the toxic documents, and so many times likelier there.
    run: int = 5
    least: int = 3
    least_share: float = 0.004
    ratio: float = 60.0
    level: int = 3
    threshold: float = 0.7


FOLDS = 4


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    fit: Fit


def remainder(doc_id: Column, modulus: int) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


#: Stands between the words of a window and around them: a whole word that a dictionary holds matches with both its ends.
BETWEEN = b" \x00 "


def windows(text: bytes, words: int) -> list[bytes]:
    """Windows of so many whole words, lower-cased; the last may have fewer."""
    w = text.lower().split()
    return w if words == 1 else [b" ".join(w[i : i + words]) for i in range(0, len(w), words)]


def spread(window: bytes) -> bytes:
    return BETWEEN + window.replace(b" ", BETWEEN) + BETWEEN


#: Windows that a worker remembers at most.
CACHE = 150_000


class Savings(dict):
    """What a document's windows save with the toxic dictionary over the ordinary one; equal words are compressed once."""

    def __init__(self, toxic: bytes, ordinary: bytes, fit: Fit) -> None:
        def compressor(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=fit.level)
            return zstandard.ZstdCompressor(level=fit.level, dict_data=d, write_content_size=False, write_dict_id=False).compress

        super().__init__()
        self.toxic, self.ordinary, self.fit = compressor(toxic), compressor(ordinary), fit

    @property
    def names(self) -> int:
        return 5 * len(self.fit.window_words)

    def saved(self, window: bytes) -> int:
        w = spread(window)
        return len(self.ordinary(w)) - len(self.toxic(w))

    def __missing__(self, window: bytes) -> int:
        self[window] = saved = self.saved(window)
        return saved

    def __call__(self, text: bytes) -> np.ndarray:
        if len(self) > CACHE:
            self.clear()
        return np.concatenate([self._measured(windows(text, n), self.__getitem__ if n == 1 else self.saved) for n in self.fit.window_words])

    @staticmethod
    def _measured(parts: list[bytes], save) -> np.ndarray:
        n = len(parts)
        if not n:
            return np.zeros(5)
        saved = np.fromiter(map(save, parts), dtype=np.float64, count=n)
        best = np.minimum(np.sort(np.append(saved, [0, 0]))[::-1], 8)
        three, five = (saved >= 3).sum(), (saved >= 5).sum()
        return np.array([best[0], best[1], np.log1p(three), three / n, np.log1p(five)])


def _runs(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The byte runs within a text's words (with the spaces before and after) as numbers, the word of each, the words."""
    words = text.lower().split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    n = max(0, len(b) - length + 1)
    x = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        x = (x << np.uint64(8)) | b[i : n + i]
    at = (np.cumsum(b == 32, dtype=np.int32) - 1)[length // 2 : n + length // 2]
    # a run belongs to one word, with the spaces around it at most
    inside = np.ones(n, dtype=bool)
    for i in range(1, length - 1):
        inside &= b[i : n + i] != 32
    return x[inside], at[inside], words


Runs = tuple[np.ndarray, np.ndarray, list[bytes]]


def toxic_windows(toxic: list[Runs], ordinary: list[Runs], fit: Fit) -> list[bytes]:
    """The words of toxic texts that hold a run which is far commoner in toxic texts, each as often as it is said."""
    if not toxic or not ordinary:
        return []
    a, ca = np.unique(np.concatenate([np.unique(x) for x, _, _ in toxic]), return_counts=True)
    b, cb = np.unique(np.concatenate([np.unique(x) for x, _, _ in ordinary]), return_counts=True)
    if not len(a):
        return []
    other = np.zeros(len(a), dtype=np.int64)
    if len(b):
        i = np.minimum(np.searchsorted(b, a), len(b) - 1)
        other = np.where(b[i] == a, cb[i], 0)
    good = a[(ca >= max(fit.least, fit.least_share * len(toxic))) & (ca / len(toxic) >= fit.ratio * (other + 0.5) / len(ordinary))]
    out = []
    for x, at, words in toxic if len(good) else []:
        hit = good[np.minimum(np.searchsorted(good, x), len(good) - 1)] == x
        out += [words[k] for k in np.unique(at[hit]).tolist() if k < len(words)]
    return out


def ordinary_windows(ordinary: list[bytes], fit: Fit) -> list[bytes]:
    """Windows of a dozen words, spread evenly over each text."""
    out = []
    for t in ordinary:
        w = windows(t, 12)
        out += w[:: max(1, -(-len(t) // fit.sample_bytes))]
    return out


def trained(samples: list[bytes], size: int, fit: Fit) -> bytes:
    """The content of a dictionary trained on windows; where they are too few to train on, the windows themselves."""
    spaced = [spread(w) for w in samples]
    try:
        return zstandard.train_dictionary(size, spaced, level=fit.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(spaced)[-size:]


def dictionaries(toxic: list[Runs], ordinary: list[Runs], end: bytes, fit: Fit) -> tuple[bytes, bytes]:
    """The trained toxic dictionary followed by the ordinary one, and the ordinary one at the same distance."""
    return trained(toxic_windows(toxic, ordinary, fit), fit.toxic_bytes, fit).rjust(fit.toxic_bytes, b"\0") + end, b"\0" * fit.toxic_bytes + end


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression of weighted rows by Newton steps; the last number is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[bytes, int]], fit: Fit, occur: dict[int, int] | None = None) -> Model | float:
    """rows: (text, label), bounded by ``fit.sample`` of each label; occur: how often each label occurs. Without both labels
    the share of toxic ones.

    Dictionaries trained without a fold measure that fold, so the curve is calibrated on unseen text (but for a single
    text of a label); the dictionaries that stay are trained on all.
    """
    split = {y: [t for t, label in rows if label == y] for y in (0, 1)}
    occur = occur or {k: len(v) for k, v in split.items()}
    if not split[0] or not split[1]:
        return occur.get(1, 0) / max(1, sum(occur.values()))
    end = trained(ordinary_windows(split[0], fit), fit.ordinary_bytes, fit)
    runs = {k: [_runs(t, fit.run) for t in v] for k, v in split.items()}
    folds = min(FOLDS, *map(len, split.values()))
    x, y = [], []
    for fold in range(folds):
        savings = Savings(*dictionaries(*([t for i, t in enumerate(runs[k]) if folds == 1 or i % folds != fold] for k in (1, 0)), end, fit), fit)
        for label, texts in split.items():
            x += [savings(t) for t in texts[fold::folds]]
            y += [label] * len(texts[fold::folds])
    toxic, ordinary = dictionaries(runs[1], runs[0], end, fit)
    weigh = {k: occur.get(k, len(v)) / len(v) for k, v in split.items()}
    labels = np.array(y)
    return Model(toxic, ordinary, tuple(_logistic(np.array(x), labels, np.where(labels == 1, weigh[1], weigh[0]))), fit)


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, fit: Fit) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """A bounded sample of labelled rows (per label the ``fit.sample`` documents with the least hashes), and how many there are of each.

    Keys are chosen without texts; only the texts of the chosen go to the driver.
    """
    toxic = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keys = docs.filter(usable & (F.octet_length("text") <= fit.most_bytes)).select("doc_id").distinct().join(toxic, "doc_id")
    keys = written(keys, "labelled")
    occur = {r["toxic"]: r["count"] for r in keys.groupBy("toxic").count().collect()}
    out = []
    for label in (0, 1):
        chosen = keys.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.sample).select("doc_id")
        texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= fit.most_bytes).join(F.broadcast(chosen), "doc_id")
        found = texts.groupBy("doc_id").agg(F.max("text").alias("text")).collect()
        out += [(r.text.encode(), label) for r in sorted(found, key=lambda r: r.doc_id)]
    return out, occur


def fitted(docs: DataFrame, labels: DataFrame, usable: Column, fit: Fit) -> Model | float:
    with scope(docs.sparkSession):
        rows, occur = labelled_sample(docs, labels, usable, fit)
    return train(rows, fit, occur)


def score(docs: DataFrame, model: Model | float, *, keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` and the score, as ``name``, for every row."""
    if not isinstance(model, Model):
        return docs.select(*keep, F.lit(float(model)).alias(name))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    schema = docs.select(*keep, F.lit(0.5).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        savings, w = Savings(m.toxic, m.ordinary, m.fit), np.array(m.weights)
        for b in batches:
            text = b.column(b.num_columns - 1)
            x = np.array([savings((t.as_py() or "").encode()) for t in text]).reshape(len(text), savings.names)
            p = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], names=[*b.schema.names[:-1], name])
        pa.default_memory_pool().release_unused()

    return docs.select(*keep, F.col("text").alias(unused("_scored_text", docs.columns))).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, score, predicted; learns from rows whose crc32(doc_id) mod 3 is not 1."""
    held = remainder(F.col("doc_id"), 3) == 1
    model = fitted(docs, labels, ~held, fit)
    scored = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= fit.threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that score below the threshold, with all columns."""
    columns = docs.columns
    held = remainder(F.col("doc_id"), 3) == 1
    model = fitted(docs, labels, ~held, fit)
    name = unused("_toxicity", columns)
    return score(docs, model, keep=columns, name=name).filter(F.col(name) < fit.threshold).select(*columns)
