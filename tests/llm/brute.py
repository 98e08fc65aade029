"""Plain single-machine versions of the numbered queries' contracts. rows: (doc_id, text[, source]) with unique doc_ids."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import tokenizers
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def groups(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def simhash(rows, shingle=4, radius=4):
    """doc_id -> (fingerprint, component_id)"""
    prints = []
    for _, text in rows:
        w = WORD.findall(lower(text or ""))
        s = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    p = np.array(prints, dtype=np.uint64)
    pairs = [(i, int(j) + i + 1) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p[i] ^ p[i + 1 :]) <= radius)]
    least = defaultdict(list)
    label = groups(len(p), pairs)
    for (doc_id, _), g in zip(rows, label):
        least[g].append(doc_id)
    return {d: (f"{f:016x}", min(least[g])) for (d, _), f, g in zip(rows, prints, label)}


def dedup(rows):
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    return {d: (max(by[t or ""]), len(by[t or ""]), d == max(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows}


ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """n_assign, n_access, n_hex, base_sha256, base spans"""
    found = {"assign": [m for m in ASSIGN.finditer(text) if len(m[1]) >= 6], "access": [m for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20], "hex": [m for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]}
    spans = sorted((m.start(), list(found).index(k), f"{k}:{m.start()}:{m.end()}") for k, v in found.items() for m in v)
    said = ",".join(s[2] for s in spans)
    return (*map(len, found.values()), hashlib.sha256(said.encode()).hexdigest(), [s[2] for s in spans])


def passages(rows, window=35):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = {}
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def encode(path, texts):
    t = tokenizers.Tokenizer.from_file(path)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pieces(path, rows, pieces, size=2048):
    """Pieces cover each document's ids exactly once and lie gapless in sequences. Returns the share of padding."""
    ids = dict(zip((d for d, *_ in rows), encode(path, [t for _, t, *_ in rows])))
    by, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        seq[p["sequence_id"]].append(p)
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
    assert set(by) == set(ids)
    for d, ps in by.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[d])
    padding = total = 0
    for ps in seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / total


def language_model_base(rows):
    """doc_id -> held_out, n_tokens, n_known, train_tokens, base_score"""
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    words = {d: [*WORD.findall(lower(t or "")), ""] for d, t in rows}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for d, ws in words.items()}


def round_robin(tokens, quanta, units):
    """Deficit round-robin, a round at a time: (queue, tokens sent) in the order they are sent. quanta in 2^-16 tokens."""
    left, credit, out = list(tokens), [0] * len(tokens), []
    while any(left):
        for s in range(len(tokens)):
            if not left[s]:
                continue
            credit[s] += quanta[s]
            whole = credit[s] >> 16
            send = left[s] if whole >= left[s] else whole // units[s] * units[s]
            credit[s] -= send << 16
            left[s] -= send
            if send:
                out.append((s, send))
    return out
