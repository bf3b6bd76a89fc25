"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

import xxhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def simhash(text, size=4, seed=42):
    words = SPACED.findall((text or "").translate(UP))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_duplicates(docs, bits=4):
    """docs: [(id, text)] -> {id: (fingerprint, component)}"""
    fp = {d: simhash(t) for d, t in docs}
    by = defaultdict(list)
    for d, f in fp.items():
        by[f].append(d)
    fs, parent = list(by), {}
    parent = {f: f for f in fs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    low = {}
    for d, f in fp.items():
        r = find(f)
        low[r] = min(low.get(r, d), d)
    return {d: (format(f, "016x"), low[find(f)]) for d, f in fp.items()}


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    w = PLAIN.findall((text or "").translate(UP))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def repeats(docs, size=400):
    """docs: [(id, text)] -> {id: (n_bytes, n_removed, n_spans, sha of the rest)}"""
    seen = defaultdict(int)
    raw = {d: (t or "").encode() for d, t in docs}
    for b in raw.values():
        for i in range(len(b) - size + 1):
            seen[hash(b[i : i + size])] += 1
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[hash(b[i : i + size])] > 1:
                gone[i : i + size] = b"\x01" * size
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out
