"""Plain versions of what the operators compute."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(AZ))


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(AZ).encode())
    shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def plain_components(ids, values, close):
    parent = dict(zip(range(len(ids)), range(len(ids))))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if close(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def plain_contamination(texts, items):
    windows = {}
    for name, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(name))
    out = []
    for text in texts:
        w, hit, names = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    names |= windows[x]
        joined = ",".join(sorted(names))
        out.append((len(w), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
