"""Plain versions of what the operators compute, row by row, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def raw(text):
    return (text or "").encode()


def words(text):
    return WORD.findall(raw(text))


def shingles(text, width):
    w = WORD.findall(raw(text).translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_groups(docs, width, percent):
    """{id: (shingles, component, kept)} of {id: text}."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    above = {i: i for i in docs}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                above[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in docs}


def exact(docs):
    """Rows (id, keep_id, group_size, kept, sha256) of (id, text) rows."""
    keys = [hashlib.sha256(raw(t).translate(LOWER)).hexdigest() for _, t in docs]
    keep, size = {}, Counter(keys)
    for (i, _), k in zip(docs, keys, strict=True):
        keep[k] = max(keep.get(k, i), i)
    return sorted((i, keep[k], size[k], keep[k] == i, k) for (i, _), k in zip(docs, keys, strict=True))


def without_repeats(docs, length=50):
    """{id: (bytes, removed, spans, sha256)} of {id: text}."""
    least = {}
    for i in sorted(docs):
        b = raw(docs[i])
        for k in range(len(b) - length + 1):
            least.setdefault(b[k : k + length], i)
    out = {}
    for i, t in docs.items():
        b, spans = raw(t), []
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                if spans and spans[-1][1] >= k:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept, at = b"", 0
        for a, z in spans:
            kept += b[at:a]
            at = z
        kept += b[at:]
        out[i] = (len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def edit_distance_within(pattern, text):
    """The least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        before, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b)))
    return min(row)
