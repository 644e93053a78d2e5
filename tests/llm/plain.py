"""The contracts once more, in plain Python over small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

LOW = {i: i + 32 for i in range(65, 91)}


def roots(nodes, links):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows):
    """{id: (fingerprint, smallest id)} of (id, text) with different ids."""
    prints = {i: simhash(t) for i, t in rows}
    ids = sorted(prints)
    links = [
        (a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2
    ]
    found = roots(ids, links)
    return {i: (prints[i], found[i]) for i in ids}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_texts(rows):
    """{id: smallest id} over pairs of (id, text) with a similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for a in ids
        for b in ids
        if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    return roots(ids, links)


def near_texts_by_prefix(rows):
    """The same as `near_texts` for many rows: a similar pair shares one of its rarest shingles.

    If two sets have a similarity of 0.8 or more, more than four fifths of the
    larger one are shared, so of the fifth and one more that are rarest in a fixed
    order one is in both.
    """
    sets = {i: shingles(t) for i, t in rows}
    count = Counter(s for x in sets.values() for s in x)
    seen, links, empty = defaultdict(list), [], None
    for i, x in sets.items():
        if not x:
            if empty is not None:
                links.append((i, empty))
            empty = i
            continue
        near = set()
        for s in sorted(x, key=lambda s: (count[s], s))[: len(x) - (4 * len(x) + 4) // 5 + 1]:
            near.update(seen[s])
            seen[s].append(i)
        links += [(i, j) for j in near if 5 * len(x & sets[j]) >= 4 * len(x | sets[j])]
    return roots(list(sets), links)


def without_repeats(rows, window=35):
    """[(id, n_words, n_removed, kept)] of (id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    places = Counter(
        tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1)
    )
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if places[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), " ".join(kept)))
    return out


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(rows, items):
    """[(id, n_words, n_hit, n_items, items_sha256, contaminated)]."""
    patterns = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            patterns[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for doc, text in rows:
        w, hit, found = alnum_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := patterns.get(tuple(w[i : i + n])):
                    found |= names
                    hit.update(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


BASE = [
    (
        "assign",
        r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
MORE = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 1),
]


def secrets(text, kinds=tuple(BASE + MORE)):
    """[(start, rank, end, kind)] in order."""
    return sorted(
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, group, least) in enumerate(kinds)
        for m in re.finditer(pattern, text or "")
        if len(m[group]) >= least
    )


def redacted(text):
    out, at = "", 0
    for start, _, end, _ in secrets(text):
        if start >= at:
            out += (text or "")[at:start] + "[SECRET]"
        at = max(at, end)
    return out + (text or "")[at:]


def crc(text):
    return zlib.crc32((text or "").encode())
