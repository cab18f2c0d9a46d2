"""Plain single-process versions of the operators, written from their contracts, for comparison."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter, defaultdict

import xxhash

LOWER = {i: i + 32 for i in range(65, 91)}


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        got = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += got
        if got:
            labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_labels(text, templates, k=3, share=0.6):
    """Labels of the templates of which enough k-grams stand in the text in order, in few more words than the template has: longest
    chains of hits, without diagonals."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels = set()
    for _, label, base, template in templates:
        t = template.split()
        places = defaultdict(list)
        for i in range(len(t) - k + 1):
            places[tuple(t[i : i + k])].append(i)
        hits = [(p, i) for p in range(len(words) - k + 1) for i in sorted(places.get(tuple(words[p : p + k]), ()), reverse=True)]
        n, best = len(t) - k + 1, 0
        for start in {p for p, _ in hits}:
            chain = []  # smallest last template position of a chain of each length
            for p, i in hits:
                if start <= p <= start + 1.5 * len(t):
                    at = bisect.bisect_left(chain, i)
                    chain[at : at + 1] = [i]
            best = max(best, len(chain))
        if best == n if base else best >= share * n:
            labels.add(label)
    return ",".join(sorted(labels))


def substring(docs, window=50):
    """docs: (doc_id, text) -> list of (doc_id, n_words, n_removed, kept_sha256)."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix(docs, window=400):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(d[k : k + window] for _, d in data for k in range(len(d) - window + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(docs, words=3, radius=2):
    fps = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        grams = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = defaultdict(lambda: None)
    for k, (i, _) in enumerate(docs):
        r = find(k)
        if i is not None:
            low[r] = i if low[r] is None else min(low[r], i)
    return [(i, f"{fps[k]:016x}", low[find(k)]) for k, (i, _) in enumerate(docs)]


def secrets_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ("assign", "access", "hex")
    joined = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(out))
    return [sum(k == x for _, k, _ in out) for x in range(3)], hashlib.sha256(joined.encode()).hexdigest()


def similar_lines(forms, q=8, similarity=0.8):
    """Components of different normal forms: {form: smallest form}."""
    sets = {f: {f[i : i + q] for i in range(max(1, len(f) - q + 1))} for f in set(forms)}
    holders = defaultdict(list)
    root = {f: f for f in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for f, s in sets.items():
        common = Counter(g for x in s for g in holders[x])
        for g, c in common.items():
            if c >= similarity * (len(s) + len(sets[g]) - c):
                root[max(find(f), find(g))] = min(find(f), find(g))
        for x in s:
            holders[x].append(f)
    return {f: find(f) for f in sets}


def fuzzy_lines(docs, q=8, similarity=0.8):
    """docs: (doc_id, text), ids different -> list of (doc_id, n_lines, n_removed, kept_sha256)."""
    form = lambda line: " ".join(re.findall(r"[^\x20\x09-\x0D]+", line.translate(LOWER)))
    split = [(i, (t or "").split("\n")) for i, t in sorted(docs)]
    root = similar_lines([form(x) for _, ls in split for x in ls if form(x)], q, similarity)
    seen, out = set(), []
    for i, lines in split:
        kept = []
        for x in lines:
            r = root.get(form(x))
            if r is None or r not in seen:
                kept.append(x)
                seen.add(r)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
