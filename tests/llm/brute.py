"""Plain, slow forms of the operators, written from their definitions."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text):
    text = text or ""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end(), "hex"))
    return sorted(found)


def secret_row(text):
    spans = base_spans(text)
    kinds = Counter(s[3] for s in spans)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return kinds["assign"], kinds["access"], kinds["hex"], sha(joined), joined


def quality_row(text):
    text = text or ""
    words = WORD.findall(text)
    symbols = sum(c in "#*$%&|<>" for c in text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, duplicates = set(), 0
    for line in lines:
        duplicates += line in seen
        seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), symbols, duplicates, len(covered), n < 50 or 100 * len(covered) > 50 * n


def shingle_set(text, size=3):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(docs, percent=90, size=3):
    """doc_id -> (n_shingles, component), comparing all pairs of different sets of like size."""
    sets = {}
    for i, text in docs:
        sets.setdefault(frozenset(shingle_set(text, size)), []).append(i)
    empty = sets.pop(frozenset(), [])
    order = sorted(sets, key=len)
    parent = list(range(len(order)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, s in enumerate(order):
        for b in range(a + 1, len(order)):
            t = order[b]
            if 100 * len(s) < percent * len(t):
                break
            shared = len(s & t)
            if 100 * shared >= percent * (len(s) + len(t) - shared):
                parent[root(a)] = root(b)
    least = {}
    for k, s in enumerate(order):
        least[root(k)] = min(least.get(root(k), 1 << 62), *sets[s])
    out = {i: (len(s), least[root(k)]) for k, s in enumerate(order) for i in sets[s]}
    return out | {i: (0, i) for i in empty}


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def license_row(text):
    words = LICENSE_WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for i in range(len(words)):
        for phrase, label in PHRASES.items():
            if tuple(words[i : i + len(phrase)]) == phrase:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
