"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(text, items, span=13):
    w, hit, found = ascii_words(text), set(), set()
    for item, other in items:
        v = ascii_words(other)
        n = min(span, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1) if v else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def shingles(text, size=4):
    w = space_words((text or "").translate(A_Z))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similar_groups(rows, size=4, percent=85):
    """(number of shingles, smallest id reachable) for each (id, text)."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(root(i), []).append(key)
    return [(len(s), min((k for k in least[root(i)] if k is not None), default=None)) for i, s in enumerate(sets)]


def without_repeats(texts, window=35):
    """(words, words removed, kept words joined) for each text."""
    split = [space_words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def statistics(text):
    w = space_words(text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    seen = Counter(grams)
    lines = [x for x in (text or "").split("\n") if space_words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len({j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)})
