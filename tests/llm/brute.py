"""Plain Python versions of the operators' contracts, for small tables."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall(text or "")


def shingles(text, n):
    own = words((text or "").translate(UPPER))
    return frozenset(tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))) if own else frozenset()


def jaccard_groups(docs, n, percent):
    """{key: (set size, component, links)} by comparing every pair."""
    sets = [(k, shingles(t, n)) for k, t in docs]
    parent, links = {k: k for k, _ in sets}, collections.Counter()

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {k: (len(s), root(k), links[k]) for k, s in sets}


def repeated_words(text):
    own = words(text)
    count = collections.Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    return len({j for i in range(len(own) - 2) if count[tuple(own[i : i + 3])] > 1 for j in range(i, i + 3)})


def repeated_lines(text):
    seen, found = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            found += line in seen
            seen.add(line)
    return found


def without_repeats(docs, window):
    """[(key, words, removed, kept text)] by counting every window."""
    count = collections.Counter(tuple(w[i : i + window]) for w in (words(t) for _, t in docs) for i in range(len(w) - window + 1))
    out = []
    for key, text in docs:
        own = words(text)
        gone = {j for i in range(len(own) - window + 1) if count[tuple(own[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((key, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return out


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def base_spans(text):
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS):
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match.group())
            if kind == "ip" and any(int(p) > 255 for p in match.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((match.start(), number, match.end()))
    return sorted(found)


def top_k(vectors, k, every):
    """{query: [(key, score)]} over integer vectors {key: list}."""
    return {
        q: sorted(((b, sum(x * y for x, y in zip(v, w))) for b, w in vectors.items() if b != q), key=lambda p: (-p[1], p[0]))[:k]
        for q, v in vectors.items()
        if q % every == 0
    }
