"""Plain versions of what the operators compute, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def shingles(text, n):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def roots(ids, linked):
    """The smallest id that links lead to, by id."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and find(i) != find(j) and linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def private_spans(text):
    """(start, place of the kind, end) of the fixed patterns for personal data."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    patterns = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    for kind, (pattern, ok) in enumerate(patterns):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


def secret_spans(text):
    text, out = text or "", []
    patterns = (
        (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    for kind, (pattern, ok) in enumerate(patterns):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.A) if ok(m)]
    return sorted(out)


def joined(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def nearest_below(lengths, goal):
    """The most words that whole passes over all documents and a subset of them can have within goal."""
    size = sum(lengths)
    passes = min(2, int(goal // size)) if size else 0
    left, sums = int(goal - passes * size), 1
    if passes < 2:
        for n in lengths:
            sums |= sums << n
    return passes * size + (sums & ((1 << (left + 1)) - 1)).bit_length() - 1
