"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = SPACED.findall(ascii_lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def ngram_components(docs, k=5, percent=75):
    """docs: list of (doc_id, text); returns list of (doc_id, n, component)."""
    sets = [shingles(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in held[x])
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for x in s:
            held[x].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]


def substring_dedup(docs, k=13):
    words = [SPACED.findall(t or "") for _, t in docs]
    first = {}
    for (d, _), w in zip(docs, words, strict=True):
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def decontaminate(docs, items, k=13):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(ascii_lower(text))
        if w:
            n = min(k, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for d, text in docs:
        w = ALNUM.findall(ascii_lower(text))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit[i : i + n] = [True] * n
                    found |= got
        ids = ",".join(sorted(str(x) for x in found))
        n_hit = sum(hit)
        out.append((d, len(w), n_hit, len(found), hashlib.sha256(ids.encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(w)))
    return out


def verbatim_matches(docs, items, k=13):
    """(doc_id, start, words, item_id, item_start) of the matches that can't be longer on either side, of k words or the whole item."""
    out = []
    for d, text in docs:
        w = ALNUM.findall(ascii_lower(text))
        for item, other in items:
            b = ALNUM.findall(ascii_lower(other))
            n = min(k, len(b))
            starts = defaultdict(list)
            for j in range(len(b) - n + 1 if b else 0):
                starts[tuple(b[j : j + n])].append(j)
            pairs = {(i, j) for i in range(len(w) - n + 1 if b else 0) for j in starts.get(tuple(w[i : i + n]), ())}
            for i, j in pairs:
                if (i - 1, j - 1) not in pairs:
                    m = 1
                    while (i + m, j + m) in pairs:
                        m += 1
                    out.append((d, i, n + m - 1, str(item), j))
    return out


def quality(docs):
    out = []
    for d, text in docs:
        text = text or ""
        w = SPACED.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = [False] * len(w)
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                rep[i : i + 3] = [True] * 3
        n = sum(rep)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, n, len(w) < 50 or 100 * n > 50 * len(w)))
    return out
