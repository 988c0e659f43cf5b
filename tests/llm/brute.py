"""Plain, slow versions of the operators' results, each written from its definition."""

import hashlib
import re
from collections import Counter


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def shingles(text, n):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(docs, n, num, den):
    """docs: {id: text}; {id: least id reachable over links of num/den similarity}."""
    sets = {i: shingles(t, n) for i, t in docs.items()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    both = Counter()
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                both[tuple(sorted((ids[a], ids[b])))] += 1
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), m in both.items():
        if den * m >= num * (len(sets[a]) + len(sets[b]) - m):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in docs}, sets


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items, window=10):
    """docs: texts; items: [(id, text)]; (n_words, n_hit, n_items, sha256) of each text."""
    index = {}
    for i, t in items:
        w = alnum(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            index.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(x) for x in index}
    out = []
    for t in docs:
        w, hit, found = alnum(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if ids := index.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        names = sorted({str(i) for i in found if i is not None})
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return out


def secrets(text):
    """(kind, start, end) of the base kinds, by start and then kind."""
    text, out = text or "", []
    either = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer(rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def units(text, least_gap=16, one_in=8, word_hash=None):
    """Words (normalised) of a text and whether a unit ends after each."""
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
    ends = []
    for k, m in enumerate(found):
        w = m[0]
        stop = w[-1] in ".!?" or w[-1] in "\"')]" and len(w) > 1 and w[-2] in ".!?"
        line = k + 1 == len(found) or "\n" in text[m.end() : found[k + 1].start()]
        ends.append(stop or line)
    by_rule = list(ends)
    for k, m in enumerate(found):
        if k + 1 >= least_gap and not any(by_rule[k - least_gap + 1 : k + 1]) and word_hash(lower(m[0])) % one_in == 0:
            ends[k] = True
    return [(lower(m[0]), m.start(), m.end()) for m in found], ends


def repeats(docs, least_words, word_hash):
    """{id: [(start, end)]}: the removed ranges of each document."""
    all_passages = []
    for i in sorted(docs):
        w, ends = units(docs[i], word_hash=word_hash)
        starts = [0] + [k + 1 for k, e in enumerate(ends) if e][:-1] if w else []
        for s in starts:
            t = next((k + 1 for k in range(s + least_words - 1, len(w)) if ends[k]), None)
            if t:
                all_passages.append((tuple(x for x, _, _ in w[s:t]), i, s, t, w))
    keep, out = {}, {i: [] for i in docs}
    for p, i, s, t, w in all_passages:
        if p in keep:
            if out[i] and s <= out[i][-1][1]:
                out[i][-1][1] = max(out[i][-1][1], t)
                out[i][-1][3] = max(out[i][-1][3], w[t - 1][2])
            else:
                out[i].append([s, t, w[s][1], w[t - 1][2]])
        else:
            keep[p] = (i, s)
    return {i: [(a, b) for _, _, a, b in x] for i, x in out.items()}
