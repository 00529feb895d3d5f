"""Plain restatements of the contracts, for small tables."""
import hashlib
import re
from collections import Counter
from itertools import accumulate, permutations

LAST = 2 ** 63 - 1


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def removed_bytes(rows, length=50):
    data = [(LAST if d is None else d, d, (t or "").encode()) for d, t in rows]
    first = {}
    for k, _, x in data:
        for i in range(len(x) - length + 1):
            s = x[i:i + length]
            first[s] = min(first.get(s, LAST), k)
    out = []
    for k, d, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if first[x[i:i + length]] < k:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, sha(bytes(c for c, g in zip(x, gone) if not g))))
    return out


def removed_words(rows, length=20):
    data = [(LAST if d is None else d, d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for k, _, w in data:
        for i in range(len(w) - length + 1):
            s = tuple(w[i:i + length])
            first[s] = min(first.get(s, (LAST, LAST)), (k, i))
    out = []
    for k, d, w in data:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < (k, i):
                gone[i:i + length] = [True] * length
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(rows, percent=85):
    """(doc_id, n_shingles, component) per row; rows of one id are one node, rows without id are alone."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else top(d) if s else d) for d, s in sets]


def contaminated(rows, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = {}
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add("" if name is None else str(name))
    out = []
    for d, t in rows:
        w = words(t)
        gone, names = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i:i + n])):
                    gone[i:i + n] = [True] * n
                    names |= x
        out.append((d, len(w), sum(gone), len(names), sha(",".join(sorted(names))), sum(gone) > 0 and 20 * sum(gone) >= len(w)))
    return out


def aligned(texts, encode_a, bytes_a, encode_b, bytes_b):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text; the vocabularies' own libraries encode."""
    found, counts = [], Counter()
    for t in texts:
        a, b, raw = (encode_a(" " + t), encode_b(t), (" " + t).encode()) if t else ((), (), b"")
        if not t or b"".join(bytes_a[i] for i in a) != raw or b"".join(bytes_b[i] for i in b) != raw:
            found.append(None)
            continue
        ends_a, ends_b = list(accumulate(len(bytes_a[i]) for i in a)), list(accumulate(len(bytes_b[i]) for i in b))
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (
        x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), sha(";".join(x[2]))) for x in found]


def audit(rows, labels):
    """rows: (doc_id, text, source); the five filters applied one after the other in all 120 orders."""
    key = lambda d: LAST if d is None else d
    good, toxic = ({d for d, q, t in labels if d is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    first = {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", LAST), key(d))
    docs = {}
    for d, t, s in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0D]+", t) if x]
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
               "D": bool(re.search("[#$%&*|]", t)), "E": key(d) > first[t]}
        docs.setdefault(s or "", []).append((d, {f for f in bad if bad[f]}))
    out = []
    for part, own in docs.items():
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for s, f in enumerate(order, 1):
                gone = [(d, b) for d, b in left if f in b]
                left = [(d, b) for d, b in left if f not in b]
                steps.append((part, "".join(order), s, len(left), len(gone), sum(f in b for _, b in own) - len(gone),
                              sum(b == {f} for _, b in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), f))
        total = Counter()
        for x in steps:
            total[x[-1]] += x[4]
        out += [(*x[:-1], total[x[-1]]) for x in steps]
    return out


def measures(t):
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words"""
    t = t or ""
    w = [x for x in re.split("[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    times = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if times[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered)


def same(found, expected):
    key = lambda r: [(x is None, x) for x in r]
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
