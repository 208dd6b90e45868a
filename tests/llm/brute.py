"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def repeated(rows, length=100):
    """doc_id -> (bytes, removed, spans, sha256) of rows (doc_id, text), judged in order of id."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())
    return out


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, n=4, percent=85):
    """doc_id -> (set size, smallest id of the component)."""
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, x in enumerate(ids):
        for y in ids[:k]:
            a, b = sets[x], sets[y]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or root(x) == root(y):
                continue
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                p, q = sorted((root(x), root(y)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in sets}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(rows, items, window=13):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1) if m else ():
            wins[tuple(w[k : k + m])].add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                got = wins.get(tuple(w[k : k + m]))
                if got:
                    hit.update(range(k, k + m))
                    found |= got
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def kneser_ney(train, order=5, pad=2):
    """A function from text to its negative log probability, trained on these texts."""
    def grams(t):
        b = bytes([pad]) * (order - 1) + (t or "").encode()
        return [b[k : k + order] for k in range(len(b) - order + 1)]

    level = {order: Counter(g for t in train for g in grams(t))}
    for n in range(order - 1, 0, -1):
        level[n] = Counter(g[1:] for g in level[n + 1])
    cut, ctx = {}, {}
    for n, c in level.items():
        k = Counter(c.values())
        if all(k.get(j) for j in (1, 2, 3, 4)):
            y = k[1] / (k[1] + 2 * k[2])
            d = (1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3])
            cut[n] = [min(max(x, 0.05), j - 0.05) for x, j in zip(d, (1, 2, 3))]
        else:
            cut[n] = [0.5, 0.75, 0.9]
        ctx[n] = defaultdict(lambda: [0, 0.0])
        for g, m in c.items():
            ctx[n][g[:-1]][0] += m
            ctx[n][g[:-1]][1] += cut[n][min(m, 3) - 1]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 256
        if g[:-1] not in ctx[n]:
            return p(g[1:])
        total, off = ctx[n][g[:-1]]
        m = level[n].get(g, 0)
        return (m - cut[n][min(m, 3) - 1] if m else 0) / total + off / total * p(g[1:])

    return lambda t: -sum(math.log(p(g)) for g in grams(t))


def runs(w, least=12):
    """(start, length, period) of the runs of a list of words, comparing each word with those after it."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((a, b - a, q) for (a, b), q in found.items())


def periodic(rows, least=12):
    """(doc_id, runs, text left) of each row (doc_id, text), words numbered from 0."""
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = runs(w, least)
        gone = {k for a, n, q in found for k in range(a + q, a + n)}
        out.append((i, found, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def repetition(text, grams, window=8):
    """The measures of one text by name."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>")}
    lines, seen = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set()
    again = [x for x in lines if x in seen or seen.add(x)]
    out |= {"n_lines": len(lines), "n_dup_lines": len(again), "dup_line_chars": sum(len(re.sub(r"[\x20\x09-\x0D]", "", x)) for x in again)}
    for n in {*grams, window}:
        places = defaultdict(list)
        for k in range(len(w) - n + 1):
            places[tuple(w[k : k + n])].append(k)
        later = {k + j for p in places.values() for k in p[1:] for j in range(n)}
        if n in grams:
            out[f"dup_chars_{n}"] = sum(len(w[k]) for k in later)
        if n == window:
            out["n_repeat_words"] = len({k + j for p in places.values() if len(p) > 1 for k in p for j in range(n)})
    return out


def phrases(rows, least=10, longest=3, inside=50, first=2000):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text)."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[k : k + n])) for n in range(1, longest + 1) for k in range(len(w) - n + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= inside * a and any(q[k : k + len(p)] == p for k in range(len(q))) for (x, q), b in often.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, nr, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for nr, (s, a, p, left, right) in enumerate(sorted(x)[:first], 1))
