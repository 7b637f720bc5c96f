"""Plain single-process versions of the training-data contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = re.compile("[ \t-\r]+")
WORD = re.compile("[^ \t-\r]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def base_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def contamination(docs, items, width=13):
    def split(t):
        return re.findall("[^\x00-/:-`{-\x7f]+", lower(t))

    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out[i] = len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)
    return out


def repeats(docs, length=400):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in docs]
    for _, b in data:
        for p in range(len(b) - length + 1):
            seen[hash(b[p : p + length])] += 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[hash(b[p : p + length])] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def passages(docs, length=50):
    seen = Counter()
    split = [(i, words(t)) for i, t in docs]
    for _, w in split:
        for p in range(len(w) - length + 1):
            seen[tuple(w[p : p + length])] += 1
    out = []
    for i, w in split:
        hit = {q for p in range(len(w) - length + 1) if seen[tuple(w[p : p + length])] > 1 for q in range(p, p + length)}
        out.append((i, len(hit)))
    return out


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def unigram_scores(docs):
    counts = Counter()
    for i, t in docs:
        if not held_out(i):
            counts.update(words(lower(t)))
            counts["\n"] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in docs:
        tokens = [*words(lower(t)), "\n"]
        out.append((i, held_out(i), len(tokens), sum(counts[x] > 0 for x in tokens), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)))
    return out


def tree_scores(docs, max_depth, min_context, min_symbol, discount, gain_per_symbol):
    """log10 probability of each text in the longest retained context, straight from the definitions."""
    train = [[*words(lower(t)), "\n"] for i, t in docs if not held_out(i)]
    counts = Counter(x for t in train for x in t)
    n, v = sum(counts.values()), len(counts)
    follow = defaultdict(Counter)
    for t in train:
        for i in range(len(t)):
            for d in range(1, max_depth + 1):
                if i >= d:
                    follow[tuple(t[i - d : i])][t[i]] += 1
    states = {}

    def p(context, s):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (counts[s] + 1) / (n + v + 1)
        listed, left = states[context]
        return listed.get(s, 0.0) + left * p(context[1:], s)

    for context in sorted(follow, key=len):
        total = sum(follow[context].values())
        shown = {s: c for s, c in follow[context].items() if c >= min_symbol}
        if total < min_context or not shown:
            continue
        listed = {s: (c - discount) / total for s, c in shown.items()}
        left = 1 - sum(listed.values())
        gain = (total - sum(shown.values())) * math.log(left)
        for s, c in shown.items():
            parent = p(context[1:], s)
            gain += c * math.log((listed[s] + left * parent) / parent)
        if gain >= gain_per_symbol * len(shown):
            states[context] = listed, left
    out = []
    for _, t in docs:
        tokens = [*words(lower(t)), "\n"]
        out.append(sum(math.log10(p(tuple(tokens[max(0, k - max_depth) : k]), x)) for k, x in enumerate(tokens)))
    return out


def shingles(text, width=5):
    w = words(lower(text))
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def probability_jaccard(a, b):
    """Of two counters, each taken as a probability distribution."""
    na, nb = sum(a.values()), sum(b.values())
    x, y = {k: n / na for k, n in a.items()}, {k: n / nb for k, n in b.items()}
    both = x.keys() & y.keys()
    if sum(min(x[k], y[k]) for k in both) < 0.5:  # the similarity is at most the common mass
        return 0.0
    every = [(x.get(k, 0.0), y.get(k, 0.0)) for k in x.keys() | y.keys()]
    return sum(1 / sum(max(p / x[d], q / y[d]) for p, q in every) for d in both)


def near_classes(docs, threshold=0.8):
    """Class of each document: all pairs of texts by probability Jaccard of their counted shingles, then components."""
    texts = [(i, t, shingles(t)) for i, t in docs]
    root = {k: k for k in range(len(texts))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    postings = defaultdict(list)
    for k, (_, _, s) in enumerate(texts):
        for x in s:
            postings[x].append(k)
    for k, (_, t, s) in enumerate(texts):
        shared = {j for x in s for j in postings[x] if j < k}
        for j in shared:
            if t == texts[j][1] or find(k) != find(j) and probability_jaccard(s, texts[j][2]) >= threshold:
                a, b = sorted((find(k), find(j)))
                root[b] = a
    first = {}
    for k, (i, _, _) in enumerate(texts):
        first[find(k)] = min(i, first.get(find(k), i))
    return {i: first[find(k)] for k, (i, _, _) in enumerate(texts)}


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """Water filling by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > epochs * sizes[s]}
        if not full:
            return out | share
        out |= {s: epochs * sizes[s] for s in full}
        open_ -= full


def search(docs, items, k=50):
    """The k best documents of each item, by the formula over every document."""
    terms = lambda t: re.findall("[^\x00-/:-@\\[-`{-\x7f]+", lower(t))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(x for _, c in counted for x in c)
    out = []
    for row, (item, text) in enumerate(items):
        w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) for x in set(terms(text)) if df[x]}
        found = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(v * ((1_000_000_000 * c[x]) // (1000 * c[x] + 20 * m)) for x, v in w.items() if c[x])
            if score > 0:
                found.append((i is None, i or 0, score))
        found.sort(key=lambda x: (-x[2], x[0], x[1]))
        out += [(row, item, r, None if null else i, s) for r, (null, i, s) in enumerate(found[:k], 1)]
    return out


def divergence(docs, least=30, most=50):
    """Pair and term rows over every kept term of a language, absent ones too."""
    words = [(x or "", s or "", re.findall("[^\x00-@\\[-`{-\x7f]+", lower(t))) for x, s, t in docs]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in words:
        seen[lang].update(set(w))
        counts[lang, source].update(w)
    out = []
    for lang in {x[0] for x in words}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = {g[1]: counts[g] for g in counts if g[0] == lang}
        share = lambda c, kept=kept: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        whole = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[x][t]) for t in kept), x) for x in groups if x != s]
            terms = [(p[s][t] - whole[t], t) for t in kept if groups[s][t] and p[s][t] > whole[t]]
            for part, rows, top in (("pair", pairs, None), ("term", terms, most)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, x, v, r) for r, (v, x) in enumerate(rows[:top], 1)]
    return out
