"""Plain versions of operators, over rows in memory."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa

from quillrank.llm import kernels as K
from quillrank.llm.span_dedup import ALONE_WORDS, AROUND, LONG_WORDS, OWN_WORDS, RUN_WORDS
from quillrank.llm.toxicity_knn import BEGINNING, NEAREST, NEIGHBOURS, SMOOTHING

from llm_words import words


def terms_of(text: str | None) -> Counter:
    low = "".join(c.lower() if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text or "")
    out = Counter()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", low.encode()):
        out[w] += 1
        if len(w) > BEGINNING:
            out[w[:BEGINNING], "..."] += 1
    return out


def plain_toxicity(rows, labels):
    """By doc_id: the score, and the cosines of the nearest examples. ``rows`` are (doc_id, text), ids once each; ``labels`` 0 or 1 by doc_id, few enough to be examples all."""
    texts = {d: terms_of(t) for d, t in rows}
    examples = {d: y for d, y in labels.items() if texts.get(d)}
    df = Counter(t for found in texts.values() for t in found)
    with_term = [Counter(t for d, y in examples.items() if y == k for t in texts[d]) for k in (0, 1)]
    stands = [sum(y == k for y in labels.values()) / sum(y == k for y in examples.values()) for k in (0, 1)]
    weight = {t: math.log(1 + len(texts) / df[t]) * math.log2(2 + stands[1] * with_term[1][t] / max(1, stands[0] * with_term[0][t])) for t in with_term[0] | with_term[1]}

    def unit(found):
        x = {t: (1 + math.log(k)) * weight[t] for t, k in found.items() if t in weight}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / length for t, v in x.items()}

    entries = {}
    for d, y in sorted(examples.items()):
        entries.setdefault(tuple(sorted(texts[d].items(), key=str)), []).append(y)
    known = [(unit(dict(key)), stands[1] * same.count(1), stands[0] * same.count(0)) for key, same in entries.items()]
    prior = sum(k[1] for k in known) / sum(k[1] + k[2] for k in known)
    out = {}
    for d, found in texts.items():
        own = unit(found)
        cosines = sorted(((sum(v * x.get(t, 0) for t, v in own.items()), ones, zeros) for x, ones, zeros in known), key=lambda e: -e[0])
        near = [e for e in cosines[:NEIGHBOURS] if e[0] > 1e-12]
        votes = [(ones + zeros) / (NEAREST + 1 - c) ** 2 for c, ones, zeros in near]
        rates = [ones / (ones + zeros) for _, ones, zeros in near]
        out[d] = (sum(v * x for v, x in zip(votes, rates, strict=True)) + SMOOTHING * prior) / (sum(votes) + SMOOTHING), [e[0] for e in near]
    return out


def lowered(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]


def shingle_set(text, n):
    w = lowered(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, n, percent):
    sets = [(d, shingle_set(t, n)) for d, t in rows]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(root(i), []).append(d)
    return sorted((d, len(s), min(groups[root(i)])) for i, (d, s) in enumerate(sets))


def plain_sentences(text):
    """(words, text up to the next sentence) of each sentence; and what comes before the first."""
    found, at = [], 0
    for word in words(text):
        begin = text.index(word, at)
        gap = text[at:begin]
        if not found:
            head, found = gap, [[[word], "", True]]
        else:
            found[-1][1] += gap
            new_line = "\n" in gap
            if new_line or found[-1][0][-1][-1] in ".!?":
                found.append([[word], "", new_line])
            else:
                found[-1][0].append(word)
        found[-1][1] += word
        at = begin + len(word)
    if not found:
        return text, []
    found[-1][1] += text[at:]
    merged = []
    for w, t, new_line in found:
        if merged and not new_line and len(w) < OWN_WORDS:
            merged[-1] = (merged[-1][0] + w, merged[-1][1] + t)
        else:
            merged.append((w, t))
    return head, [piece for w, t in merged for piece in plain_pieces(w, t)]


def word_hash(w):
    return int(K.hash_words(block := next(K.blocks(pa.array([w]))), K.words(block), lower=True)[0])


def plain_pieces(w, t):
    """A long sentence in pieces."""
    if len(w) <= LONG_WORDS:
        return [(w, t)]
    hashes = [word_hash(x) for x in w] + [0]
    with np.errstate(over="ignore"):
        pair = [int(K.mix(np.array([a], K.U) * K.BASE + K.U(b))[0]) for a, b in zip(hashes, hashes[1:], strict=False)]
    lowest = lambda i: all(pair[i] < x for x in pair[max(0, i - AROUND) : i]) and all(pair[i] <= x for x in pair[i + 1 : i + 1 + AROUND])
    out, at = [[[], ""]], 0
    for i, word in enumerate(w):
        if i and lowest(i):
            out.append([[], ""])
        begin = t.index(word, at)
        # White space goes with the word before it.
        (out[-1] if out[-1][0] or len(out) == 1 else out[-2])[1] += t[at:begin]
        out[-1][0].append(word)
        out[-1][1] += word
        at = begin + len(word)
    out[-1][1] += t[at:]
    return [tuple(x) for x in out]


def plain_dedup(rows, run_words=RUN_WORDS, alone_words=ALONE_WORDS):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc_id] = None
            continue
        head, parts = plain_sentences(text)
        low = [tuple(lowered(" ".join(w))) for w, _ in parts]
        gone = set()
        n = len(low)
        enough = lambda i, j: j - i >= 2 and sum(map(len, low[i:j])) >= run_words
        runs = {(i, j) for i in range(n) for j in [next((j for j in range(i + 2, n + 1) if enough(i, j)), None)] if j}
        ends = {j for _, j in runs}
        runs |= {(i, j) for j in range(1, n + 1) if j not in ends for i in [next((i for i in range(j - 2, -1, -1) if enough(i, j)), None)] if i is not None}
        runs |= {(i, i + 1) for i in range(n) if len(low[i]) >= alone_words}
        for i, j in sorted(runs):
            name = tuple(low[i:j])
            if name in seen:
                gone.update(range(i, j))
            seen.add(name)
        out[doc_id] = head + "".join(t for i, (_, t) in enumerate(parts) if i not in gone)
    return out


def plain_mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """(text, source, place) by (doc_id, epoch) of the mix of (doc_id, text, source) rows, ids once each."""
    size = {d: len(words(t)) for d, t, _ in rows}
    total = Counter()
    for d, _, s in rows:
        total[s] += size[d]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), Fraction(str(share)) * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * total[s] <= level * weight[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        goal |= {s: most * total[s] for s in full}
        left -= sum(goal[s] for s in full)
        open_ -= full
    out = {}
    for s in names:
        budget = math.floor(goal[s] + Fraction(1, 2))
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
        rest = budget - (budget // total[s]) * total[s] if total[s] else 0
        for d, t, _ in mine:
            if not size[d]:
                continue
            taken = budget // total[s] * size[d] + min(size[d], rest)
            rest -= min(size[d], rest)
            for epoch in range(-(-taken // size[d])):
                out[d, epoch] = t if (epoch + 1) * size[d] <= taken else " ".join(words(t)[: taken - epoch * size[d]])
    return out
