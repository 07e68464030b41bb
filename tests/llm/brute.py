"""Plain Python versions of the text operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def near_duplicates(rows, threshold=85):
    """rows: (doc_id, text); per row (shingles, component)."""
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    chars, symbols, dups = sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    capitals, letters = sum("A" <= c <= "Z" for c in text), sum(any(c.isalpha() for c in x) for x in w)
    kept = (not failed and symbols * 10 <= len(w) and (dups < 3 or dups * 10 <= len(lines) * 3) and len(w) * 3 <= chars <= len(w) * 12
            and (len(text) - capitals) * 2 >= len(text) and letters * 10 >= len(w) * 7)
    return len(w), chars, symbols, dups, len(covered), failed, kept


def drop_lines(docs, min_lines=3, min_words=20):
    """docs: distinct (doc_id, text) in order; the texts without later copies of repeated runs, and lines removed."""
    seqs = []
    for _, text in docs:
        lines = (text or "").split("\n")
        seqs.append([(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")])
    seen, out = set(), []
    for (_, text), seq in zip(docs, seqs):
        gone = set()
        for p in range(len(seq)):
            for n in range(1, min_lines + 1):
                run = tuple(x for _, x in seq[p:p + n])
                if len(run) < n or (n < min_lines and sum(len(words(x)) for x in run) < min_words):
                    continue
                if run in seen:
                    gone |= {seq[p + k][0] for k in range(n)}
                seen.add(run)
        kept = [x for i, x in enumerate((text or "").split("\n")) if i not in gone]
        out.append((text if not gone else "\n".join(kept), len(gone)))
    return out


def distance(pattern, text):
    """Least edits from pattern to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        diagonal, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            diagonal, row[j] = row[j], min(diagonal + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def leaks(text, items, rate=0.2, least=8):
    """(item_id, distance) of items within their budget."""
    w = words((text or "").translate(LOWER))
    found = []
    for item, body in items:
        p = words((body or "").translate(LOWER))
        if p and w:
            d = distance(p, w)
            if d <= (int(len(p) * rate + 1e-9) if len(p) >= least else 0):
                found.append((item, d))
    return sorted(found)


def repeated_bytes(docs, width=100):
    """docs: distinct (doc_id, text) in order; (bytes, removed, runs, digest) each."""
    seen, out = set(), []
    for _, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if b[i:i + width] in seen:
                gone[i:i + width] = b"\1" * width
            else:
                seen.add(b[i:i + width])
        left = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def targets(sizes):
    """Target per source by sharing again what stopped sources can't take."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(3 * sizes[s] for s in stopped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3.0 * sizes[s]) for s in order}
        stopped |= over


def mix(docs, block=4, seed="mix-1"):
    """docs: (doc_id, source, text); taken words per doc by walking the sources' streams word by word."""
    size = {i: len(words(t)) for i, (_, _, t) in enumerate(docs)}
    by = defaultdict(list)
    for i, (d, s, _) in enumerate(docs):
        by[s].append(i)
    sizes = {s: sum(size[i] for i in rows) for s, rows in by.items()}
    target = targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    total = sum(target[s] for s in order)
    seats = Counter()
    for _ in range(int(total / block + 0.5)):
        best = max((s for s in order if target[s] > 0), key=lambda s: (target[s] / (2 * seats[s] + 1), -order.index(s)))
        seats[best] += 1
    taken = Counter()
    key = lambda i: (hashlib.md5(f"{seed}:{'null' if docs[i][0] is None else docs[i][0]}".encode()).hexdigest(), docs[i][0] or 0, size[i])
    for s, rows in by.items():
        stream = [i for i in sorted(rows, key=key) for _ in range(size[i])]
        if stream:
            origin = int(hashlib.md5(f"{seed}/{s or ''}".encode()).hexdigest()[:12], 16) % max(-(-len(stream) // block), 1) * block
            for k in range(min(seats[s] * block, 3 * len(stream))):
                taken[stream[(origin + k) % len(stream)]] += 1
    return [(size[i], sizes[s], target[s], taken[i]) for i, (_, s, _) in enumerate(docs)]
