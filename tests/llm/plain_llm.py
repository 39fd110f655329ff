"""Brute-force versions of the operators, on lists of dicts."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import regex
import xxhash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate(AZ)


# Near-duplicates: all pairs


def shingles(text, n=5):
    words = WORDS.findall(lower(text))
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def similarity(a, b):
    def weight(c):
        return 1 + math.log(c)

    shared = sum(min(weight(a[x]), weight(b[x])) for x in a.keys() & b.keys())
    return shared / (sum(map(weight, a.values())) + sum(map(weight, b.values())) - shared)


def near_classes(rows, limit=0.8):
    """For each row the index of its class."""
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= limit:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(rows))]


def first_of_classes(rows):
    """The rows that stay: of each class one with the smallest id, ids before null."""
    classes = defaultdict(list)
    for row, c in zip(rows, near_classes(rows), strict=True):
        classes[c].append(row)
    return [min(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for rows in classes.values()]


# Mixing


def targets(rows):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(SPACED.findall(r["text"] or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, left = {}, dict(weights)
    while True:
        rest = sum(sizes.values()) - sum(capped.values())
        level = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if level[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **level}, sizes, {s: i for i, s in enumerate(names)}
        for s in over:
            capped[s] = 3.0 * sizes[s]
            del left[s]


def draw(doc_id):
    return hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15]


def mix(rows):
    """Copies taken of each row, by the order of finish times."""
    target, sizes, rank = targets(rows)
    lines = defaultdict(list)
    for i, r in enumerate(rows):
        lines[r["source"]].append((draw(r["doc_id"]), r["doc_id"] if r["doc_id"] is not None else -1, len(SPACED.findall(r["text"] or "")), i))
    turns, copies = [], [0] * len(rows)
    for source, line in lines.items():
        done = 0
        for h, doc_id, size, i in sorted(line):
            done += size
            for turn in range(3):
                time = (turn * sizes[source] + done) / target[source] if target[source] > 0 else 0.0
                turns.append((time, rank[source], h, doc_id, turn, size, i))
    taken, budget = 0, sum(sizes.values())
    turns.sort()
    for _, group in itertools.groupby((t for t in turns if t[5] and t[0] <= 4), key=lambda t: t[:5]):
        group = list(group)
        taken += sum(t[5] for t in group)
        if taken > budget:
            break
        last = group[-1][:5]
        for t in group:
            copies[t[6]] += 1
    else:
        last = (math.inf,)
    if budget:
        for t in turns:
            if not t[5] and t[4] == 0 and t[:5] <= last:
                copies[t[6]] = 1
    else:
        copies = [1] * len(rows)
    return copies


# Benchmark templates

NAME = regex.compile(r"\p{Lu}(?<=[\p{L}\p{N},;:] .)\p{Ll}+(?: \p{Lu}\p{Ll}+)*")
NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"


def tokens(text, units):
    """(kind, value): kind is None for words, else p, n or u."""
    unit = rf"(?:(?i:{'|'.join(sorted(units, key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{M}}])|[%€$£°])"
    marks: list[tuple[str, str]] = []

    def mark(kind, value):
        marks.append((kind, value.lower()))
        return f" {len(marks) - 1:c} " if False else f" {chr(0xF0000 + len(marks) - 1)} "

    text = NAME.sub(lambda m: mark("p", m.group()), text or "")
    text = regex.sub(f"({NUMBER})( ?)({unit})", lambda m: mark("n", m.group(1)) + mark("u", m.group(3)), text)
    text = regex.sub(NUMBER, lambda m: mark("n", m.group()), text)
    out = []
    for m in regex.finditer(r"(.)|[\p{L}\p{M}]+", text):
        out.append(marks[ord(m.group(1)) - 0xF0000] if m.group(1) else (None, m.group().lower()))
    return out


def leaks(rows, items, units, window=8, enough=13, literals=4):
    """{(doc_id, item_id): item tokens found}."""
    found = {}
    for item in items:
        ours = tokens(item["text"], units)
        width = min(window, len(ours))
        if not width:
            continue
        for row in rows:
            theirs = tokens(row["text"], units)
            shape = [k or v for k, v in theirs]
            own = [k or v for k, v in ours]
            shifts = defaultdict(set)
            places = defaultdict(list)
            for j in range(len(own) - width + 1):
                places[tuple(own[j : j + width])].append(j)
            for i in range(len(shape) - width + 1):
                for j in places.get(tuple(shape[i : i + width]), ()):
                    shifts[i - j].update(range(j, j + width))
            covered = set()
            for shift, at in shifts.items():
                pairs = [(ours[j], theirs[j + shift]) for j in sorted(at)]
                slots = {(a, b) for a, b in pairs if a[0]}
                names = {(a, b) for a, b in slots if a[0] == "p"}
                one = len({a for a, _ in slots}) == len(slots) and len({b for _, b in names}) == len(names)
                plain = sum(a[0] is None for a, _ in pairs)
                if one and (plain >= literals or all(a == b for a, b in pairs)):
                    covered |= at
            if len(covered) >= min(enough, len(ours)):
                found[row["doc_id"], item["item_id"]] = len(covered)
    return found


# Sharding


def smallest_capacity(sizes, shards):
    """Least capacity of a contiguous partition, by trying all last cuts."""
    best = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        new = [0] + [math.inf] * len(sizes)
        for end in range(1, len(sizes) + 1):
            total = 0
            for begin in range(end - 1, -1, -1):
                total += sizes[begin]
                new[end] = min(new[end], max(best[begin], total))
        best = new
    return best[-1]


def shard_loads(rows, shards):
    """Sorted byte sums of the groups with shards of their own, then the least capacity of the others."""
    groups = Counter()
    for r in rows:
        key = "-" if r["text"] is None else hashlib.sha256(r["text"].encode()).hexdigest()
        groups[key] += len((r["text"] or "").encode()) + 16
    own, rest, left = [], dict(groups), shards
    for key in sorted(groups, key=lambda k: (-groups[k], k)):
        if left == 1 or groups[key] * left <= sum(rest.values()):
            break
        own.append(rest.pop(key))
        left -= 1
    return own, smallest_capacity([rest[k] for k in sorted(rest)], left) if rest else 0, left


# Periodic runs: every period, every stretch


def runs(words, least=24, power=3):
    """(start, length, period) of the stretches with that smallest period that no neighbour extends."""
    found, n = [], len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(least, power * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((i, len(part), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


# Clusters: all distances anew in every round


def clusters(rows, k=8, rounds=10):
    """(id, cluster, distance, inertia of the cluster, inertia, centroid) for (id, components)."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [math.floor(Fraction(v) * 1024) for v in x]))
    first = sorted(kept, key=lambda r: ("none" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), " ".join(map(str, r[1]))))[:k]
    centroids = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for c in set(of):
            own = [x for (_, x), o in zip(kept, of, strict=True) if o == c]
            centroids[c] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    of = [nearest(x) for _, x in kept]
    total = Counter()
    for d, c in of:
        total[c] += d
    return [(i, c, d, total[c], sum(total.values()), ",".join(map(str, centroids[c]))) for (i, _), (d, c) in zip(kept, of, strict=True)]


# SimHash: all pairs


def fingerprint(text, n=4):
    words = SPACED.findall(lower(text))
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def hamming_classes(values, near):
    """For each value one value of its component."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= near:
            root[find(b)] = find(a)
    return {v: find(v) for v in values}
