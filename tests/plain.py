"""The operators' rules once more, as plain loops over Python values, for tests and baselines."""

import json
import math
import re


def counting_matches(text, patterns, keywords, window=120):
    """Matches of all patterns without a keyword among the ``window`` characters before them."""
    found = [m for p in patterns for m in re.finditer(p, text or "", re.IGNORECASE)]
    context = {m: text[max(0, m.start() - window) : m.start()].lower() for m in found}
    return [m.group() for m in found if not any(k in context[m] for k in keywords)]


def excerpt(text):
    return text[:300].replace("\n", " ")


def scan(text, phrases):
    """(phrase, start, end, severity) by looking at every position."""
    hits = []
    for phrase in phrases:
        at, size = 0, len(phrase)
        while at + size <= len(text):
            if text[at : at + size].lower() == phrase.lower():
                hits.append((phrase, at, at + size, [1, 1, 2, 3, 4, 5][min(size // 10, 5)]))
                at += size
            else:
                at += 1
    return hits


def redact(text, phrases, token="[REDACTED]"):
    for phrase in sorted(phrases, key=len, reverse=True):
        text = re.compile(re.escape(phrase), re.IGNORECASE).sub(lambda _: token, text)
    return text


def record_text(line, keys=("text", "content", "instruction", "prompt"), fallback="first"):
    """The text of a JSON line, or None; containers are left to the tests' own expectations."""
    try:
        value = json.loads(line)
    except ValueError:
        return line.strip() or None
    if type(value) is not dict:
        return f"{value}"
    chosen = [f"{value[k]}" for k in keys if value.get(k)]
    chosen = chosen or [v for v in value.values() if type(v) is str and v.strip()]
    if fallback == "join" and not any(value.get(k) for k in keys):
        chosen = [" ".join(chosen)] if chosen else []
    return chosen[0] if chosen else None


def first_occurrences(keys):
    seen, unique, duplicates = set(), [], []
    for position, key in enumerate(keys):
        (duplicates if key in seen else unique).append(position)
        seen.add(key)
    return unique, duplicates


def words(text):
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def vocabulary(texts, size):
    counts = {}
    for text in texts:
        for word in words(text):
            counts[word] = counts.get(word, 0) + 1
    ranked = sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:size]
    return {word: i + 2 for i, (word, _) in enumerate(ranked)}


def encoded(text, vocab, length):
    ids = [vocab.get(w, 1) for w in words(text)[:length]]
    gap = length - len(ids)
    return ids + [0] * gap, [1] * len(ids) + [0] * gap


def nearest(vectors, queries, k):
    """(query, rank, doc) triples by squared distance, then id."""
    out = []
    for q, a in queries:
        ranked = sorted((math.fsum((x - y) ** 2 for x, y in zip(a, b)), d) for d, b in vectors)
        out += [(q, rank, d) for rank, (_, d) in enumerate(ranked[:k], 1)]
    return out


def phrase_places(texts, phrases):
    """(text number, phrase, first word) by trying every phrase at every word."""
    split = lambda text: re.findall("[a-z0-9]+", (text or "").lower())
    listed = {tuple(split(p)) for p in phrases} - {()}
    found = []
    for number, text in enumerate(texts):
        own = split(text)
        for phrase in listed:
            n = len(phrase)
            found += [(number, " ".join(phrase), i) for i in range(len(own) - n + 1) if tuple(own[i : i + n]) == phrase]
    return sorted(found)
