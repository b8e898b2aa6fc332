"""Plain models of the text operators, one row at a time."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_sum(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += sum(divmod(2 * d, 10)) if i % 2 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or "0") > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn_sum(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def base_digest(text):
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text))
    return hashlib.sha256(joined.encode()).hexdigest()


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return frozenset()
    size = min(5, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_duplicates(docs):
    """docs: list of (key, text); returns a sorted list of (key, class, links)."""
    docs = [(k, shingles(t)) for k, t in docs if k is not None]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(docs)
    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = docs[i][1], docs[j][1]
        if a and b and len(a & b) * 10 >= len(a | b) * 8:
            links[i] += 1
            links[j] += 1
            parent[root(j)] = root(i)
    classes = {}
    for i, (k, _) in enumerate(docs):
        classes[root(i)] = min(k, classes.get(root(i), k))
    return sorted((k, classes[root(i)], links[i]) for i, (k, _) in enumerate(docs))


def edit_distance(pattern, text):
    """Fewest edits to turn the pattern into some part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def crc(key):
    return zlib.crc32(str(key).encode())


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def language_model(docs, mu, steps):
    """docs: list of (key, text); returns {key: (tokens, known, N, base, score)}."""
    learned = [tokens(t) for k, t in docs if k is not None and crc(k) % 10]
    words = Counter(t for d in learned for t in d)
    pairs = Counter(p for d in learned for p in zip(["<s>", *d], d, strict=False))
    n, v, starts = words.total(), len(words), len(learned)
    uni = lambda w: (words[w] + 0.1) / (n + 0.1 * (v + 1))
    out = {}
    for k, text in docs:
        own, base, score = tokens(text), 0.0, 0.0
        for c, w in zip(["<s>", *own], own, strict=False):
            seen = starts if c == "<s>" else words[c]
            log = math.log10((pairs[c, w] + mu * uni(w)) / (seen + mu))
            score += -round(-log * steps) / steps if pairs[c, w] else log
            base += math.log10(uni(w))
        out[k] = (len(own), sum(words[w] > 0 for w in own), n, base, score)
    return out


def posteriors(docs, labels, domains, most_words, least_z):
    """docs: (key, text), labels: {key: domain}; {key: probabilities} of a Bayes classifier on word presence."""
    own = {}
    for key, text in docs:
        words = re.split(r"[\s.,;:?()\"']+|(?<=[^!])(?=!)", (text or "").lower(), flags=re.ASCII)
        own[key] = {w for w in words if w}
    known = [(labels[k], own[k]) for k, _ in docs if labels.get(k) in domains]
    size = [sum(d == name for d, _ in known) for name in domains]
    counts = {}
    for domain, words in known:
        for word in words:
            counts.setdefault(word, [0] * len(domains))[domains.index(domain)] += 1
    chosen = []
    for word, found in counts.items():
        share = sum(found) / max(1, len(known))
        lift = max(abs(c - share * n) / math.sqrt(share * n + 1) for c, n in zip(found, size, strict=True))
        held = [min((c + share) / (n + 1), 1 - 1e-6) for c, n in zip(found, size, strict=True)]
        if lift >= least_z:
            chosen.append((-lift, word, held))
    table = {word: held for _, word, held in sorted(chosen)[:most_words]}
    out = {}
    for key, words in own.items():
        logs = []
        for i, n in enumerate(size):
            log = math.log((n + 1) / (len(known) + len(domains)))
            log += sum(math.log(held[i] if word in words else 1 - held[i]) for word, held in table.items())
            logs.append(log)
        raised = [math.exp(x - max(logs)) for x in logs]
        out[key] = [x / sum(raised) for x in raised]
    return out
