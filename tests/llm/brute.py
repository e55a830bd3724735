"""Plain versions of the operators, for comparison."""

import hashlib
import re
from collections import Counter

import numpy as np


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(docs, width=2, percent=80):
    """docs: {id: text}. {id: (n_shingles, component)}."""
    sets = {}
    for i, text in docs.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = components(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def repeats(docs, length):
    """docs: list of texts. Per text: n_bytes, n_removed, n_spans, kept_sha256."""
    data = [(t or "").encode() for t in docs]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                hit[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = bytes(b for b, h in zip(d, hit, strict=False) if not h)
        out.append((len(d), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def contamination(docs, items, n=10):
    """docs: {id: text}, items: [(id, text)]. {id: (n_words, n_hit, items)}."""
    windows = {}
    for item, text in items:
        w = WORDS.findall(fold(text))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in docs.items():
        w, hit, found = WORDS.findall(fold(text)), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own:
                    hit.update(range(i, i + size))
                    found |= own
        out[doc] = (len(w), len(hit), sorted(found))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    def digits(s):
        return [int(c) for c in s if c in "0123456789"]

    def luhn(d):
        return sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group())) % 10 == 0]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out
