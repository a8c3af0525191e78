"""Plain versions of what the operators compute."""
import re
from collections import Counter

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def shingles(text, k=5):
    w = words(text)
    return Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else None


def similarity(a, b):
    both = sum(min(a[s], b[s]) for s in a if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def classes(texts, threshold=0.8):
    """Per text the first index of its near-duplicate class, comparing all pairs."""
    s, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and similarity(s[i], s[j]) >= threshold - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(s))]


def contamination(text, items, window=10):
    """(n_words, hit places, item ids) of a text against (id, text) items."""
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(window, len(iw))
        for i in range(len(iw) - n + 1 if iw else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == iw[i:i + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return len(w), hit, found


def quality(text):
    """The base measures: words, word_chars, symbols, dup_lines, repeat_words."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
