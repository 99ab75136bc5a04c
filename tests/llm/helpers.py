"""Plain versions of what the operators compute."""
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=lambda i: f"s{i % 3}", schema=SCHEMA):
    """Documents from texts, or from (doc_id, text) pairs."""
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", source(k), None if t is None else len(t)) for k, (i, t) in enumerate(pairs)], schema)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def components(texts, k, percent=80):
    """doc_id -> least id reachable, from {doc_id: text}."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    pairs = Counter((a, b) for m in lists.values() for x, a in enumerate(m) for b in m[x + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def repeats(texts, least=50):
    """{(doc_id, start, end, first, first_doc_id)} of the maximal spans, from {doc_id: text}."""
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    held = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            held[tuple(w[k : k + least])].add(i)
    out = set()
    for i, w in words.items():
        for first in (True, False):
            span = None
            for k in range(len(w) - least + 1):
                own = held[tuple(w[k : k + least])]
                if len(own) < 2 or (min(own) == i) != first:
                    continue
                if span and k <= span[1]:
                    span = (span[0], k + least, min(span[2], min(own)))
                else:
                    if span:
                        out.add((i, span[0], span[1], first, span[2]))
                    span = (k, k + least, min(own))
            if span:
                out.add((i, span[0], span[1], first, span[2]))
    return out


def jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 1.0
