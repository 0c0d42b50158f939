"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def repeats(docs, width=50):
    """doc_id -> (n_words, n_removed, kept_sha256); docs: distinct (doc_id, text)."""
    words = {d: SPACE_WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def contamination(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = ALNUM_WORD.findall(lower(text))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = ALNUM_WORD.findall(lower(t)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def linked(docs, words=4, num=85, den=100):
    """doc_id -> (n_shingles, component_id)."""
    sets = {}
    for d, t in docs:
        w = SPACE_WORD.findall(lower(t))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_pii(text):
    """Sorted (start, rank, end) of all base spans."""
    spans = []
    for rank, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                spans.append((m.start(), rank, m.end()))
    return sorted(spans)


def telling_terms(docs, min_support=3, generalise_at=0.7, remove_at=0.9):
    """doc -> all (start, rank, end), base spans and telling terms, by counting every pair; docs: (doc_id, text) of distinct rows."""
    import math
    from collections import Counter, defaultdict

    import regex

    term = regex.compile(r"(?<!\p{L})\p{L}{4,}+")
    docs = [(d, t or "") for d, t in docs]
    base = {d: base_pii(t) for d, t in docs}
    text, n = dict(docs), len(docs)
    entities = {d: {(rank, text[d][s:e].lower()) for s, rank, e in spans} for d, spans in base.items()}
    terms = {d: {m.lower() for m in term.findall(t)} for d, t in docs}
    n_entity, n_term = Counter(x for v in entities.values() for x in v), Counter(x for v in terms.values() for x in v)
    both = Counter((e, t) for d in text for e in entities[d] for t in terms[d])
    action = defaultdict(lambda: 9)
    for (e, t), k in both.items():
        if k >= min_support and n_entity[e] < n:
            x = math.log(k * n / (n_entity[e] * n_term[t])) / math.log(n / n_entity[e])
            if x >= generalise_at:
                action[e, t] = 4 if x >= remove_at else 5
    out = {}
    for d, t in docs:
        spans = set(base[d])
        for m in term.finditer(t):
            if not any(s < m.end() and m.start() < e for s, _, e in base[d]):
                best = min((action[e, m[0].lower()] for e in entities[d] if (e, m[0].lower()) in action), default=9)
                if best < 9:
                    spans.add((m.start(), best, m.end()))
        out[d] = sorted(spans)
    return out
