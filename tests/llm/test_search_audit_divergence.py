"""Threshold search, filter audit and source divergence against plain versions, and their edge cases."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from commitlens.llm import divergence, filter_audit, threshold_search


def found(df, df_queries, k, **more):
    out = {}
    for r in threshold_search.search(df, df_queries, k, **more).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(v, s) for _, v, s in sorted(x)] for q, x in out.items()}


def plain_search(rows, ids, k, scale=256):
    """rows: (id, vector) of usable ones."""
    whole = {}
    for i, v in rows:
        whole.setdefault(i, []).append(tuple(int(np.floor(scale * x)) for x in v))
    out = {}
    for q in ids:
        if q in whole:
            v = min(whole[q])
            score = {i: max(sum(a * b for a, b in zip(v, w, strict=True)) for w in ws) for i, ws in whole.items() if i != q}
            out[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    return {q: x for q, x in out.items() if x}


@pytest.mark.parametrize("block_rows", [7, 8192])
def test_threshold_search(spark, monkeypatch, block_rows):
    monkeypatch.setattr(threshold_search, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(threshold_search, "QUERY_ROWS", 3)
    monkeypatch.setattr(threshold_search, "SAMPLE", 10)
    rng = np.random.default_rng(4)
    # few distinct values give ties, half of the vectors are copies of one, some ids repeat
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(200, 6)), 1))]
    rows += [(int(i), [0.5, -0.5, 0.25, 0.0, 0.0, 1.0]) for i in range(200, 320)] + rows[:20] + [(5, rows[9][1]), (20, rows[30][1])]
    rows.append((400, [0.0] * 6))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    ids = list(range(0, 401, 20))
    assert found(df, df.where("vec_id % 20 = 0"), 4) == plain_search(rows, ids, 4)


def test_threshold_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [9.0, 9.0]), (8, [-1.0, 0.003])]
    df = spark.createDataFrame([(i, v, 1.0, i) for i, v in rows], "vec_id long, embedding array<double>, score double, query_id long")
    usable = [(i, v) for i, v in rows if i in (0, 1, 2, 8)]
    assert found(df, df, 10) == plain_search(usable, range(9), 10)
    assert threshold_search.search(df.where("false"), df, 5).count() == 0
    assert threshold_search.search(df, df.where("false"), 5).count() == 0
    assert threshold_search.search(df.where("vec_id = 0"), df, 5).count() in (0, 1, 2, 3)
    big = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        threshold_search.search(big, big, 1).collect()


def test_walks_stop_early(spark):
    """On a block where few candidates are near, most are never looked up."""
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(4000, 3))).round(2) * 100 // 1
    x[:20] *= 10
    lists = threshold_search.Lists(x, np.arange(4000))
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                looked.append(len(at))
            return super().__getitem__(at)

    lists.x = x.view(Counted)
    scores, ids = lists.top(np.array([3.0, 2.0, 1.0]), -1, -np.inf, 5)
    want = np.lexsort((np.arange(4000), -(x @ [3.0, 2.0, 1.0])))[:5]
    assert ids.tolist() == want.tolist() and sum(looked) < 400


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    good, toxic = Counter(), Counter()
    for d, q, t in labels:
        good[d] |= q == 1
        toxic[d] |= t == 1
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    parts = {}
    for d, text, lang in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and first[text] < d}
        parts.setdefault(lang or "", []).append(({f for f, x in fails.items() if x}, d is not None and good[d], d is not None and toxic[d]))
    out = []
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for fails, *_ in rows:
                if fails:
                    shapley[next(f for f in order if f in fails)] += 1
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                before = set(order[:s])
                here = [r for r in rows if f in r[0] and not r[0] & before]
                kept = sum(not r[0] & (before | {f}) for r in rows)
                redundant = sum(f in r[0] and bool(r[0] & before) for r in rows)
                out.append((part, "".join(order), s + 1, kept, len(here), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), shapley[f]))
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark):
    rng = random.Random(3)
    words = [f"wörd{i}" for i in range(300)]
    texts = [None, "", "same", " ".join(words[:120]), "A B C #", " ".join(words[:99]), " ".join(words[:100]), "x " * 5000, " ".join(words[:150]) + " $ " + "Q" * 400, "   "]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None])) for i in range(80)]
    docs += docs[:5] + [(None, "same", "en"), (None, None, None), (3, "other text", "en"), (3, "other text", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(60)] + [(4, 1, 0), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 0, "n") for d in docs], "doc_id long, text string, lang string, hash int, bits string").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, marks)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == plain_audit(docs, labels)
    assert filter_audit.audit(df.where("false"), marks).count() == 0
    assert filter_audit.audit(df, marks.where("false")).where("good_lost > 0 or toxic_lost > 0").count() == 0


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(docs, min_docs=30, top=50):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    rows = [(lang or "", source or "", TERM.findall(lower(text))) for _, text, lang, source in docs]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(t for _, _, w in mine for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        counts = {s: Counter() for _, s, _ in mine}
        for _, s, w in mine:
            counts[s].update(w)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        for s in p:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pair, len(pair)), ("term", term, top)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(values[:most])]
    return sorted(out)


@pytest.mark.parametrize(("groups", "terms"), [(2, 5), (128, 4096)])
def test_divergence(spark, groups, terms):
    rng = random.Random(9)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "日本", "\U0001f600x"]
    docs = []
    for i in range(400):
        text = rng.choice([" ", "-", "_1"]).join(rng.choice(vocabulary[: rng.choice([10, 40, 65])]).title() for _ in range(rng.choice([0, 3, 30])))
        docs.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", None, *[f"s{k}" for k in range(7)]])))
    docs += [(1, None, "en", "silent"), (2, "one lonely", "xx", "a"), (3, "", "xx", "b"), (4, "solo", "yy", "only"), *docs[:9]]
    df = spark.createDataFrame([(*d, "t", 1) for d in docs], "doc_id long, text string, lang string, source string, term string, n int").repartition(5)
    got = divergence.diverge(df, min_docs=5, groups=groups, terms=terms)
    want = plain_divergence(docs, 5)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == want
    assert {r[0] for r in want if r[2] == "pair"} >= {"xx", "en", "de", ""}
    assert divergence.diverge(df.where("false")).count() == 0


def test_counts_add_up_over_small_steps(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["a", "a", "b"], "source": ["x", "y", "x"], "text": ["p q P", "q r", None]})
    tables = list(divergence.count_terms(iter([batch, batch])))
    rows = Counter()
    for t in tables:
        for r in t.to_pylist():
            rows[r["lang"], r["source"], r["term"], "n"] += r["n"]
            rows[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    assert rows == {("a", "x", "p", "n"): 4, ("a", "x", "p", "docs"): 2, ("a", "x", "q", "n"): 2, ("a", "x", "q", "docs"): 2, ("a", "y", "q", "n"): 2, ("a", "y", "q", "docs"): 2, ("a", "y", "r", "n"): 2, ("a", "y", "r", "docs"): 2}
