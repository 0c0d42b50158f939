import base64
import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from commitlens.llm import byte_bpe, decontaminate, jaccard_join, pii, sharding, substring_dedup, toxicity
from commitlens.llm.common import pack, unpack
from commitlens.llm.fm_index import FMIndex, Wavelet, suffix_order

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "É") for b in ("ra", "si", "xo", "77")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty, odd white space and one very long text."""
    rng = random.Random(1)
    base = [text(rng, n) for n in (3, 8, 60, 120, 200, 400)]
    near = base[4].split()
    near[100] = "other"
    passage = text(rng, 70)
    docs = [*base, base[3], base[4], " ".join(near), passage, text(rng, 20) + "\n" + passage + "\t" + text(rng, 30), None, "", " \n\x0b ", "A", "a", text(rng, 30_000)]
    return [(100 - i, t) for i, t in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1.5, "y") for i, t in rows], "doc_id long, text string, node string, score double, text_key string")


EMPTY = "doc_id long, text string"


def test_shards(docs, rows):
    got = sharding.byte_shards(docs, 4).collect()
    assert len(got) == len(rows)
    sizes = {d: len((t or "").encode()) + 1 for d, t in rows}
    per = {}
    for r in got:
        assert r["size"] == sizes[r["id"]]
        per.setdefault(r["shard"], []).append(r)
    for part in per.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    order = sorted(got, key=lambda r: r["id"])
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in order)
    total, largest = sum(sizes.values()), max(sizes.values())
    assert all(abs(sum(r["size"] for r in part) - total / 4) <= largest for part in per.values())


def test_substring_dedup(docs, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs, 50).collect()}
    assert got == brute.repeats(rows)
    assert sum(v[1] > 0 for v in got.values()) >= 4


def test_substring_dedup_of_a_passage_in_most_documents(spark):
    rng = random.Random(12)
    passage = text(rng, 75)
    rows = [(rng.randrange(10**6), f"{text(rng, rng.randint(0, 60))} {passage if rng.random() < 0.8 else ''} {text(rng, rng.randint(0, 60))}") for _ in range(300)]
    rows = list({d: (d, t) for d, t in rows}.values())
    rows.append((10**7, passage + " " + passage + " ja" * 300))
    df = spark.createDataFrame(rows, EMPTY).repartition(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df, 50).collect()}
    assert got == brute.repeats(rows)


def test_substring_dedup_of_many_rows_without_id(spark):
    """Rows without an id are dealt over the groups by their texts and still come after every id; equal ones never before one another."""
    rng = random.Random(11)
    passage = text(rng, 60)
    rows = [(4, passage)] + [(None, f"{text(rng, 5)} {passage} own{k}") for k in range(40)] * 2
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, EMPTY).repartition(6), 50).collect())
    assert got == sorted([(4, len(passage.split()), 0)] + [(-1, len(t.split()), len(passage.split())) for _, t in rows[1:]])
    keys = np.arange(1000, dtype=np.int64)
    assert len(set(substring_dedup.groups_of(np.full(1000, substring_dedup.LAST_ID), keys, 16).tolist())) == 16
    assert len(set(substring_dedup.groups_of(np.full(1000, 3), keys, 16).tolist())) == 1


def test_substring_dedup_null_and_repeated_ids(spark):
    t = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (7, t), (7, "else")], EMPTY)
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.remove_repeats(df, 50).collect())
    assert got == [(-1, 60), (5, 0), (5, 0), (7, 0), (7, 60)]


def test_jaccard_join(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(docs, 4, 85, 100).collect()}
    assert got == brute.linked(rows)


def test_jaccard_join_finds_all_links_at_the_threshold(spark):
    rng = random.Random(9)
    docs = []
    for _ in range(12):
        words = [str(rng.randrange(10**6)) for _ in range(rng.choice([9, 14, 30, 80, 150]))]
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = str(rng.randrange(10**6))
            docs.append((len(docs), " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(spark.createDataFrame(docs, EMPTY), 3, 80, 100).collect()}
    assert got == brute.linked(docs, 3, 80, 100)


def test_jaccard_join_of_short_texts_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", 4)
    rng = random.Random(4)
    docs = []
    for _ in range(40):
        words = [str(rng.randrange(60)) for _ in range(rng.randint(5, 22))]
        for _ in range(5):
            w = list(words)
            for _ in range(rng.randint(0, 2)):
                w.insert(rng.choice([0, len(w)]), str(rng.randrange(60)))
            docs.append((len(docs), " ".join(w)))
    for words, num in ((2, 80), (4, 85), (1, 85)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link(spark.createDataFrame(docs, EMPTY), words, num, 100).collect()}
        assert got == brute.linked(docs, words, num, 100)


def test_signatures_share_one_for_every_similar_pair():
    rng = np.random.default_rng(2)
    for size in (7, 8, 12, 15, 20, 28, 40, 60, 300):
        for _ in range(60):
            a = np.sort(rng.integers(0, 2**63, size, dtype=np.uint64))
            most = size * 15 // 100
            drop, add = rng.integers(0, most // 2 + 1), rng.integers(0, most // 2 + 1)
            b = np.sort(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            of, sig = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85, 100)
            assert set(sig[of == 0]) & set(sig[of == 1])


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    codes = np.concatenate([np.concatenate([rng.integers(1, 5, rng.integers(1, 30)), [0]]) for _ in range(40)])
    codes = np.concatenate([[0], codes])
    order = suffix_order(codes)
    assert sorted(order) == list(range(len(codes)))
    index = FMIndex(codes, 3)
    patterns = [tuple(rng.integers(1, 5, n)) for n in (1, 2, 3, 4, 6) for _ in range(10)]
    matrix = np.zeros((len(patterns), 6), np.int64)
    for i, p in enumerate(patterns):
        matrix[i, 6 - len(p) :] = p
    lo, hi = index.search(matrix, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        expected = [i for i in range(len(codes) - len(p) + 1) if tuple(codes[i : i + len(p)]) == p]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == expected


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 8, 500)
    w, at, c = Wavelet(s, 3), rng.integers(0, 501, 200), rng.integers(0, 8, 200)
    assert w.rank(c, at).tolist() == [int((s[:p] == x).sum()) for x, p in zip(c, at, strict=True)]
    places = rng.integers(0, 500, 100)
    code, rank = w.access(places)
    assert code.tolist() == s[places].tolist() and rank.tolist() == [int((s[:p] == s[p]).sum()) for p in places]


def test_decontamination(spark, docs, rows):
    items = [(1, rows[5][1]), (2, "Kara losi"), (2, "Kara losi"), (3, None), (4, ""), (10, rows[3][1][:200].upper())]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(docs, benchmark).collect()
    assert sorted((r["doc_id"], r["n_words"], sum(b - a for a, b in r["spans"]), len(r["items"]), brute.sha(",".join(r["items"])), bool(r["spans"])) for r in got) == sorted(brute.contamination(rows, items))
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, benchmark).collect()}
    untouched = [(d, t) for (d, t), x in zip(rows, brute.contamination(rows, items), strict=True) if not x[2]]
    assert all(cleaned[d] == t for d, t in untouched)
    assert all(not r[2] for r in brute.contamination([(d, t) for d, t in cleaned.items() if d == rows[5][0]], items))


def test_decontamination_in_parts(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 30)
    items = [(i, rows[k][1]) for i, k in enumerate((2, 3, 4))]
    got = decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], sum(b - a for a, b in r["spans"]), len(r["items"])) for r in got) == sorted((x[0], x[2], x[3]) for x in brute.contamination(rows, items))


def test_decontamination_in_parts_cuts_as_in_one(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame([(i, rows[k][1]) for i, k in enumerate((2, 3, 4))], "item_id long, text string")
    once = decontaminate.clean(docs, items)
    whole = sorted(map(str, once.collect()))
    monkeypatch.setattr(decontaminate, "PART_WORDS", 30)
    parts = decontaminate.clean(docs.union(docs), items)
    assert parts.columns == once.columns == docs.columns
    assert sorted(map(str, parts.collect())) == sorted(whole * 2)


def test_decontamination_tells_words_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "word_hashes", lambda raw, starts, ends: (ends - starts).astype(np.uint64))
    windows = decontaminate.Windows([("a", "one two three"), ("b", "two one three"), ("c", "six ten seven")], 3)
    text = np.frombuffer(b"six two one three one two three ten six eight", np.uint8)
    starts, ends, word_at = decontaminate.word_spans(text, np.array([0, len(text)]), decontaminate.LETTER_OR_DIGIT)
    found, which = decontaminate.shard_hits(text, starts, ends, word_at, windows)
    assert sorted((p, windows.items[k][0]) for p, k in zip(found.tolist(), which.tolist(), strict=True)) == [(1, "b"), (4, "a")]


PERSONAL = [
    "mail a.b+c@x-y.example.com, then x@y.zz_foo@bar.com and a@b",
    "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5 and 001.002.003.255.",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 1 2 3",
    "call +1 (456) 555-2186 or +12 or +1 234 567 890 123 456 789",
    "é 10.0.0.1 ü me@home.org 378282246310005", None, "", "9" * 3000, "a" * 3000 + "@", "x@" + "a." * 500,
]


def test_base_pii(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), EMPTY)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(df).collect()}
    assert got == {i: brute.base_pii(t) for i, t in enumerate(PERSONAL)}


def test_disclosing_terms(spark):
    texts = [f"Our colleague Montgomery writes from boss@corp.example.com about item{'abcdefghij'[i]}" for i in range(5)]
    texts += [f"Nothing about colleagues here, writes somebody about item{'abcdefghij'[i % 10]}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    found = pii.find(df)
    for r in found.collect():
        words = {texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["rank"] >= 4}
        assert words == ({"Montgomery", "colleague", "from"} if r["doc_id"] < 5 else set())
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df, found).collect()}
    assert clean[0] == "Our   writes  [EMAIL] about itema" and clean[9] == texts[9]


def test_many_matches_in_one_text(spark):
    texts = ["1.2.3.4 " * 60_000, "née a@b.cd, " * 20_000 + "x" * 3000 + " a@b.cd " + "y " * 2000, " ".join(f"+49 30 {i:07d}.q{i}@x.org" for i in range(10_000))]
    df = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    found = pii.find(df)
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()} == {i: brute.base_pii(t) for i, t in enumerate(texts)}
    clean = [r["text"] for r in pii.sanitise(df, found).orderBy("doc_id").collect()]
    assert clean == ["[IP] " * 60_000, texts[1].replace("a@b.cd", "[EMAIL]"), " ".join(["[PHONE][EMAIL]"] * 10_000)]


def test_overlapping_personal_data_is_cut_to_its_end(spark):
    texts = {
        "pay 4111 1111 1111 1111foo@x.com today": "pay [CARD][EMAIL] today",
        "call +49 30 1234567.ann@x.com now": "call [PHONE][EMAIL] now",
        "in 4111111111111111@x.com only": "in [EMAIL] only",
        "a@x.com b": "[EMAIL] b",
    }
    df = spark.createDataFrame(list(enumerate(texts)), EMPTY)
    assert [r["text"] for r in pii.sanitise(df, pii.find(df)).orderBy("doc_id").collect()] == list(texts.values())


def disclosing(docs, min_support=3, generalise_at=0.7, remove_at=0.9):
    """(doc_id, text) -> sorted (start, rank, end) of all places of disclosing terms; docs: distinct (doc_id, text)."""
    import math
    import re

    found = [[(m[0].lower(), *m.span()) for m in re.finditer("(?<![a-zA-Z])[a-zA-Z]{4,}", t)] for _, t in docs]
    terms = [{w for w, _, _ in x} for x in found]
    spans = [brute.base_pii(t) for _, t in docs]
    entities = [{(rank, t[s:e].lower()) for s, rank, e in x} for x, (_, t) in zip(spans, docs, strict=True)]
    action = {}
    for x in set().union(*entities):
        having = [k for k, e in enumerate(entities) if x in e]
        for w in set().union(*(terms[k] for k in having)):
            n_both, n_term = sum(w in terms[k] for k in having), sum(w in t for t in terms)
            if n_both >= min_support and len(having) < len(docs):
                d = math.log(n_both * len(docs) / (len(having) * n_term)) / math.log(len(docs) / len(having))
                if d >= generalise_at:
                    action[x, w] = 4 if d >= remove_at else 5
    out = {}
    for k, d in enumerate(docs):
        best = {w: min(action[x, w] for x in entities[k] if (x, w) in action) for w in terms[k] if any((x, w) in action for x in entities[k])}
        out[d] = sorted((s, best[w], e) for w, s, e in found[k] if w in best and not any(a < e and s < b for a, _, b in spans[k]))
    return out


def test_disclosing_terms_anywhere_in_the_documents(spark):
    rng = random.Random(6)
    common = ["garden", "winter", "letter", "window", "yellow", "market", "system", "paper"]
    people = {f"p{i}@mail.example.com": (name, place) for i, (name, place) in enumerate([("Montgomery", "Utrecht"), ("Okonkwo", "Ravenna"), ("Thorvald", "Leipzig")])}
    rows = []
    for k in range(120):
        filler = lambda: " ".join(rng.choice(common) for _ in range(rng.randint(12, 30)))
        parts = [filler()]
        if k % 4 == 0:
            email = rng.choice(list(people))
            name, place = people[email]
            near = rng.random() < 0.5  # half of the time beside the address, else sentences away
            parts += [f"{name} {email}" if near else email, filler(), f"{name} again.", filler(), place if rng.random() < 0.8 else "", name.upper()]
        elif k % 15 == 1:
            parts += [rng.choice(list(people.values()))[1], filler()]  # a place without the address
        rows.append((k if k else None, ". ".join(parts)))
    rows += [(200, "Unique Hapaxword only.one@example.org"), (201, "Nothing")]
    df = spark.createDataFrame([*rows, rows[0], rows[4], rows[4]], EMPTY)  # repeated rows count once
    want = disclosing(rows)
    assert {k for x in want.values() for _, k, _ in x} == {4, 5}
    texts = {(d, r["text_key"]): t for (d, t), r in zip(rows, spark.createDataFrame(rows, EMPTY).select(F.xxhash64("text").alias("text_key")).collect(), strict=True)}
    got = pii.find(df).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        t = texts[r["doc_id"], r["text_key"]]
        assert [tuple(s) for s in r["spans"] if s["rank"] >= 4] == want[r["doc_id"], t], t
        assert [tuple(s) for s in r["spans"] if s["rank"] < 4] == brute.base_pii(t)


def test_byte_bpe(docs, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.encode(docs, path, public_tokenizers.PATTERN, units=byte_bpe.UNITS).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        ids = own.encode_ordinary(t or "")
        assert got[d]["ids"] == ids and bytes(got[d]["decoded"]) == (t or "").encode()
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_byte_bpe_of_rows_repeated_in_other_partitions(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {1: "a b", 2: "some other words, then a and b again", 3: ""}
    df = spark.createDataFrame(spark.sparkContext.parallelize([*texts.items()] * 3, 3), EMPTY)  # equal rows in each of three tasks
    got = byte_bpe.encode(df, path, public_tokenizers.PATTERN, units=byte_bpe.UNITS).collect()
    assert sorted(r["doc_id"] for r in got) == sorted([*texts] * 3)
    for r in got:
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_byte_bpe_of_rows_in_another_order_each_time(spark, docs, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    twice = docs.union(docs).repartition(3).orderBy(F.rand())
    got = byte_bpe.encode(twice, path, public_tokenizers.PATTERN, units=byte_bpe.UNITS).collect()
    assert sorted((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got) == sorted(2 * [(d, own.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows])


def test_units_hold_pre_tokens_whole():
    import re

    import regex

    rng = random.Random(8)
    split, units = regex.compile(public_tokenizers.PATTERN).findall, re.compile(byte_bpe.UNITS).findall
    for _ in range(3000):
        t = "".join(rng.choice(["a", "Bé", "1", "²", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "'", "'s", "'ll", ".", "!?", "_", "́", "日", "🙂"]) for _ in range(rng.randint(0, 14)))
        assert "".join(units(t)) == t
        assert [w for u in units(t) for w in split(u)] == split(t)


def test_packed_numbers():
    x = np.array([0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert unpack(pack(x)).tolist() == x.tolist()


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    bad = ["grumblor", "snarkwit", "vilefang"]

    def misspelt(w):
        i = rng.randrange(2, len(w) - 2)
        return w[:i] + rng.choice("xyz") + w[i:] if rng.random() < 0.5 else w

    docs, labels = [], []
    for i in range(900):
        words = text(rng, rng.choice([10, 40, 300])).split()
        toxic = i % 3 == 0
        if toxic:
            words[rng.randrange(len(words))] = misspelt(rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, None if i % 50 == 1 else int(toxic)))
    docs += [(900, None), (901, "")]
    df = spark.createDataFrame(docs, EMPTY)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = {r["doc_id"]: r for r in toxicity.scores(df, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [(i, i % 3 == 0) for i in range(900) if got[i]["held"]]
    right = sum((got[i]["predicted"] == 1) == t for i, t in held)
    assert right >= 0.95 * len(held) and len(held) > 200
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"]


def test_toxicity_passes_over_texts_beyond_its_bytes(spark):
    texts = [("you awful fool", 1), ("a fine day", 0)] * 20
    rows = [(i, t, y) for i, (t, y) in enumerate(texts)]
    huge = [(1000 + i, f"awful {'fine day ' * 2000}", i % 2) for i in range(8)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows + huge], "doc_id long, toxic int")
    docs = lambda r: spark.createDataFrame([(i, t) for i, t, _ in r], "doc_id long, text string")
    bounded, without = (toxicity.train(docs(r), labels, class_bytes=1000) for r in (rows + huge, rows))
    assert np.array_equal(bounded.vectors, without.vectors)
    assert not np.array_equal(toxicity.train(docs(rows + huge), labels).vectors, without.vectors)
    assert toxicity.train(docs(huge), labels, class_bytes=1000) is None


def test_toxicity_of_ids_with_several_texts(spark):
    rows = [(i, f"vilefang word{i} here" if i % 2 else f"word{i} stands here") for i in range(60)]
    other = [(i, t + " again") for i, t in rows]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    a, b = spark.createDataFrame(rows, EMPTY), spark.createDataFrame(other, EMPTY)
    score = [sorted(map(tuple, toxicity.scores(a, toxicity.train(df, labels)).select("doc_id", "score").collect())) for df in (a.union(b), b.union(a).repartition(3))]
    assert score[0] == score[1]


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "a b")], EMPTY)
    assert toxicity.scores(df, toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))).collect()[0]["score"] == 0


@pytest.mark.parametrize("run", [
    lambda d, s: sharding.byte_shards(d, 4),
    lambda d, s: substring_dedup.remove_repeats(d),
    lambda d, s: jaccard_join.link(d),
    lambda d, s: decontaminate.find(d, s.createDataFrame([], "item_id long, text string")),
    lambda d, s: pii.find(d),
    lambda d, s: byte_bpe.encode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
    lambda d, s: toxicity.scores(d, None),
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], EMPTY), spark).count() == 0
