"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its byte n-grams (3 to 6, with word borders) and of the whole word, so a misspelling that was never seen
shares most of its vector with the words it resembles. A segment of SEGMENT words is the average of its words; a softmax over a
linear map of that gives its class, and a document's score is that of its most toxic segment, so a few words in a very long
text count as much as in a short one. Labels are per document: in every epoch the gradient goes through each document's
strongest segment, so training finds out which segments bear the label.

Training reads at most ``per_class`` labelled documents of each class (those with the smallest hashes of their ids), and of those, in that
order, as many whole texts as ``class_bytes`` hold; those are the only bounds. One task fits the model on them. Scoring reads every whole text in one pass without a shuffle; the model is a table of fixed size.

Defined results: null and empty texts get the score of the bias alone; labels that are null or of ids without a document are left out; several labels of
one id count as the largest; of several texts of one id the smallest is learnt from; without labelled documents of both classes every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTER_OR_DIGIT, LOWER, mix, range_hashes, record, saved, spans_of_bytes, text_bytes, word_hashes, word_spans

BUCKETS = 1 << 17
DIMENSIONS = 8
SEGMENT = 4
#: Segments in one step of the training, and the most occurrences of words held for it at once.
STEP = 2048
#: Text that is read at once.
STEP_BYTES = 1 << 20
NGRAMS = (3, 4, 5, 6)
BORDER = 0x20
#: Types and shapes of the arrays of a flat model: vectors, classes, bias.
FLAT = (np.float32, BUCKETS, 1), (np.float32, 1, 2), (np.float64, 2)


@dataclass
class Words:
    """The words of some texts: distinct words' n-gram buckets and, for each occurrence, its distinct word."""

    hash: np.ndarray  # of each distinct word
    bucket: np.ndarray  # of all n-grams of all distinct words, end to end
    at: np.ndarray  # distinct words' offsets in it, len+1
    word: np.ndarray  # distinct word of each occurrence
    segment: np.ndarray  # segment of each occurrence
    segment_text: np.ndarray  # text of each segment
    texts: int


def read_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    texts = len(offsets) - 1
    # a border byte before each text and one after the last, so that every word has borders on both sides
    padded = np.full(len(raw) + texts + 1, BORDER, np.uint8)
    size = np.diff(offsets)
    padded[np.arange(len(raw)) + np.repeat(np.arange(1, texts + 1), size)] = LOWER[raw]
    padded[~LETTER_OR_DIGIT[padded]] = BORDER
    starts, ends, word_at = word_spans(padded, offsets + np.arange(texts + 1), LETTER_OR_DIGIT)
    word_at[-1] = len(starts)
    h = word_hashes(padded, starts, ends)
    distinct, first, word = np.unique(h, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    grams, owner = [mix(h[first] ^ np.uint64(0x5851F42D4C957F2D))], [np.arange(len(s))]
    for n in NGRAMS:
        count = np.maximum(e - s + 2 - n + 1, 0)
        of = np.repeat(np.arange(len(s)), count)
        begin = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + s[of] - 1
        grams.append(mix(range_hashes(padded, begin, begin + n) + np.uint64(n)))
        owner.append(of)
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bucket = (grams[order] % np.uint64(BUCKETS)).astype(np.int32)
    at = np.searchsorted(owner[order], np.arange(len(s) + 1))
    count = np.diff(word_at)
    text = np.repeat(np.arange(texts), count)
    segments = -(-count // SEGMENT)
    base = np.cumsum(segments) - segments
    segment = base[text] + (np.arange(len(word)) - word_at[:-1][text]) // SEGMENT
    return Words(distinct, bucket, at, word, segment, np.repeat(np.arange(texts), segments), texts)


def together(parts: Iterable[Words]) -> Words:
    """The words of several runs of texts as those of one. A word of several runs is kept once, so all grows with the distinct words and the occurrences."""
    known, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, and their words
    bucket, grams, word, segment, segment_text = [], [], [], [], []
    segments = texts = 0
    for p in parts:
        place, size = np.searchsorted(known, p.hash), np.diff(p.at)
        old = place < len(known)
        old[old] = known[place[old]] == p.hash[old]
        of = np.empty(len(p.hash), np.int32)
        of[old] = number[place[old]]
        of[~old] = len(known) + np.arange((~old).sum())
        known, number = np.insert(known, place[~old], p.hash[~old]), np.insert(number, place[~old], of[~old])
        bucket.append(p.bucket[np.repeat(~old, size)])
        grams.append(size[~old])
        word.append(of[p.word])
        segment.append((p.segment + segments).astype(np.int32))
        segment_text.append((p.segment_text + texts).astype(np.int32))
        segments, texts = segments + len(p.segment_text), texts + p.texts
    ordered = np.empty_like(known)
    ordered[number] = known
    at = np.append(0, np.cumsum(np.concatenate(grams)))
    return Words(ordered, np.concatenate(bucket), at, np.concatenate(word), np.concatenate(segment), np.concatenate(segment_text), texts)


def means(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the runs [at[i], at[i+1]), none of which is empty."""
    return np.add.reduceat(values, at[:-1]) / np.diff(at) if len(values) else np.zeros(0)


def segment_values(w: Words, gram_value: np.ndarray) -> np.ndarray:
    """Mean over a segment's words of the mean over a word's n-grams of a value of the n-gram."""
    word_value = means(gram_value[w.bucket], w.at)
    n = len(w.segment_text)
    return np.bincount(w.segment, word_value[w.word], n) / np.maximum(np.bincount(w.segment, minlength=n), 1)


def text_scores(w: Words, gram_value: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Each text's score, and its strongest segment (-1 where it has none)."""
    value = segment_values(w, gram_value) + bias
    best = np.full(w.texts, -1, np.int64)
    order = np.lexsort((value, w.segment_text))
    best[w.segment_text[order]] = order  # the last one written is the largest
    logit = np.where(best >= 0, value[best], bias) if len(value) else np.full(w.texts, bias)
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50))), best


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x DIMENSIONS
    classes: np.ndarray  # DIMENSIONS x 2
    bias: np.ndarray  # 2

    def collapsed(self) -> tuple[np.ndarray, float]:
        """The softmax of two classes depends on their difference only, which is linear in the vectors."""
        return (self.vectors @ (self.classes[:, 1] - self.classes[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])

    def flat(self) -> Model:
        """A model of one dimension that gives the same scores: a value for each n-gram, DIMENSIONS times smaller."""
        value, bias = self.collapsed()
        return Model(value[:, None], np.array([[0, 1]], np.float32), np.array([0, bias]))


def surplus(w: Words, label: np.ndarray) -> np.ndarray:
    """For each n-gram bucket: by how many standard errors it is found in more (or fewer) texts of label 1 than its frequency would have."""
    found = np.zeros((2, BUCKETS))
    text = w.segment_text[w.segment]
    for t in range(w.texts):
        lo, hi = np.searchsorted(text, (t, t + 1))
        words = np.unique(w.word[lo:hi])
        k = w.at[words + 1] - w.at[words]
        index = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(w.at[words], k)
        found[label[t]][np.unique(w.bucket[index])] += 1
    expected = found.sum(0) * (label == 1).mean()
    return (found[1] - expected) / np.sqrt(expected + 1)


def fit(w: Words, label: np.ndarray, epochs: int = 12, batches: int = 8, rate: float = 3.0, seed: int = 7) -> Model:
    """Joint AdaGrad steps on vectors, classes and bias; the two classes weigh the same.

    The first coordinate starts as the n-gram's surplus in texts of label 1, which lets the first epochs find the segments that
    matter; all coordinates are then trained together.
    """
    rng = np.random.default_rng(seed)
    m = Model(rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.3, (DIMENSIONS, 2)), np.array([0.5, -0.5]))
    m.vectors[:, 0], m.classes[0] = surplus(w, label), (-0.5, 0.5)
    seen_v, seen_c, seen_b = np.full((BUCKETS, DIMENSIONS), 1e-6), np.full((DIMENSIONS, 2), 1e-6), np.full(2, 1e-6)
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    per_segment = np.bincount(w.segment, minlength=len(w.segment_text))
    starts = np.searchsorted(w.segment, np.arange(len(w.segment_text) + 1))
    grams = np.diff(w.at)
    for _ in range(epochs):
        _, best = text_scores(w, *m.collapsed())
        use, weigh = best[best >= 0], weight[best >= 0]
        for batch in np.array_split(rng.permutation(len(use)), max(batches, -(-len(use) // STEP))):
            some, scale = use[batch], weigh[batch] / weigh[batch].sum()
            # the chosen segments' words, and those words' n-grams, each with its share in the segment's average
            n = per_segment[some]
            owner = np.repeat(np.arange(len(some)), n)
            word = w.word[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + starts[some][owner]]
            k = grams[word]
            gram_owner = np.repeat(owner, k)
            bucket = w.bucket[np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(w.at[word], k)]
            share = np.repeat(1.0 / (k * n[owner]), k)
            bag = np.stack([np.bincount(gram_owner, share * m.vectors[bucket, d], len(some)) for d in range(DIMENSIONS)], 1)
            logits = bag @ m.classes + m.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), label[w.segment_text[some]]] -= 1
            grad = p * scale[:, None]
            g_classes, g_bias, g_bag = bag.T @ grad, grad.sum(0), grad @ m.classes.T
            used, place = np.unique(bucket, return_inverse=True)
            g = np.stack([np.bincount(place, share * g_bag[gram_owner, d], len(used)) for d in range(DIMENSIONS)], 1)
            seen_v[used] += g * g
            m.vectors[used] -= rate * g / np.sqrt(seen_v[used])
            seen_c += g_classes**2
            m.classes -= 0.1 * g_classes / np.sqrt(seen_c)
            seen_b += g_bias**2
            m.bias -= 0.1 * g_bias / np.sqrt(seen_b)
    return m


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text", class_bytes: int = 64 << 20) -> Model | None:
    """Fits on at most per_class documents of each class whose id is not held out, and on at most class_bytes of their whole texts.

    A text that does not fit in what is left of the bytes is passed over, not cut; the next ones may still fit.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # one top-k a class; the ids are then few enough to be sent to the scan of the texts
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    rows = ids.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = saved(rows, "labelled")
    # the lengths of so few rows are small on the driver, their texts need not be
    sizes = rows.select(F.xxhash64("doc_id").alias("hash"), "doc_id", "toxic", F.octet_length("text").alias("size")).collect()
    left, fits, classes = {0: class_bytes, 1: class_bytes}, [], set()
    for r in sorted(sizes):
        if r.size <= left[r.toxic]:
            left[r.toxic] -= r.size
            fits.append(r.doc_id)
            classes.add(r.toxic)
    if len(classes) < 2:
        return None
    sample = rows.where(F.col("doc_id").isin(fits)).select("doc_id", "text", "toxic").coalesce(1).sortWithinPartitions("doc_id")
    parts = sample.mapInArrow(_learn, "vectors binary, classes binary, bias binary").first()
    return Model(*(np.frombuffer(part, t).reshape(shape) for part, (t, *shape) in zip(parts, FLAT, strict=True)))


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task fits the model on the bounded sample; only what scoring needs of it goes to the driver, half a megabyte."""
    sample = pa.Table.from_batches(batches)
    label = sample.column("toxic").to_numpy().astype(np.int64)
    raw, offsets = text_bytes(sample.column("text"))
    m = fit(together(read_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in spans_of_bytes(offsets, STEP_BYTES)), label).flat()
    yield record(["vectors", "classes", "bias"], [pa.array([a.tobytes()], pa.binary()) for a in (m.vectors, m.classes, m.bias)])


def _score(table, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, bias = table.value
        for b in batches:
            raw, offsets = text_bytes(b.column("text"))
            for i, j in spans_of_bytes(offsets, STEP_BYTES):
                s, _ = text_scores(read_words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), value, bias)
                rows = [b.column(k).slice(i, j - i) for k in range(b.num_columns)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(s)], names=[*b.schema.names, name])

    return score


def scores(docs: DataFrame, model: Model | None, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The rows with two more columns: the score of column ``text`` (0 to 1) and the prediction (1 from 0.7 on). Columns of those names are replaced."""
    rows = docs.drop(score, predicted)
    if model is None:
        out = rows.withColumn(score, F.lit(0.0))
    else:
        table = docs.sparkSession.sparkContext.broadcast(model.collapsed())
        out = rows.mapInArrow(_score(table, score), T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType())]))
    return out.withColumn(predicted, (F.col(score) >= 0.7).cast("int"))
