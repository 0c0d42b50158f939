"""Similarity self-join of documents on word n-gram sets with PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Sets. A document's set holds the distinct hashes of its word shingles. Equal sets have one fingerprint and are one *node*, so copies
collapse while they are read and in every aggregation after that.

Signatures. Sizes fall into bands whose ends have the ratio of the threshold, so two sets that reach it lie in one band or in
neighbours; every set signs for its own band and the next. In band j at most k_j elements can differ. The hashed feature domain is cut
into n1 = k_j/2 + 1 (+ slack) partitions of three cells each. Some partition holds at most one difference, so one of its three
2-subsets of cells is equal in both sets: each 2-subset gives one signature. A signature over empty cells says nothing and is left
out. A set with so many empty cells that the argument fails (in more partitions than the slack) signs again by another partitioning, up to
SEEDS of them: two similar sets that both fail the first meet in the second, and so on. Sets that fail all, and every set of a band where a
set has at most FEW elements that the other lacks, are partitioned down to single elements: their signatures are all TAKEN-subsets of their
first elements in hash order, as many of these as the first TAKEN common elements can lie among.

Candidates. Signatures are packed per task and bucket (4 bytes each) and grouped per bucket. Groups with the same members are one.
First every member is compared with one hub of its group (the member that shares most signatures) and verified edges make components. Groups
that still hold several components are looked at twice more: first the best pair of each component, which is one row a component at most, then
all pairs of components that are still different. So no link between different components is lost, and a group of copies costs one
comparison per member.

A pair is a candidate only if its sketches allow it. A sketch counts a set's elements in cells, one cell for every one or two elements (up to
MOST_CELLS); the L1 distance of two sketches never exceeds the number of differing elements and stays close to it, so what remains are links and
pairs just below the threshold.

A pair is looked at in the least of its common groups only, as far as the first LISTED open groups of both tell; a pair that shares none of
these is looked at in each.

Verification recomputes both sets from the whole texts and counts the intersection.

Hashes have 64 bits; sets are told apart by a 64-bit sum of their elements' hashes.

Defined results: null texts and texts without words have an empty set, link with nothing and are their own component; fewer words than a
shingle make one shingle of all of them; a component's id is its smallest doc_id that is not null; repeated rows fall together;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, Scratch, components, mix, partitions, range_hashes, spans_of_bytes, text_bytes, with_key, word_hashes, word_spans

LAST_ID = (1 << 63) - 1
SHINGLE_BASE = 0xC2B2AE3D27D4EB4F
#: Cells of a sketch: the power of two from half the set's size on, within these bounds.
LEAST_CELLS, MOST_CELLS = 64, 4096
#: Elements of a subset of single elements, and up to how many missing elements a band uses only these.
TAKEN, FEW, SEEDS = 4, 2, 64
#: Members of a group that one task compares with one another.
GROUP_ROWS = 1024
#: The least open groups that a member carries with it.
LISTED = 32
#: Text whose sets, and elements whose signatures, are made at once.
STEP_BYTES, STEP_ELEMENTS = 1 << 20, 1 << 17
#: Shingles whose signatures go to one bucket, about.
BUCKET_SHINGLES = 1_000_000
#: Members compared with one hub in one group of rows.
HUB_ROWS = 256


def shingle_sets(part: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sorted distinct shingle hashes, end to end, and the len+1 offsets of the texts' sets."""
    part = LOWER[part]
    starts, ends, word_at = word_spans(part, off, NOT_SPACE)
    count = np.diff(word_at)
    number = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    text = np.repeat(np.arange(len(number)), number)
    first = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + word_at[:-1][text]
    length = np.minimum(count, words)[text]
    h = range_hashes(word_hashes(part, starts, ends), first, first + length, SHINGLE_BASE)
    with np.errstate(over="ignore"):
        h = mix(h + length.astype(np.uint64))
    at = np.concatenate(([0], np.cumsum(number)))
    sets = []
    for i in range(len(number)):
        s = np.sort(h[at[i] : at[i + 1]])
        sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else h), np.concatenate(([0], np.cumsum(sizes)))


def sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of 64-bit values per group modulo 2**64, exact as two sums of 32-bit halves (for fewer than 2**21 values a group)."""
    low = np.bincount(group, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), groups)
    high = np.bincount(group, (values >> np.uint64(32)).astype(np.float64), groups)
    with np.errstate(over="ignore"):
        return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def fingerprints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return mix(sums(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), owner, len(at) - 1)).view(np.int64)


class Bands:
    """Size bands [low, high] for the threshold num/den, and the most elements in which two sets of a band can differ."""

    def __init__(self, num: int, den: int, most: int):
        self.num, self.den = num, den
        low, high = [1], [den // num]
        while high[-1] < most:
            low.append(high[-1] + 1)
            high.append(low[-1] * den // num)
        low.append(high[-1] + 1)
        high.append(low[-1] * den // num)
        self.low, self.high = np.array(low), np.array(high)
        self.differ = 2 * self.high * (den - num) // (den + num)
        base = self.differ // 2 + 1
        self.slack = self.slack_for(base)
        self.parts = base + self.slack
        self.missing = self.high * (den - num) // den
        self.taken = np.minimum(TAKEN, -(-self.low * num // den))

    def slack_for(self, base: np.ndarray) -> np.ndarray:
        """So many more partitions that few sets of a band, down to the smallest that signs for it, have more of them with empty cells."""
        smallest, slack, best = self.low * self.num / self.den, np.ones(len(base), np.int64), np.full(len(base), np.inf)
        for part in np.linspace(0, 0.5, 41):
            more = 1 + (base * part).astype(np.int64)
            empty = np.exp(-smallest / (base + more) / 3)
            bad = (base + more) * (empty**3 + 3 * (1 - empty) * empty**2)
            lacking = np.maximum(bad + 2.5 * np.sqrt(bad) - more, 0)
            slack, best = np.where(lacking < best, more, slack), np.minimum(lacking, best)
        return slack

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, sizes, "left")


@lru_cache
def subsets(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64)


def signatures(h: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of all sets; sets so small that similar ones are equal have none."""
    sizes = np.diff(at)
    bands = Bands(num, den, int(sizes.max(initial=1)))
    owner_out, sig_out = [], []
    value = mix(h ^ np.uint64(0x8CB92BA72F3D8DD7))
    with np.errstate(over="ignore"):
        for step in (0, 1):
            band = bands.of(sizes) + step
            signs = (bands.differ[band] > 0) & (sizes > 0)
            few = signs & (bands.missing[band] <= FEW)
            open_ = np.flatnonzero(signs & ~few)
            left = [np.flatnonzero(few)]
            for seed in range(SEEDS):
                if seed == SEEDS // 8:  # of small sets the subsets are few
                    small = bands.missing[band[open_]] <= 4 * TAKEN
                    left.append(open_[small])
                    open_ = open_[~small]
                if not len(open_):
                    break
                # the sets that are still open, numbered anew
                size, parts, in_band = sizes[open_], bands.parts[band[open_]], band[open_]
                element = np.arange(int(size.sum())) + np.repeat(at[open_] - np.cumsum(size) + size, size)
                cells = 3 * parts
                base = np.cumsum(cells) - cells
                spread = mix(h[element] ^ np.uint64((0x9FB21C651E98DF25 + 2 * seed * 0x9E3779B97F4A7C15) % (1 << 64)))
                owner = np.repeat(np.arange(len(open_)), size)
                cell = base[owner] + (spread % cells[owner].astype(np.uint64)).astype(np.int64)
                n = int(cells.sum())
                total, filled = sums(value[element], cell, n).reshape(-1, 3), np.bincount(cell, minlength=n).reshape(-1, 3) > 0
                of = np.repeat(np.arange(len(open_)), parts)
                number = np.arange(len(of)) - (np.cumsum(parts) - parts)[of]
                for left_out, (a, b) in enumerate(((1, 2), (0, 2), (0, 1))):
                    keep = filled[:, a] | filled[:, b]
                    place = (((in_band[of] * SEEDS + seed) * 4 + left_out).astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64)
                    sig = mix(mix(total[:, a] + place * np.uint64(0x9E3779B97F4A7C15)) + total[:, b])
                    owner_out.append(open_[of[keep]])
                    sig_out.append(sig[keep])
                open_ = open_[np.bincount(of, filled.sum(1) < 2, len(open_)) > bands.slack[in_band]]
            for k in np.concatenate((*left, open_)).tolist():
                taken = int(bands.taken[band[k]])
                first = value[at[k] : min(at[k + 1], at[k] + taken + int(bands.missing[band[k]]))]
                if len(first) >= taken:
                    sig = mix(first[subsets(len(first), taken)].sum(1, dtype=np.uint64) + np.uint64(int(band[k]) * 4 + 3) * np.uint64(0x9E3779B97F4A7C15))
                    owner_out.append(np.full(len(sig), k))
                    sig_out.append(sig)
    return np.concatenate(owner_out) if owner_out else np.zeros(0, np.int64), np.concatenate(sig_out) if sig_out else np.zeros(0, np.uint64)


def sketches(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set the number of its elements in each cell, as 16-bit numbers."""
    n = np.diff(at)
    cells = 1 << np.ceil(np.log2(np.clip(n, 2 * LEAST_CELLS, 2 * MOST_CELLS) / 2)).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(cells)))
    owner = np.repeat(np.arange(len(n)), n)
    cell = (mix(h ^ np.uint64(0xD1B54A32D192ED03)) & (cells[owner] - 1).astype(np.uint64)).astype(np.int64)
    count = np.minimum(np.bincount(base[owner] + cell, minlength=base[-1]), 65535).astype("<u2")
    return [count[i:j].tobytes() for i, j in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def folded(sketch: bytes, cells: int) -> np.ndarray:
    """The sketch in fewer cells: those that agree in their low bits are one."""
    return np.frombuffer(sketch, "<u2").astype(np.int32).reshape(-1, cells).sum(0)


def _features(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("sketch", pa.binary())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_bytes(b.column("text"))
            for i, j in spans_of_bytes(offsets, STEP_BYTES):
                h, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                n = np.diff(at)
                keys = [b.column(c).slice(i, j - i) for c in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(fingerprints(h, at), mask=n == 0), pa.array(n), pa.array(sketches(h, at), pa.binary())], schema=schema)

    return features


def _sign(words: int, num: int, den: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("node", pa.binary()), ("count", pa.binary()), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_bytes(b.column("text"))
            for i, j in spans_of_bytes(offsets, STEP_BYTES):
                h, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                if not len(h):
                    continue
                node, one = np.unique(fingerprints(h, at), return_index=True)  # copies in the chunk sign once
                take = np.zeros(len(at) - 1, bool)
                take[one] = True
                parts = [(x, *signatures(h[at[x] : at[y]], at[x : y + 1] - at[x], num, den)) for x, y in spans_of_bytes(at, STEP_ELEMENTS)]
                of, sig = np.concatenate([x + o for x, o, _ in parts]), np.concatenate([s for *_, s in parts])
                of, sig = of[take[of]], sig[take[of]]
                nodes = fingerprints(h, at)
                order = np.argsort(of, kind="stable")
                of, sig = of[order], sig[order]
                bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for k in np.flatnonzero(np.diff(cuts)):
                    mine = order[cuts[k] : cuts[k + 1]]
                    used, count = np.unique(of[mine], return_counts=True)
                    rows.append({"bucket": int(k), "node": nodes[used].astype("<i8").tobytes(), "count": count.astype("<u4").tobytes(), "sig": sig[mine].astype("<u4").tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return sign


def _groups(table: pa.Table) -> pa.Table:
    """Of one bucket: (group, node, sigs) for signatures that several nodes share; equal member sets are one group, found sigs times."""
    node, sig = [], []
    for n, c, s in zip(*(table.column(x).to_pylist() for x in ("node", "count", "sig")), strict=True):
        node.append(np.repeat(np.frombuffer(n, "<i8"), np.frombuffer(c, "<u4")))
        sig.append(np.frombuffer(s, "<u4"))
    node, sig = np.concatenate(node), np.concatenate(sig)
    order = np.lexsort((node, sig))
    node, sig = node[order], sig[order]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))  # a node once for each signature
    node, sig = node[new], sig[new]
    edge = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(edge, len(sig)))
    many = np.repeat(size > 1, size)
    node, size = node[many], size[size > 1]
    schema = pa.schema([("grp", pa.int64()), ("node", pa.int64()), ("sigs", pa.int64())])
    if not len(node):
        return schema.empty_table()
    edge = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        key = mix(np.add.reduceat(mix(node.view(np.uint64)), edge) + size.astype(np.uint64))
    _, one, times = np.unique(key, return_index=True, return_counts=True)
    index = np.arange(size[one].sum()) - np.repeat(np.cumsum(size[one]) - size[one], size[one]) + np.repeat(edge[one], size[one])
    return pa.table([np.repeat(key[one].view(np.int64), size[one]), node[index], np.repeat(times, size[one])], schema=schema)


def _apart(num: int, den: int):
    """Drops pairs whose sketches rule them out."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            for k, (a, b) in enumerate(zip(batch.column("sketch_a"), batch.column("sketch_b"), strict=True)):
                a, b = a.as_py(), b.as_py()
                cells = min(len(a), len(b)) // 2
                keep[k] = np.abs(folded(a, cells) - folded(b, cells)).sum() * (den + num) <= total[k] * (den - num)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return apart


def possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes that sizes and sketches do not rule out."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    sized = pairs.join(side("a").drop("sketch_a"), "a").join(side("b").drop("sketch_b"), "b").where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    both = sized.join(side("a").drop("n_a"), "a").join(side("b").drop("n_b"), "b")
    return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_apart(num, den), "a long, b long")


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from rows that come sorted by the key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(-(keys != keys[-1]).astype(np.int8), 0))  # where the last run begins
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(num: int, den: int, best: bool):
    """Of each group: pairs of different components that sizes and sketches do not rule out; pairs with the hub are known.

    ``best``: of each component only the pair whose sketches are nearest.
    """
    none = np.zeros(0, np.int64)

    def elsewhere(lists: list[np.ndarray]) -> np.ndarray | None:
        """Which members share one of their groups in ``lists``."""
        group = np.concatenate(lists)
        if not len(group):
            return None
        _, number, times = np.unique(group, return_inverse=True, return_counts=True)
        shared = times[number] > 1
        if not shared.any():
            return None
        member = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[shared]
        _, number = np.unique(number[shared], return_inverse=True)
        found = np.zeros((len(lists), int(number.max()) + 1), np.float32)
        found[member, number] = 1
        return found @ found.T > 0

    def of_group(comp: np.ndarray, size: np.ndarray, part: np.ndarray, sketch: list[bytes], lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows come by size. Of the rows of two parts only pairs across them are looked at."""
        settled = elsewhere(lists)
        fine = min(map(len, sketch)) // 2
        coarse = np.stack([folded(s, LEAST_CELLS) for s in sketch])
        across = part.min() != part.max()
        first, second, apart = [none], [none], [np.zeros(0)]
        for x in range(0, len(comp), 64):
            rows = slice(x, x + 64)
            open_ = (comp[rows, None] != comp) & (np.arange(len(comp)) > np.arange(len(comp))[rows, None]) & (size * num <= size[rows, None] * den)
            if across:
                open_ &= part[rows, None] != part
            if settled is not None:
                open_ &= ~settled[rows]
            i, j = np.nonzero(open_)
            i += x
            for cells in dict.fromkeys((LEAST_CELLS, fine)):
                if not len(i):
                    break
                if cells == LEAST_CELLS:
                    a, b, counts = i, j, coarse
                else:
                    used, place = np.unique(np.concatenate((i, j)), return_inverse=True)
                    a, b, counts = place[: len(i)], place[len(i) :], np.stack([folded(sketch[k], cells) for k in used.tolist()])
                far = np.concatenate([np.abs(counts[a[k : k + 2048]] - counts[b[k : k + 2048]]).sum(1) for k in range(0, len(a), 2048)])
                near = far * (den + num) <= (size[i] + size[j]) * (den - num)
                i, j, far = i[near], j[near], far[near]
            if len(i):
                first.append(i)
                second.append(j)
                apart.append(far / (size[i] + size[j]))
        i, j, apart = np.concatenate(first), np.concatenate(second), np.concatenate(apart)
        if best and len(i):
            of, place = np.concatenate((comp[i], comp[j])), np.tile(np.arange(len(i)), 2)
            by = np.lexsort((apart[place], of))
            take = np.unique(place[by][np.concatenate(([True], of[by][1:] != of[by][:-1]))])
            i, j = i[take], j[take]
        return i, j

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "block"):
            block, grp, node, hub, comp, size, part = (table.column(c).to_numpy() for c in ("block", "grp", "node", "hub", "comp", "n_shingles", "part"))
            sketch = table.column("sketch").to_pylist()
            least = table.column("least").combine_chunks()
            ids, at = least.flatten().to_numpy(), np.concatenate(([0], np.cumsum(least.value_lengths().to_numpy())))
            order = np.lexsort((size, block))
            order = order[node[order] != hub[order]]
            cuts = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0, [True]))) if len(order) else none
            a, b = [none], [none]
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                mine = order[x:y]
                lists = [ids[at[k] : at[k + 1]] for k in mine.tolist()]
                i, j = of_group(comp[mine], size[mine], part[mine], [sketch[k] for k in mine.tolist()], [x[x < grp[mine[0]]] for x in lists])
                a.append(node[mine[i]])
                b.append(node[mine[j]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return pairs


def _verify(words: int, num: int, den: int):
    """Rows come sorted by hub, the hub's own row before its members': the set of one hub is held at a time."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            hubs, nodes, raw_offsets = batch.column("b").to_numpy(), batch.column("a").to_numpy(), text_bytes(batch.column("text"))
            raw, offsets = raw_offsets
            a, b = [], []
            for i, j in spans_of_bytes(offsets, STEP_BYTES):
                h, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                for k in range(i, j):
                    mine = h[at[k - i] : at[k - i + 1]]
                    if nodes[k] == hubs[k]:
                        hub, kept = hubs[k], mine.copy()
                    elif hub != hubs[k]:
                        raise ValueError("a member came without its hub")
                    else:
                        where = np.minimum(np.searchsorted(kept, mine), len(kept) - 1)
                        both = int((kept[where] == mine).sum())
                        if den * both >= num * (len(kept) + len(mine) - both):
                            a.append(nodes[k])
                            b.append(hubs[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return verify


def verified(edges: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The edges (a, b) between nodes whose sets reach the threshold. Members of a hub b are dealt out in parts of about HUB_ROWS."""
    many = edges.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).alias("parts"))
    members = edges.join(many, "b").select("a", "b", F.pmod(F.hash("a"), F.col("parts")).cast("int").alias("part"))
    need = members.union(members.select(F.col("b").alias("a"), "b", "part").distinct())
    where = nodes.select(F.col("node").alias("a"), "id", "text_key")
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text_key", "text")
    # only texts that stand for a node in question are dealt on
    used = need.join(where, "a")
    rows = texts.join(used.hint("merge"), ["id", "text_key"])  # rows that repeat id and text give the same answer twice
    n = partitions(docs.sparkSession)
    rows = rows.select("a", "b", "part", "text").repartition(n, "b", "part").sortWithinPartitions("b", "part", F.col("a") != F.col("b"))
    return rows.select("a", "b", "text").mapInArrow(_verify(words, num, den), "a long, b long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of a group, dealt to ``parts`` parts, meet in one block for each two parts; a part is with itself in its own block."""
    part = rows.withColumn("part", F.pmod(F.hash("node"), F.col("parts")))
    met = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("block", F.xxhash64("grp", F.least("part", "other"), F.greatest("part", "other"))).select("block", "grp", "node", "hub", "comp", "part")


def link(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, text_key, n_shingles, component_id. Documents link when den * intersection >= num * union."""
    docs = with_key(df, id_col, text_col)
    spark = docs.sparkSession
    scratch = Scratch(spark)
    features = scratch.save(docs.mapInArrow(_features(words), "doc_id long, text_key long, node long, n_shingles long, sketch binary"), "features")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "text_key", "n_shingles", "sketch"))
    nodes = scratch.save(features.where("node is not null").groupBy("node").agg(first.alias("r")).select("node", "r.*"), "nodes")

    shingles = features.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(partitions(spark), -(-shingles // BUCKET_SHINGLES))  # so that a bucket's size does not grow with the input
    blobs = docs.mapInArrow(_sign(words, num, den, buckets), "bucket int, node binary, count binary, sig binary")
    shared = blobs.groupBy("bucket").applyInArrow(_groups, "grp long, node long, sigs long")
    groups = scratch.save(shared.groupBy("grp", "node").agg(F.sum("sigs").alias("sigs")), "groups")

    weight = groups.groupBy("node").agg(F.sum("sigs").alias("weight"))
    hubs = groups.join(weight, "node").groupBy("grp").agg(F.max(F.struct("weight", "node")).alias("h"), F.count(F.lit(1)).alias("members")).select("grp", F.col("h.node").alias("hub"), "members")
    hubs = scratch.save(hubs, "hubs")
    stars = groups.join(hubs, "grp").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = scratch.save(possible(stars, nodes, num, den), "stars")
    links = scratch.save(verified(stars, nodes, docs, words, num, den), "links")
    scratch.drop("stars")

    groups = groups.join(hubs.where("members > 2"), "grp").select("grp", "node", "hub")  # pairs with the hub are settled
    roots = components(links, scratch)
    for best in (True, False):
        of = groups.join(roots, "node", "left").select("grp", "node", "hub", F.coalesce("root", "node").alias("comp"))
        several = of.groupBy("grp").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y")
        rest = scratch.save(of.join(several.select("grp", F.ceil(F.col("m") / GROUP_ROWS).cast("int").alias("parts")), "grp"), f"open-{best}")
        least = rest.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("grp")), 1, LISTED).alias("least"))  # no more groups than the text has signatures
        rest = in_blocks(rest).join(nodes.select("node", "n_shingles", "sketch").join(least, "node"), "node")
        rest = rest.repartition(partitions(spark), "block").sortWithinPartitions("block")
        more = scratch.save(rest.mapInArrow(_pairs(num, den, best), "a long, b long").distinct(), "pairs")
        if not more.limit(1).count():
            break
        found = scratch.save(verified(more, nodes, docs, words, num, den), f"links-{best}")
        scratch.drop("pairs", f"open-{best}")
        if found.limit(1).count():
            links = links.union(found)
            roots = components(links, scratch, f"components-{best}")

    ids = nodes.select("node", F.when(F.col("id") != LAST_ID, F.col("id")).alias("id"))
    rooted = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    member = scratch.save(rooted.join(least, "root").select("node", "component_id"), "members")
    scratch.drop("groups", "hubs", "nodes")
    return features.join(member, "node", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
