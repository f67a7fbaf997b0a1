"""N-gram Jaccard join by prefix trees.

Each document is the set of its distinct word n-grams (64-bit hashes). The work goes in steps, each a table:

1. Sets. Texts with equal sets become one node; copies cost nothing further. Sets are not stored: later steps make them again from
   the texts that they need, which are smaller.
2. A global order of n-grams, rare first, by a count sketch of fixed size over all sets (any fixed order gives right results;
   counts only keep frequent n-grams out of the prefixes).
3. Prefix filter: similar sets share an n-gram among each one's first n - ceil(t n) + 1. Nodes that share one are compared by
   parity sketches: the bits in which two sketches differ are at most the n-grams in which the sets do, so two sets whose sketches
   differ in more bits than a link allows are no link. What the sketches leave is searched breadth first, nodes leaving as they are
   reached: one edge a node, not all pairs. Components of these edges are clusters: every link lies inside one. Short sketches tell
   nothing about long texts, so clusters that are too large for one task are searched once more with long sketches.
4. Inside a cluster (cut into pairs of chunks where it is large) sets are stored in a compressed trie. A set is searched by
   walking the trie level by level: the overlap with a path is counted once for all sets below, and a subtree is dropped when even
   all remaining n-grams could not reach the threshold. Links are found by breadth-first search; nodes already reached leave
   the trie, so a group of near copies costs about one walk each and not all pairs. No link that would join two
   components is missed.
5. Components of the links, carried back to documents.

Words: runs of anything but white space, A-Z in lower case. With fewer words than n, the whole sequence is the only n-gram.
Nulls: a null text, or one without words, has an empty set and links with nothing; its component is its own doc_id. A null doc_id
takes part, but is never a component's smallest. Repeated rows give a row each, in one component if they have words. An empty
table gives no rows. Other columns are ignored. Equality of n-grams and of sets is that of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, small_batches, table, written
from .components import EDGES, connected_components, forest

WORDS, PERCENT = 4, 85
SKETCH, FILTER = 1 << 19, 1 << 24
#: n-grams of a cluster (8 bytes each) that one task takes at a time.
UNIT = 2_000_000
SEGMENT = 48
#: Bits of a parity sketch. In an n-gram's group of more than HOT nodes, neighbours by size are paired without looking at sketches.
BITS, HOT = 1_024, 20_000
#: Bits of the long sketches of sets of more than BITS n-grams, and of more than LONG[0] * 2; bytes of sketches that one task holds.
LONG, SKETCH_BYTES = (4_096, 32_768), 24_000_000
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class Shingles:
    """Sets of word n-grams of texts; hashes of words already seen are looked up, and forgotten when they get many."""

    def __init__(self, n: int = WORDS):
        self.n, self.known = n, {}

    def of(self, text: str | None) -> np.ndarray:
        import xxhash

        words = text.encode().lower().split() if text else []  # bytes: only A-Z change, only 0x09-0x0D and blanks separate
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        ids = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            ids.append(h)
        ids = np.array(ids, np.uint64)
        n = min(self.n, len(ids))
        out = np.zeros(len(ids) - n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out += mix64(ids[k : k + len(out)] + _STEPS[k]) * _STEPS[-1 - k]
            return np.unique(mix64(out + np.uint64(n)))


def node_of(grams: np.ndarray) -> int | None:
    """The number that stands for a set; None for the empty one."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64)) if len(grams) else None


def parity(grams: np.ndarray, bits: int = BITS) -> bytes:
    """For each of `bits` slots, whether an odd number of n-grams falls to it."""
    return np.packbits(np.bincount(((grams >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _survey(n: int, slots: int, parts: int = 64):
    """Rows of two kinds: each document's set size and node; and the task's count sketch, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_key", "size", "node", "sketch", "long", "part", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        shingles, sums = Shingles(n), np.zeros(slots, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = batch.slice(lo, 256)
                sets = [shingles.of(t) for t in own.column("text").to_pylist()]
                sums += np.bincount((np.concatenate(sets) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
                none = [None] * len(sets)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_key"), *(pa.array(x, k) for x, k in zip(([len(s) for s in sets], [node_of(s) for s in sets], [parity(s) if len(s) else None for s in sets], [parity(s, LONG[len(s) > 2 * LONG[0]]) if len(s) > BITS else None for s in sets], none, none), kinds[2:]))], names)
        none = [None] * parts
        pieces = [p.tobytes() for p in np.split(np.minimum(sums, 0xFFFFFFFF).astype(np.uint32), parts)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((none, none, none, none, none, none, list(range(parts)), pieces), kinds)], names)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts")):
            counts = np.frombuffer(blob.as_buffer(), np.uint32).astype(np.uint64)
            sums[part] = sums[part] + counts if part in sums else counts
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])


def count_sketch(survey: DataFrame, slots: int = SKETCH) -> np.ndarray:
    """How many sets have an n-gram that falls to each slot: a table of fixed size."""
    parts = survey.where("part is not null").select("part", "counts").repartition("part").mapInArrow(_add, "part long, counts binary").collect()
    out = np.zeros(slots, np.uint32)
    for r in parts:
        own = np.frombuffer(r["counts"], np.uint32)
        out[r["part"] * len(own) : (r["part"] + 1) * len(own)] = own
    return out


def _prefixes(n: int, shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shingles = shared.value, Shingles(n)
        mask = np.uint64(len(counts) - 1)
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            found, nodes, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingles.of(text)
                node, size = node_of(grams), len(grams)
                if node is None or node in seen:
                    continue
                seen.add(node)
                keep = size - (percent * size + 99) // 100 + 1
                rank = counts[(grams & mask).astype(np.int64)]
                found.append(grams[np.lexsort((grams, rank))[:keep]])
                nodes.append(np.full(keep, node, np.int64))
                sizes.append(np.full(keep, size, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], ["gram", "node", "size"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by n-gram, those whose n-gram another row has too."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        gram, node, size = (batch.column(c).to_numpy() for c in ("gram", "node", "size"))
        if held is not None:
            gram, node, size = (np.concatenate([[x], y]) for x, y in zip(held[:3], (gram, node, size)))
        same = gram[1:] == gram[:-1]
        keep = np.concatenate([[held is not None and held[3]], same]) | np.concatenate([same, [False]])
        held = (gram[-1], node[-1], size[-1], bool(same[-1]) if len(same) else False)
        keep[-1] = False  # the last row waits for the next batch
        yield pa.RecordBatch.from_arrays([pa.array(gram[keep]), pa.array(node[keep]), pa.array(size[keep])], ["gram", "node", "size"])
    if held is not None and held[3]:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held[:3]], ["gram", "node", "size"])


def plausible(nodes: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Edges that connect whatever pairs that may be links connect. sizes ascend; sketches: a row of 64-bit words each."""
    a: list[int] = []
    b: list[int] = []
    left = np.arange(len(nodes))
    queue: list[int] = []
    while len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = int(left[0]), left[1:]
        most = (sizes[x] + sizes[left]) * (100 - percent) // (100 + percent)
        small, large = np.minimum(sizes[left], sizes[x]), np.maximum(sizes[left], sizes[x])
        near = (100 * small >= percent * large) & (np.bitwise_count(sketches[left] ^ sketches[x]).sum(axis=1, dtype=np.int64) <= most)
        if near.any():
            found = left[near]
            a += [int(nodes[x])] * len(found)
            b += nodes[found].tolist()
            queue += found.tolist()
            left = left[~near]
    return a, b


def _plausible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new_a: list[int] = []
        new_b: list[int] = []
        held: list[tuple[np.ndarray, ...]] = []  # pieces of the group that may go on
        count = 0

        def chain() -> None:
            nodes, sizes, _ = (np.concatenate(x) for x in zip(*held))
            ok = (nodes[1:] != nodes[:-1]) & (100 * sizes[:-1] >= percent * sizes[1:])
            new_a.extend(nodes[1:][ok].tolist())
            new_b.extend(nodes[:-1][ok].tolist())
            held[:] = [tuple(x[-1:] for x in held[-1])]

        def finish() -> None:
            if count > HOT:
                chain()
            elif count > 1:
                nodes, sizes, sketches = (np.concatenate(x) for x in zip(*held))
                once = np.concatenate([[True], nodes[1:] != nodes[:-1]])  # copies of a node lie together
                x, y = plausible(nodes[once], sizes[once], sketches[once], percent)
                new_a.extend(x)
                new_b.extend(y)
            held.clear()

        group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, nodes, sizes = (batch.column(c).to_numpy() for c in ("gram", "node", "size"))
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(gram), -1)
            cuts = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if gram[lo] != group:
                    finish()
                    group, count = gram[lo], 0
                held.append((nodes[lo:hi], sizes[lo:hi], sketches[lo:hi]))
                count += hi - lo
                if count > HOT:  # too many to hold: from now on neighbours by size are connected, which keeps all that may be similar together
                    chain()
            if len(new_a) > 300_000:
                a, b = forest(np.concatenate([a, np.array(new_a, np.int64)]), np.concatenate([b, np.array(new_b, np.int64)]))
                new_a.clear()
                new_b.clear()
        finish()
        a, b = forest(np.concatenate([a, np.array(new_a, np.int64)]), np.concatenate([b, np.array(new_b, np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def folded(sketch: np.ndarray, bits: int) -> np.ndarray:
    """A parity sketch of fewer bits from one of more: slots that fall together add up."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, bits // 64), axis=0)


def plausible_long(nodes: np.ndarray, sizes: np.ndarray, sketches: list[bytes], percent: int) -> tuple[list[int], list[int]]:
    """As `plausible`, by long sketches: first at LONG[0] bits, then at LONG[1] where both have them."""
    order = np.argsort(sizes, kind="stable")
    nodes, sizes = nodes[order], sizes[order]
    whole = [np.frombuffer(sketches[k], np.uint64) for k in order]
    short = np.stack([folded(w, LONG[0]) if len(w) * 64 > LONG[0] else np.pad(w, (0, LONG[0] // 64 - len(w))) for w in whole])
    # a set of at most BITS n-grams has a sketch of BITS bits; others are folded to it to be compared with it
    base = np.stack([folded(w, BITS) for w in whole])
    small, large = sizes <= BITS, sizes > 2 * LONG[0]
    a: list[int] = []
    b: list[int] = []
    left = np.arange(len(nodes))
    queue: list[int] = []
    while len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = int(left[0]), left[1:]
        lo, hi = np.searchsorted(sizes[left], [-(-percent * sizes[x] // 100), 100 * sizes[x] // percent + 1])
        own = left[lo:hi]
        most = (sizes[x] + sizes[own]) * (100 - percent) // (100 + percent)
        apart = np.bitwise_count(base[own] ^ base[x]).sum(axis=1, dtype=np.int64)
        if not small[x]:
            far = ~small[own] & (apart <= most)
            apart[far] = np.bitwise_count(short[own[far]] ^ short[x]).sum(axis=1, dtype=np.int64)
        near = apart <= most
        if large[x]:
            for k in np.flatnonzero(near & large[own]).tolist():
                near[k] = int(np.bitwise_count(whole[own[k]] ^ whole[x]).sum(dtype=np.int64)) <= most[k]
        if near.any():
            found = own[near]
            a += [int(nodes[x])] * len(found)
            b += nodes[found].tolist()
            queue += found.tolist()
            keep = np.ones(len(left), bool)
            keep[lo:hi] = ~near
            left = left[keep]
    return a, b


def _refine(percent: int):
    def run(table: pa.Table) -> pa.Table:
        nodes, sizes = table.column("node").to_numpy(), table.column("size").to_numpy()
        a, b = plausible_long(nodes, sizes, table.column("best").to_pylist(), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def chunk_pairs(rows: DataFrame, sizes: DataFrame, total: str, most: int) -> DataFrame:
    """Rows of clusters with `pair`, the unit of work they go to. A cluster whose total is over `most` is cut into chunks of half as much;
    each pair of chunks is a unit, so a row goes to as many as there are chunks."""
    chunks = sizes.select("component", F.ceil(F.col(total) * 2 / F.lit(most)).alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), "chunks")
    pairs = F.when(F.col("chunks") <= 2, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda k: F.least(k, chunk) * F.col("chunks") + F.greatest(k, chunk)))
    return rows.join(chunks, "component").withColumn("pair", F.explode(pairs)).drop("chunks")


class Trie:
    """Compressed prefix tree of sorted rank arrays. Nodes are kept in breadth-first order, so children lie together."""

    def __init__(self, sets: list[np.ndarray], names: np.ndarray):
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        sets = [sets[k] for k in order]
        self.names = names[order]
        sizes = np.array([len(s) for s in sets])
        self.flat = np.concatenate(sets)
        offset = np.concatenate([[0], np.cumsum(sizes)])
        shared = np.zeros(max(0, len(sets) - 1), np.int64)
        for k in range(len(shared)):
            n = min(sizes[k], sizes[k + 1])
            differ = np.flatnonzero(sets[k][:n] != sets[k + 1][:n])
            shared[k] = differ[0] if len(differ) else n
        rows: list[tuple[int, int, int, int, int, int, int]] = []  # begin in flat, length, depth at the end, least and most size, first and last+1 own sets
        spans: list[tuple[int, int]] = []
        children: list[tuple[int, int]] = []
        level = [(0, len(sets), 0)]
        top: list[tuple[int, int, int]] = []

        def below(lo: int, hi: int, depth: int) -> list[tuple[int, int, int]]:
            cuts = [lo, *(np.flatnonzero(shared[lo : hi - 1] <= depth) + lo + 1).tolist(), hi]
            return [(x, y, depth) for x, y in zip(cuts, cuts[1:])]

        top = below(*level[0])
        queue, self.roots = list(top), len(top)
        at = 0
        while at < len(queue):
            lo, hi, depth = queue[at]
            at += 1
            common = int(sizes[lo]) if hi - lo == 1 else int(min(shared[lo : hi - 1].min(), sizes[lo]))
            end = min(common, depth + SEGMENT)
            own = lo
            while own < hi and sizes[own] == end:
                own += 1
            rows.append((int(offset[lo]) + depth, end - depth, end, int(sizes[lo:hi].min()), int(sizes[lo:hi].max()), lo, own))
            more = [] if own == hi else below(own, hi, end) if end == common else [(own, hi, end)]
            children.append((len(queue), len(queue) + len(more)))
            queue += more
        self.begin, self.length, self.end, self.least, self.most, self.first, self.past = np.array(rows, np.int64).T
        self.kids = np.array(children, np.int64)

    def search(self, inside: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Places (in self.names) of the sets that link with a set, given by its size and a mark for each of its ranks."""
        found = []
        at, overlap = np.arange(self.roots), np.zeros(self.roots, np.int64)
        while len(at):
            length = self.length[at]
            starts = np.cumsum(length) - length
            places = np.arange(int(length.sum())) + np.repeat(self.begin[at] - starts, length)
            overlap = overlap + np.add.reduceat(inside[self.flat[places]], starts)
            end = self.end[at]
            # at best the rest of both is common; the most promising size of a set below is where both rests are equal
            best = np.clip(end + size - overlap, self.least[at], self.most[at])
            reach = overlap + np.minimum(size - overlap, best - end)
            alive = (100 + percent) * reach >= percent * (size + best)
            at, overlap, end = at[alive], overlap[alive], end[alive]
            linked = (self.past[at] > self.first[at]) & ((100 + percent) * overlap >= percent * (size + end))
            found += [np.arange(x, y) for x, y in zip(self.first[at[linked]], self.past[at[linked]])]
            counts = self.kids[at, 1] - self.kids[at, 0]
            begin = np.cumsum(counts) - counts
            overlap = np.repeat(overlap, counts)
            at = np.arange(int(counts.sum())) + np.repeat(self.kids[at, 0] - begin, counts)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def links(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[list[int], list[int]]:
    """Links between distinct sets of hashes that connect whatever all links connect: pairs of places in `sets`."""
    everything, ranks, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(everything), np.uint32)
    place[np.lexsort((everything, -counts))] = np.arange(len(everything), dtype=np.uint32)  # frequent first: near copies share paths
    bounds = np.cumsum([len(s) for s in sets])[:-1]
    sets = [np.sort(x) for x in np.split(place[ranks.ravel()], bounds)]
    inside = np.zeros(len(everything), np.int64)
    alive = np.ones(len(sets), bool)
    trie, held = Trie(sets, np.arange(len(sets))), len(sets)
    a, b = [], []
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed] = False
        queue = [seed]
        while queue:
            left = int(alive.sum()) if len(queue) % 16 == 1 or held < 64 else held
            if not left:
                return a, b
            if 2 * left < held:
                own = np.flatnonzero(alive)
                trie, held = Trie([sets[k] for k in own], own), left
            x = queue.pop()
            inside[sets[x]] = 1
            near = trie.names[trie.search(inside, len(sets[x]), percent)]
            inside[sets[x]] = 0
            for y in near[alive[near]].tolist():
                alive[y] = False
                a.append(x)
                b.append(y)
                queue.append(y)
    return a, b


def _join(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(n)
        key, nodes, sets = None, [], []
        a: list[int] = []
        b: list[int] = []

        def finish() -> None:
            if len(sets) > 1:
                x, y = links(sets, percent)
                a.extend(max(nodes[i], nodes[j]) for i, j in zip(x, y))
                b.extend(min(nodes[i], nodes[j]) for i, j in zip(x, y))

        for batch in batches:
            for unit, node, text in zip(batch.column("unit").to_pylist(), batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                if unit != key:
                    finish()
                    key, nodes, sets = unit, [], []
                if not nodes or nodes[-1] != node:  # copies of a text lie together
                    nodes.append(node)
                    sets.append(shingles.of(text))
        finish()
        x, y = forest(np.array(a, np.int64), np.array(b, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return run


def _member(shared):
    """Rows whose text_key is marked, each key once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        seen: set[int] = set()
        for batch in batches:
            key = batch.column("text_key").to_numpy()
            slot = (key.view(np.uint64) & np.uint64(8 * len(marks) - 1)).astype(np.int64)
            inside = (marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            for k in np.flatnonzero(inside).tolist():
                inside[k] = key[k] not in seen
                seen.add(int(key[k]))
            if len(seen) > 1_000_000:
                seen.clear()
            yield batch.filter(pa.array(inside))

    return run


def marks_of(keys: DataFrame, bits: int = FILTER) -> np.ndarray:
    """A bitmap of fixed size that has a mark for each text_key: what isn't marked is no such key."""
    slot = F.col("text_key").bitwiseAND(F.lit(bits - 1))
    words = keys.groupBy(F.shiftright(slot, 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(text_key & 31 as int))")).alias("value")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words["word"].to_numpy()] = words["value"].to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, unit: int = UNIT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    survey = written(rows.mapInArrow(_survey(n, SKETCH), "doc_id long, text_key long, size long, node long, sketch binary, long binary, part long, counts binary"), "survey")
    sets = survey.where("part is null").select("doc_id", "text_key", "size", "node")
    counts = spark.sparkContext.broadcast(count_sketch(survey))
    prefixes = rows.select("text").mapInArrow(_prefixes(n, counts, percent), "gram long, node long, size long")
    shared = prefixes.repartition("gram").sortWithinPartitions("gram").mapInArrow(_shared, "gram long, node long, size long")
    sketches = survey.where("size > 0").groupBy("node").agg(F.min("sketch").alias("sketch"))
    near = shared.join(sketches, "node").repartition("gram").sortWithinPartitions("gram", "size", "node").mapInArrow(_plausible(percent), EDGES)
    clusters = connected_components(near, reduced=True)

    # one text for each node of a cluster; a node keeps its own number, for texts may share their smallest doc_id
    best = F.coalesce("long", "sketch")
    nodes = written(survey.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.min("size").alias("size"), F.min(best).alias("best")), "nodes")
    firsts = written(nodes.drop("doc_id").join(clusters, "node"), "firsts")
    sizes = firsts.groupBy("component").agg(F.sum("size").alias("total"), F.sum(F.length("best")).alias("bytes")).withColumn("giant", F.col("total") > unit)
    giant = firsts.join(sizes.where("giant").select("component"), "component", "left_semi")
    fine = chunk_pairs(giant.select("component", "node", "size", "best"), sizes, "bytes", SKETCH_BYTES)
    fine = connected_components(fine.groupBy("component", "pair").applyInArrow(_refine(percent), EDGES), reduced=True)
    tight = firsts.join(sizes.where("not giant").select("component"), "component", "left_semi").select("node", "component").unionAll(fine)
    firsts = written(firsts.drop("component", "best").join(tight, "node"), "tight")

    sizes = firsts.groupBy("component").agg(F.sum("size").alias("total"))
    work = chunk_pairs(firsts.select("component", "node", "text_key"), sizes, "total", unit)
    marks = spark.sparkContext.broadcast(marks_of(firsts))
    texts = rows.select("text_key", "text").mapInArrow(_member(marks), "text_key long, text string")
    units = texts.join(work, "text_key").repartition("component", "pair").sortWithinPartitions("component", "pair", "node").select(F.concat_ws(" ", F.col("component").cast("string"), F.col("pair").cast("string")).alias("unit"), "node", "text")
    linked = connected_components(units.mapInArrow(_join(n, percent), EDGES), reduced=True)

    members = written(nodes.select("node", "doc_id").join(linked, "node", "left"), "members")
    inside = members.where("component is not null")
    least = inside.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = members.where("component is null").select("node", F.col("doc_id").alias("component_id"))
    found = inside.join(least, "component").select("node", "component_id").unionAll(alone)
    found = written(found, "found")  # so that both sides of the last join are plain, and a set with very many copies can be split
    named = sets.select("doc_id", F.col("size").alias("n_shingles"), "node").join(found, "node", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
