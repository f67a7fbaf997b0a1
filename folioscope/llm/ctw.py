"""Language-model scoring by context-tree weighting.

A text is read as the bytes of its words (A-Z in lower case) with a blank after each, then one end byte, 0x0A. A byte is eight binary
decisions. The context of a decision is the bits of its byte so far and the DEPTH bytes before it in the text, over word boundaries
(blanks before the text's first byte). At each depth a context has a Krichevsky-Trofimov estimate; a node's weighted probability is
half its own estimate's and half the product of its children's, the contexts one byte longer. So the model mixes the estimates of all
depths. It depends only on counts, which are sums: they are gathered by grouped aggregation over all training texts.

Training texts may have a class (their language). Each class has a tree of its own, and a text's probability is the mixture
over classes, weighted by their shares of the training texts: the class of a text that is scored is never read.

1. Blocks of documents become tables of the distinct (DEPTH + 1)-byte strings in them - a context and its byte - with training counts by
   class, and local dictionaries of words with counts, and each document's local word ids in order. Strings and words that occur only
   in held-out texts take part with count 0, so everything that has to be scored is there.
2. Strings are dealt into shares of the tree by a hash of their last two context bytes and merged there, at first in groups of blocks,
   then all. A share has all nodes of depth 2 and more of its contexts; sums of these give the nodes of depth 1 and 0 (at most
   256 * 255 + 255 rows a class, held on the driver). Going back down, each string gets its log probability.
3. These go back to the blocks, whose texts are put together again from words and ids: a document's score is the sum over its strings.
4. For the unigram base, words are dealt into parts by a hash, their training counts summed over blocks and sent back to them.

Between steps, what goes from one task to another is packed in one row, as arrays. Numbers of parts and shares follow the numbers of words and
strings, so that a task holds about PART_WORDS local words or PART_STRINGS strings.

Log probabilities of strings travel with 11 bits of mantissa: a string's term has a relative error of at most 1/4,096, a text's score far less,
since the errors of its strings are independent.

Nulls: a null text is empty (one token, the end); a null doc_id counts as the text '' where documents are dealt into training and
held-out ones. Repeated rows count, and are scored, each. Without any training text all counts are 0 and each bit has probability 1/2.
An empty table gives no rows. Other columns are ignored. Very long words and texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, mix64, packed, small_batches, table, unpacked, written

DEPTH = 6
END = b"\n"
#: Tokens of a block, blocks' words of a part of the vocabulary, and blocks' strings of a share of the tree. A block's strings are sent to it once each, so
#: that few large blocks move less than many small ones, which repeat most of them.
BLOCK_TOKENS, PART_WORDS, PART_STRINGS = 5_500_000, 400_000, 400_000
#: Words, documents or strings that travel in one row; blocks whose strings are merged at a time; bytes of texts coded at a time.
ROW_WORDS, ROW_DOCS, ROW_STRINGS, GROUP, CHUNK = 50_000, 500, 500_000, 64, 1 << 20
#: Classes with trees of their own; the least frequent labels beyond share the last one.
CLASSES = 8
LOG_HALF = math.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series after a shift by 8."""
    shift = np.zeros_like(x)
    y = x.astype(np.float64).copy()
    small = y < 8
    product = np.ones_like(y)
    for _ in range(8):
        product = np.where(small, product * y, product)
        y = np.where(small, y + 1, y)
        small = y < 8
        if not small.any():
            break
    shift = np.log(product)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


#: Estimates of small counts, of which a tree has very many: looked up.
_SMALL = 128
_KT = _log_kt(*(x.ravel().astype(np.float64) for x in np.meshgrid(np.arange(_SMALL), np.arange(_SMALL), indexing="ij")))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    small = (zeros < _SMALL) & (ones < _SMALL)
    at = np.where(small, zeros * _SMALL + ones, 0).astype(np.int32)
    out = _KT[at]
    large = np.flatnonzero(~small)
    out[large] = _log_kt(zeros[large], ones[large])
    return out


# --- byte strings of texts ----------------------------------------------------------------------------------------


def spelled(text: str | None) -> list[bytes]:
    """The words of a text and the end."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z change, only 0x09-0x0D and blanks separate
    words.append(END)
    return words


def strings_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts, one text after the other: the bytes before it and the byte as one number; and the texts' lengths."""
    gap = b" " * depth
    data = np.frombuffer(gap + gap.join(texts), np.uint8)
    codes = np.zeros(len(data) - depth, np.int64)
    for k in range(depth + 1):
        codes <<= 8
        codes |= data[k : k + len(codes)]
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + depth) - lengths - depth
    edge = np.zeros(len(codes) + 1, np.int8)
    edge[starts] += 1
    edge[starts + lengths] -= 1
    return codes[np.cumsum(edge[:-1]) > 0], lengths


def lots(texts: list, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of lots of neighbouring texts of about `size` bytes."""
    lo, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def merged(tables: list[tuple[np.ndarray, np.ndarray]], size: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Tables of ascending numbers and rows of counts as one, in order of the numbers; about `size` rows are sorted at a time."""
    longest = max((c for c, _ in tables), key=len)
    steps = 1 + sum(len(c) for c, _ in tables) // size
    edges = np.unique(longest[np.arange(1, steps) * len(longest) // steps]) if len(longest) else longest
    cuts = [[0, *np.searchsorted(c, edges).tolist(), len(c)] for c, _ in tables]
    found = []
    for k in range(len(edges) + 1):
        keys = np.concatenate([c[at[k] : at[k + 1]] for (c, _), at in zip(tables, cuts)])
        order = np.argsort(keys)
        keys = keys[order]
        sums, starts = np.concatenate([n[at[k] : at[k + 1]] for (_, n), at in zip(tables, cuts)])[order], runs(keys)
        found.append((keys[starts], np.add.reduceat(sums, starts, axis=0, dtype=sums.dtype) if len(keys) else sums))
    return np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found])


def marked_counts(texts: list[bytes], kinds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of the texts with their class in the lowest 4 bits, and how often each comes; kinds: as for string_counts."""
    marks = (kinds & 15).astype(np.int8)  # a string and its text's class are sorted as one number; 15 stands for no class
    tables = [(np.zeros(0, np.int64), np.zeros((0, 1), np.uint32))]
    for lo, hi in lots(texts, 2 * CHUNK):
        keys, lengths = strings_of(texts[lo:hi], depth)
        keys <<= 4
        keys |= np.repeat(marks[lo:hi], lengths)
        keys.sort()
        starts = runs(keys)
        tables.append((keys[starts], np.diff(starts, append=len(keys)).astype(np.uint32)[:, None]))
        if sum(len(c) for c, _ in tables[1:]) > 2_000_000:
            tables = [merged(tables)]
    return merged(tables)


def by_class(keys: np.ndarray, counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Marked strings and their counts as strings and their counts by class."""
    codes, kind = keys >> 4, (keys & 15).astype(np.int8)
    starts = runs(codes)
    sums = np.zeros((len(starts), classes), np.uint32)
    at = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(codes)))
    own = kind < classes
    sums[at[own], kind[own]] = counts[own, 0]
    return codes[starts], sums


def string_counts(texts: list[bytes], kinds: np.ndarray, classes: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of the texts, and their counts by class; kinds: a class for each text, -1 for held-out ones."""
    return by_class(*marked_counts(texts, kinds, depth), classes)


class Places:
    """Finds the places of strings in a table of distinct ones, all of which are there: in order of a hash's slots, `order` of the table."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, (2 * len(codes)).bit_length())
        slot = self.slot(codes)
        self.order = np.argsort(slot, kind="stable")
        self.codes = codes[self.order]
        self.starts = np.cumsum(np.bincount(slot + 1, minlength=1 << self.bits)).astype(np.int32)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        at = self.starts[self.slot(codes)]
        left = np.flatnonzero(self.codes[at] != codes)
        while len(left):
            at[left] += 1
            left = left[self.codes[at[left]] != codes[left]]
        return at


def lookup_sums(texts: list[bytes], places: Places, logs: list[np.ndarray], depth: int) -> np.ndarray:
    """For each text the sum, by class, of its strings' logs; logs: for each class, in the order of places."""
    found = [np.zeros((0, len(logs)))]
    for lo, hi in lots(texts, CHUNK):
        own, lengths = strings_of(texts[lo:hi], depth)
        at, starts = places.of(own), np.cumsum(lengths) - lengths
        found.append(np.stack([np.add.reduceat(x[at], starts, dtype=np.float64) for x in logs], axis=1))
    return np.concatenate(found)


def shortened(logs: np.ndarray) -> np.ndarray:
    """32-bit floats rounded to 11 bits of mantissa, which pack better."""
    bits = logs.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(0x800)) & np.uint32(0xFFFFF000)).view(np.float32)


# --- the weighted tree --------------------------------------------------------------------------------------------


class Level:
    """The strings of one depth - context (the last `depth` bytes) and byte, as one number - with their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int):
        mask = (1 << (8 * (depth + 1))) - 1
        self.codes, of = np.unique(codes & mask, return_inverse=True)
        self.of = of.astype(np.int32)  # from strings one byte longer
        self.counts = np.bincount(self.of, weights=counts, minlength=len(self.codes))


def levels(codes: np.ndarray, counts: np.ndarray, low: int, depth: int) -> list[Level]:
    """Levels of depth `low` to `depth`."""
    out: list[Level] = []
    for d in range(depth, low - 1, -1):
        out.append(Level(codes, counts, d))
        codes, counts = out[-1].codes, out[-1].counts
    return out[::-1]


class Nodes:
    """A level's nodes for one of the eight bits: (context, bits so far), in the order of its strings."""

    def __init__(self, level: Level, bit: int):
        self.keys = (level.codes >> 8 << 8) | (((level.codes & 0xFF) | 256) >> (8 - bit))
        new = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])
        self.keys = self.keys[new]
        self.of = (np.cumsum(new) - 1).astype(np.int32)
        one = (level.codes >> (7 - bit)) & 1
        self.ones = np.bincount(self.of, weights=level.counts * one, minlength=len(self.keys))
        self.zeros = np.bincount(self.of, weights=level.counts, minlength=len(self.keys)) - self.ones
        self.log_kt = log_kt(self.zeros, self.ones)
        self.log_weighted, self.own = self.log_kt, None  # own: the share of the node's own estimate in what it predicts

    def weigh(self, below: Nodes, strings: np.ndarray) -> None:
        """Mix with the product of the children's weighted probabilities; strings: from the deeper strings to this level's."""
        first = np.flatnonzero(np.concatenate([[True], below.of[1:] != below.of[:-1]]))  # a string of each child
        children = np.bincount(self.of[strings[first]], weights=below.log_weighted, minlength=len(self.keys))
        self.log_weighted = LOG_HALF + np.logaddexp(self.log_kt, children)
        self.own = np.exp(LOG_HALF + self.log_kt - self.log_weighted)


def weighed(tree: list[Level], bit: int) -> list[Nodes]:
    """The nodes of all levels for one bit, weighed from below. Bits don't depend on each other, so one is held at a time."""
    out = [Nodes(tree[-1], bit)]
    for above, below in zip(tree[-2::-1], tree[:0:-1]):
        out.append(Nodes(above, bit))
        out[-1].weigh(out[-2], above.of)
    return out[::-1]


def top_levels(nodes: dict[tuple[int, int], tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """From depth-2 sums by (last byte, bits so far) - zeros, ones, sum of log weighted: depth 1 and 0 as arrays.

    Returns for depth 1 an array [256, 256, 3] and for depth 0 [256, 3] of zeros, ones and the own estimate's share."""
    zeros, ones, below = (np.zeros((256, 256)) for _ in range(3))
    for (last, node), (z, o, w) in nodes.items():
        zeros[last, node], ones[last, node], below[last, node] = z, o, w
    kt = log_kt(zeros.ravel(), ones.ravel()).reshape(256, 256)
    weighted = LOG_HALF + np.logaddexp(kt, below)
    one = np.stack([zeros, ones, np.exp(LOG_HALF + kt - weighted)], axis=-1)
    z0, o0, w0 = zeros.sum(axis=0), ones.sum(axis=0), weighted.sum(axis=0)
    kt0 = log_kt(z0, o0)
    return one, np.stack([z0, o0, np.exp(LOG_HALF + kt0 - (LOG_HALF + np.logaddexp(kt0, w0)))], axis=-1)


def log_probabilities(tree: list[Level], top: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Natural log of the mixed probability of each string of the deepest level; `top` has depth 1 and 0 if `tree` begins at 2."""
    codes = tree[-1].codes
    total = np.zeros(len(codes))
    for bit in range(8):
        one = (codes >> (7 - bit)) & 1 == 1
        mixed, path = None, None
        for level, nodes in zip(tree[::-1], weighed(tree, bit)[::-1]):
            at = nodes.of if path is None else nodes.of[path]
            p = (np.where(one, nodes.ones[at], nodes.zeros[at]) + 0.5) / (nodes.zeros[at] + nodes.ones[at] + 1)
            mixed = p if nodes.own is None else nodes.own[at] * p + (1 - nodes.own[at]) * mixed
            above = tree[tree.index(level) - 1] if level is not tree[0] else None
            if above is not None:
                path = above.of if path is None else above.of[path]
        if top is not None:
            node, last = ((codes & 0xFF) | 256) >> (8 - bit), (codes >> 8) & 0xFF
            for stats in (top[0][last, node], top[1][node]):
                p = (np.where(one, stats[:, 1], stats[:, 0]) + 0.5) / (stats[:, 0] + stats[:, 1] + 1)
                mixed = stats[:, 2] * p + (1 - stats[:, 2]) * mixed
        total += np.log(mixed)
    return total


# --- tables -------------------------------------------------------------------------------------------------------


_BLOCK = "block long, first_id long, n_words long, words array<binary>, trained binary, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, ids binary, n_strings long, codes binary, sums binary"


def _blocks(classes: int, depth: int):
    """Rows of three kinds, of bounded size: a block's words (from local id `first_id` on) with their training counts by class; its
    documents (doc_id, held_out, n_tokens, ids in order); its strings with their training counts by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kinds_of = {"long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
        fields = [f.split() for f in _BLOCK.split(", ")]
        row = lambda **values: pa.RecordBatch.from_arrays([pa.array([values.get(n)], kinds_of[k]) for n, k in fields], [n for n, _ in fields])
        block = TaskContext.get().partitionId() << 32
        spelt: list[pa.Array] = []  # words of the block's documents
        docs: list[tuple] = []
        texts: list[bytes] = []
        kinds: list[int] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, tokens
            if docs:
                coded = pa.chunked_array(spelt).unify_dictionaries()
                spelt.clear()
                words, ids = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks])
                del coded
                held = np.repeat(np.array(kinds, np.int8), [d[2] for d in docs])
                counts = np.stack([np.bincount(ids[held == kind], minlength=len(words)) for kind in range(classes)], axis=1).astype(np.uint32)
                starts = np.concatenate([[0], np.cumsum([d[2] for d in docs])])
                for lo in range(0, len(words), ROW_WORDS):
                    own = words[lo : lo + ROW_WORDS]
                    yield row(block=block, first_id=lo, n_words=len(own), words=own.to_pylist(), trained=packed(counts[lo : lo + ROW_WORDS]))
                for lo in range(0, len(docs), ROW_DOCS):
                    doc_id, held_out, n_tokens = map(list, zip(*docs[lo : lo + ROW_DOCS]))
                    yield row(block=block, doc_id=doc_id, held_out=held_out, n_tokens=n_tokens, ids=packed(ids[starts[lo] : starts[lo + len(doc_id)]].astype(np.uint32)))
                # words and ids aren't held while strings are counted
                del words, ids, held, counts, starts, own
                pa.default_memory_pool().release_unused()
                keys, counts = marked_counts(texts, np.array(kinds), depth)
                texts.clear()
                starts = runs(keys >> 4)
                for lo in range(0, len(starts), ROW_STRINGS):
                    part = slice(starts[lo], starts[lo + ROW_STRINGS] if lo + ROW_STRINGS < len(starts) else None)
                    own, sums = by_class(keys[part], counts[part], classes)
                    yield row(block=block, n_strings=len(own), codes=packed(np.diff(own, prepend=0)), sums=packed(sums))
            for x in (spelt, docs, texts, kinds):
                x.clear()
            block, tokens = block + 1, 0

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lot = [spelled(t) for t in part.column("text").to_pylist()]
                spelt.append(pa.array([w for words in lot for w in words], pa.binary()).dictionary_encode())
                docs += zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), map(len, lot))
                texts += [b" ".join(words) for words in lot]
                kinds += [-1 if h else k for h, k in zip(part.column("held_out").to_pylist(), part.column("kind").to_pylist())]
                tokens += sum(map(len, lot))
                if tokens > BLOCK_TOKENS:
                    yield from flush()
        yield from flush()

    return run


def _deal_words(classes: int, parts: int):
    """A block's words by part: a row for each part that has any; `ids` are their local ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for block, first_id, words, trained in zip(batch.column("block").to_pylist(), batch.column("first_id").to_pylist(), batch.column("words"), batch.column("trained").to_pylist()):
                words = words.values
                part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words.to_pylist()), np.int64, len(words))
                counts = unpacked(trained, np.uint32).reshape(-1, classes)
                order = np.argsort(part, kind="stable")
                found, starts = np.unique(part[order], return_index=True)
                for p, own in zip(found.tolist(), np.split(order, starts[1:])):
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), words.take(pa.array(own))), pa.array([packed(counts[own])]), pa.array([packed(np.diff(own + first_id, prepend=0).astype(np.uint32))])], ["part", "block", "words", "trained", "ids"])

    return run


def _merge_words(classes: int):
    """One part: its distinct words' training counts; and for each block its local ids with the words' places."""

    def run(table: pa.Table) -> pa.Table:
        own = table.column("words").combine_chunks()
        rows = np.diff(own.offsets.to_numpy())
        at = own.flatten().dictionary_encode().indices.to_numpy()
        trained = [unpacked(t.as_py(), np.uint32).reshape(-1, classes).sum(axis=1, dtype=np.int64) for t in table.column("trained")]
        sums = np.bincount(at, weights=np.concatenate(trained)).astype(np.int64)
        places = np.split(at, np.cumsum(rows)[:-1])
        return pa.table({
            "part": pa.array(table.column("part").to_pylist(), pa.int64()), "tokens": pa.array([int(sums.sum())] + [0] * (len(places) - 1)), "types": pa.array([int((sums > 0).sum())] + [0] * (len(places) - 1)),
            "of_block": table.column("block"), "ids": table.column("ids"), "counts": pa.array([packed(sums[at]) for at in places], pa.binary()),
        })

    return run


def share_of(codes: np.ndarray, shares: int) -> np.ndarray:
    """The share of the tree that a string belongs to, by its last two context bytes."""
    return (mix64((codes >> 8) & 0xFFFF) % np.uint64(shares)).astype(np.int64)


def _deal_strings(classes: int, shares: int, with_sums: bool):
    """Rows of a block's strings by share: a row for each share that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, codes, sums in zip(batch.column("block").to_pylist(), batch.column("codes"), batch.column("sums")):
                codes = np.cumsum(unpacked(codes.as_py(), np.int64))
                sums = unpacked(sums.as_py(), np.uint32).reshape(-1, classes) if with_sums else None
                share = share_of(codes, shares)
                order = np.argsort(share, kind="stable")
                found, starts = np.unique(share[order], return_index=True)
                for q, own in zip(found.tolist(), np.split(order, starts[1:])):
                    yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([block]), pa.array([packed(np.diff(codes[own], prepend=0))]), pa.array([packed(sums[own]) if with_sums else None], pa.binary())], ["share", "block", "codes", "sums"])

    return run


def _merge_strings(classes: int, kind: type):
    """Strings of a share, summed over what a group of blocks, or all groups, have of it."""

    def run(table: pa.Table) -> pa.Table:
        codes, sums = merged([(np.cumsum(unpacked(c.as_py(), np.int64)), unpacked(n.as_py(), kind).reshape(-1, classes).astype(np.int64)) for c, n in zip(table.column("codes"), table.column("sums"))])
        return pa.table({"share": table.column("share")[:1], "codes": pa.array([packed(np.diff(codes, prepend=0))]), "sums": pa.array([packed(sums)])})

    return run


def _strings(table: pa.Table, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """A share's strings and their counts by class."""
    codes, sums = (table.column(c)[0].as_py() for c in ("codes", "sums"))
    return np.cumsum(unpacked(codes, np.int64)), unpacked(sums, np.int64).reshape(-1, classes).T


def _low_sums(classes: int, depth: int):
    """Depth-2 nodes of a share, summed by class, last byte and bits so far."""

    def run(table: pa.Table) -> pa.Table:
        codes, counts = _strings(table, classes)
        out = []
        for k in range(classes):
            tree = levels(codes, counts[k], 2, depth)
            for bit in range(8):
                low = weighed(tree, bit)[0]
                group, at = np.unique(((low.keys >> 8) & 0xFF) << 8 | (low.keys & 0xFF), return_inverse=True)
                out.append((np.full(len(group), k), group >> 8, group & 0xFF, *(np.bincount(at, weights=x) for x in (low.zeros, low.ones, low.log_weighted))))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["kind", "last", "node", "zeros", "ones", "below"])

    return run


def _string_scores(classes: int, depth: int, shared):
    """A share's strings with their log probabilities by class."""

    def run(table: pa.Table) -> pa.Table:
        codes, counts = _strings(table, classes)
        logs = np.stack([log_probabilities(levels(codes, counts[k], 2, depth), shared.value[k]) for k in range(classes)], axis=1)
        return pa.table({"share": table.column("share"), "all_codes": table.column("codes"), "logs": pa.array([packed(shortened(logs))])})

    return run


def _to_blocks(classes: int):
    """For each row of a block's strings in a share: their log probabilities, in the same order."""

    def run(dealt: pa.Table, scored: pa.Table) -> pa.Table:
        codes = np.cumsum(unpacked(scored.column("all_codes")[0].as_py(), np.int64))
        logs = unpacked(scored.column("logs")[0].as_py(), np.float32).reshape(-1, classes)
        own = [logs[np.searchsorted(codes, np.cumsum(unpacked(c.as_py(), np.int64)))] for c in dealt.column("codes")]
        none = pa.nulls(len(own), pa.binary())
        return pa.table({"of_block": dealt.column("block"), "ids": none, "counts": none, "codes": dealt.column("codes"), "logs": pa.array([packed(x) for x in own], pa.binary())})

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _document_scores(total: tuple[int, int], prior: list[float], depth: int):
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        own = block.filter(pc.is_valid(block.column("words")))
        words = [w for _, part in sorted(zip(own.column("first_id").to_pylist(), own.column("words").to_pylist())) for w in part]
        c = np.zeros(len(words), np.int64)
        strings, logs = [np.zeros(0, np.int64)], [np.zeros((0, len(prior)), np.float32)]
        for ids, counts, codes, values in zip(*(told.column(k) for k in ("ids", "counts", "codes", "logs"))):
            if ids.is_valid:
                c[np.cumsum(unpacked(ids.as_py(), np.uint32).astype(np.int64))] = unpacked(counts.as_py(), np.int64)
            else:
                strings.append(np.cumsum(unpacked(codes.as_py(), np.int64)))
                logs.append(unpacked(values.as_py(), np.float32).reshape(-1, len(prior)))
        places, logs = Places(np.concatenate(strings)), np.concatenate(logs)
        logs = [logs[places.order, k] for k in range(len(prior))]
        base = np.log10((c + 1) / (total[0] + total[1] + 1))
        known = (c > 0).astype(np.int64)
        docs = block.filter(pc.is_valid(block.column("ids")))
        n_known, base_score, scores, lengths = [], [], [], []
        for blob, n_tokens in zip(docs.column("ids"), docs.column("n_tokens").to_pylist()):
            ids = unpacked(blob.as_py(), np.uint32).astype(np.int64)
            starts = np.cumsum(n_tokens) - n_tokens
            n_known.append(np.add.reduceat(known[ids], starts))
            base_score.append(np.add.reduceat(base[ids], starts))
            spelt = list(map(words.__getitem__, ids.tolist()))
            texts = [b" ".join(spelt[a : a + n]) for a, n in zip(starts.tolist(), n_tokens)]
            scores.append(np.logaddexp.reduce(lookup_sums(texts, places, logs, depth) + np.array(prior), axis=1))
            lengths += [len(t) for t in texts]
        score = np.concatenate(scores)
        out = [*(pa.concat_arrays(docs.column(k).chunks).flatten() for k in ("doc_id", "held_out", "n_tokens")), pa.array(np.concatenate(n_known)), pa.array([total[0]] * len(score), pa.int64()), pa.array(np.concatenate(base_score)), pa.array(score / math.log(10)), pa.array(-score / math.log(2) / np.array(lengths))]
        return pa.table(out, [f.split()[0] for f in _RESULT.split(", ")])

    return run


def score(docs: DataFrame, held_out: Column, label: str | None = None, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability) and bits_per_byte (its code
    length) of each row.

    label: a column that has the class of training rows; null labels are a class. depth: 2 to 6."""
    if not 2 <= depth <= 6:
        raise ValueError("a context has 2 to 6 bytes")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"), (F.col(label) if label else F.lit("")).cast("string").alias("label"))
    labels = rows.where(~F.col("held_out")).groupBy("label").agg(F.count("*").alias("n"))
    seen = labels.orderBy(F.desc("n"), "label").limit(CLASSES).collect()
    names = [r["label"] for r in seen]
    classes = max(1, len(names))
    numbers = [r["n"] + 1 for r in seen] or [1]
    if classes == CLASSES:  # the last class takes all further labels
        numbers[-1] = 1 + labels.agg(F.sum("n")).first()[0] - sum(r["n"] for r in seen[:-1])
    prior = [math.log(x / sum(numbers)) for x in numbers]
    kind = F.lit(classes - 1)
    for k, name in reversed(list(enumerate(names[: classes - 1]))):
        kind = F.when(F.col("label").eqNullSafe(F.lit(name)), k).otherwise(kind)

    blocks = written(rows.select("doc_id", "text", "held_out", kind.alias("kind")).mapInArrow(_blocks(classes, depth), _BLOCK), "blocks")
    n_words, n_strings, n_blocks = blocks.agg(F.sum("n_words"), F.sum("n_strings"), F.countDistinct("block")).first()
    parts, shares, groups = 1 + (n_words or 0) // PART_WORDS, 1 + (n_strings or 0) // PART_STRINGS, 1 + n_blocks // GROUP

    # counts of words, summed by part and sent back to the blocks
    dealt = blocks.where("words is not null").select("block", "first_id", "words", "trained").mapInArrow(_deal_words(classes, parts), "part long, block long, words array<binary>, trained binary, ids binary")
    schema = "part long, tokens long, types long, of_block long, ids binary, counts binary"
    vocabulary = written(dealt.repartition(parts, "part").groupBy("part").applyInArrow(_merge_words(classes), schema), "vocabulary")
    sizes = vocabulary.agg(F.sum("tokens"), F.sum("types")).first()
    total = (int(sizes[0] or 0), int(sizes[1] or 0))

    # counts of strings, merged by share in two steps; the tree; log probabilities, sent back to the blocks
    strings = blocks.where("codes is not null").select("block", "codes", "sums")
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("long").alias("group")
    schema = "share long, block long, codes binary, sums binary"
    dealt = strings.mapInArrow(_deal_strings(classes, shares, True), schema).select("*", group).repartition(shares, "share", "group")
    schema = "share long, codes binary, sums binary"
    some = dealt.groupBy("share", "group").applyInArrow(_merge_strings(classes, np.uint32), schema)
    tree = written(some.repartition(shares, "share").groupBy("share").applyInArrow(_merge_strings(classes, np.int64), schema), "tree")
    sums = tree.groupBy("share").applyInArrow(_low_sums(classes, depth), "kind long, last long, node long, zeros double, ones double, below double").groupBy("kind", "last", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect()  # at most CLASSES * 256 * 255 rows
    top = spark.sparkContext.broadcast([top_levels({(r[1], r[2]): (r[3], r[4], r[5]) for r in sums if r[0] == k}) for k in range(classes)])
    logs = written(tree.groupBy("share").applyInArrow(_string_scores(classes, depth, top), "share long, all_codes binary, logs binary"), "logs")
    logs = logs.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    again = strings.mapInArrow(_deal_strings(classes, shares, False), "share long, block long, codes binary, sums binary").select("share", "block", "codes", group)
    schema = "of_block long, ids binary, counts binary, codes binary, logs binary"
    back = again.groupBy("share", "group").cogroup(logs.groupBy("share", "group")).applyInArrow(_to_blocks(classes), schema)

    none = F.lit(None).cast("binary")
    told = vocabulary.select("of_block", "ids", "counts", none.alias("codes"), none.alias("logs")).unionAll(back)
    texts = blocks.where("codes is null").select("block", "first_id", "words", "doc_id", "held_out", "n_tokens", "ids")
    return texts.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(_document_scores(total, prior, depth), _RESULT)


def op1_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2, "lang")
