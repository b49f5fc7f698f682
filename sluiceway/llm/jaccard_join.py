"""Exact Jaccard self-join of word n-gram sets with signature trees.

Two sets link when ``100 * overlap >= threshold * union``.  Equal sets are folded
to one *class* first; the join finds links between classes and their components.

1. *Sets.*  Each text becomes a sorted array of 48-bit n-gram hashes, written
   once to the shared folder.
2. *Order.*  A counting sketch of fixed size over all sets ranks tokens from rare
   to frequent.  Any order keeps the join exact; a good one keeps groups small.
3. *Groups.*  In that order two linked sets share at least ``l`` tokens of their
   first ``n - ceil(t n) + l``.  These leading tokens meet in buckets of the hash
   range; sets with the same company are one group, whatever the token; sets with
   fewer than ``l`` shared leading tokens are done.
4. *Families.*  Groups are gathered under the set that meets most company: near
   copies of one text share it, so each set travels about once with its tokens.
   It leaves families that hold too little of it to matter.
5. *Trees.*  A task compares all its sets with that head and builds signature
   trees over the rest: nodes carry OR-combined bitmaps and size ranges, and a dual
   traversal drops node pairs whose largest possible overlap is too small or that
   lie in one component already.  What is left is compared on the full sets, where
   they are: pairs never become rows, only links that tie components together do.
6. *Blocks.*  A family over ``BLOCK`` tokens is first joined block by block; then
   the sets outside its largest component meet the other blocks in tasks of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, materialise, release, shared_dir, shuffle_partitions, utf8
from .components import connected_components

#: Cells of the counting sketch: its levels (one byte each) are all that is sent to the tasks.
CELLS = 1 << 18
_CHUNKS = 8
#: Share of a set that must be met again among the leading tokens.
EXTRA = 0.05
#: Tokens in a block of a large family, sets in a leaf of a tree, and sets that are compared without one.
BLOCK = 300_000
LEAF = 64
FEW = 8
#: Most bits of the filter that keeps unneeded sets out of the shuffle (32 MB); a fuller one only lets more through.
BLOOM_BITS = 1 << 28
_MASK = np.uint64((1 << 48) - 1)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def token_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of the whole sequence if it is shorter."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    out = h[: len(h) - n + 1]
    for j in range(1, n):
        out = _mix(out) * _U(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j]
    return np.unique(_mix(out))


def pack_tokens(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_tokens(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def bitmap_width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two between 2 n and 4 n, at least 64."""
    return max(64, 1 << (2 * n - 1).bit_length())


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) OR-folded to fewer words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


_SETS = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("proof", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])


def _sets(size: int):
    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in part:
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for lo in range(0, len(ids), 1000):
                names, proofs, ns, toks = [], [], [], []
                for text in texts[lo : lo + 1000]:
                    s = token_set(text, size)
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    name, proof = (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)
                    tokens = None
                    if len(s) and digest not in seen:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen.add(digest)
                        # Sorting again: the 48 bits kept are the low ones.
                        tokens = pack_tokens(np.unique(s & _MASK))
                    names.append(name)
                    proofs.append(proof)
                    ns.append(len(s))
                    toks.append(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 1000], pa.int64()), pa.array(names, pa.int64()), pa.array(proofs, pa.int64()), pa.array(ns, pa.int64()), pa.array(toks, pa.binary())], schema=_SETS)
        release()

    return work


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (_mix(tokens) >> _U(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _levels(sets: DataFrame) -> bytes:
    """Binary logarithms of the sketch's counts over all sets."""
    step = CELLS // _CHUNKS

    def count(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        some = None
        for b in part:
            for t in b.column(0).to_pylist():
                some = (xxhash.xxh3_64_intdigest(t[:48]) & 31) if some is None else some
                total += np.bincount(_cells(unpack_tokens(t)), minlength=CELLS).astype(np.uint32) if len(t) > 6 * CELLS // 8 else 0
                if len(t) <= 6 * CELLS // 8:
                    np.add.at(total, _cells(unpack_tokens(t)), 1)
        if some is not None:
            rows = [zlib.compress(total[i * step : (i + 1) * step].tobytes(), 1) for i in range(_CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array([some * _CHUNKS + i for i in range(_CHUNKS)], pa.int32()), pa.array(rows, pa.binary())], names=["key", "cells"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(step, np.uint32)
        for x in table.column("cells").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        return pa.table({"key": pa.array([key[0].as_py() % _CHUNKS], pa.int32()), "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = sets.select("tokens").filter("tokens is not null").mapInArrow(count, "key int, cells binary")
    summed = rows.groupBy("key").applyInArrow(add, "key int, cells binary").groupBy("key").applyInArrow(add, "key int, cells binary")
    total = np.zeros((_CHUNKS, step), np.uint32)
    for r in summed.collect():
        total[r["key"]] = np.frombuffer(zlib.decompress(bytes(r["cells"])), np.uint32)
    return np.floor(np.log2(total.reshape(-1) + 1.0)).astype(np.uint8).tobytes()


def leading(n: int, threshold: int, extra: float) -> tuple[int, int]:
    """How many leading tokens of a set of n take part, and how many a linked set must share of them."""
    least = -(-threshold * n // 100)
    more = max(1, int(extra * n))
    return min(n, n - least + more), max(1, int(extra * least))


def _hot_level(levels: bytes, buckets: int) -> int:
    """Level from which a cell may hold over an eighth of an average bucket: its tokens are dealt out by set."""
    total = float((2.0 ** np.frombuffer(levels, np.uint8)).sum())
    return max(12, int(np.ceil(np.log2(total / buckets / 8 + 1))))


def _entries(levels, buckets: int, threshold: int):
    """Leading tokens by bucket; a blob is a count, then classes, sizes, run lengths and tokens.

    A token goes to the bucket of its hash; one of a hot cell to that of hash and class.
    """

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        hot = _hot_level(levels.value, buckets)
        held: list[tuple[int, int, np.ndarray]] = []
        entries = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(t) for _, _, t in held])
            tokens = np.concatenate([t for _, _, t in held])
            owner = np.repeat(np.arange(len(held)), lengths)
            cls = np.array([c for c, _, _ in held], np.int64)
            ns = np.array([n for _, n, _ in held], np.int64)
            own = np.where(level[_cells(tokens)] >= hot, cls[owner].view(np.uint64), _U(0))
            bucket = (_mix(tokens ^ own) % _U(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            tokens, owner, bucket = tokens[order], owner[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            names, blobs = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                who, runs = np.unique(owner[a:b], return_counts=True)
                names.append(int(bucket[a]))
                blobs.append(len(who).to_bytes(4, "little") + cls[who].tobytes() + ns[who].astype("<u4").tobytes() + runs.astype("<u4").tobytes() + pack_tokens(tokens[a:b]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for b in part:
            for cls, n, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                tokens = unpack_tokens(data)
                take, _ = leading(n, threshold, EXTRA)
                if take < len(tokens):
                    lv = level[_cells(tokens)]
                    tokens = tokens[np.argsort(lv, kind="stable")[:take]]
                held.append((cls, n, tokens))
                entries += len(tokens)
                if entries >= 2_000_000:
                    yield flush()
                    held, entries = [], 0
        if held:
            yield flush()

    return work


def _groups(levels, buckets: int):
    """Sets that share a token of this bucket: group (hash of its company), class, size, tokens of that company.

    Entries of hot tokens pass through: such a group is named by its token and met again by name.
    """

    def work(key: tuple, table: pa.Table) -> pa.Table:
        level = np.frombuffer(levels.value, np.uint8)
        cls, ns, toks = [], [], []
        for blob in table.column("blob").to_pylist():
            k = int.from_bytes(blob[:4], "little")
            c = np.frombuffer(blob, np.int64, k, 4)
            n = np.frombuffer(blob, "<u4", k, 4 + 8 * k)
            runs = np.frombuffer(blob, "<u4", k, 4 + 12 * k)
            cls.append(np.repeat(c, runs))
            ns.append(np.repeat(n, runs))
            toks.append(unpack_tokens(blob[4 + 16 * k :]))
        cls, ns, toks = np.concatenate(cls), np.concatenate(ns).astype(np.int64), np.concatenate(toks)
        order = np.lexsort((cls, toks))
        cls, ns, toks = cls[order], ns[order], toks[order]
        # A class may come from several tasks.
        first = np.concatenate(([True], (toks[1:] != toks[:-1]) | (cls[1:] != cls[:-1])))
        cls, ns, toks = cls[first], ns[first], toks[first]
        hot = level[_cells(toks)] >= _hot_level(levels.value, buckets)
        loose = {"gid": _mix(toks[hot]).view(np.int64), "cls": cls[hot], "n": ns[hot], "w": np.ones(int(hot.sum()), np.int64)}
        cls, ns, toks = cls[~hot], ns[~hot], toks[~hot]
        starts = np.flatnonzero(np.concatenate(([True], toks[1:] != toks[:-1]))) if len(toks) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [len(toks)])))
        company = np.add.reduceat(_mix(cls.view(np.uint64)), starts) if len(starts) else np.zeros(0, np.uint64)
        shared = sizes >= 2
        names, firsts, weights = np.unique(company[shared], return_index=True, return_counts=True)
        starts, sizes = starts[shared][firsts], sizes[shared][firsts]
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        found = {"gid": np.repeat(names, sizes).view(np.int64), "cls": cls[at], "n": ns[at], "w": np.repeat(weights, sizes).astype(np.int64)}
        return pa.table({k: np.concatenate((found[k], loose[k])) for k in found})

    return work


def similar_sizes(a, b, threshold: int):
    return (a * 100 >= b * threshold) & (b * 100 >= a * threshold)


def incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """A row of ones and zeros for each set over the given tokens."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.minimum(np.searchsorted(columns, flat), len(columns) - 1)
    hit = columns[at] == flat
    out = np.zeros((len(sets), len(columns)), np.float32)
    out[owner[hit], at[hit]] = 1
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of one list shares with each set of the other."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, len(common), 1 << 16):
        part = common[lo : lo + (1 << 16)]
        out += (incidence(left, part) @ incidence(right, part).T).astype(np.int64)
    return out


def shared_counts(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens the sets of each pair share; pairs are merged many at a time."""
    lengths = np.array([len(t) for t in tokens])
    weight = np.cumsum(lengths[left] + lengths[right])
    out = np.zeros(len(left), np.int64)
    lo = 0
    while lo < len(left):
        hi = int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + 4_000_000, "right"))
        hi = min(max(hi, lo + 1), lo + 60_000)
        tags = np.arange(hi - lo, dtype=np.uint64) << _U(48)
        both = np.concatenate([np.concatenate([tokens[i] for i in who[lo:hi]]) | np.repeat(tags, lengths[who[lo:hi]]) for who in (left, right)])
        both.sort()
        out[lo:hi] = np.bincount((both[1:][both[1:] == both[:-1]] >> _U(48)).astype(np.int64), minlength=hi - lo)
        lo = hi
    return out


class SignatureTree:
    """Sets of similar size, ordered by it, under nodes of two children each with OR-combined bitmaps."""

    def __init__(self, at: np.ndarray, n: np.ndarray, tokens: list[np.ndarray]):
        self.at = at[np.argsort(n[at], kind="stable")]
        self.sizes = n[self.at]
        width = bitmap_width(int(self.sizes[-1]))
        bits = np.zeros((len(at), width), np.uint8)
        for row, i in enumerate(self.at):
            bits[row, (tokens[i] & _U(width - 1)).astype(np.int64)] = 1
        self.bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.root = self._node(0, len(at))

    def _node(self, lo: int, hi: int) -> dict:
        node = {"lo": lo, "hi": hi, "least": int(self.sizes[lo]), "most": int(self.sizes[hi - 1])}
        if hi - lo <= LEAF:
            return node | {"bits": np.bitwise_or.reduce(self.bits[lo:hi], 0), "sub": ()}
        left, right = self._node(lo, (lo + hi) // 2), self._node((lo + hi) // 2, hi)
        return node | {"bits": left["bits"] | right["bits"], "sub": (left, right)}

    def narrowed(self, bits: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of so many words, and how many bits are set in each."""
        bits = folded(bits, words)
        return bits, np.bitwise_count(bits).sum(1).astype(np.int64)


def dual_traversal(x: SignatureTree, y: SignatureTree, threshold: int, settled, visit) -> None:
    """Call ``visit`` with the leaves' pairs of sets that may link.

    A pair of nodes is left out if ``settled``, if their size ranges are too far
    apart, or if no set can share enough: a set's tokens that another also holds
    set bits in both bitmaps, and only as many tokens as it has bits too few can hide.
    """
    words = min(x.bits.shape[1], y.bits.shape[1])
    (xb, xc), (yb, yc) = x.narrowed(x.bits, words), y.narrowed(y.bits, words)
    hidden_x, hidden_y = x.sizes - xc, y.sizes - yc
    stack = [(x.root, y.root)]
    while stack:
        p, q = stack.pop()
        if x is y and q["hi"] <= p["lo"]:
            continue
        if p["most"] * 100 < q["least"] * threshold or q["most"] * 100 < p["least"] * threshold:
            continue
        a, b = slice(p["lo"], p["hi"]), slice(q["lo"], q["hi"])
        if settled(x.at[a], y.at[b]):
            continue
        room = int(np.bitwise_count(folded(p["bits"][None], words) & folded(q["bits"][None], words)).sum()) + min(int(hidden_x[a].max()), int(hidden_y[b].max()))
        if room * (100 + threshold) < threshold * (p["least"] + q["least"]):
            continue
        if p["sub"] or q["sub"]:
            stack += [(s, t) for s in p["sub"] or (p,) for t in q["sub"] or (q,)]
            continue
        common = np.bitwise_count(xb[a][:, None, :] & yb[b][None, :, :]).sum(2).astype(np.int64)
        room = common + np.minimum(hidden_x[a][:, None], hidden_y[b][None, :])
        nx, ny = x.sizes[a][:, None], y.sizes[b][None, :]
        ok = (room * (100 + threshold) >= threshold * (nx + ny)) & similar_sizes(nx, ny, threshold)
        if x is y and p is q:
            ok &= np.tri(*ok.shape, -1, dtype=bool).T
        visit(x.at[a], y.at[b], ok)


class Family:
    """Sets that one task joins: links are kept only where they tie components together."""

    def __init__(self, cls: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, tokens: list[np.ndarray], threshold: int):
        self.cls, self.n, self.side, self.tokens, self.threshold = cls, n, side, tokens, threshold
        _, first, self.comp = np.unique(comp, return_index=True, return_inverse=True)
        self.parent = list(range(len(first)))
        self.found: list[tuple[int, int]] = []

    def _root(self, c: int) -> int:
        while self.parent[c] != c:
            self.parent[c] = self.parent[self.parent[c]]
            c = self.parent[c]
        return c

    def tie(self, pairs) -> None:
        before = len(self.found)
        for i, j in pairs:
            a, b = self._root(int(self.comp[i])), self._root(int(self.comp[j]))
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.found.append((int(self.cls[i]), int(self.cls[j])))
        if len(self.found) > before:
            self.comp = np.array([self._root(c) for c in range(len(self.parent))])[self.comp]

    def star(self, hub: int) -> None:
        """Compare every set with one of them."""
        others = np.flatnonzero((self.comp != self.comp[hub]) & similar_sizes(self.n, self.n[hub], self.threshold))
        if len(others):
            common = overlaps([self.tokens[hub]], [self.tokens[i] for i in others])[0]
            self.tie((hub, i) for i in others[100 * common >= self.threshold * (self.n[hub] + self.n[others] - common)])

    def _settled(self, a: np.ndarray, b: np.ndarray) -> bool:
        c = self.comp[a[0]]
        return bool((self.comp[a] == c).all() and (self.comp[b] == c).all())

    def _visit(self, a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> None:
        ok &= self.comp[a][:, None] != self.comp[b][None, :]
        rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
        if len(rows):
            common = overlaps([self.tokens[i] for i in a[rows]], [self.tokens[j] for j in b[cols]])
            linked = ok[np.ix_(rows, cols)] & (100 * common >= self.threshold * (self.n[a[rows]][:, None] + self.n[b[cols]][None, :] - common))
            self.tie((a[rows[i]], b[cols[j]]) for i, j in zip(*np.nonzero(linked), strict=True))

    def trees(self) -> None:
        """Dual traversals between the trees of like sizes; between both sides where there are two."""
        scale = np.floor(np.log(self.n) / np.log(100 / self.threshold) + 1e-9).astype(np.int64)
        trees = {(s, k): SignatureTree(np.flatnonzero((self.side == s) & (scale == k)), self.n, self.tokens) for s, k in set(zip(self.side.tolist(), scale.tolist(), strict=True))}
        two = len(set(self.side.tolist())) == 2
        keys = sorted(trees)
        for i, (s, k) in enumerate(keys):
            for s2, k2 in keys[i:]:
                # A step aside for sizes at the very edge of a scale.
                if abs(k - k2) <= 2 and (s != s2 if two else True):
                    dual_traversal(trees[s, k], trees[s2, k2], self.threshold, self._settled, self._visit)


def _join_tasks(threshold: int, rows: int = 20_000, width: int = 64 << 20):
    """Over rows sorted by task: links between the sets of each task that tie components together."""

    def links_of(table: pa.Table) -> list[tuple[int, int]]:
        task, cls, n, comp, side, hub = (table.column(c).to_numpy() for c in ("task", "cls", "n", "comp", "side", "hub"))
        tokens = [unpack_tokens(x) for x in table.column("tokens").to_pylist()]
        cuts = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1], [True])))
        starts, sizes = cuts[:-1], np.diff(cuts)
        out: list[tuple[int, int]] = []
        left, right = [], []
        for size in range(2, FEW + 1):
            i, j = np.triu_indices(size, 1)
            at = starts[sizes == size][:, None]
            left.append((at + i).ravel())
            right.append((at + j).ravel())
        left, right = np.concatenate(left), np.concatenate(right)
        ok = (comp[left] != comp[right]) & similar_sizes(n[left], n[right], threshold) & ((side[left] != side[right]) | (side[left] == 0))
        left, right = left[ok], right[ok]
        common = shared_counts(tokens, left, right)
        linked = 100 * common >= threshold * (n[left] + n[right] - common)
        out += zip(cls[left[linked]].tolist(), cls[right[linked]].tolist(), strict=True)
        for at, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            part = slice(at, at + size)
            family = Family(cls[part], n[part], comp[part], side[part], tokens[part], threshold)
            for k in np.flatnonzero(hub[part]):
                family.star(int(k))
            family.trees()
            out += family.found
        return out

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = weight = 0

        def emit(table: pa.Table) -> pa.RecordBatch:
            found = sorted({(min(p), max(p)) for p in links_of(table)})
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for b in part:
            held.append(b)
            count, weight = count + b.num_rows, weight + b.nbytes
            if count >= rows or weight >= width:
                table = pa.Table.from_batches(held)
                task = table.column("task").to_numpy()
                cut = int(np.argmax(task == task[-1]))
                if cut:
                    yield emit(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                count, weight = (0, 0) if cut else (count // 2, weight // 2)
        if held:
            yield emit(pa.Table.from_batches(held))
        held.clear()
        release()

    return work


class JaccardJoin:
    """One join; the steps above as methods, tables in the shared folder between them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 75):
        self.spark, self.threshold = docs.sparkSession, threshold
        shared_dir(self.spark)
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
        self.sets = materialise(rows.mapInArrow(_sets(n), "doc_id long, cls long, proof long, n long, tokens binary"), "sets")
        # Different sets under one 64-bit name get names of their own.
        proofs = self.sets.groupBy("cls").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).filter("lo != hi").select(F.col("cls").alias("clash"))
        clashes = materialise(proofs, "clashes")
        if not clashes.isEmpty():
            renamed = self.sets.join(clashes, F.col("cls") == F.col("clash"), "left")
            self.sets = renamed.withColumn("cls", F.when(F.col("clash").isNull(), F.col("cls")).otherwise(F.xxhash64("cls", "proof"))).drop("clash")
        self.members = self.sets.select("doc_id", "cls", "n")

    def groups(self) -> DataFrame:
        """``gid, cls, n, w, met`` of sets that share leading tokens often enough: w of them in this group, met in all."""
        levels = self.spark.sparkContext.broadcast(_levels(self.sets))
        buckets = shuffle_partitions(self.spark)
        entries = self.sets.filter("tokens is not null").select("cls", "n", "tokens").mapInArrow(_entries(levels, buckets, self.threshold), "bucket int, blob binary")
        found = entries.groupBy("bucket").applyInArrow(_groups(levels, buckets), "gid long, cls long, n long, w long")
        found = materialise(found, "groups")
        alive = found.groupBy("cls").agg(F.sum("w").alias("met"), F.max("n").alias("n")).filter(F.col("met") >= self._needed()).select("cls", "met")
        return materialise(found.groupBy("gid", "cls", "n").agg(F.sum("w").alias("w")).join(alive, "cls"), "groups")

    def _needed(self) -> Column:
        """Leading tokens that a set of n shares with each set that links to it."""
        return F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * self.threshold / 100) * EXTRA)).cast("long")

    def _scale(self) -> Column:
        """Sizes that may link are of the same scale or of one aside."""
        return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / self.threshold)) + 1e-9)

    def families(self) -> DataFrame:
        """``fam, cls, n``: each group's sets under the set of the group that meets most company.

        Many groups of one family of copies have the same head, so a set comes up
        about once for each family, not for each token.  A set leaves the families
        in which it shares least, together under half of what a link needs: two
        sets leave less than a link between them, so one family still holds both.
        It also leaves those that have no other set of a size near its own.
        """
        groups = self.groups()
        heads = groups.groupBy("gid").agg(F.max_by("cls", F.struct("met", "cls")).alias("fam"), F.count("*").alias("size")).filter("size > 1").drop("size")
        found = groups.join(heads, "gid").groupBy("fam", "cls", "n").agg(F.sum("w").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("cls").orderBy("w", "fam"))
        kept = found.withColumn("upto", upto).filter(2 * F.col("upto") > self._needed() - 1).select("fam", "cls", "n", self._scale().alias("scale"))
        kept = materialise(kept, "families")
        near = kept.groupBy("fam", "scale").agg(F.count("*").alias("sets")).select("fam", F.explode(F.expr("array(scale - 1, scale, scale + 1)")).alias("scale"), "sets")
        near = near.groupBy("fam", "scale").agg(F.sum("sets").alias("sets")).filter("sets > 1").select("fam", "scale")
        return materialise(kept.join(near, ["fam", "scale"]).select("fam", "cls", "n"), "families")

    def _bloom(self, ids: DataFrame):
        """A membership filter of bounded size for class names."""
        bits = max(1 << 20, min(BLOOM_BITS, 1 << (16 * ids.count()).bit_length()))
        mask = _U(bits - 1)

        def fill(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in part:
                h = _mix(b.column(0).to_numpy().view(np.uint64))
                at = np.unique(np.concatenate((h & mask, (h >> _U(32)) & mask)))
                yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)), pa.array((_U(1) << (at & _U(63))).view(np.int64))], names=["word", "bits"])

        words = ids.mapInArrow(fill, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        table = np.zeros(bits // 64, np.int64)
        for batch in words.toArrow().to_batches():
            table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        return self.spark.sparkContext.broadcast(table.tobytes()), mask

    def _tokens(self, ids: DataFrame) -> DataFrame:
        """``name, tokens`` of the given classes, each once."""
        bloom, mask = self._bloom(ids)

        def needed(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(bloom.value, np.uint64)
            for b in part:
                h = _mix(b.column(0).to_numpy().view(np.uint64))
                ok = np.ones(len(h), bool)
                for at in (h & mask, (h >> _U(32)) & mask):
                    ok &= (bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)
                yield b.filter(pa.array(ok))

        sets = self.sets.filter("tokens is not null").select(F.col("cls").alias("name"), "tokens").mapInArrow(needed, "name long, tokens binary")
        return sets.groupBy("name").agg(F.first("tokens").alias("tokens"))

    def _joined(self, placed: DataFrame, name: str) -> DataFrame:
        """Links found by the tasks of ``placed(task, cls, n, comp, side, hub)``."""
        full = placed.join(self._tokens(placed.select("cls").distinct()), F.col("cls") == F.col("name"))
        dealt = full.select("task", "cls", "n", "comp", "side", "hub", "tokens").repartition(shuffle_partitions(self.spark), "task").sortWithinPartitions("task")
        return materialise(dealt.mapInArrow(_join_tasks(self.threshold), "a long, b long"), name)

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Verified links that span every component, and ``node, component`` of linked classes.

        Pairs already in one component aren't compared: these are not all links of a class.
        """
        families = self.families()
        weights = families.groupBy("fam").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
        own = F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks"))
        # The head stands in each block of its family.
        at = F.when(F.col("cls") == F.col("fam"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
        placed = families.join(weights, "fam").select("fam", "cls", "n", F.explode(at).alias("block"))
        placed = placed.select(F.xxhash64("fam", "block").alias("task"), "cls", "n", F.col("cls").alias("comp"), F.lit(0).alias("side"), (F.col("cls") == F.col("fam")).alias("hub"))
        links = self._joined(placed, "links")
        comps = materialise(connected_components(links), "components")
        large = weights.filter("blocks > 1").select("fam")
        if large.isEmpty():
            return links, comps
        links = links.unionByName(self._joined(self._across(families.join(large, "fam"), comps), "links"))
        return links, materialise(connected_components(links), "components")

    def _across(self, families: DataFrame, comps: DataFrame) -> DataFrame:
        """Tasks between the blocks of large families.

        The largest component of a family is done with itself: its blocks meet only
        those of the sets outside it, and these each other, where sizes are near enough.
        """
        named = families.join(comps, F.col("cls") == F.col("node"), "left").select("fam", "cls", "n", F.coalesce("component", "cls").alias("comp"))
        shares = named.groupBy("fam", "comp").agg(F.sum("n").alias("share"))
        main = shares.groupBy("fam").agg(F.max_by("comp", F.struct("share", "comp")).alias("main"), F.count("*").alias("several")).filter("several > 1").drop("several")
        named = materialise(named.join(main, "fam").select("fam", "cls", "n", "comp", self._scale().alias("scale"), (F.col("comp") == F.col("main")).alias("inside")), "unjoined")
        cells = named.groupBy("fam", "scale", "inside").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
        named = named.join(cells, ["fam", "scale", "inside"]).withColumn("block", F.pmod(F.xxhash64("cls", F.lit("across")), F.col("blocks")))
        units = cells.select("fam", "scale", "inside", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        unit = F.struct("scale", "inside", "block")
        x, y = units.select("fam", unit.alias("x")), units.select("fam", unit.alias("y"))
        near = (F.abs(F.col("x.scale") - F.col("y.scale")) <= 2) & ~(F.col("x.inside") & F.col("y.inside")) & (F.col("x") <= F.col("y"))
        tasks = x.join(y, "fam").filter(near).select("fam", "x", "y", F.xxhash64("fam", "x", "y").alias("task"))
        sides = tasks.select("fam", F.col("x").alias("unit"), "task", F.lit(0).alias("side")).unionByName(tasks.filter("x != y").select("fam", F.col("y").alias("unit"), "task", F.lit(1).alias("side")))
        return named.withColumn("unit", unit).join(sides, ["fam", "unit"]).select("task", "cls", "n", "comp", "side", F.lit(False).alias("hub"))

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id."""
        _, comps = self.links()
        heads = self.members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("head"))
        named = heads.join(comps, F.col("cls") == F.col("node"), "left").select("cls", "head", F.coalesce("component", "cls").alias("comp"))
        best = named.groupBy("comp").agg(F.min("head").alias("component_id"))
        label = named.join(best, "comp").select(F.col("cls").alias("label_cls"), "component_id")
        return self.members.join(label, (F.col("cls") == F.col("label_cls")) & (F.col("n") > 0), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 75) -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` (smallest id reachable by links) of every row.

    Null and blank texts have an empty set and link with nothing.  Rows with a
    null id keep it and belong to their component without naming it.  Rows that
    repeat an id or a text are one class; ties of size or company go by name.
    An empty table gives no rows; other columns aren't read, whatever their
    names.  Whole texts are used; n-gram hashes have 64 bits (48 in the
    comparison of two sets).
    """
    out = JaccardJoin(docs, id_col, text_col, n, threshold).components()
    return out.withColumnRenamed("doc_id", id_col)
