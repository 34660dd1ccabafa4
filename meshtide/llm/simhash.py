"""SimHash near-dedup: signatures from word shingles, linked by a binary trie self-join.

A signature holds one or more fingerprints ("tables"). For each table the
distinct fingerprints form a binary trie; the self-join walks pairs of trie
nodes together from the root, adds up the bits in which they differ and drops a
pair as soon as the sum exceeds the Hamming budget.

The bits of a key are a ring of budget + 1 parts. Of two keys within the budget one
part is equal, and from one of the parts on, the first l parts differ in less than l
bits together. So each table has a trie for each part, over keys turned until they
begin with it, and a walk drops a pair that differs in more than that: few pairs of
nodes are left at any depth, and together the tries find every pair.

On Spark rows are cut into blocks, and each pair of blocks is a group that walks the
tries of all tables. Where that would copy a row more often than there are tries, the
top levels of each trie are dealt out instead (equal tops meet, so a row has one copy
for each trie), and only a top that is still large is cut into blocks. A task returns
a spanning forest of the links it found, not the links.

Defined results: null text counts as empty; empty texts have signature zero and
are linked like any other; repeated rows keep their own row in the result; null
ids take part, but never become a component's id unless all are null; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.operators.graph import connected_components
from meshtide.session import checkpointed, release, settled, written

SEED = 42
#: Rows of a block, blocks at least, and rows that need only one; rows that a dealt-out top of a trie holds on average, and its levels at most.
BLOCK_ROWS, BLOCKS, FEW_ROWS, SHARD_ROWS, MOST_TOP_BITS = 1 << 18, 8, 1 << 13, 1 << 14, 16
#: Pairs of nodes that are walked at once; pairs of rows that are compared at once.
NODE_PAIRS, PAIRS = 1 << 18, 1 << 17


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the rows of an (n, words) uint64 array have each bit set; bit 0 of word 0 first."""
    planes = [(1, h)]
    n = len(h) // 3
    if n >= 16:  # full adders first: a third of the rows as sums, a third as carries
        a, b, c = h[:n], h[n : 2 * n], h[2 * n : 3 * n]
        x = a ^ b
        planes = [(1, np.concatenate([x ^ c, h[3 * n :]])), (2, (a & b) | (x & c))]
    total = np.zeros(h.shape[1] * 64, np.int64)
    for weight, p in planes:
        bits = np.unpackbits(np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1), axis=1, bitorder="little")
        total += weight * bits.sum(axis=0, dtype=np.int32)
    return total


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each ``size``-word shingle (repeats included) of the lower-cased text; shorter texts are one shingle."""
    words = text.lower().split()  # bytes: A-Z only, and white space is [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        shingles: Iterator = iter([words])
    else:
        shingles = zip(*(words[i:] for i in range(size)), strict=False)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64)


def widen(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) uint64: the hash itself, then further mixed words of it."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        x = h + np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def signature(text: bytes, size: int, words: int) -> bytes:
    """Little-endian uint64 words; a bit is 1 if set in over half of the shingle hashes."""
    h = shingle_hashes(text, size)
    if not len(h):
        return bytes(8 * words)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += bit_sums(widen(h[at : at + (1 << 15)], words))
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, words: int = 1) -> DataFrame:
    """``id, sig, fp`` for every row; ``fp`` is the signature's first word as a signed long."""

    def run(batches):
        for b in batches:
            text = b.column(1).cast(pa.binary())
            sig = [signature(t.as_py(), size, words) for t in text]
            fp = [int.from_bytes(s[:8], "little", signed=True) for s in sig]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.binary()), pa.array(fp, pa.int64())], ["id", "sig", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, sig binary, fp long")


def ring(bits: int, budget: int) -> list[tuple[int, list[int]]]:
    """For each of budget + 1 parts of a key: its first bit (0: the highest), and how many bits may differ down to each level of the trie that begins with it."""
    starts = [bits * r // (budget + 1) for r in range(budget + 2)]
    width = [b - a for a, b in zip(starts, starts[1:], strict=False)]
    return [(starts[r], [n for n in range(budget + 1) for _ in range(width[(r + n) % (budget + 1)])]) for r in range(budget + 1)]


def turned(keys: np.ndarray, bits: int, start: int) -> np.ndarray:
    """``bits``-wide keys, turned left by ``start`` bits."""
    if not start:
        return keys
    return ((keys << np.uint64(start)) | (keys >> np.uint64(bits - start))) & np.uint64((1 << bits) - 1)


def trie_levels(keys: np.ndarray, bits: int):
    """For each level of the trie over sorted distinct keys: the child of each node by 0 and by 1, or -1."""
    node = np.zeros(len(keys), np.int32)  # of each key
    for level in range(1, bits + 1):
        prefix = keys >> np.uint64(bits - level)
        first = np.ones(len(keys), bool)
        np.not_equal(prefix[1:], prefix[:-1], out=first[1:])
        child = np.full((2, node[-1] + 1 if len(node) else 1), -1, np.int32)
        at = np.flatnonzero(first)
        child[(prefix[at] & np.uint64(1)).astype(np.intp), node[at]] = np.arange(len(at), dtype=np.int32)
        yield child
        node = np.cumsum(first, dtype=np.int32) - 1


def near_leaves(a: list[np.ndarray], b: list[np.ndarray], allowed: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves of two tries, given by their levels, that differ down to each level in at most the ``allowed`` bits, some at once."""
    todo = [(0, np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int8))]
    while todo:
        level, i, j, d = todo.pop()
        if level == len(allowed):
            yield i, j
            continue
        if len(i) > NODE_PAIRS:
            todo += [(level, i[at], j[at], d[at]) for at in (slice(len(i) // 2, None), slice(len(i) // 2))]
            continue
        left, right = (a[level][0][i], a[level][1][i]), (b[level][0][j], b[level][1][j])
        there, near = [(x >= 0, y >= 0) for x, y in zip(left, right, strict=True)], d < allowed[level]  # near: may differ once more
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                ok = there[x][0] & there[y][1]
                ok = np.flatnonzero(ok if x == y else ok & near)
                parts.append((left[x][ok], right[y][ok], d[ok] + np.int8(x != y)))
        i, j, d = (np.concatenate(p) for p in zip(*parts, strict=True))
        if len(i):
            todo.append((level + 1, i, j, d))


def depth(keys: np.ndarray, bits: int) -> int:
    """Levels of the trie over sorted keys below which a subtree has about one key."""
    keys = np.unique(keys)
    for level in range(min(bits, max(len(keys).bit_length() - 1, 1)), bits):
        prefix = keys >> np.uint64(bits - level)
        count = np.diff(np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1], [True]])))
        if (count**2).sum() <= 1.25 * len(keys):
            return level
    return bits


def trie_pairs(a: np.ndarray, b: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sorted distinct key arrays that differ in at most ``budget`` bits."""
    found = list(near_leaves(list(trie_levels(a, bits)), list(trie_levels(b, bits)), [budget] * bits))
    return tuple(np.concatenate([np.zeros(0, np.int32), *(f[k] for f in found)]) for k in (0, 1))


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node reachable by the links u-v."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        while (root[root] != root).any():
            root = root[root]
        keep = root[u] != root[v]
        u, v = u[keep], v[keep]
    return root


def leaf_rows(first: np.ndarray, size: np.ndarray, begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For pairs of runs (``size`` rows from ``first``, ``count`` from ``begin``): every row of one with every row of the other, some at once."""
    met = size * count
    one = met == 1
    yield first[one], begin[one]
    first, begin, count, met = (v[~one] for v in (first, begin, count, met))
    ends = np.cumsum(met)
    for cut in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        stop = min(cut + PAIRS, int(ends[-1]))
        at = slice(np.searchsorted(ends, cut, "right"), np.searchsorted(ends, stop) + 1)
        pick = np.repeat(np.arange(at.start, at.stop), np.minimum(ends[at], stop) - np.maximum(ends[at] - met[at], cut))
        off = np.arange(cut, stop) - (ends[pick] - met[pick])
        yield first[pick] + off // count[pick], begin[pick] + off % count[pick]


def close_rows(rows: dict, home: np.ndarray, near: np.ndarray, table: int, start: int, allowed: list[int], far: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows (one of ``home``, one of ``near``) of different nodes that a walk of one trie finds, and their differing bits, at most PAIRS at once.

    ``rows``: arrays with the ``node`` and signature words (``sig``) of each;
    ``table`` and ``start``: which trie; ``far``: differing bits allowed in whole
    signatures.
    """
    bits = len(allowed)
    key = np.zeros((len(rows["node"]), 8), np.uint8)
    key[:, : bits // 8] = rows["sig"].view(np.uint8)[:, table * bits // 8 : (table + 1) * bits // 8]
    key = turned(key.view("<u8").ravel(), bits, start)
    sides = [side[np.argsort(key[side])] for side in ((home,) if home is near else (home, near))]
    levels = max(depth(key[side], bits) for side in sides)  # rows that meet there are compared themselves
    tries = []
    for side in sides:
        own, first = np.unique(key[side] >> np.uint64(bits - levels), return_index=True)
        tries.append((side, first, np.diff(np.append(first, len(side))), list(trie_levels(own, levels))))
    (home, first, size, a), (near, begin, count, b) = tries[0], tries[-1]
    node, sig, home_key, near_key = rows["node"], rows["sig"], key[home], key[near]
    for i, j in near_leaves(a, b, allowed[:levels]):
        for x, y in leaf_rows(first[i], size[i], begin[j], count[j]):
            ok = np.flatnonzero(np.bitwise_count(home_key[x] ^ near_key[y]) <= allowed[-1])
            x, y = home[x[ok]], near[y[ok]]
            d = np.bitwise_count(sig[x] ^ sig[y]).sum(axis=1)
            ok = (node[x] != node[y]) & (d <= far)
            yield x[ok], y[ok], d[ok]


def walk(rows: dict, home: np.ndarray, near: np.ndarray, tries: list[tuple], far: int) -> np.ndarray:
    """Spanning-forest links (node, node) between the rows of two blocks, or of one; ``tries``: table, start and allowed bits of each."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for trie in tries:
        for x, y, _ in close_rows(rows, home, near, *trie, far):
            if len(x):  # keep a forest only
                u, v = np.concatenate([u, rows["node"][x]]), np.concatenate([v, rows["node"][y]])
                names, ids = np.unique(np.concatenate([u, v]), return_inverse=True)
                root = forest(len(names), ids[: len(u)], ids[len(u) :])
                own = np.flatnonzero(root != np.arange(len(names)))
                u, v = names[own], names[root[own]]
    return np.stack([u, v])


#: Which candidate pairs come back: two for each row (its nearest and its smallest partner), one for each row (the nearest in another component), or all between components.
FEW, ONE, ALL = range(3)


def least(group: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """Index of the least row of each group, by the first of ``by``, then the next."""
    order = np.lexsort((*by[::-1], group))
    return order[np.append(True, group[order][1:] != group[order][:-1])] if len(order) else order


def best(found: np.ndarray, which: int) -> np.ndarray:
    """Of rows (node, other node, differing bits) each once, and for FEW and ONE those alone that :func:`chosen` may pick of a node."""
    if which == ALL or not found.shape[1]:
        return np.unique(found, axis=1) if found.shape[1] else found
    keep = []
    for order in (np.lexsort((found[1], found[2], found[0])), np.lexsort((found[1], found[0])))[: 2 if which == FEW else 1]:
        node = found[0][order]
        keep.append(order[np.append(True, node[1:] != node[:-1])])
    return found[:, np.unique(np.concatenate(keep))]


def candidates(rows: dict, home: np.ndarray, near: np.ndarray, tries: list[tuple], budget: int, far: int, similarity: float, which: int) -> np.ndarray:
    """Rows (node, other node, differing bits) for pairs of :func:`close_rows` whose sets' sizes (``n``) allow the ``similarity`` and whose components (``comp``) differ.

    Of ALL pairs, one that an earlier table finds as well is left to that table.
    """
    node, n, comp, sig = (rows[c] for c in ("node", "n", "comp", "sig"))
    out = [np.zeros((3, 0), np.int64)]
    for table, start, allowed in tries:
        for x, y, d in close_rows(rows, home, near, table, start, allowed, far):
            ok = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9
            if home is near:
                ok &= node[x] < node[y]
            if which != FEW:
                ok &= comp[x] != comp[y]
            if which == ALL:
                differ = (sig[x] ^ sig[y]).view(f"<u{len(allowed) // 8}")[:, :table]
                ok &= ~(np.bitwise_count(differ) <= budget).any(axis=1)
            u, v, d = node[x[ok]], node[y[ok]], d[ok].astype(np.int64)
            if which == ALL:
                out.append(np.stack([u, v, d]))
            else:
                for own, other in ((u, v), (v, u)):
                    keep = np.concatenate([least(own, d, other), least(own, other)]) if which == FEW else least(own, d, other)
                    out.append(np.stack([own[keep], other[keep], d[keep]]))
            if len(out) > 64:
                out = [best(np.concatenate(out, axis=1), which)]
    return best(np.concatenate(out, axis=1), which)


def dealt(nodes: DataFrame, tables: int, bits: int, budget: int) -> tuple[DataFrame, int | None]:
    """``nodes`` with ``cell, low, high, block``: a copy for each group (cell, low, high) that the row's block meets, and the levels of the tops, if tops are dealt out.

    Without tops there is one cell, whose groups walk all tries; else a cell's number
    is that of its trie (table, then part), followed by the bits of the top.
    """
    rows, parts = nodes.count(), ring(bits, budget)
    blocks = 1 if rows <= FEW_ROWS else max(BLOCKS, math.ceil(rows / BLOCK_ROWS))
    if blocks <= tables * len(parts):
        levels, cut = None, nodes.select("*", F.lit(0).alias("cell"), F.lit(blocks).alias("blocks"))
    else:
        width, levels = bits // 8, min(MOST_TOP_BITS, bits // len(parts), max(1, math.ceil(math.log2(rows / SHARD_ROWS))))
        keys = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.concat(*[F.substring("sig", t * width + k, F.lit(1)) for k in range(width, 0, -1)]))
        tops = nodes.select("*", F.posexplode(keys).alias("table", "key")).withColumn("key", F.conv(F.hex("key"), 16, -10).cast("long"))
        tops = tops.withColumn("top", F.array(*[F.shiftrightunsigned("key", bits - start - levels).bitwiseAND((1 << levels) - 1) for start, _ in parts]))
        tops = tops.select(*nodes.columns, "table", F.posexplode("top").alias("part", "top")).withColumn("cell", ((F.col("table") * len(parts) + F.col("part")) * (1 << levels) + F.col("top")).cast("int"))
        sizes = settled(tops.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")))  # at most 2 ** MOST_TOP_BITS rows a trie
        cut = tops.select(*nodes.columns, "cell").join(F.broadcast(sizes), "cell")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *nodes.columns), levels


def links(nodes: DataFrame, tables: int, bits: int, budget: int, far: int, similarity: float | None = None, which: int = ALL) -> DataFrame:
    """Links ``src, dst`` (a spanning forest for each task) between the rows of ``nodes(node long, sig binary)``.

    Table t's key is the t-th ``bits``-wide little-endian slice of the signature.
    With a ``similarity`` the nodes also have ``n``, the size of their shingle
    sets, and ``comp``, their component so far, and pairs come back that may be so
    similar, with the bits ``d`` in which they differ.
    """
    extra = [] if similarity is None else ["n", "comp"]
    rows, levels = dealt(nodes.select("node", "sig", *extra), tables, bits, budget)
    every = [(t, *part) for t in range(tables) for part in ring(bits, budget)]

    def run(key, group):
        cell, low, high = (k.as_py() for k in key)
        cols = group.select(["block", "node", *extra]).combine_chunks()
        at = {c: cols[c].to_numpy() for c in ("node", *extra)}
        at["sig"] = np.frombuffer(b"".join(group["sig"].to_pylist()), "<u8").reshape(group.num_rows, -1)
        block = cols["block"].to_numpy()
        home = np.flatnonzero(block == low)
        near = home if low == high else np.flatnonzero(block == high)
        tries = every if levels is None else every[cell >> levels :][:1]
        if similarity is None:
            found = walk(at, home, near, tries, far)
            found = np.concatenate([found, np.zeros_like(found[:1])])
        else:
            found = candidates(at, home, near, tries, budget, far, similarity, which)
        return pa.table({"src": found[0], "dst": found[1], "d": found[2]})

    return rows.groupBy("cell", "low", "high").applyInArrow(run, "src long, dst long, d long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, tables: int = 1, bits: int = 64, budget: int = 3, words: int = 1, far: int | None = None) -> DataFrame:
    """``id, sig, component_id`` for every row: rows in one component are connected by links.

    Two signatures link if a table's fingerprints differ in at most ``budget``
    bits and the whole signatures in at most ``far`` (None: ``budget``).
    ``component_id`` is the smallest id of the component.
    """
    sigs = checkpointed(signatures(docs, id_col, text_col, size, words))
    distinct = sigs.groupBy("sig", "fp").agg(F.min("id").alias("low"))  # rows with equal signatures are one node
    distinct = checkpointed(distinct.withColumn("node", F.col("fp") if words == 1 else F.monotonically_increasing_id()))
    label = connected_components(links(distinct.select("node", "sig"), tables, bits, budget, budget if far is None else far))
    member = distinct.join(label, "node", "left").select("sig", "low", F.coalesce("component", "node").alias("c"))
    smallest = member.groupBy("c").agg(F.min("low").alias("component_id"))
    of = member.join(smallest, "c").select("sig", "component_id")
    return sigs.join(of, "sig").select("id", "sig", "fp", "component_id")


#: What one-of-each-group dedup uses: five-word shingles, 512-bit signatures, eight tries over 32 bits each.
NEAR = {"size": 5, "tables": 8, "bits": 32, "budget": 4, "words": 8}
#: Standard deviations that a candidate's differing bits may lie above the expected ones.
SLACK = 5
#: Signature words and deviations for the rows that have candidates: four times the bits tell a similarity of 0.7 from 0.8.
WIDE, WIDE_SLACK = 32, 3.5
#: Narrow rows (some 40 bytes) that may be broadcast.
BROADCAST_ROWS = 200_000


def allowed_bits(similarity: float, words: int, slack: float = SLACK) -> int:
    """Differing bits that a pair of a shingle-set (Jaccard) similarity stays within, ``slack`` deviations above the expected ones.

    Expected: cosine 2j/(1+j), angle over pi. Sets of a few shingles differ more; the slack covers them.
    """
    cosine = 2 * similarity / (1 + similarity)
    n, p = 64 * words, math.acos(cosine) / math.pi
    return math.floor(n * p + slack * math.sqrt(n * p * (1 - p)))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, size))


def set_name(hashes: np.ndarray) -> bytes:
    """Equal sets have equal names (128 bits)."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def set_signature(h: np.ndarray, words: int) -> bytes:
    """A bit is 1 if set in over half of the set's hashes; the first words are those of a narrower signature."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += bit_sums(widen(h[at : at + (1 << 15)], words))
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes()


#: Sets of so many shingles at most find each other by what is left when shingles are taken out, not by signatures, which say little of them.
SHORT = 14


def longest_partner(similarity: float) -> int:
    """Shingles of the largest set that may be similar to one of SHORT."""
    return math.floor(SHORT / similarity + 1e-9)


def set_signatures(docs: DataFrame, id_col: str, text_col: str, size: int, words: int, keep: int = 0) -> DataFrame:
    """``id, h, same, sig, n, short`` for every row: a hash of the text, the shingle set's name, its signature (each shingle once) and size, and the set itself if it has at most ``keep`` shingles."""

    def run(batches):
        for b in batches:
            same, sig, n, short = [], [], [], []
            for t in b.column(2).cast(pa.binary()):
                h = shingle_set(t.as_py(), size)
                same.append(set_name(h))
                sig.append(set_signature(h, words))
                n.append(len(h))
                short.append(h.tobytes() if len(h) <= keep else None)
            made = [pa.array(same, pa.binary()), pa.array(sig, pa.binary()), pa.array(n, pa.int32()), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["id", "h", "same", "sig", "n", "short"])

    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, h long, same binary, sig binary, n int, short binary")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h, text``: ids may repeat with other texts, so the id and a hash of the text name a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def short_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links ``src, dst`` between the small sets among ``nodes(node, short)``: exact, and each set once for each subset that links it.

    Two sets are similar enough if and only if their intersection, of i shingles,
    lacks at most i/s - i of theirs together. So every set names what is left of it
    when so few shingles are taken out; of those that leave the same subset the one
    that loses least is similar to each that any of them is similar to.
    """
    slack = 1 / similarity - 1

    def run(batches):
        for b in batches:
            node, key, left, lost = [], [], [], []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.frombuffer(raw, np.uint64)
                for e in range(len(h) + 1):
                    if e and e > (len(h) - e) * slack + 1e-9:
                        break
                    out = np.array(list(combinations(range(len(h)), e)), np.intp)
                    sums = (h.sum(dtype=np.uint64) - h[out].sum(axis=1, dtype=np.uint64)).view(np.int64)
                    node.append(np.full(len(sums), name))
                    key.append(sums)
                    left.append(np.full(len(sums), len(h) - e, np.int32))
                    lost.append(np.full(len(sums), e, np.int32))
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (node, key, left, lost)], ["node", "key", "left", "lost"])

    kept = nodes.where("short is not null").select("node", "short").mapInArrow(run, "node long, key long, left int, lost int")
    hubs = kept.groupBy("key", "left").agg(F.min(F.struct("lost", "node")).alias("hub"), F.count(F.lit(1)).alias("times")).where("times > 1")
    hubs = settled(hubs.select("key", "left", F.col("hub.lost").alias("hub_lost"), F.col("hub.node").alias("src")))
    met = kept.join(hubs, ["key", "left"]).where((F.col("node") != F.col("src")) & (F.col("lost") + F.col("hub_lost") <= F.col("left") * slack + 1e-9))
    return met.select("src", F.col("node").alias("dst")).distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``node, shingles`` (sorted uint64 in bytes), ``sig`` (WIDE words) and ``n`` for each of ``wanted(node, low)``; ``low`` names a row with that set."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), size) for t in b.column(1).cast(pa.binary())]
            made = [pa.array([h.tobytes() for h in sets], pa.binary()), pa.array([set_signature(h, WIDE) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["node", "shingles", "sig", "n"])

    few = wanted.count() <= BROADCAST_ROWS
    of = wanted.select("node", F.col("low.id").alias("wanted_id"), F.col("low.h").alias("wanted_h"))
    found = texts(docs, id_col, text_col).join(F.broadcast(of) if few else of, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("h") == F.col("wanted_h"))).select("node", "text")
    return found.mapInArrow(run, "node long, shingles binary, sig binary, n int").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(src, dst)`` whose shingle sets have exactly at least the Jaccard ``similarity``."""

    def run(batches):
        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], ["src", "dst"])

    of = lambda k, name: sets.select(F.col("node").alias(k), F.col("shingles").alias(name))
    return pairs.join(of("src", "x"), "src").join(of("dst", "y"), "dst").select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long")


def chosen(found: DataFrame, which: int) -> DataFrame:
    """The pairs ``src, dst`` to test, each once, from what all tables found."""
    nearest = F.min(F.struct("d", "dst"))["dst"]
    if which == FEW:
        found = found.groupBy("src").agg(F.array(nearest, F.min("dst")).alias("dst")).select("src", F.explode("dst").alias("dst"))
    elif which == ONE:
        found = found.groupBy("src").agg(nearest.alias("dst"))
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of each group of near copies the one with the smallest id.

    Documents link if the Jaccard similarity of their sets of five-word shingles
    (as 64-bit hashes) is at least ``similarity``. Small sets (SHORT) find all their
    partners exactly. For the others candidates come from the tries
    over signatures of the sets; each is confirmed by the sets themselves, so
    that a candidate may be missed, but no link is wrong. A group of g near copies
    is not expanded into its pairs: a first walk over all rows returns two
    candidates for each row, two more, over the rows that have candidates, the
    nearest one in another component, and a last one all that still join two
    components, so that none is left out.

    A row is known by its id and a hash of its text: rows that share an id but not
    their text go or stay each for itself (of near copies with one id the one with
    the smaller hash stays), and repeated rows, equal in both, all stay or all go.
    Rows with a null id stay.
    """
    how = NEAR | options
    size, words = how["size"], how["words"]
    sigs = checkpointed(set_signatures(docs, id_col, text_col, size, words, longest_partner(similarity)))
    name = F.struct(F.col("id").isNull().alias("none"), "id", "h")
    nodes = sigs.groupBy("same").agg(F.min(name).alias("low"), F.max(name).alias("high"), *[F.first(c).alias(c) for c in ("sig", "n", "short")])  # rows with equal sets are one node
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    joined = settled(short_links(nodes, similarity))
    label = settled(connected_components(joined))
    active, sets = nodes.join(label, "node", "left").select("node", "sig", "n", F.coalesce("component", "node").alias("comp")), None
    for which in (FEW, ONE, ONE, ALL):
        far = allowed_bits(similarity, words) if which == FEW else allowed_bits(similarity, WIDE, WIDE_SLACK)
        pairs = settled(chosen(links(active, how["tables"], how["bits"], how["budget"], far, similarity, which), which))
        release(docs.sparkSession)
        if sets is None:
            ends = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
            sets = written(shingle_sets(docs, checkpointed(nodes.join(ends, "node").select("node", "low")), id_col, text_col, size), "sets")
        joined = settled(joined.union(confirmed(pairs, sets, similarity)))
        label = settled(connected_components(joined))
        release(docs.sparkSession)
        active = sets.join(label, "node", "left").select("node", "sig", "n", F.coalesce("component", "node").alias("comp"))
    member = nodes.select("node", "low").join(label, "node")
    smallest = member.groupBy("component").agg(F.min("low").alias("best"))
    better = member.join(smallest, "component").where("low <> best").select("node", F.lit(True).alias("all_go"))  # sets whose rows all go
    of = nodes.join(better, "node", "left").where(F.col("all_go") | (F.col("low") != F.col("high"))).select("same", "low", F.coalesce("all_go", F.lit(False)).alias("all_go"))
    gone = sigs.join(settled(of), "same").where((F.col("all_go") | (name != F.col("low"))) & F.col("id").isNotNull()).select("id", "h").distinct()
    gone = settled(gone.select(F.col("id").alias("_gone_id"), F.col("h").alias("_gone_h")))
    release(docs.sparkSession)
    few = gone.count() <= BROADCAST_ROWS  # else the texts are shuffled once
    return docs.join(F.broadcast(gone) if few else gone, (F.col(id_col) == F.col("_gone_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_gone_h")), "left_anti")
