"""SimHash near-dedup: tiled exact comparison with numpy exclusive-or and bit counts.

Fingerprints are made once per text; equal ones are one node.  Nodes meet in blocks: for a small radius by the pigeonhole
rule (cut into ``radius + 2`` pieces, at least two pieces of two linked fingerprints are equal), so no link can be lost; for
a wide radius, where that rule cannot prune, by the smallest shingle under several permutations.  Inside a block the
nodes are sorted and compared tile by tile, and tile pairs that are too far apart (by bit counts, or by the sizes of their sets)
are skipped.  A block that does not fit a task is cut by further pieces or further anchors; what shares even those is compared
with a task's worth of pivots first.  Comparing all tiles without blocks would grow with the square of the corpus.

Each block reports a spanning forest of its links, never all pairs; components.py joins the forests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import materialise, maybe_among, one_each, salted_left_join, small_batches, without
from edgeloom.llm.components import components

SEED = 42
#: Bytes of text that are cut into words at a time.
SLICE = 4 << 20
#: Rows of a block that one task compares; larger blocks are cut further.
BLOCK_ROWS = 4096
TILE = 512


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of the whole text, slice by slice; a text with fewer words is one shingle."""
    carry: list[bytes] = []
    at, seen, text = 0, 0, text.lower()  # bytes.lower() maps A-Z only
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        part = carry + text[at:end].split()
        at = end
        if len(part) < words:
            carry = part
            continue
        yield _hash_runs(part, words)
        seen += 1
        carry = part[len(part) - words + 1 :] if words > 1 else []
    if not seen and carry:
        yield _hash_runs(carry, len(carry))


def _hash_runs(part: list[bytes], words: int) -> np.ndarray:
    lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
    ends = np.cumsum(lengths + 1)
    joined, digest = b" ".join(part), xxhash.xxh64_intdigest
    n = len(part) - words + 1
    first, last = (ends - lengths - 1)[:n].tolist(), (ends - 1)[words - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), dtype=np.uint64, count=n)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of a hash (the finaliser of splitmix64)."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes, words: int = 3, bits: int = 64, anchors: int = 0) -> tuple[bytes, list[int]]:
    """Big-endian fingerprint and the least shingle hash under each of ``anchors`` permutations; repeats count."""
    return fingerprint_of(shingle_hashes(text, words), bits, anchors)


def fingerprint_of(parts: Iterable[np.ndarray], bits: int = 64, anchors: int = 0) -> tuple[bytes, list[int]]:
    """The same of shingle hashes that come in parts."""
    width = bits // 64
    counts, total = np.zeros(bits, dtype=np.int64), 0
    least = np.full(anchors, np.iinfo(np.int64).max, dtype=np.int64)
    for hashes in parts:
        total += len(hashes)
        for at in range(0, len(hashes), 255 * 16):
            h = hashes[at : at + 255 * 16]
            wide = np.empty((len(h), width), dtype=">u8")
            wide[:, 0] = h
            for k in range(1, width):
                wide[:, k] = _mixed(h, k)
            flags = np.unpackbits(wide.view(np.uint8), axis=1)
            for row in range(0, len(h), 255):  # 255 flags fit a byte
                counts += np.add.reduce(flags[row : row + 255], axis=0, dtype=np.uint8)
            for k in range(anchors):
                least[k] = min(least[k], (_mixed(h, 1000 + k) >> np.uint64(1)).min())
    return np.packbits(2 * counts > total).tobytes(), least.tolist() if total else []


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64) -> DataFrame:
    """``doc_id, fp`` (bits / 8 bytes) and ``ones``.  Null and empty texts, and texts of white space, get zero."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = [fingerprint(t.as_py() or b"", words, bits)[0] for t in batch.column(1)]
            ones = [int.from_bytes(f, "big").bit_count() for f in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(ones, pa.int32())], names=["doc_id", "fp", "ones"])

    return small_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(run, f"doc_id {kind}, fp binary, ones int")


def tile_links(fp: np.ndarray, ones: np.ndarray, radius: int, tile: int = TILE) -> list[tuple[int, int]]:
    """Links (a spanning forest of them) between rows of ``fp`` (n, words of 64 bits) that differ in at most ``radius`` bits."""
    order = np.argsort(ones, kind="stable")
    fp, ones, n = fp[order], ones[order], len(order)
    parent, links = np.arange(n), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def roots(part: slice) -> np.ndarray:
        r = parent[part]
        while (r != parent[r]).any():
            r = parent[r]
        return r

    for a in range(0, n, tile):
        left = slice(a, min(n, a + tile))
        for b in range(a, n, tile):
            right = slice(b, min(n, b + tile))
            if ones[b] - ones[left.stop - 1] > radius:
                break  # sorted: no later tile can be near enough either
            distance = np.zeros((left.stop - a, right.stop - b), dtype=np.uint16)
            for w in range(fp.shape[1]):
                distance += np.bitwise_count(fp[left, None, w] ^ fp[None, right, w])
            near = distance <= radius
            if a == b:
                near = np.triu(near, 1)
            while near.any():
                near &= roots(left)[:, None] != roots(right)[None, :]
                rows = np.flatnonzero(near.any(axis=1))
                for i, j in zip(rows.tolist(), near[rows].argmax(axis=1).tolist()):
                    x, y = find(a + i), find(b + j)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        links.append((int(order[a + i]), int(order[b + j])))
    return links


def _cut(rows: DataFrame, pieces: int) -> DataFrame:
    """``fp, ones, key, rest``: ``rest`` (hexadecimal digits) is cut into ``pieces``, and a row goes to a block for each pair of
    them.  ``key`` names the digits that a block has in common; the other pieces are the new ``rest``."""
    at = lambda i: F.round(F.length("rest") * i / pieces).cast("int")
    part = [F.col("rest").substr(at(i) + 1, at(i + 1) - at(i)) for i in range(pieces)]
    blocks = []
    for i, j in combinations(range(pieces), 2):
        others = F.concat(*[part[k] for k in range(pieces) if k not in (i, j)])
        blocks.append(F.struct(F.xxhash64("key", F.lit(i * pieces + j), part[i], part[j]).alias("key"), others.alias("rest")))
    return rows.select("fp", "ones", F.explode(F.array(*blocks)).alias("b")).select("fp", "ones", "b.key", "b.rest")


def links(prints: DataFrame, bits: int, radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between different fingerprints of ``prints`` within ``radius``: forests whose union has every component.

    A block of more than ``block_rows`` is cut again by the same rule, in the digits that its rows do not share; 64 bits and a
    radius of 2 leave at most 65,536 different rows after the second cut and 256 after the third."""
    rows = prints.select("fp", "ones").distinct().select("fp", "ones", F.lit(0).cast("bigint").alias("key"), F.hex("fp").alias("rest"))
    ready, left, pieces = [], bits // 4, radius + 2
    while True:
        rows, left = _cut(rows, pieces), left - 2 * (left // pieces)
        sizes = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        heavy = sizes.filter(F.col("n") > block_rows)
        last = left < pieces or heavy.isEmpty()
        ready.append(rows.join(sizes if last else sizes.filter(F.col("n") <= block_rows), "key").select("key", "fp", "ones"))
        if last:
            break
        rows = materialise(rows.join(heavy, "key").drop("n"))
    dealt = reduce(DataFrame.unionByName, ready).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compare(radius), "a binary, b binary").distinct()


def _compare(radius: int):
    def run(batches):
        held, name = [], None
        for batch in batches:
            key = batch.column(0).to_numpy()
            fp, ones = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            a, b = [], []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if key[lo] != name:
                    _within(held, radius, a, b)
                    held, name = [], key[lo]
                held += zip(fp[lo:hi], ones[lo:hi].tolist())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        a, b = [], []
        _within(held, radius, a, b)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def _within(held: list[tuple[bytes, int]], radius: int, a: list, b: list) -> None:
    if len(held) < 2:
        return
    if len(held) == 2:
        (x, p), (y, q) = held
        found = [(0, 1)] if abs(p - q) <= radius and (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count() <= radius else []
    else:
        wide = np.frombuffer(b"".join(f for f, _ in held), dtype=">u8").reshape(len(held), -1).astype(np.uint64)
        found = tile_links(wide, np.array([p for _, p in held]), radius)
    for i, j in found:
        a.append(held[i][0])
        b.append(held[j][0])


def near_groups(docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (hex) and ``component_id``, the smallest ``doc_id`` reachable.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; repeats count; fewer than ``words`` words are one
    shingle.  Null, empty and blank texts have fingerprint zero and link like any other.  Repeated rows give repeated rows.
    A row without ``doc_id`` gets the component of its fingerprint, which is null only if no linked document has an id.
    An empty table gives an empty result; other columns are not read.
    """
    prints = materialise(fingerprints(docs, words, bits))
    tree = materialise(components(links(prints, bits, radius, block_rows)))
    joined = with_components(prints.select("doc_id", "fp"), tree, "fp")
    return joined.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def with_components(prints: DataFrame, tree: DataFrame, key: str) -> DataFrame:
    """``prints`` with ``component_id``: the smallest ``doc_id`` of the rows whose ``key`` has the same root in ``tree`` (node, root)."""
    nodes = prints.groupBy(key).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    root = F.coalesce("root", key)
    nodes = nodes.join(tree.withColumnRenamed("node", key), key, "left").withColumn("root", root)
    several = materialise(nodes.filter((F.col("n") > 1) | (F.col("root") != F.col(key))).select(key, "root", "least"))
    # singles that are the root of others appear here only through their members
    tops = several.select("root").distinct().join(nodes.select(F.col(key).alias("root"), F.col("least").alias("own")), "root")
    ids = several.groupBy("root").agg(F.min("least").alias("of_members")).join(tops, "root")
    ids = ids.select("root", F.least("of_members", "own").alias("component_id"))
    named = several.select(key, "root").unionByName(tops.select(F.col("root").alias(key), "root")).distinct()
    named = named.join(ids, "root").select(key, "component_id")
    joined = salted_left_join(prints, named, key, F.col("doc_id"))
    return joined.withColumn("component_id", F.coalesce("component_id", "doc_id"))


#: The near-dedup setting for a similarity of shingle sets: blocks by 8 anchors, 512 bits to thin out a block's pairs.
WIDE = {"words": 5, "bits": 512, "anchors": 8}
#: Shingles of one block whose sets a task holds (16 MB).
BLOCK_SHINGLES = 1 << 21
#: Sets of at most so many shingles are compared whatever their fingerprints: ties and few votes make those unsure.
SHORT = 64


def radius_for(similarity: float, bits: int, deviations: float = 5) -> int:
    """Bits by which two sets of this Jaccard similarity differ, plus standard deviations so that hardly any pair is missed."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *shingle_hashes(text, words)]))


#: Bytes of a shingle's hash in the sets that are moved: two shingles of a pair of sets agree by chance in one of a billion pairs.
HASH_BYTES = 6


def packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // HASH_BYTES, 8), dtype=np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(-1, HASH_BYTES)
    return wide.view("<u8")[:, 0]


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def profiles(docs: DataFrame, words: int, bits: int, anchors: int) -> DataFrame:
    """``doc_id, text_key, node`` (a digest of the shingle set), ``fp, size`` and ``anchors`` of that set (no anchors if it is empty)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made, sets = [], []
            for t in batch.column(2):
                own = shingle_set(t.as_py() or b"", words)
                made.append(fingerprint_of([own], bits, anchors))
                sets.append((hashlib.md5(own.tobytes()).digest(), len(own)))
            body = [pa.array([d for d, _ in sets], pa.binary()), pa.array([f for f, _ in made], pa.binary()), pa.array([n for _, n in sets], pa.int32()), pa.array([a for _, a in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *body], names=["doc_id", "text_key", "node", "fp", "size", "anchors"])

    rows = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    return small_batches(rows).mapInArrow(run, f"doc_id {kind}, text_key binary, node binary, fp binary, size int, anchors array<bigint>")


CELL = ["tbl", "key", "cell"]


def _sizes(rows: DataFrame, block_rows: int) -> DataFrame:
    """``tbl, key, parts`` of the blocks with more than one row; a block of one part fits a task."""
    sizes = rows.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("held")).filter("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / block_rows, F.col("held") / BLOCK_SHINGLES)).cast("int")
    return materialise(sizes.select("tbl", "key", parts.alias("parts")))


def _blocks(nodes: DataFrame, anchors: int, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Cells (``tbl, key, cell, node, ask``) of blocks that fit a task, and rows (with ``parts``) of those that do not, if any.

    Two nodes meet under the first anchor that they share or, where its block does not fit a task, under the first two."""
    one = lambda rows, sizes: rows.join(sizes.filter("parts = 1"), ["tbl", "key"]).select("tbl", "key", F.lit(0).cast("bigint").alias("cell"), "node", F.lit(True).alias("ask"))
    rows = nodes.select("node", "size", F.posexplode("anchors").alias("tbl", "key"))
    sizes = _sizes(rows, block_rows)
    cells, heavy = one(rows, sizes), sizes.filter("parts > 1")
    if heavy.isEmpty():
        return cells, None
    deep = rows.join(heavy.drop("parts"), ["tbl", "key"]).join(nodes.select("node", "anchors"), "node")
    deep = deep.select("node", "size", "tbl", "key", F.posexplode("anchors").alias("second", "other")).filter("second > tbl")
    deep = materialise(deep.select("node", "size", (anchors * (F.col("tbl") + 1) + F.col("second")).cast("int").alias("tbl"), F.xxhash64("key", "other").alias("key")))
    sizes = _sizes(deep, block_rows)
    cells, heavy = cells.unionByName(one(deep, sizes)), sizes.filter("parts > 1")
    return cells, None if heavy.isEmpty() else materialise(deep.join(heavy, ["tbl", "key"]).select("tbl", "key", "node", "parts"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Cells in which every asking row of a block meets every row of it.

    ``rows``: tbl, key, node, parts, ask and slots.  A block's rows lie in ``parts`` parts, its asking rows in ``slots``; a cell
    is a part with a slot.  With one slot (at most a task's worth of asking rows) the rows grow in proportion."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("bigint")
    slot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("slots")).cast("bigint")
    held = rows.withColumn("to", F.explode(F.expr("sequence(0L, slots - 1L)"))).select("tbl", "key", (own * F.col("slots") + F.col("to")).alias("cell"), "node", F.lit(False).alias("ask"))
    asked = rows.filter("ask").withColumn("to", F.explode(F.expr("sequence(0L, parts - 1L)"))).select("tbl", "key", (F.col("to") * F.col("slots") + slot).alias("cell"), "node", "ask")
    return held.unionByName(asked)


def _cells(batches, columns: tuple[str, ...]):
    """(tbl, key, cell) and the rows (tuples of ``columns``) of each cell of sorted batches; a repeated first column counts once."""
    held, name = [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        names = zip(*(table[c].to_pylist() for c in CELL))
        for this, row in zip(names, zip(*(table[c].to_pylist() for c in columns))):
            if this != name:
                if len(held) > 1:
                    yield name, held
                held, name = [], this
            if not held or held[-1][0] != row[0]:
                held.append(row)
    if len(held) > 1:
        yield name, held


def _before(tbl: int, anchors: int) -> list[int]:
    """The anchors that two rows must not share if they are to meet in table ``tbl``: those before its own."""
    if tbl < anchors:
        return list(range(tbl))
    return [k for k in range(tbl % anchors) if k != tbl // anchors - 1]


def near_tiles(fp: np.ndarray, size: np.ndarray, anchors: np.ndarray, ask: np.ndarray, tbl: int, similarity: float, radius: int, tile: int = TILE):
    """(left, right, near) for the tiles of rows sorted by size: pairs that may be similar, meet in table ``tbl`` first, and one of
    which asks."""
    n, before = len(size), _before(tbl, anchors.shape[1])
    for a in range(0, n, tile):
        left = slice(a, min(n, a + tile))
        for b in range(a, n, tile):
            right = slice(b, min(n, b + tile))
            if similarity * size[b] > size[left.stop - 1] + 1e-6:
                break  # sorted: the sets of later tiles are larger still
            near = size[left, None] + 1e-6 >= similarity * size[None, right]
            near &= ask[left, None] | ask[None, right]
            if not near.any():
                continue
            distance = np.zeros(near.shape, dtype=np.uint16)
            for w in range(fp.shape[1]):
                distance += np.bitwise_count(fp[left, None, w] ^ fp[None, right, w])
            near &= (distance <= radius) | (size[left, None] <= SHORT)
            if a == b:
                near = np.triu(near, 1)
            for k in before if near.any() else ():
                near &= anchors[left, None, k] != anchors[None, right, k]
            if near.any():
                yield left, right, near


def _sorted_cell(rows: list[tuple]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (node, fp, size, anchors, ask, ...) by size, and their columns as arrays."""
    rows = sorted(rows, key=lambda r: r[2])
    wide = np.frombuffer(b"".join(r[1] for r in rows), dtype=">u8").reshape(len(rows), -1).astype(np.uint64)
    return rows, wide, np.array([r[2] for r in rows], dtype=np.int64), np.array([r[3] for r in rows], dtype=np.int64), np.array([r[4] for r in rows], dtype=bool)


_MARKED = ["tbl int", "key bigint", "cell bigint", "node binary", "ask boolean"]


def _candidates(similarity: float, radius: int):
    """Keeps the rows of a cell that may have a similar one in it."""

    def found(tbl: int, rows: list[tuple]) -> list[tuple]:
        if len(rows) == 2:  # most cells
            (x, p, m, a, s), (y, q, n, b, t) = rows
            near = (s or t) and min(m, n) + 1e-6 >= similarity * max(m, n) and all(a[k] != b[k] for k in _before(tbl, len(a)))
            return [(x, s), (y, t)] if near and (min(m, n) <= SHORT or (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_count() <= radius) else []
        rows, *arrays = _sorted_cell(rows)
        some = np.zeros(len(rows), dtype=bool)
        for left, right, near in near_tiles(*arrays, tbl, similarity, radius):
            some[left] |= near.any(axis=1)
            some[right] |= near.any(axis=0)
        return [(rows[i][0], rows[i][4]) for i in np.flatnonzero(some)]

    def run(batches):
        out = []
        names, types = [c.split()[0] for c in _MARKED], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        for name, rows in _cells(batches, ("node", "fp", "size", "anchors", "ask")):
            out += [(*name, *row) for row in found(name[0], rows)]
            if len(out) > 5000:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)

    return run


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def set_links(rows: list[tuple], tbl: int, similarity: float, radius: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the pairs of a cell (node, fp, size, anchors, ask, set) whose sets have this Jaccard similarity at least."""
    rows, fp, size, anchors, ask = _sorted_cell(rows)
    every, flat = np.unique(unpacked(b"".join(r[5] for r in rows)), return_inverse=True)
    ends = np.cumsum(size)
    own = [flat[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]
    mark, group, links = np.zeros(len(every), dtype=np.int32), np.arange(len(rows)), []
    for left, right, near in near_tiles(fp, size, anchors, ask, tbl, similarity, radius):
        for i in (np.flatnonzero(near.any(axis=1)) + left.start).tolist():
            others = np.flatnonzero(near[i - left.start]) + right.start
            others = others[group[others] != group[i]]
            if not len(others):
                continue
            mark[own[i]] = 1
            starts = np.cumsum(size[others]) - size[others]
            shared = np.add.reduceat(mark[np.concatenate([own[j] for j in others])], starts)
            mark[own[i]] = 0
            union = size[i] + size[others] - shared
            for j in others[shared + 1e-6 >= similarity * union].tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    links.append((rows[i][0], rows[j][0]))
    return links


def _verified(cells: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, radius: int, words: int) -> DataFrame:
    """Links (a, b) of the pairs of ``cells`` whose sets have this Jaccard similarity, counted exactly.

    Nodes meet in cells without their sets; only those that have a candidate in a cell get them, from a scan of the texts that
    a filter of the candidates cuts down before any text is shuffled or hashed."""
    ready = lambda rows: rows.repartition(*CELL).sortWithinPartitions(*CELL, "node", F.col("ask").desc())
    facts = nodes.select("node", "fp", "size", "anchors")
    marked = materialise(ready(cells.join(facts, "node")).mapInArrow(_candidates(similarity, radius), ", ".join(_MARKED)))
    wanted = materialise(marked.select("node").distinct().join(nodes, "node").select("node", "fp", "size", "anchors", F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")))
    texts = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    texts = maybe_among(texts, [F.col("doc_id"), F.col("text_key")], wanted.select("__id", "__key"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches):
        for batch in batches:
            made = [packed(shingle_set(t.as_py() or b"", words)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.binary())], names=["doc_id", "text_key", "members"])

    held = small_batches(texts).mapInArrow(sets, f"doc_id {kind}, text_key binary, members binary")
    held = held.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))).select("node", "fp", "size", "anchors", "members")

    def verified(batches):
        for (tbl, *_), rows in _cells(batches, ("node", "fp", "size", "anchors", "ask", "members")):
            if found := set_links(rows, tbl, similarity, radius):
                yield _batch(found, ["a", "b"], [pa.binary(), pa.binary()])

    return materialise(ready(marked.join(held, "node")).mapInArrow(verified, "a binary, b binary").distinct())


def copy_links(docs: DataFrame, prints: DataFrame, similarity: float, radius: int, words: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) between nodes of ``prints`` (profiles of ``docs``) whose sets have this Jaccard similarity: forests whose union
    has every component of the pairs that share an anchor.

    In a block that does not fit a task, a task's worth of rows, picked by a hash, is compared with all rows; rows that this joins
    need no comparison with each other, so after that only rows outside the block's largest group are compared with all rows."""
    nodes = materialise(prints.dropDuplicates(["node"]))  # whichever of equal sets
    cells, heavy = _blocks(nodes, WIDE["anchors"], block_rows)
    found = _verified(cells, nodes, docs, similarity, radius, words)
    if heavy is None:
        return found
    first = heavy.withColumn("ask", F.pmod(F.xxhash64("node"), F.col("parts")) == 0).withColumn("slots", F.lit(1).cast("bigint"))
    found = materialise(found.unionByName(_verified(_dealt(first), nodes, docs, similarity, radius, words)))
    rooted = heavy.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    largest = rooted.groupBy("tbl", "key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("tbl", "key")
    largest = largest.agg(F.max_by("root", F.struct("n", "root")).alias("top"), (F.sum("n") - F.max("n")).alias("open"))
    slots = F.ceil(F.greatest(F.col("open") / block_rows, F.lit(1))).cast("bigint")
    rest = rooted.join(largest, ["tbl", "key"]).select("tbl", "key", "node", "parts", (F.col("root") != F.col("top")).alias("ask"), slots.alias("slots"))
    return found.unionByName(_verified(_dealt(materialise(rest)), nodes, docs, similarity, radius, words))


def _losers(prints: DataFrame, tree: DataFrame) -> DataFrame:
    """``doc_id, text_key`` of the rows of ``prints`` that do not stay: those of a group other than its least (id, text), null ids last."""
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"))
    nodes = prints.groupBy("node").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("n")).join(tree, "node", "left")
    nodes = materialise(nodes.withColumn("root", F.coalesce("root", "node")))
    best = nodes.groupBy("root").agg(F.min("least").alias("best"), F.sum("n").alias("rows")).filter("rows > 1").drop("rows")
    named = salted_left_join(nodes.select("node", "root"), best, "root", F.col("node")).filter("best IS NOT NULL").select("node", "best")
    rows = salted_left_join(prints.select("doc_id", "text_key", "node"), named, "node", F.col("text_key"))
    return rows.filter(order != F.col("best")).select("doc_id", "text_key").distinct()


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` (all columns, whatever their names) with one document of each group of near copies.

    Two documents are linked if their sets of five-word shingles have this Jaccard similarity, counted exactly; a group is what
    links join.  The smallest ``doc_id`` stays (null last), of an id with several such texts the one with the least MD5 digest; a
    row is known by its id and text, so rows of one id but different groups are judged apart, and rows that repeat both collapse
    to one.  Null, empty and blank texts have the same empty set: one of them stays.  Fewer than five words are one shingle; texts
    of any length are read whole.  An empty table gives an empty result.
    """
    prints = materialise(profiles(docs, **WIDE))
    tree = materialise(components(copy_links(docs, prints, similarity, radius_for(similarity, WIDE["bits"]), WIDE["words"], block_rows)))
    own = [F.col("doc_id"), text_key()]
    tied = prints.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "text_key")
    return without(one_each(docs, own, materialise(tied)), own, materialise(_losers(prints, tree)))
