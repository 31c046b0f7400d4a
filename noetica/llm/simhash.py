"""SimHash near-duplicates through an inverted index on positional bytes.

A fingerprint of 64 bits is eight positional bytes.  Two that differ in ``MAX_BITS`` = 3
bits or fewer share at least 8 - 3 = 5 of them.  Five shared positions always include
three within one half (bytes 0-3 or 4-7), so the index is keyed by the eight triples of
positions within a half: each posting list holds the distinct fingerprints with the same
three bytes.  Within a list the shared positional bytes of each pair are tallied, pairs
with five or more are retained, and the bits of those are verified.  A list reports its
links as a spanning forest, never as all pairs.

A long list is split by the further bytes that a pair must share (two of the other five),
and a list still long after that differs in 24 bits only, so its links are found by flipping
up to three of them: a list's cost grows in proportion to its length.  Lists of more than
SPLIT fingerprints are dealt by all five bytes before they meet in a task, so that none
holds more than the 2 ** 24 that three bytes tell apart.

Cases: texts without words (null, empty, blank) have fingerprint zero and are linked like
any other; fewer than three words are one shingle.  Very long texts are hashed in blocks of
shingles.  Equal texts meet in one fingerprint
before any pair is sought, so groups of copies cost nothing; ties cannot arise, as the
smallest id names the component; rows that repeat an id are linked by their texts like any
others.  A null id gets the id of its component, null if there is no other.  An empty table gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, pieces, places, written
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Positional bytes that a linked pair shares at least.
MIN_SHARED = 8 - MAX_BITS
#: The key positions of the inverted index.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
#: By kind, the positions that a posting list shares: triples, then those with two more.
KINDS = TRIPLES + [(*t, *more) for t in TRIPLES for more in combinations([p for p in range(8) if p not in t], MIN_SHARED - 3)]
#: Lists longer than this are dealt by five bytes.
SPLIT = 1 << 18
#: Keys of such lists up to this number (12 bytes each) are broadcast.
BROADCAST_KEYS = 100_000
#: Lists up to this length are compared directly.
DIRECT = 4096
#: Shingles hashed at once.
BLOCK = 1 << 18

_LANES = np.zeros(256, np.uint64)
for _bit in range(8):
    _LANES += ((np.arange(256, dtype=np.uint64) >> np.uint64(7 - _bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def _counts(digests: bytes) -> np.ndarray:
    """How many of the 8-byte hashes have each bit, most significant first."""
    lanes = _LANES[np.frombuffer(digests, np.uint8).reshape(-1, 8)]
    edges = np.arange(0, len(lanes), 255)
    return np.add.reduceat(lanes, edges, axis=0).astype("<u8").view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text's three-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_digest
    if n <= 1:
        total, n = _counts(digest(joined, SEED)), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-SHINGLE] + 1)).tolist()
        ends = ends[SHINGLE - 1 :].tolist()
        total = 0
        for at in range(0, n, BLOCK):
            total = total + _counts(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]))
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the fingerprint as a signed long, ``fp``."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text_col):
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(fps)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _retained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share MIN_SHARED positional bytes or more."""
    x = a ^ b
    x |= x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return 8 - np.bitwise_count(x & np.uint64(0x0101010101010101)) >= MIN_SHARED


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which retained pairs differ in few enough bits."""
    return np.bitwise_count(a ^ b) <= MAX_BITS


def _tiles(fps: np.ndarray, size: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(fps), size):
        for j in range(i, len(fps), size):
            a, b = np.nonzero(_retained(fps[i : i + size, None], fps[None, j : j + size]))
            hit = _verified(fps[a + i], fps[b + j])
            yield a[hit] + i, b[hit] + j


def _flips(fps: np.ndarray, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs among distinct fingerprints that differ in the three free bytes only."""
    low = np.zeros(len(fps), np.int64)
    for k, position in enumerate(free):
        low |= ((fps >> np.uint64(56 - 8 * position)) & np.uint64(255)).astype(np.int64) << (8 * k)
    place = np.full(1 << 24, -1, np.int32)
    place[low] = np.arange(len(fps))
    bits = [1 << b for b in range(24)]
    for r in range(1, MAX_BITS + 1):
        for some in combinations(bits, r):
            other = place[low ^ sum(some)]
            hit = np.flatnonzero(other >= 0)
            yield hit, other[hit]


def _list_pairs(fps: np.ndarray, shared: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (indices) of one posting list of distinct fingerprints."""
    if len(fps) <= DIRECT:
        yield from _tiles(fps)
        return
    rest = [p for p in range(8) if p not in shared]
    if len(shared) >= MIN_SHARED:
        yield from _flips(fps, rest)
        return
    for more in combinations(rest, MIN_SHARED - len(shared)):
        mask = np.uint64(sum(255 << (56 - 8 * p) for p in more))
        order = np.argsort(fps & mask, kind="stable")
        own = fps[order] & mask
        cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
        for a, b in zip(cuts[:-1][np.diff(cuts) > 1], cuts[1:][np.diff(cuts) > 1], strict=True):
            index = order[a:b]
            for i, j in _list_pairs(fps[index], (*shared, *more)):
                yield index[i], index[j]


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of linked rows; ``label`` points to smaller or equal rows."""
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]


def _forest(kinds: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) of rows linked within their own posting lists (sorted by key)."""
    n = len(fps)
    label = np.arange(n)
    cut = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1, [n]))
    sizes = np.diff(cut)
    run = np.repeat(np.arange(len(sizes)), sizes)
    short = np.flatnonzero(sizes[run] <= 64)
    step = 1
    while len(short):
        short = short[short + step < n]
        short = short[run[np.minimum(short + step, n - 1)] == run[short]]
        kept = short[_retained(fps[short], fps[short + step])]
        hit = kept[_verified(fps[kept], fps[kept + step])]
        _hook(label, hit, hit + step)
        step += 1
    for k in np.flatnonzero(sizes > 64):
        own = fps[cut[k] : cut[k + 1]]
        for i, j in _list_pairs(own, KINDS[kinds[cut[k]]]):
            _hook(label, i + cut[k], j + cut[k])
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of posting lists that come sorted by kind, key and fingerprint."""
    held: list[tuple[np.ndarray, ...]] = []

    def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        u, v = _forest(*rows)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        kinds, keys, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(fps):
            continue
        # the last list of a batch may go on in the next
        last = int(np.flatnonzero((keys == keys[-1]) & (kinds == kinds[-1]))[0])
        rows = (kinds, keys, fps.view(np.uint64))
        if last:
            held.append(tuple(x[:last] for x in rows))
            yield out(tuple(map(np.concatenate, zip(*held, strict=True))))
            held = []
        elif held and (held[-1][0][-1], held[-1][1][-1]) != (kinds[0], keys[0]):
            yield out(tuple(map(np.concatenate, zip(*held, strict=True))))
            held = []
        held.append(tuple(x[last:] for x in rows))
    if held:
        yield out(tuple(map(np.concatenate, zip(*held, strict=True))))


def _posted(fps: DataFrame, kinds: Iterable[int]) -> DataFrame:
    """``kind, key, fp``: the posting lists of some kinds that each fingerprint is in."""
    postings = []
    for k in kinds:
        mask = sum(255 << (56 - 8 * p) for p in KINDS[k])
        postings.append(F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return fps.select(F.explode(F.array(*postings)).alias("p"), "fp").select("p.kind", "p.key", "fp")


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` that connect all distinct fingerprints ``fp`` linked within MAX_BITS."""
    rows = _posted(distinct, range(len(TRIPLES)))
    if distinct.count() > SPLIT:  # else no list is that long
        long_ = written(rows.groupBy("kind", "key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("kind", "key"), "long-lists")
        n_long = long_.count()
        if n_long:
            keys = F.broadcast(long_) if n_long <= BROADCAST_KEYS else long_
            each = [rows.join(keys, ["kind", "key"], "left_anti")]
            inside = rows.join(keys, ["kind", "key"], "left_semi")
            for k, triple in enumerate(TRIPLES):
                each.append(_posted(inside.where(F.col("kind") == k), [i for i in range(len(TRIPLES), len(KINDS)) if KINDS[i][:3] == triple]))
            rows = reduce(DataFrame.unionByName, each)
    dealt = rows.repartition("kind", "key").sortWithinPartitions("kind", "key", "fp")
    return dealt.mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (its smallest id)."""
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")), "classes")
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row, all columns as they are: the first by id, and by text where
    ids are repeated; rows without an id come before the others."""
    place = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    rows = numbered(places(docs), place[id_col], place[text_col])
    stay = near_duplicates(rows, "_id", place[text_col]).where("_id = component_id").select("_id")
    return rows.join(stay, "_id", "left_semi").select(*(F.col(c).alias(name) for name, c in place.items()))
