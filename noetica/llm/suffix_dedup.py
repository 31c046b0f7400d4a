"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of WIDTH = 100 bytes that covers it also starts earlier (in a
document of smaller id, or earlier in the same one).  Positions get ranks for strings of
growing length; those whose rank is unique drop out, until the length reaches the threshold:

1. 32 bytes, at synchronising positions: of the 69 positions where a 32-byte string lies
   inside a 100-byte window, the one with the least hash (the leftmost of equal ones) owns
   the window.  Equal windows have owners at equal offsets, so only owners are ranked, about
   one position in 35.  With a position goes the rank of its surroundings, the 168 bytes
   that all its windows span.  A position whose surroundings appear earlier is settled: all
   of them go.  If the 32 bytes have one surroundings only, nothing else can match.
2. The windows of the positions left, 16 neighbours at a time by their common core of 85
   bytes.  Spark sorts the positions by (rank of 32 bytes, rank of 32 bytes at offset 32);
   those with a pair of their own drop out, the others get the rank of 64 bytes.
3. It sorts what is left by (rank of 64 bytes, rank of 32 bytes at offset 53): 85 bytes.
4. 100 bytes: core paired with the bytes around it, per window; the first of equal windows
   stays, the others mark what goes.

Ranks are names, 64-bit hashes of the bytes or of the pair, the same for equal strings
wherever they lie, so no table of ranks is sent around.  Positions of step 1 travel as packed
arrays by hash bucket.  Every map task combines equal keys first and sends at most CONTEXTS
surroundings of a 32-byte string to its bucket; those beyond are passed on to step 2 as they
are, and like all whose state is known there they are spread over the buckets.  So a string
found in a third of all documents costs a bucket a bounded number of entries for each map
task.  The sorts of steps 2 and 3 are by ranges of (rank, rank, id), so a core found in a third of all
documents lies in many partitions; a partition's first and last core may go on in another, so
of their equal windows the first is sent on, and those meet by window.

Cases: null text is empty: no bytes, no spans.  Texts under 100 bytes keep everything.
Rows without an id come first; rows that share an id are taken in order of their texts;
of equal rows one, no matter which, counts as the earliest.  Ids may be of any type that
sorts.  Texts of any length are scanned in segments.  An empty table gives an empty result.
Columns other than id and text pass through ``remove`` untouched, whatever their names, as
columns are renamed while at work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, pieces, places, written

WIDTH, GRAM = 100, 32
SPAN = WIDTH - GRAM  # how far before its owner a window starts at most
CHUNK = 16
CORE = WIDTH - (CHUNK - 1)
#: Where the 32-byte ranks that make up a core start.
OFFSETS = (0, GRAM, CORE - GRAM)
#: Surroundings of one 32-byte string that a map task sends on.
CONTEXTS = 8
#: Positions that a map task combines at once.
FLUSH = 1 << 21
#: Text bytes per hash bucket.
BUCKET_BYTES = 4 << 20
SEGMENT = 1 << 17

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_C2 = [np.uint64(c) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_PAD = 192


def _mix(h: np.ndarray, v: np.ndarray, c: np.uint64) -> np.ndarray:
    h = h ^ v
    h *= c
    h ^= h >> np.uint64(32)
    return h


class Text:
    """Documents in a row, padded, with loads of eight bytes at any position."""

    def __init__(self, docs: list[bytes]):
        self.sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.size = int(self.ends[-1]) if len(docs) else 0
        self.data = b"".join([b"\0" * _PAD, *docs, b"\0" * _PAD])
        self.words = np.ndarray((self.size + 2 * _PAD - 8,), "<u8", self.data, 0, (1,))
        self.bytes = np.frombuffer(self.data, np.uint8)

    def load(self, at: np.ndarray) -> np.ndarray:
        return self.words[at + _PAD]

    def gram_hashes(self, start: int, end: int) -> np.ndarray:
        """Hashes of the 32 bytes at each of a range of positions."""
        a, n = start + _PAD, end - start
        h = self.words[a : a + n].astype(np.uint64) * _C[0]
        h ^= h >> np.uint64(32)
        for k in (1, 2, 3):
            h ^= self.words[a + 8 * k : a + 8 * k + n]
            h *= _C[k]
            h ^= h >> np.uint64(32)
        return h

    def hashes(self, at: np.ndarray, size: int, constants: list[np.uint64]) -> np.ndarray:
        """Hashes of ``size`` bytes at given positions."""
        h = np.full(len(at), np.uint64(size))
        whole = size // 8
        for k in range(whole):
            h = _mix(h, self.load(at + 8 * k), constants[k % 4])
        if size % 8:
            h = _mix(h, self.load(at + size - 8), constants[whole % 4])
        return h ^ (h >> np.uint64(29))

    def surroundings(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from SPAN before to WIDTH after, as far as the documents go."""
        first, last = self.starts[doc], self.ends[doc]
        h = self.hashes(at - SPAN, SPAN + WIDTH, _C2)
        cut = np.flatnonzero((at - SPAN < first) | (at + WIDTH > last))
        if len(cut):
            p, first, last = at[cut], first[cut], last[cut]
            g = np.full(len(cut), np.uint64(7))
            for k in range((SPAN + WIDTH) // 8):
                b = p - SPAN + 8 * k
                low, high = np.clip(first - b, 0, 8).astype(np.uint64) * np.uint64(8), np.clip(b + 8 - last, 0, 8).astype(np.uint64) * np.uint64(8)
                v = self.load(b)
                v = np.where(low < 64, (v >> (low & np.uint64(63))) << (low & np.uint64(63)), np.uint64(0))
                v = np.where(high < 64, (v << (high & np.uint64(63))) >> (high & np.uint64(63)), np.uint64(0))
                g = _mix(g, v, _C2[k % 4])
            g = _mix(g, np.minimum(p - first, SPAN).astype(np.uint64), _C2[1])
            h[cut] = _mix(g, np.minimum(last - p, WIDTH).astype(np.uint64), _C2[2])
        return h

    def owners(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By segment: window starts, their owners, and the owners' hashes."""
        inside = np.zeros(self.size + 1, np.int8)  # where a window starts inside one document
        long_ = np.flatnonzero(self.sizes >= WIDTH)
        np.add.at(inside, self.starts[long_], 1)
        np.add.at(inside, self.ends[long_] - WIDTH + 1, -1)
        inside = np.cumsum(inside, dtype=np.int8)[:-1].astype(bool)
        low = np.uint64((1 << 18) - 1)
        for start in range(0, self.size, SEGMENT):
            end = min(start + SEGMENT, self.size)
            h = self.gram_hashes(start, end + SPAN)
            key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while width < 64:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            rest = SPAN + 1 - width
            key = np.minimum(key[: end - start], key[rest : rest + end - start])
            p = np.flatnonzero(inside[start:end])
            owner = (key[p] & low).astype(np.int64)
            yield p + start, owner + start, h[owner]


def _bytes_of(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def _packed(bucket: np.ndarray, columns: list[np.ndarray], n_buckets: int) -> tuple[list[int], list[list[bytes]]]:
    """Columns cut by bucket: bucket numbers, and per column the bytes of each."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    some = np.flatnonzero(np.diff(edges))
    out = []
    for c in columns:
        c = np.ascontiguousarray(c[order])
        out.append([c[edges[b] : edges[b + 1]].tobytes() for b in some])
    return some.tolist(), out


def _buckets(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket, from rows sorted by bucket."""
    held, now = [], None

    def whole() -> list[np.ndarray]:
        return [np.frombuffer(b"".join(parts), kind) for parts, kind in zip(zip(*held, strict=True), kinds, strict=True)]

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[1:]]
        for i, b in enumerate(batch.column(0).to_pylist()):
            if b != now and held:
                yield whole()
                held = []
            now = b
            held.append([c[i] for c in columns])
    if held:
        yield whole()


_ENTRY = T.StructType([T.StructField("bucket", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("gram", "context", "id", "at", "state"))])
_ENTRY_KINDS = ["<u8", "<u8", "<i8", "<i8", "u1"]
#: States of a position: sent on as the earliest of its surroundings in its map task, or
#: known there to be settled, or to be left for the next step; CROWDED marks a 32-byte
#: string that has more surroundings than were sent.
SENT, SETTLED, LEFT, CROWDED = 0, 1, 2, 3


def _groups(gram: np.ndarray, context: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of repeated strings in order, with starts of strings and of surroundings."""
    order = np.argsort(gram, kind="stable")
    own = gram[order]
    same = own[1:] == own[:-1]
    twice = np.zeros(len(own), bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = order[twice]
    some = some[np.lexsort((at[some], ids[some], context[some], gram[some]))]
    new_gram = np.ones(len(some), bool)
    new_gram[1:] = gram[some[1:]] != gram[some[:-1]]
    new_context = new_gram.copy()
    new_context[1:] |= context[some[1:]] != context[some[:-1]]
    return some, new_gram, new_context


def _combined(gram: np.ndarray, context: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """States of a map task's own positions."""
    state = np.zeros(len(gram), np.uint8)
    some, new_gram, new_context = _groups(gram, context, ids, at)
    state[some[~new_context]] = SETTLED
    firsts, of = some[new_context], np.cumsum(new_gram)[new_context]
    nth = np.arange(len(firsts)) - np.searchsorted(of, of)
    state[firsts[nth == CONTEXTS]] = CROWDED
    state[firsts[nth > CONTEXTS]] = LEFT
    return state


def _positions(n_buckets: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            gram, context, ids, at = (np.concatenate(c) for c in zip(*held, strict=True))
            state = _combined(gram, context, ids, at)
            # what is known already needs no meeting: it is spread, whatever its string
            known = (state == SETTLED) | (state == LEFT)
            place = np.where(known, _mix(ids.astype(np.uint64), at.astype(np.uint64), _C[0]), gram)
            numbers, columns = _packed((place % np.uint64(n_buckets)).astype(np.int64), [gram, context, ids, at, state], n_buckets)
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=_ENTRY.names)

        for part, texts in pieces(batches, text_col):
            text = Text(_bytes_of(texts))
            ids = part.column("_id").to_numpy()
            last = -1
            for _, owner, h in text.owners():
                # owners rise with their windows; one may own windows of two segments
                first = owner != np.concatenate(([last], owner[:-1]))
                last = owner[-1] if len(owner) else last
                owner, h = owner[first], h[first]
                doc = np.searchsorted(text.ends, owner, "right")
                held.append((h, text.surroundings(owner, doc), ids[doc], owner - text.starts[doc]))
                size += len(owner)
            if size >= FLUSH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


_STATUS = T.StructType([T.StructField("_id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("settled", T.BooleanType())])


def _statuses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for gram, context, ids, at, state in _buckets(batches, _ENTRY_KINDS):
        alone = (state == SETTLED) | (state == LEFT)
        sent = np.flatnonzero(~alone)
        some, new_gram, new_context = _groups(gram[sent], context[sent], ids[sent], at[sent])
        some = sent[some]
        of = np.cumsum(new_gram) - 1
        several = np.bincount(of[new_context], minlength=int(new_gram.sum())) > 1
        several |= np.bincount(of, weights=state[some] == CROWDED, minlength=len(several)) > 0
        settled = np.concatenate([some[~new_context], np.flatnonzero(state == SETTLED)])
        # a string met once here may still have been left over by the same map task
        lone = np.setdiff1d(np.flatnonzero(state == CROWDED), some)
        left = np.concatenate([some[new_context & several[of]], np.flatnonzero(state == LEFT), lone])
        rows = np.concatenate([settled, left])
        flag = np.arange(len(rows)) < len(settled)
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(at[rows]), pa.array(flag)], names=_STATUS.names)


_CORE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("a", "b", "last")] + [T.StructField("around", T.BinaryType())] + [T.StructField(n, T.LongType()) for n in ("_id", "at")] + [T.StructField(n, T.IntegerType()) for n in ("low", "high")]
)


_KEPT = T.StructType([T.StructField("rank", T.LongType()), *_CORE.fields[2:]])


def _cores(text_col: str):
    """Cores of the windows that positions in ``_left`` own, with their ranks of 32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            order = np.lexsort(columns[1::-1])  # equal cores are neighbours, which compresses well
            columns = [c[order] for c in columns]
            n = len(order)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (2 * CHUNK - 2)).buffers()[1]
            around = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(columns[3].tobytes())])
            return pa.RecordBatch.from_arrays([*map(pa.array, columns[:3]), around, *map(pa.array, columns[4:])], names=_CORE.names)

        for part, texts in pieces(batches, text_col):
            text = Text(_bytes_of(texts))
            ids = part.column("_id").to_numpy()
            wanted = np.zeros(text.size, bool)
            for k, where in enumerate(part.column("_left").to_pylist()):
                wanted[np.array(where, np.int64) + text.starts[k]] = True
            for p, owner, _ in text.owners():
                mine = wanted[owner]
                p, owner = p[mine], owner[mine]
                if not len(p):
                    continue
                before = owner - p
                # the windows of an owner and a chunk are neighbours, the farthest first
                chunk = before // CHUNK
                new = np.ones(len(p), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (chunk[1:] != chunk[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(p)) - 1
                owner, chunk = owner[first], chunk[first]
                at = owner - CHUNK * chunk  # where the core starts
                around = np.empty((len(at), 2 * CHUNK - 2), np.uint8)
                for e in range(CHUNK - 1):
                    around[:, e] = text.bytes[at - 1 - e + _PAD]
                    around[:, CHUNK - 1 + e] = text.bytes[at + CORE + e + _PAD]
                doc = np.searchsorted(text.ends, owner, "right")
                ranks = [text.hashes(at + o, GRAM, _C).view(np.int64) for o in OFFSETS]
                ends = [(before[k] - CHUNK * chunk).astype(np.int32) for k in (last, first)]
                held.append([*ranks, around, ids[doc], at - text.starts[doc], *ends])
                size += len(at)
            if size >= FLUSH // 8:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return run


def _reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their pair ``a, b`` those whose pair is not their own, with its rank.

    The first and the last pair of a partition may go on in another, so they stay.
    """
    before: tuple[int, int] | None = None  # the last pair met
    waiting: pa.RecordBatch | None = None  # its row, if it was the first one

    def out(rows: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (rows.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        rank = _mix(_mix(a, b, _C2[0]), a, _C2[1]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rank), *rows.columns[2:]], names=_KEPT.names)

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = before != (a[0], b[0])
        keep = ~new
        keep[:-1] |= ~new[1:]
        keep[0] |= before is None
        if waiting is not None and not new[0]:
            yield out(waiting)
        waiting = None if keep[-1] else batch.slice(len(a) - 1)
        before = (a[-1], b[-1])
        if keep.any():
            yield out(batch.filter(pa.array(keep)))
    if waiting is not None:
        yield out(waiting)


_SPANS = T.StructType([T.StructField("_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
#: Spans to remove (``core`` is null), or windows that are the first of their core in a partition.
_MET = T.StructType([*_SPANS.fields, T.StructField("core", T.LongType()), T.StructField("key", T.LongType())])


def _window_keys(core: np.ndarray, around: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of bytes before the core: which cores have the window, and its key."""
    left, right = [core.astype(np.uint64)], [np.zeros(len(core), np.uint64)]
    for e in range(CHUNK - 1):
        left.append(_mix(left[-1] + np.uint64(e), around[:, e].astype(np.uint64), _C2[e % 4]))
        right.append(_mix(right[-1] + np.uint64(e + 1), around[:, CHUNK - 1 + e].astype(np.uint64), _C[e % 4]))
    for e in range(CHUNK):
        have = np.flatnonzero((low <= e) & (e <= high))
        yield e, have, _mix(left[e][have], right[CHUNK - 1 - e][have] + np.uint64(e), _C2[2])


def _met(rows: list[pa.RecordBatch], whole: bool) -> pa.RecordBatch:
    """Spans of the windows that have an equal one before; unless the cores are ``whole`` here,
    also the windows that have none."""
    table = pa.Table.from_batches(rows).combine_chunks()
    around = np.frombuffer(b"".join(table["around"].to_pylist()), np.uint8).reshape(-1, 2 * CHUNK - 2)
    rank, last, ids, at, low, high = (table[n].to_numpy() for n in ("rank", "last", "_id", "at", "low", "high"))
    core = _mix(rank.view(np.uint64), last.view(np.uint64), _C[3])
    spans, firsts = [], []
    for e, have, key in _window_keys(core, around, low, high):
        order = np.lexsort((at[have], ids[have], core[have], key))
        own, key = have[order], key[order]
        again = np.zeros(len(own), bool)
        again[1:] = (key[1:] == key[:-1]) & (core[own[1:]] == core[own[:-1]])
        spans.append((ids[own[again]], at[own[again]] - e))
        if not whole:
            new = own[~again]
            firsts.append((ids[new], at[new] - e, core[new].view(np.int64), key[~again].view(np.int64)))
    own_ids, starts = (np.concatenate(c) for c in zip(*spans, strict=True))
    # neighbours make one span
    order = np.lexsort((starts, own_ids))
    own_ids, starts = own_ids[order], starts[order]
    cut = np.ones(len(starts), bool)
    cut[1:] = (own_ids[1:] != own_ids[:-1]) | (starts[1:] > starts[:-1] + WIDTH)
    first = np.flatnonzero(cut)
    last_ = np.append(first[1:], len(starts)) - 1 if len(first) else first
    found = [own_ids[first], starts[first], starts[last_] + WIDTH]
    nothing = pa.nulls(len(first), pa.int64())
    if whole:
        return pa.RecordBatch.from_arrays([*map(pa.array, found), nothing, nothing], names=_MET.names)
    more = [np.concatenate(c) for c in zip(*firsts, strict=True)]
    columns = [np.concatenate(c) for c in zip(found, (more[0], more[1], more[1] + WIDTH), strict=True)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.concat_arrays([nothing, pa.array(c)]) for c in more[2:])], names=_MET.names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What windows meet, from cores sorted by rank and last rank."""
    held: list[pa.RecordBatch] = []
    size, whole, before = 0, False, None  # the partition's first core may have begun in another
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rank, last = batch.column("rank").to_numpy(), batch.column("last").to_numpy()
        new = np.ones(n, bool)
        new[1:] = (rank[1:] != rank[:-1]) | (last[1:] != last[:-1])
        new[0] = before is not None and before != (rank[0], last[0])
        before, starts = (rank[-1], last[-1]), np.flatnonzero(new[1:]) + 1
        starts = np.concatenate(([0] if new[0] else [], starts)).astype(int).tolist()
        at = 0
        for cut in dict.fromkeys([*starts[:1], *starts[-1:]]):  # the end of the core at work, then of all others but the last
            held.append(batch.slice(at, cut - at))
            if size + cut - at:
                yield _met(held, whole)
            held, size, whole, at = [], 0, True, cut
        held.append(batch.slice(at))
        size += n - at
        if not whole and size >= FLUSH // 8:
            yield _met(held, False)
            held, size = [], 0
    if size:
        yield _met(held, False)


def _repeated_windows(cores: DataFrame) -> DataFrame:
    """Spans of the windows that also start earlier."""
    pairs = written(cores, "cores")
    by = ["a", "b", "_id"]
    kept = written(pairs.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_reranked, _KEPT), "cores-64")
    by = ["rank", "last", "_id"]
    met = written(kept.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_windows, _MET), "windows")
    nth = F.row_number().over(Window.partitionBy("core", "key").orderBy("_id", "start"))
    again = met.where("core is not null").withColumn("nth", nth).where("nth > 1")
    return met.where("core is null").select(*_SPANS.names).unionByName(again.select(*_SPANS.names))


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns, ``_id``, and ``_spans``: what to remove (unmerged; null if nothing)."""
    rows, size = numbered(docs, id_col, text_col), docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_buckets = max(64, size // BUCKET_BYTES)
    dealt = rows.select("_id", F.col(text_col)).mapInArrow(_positions(n_buckets, text_col), _ENTRY).repartition("bucket").sortWithinPartitions("bucket")
    statuses = written(dealt.mapInArrow(_statuses, _STATUS), "statuses")
    left = statuses.where("not settled").groupBy("_id").agg(F.collect_set("at").alias("_left"))
    # both joins see the same columns and rows, so the texts are dealt once (a reused exchange)
    texts = rows.repartition("_id")
    windows = _repeated_windows(texts.join(left, "_id").mapInArrow(_cores(text_col), _CORE))
    settled = statuses.where("settled").select("_id", (F.col("at") - SPAN).alias("start"), (F.col("at") + WIDTH).alias("end"))
    spans = windows.unionByName(settled).groupBy("_id").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    return texts.join(spans, "_id", "left")


def merged(spans: list | None, size: int) -> list[tuple[int, int]]:
    """Spans cut to the text and joined; what is shorter than WIDTH after the cut is no match."""
    out: list[tuple[int, int]] = []
    cut = sorted((max(0, s["start"]), min(size, s["end"])) for s in spans or ())
    for a, b in cut:
        if b - a < WIDTH:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: bytes, removed bytes, spans removed, and the SHA-256 of what is kept."""
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "c1"):
            rows = []
            for raw, found in zip(_bytes_of(texts), part.column("_spans").to_pylist(), strict=True):
                spans = merged(found, len(raw))
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()))
            types = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("c0"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=schema.names)

    return _with_spans(docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1")), "c0", "c1").mapInArrow(run, schema)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, repeated strings taken out of the texts.

    A text must stay text: a character of which a span holds only some bytes is kept.
    """
    schema, at = docs.schema, docs.columns.index
    id_place, text_place = f"c{at(id_col)}", f"c{at(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text_place):
            new = []
            for text, raw, found in zip(texts, _bytes_of(texts), part.column("_spans").to_pylist(), strict=True):
                spans = []
                for a, b in merged(found, len(raw)):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    spans.append((a, b))
                new.append(_kept(raw, spans).decode("utf-8", "surrogatepass") if spans else text)
            arrays = []
            for i, f in enumerate(schema.fields):
                column = part.column(f"c{i}")
                if f.name == text_col:
                    column = pa.array(new, column.type)
                elif f.name == chars_col:
                    column = pa.array([len(t) if t is not None else 0 for t in new], column.type)
                arrays.append(column)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return _with_spans(places(docs), id_place, text_place).mapInArrow(run, schema)


#: DuckDB SQL for ``digests`` over ``documents``: every window's first start, in hexadecimal
#: digits (two a byte).  Ids are taken to be unique.
ORACLE_SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) x, octet_length(encode(coalesce(text, ''))) n from documents),
windows as (select doc_id, i, md5_number_lower(substr(x, 2 * i + 1, {2 * WIDTH})) h from d, lateral (select unnest(range(0, n - {WIDTH - 1})) i) where n >= {WIDTH}),
ranked as (select doc_id, i, row_number() over (partition by h order by doc_id, i) nth from windows),
again as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + {WIDTH}, true)::int new from ranked where nth > 1),
numbered as (select doc_id, i, sum(new) over (partition by doc_id order by i) run from again),
runs as (select doc_id, min(i) a, max(i) + {WIDTH} b from numbered group by doc_id, run),
cut as (select *, coalesce(lag(b) over w, 0) before, lead(b) over w is null last_ from runs window w as (partition by doc_id order by a)),
kept as (select doc_id, count(*) n_spans, sum(b - a) n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)) || case when last_ then substr(x, 2 * b + 1) else '' end, '' order by a) y from cut join d using (doc_id) group by doc_id)
select doc_id, n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(y, x))) kept_sha256 from d left join kept using (doc_id)
"""
