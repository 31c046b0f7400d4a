"""Byte-level BPE by prefix dynamic programming.

Of every byte prefix of a piece, the encoding's last token is stored: it is the only token
that ends there and is compatible with the last token of the prefix before it.  Two tokens
are compatible if no merge across their border would come before the merges that built
them; undoing those merges from the highest rank down decides it.  So an encoding is read
off backwards, an append extends the table, and an edit renews it only near the edit
(``Prefixes``).

``Encoder.encode_pieces`` fills the tables of many pieces of one length side by side.
Pieces are the matches of the vocabulary's pattern; encodings of frequent short stretches
between blanks are kept in a store that is bounded in stretches and so in bytes.

Cases: a null text is an empty one: no ids, digests of the empty string.  Texts, ties and
repeated rows are encoded one by one, each in full; long pieces take a table of their own
(``Prefixes``), whose candidates are found for thousands of starts at once.  An empty table gives an empty result.  Only the id and the text are read,
except by ``tokenize``, which passes all columns through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Stretches whose ids a worker keeps at most.
HELD = 400_000
#: Longest stretch that is kept, in characters.
LONGEST = 64
#: Starts of a long piece whose tokens are sought at once.
STARTS = 1 << 14
#: Longest piece of the side-by-side tables.
WIDE = 32


class Lookup:
    """Immutable map from non-negative longs to ints, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == -1
            take = left[free]
            self.keys[slot[take]] = keys[take]  # of several the last one stays
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.values[slot], -1)
        left = np.flatnonzero((have != keys) & (have != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            have = self.keys[slot[left]]
            hit = have == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (have != -1)]
        return out


def _two_parts(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge gives ``token``, found by merging below its rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = rank, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], rank)
            if r < best:
                best, at = r, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None


class Encoder:
    """Tables of a vocabulary: splits, pairs, and a trie of the tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.pattern = pattern
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.usable = np.zeros(size, bool)
        for token, rank in ranks.items():
            parts = _two_parts(token, rank, ranks)
            if parts:
                self.left[rank], self.right[rank] = parts
            self.usable[rank] = len(token) == 1 or parts is not None
        self.sizes = np.array([len(t) for t in self.tokens], np.int32)
        self.longest = int(self.sizes.max())
        merged = np.flatnonzero(self.left >= 0)
        self.pairs = Lookup((self.left[merged].astype(np.int64) << 32) | self.right[merged], merged)
        keys, values, nodes, token_of = [], [], {b"": 0}, [-1]
        for rank, token in enumerate(self.tokens):
            if not self.usable[rank]:
                continue
            for n in range(1, len(token) + 1):
                head = token[:n]
                if head not in nodes:
                    nodes[head] = len(token_of)
                    token_of.append(-1)
                    keys.append(nodes[head[:-1]] << 8 | head[-1])
                    values.append(nodes[head])
            token_of[nodes[token]] = rank
        self.step, self.token_of = Lookup(np.array(keys), np.array(values)), np.array(token_of, np.int32)
        self.known_keys, self.known = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self._start()

    def _start(self) -> None:
        self.ids_of = {t: i for i, t in enumerate(self.tokens) if self.usable[i]}
        self.names = [str(i) for i in range(len(self.tokens))]
        self.find = regex.compile(self.pattern).findall
        self.held: dict[str, bytes] = {}
        self.parts = list(zip(self.left.tolist(), self.right.tolist(), strict=True))
        self.merge_of = {a << 32 | b: rank for rank, (a, b) in enumerate(self.parts) if a >= 0}
        self.fitting: dict[int, bool] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ids_of", "names", "find", "held", "parts", "merge_of", "fitting")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._start()

    # -- compatibility of neighbours

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which token pairs stand side by side in an encoding."""
        key = (first.astype(np.int64) << 32) | second
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.known[slot]
        new = np.flatnonzero(self.known_keys[slot] != key)
        if len(new):
            out[new] = found = self._compatible(first[new], second[new])
            self.known_keys[slot[new]], self.known[slot[new]] = key[new], found
            # two pairs of this call may share a slot; what stays must belong together
            self.known[slot[new]] = np.where(self.known_keys[slot[new]] == key[new], found, self.known[slot[new]])
            lost = self.known_keys[slot[new]] != key[new]
            self.known_keys[slot[new[lost]]] = -1
        return out

    def fits(self, first: int, second: int) -> bool:
        """``compatible`` for one pair, kept in a bounded store."""
        found = self.fitting.get(first << 32 | second)
        if found is None:
            if len(self.fitting) > HELD:
                self.fitting.clear()
            found = self.fitting[first << 32 | second] = self._fits(first, second)
        return found

    def _fits(self, a: int, b: int) -> bool:
        limit = len(self.tokens)
        while True:
            if self.merge_of.get(a << 32 | b, limit) < limit:
                return False
            rank_a, rank_b = (x if self.parts[x][0] >= 0 else -1 for x in (a, b))
            if rank_a > rank_b:
                limit, a = a, self.parts[a][1]
            elif rank_b >= 0:
                limit, b = b + 1, self.parts[b][0]
            else:
                return True

    def _compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        a, b = first.astype(np.int64), second.astype(np.int64)
        out = np.ones(len(a), bool)
        index, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        while len(index):
            across = self.pairs((a << 32) | b)
            bad = (across >= 0) & (across < limit)
            out[index[bad]] = False
            rank_a, rank_b = np.where(self.left[a] >= 0, a, -1), np.where(self.left[b] >= 0, b, -1)
            on = ~bad & ((rank_a >= 0) | (rank_b >= 0))
            undo_a = rank_a > rank_b
            # of equal ranks the left one is merged first, so the right one is undone first
            limit = np.where(undo_a, a, b + 1)[on]
            a, b = np.where(undo_a, self.right[a], a)[on], np.where(undo_a, b, self.left[b])[on]
            index = index[on]
        return out

    # -- tables of prefixes

    def _last_tokens(self, text: np.ndarray) -> np.ndarray:
        """Last token of each prefix; ``text`` holds pieces of one length by row."""
        n, size = text.shape
        ends: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for start in range(size):
            rows, state = np.arange(n), np.zeros(n, np.int64)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                state = self.step((state << 8) | text[rows, end - 1]).astype(np.int64)
                alive = state >= 0
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                token = self.token_of[state]
                have = token >= 0
                if have.any():
                    ends[start, end] = rows[have], token[have]
        last = np.full((n, size + 1), -1, np.int32)
        for end in range(1, size + 1):
            for start in range(max(0, end - self.longest), end):
                if (start, end) not in ends:
                    continue
                rows, token = ends[start, end]
                if start:
                    open_ = last[rows, end] < 0
                    rows, token = rows[open_], token[open_]
                    fits = self.compatible(last[rows, start], token)
                    rows, token = rows[fits], token[fits]
                last[rows, end] = token
        return last

    def encode_pieces(self, found: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out, by_size = {}, defaultdict(list)
        for piece in found:
            known = self.ids_of.get(piece)
            if known is not None:
                out[piece] = known.to_bytes(4, "little")
            elif len(piece) > WIDE:
                out[piece] = np.array(Prefixes(self, piece).ids(), "<u4").tobytes()
            else:
                by_size[len(piece)].append(piece)
        for size, own in by_size.items():
            for at in range(0, len(own), 1 << 15):
                some = own[at : at + (1 << 15)]
                last = self._last_tokens(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), size))
                place, rows, columns = np.full(len(some), size), np.arange(len(some)), []
                while True:
                    on = place > 0
                    if not on.any():
                        break
                    token = np.where(on, last[rows, place], -1)
                    columns.append(token)
                    place = place - np.where(on, self.sizes[token], 0)
                ids = np.array(columns[::-1], np.int64).T
                full = ids >= 0
                flat, ends = ids[full].astype("<u4").tobytes(), np.cumsum(full.sum(axis=1)) * 4
                for piece, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[piece] = flat[a:b]
        return out

    # -- texts

    def stretches(self, text: str) -> list[str]:
        """The text cut before single blanks between other characters, where pieces begin."""
        if _WIDE_SPACE.search(text):
            cut = _LONE_BLANK.split(text)
        else:
            cut = text.split(" ")
        return [cut[0], *map(" ".__add__, cut[1:])]

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [self.stretches(t) if t else [] for t in texts]
        seen = {s for own in cut for s in own}
        new = seen.difference(self.held)
        if len(self.held) + len(new) > HELD:
            self.held.clear()
            new = seen
        found = {s: self.find(s) for s in new}
        ids = self.encode_pieces({p.encode("utf-8", "surrogatepass") for own in found.values() for p in own})
        coded = {s: b"".join([ids[p.encode("utf-8", "surrogatepass")] for p in own]) for s, own in found.items()}
        self.held.update((s, own) for s, own in coded.items() if len(s) <= LONGEST)
        long_ = {s: own for s, own in coded.items() if len(s) > LONGEST}
        get, get_long = self.held.get, long_.get
        return [b"".join([get(s) or get_long(s, b"") for s in own]) for own in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_WIDE_SPACE = re.compile(r"\s\s")
_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")


class Prefixes:
    """The last token of every prefix of one piece, for appends and edits."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, bytearray(), [-1]
        self.append(data)

    def _at(self, end: int) -> int:
        ids, data = self.encoder.ids_of, self.data
        for start in range(max(0, end - self.encoder.longest), end):
            token = ids.get(bytes(data[start:end]))
            if token is not None and (start == 0 or self._fits(self.last[start], token)):
                return token
        raise ValueError("a byte has no token")

    def _fits(self, first: int, second: int) -> bool:
        return self.encoder.fits(first, second)

    def _long(self, data: bytes) -> None:
        """Append many bytes: the tokens that end at each are found for STARTS starts at once."""
        old = len(self.data)
        self.data += data
        encoder, size, last, fits = self.encoder, len(self.data), self.last, self.encoder.fits
        text = np.frombuffer(bytes(self.data), np.uint8)
        # tokens (end, start, token) from starts before the ones at work, that end after them
        ends = starts = tokens = np.empty(0, np.int64)
        for first in range(max(0, old + 1 - encoder.longest), size, STARTS):
            stop = min(size, first + STARTS)
            place, state, found = np.arange(first, stop), np.zeros(stop - first, np.int64), [(ends, starts, tokens)]
            for n in range(1, encoder.longest + 1):
                inside = place + n <= size
                place, state = place[inside], state[inside]
                state = encoder.step((state << 8) | text[place + n - 1]).astype(np.int64)
                alive = state >= 0
                place, state = place[alive], state[alive]
                if not len(place):
                    break
                token = encoder.token_of[state]
                have = token >= 0
                found.append((place[have] + n, place[have], token[have].astype(np.int64)))
            ends, starts, tokens = (np.concatenate(c) for c in zip(*found, strict=True))
            now = (ends > old) & (ends <= stop)
            later = ends > stop
            order = np.lexsort((starts[now], ends[now]))
            own_ends, own_starts, own_tokens = ends[now][order], starts[now][order].tolist(), tokens[now][order].tolist()
            bounds = np.searchsorted(own_ends, np.arange(len(last), stop + 2)).tolist()
            for low, high in zip(bounds, bounds[1:], strict=False):
                for k in range(low, high):
                    a = own_starts[k]
                    if a == 0 or fits(last[a], own_tokens[k]):
                        last.append(own_tokens[k])
                        break
                else:
                    raise ValueError("a byte has no token")
            ends, starts, tokens = ends[later], starts[later], tokens[later]

    def append(self, data: bytes) -> None:
        if len(data) > WIDE:
            self._long(data)
            return
        for byte in data:
            self.data.append(byte)
            self.last.append(self._at(len(self.data)))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put ``data`` in place of bytes start to end; how many entries were renewed."""
        old, shift = self.last, start + len(data) - end
        self.data[start:end] = data
        self.last = self.last[: start + 1]
        same = renewed = 0
        for i in range(start + 1, len(self.data) + 1):
            self.last.append(self._at(i))
            renewed += 1
            was = i - shift
            same = same + 1 if was > end and old[was] == self.last[i] else 0
            if same >= self.encoder.longest:  # an entry depends on so many before it
                self.last += old[was + 1 :]
                break
        return renewed

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= int(self.encoder.sizes[out[-1]])
        return out[::-1]


@lru_cache(4)
def encoder(path: str | None = None) -> Encoder:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return Encoder(ranks)


def _mapped(docs: DataFrame, text_col: str, schema: T.StructType, each, path: str | None) -> DataFrame:
    """``each(encoder, batch, texts, ids)`` over ``docs``; the vocabulary's tables are broadcast."""
    tables = docs.sparkSession.sparkContext.broadcast(encoder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tables.value
        for part, texts in pieces(batches, text_col):
            yield each(own, part, texts, own.encode_batch(texts))

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode, decode, and return per row the number of ids and digests of ids and bytes."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def each(own: Encoder, part: pa.RecordBatch, texts: list, encoded: list[bytes]) -> pa.RecordBatch:
        counts, of_ids, of_bytes = [], [], []
        for raw in encoded:
            ids = np.frombuffer(raw, "<u4").tolist()
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([part.column(id_col), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=schema.names)

    return _mapped(docs.select(id_col, text_col), text_col, schema, each, path)


def tokenize(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the ids of each text (an own column of that name gives way)."""
    docs = docs.drop(ids_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])

    def each(own: Encoder, part: pa.RecordBatch, texts: list, encoded: list[bytes]) -> pa.RecordBatch:
        offsets = np.concatenate(([0], np.cumsum([len(raw) // 4 for raw in encoded]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
        return pa.RecordBatch.from_arrays([*part.columns, ids], names=schema.names)

    return _mapped(docs, text_col, schema, each, path)


def detokenize(rows: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded", path: str | None = None) -> DataFrame:
    """All columns and the decoded bytes of the ids."""
    rows = rows.drop(bytes_col)
    tables = rows.sparkSession.sparkContext.broadcast(encoder(path))
    schema = T.StructType([*rows.schema.fields, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if ids is None else tables.value.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)
