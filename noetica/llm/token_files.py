"""Token ids in binary shards compressed by a Re-Pair grammar.

Documents are dealt by ranges of their ids, encoded, and gathered into shards of about
SHARD ids.  In each shard pairs of neighbouring ids are repeatedly replaced by
nonterminals until no pair occurs twice; every round replaces all pairs that occur often
enough, the more frequent one winning where two overlap.  A shard file holds the rules,
their expansion lengths, the remaining symbols, and each document's id and length, so any
range of ids is decoded by expanding only the symbols that cover it.

Shard file, little-endian: ``TOKR``, header of eight 64-bit integers (part, number within
the part, documents, rules, symbols, first nonterminal, ids, bytes of a symbol), document
ids (64 bit), document lengths (64 bit), a byte for each document whose id is null, rule
pairs (32 bit), expansion lengths (64 bit), symbols as byte planes, and a line feed.  Files are written by Spark's text
writer, one shard each, so that they are committed like any output and need no more than
the shared folder.

Cases: a null text is an empty one: it has the end id only.  Documents without an id come
first; those that share one are ordered by their texts.  Repeated rows are repeated in the
files.  A very long text makes a large shard of its own.  An empty table gives no files
and an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, scratch, written

VOCABULARY = "word_bpe_49k.json"
END = 1
#: Ids of a shard (one document more at most).
SHARD = 1 << 21
#: Least counts of a pair, one after the other: a pair that occurs twice is replaced in the end.
LEAST = (16, 4, 2)
#: Words whose ids a worker keeps at most, in each of two generations.
HELD = 400_000
#: Longest word that is kept, in characters: so the store is bounded in bytes too.
LONGEST = 64

_HEAD = struct.Struct("<4s8q")


class WordEncoder:
    """Encodings by the tokenizers library, kept for words between ASCII white space.

    The library drops white space and never joins what it separates, so a text's ids are
    those of its stretches in a row.  Of a stretch that is a Latin word with marks after it,
    the word, lower-cased, and the marks are the library's own two pieces; such pieces go to
    its BPE model directly, all others through the whole of it, as they are written: its
    special tokens are found in raw text only.

    Texts are split and their stretches numbered by Arrow, many texts at once; the store is
    asked once for each distinct word of them, and ids are gathered by number.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model.tokenize
        #: Ids of words; of what is not a word of the kind above, NO_WORD.
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():  # ASCII letters and marks stand for themselves
            piece = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", map(_ID, self.model(piece))).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.held.get, words))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            w = words[i]
            if len(w) > LONGEST:
                found[i] = NO_WORD
                continue
            ids = self.older.get(w)
            if ids is None:
                ids = self._piece(w.lower()) if _WORD.fullmatch(w) else NO_WORD
            found[i] = self.held[w] = ids
        if len(self.held) > HELD:
            self.older, self.held = self.held, {}
        return found

    def _stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct stretches in a row, and where each ends."""
        cores = pa.compute.utf8_rtrim(stretches, characters=_MARKS)
        n_marks = pa.compute.binary_length(stretches).to_numpy() - pa.compute.binary_length(cores).to_numpy()
        cores = cores.dictionary_encode()
        core = cores.indices.to_numpy()
        table = self._words(cores.dictionary.to_numpy(zero_copy_only=False).tolist())
        odd = (np.fromiter(map(len, table), np.int64, len(table)) == 0)[core] | (n_marks > MARKS)
        # two parts of each stretch by their places in the table: the word, and the marks
        part = np.zeros((len(core), 2), np.int64)
        part[:, 0], part[:, 1] = core, len(table)
        table.append(b"")
        for k in range(1, MARKS + 1):
            some = np.flatnonzero((n_marks == k) & ~odd)
            if len(some):
                marks = pa.compute.utf8_slice_codeunits(stretches.take(pa.array(some)), -k).dictionary_encode()
                part[some, 1] = marks.indices.to_numpy() + len(table)
                for m in marks.dictionary.to_numpy(zero_copy_only=False).tolist():
                    if m not in self.marks:
                        self.marks[m] = self._piece(m)
                    table.append(self.marks[m])
        some = np.flatnonzero(odd)
        if len(some):
            part[some, 0] = np.arange(len(some)) + len(table)
            own = self.tokenizer.encode_batch_fast(stretches.take(pa.array(some)).to_numpy(zero_copy_only=False).tolist(), add_special_tokens=False)
            table += [array("I", e.ids).tobytes() for e in own]
        return _gathered(table, part.reshape(-1), 2)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end."""
        lists = pa.compute.ascii_split_whitespace(texts.fill_null(""))
        stretches = lists.flatten().dictionary_encode()
        ids, ends = self._stretches(stretches.dictionary)
        out, stops = _taken(ids, ends, stretches.indices.to_numpy())
        # of a text without stretches, the list is empty or has one empty stretch
        return out, np.concatenate(([0], stops))[np.cumsum(lists.value_lengths().to_numpy())]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        raw = pa.array([None if t is None else t.encode("utf-8", "replace") for t in texts], pa.binary()).cast(pa.string())
        ids, ends = self.encode_column(raw)
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if len(texts) else []


def _taken(ids: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``ids`` (ending at ``ends``) picked by number, in a row, and their new ends."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    sizes = (ends - starts)[index]
    stops = np.cumsum(sizes)
    shift = starts[index] - stops + sizes
    return ids[np.repeat(shift, sizes) + np.arange(len(ids) and int(sizes.sum()))], stops


def _gathered(table: list[bytes], parts: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a table picked by number; the ends of every ``together`` of them."""
    ids = np.frombuffer(b"".join(table), "<u4")
    out, stops = _taken(ids, np.cumsum(np.fromiter(map(len, table), np.int64, len(table)) // 4), parts)
    return out, stops[together - 1 :: together]


_ID = attrgetter("id")
NO_WORD = b""
# marks that the library keeps together and that start no contraction; so many at most
_MARKS, MARKS = ".,!?;:|&$%*#-", 4
_WORD = re.compile("[a-zA-Zß-öø-ÿÀ-ÖØ-Þ]+")
# the letters that byte-level vocabularies write bytes as
_BYTE_LETTERS = {}
for _b in range(256):
    _shown = 33 <= _b <= 126 or 161 <= _b <= 172 or 174 <= _b <= 255
    _BYTE_LETTERS[_b] = _b if _shown else 256 + len([x for x in range(_b) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255)])


@lru_cache(2)
def word_encoder(path: str | None = None) -> WordEncoder:
    return WordEncoder(path)


# -- grammar


def _every_other(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """A mask of the places that stay when of a run of adjoining ones every other is left out."""
    stays = np.ones(len(at), bool)
    follows = np.flatnonzero(following[:-1] == at[1:]) + 1
    if len(follows):
        new = np.flatnonzero(np.concatenate(([True], np.diff(follows) != 1)))
        stays[follows[(follows - np.repeat(follows[new], np.diff(new, append=len(follows)))) % 2 == 0]] = False
    return stays


def _by_pair(at: np.ndarray, key: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their pairs (and then of themselves), and the pairs in order; ``key`` is used up."""
    if int(key.max(initial=0)).bit_length() + shift <= 64:  # both fit one number: sorting values beats sorting indices
        key <<= np.uint64(shift)
        key |= at.view(np.uint32)
        key.sort()
        at = (key & np.uint64((1 << shift) - 1)).astype(np.int32)
        key >>= np.uint64(shift)
        return at, key
    order = np.argsort(key, kind="stable")
    return at[order], key[order]


_NONE = np.iinfo(np.int32).max
#: While one place of so many at least is touched, rounds rewrite the sequence.
DENSE = 16


def _ranked(at: np.ndarray, left: np.ndarray, right: np.ndarray, after: np.ndarray | None, least: int, wide: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of frequent pairs in order of their ranks, these ranks, and the pairs by rank, the most frequent first.

    ``after`` links the places; without it they follow one another.
    """
    key = left.astype(np.uint64)
    key <<= np.uint64(wide)
    key |= right
    at, key = _by_pair(at, key, shift)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(starts, append=len(at))
    some = np.flatnonzero(sizes >= least)
    pair, counts = key[starts[some]], sizes[some]
    # of a run of one symbol, every other pair counts
    same = np.flatnonzero(pair >> np.uint64(wide) == pair & np.uint64((1 << wide) - 1))
    if len(same):
        ends = np.cumsum(counts[same])
        run = at[np.repeat(starts[some[same]] + counts[same] - ends, counts[same]) + np.arange(ends[-1])]
        counts[same] = np.add.reduceat(_every_other(run, run + 1 if after is None else after[run]), ends - counts[same], dtype=np.int64)
    order = np.flatnonzero(counts >= least)
    order = order[np.argsort(-counts[order], kind="stable")]
    some, sizes = some[order], sizes[some[order]]
    ends = np.cumsum(sizes)
    own = np.repeat((starts[some] - ends + sizes).astype(np.int32), sizes)
    own += np.arange(len(own), dtype=np.int32)
    return at.take(own), np.repeat(np.arange(len(order), dtype=np.int32), sizes), pair[order]


def compress(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): nonterminal ``first + i`` stands for the pair ``rules[i]``.

    A pair of old symbols never becomes more frequent, so a round counts only the places of
    pairs that were frequent in the one before, and those beside its new symbols.  While these
    are many, a round works on slices and rewrites the sequence without gaps; then symbols
    stay at their places, linked over the gaps.
    """
    sequence, rules, n_rules = np.array(ids, np.uint32), [], 0

    def replace(chosen: np.ndarray, place: np.ndarray, following: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Write new symbols at the chosen places, but for pairs that win too rarely; where they stand now."""
        nonlocal n_rules
        # neighbours that are both left are of a run of one symbol
        keep = _every_other(chosen, following)
        if not keep.all():
            chosen, place = chosen[keep], place[keep]
        used = np.bincount(place, minlength=len(pair)) >= least  # the first one always is
        if not used.all():
            keep = np.flatnonzero(used.take(place))
            chosen, place, pair = chosen.take(keep), place.take(keep), pair[used]
        rules.append(np.stack([pair >> np.uint64(wide), pair & np.uint64((1 << wide) - 1)], axis=1).astype(np.int64))
        sequence[chosen] = (first + n_rules - 1 + np.cumsum(used)).astype(np.uint32).take(place)
        n_rules += len(pair)
        return chosen

    for least in LEAST:
        n = len(sequence)
        at = np.arange(max(n - 1, 0), dtype=np.int32)
        while len(at) >= least and DENSE * len(at) >= n:
            wide = (first + n_rules).bit_length()
            left, right = (sequence[:-1], sequence[1:]) if len(at) == n - 1 else (sequence.take(at), sequence[1:].take(at))
            at, place, pair = _ranked(at, left, right, None, least, wide, n.bit_length())
            if not len(pair):
                at = at[:0]
                break
            # the rank decides between overlapping places; at the end and before the start there is none
            rank = np.full(n + 1, _NONE, np.int32)
            own = rank[1:-1]
            own[at] = place
            touched = np.zeros(n, bool)
            np.less(own, _NONE, out=touched[:-1])
            wins = own <= rank[:-2]
            wins &= own <= rank[2:]
            wins &= touched[:-1]
            chosen = np.flatnonzero(wins)
            chosen = replace(chosen, own.take(chosen), chosen + 1, pair)
            live = np.ones(n, bool)
            live[chosen + 1] = False
            live = np.flatnonzero(live)
            sequence, touched, n = sequence.take(live), touched.take(live), len(live)
            chosen -= np.arange(len(chosen))
            touched[chosen] = touched[chosen - 1] = True  # before the first symbol comes the last, which has no pair
            at = np.flatnonzero(touched[:-1]).astype(np.int32)
        if len(at) < least:
            continue
        after, before, live = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.ones(n, bool)
        sequence, rank = np.append(sequence, np.uint32(0)), np.full(n + 2, _NONE, np.int32)
        while len(at) >= least:
            wide = (first + n_rules).bit_length()
            at, place, pair = _ranked(at, sequence[at], sequence[after[at]], after, least, wide, n.bit_length())
            if not len(pair):
                break
            rank[at] = place
            at = np.sort(at)  # by place again
            place = rank[at]
            wins = (place <= rank[before[at]]) & (place <= rank[after[at]])
            rank[at] = _NONE
            chosen = at[wins]
            chosen = replace(chosen, place[wins], after[chosen], pair)
            gone = after[chosen]
            after[chosen] = after[gone]
            before[after[chosen]] = chosen
            live[gone] = False
            beside = before[chosen]
            at = np.sort(np.concatenate((at, chosen, beside[beside >= 0])))
            at = at[np.concatenate(([True], at[1:] != at[:-1])) & live[at]]
            at = at[after[at] < n]
        sequence = sequence[:n][live]
    return sequence.astype(np.int64), np.concatenate(rules) if rules else np.empty((0, 2), np.int64)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    lengths, rows = np.zeros(len(rules), np.int64), np.arange(len(rules))
    while len(rows):
        of = rules[rows]
        each = np.where(of >= first, lengths[np.maximum(of - first, 0)], 1)
        known = each.all(axis=1)
        lengths[rows[known]] = each[known].sum(axis=1)
        rows = rows[~known]
    return lengths


#: Nonterminals of so many ids at most are expanded once where symbols are many.
SHORT = 16


def expand(symbols: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids of ``symbols``.  Many symbols are copied from a row of all ids, short nonterminals and long symbols."""
    lengths = expansion_lengths(rules, first) if lengths is None else lengths
    if len(symbols) <= first + 4 * len(rules):
        return _placed(symbols, rules, first, lengths)
    short = np.flatnonzero(lengths <= SHORT)
    size, start = np.ones(first + len(rules), np.int64), np.arange(first + len(rules))
    size[first:] = lengths
    start[first + short] = first + np.cumsum(lengths[short]) - lengths[short]
    sizes, starts = size.take(symbols), start.take(symbols)
    ends = np.cumsum(sizes)
    long = np.flatnonzero((symbols >= first) & (sizes > SHORT))
    starts[long] = first + lengths[short].sum() + np.cumsum(sizes[long]) - sizes[long]
    row = np.concatenate((np.arange(first), _placed(short + first, rules, first, lengths), _placed(symbols[long], rules, first, lengths)))
    kind = np.int32 if ends[-1] + len(row) < 2**31 else np.int64
    at = np.repeat((starts - ends + sizes).astype(kind), sizes)
    at += np.arange(len(at), dtype=kind)
    return row.take(at)


def _placed(symbols: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray) -> np.ndarray:
    """The ids of ``symbols``; every nonterminal puts its two parts where they belong."""
    kind = np.int32 if len(symbols) + int(lengths.sum()) < 2**31 else np.int64
    symbols, rules, lengths = symbols.astype(kind), rules.astype(kind), lengths.astype(kind)

    def sizes(x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), kind)
        non = np.flatnonzero(x >= first)
        out[non] = lengths[x[non] - first]
        return out

    own = sizes(symbols)
    ends = np.cumsum(own, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    place = (ends - own).astype(kind if not len(ends) or ends[-1] < 2**31 else np.int64)
    while len(symbols):
        non = symbols >= first
        out[place[~non]] = symbols[~non]
        place, pairs = place[non], rules[symbols[non] - first]
        left, right = pairs[:, 0], pairs[:, 1]
        symbols, place = np.concatenate((left, right)), np.concatenate((place, place + sizes(left)))
    return out


class Shard:
    """A shard in memory, for writing or for reading ranges."""

    def __init__(self, part: int, number: int, doc_ids: list, lengths: np.ndarray, symbols: np.ndarray, rules: np.ndarray, expansions: np.ndarray, first: int):
        self.part, self.number, self.doc_ids, self.lengths = part, number, doc_ids, lengths
        self.symbols, self.rules, self.expansions, self.first = symbols, rules, expansions, first

    @classmethod
    def of(cls, part: int, number: int, doc_ids: list, texts: list[bytes], first: int) -> Shard:
        ids = np.frombuffer(b"".join(texts), "<u4")
        symbols, rules = compress(ids, first)
        return cls(part, number, doc_ids, np.array([len(t) // 4 for t in texts], np.int64), symbols, rules, expansion_lengths(rules, first), first)

    def to_bytes(self) -> bytes:
        top = int(max(self.symbols.max(initial=0), 1))
        planes = (top.bit_length() + 7) // 8
        raw = self.symbols.astype("<u4").view(np.uint8).reshape(-1, 4)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        head = _HEAD.pack(b"TOKR", self.part, self.number, len(ids), len(self.rules), len(self.symbols), self.first, int(self.lengths.sum()), planes)
        return b"".join([head, ids.tobytes(), self.lengths.astype("<i8").tobytes(), null.tobytes(), self.rules.astype("<u4").tobytes(), self.expansions.astype("<i8").tobytes(), *(raw[:, p].tobytes() for p in range(planes)), b"\n"])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, part, number, n_docs, n_rules, n_symbols, first, n_ids, planes = _HEAD.unpack_from(data)
        if magic != b"TOKR":
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, lengths, null = take("<i8", n_docs), take("<i8", n_docs), take("u1", n_docs)
        rules, expansions = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64), take("<i8", n_rules)
        raw = np.zeros((n_symbols, 4), np.uint8)
        for p in range(planes):
            raw[:, p] = take("u1", n_symbols)
        if data[at:] != b"\n" or lengths.sum() != n_ids:
            raise ValueError("damaged token shard")
        symbols = raw.view("<u4").reshape(-1).astype(np.int64)
        return cls(part, number, [None if x else int(i) for i, x in zip(ids, null, strict=True)], lengths, symbols, rules, expansions, first)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.first, self.expansions).astype("<u4")

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the shard, expanding only the symbols that cover them."""
        if end <= start:
            return np.empty(0, "<u4")
        sizes = np.where(self.symbols >= self.first, self.expansions[np.maximum(self.symbols - self.first, 0)] if len(self.rules) else 1, 1)
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
        before = int(ends[a] - sizes[a])
        return expand(self.symbols[a:b], self.rules, self.first, self.expansions)[start - before : end - before].astype("<u4")


# -- Spark


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> None:
    """Write shard files of all documents, in ascending order of ids, to ``path``."""
    first = word_encoder(vocabulary).vocabulary
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = word_encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([Shard.of(part, number, ids, texts, first).to_bytes()[:-1]], pa.binary())], names=["value"])

        for piece, _ in pieces(batches, text_col):
            found, ends = own.encode_column(piece.column(text_col).cast(pa.string()))
            found, at = memoryview(found.tobytes()), 0
            for i, stop in zip(piece.column(id_col).to_pylist(), (4 * ends).tolist(), strict=True):
                ids.append(i)
                texts.append(bytes(found[at:stop]) + end)
                size += (stop - at) // 4 + 1
                at = stop
                if size >= SHARD:
                    yield shard()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield shard()

    ordered = docs.select(id_col, text_col).repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first())
    shards = ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    shards.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


_READ = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "number", "doc_id", "local", "n_tokens", "ids_crc32")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents in the shard files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard.from_bytes(content.as_buffer().to_pybytes())
                raw = memoryview(shard.ids().tobytes())
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard.part)), pa.array(np.full(n, shard.number)), pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.lengths), pa.array(crcs, pa.int64())], names=_READ.names
                )

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")
    rows = written(files.mapInArrow(run, _READ), "token-rows")  # each file is decoded once
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("size"))
    # sums within a part, then over the parts: the last window has one row per part
    sizes = sizes.withColumn("inside", F.sum("size").over(Window.partitionBy("part").orderBy("number")) - F.col("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    starts = sizes.join(parts, "part").select("part", "number", (F.col("before") + F.col("inside")).alias("offset"))
    return rows.join(starts, ["part", "number"]).select("doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write all documents to shard files in the shared folder and read those back."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, path, id_col, text_col, vocabulary)
    return read(docs.sparkSession, path)
