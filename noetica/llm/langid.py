"""Language identification by hyperdimensional profiles.

Every letter gets a random vector of DIMENSIONS signs, made from a hash of its code
point.  The vector of an n-gram of three characters is the product of its letters'
vectors, each rotated by its place (binding); a text's vector is the sum of its n-grams'
vectors (bundling); a language's prototype is the sum over its training texts.  A text
gets the language whose prototype has the largest cosine with it.

Texts are lower-cased; each run of other characters than letters counts as one blank, and
blanks frame the text.  Learning sums n-gram counts per language in every partition and
bundles them there, so what is shuffled is one vector per language and partition.  One
vector per language comes to the driver and to every task: at most MAX_LANGUAGES of them
(there are some 8,000 languages); labels with more values than that are no languages and
raise an error before anything is collected.

Cases: a null text, or one without letters, gets ``und`` and score 0, as do all texts if
nothing can be learned.  Ties go to the language that sorts first.  Repeated rows count
repeatedly in learning and get equal predictions.  Very long texts are worked on in
blocks.  An empty table gives an empty result.  Only id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

DIMENSIONS = 512
UNKNOWN = "und"
#: Bound of the prototypes that are collected, 4 kB each.
MAX_LANGUAGES = 20_000
#: N-gram vectors that a worker holds at most; beyond it, it starts anew.
HELD = 60_000
#: Letters worked on at once.
BLOCK = 1 << 20

_BLANK = 32
_MASK = (1 << 21) - 1


@cache
def _letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letter_vector(point: int) -> np.ndarray:
    return np.random.default_rng(point).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1


class Vectors:
    """Vectors of n-grams, made when first met."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.codes, self.place = np.empty(0, np.int64), np.empty(0, np.int64)  # sorted codes and their rows
        self.rows = np.empty((1024, DIMENSIONS), np.float32)

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = _letter_vector(point)
        return self.letters[point]

    def at(self, grams: np.ndarray) -> np.ndarray:
        """The rows of distinct n-gram codes."""
        known = np.searchsorted(self.codes, grams)
        new = grams[self.codes[np.minimum(known, len(self.codes) - 1)] != grams] if len(self.codes) else grams
        if len(new):
            if len(self.codes) and len(self.codes) + len(new) > HELD:
                self.clear()
                new = grams
            first = len(self.codes)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            for k, g in enumerate(new.tolist(), first):
                a, b, c = g >> 42, (g >> 21) & _MASK, g & _MASK
                self.rows[k] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            codes = np.concatenate([self.codes, new])
            order = np.argsort(codes)
            self.codes, self.place = codes[order], np.concatenate([self.place, np.arange(first, first + len(new))])[order]
            known = np.searchsorted(self.codes, grams)
        return self.place[known]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIMENSIONS)
        weights = counts.astype(np.float32)
        for at in range(0, len(grams), 256):
            place = self.at(grams[at : at + 256])  # may renew the rows
            total += weights[at : at + 256] @ self.rows[place]
        return total


_vectors: Vectors | None = None


def vectors() -> Vectors:
    global _vectors
    if _vectors is None:
        _vectors = Vectors()
    return _vectors


def grams(text: str | None) -> np.ndarray:
    """Codes of the n-grams of a text, in order; empty if it has no letter."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, _BLANK)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as the blank
    points = np.concatenate(([_BLANK], points[keep], [_BLANK])).astype(np.int64)
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(text), return_counts=True)


_LEARNED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of the languages, from all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, np.ndarray] = {}
        own, size = Vectors(), 0

        def bundle() -> None:
            for lang, codes in held.items():
                sums[lang] = sums.get(lang, 0) + own.bundle(*np.unique(np.concatenate(codes), return_counts=True))
            held.clear()

        for part, texts in pieces(batches, text_col):
            for text, lang in zip(texts, part.column(lang_col).to_pylist(), strict=True):
                found = grams(text)
                if len(found):
                    held.setdefault(lang, []).append(found)
                    size += len(found)
                if size > 4 * BLOCK:
                    bundle()
                    size = 0
                if len(sums) + len(held) > MAX_LANGUAGES:
                    raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
        bundle()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    parts = labelled.select(text_col, lang_col).where(F.col(lang_col).isNotNull()).mapInArrow(run, _LEARNED)
    each = parts.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = each.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vector")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    return {r["lang"]: np.array(r["vector"]) for r in rows}


def predict(text: str | None, langs: list[str], unit: np.ndarray) -> tuple[str, float]:
    """Language and cosine (negative ones count as 0); ``unit`` has normed prototypes by row."""
    codes, counts = counted(text)
    if not len(codes) or not langs:
        return UNKNOWN, 0.0
    own = vectors().bundle(codes, counts)
    size = np.sqrt(own @ own)
    if size == 0:
        return langs[0], 0.0
    cosines = unit @ own / size
    best = int(np.argmax(cosines))
    return langs[best], float(np.clip(cosines[best], 0, 1))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, ``lang_pred`` and ``score`` for each row."""
    langs = sorted(prototypes)
    unit = np.array([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in langs])
    out = [docs.schema[id_col], *(docs.schema[c] for c in keep)]
    schema = T.StructType([*out, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text_col):
            found = [predict(t, langs, unit) for t in texts]
            arrays = [part.column(f.name) for f in out]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=schema.names)

    return docs.select(id_col, *keep, text_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
