"""Line-first quality rules.

Each line is judged by itself: it fails if it does not end like a sentence (but a long line
with a sentence's end inside is prose that was cut off), looks like navigation (marks
instead of words), shouts, is boilerplate (phrases, as whole words, make up
MIN_PHRASE_PERCENT of its words), or repeats an earlier line of its document.  Failed lines
are removed; a document that loses more than ``MAX_LOST_PERCENT`` of its word characters is
rejected.  Base rules on the whole text
(too few words, too many repeated three-word windows) reject before that.

Cases: a null text has no words and is rejected by the base rule (no words); so is an
empty text.  Lines without a word are neither judged nor counted.  A row is judged by its
own text alone, so ties and repeated rows get equal verdicts and an empty table gives an
empty result; a very long text is judged as a whole, in time linear in its lines.  Only ``text`` is read; other columns, whatever their names, pass through
``clean`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SPACES, pieces, sql_literal

#: Base rule: fewer words reject a document.
MIN_WORDS = 50
#: Base rule: a larger share of words in repeated three-word windows rejects it.
MAX_REPEAT_PERCENT = 50
#: The method's rule: a larger share of word characters in removed lines rejects it.
MAX_LOST_PERCENT = 50
#: A line with more marks than this share of its words is navigation.
MAX_MARK_PERCENT = 20
#: A line with more exclamation marks than this share of its words shouts.
MAX_EXCLAIM_PERCENT = 25
SYMBOLS = "#*$%&|<>"
#: How a sentence may end.
ENDS = (".", "!", "?", '"', "'", ")", ":", ";", "…", "”", "’", "»")
#: A line of so many words may end anyhow if a sentence ends inside it.
PROSE_WORDS = 20
#: Footers, consent notices and navigation of web pages, in the languages of the corpus.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
    "enable javascript", "click here", "read more", "sign up", "log in", "subscribe to", "share this", "skip to content",
    "back to top", "lorem ipsum",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutz", "verwendet cookies", "javascript aktivieren", "hier klicken",
    "weiterlesen", "jetzt anmelden", "newsletter abonnieren", "zum inhalt springen", "zum seitenanfang",
    "tous droits réservés", "conditions d'utilisation", "mentions légales", "politique des cookies", "utilise des cookies", "activer javascript",
    "cliquez ici", "lire la suite", "en savoir plus", "se connecter", "s'inscrire", "aller au contenu", "retour en haut",
    "todos los derechos reservados", "condiciones de uso", "aviso legal", "política de privacidad", "utiliza cookies", "habilitar javascript",
    "haga clic", "leer más", "iniciar sesión", "saltar al contenido", "volver arriba",
)

#: A line with such a share of its words in boilerplate phrases is boilerplate.
MIN_PHRASE_PERCENT = 25

#: Whole words: a boundary lies between an ASCII letter, digit or underscore and anything else.
_PHRASES = rf"\b(?:{'|'.join(BOILERPLATE)})\b"
_UPPER_BYTES = bytes(range(65, 91))
_LETTER_BYTES = _UPPER_BYTES + bytes(range(97, 123))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _ascii_letters(line: bytes) -> tuple[int, int]:
    """Counts of A-Z, and of A-Z and a-z."""
    n = len(line)
    return n - len(line.translate(None, _UPPER_BYTES)), n - len(line.translate(None, _LETTER_BYTES))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in three-word windows found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, count()), np.int64, n)
    # ids are below n, so two fit one 64-bit key; the third word joins by the pair's own id
    _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    key = pair[:-1] * np.int64(n) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] = hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def line_fails(line: bytes, n_words: int) -> bool:
    """Whether a line with words, not seen before in its document, breaks a rule."""
    bare = line.strip()
    if not bare.endswith(_ENDS) and not (n_words >= PROSE_WORDS and _INNER_END.search(bare)):
        return True
    marks = sum(map(bare.count, _MARKS))
    if marks * 100 > MAX_MARK_PERCENT * n_words:
        return True
    if bare.count(b"!") * 100 > MAX_EXCLAIM_PERCENT * n_words and n_words > 3:
        return True
    upper, letters = _ascii_letters(bare)
    if letters > 20 and 2 * upper > letters:
        return True
    lower = bare.translate(_LOWER)
    return sum(p.count(b" ") + 1 for p in _PHRASE_BYTES.findall(lower)) * 100 >= MIN_PHRASE_PERCENT * n_words


_ENDS = tuple(e.encode() for e in ENDS)
_INNER_END = re.compile(rb"[.!?] ")
_MARKS = [s.encode() for s in SYMBOLS]
_PHRASE_BYTES = re.compile(_PHRASES.encode())


def judge(text: str | None) -> tuple[tuple, bytes]:
    """The digest of one text, and the text without its failed lines (UTF-8)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    word_chars = len(text or "") - sum(map((text or "").count, SPACES))
    n_symbols = sum(map(raw.count, _MARKS))
    seen: set[bytes] = set()
    kept_lines, n_dup, n_lines, lost, lines_out = [], 0, 0, 0, 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            kept_lines.append(line)
            continue
        n_lines += 1
        dup = line in seen
        n_dup += dup
        seen.add(line)
        if dup or line_fails(line, len(own)):
            lines_out += 1
            lost += sum(len(w) - _continuations(w) for w in own)
        else:
            kept_lines.append(line)
    n_repeat = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    kept = not failed and 100 * lost <= MAX_LOST_PERCENT * word_chars
    return (n_words, word_chars, n_symbols, n_dup, n_repeat, failed, kept, n_lines, lines_out, lost), b"\n".join(kept_lines)


_CONTINUATION = bytes(range(0x80, 0xC0))


def _continuations(word: bytes) -> int:
    return 0 if word.isascii() else len(word) - len(word.translate(None, _CONTINUATION))


DIGEST = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_lines_removed", "chars_removed")]
)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the digest of each row."""
    schema = T.StructType([docs.schema[id_col], *DIGEST.fields])
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text_col):
            columns = zip(*(judge(t)[0] for t in texts), strict=True)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *arrays], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows that pass, with failed lines taken out of ``text_col``; all columns stay."""
    chars = chars_col if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, text_col):
            keep, new = [], []
            for i, text in enumerate(texts):
                digest, cleaned = judge(text)
                if digest[6]:
                    keep.append(i)
                    new.append(cleaned.decode("utf-8", "surrogatepass"))
            part = part.take(pa.array(keep, pa.int32()))
            part = part.set_column(part.schema.get_field_index(text_col), part.schema.field(text_col), pa.array(new, part.schema.field(text_col).type))
            if chars:
                at = part.schema.field(chars)
                part = part.set_column(part.schema.get_field_index(chars), at, pa.array(list(map(len, new)), at.type))
            yield part

    return docs.mapInArrow(run, docs.schema)


_SPACE_CLASS = r"[\x20\x09-\x0D]"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _count_sql(x: str, characters: str) -> str:
    """How many characters of a class a DuckDB string has."""
    return f"(length({x}) - length(regexp_replace({x}, {sql_literal(characters)}, '', 'g')))"


_MARK_CLASS = f"[{re.escape(SYMBOLS)}]"
_END_CLASS = f"[{re.escape(''.join(ENDS))}]$"
_FAILS = f"""
  (not regexp_matches(bare, {sql_literal(_END_CLASS)}) and not (n >= {PROSE_WORDS} and regexp_matches(bare, '[.!?] ')))
  or {_count_sql("bare", _MARK_CLASS)} * 100 > {MAX_MARK_PERCENT} * n
  or ({_count_sql("bare", "!")} * 100 > {MAX_EXCLAIM_PERCENT} * n and n > 3)
  or ({_count_sql("bare", "[A-Za-z]")} > 20 and 2 * {_count_sql("bare", "[A-Z]")} > {_count_sql("bare", "[A-Za-z]")})
  or coalesce(list_sum(list_transform(regexp_extract_all(translate(bare, '{_LETTERS}', '{_LETTERS.lower()}'), {sql_literal(_PHRASES)}), lambda p: length(p) - length(replace(p, ' ', '')) + 1)), 0) * 100 >= {MIN_PHRASE_PERCENT} * n"""
#: DuckDB SQL for ``verdicts`` over ``documents``; ids are taken to be unique.
ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
spoken as (select doc_id, unnest(string_split(x, chr(10))) line, generate_subscripts(string_split(x, chr(10)), 1) i from d),
lines as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) n, regexp_replace(line, '^{_SPACE_CLASS}+|{_SPACE_CLASS}+$', '', 'g') bare from spoken),
seen as (select *, row_number() over (partition by doc_id, line order by i) > 1 dup from lines where n > 0),
judged as (select doc_id, dup, length(regexp_replace(line, '{_SPACE_CLASS}', '', 'g')) chars, dup or {_FAILS} out from seen),
by_line as (select doc_id, count(*) n_lines, count(*) filter (dup) n_dup, count(*) filter (out) n_out, coalesce(sum(chars) filter (out), 0) lost from judged group by doc_id),
windows as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] win from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d)),
again as (select doc_id, i from windows qualify count(*) over (partition by doc_id, win) > 1),
repeated as (select doc_id, count(distinct i + k) n from again, range(0, 3) t(k) group by doc_id),
base as (
  select d.doc_id, len(w)::bigint n_words, length(regexp_replace(x, '{_SPACE_CLASS}', '', 'g'))::bigint word_chars, {_count_sql("x", _MARK_CLASS)}::bigint n_symbols,
    coalesce(n_dup, 0)::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_out, 0)::bigint n_lines_removed, coalesce(lost, 0)::bigint chars_removed
  from d left join by_line using (doc_id) left join repeated r using (doc_id)),
failed as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from base)
select *, not base_failed and 100 * chars_removed <= {MAX_LOST_PERCENT} * word_chars kept from failed
"""
