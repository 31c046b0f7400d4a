"""Text functions of ingestion and entity resolution, as column expressions where Spark can."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates tokens: ASCII punctuation, white space, and the bullet.
SEPARATORS = r"[\p{Punct}\s•]+"
ATEXT = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+$"
#: Providers whose addresses say nothing about an organisation, and throw-away ones.
FREE_DOMAINS = ("gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com", "aol.com", "gmx.de", "gmx.net", "web.de", "orange.fr", "free.fr", "laposte.net", "icloud.com", "me.com", "mail.ru", "protonmail.com")
DISPOSABLE_DOMAINS = ("mailinator.com", "guerrillamail.com", "10minutemail.com", "yopmail.com", "trashmail.com", "tempmail.com", "dispostable.com")


def _stripped(x: str | None) -> str | None:
    return None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _strip_marks(x: pd.Series) -> pd.Series:
    return x.map(_stripped, na_action="ignore")


def strip_accents(x: Column) -> Column:
    """Canonical decomposition without its combining marks."""
    return _strip_marks(x)


def normalise(x: Column) -> Column:
    return F.lower(strip_accents(x))


def plain_spaces(x: Column) -> Column:
    """Every white-space character becomes one blank; runs keep their length."""
    return F.regexp_replace(x, r"\s", " ")


def unquote_text(x: str | None) -> str | None:
    """Matching quotes around a text are taken off, again and again."""
    while x is not None and len(x) >= 2 and x[0] == x[-1] and x[0] in "\"'":
        x = x[1:-1]
    return x


@F.pandas_udf(T.StringType())
def unquote(x: pd.Series) -> pd.Series:
    return x.map(unquote_text, na_action="ignore")


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, SEPARATORS), lambda t: t != "")


def tokens_and_separators(x: Column) -> Column:
    """``(is_token, text)`` in order; joined again they give the text."""
    parts = F.regexp_extract_all(x, F.lit(r"[\p{Punct}\s•]+|[^\p{Punct}\s•]+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct((~p.rlike(f"^{SEPARATORS}$")).alias("is_token"), p.alias("text")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


@lru_cache(1000)
def jaro_winkler_of(a: str, b: str, boost: float = 0.7) -> float:
    """Jaro-Winkler similarity; the common prefix counts from a Jaro of ``boost`` on."""
    if not a and not b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    reach = max(len(long_) // 2 - 1, 0)
    taken, hits = [False] * len(long_), []
    for i, c in enumerate(short):
        for j in range(max(0, i - reach), min(len(long_), i + reach + 1)):
            if not taken[j] and long_[j] == c:
                taken[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [long_[j] for j in range(len(long_)) if taken[j]]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro < boost:
        return jaro
    prefix = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + min(0.1, 1 / len(long_)) * prefix * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)])


def email_address(x: Column) -> Column:
    """``local, domain, iri`` of an address, null if it is none; the domain keeps its case."""
    bare = F.trim(x)
    at = F.length(bare) - F.instr(F.reverse(bare), "@")
    local, domain = F.substring(bare, F.lit(1), at), F.substring(bare, at + 2, F.lit(1 << 20))
    quoted = F.when(F.lower(local).rlike(ATEXT), F.lower(local)).otherwise(F.concat(F.lit('"'), F.lower(local), F.lit('"')))
    good = bare.contains("@") & (F.length(local) > 0) & (F.length(domain) > 0) & ~bare.rlike(r"(?i)^undisclosed[- ]recipients:;?")
    return F.when(good, F.struct(local.alias("local"), domain.alias("domain"), F.concat(F.lit("mailto:"), quoted, F.lit("@"), F.lower(domain)).alias("iri")))


def display_name(name: Column, address: Column) -> Column:
    """A sender's name without quotes and without its own address; blank if it is one."""
    bare = unquote(F.trim(name))
    own = F.replace(F.replace(F.replace(bare, F.concat(F.lit("("), address, F.lit(")")), F.lit("")), F.concat(F.lit("<"), address, F.lit(">")), F.lit("")), F.concat(F.lit("["), address, F.lit("]")), F.lit(""))
    own = plain_spaces(F.trim(own))
    return F.when(own.contains("@") & (levenshtein_similarity(F.lower(own), F.lower(address)) >= 0.9), "").otherwise(own)


def message_iri(x: Column) -> Column:
    """``mid:`` IRI of a message id in angle brackets, plain or percent-encoded."""
    inner = F.regexp_extract(F.trim(x), r"(?i)^(?:<|%3C)(.+?)(?:>|%3E)$", 1)
    return F.when(inner != "", F.concat(F.lit("mid:"), F.replace(F.replace(F.url_encode(inner), F.lit("%40"), F.lit("@")), F.lit("+"), F.lit("%20"))))


def phone(x: Column, country_code: str = "33") -> Column:
    """``tel:`` IRI of an international number, or of a national one of the default region."""
    digits = F.regexp_replace(x, r"[\s().-]", "")
    world = F.when(digits.rlike(r"^\+\d{6,15}$"), digits).when(digits.rlike(r"^00\d{6,15}$"), F.concat(F.lit("+"), F.substring(digits, 3, 20)))
    home = F.when(digits.rlike(r"^0[1-9]\d{8}$"), F.concat(F.lit(f"+{country_code}"), F.substring(digits, 2, 20)))
    number = F.coalesce(world, home)
    national = F.replace(number, F.lit(f"+{country_code}"), F.lit(""))
    kind = F.when(number.startswith(f"+{country_code}"), F.when(national.rlike("^[67]"), "cell").when(national.rlike("^8"), "special").otherwise("fixed")).otherwise("unknown")
    return F.when(number.isNotNull(), F.struct(F.concat(F.lit("tel:"), number).alias("iri"), kind.alias("kind")))


def uuid3(x: Column) -> Column:
    """Name UUID (version 3) of the text's bytes; a text that is a UUID stays."""
    h = F.md5(x.cast("binary"))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(F.lower(x).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(x)).otherwise(made)


def image_type(x: Column) -> Column:
    head = F.hex(F.substring(x, 1, 12))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")


#: Latin letters that Unicode does not decompose, and what they are folded to.
STROKED, PLAIN = "ĐĦŁØŦđħıłøŧ", "DHLOTdhilot"
_MARKED = [c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) > 1]
ACCENTED, FOLDED = "".join(_MARKED) + STROKED, "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED) + PLAIN
PAIRS = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th"}


def folded(x: Column) -> Column:
    """Latin letters without their marks, by the JVM alone; combining marks go too."""
    x = F.regexp_replace(F.translate(x, ACCENTED, FOLDED), r"\p{M}+", "")
    for letter, plain in PAIRS.items():
        x = F.replace(x, F.lit(letter), F.lit(plain))
    return x


def grams(x: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Distinct n-grams of the lower-cased tokens' letters and digits, accents folded."""
    words = F.filter(F.split(F.lower(folded(x)), r"[^\p{L}\p{N}]+"), lambda t: t != "")

    def cut(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(*(cut(w, n) for n in sizes)))))


def provider_kinds(emails: DataFrame, providers: DataFrame) -> DataFrame:
    """``emails`` with ``kind`` of their ``domain`` by a list of providers ``(domain, kind)``."""
    listed = providers.select(F.lower("domain").alias("_domain"), "kind").groupBy("_domain").agg(F.min("kind").alias("kind"))
    return emails.join(listed, F.lower(emails["domain"]) == listed["_domain"], "left").drop("_domain")


def provider_kind(domain: Column) -> Column:
    """By the short lists of this module; ``provider_kinds`` takes a list of any length."""
    d = F.lower(domain)
    return F.when(d.isin(*FREE_DOMAINS), "free").when(d.isin(*DISPOSABLE_DOMAINS), "disposable")


def place_hierarchy(street: Column, number: Column, locality: Column, region: Column, country: Column) -> Column:
    """Country, region, locality and street, each with the id of its path and its parent's."""
    street = F.when(street.isNotNull() & number.isNotNull(), F.concat(number, F.lit(" "), street)).otherwise(street)
    levels = [("country", country), ("region", region), ("locality", locality), ("street", street)]
    given = F.filter(F.array(*(F.struct(F.lit(name).alias("level"), value.alias("name")) for name, value in levels)), lambda s: s["name"].isNotNull())
    start = F.struct(F.lit(None).cast("string").alias("parent"), F.array().cast("array<struct<level:string,name:string,id:string,parent:string>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        # the id is bound once: an expression that held its parents' expressions would double at every use
        own = F.transform(F.array(F.concat_ws("/", a["parent"], s["level"], s["name"])), uuid3)[0]
        found = lambda x: F.struct(x.alias("parent"), F.concat(a["out"], F.array(F.struct(s["level"].alias("level"), s["name"].alias("name"), x.alias("id"), a["parent"].alias("parent")))).alias("out"))
        return F.transform(F.array(own), found)[0]

    return F.aggregate(given, start, step, lambda a: a["out"])


