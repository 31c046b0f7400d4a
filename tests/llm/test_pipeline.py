"""The pipeline's rows against the stages in plain Python."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from noetica.llm import bpe, mixing, quality
from tests.llm.test_operators import WORDS, brute_components, brute_fingerprint, brute_quality


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeats", "mix", "tokens"]


def brute_clean(text):
    """The text without its failed lines, or None if the document goes."""
    text = text or ""
    n_words, chars, *_, failed = brute_quality(text)
    if failed:
        return None
    kept, seen, lost = [], set(), 0
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            kept.append(line)
            continue
        bare, n = line.strip(" \t\n\x0b\x0c\r"), len(words)
        ends = any(bare.endswith(e) for e in quality.ENDS) or (n >= 20 and re.search("[.!?] ", bare))
        letters = re.findall("[A-Za-z]", bare)
        bad = line in seen or not ends or 100 * sum(c in "#*$%&|<>" for c in bare) > 20 * n or (100 * bare.count("!") > 25 * n and n > 3)
        bad = bad or (len(letters) > 20 and 2 * sum(c.isupper() for c in letters) > len(letters))
        found = [p for p in quality.BOILERPLATE for _ in re.findall(rf"(?a)\b{p}\b", bare.lower())]
        bad = bad or (bool(found) and 100 * sum(len(p.split(" ")) for p in found) >= 25 * n)
        seen.add(line)
        if bad:
            lost += sum(map(len, words))
        else:
            kept.append(line)
    return "\n".join(kept) if 100 * lost <= 50 * chars else None


def brute_repeats(texts):
    """Texts by id without the characters that lie wholly in repeated 100-byte strings."""
    seen, out = set(), {}
    for i, text in sorted(texts.items()):
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept, at = [], 0
        for c in text:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out[i] = "".join(kept)
    return out


def brute_copies(texts, source_of):
    """How often each document is repeated."""
    mass = Counter()
    for i, t in texts.items():
        mass[source_of[i]] += len(t)
    mass = {s: m for s, m in mass.items() if m}
    weights = {s: m**mixing.ALPHA for s, m in mass.items()}
    out = {}
    for i in texts:
        s = source_of[i]
        if s not in mass:
            continue
        rate = weights[s] / sum(weights.values()) * sum(mass.values()) / mass[s]
        parts = math.ceil(rate / mixing.CHUNK)
        n = 0
        for part in range(1, parts + 1):
            x = (int(hashlib.md5(f"{mixing.SEED}|{i}|{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            k, term = 0, math.exp(-rate / parts)
            total = term
            while total < x:
                k += 1
                term *= rate / parts / k
                total += term
            n += k
        out[i] = n
    return out


def test_pipeline_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    sentence = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n)) + "."
    shared = sentence(40)
    texts = ["\n".join(sentence(12) for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    texts += [texts[i] for i in range(10)] + [texts[i] + "\n" + sentence(9) for i in range(10, 20)] + ["too short", None, "", "Home | " * 90]
    texts += ["\n".join([sentence(20), shared, sentence(20), "Click here.", "All rights reserved.", "NO LINE SHOULD SHOUT LIKE THIS ONE HERE.", sentence(20), "Menu"]) for _ in range(8)]
    source_of = {i: f"s{i % 3 if i % 5 else 0}" for i in range(len(texts))}
    rows = [(i, t, "en", source_of[i], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    clean = {i: c for i, t in enumerate(texts) if (c := brute_clean(t)) is not None}
    assert 60 < len(clean) < len(texts) and any(clean[i] != texts[i] for i in clean)
    fps = {i: brute_fingerprint(t) for i, t in clean.items()}
    stay = {i: clean[i] for i, c in brute_components(list(clean), fps).items() if i == c}
    assert len(stay) <= len(clean) - 10
    left = brute_repeats(stay)
    assert sum(map(len, left.values())) < sum(map(len, stay.values()))
    copies = brute_copies(left, source_of)
    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, n in copies.items():
        ids = library.encode_ordinary(left[i])
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(left[i].encode()).hexdigest()] = n
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == +want


def test_stages_take_odd_tables(spark):
    """Every stage on an empty table, on nulls in any column, and with clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _spans string, fp string, copy string"
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None, None), (1, "", "en", None, 0, "a", "b", "c", "d"), (1, "x " * 60 + ".", None, "s", None, "e", "f", "g", "h"), (1, "x " * 60 + ".", None, "s", None, "e", "f", "g", "h")], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0
        got = stage(spark, odd, "")
        assert name == "tokens" or got.columns == odd.columns
        got.collect()
