"""The training-data operators against brute force, round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from noetica.llm import bpe, langid, licenses, mixing, quality, simhash, suffix_dedup, token_files, topk, warc

RND = random.Random(3)
WORDS = ["".join(RND.choice("abcdeßfgé") for _ in range(RND.randint(1, 8))) for _ in range(400)]
EDGE = [None, "", " \n\t ", "one", "one two", "a" * 500, "line\n" * 40, "x " * 3000, "Ünïcode “quotes” 你好 😀 \x1c\x85 tail"]


def sentence(n):
    return " ".join(RND.choice(WORDS) for _ in range(n)) + "."


def documents(spark, texts, first=0, **columns):
    rows = [Row(doc_id=first + i, text=t, lang="en", source=f"s{i % 3}", n_chars=len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in columns:
        df = df.withColumn(name, df.doc_id)
    return df


@pytest.fixture(scope="module")
def corpus():
    texts = [sentence(RND.randint(1, 90)) for _ in range(120)]
    for _ in range(40):
        t = RND.choice(texts[:60])
        words = t.split(" ")
        if RND.random() < 0.6:
            words[RND.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    shared = sentence(40)
    texts += [sentence(5) + "\n" + shared + "\n" + sentence(5) for _ in range(20)]
    return texts + EDGE


# -- WARC


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x\r\n\r\nWARC/1.1\r\ny", "", "only"]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, h in enumerate(html):
        payload = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (got[i].payload_bytes, got[i].record_type, got[i].refers_to) == (len(payload), "response" if i == last else "revisit", None if i == last else last)
    assert warc.round_trip(pages.limit(0)).count() == 0


def record(payload: bytes, **headers) -> bytes:
    lines = {"WARC-Type": "response", "Content-Length": str(len(payload)), "WARC-Block-Digest": "sha1:" + warc.base32_sha1(payload)} | headers
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines.items()) + b"\r\n" + payload + b"\r\n\r\n"


def salvaged(data: bytes):
    found = list(warc.salvage(data))
    return [x for x in found if isinstance(x, warc.Record)], [x for x in found if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("pack", [lambda x: x, gzip.compress])
def test_warc_salvage(pack):
    good = [pack(record(f"payload {i}".encode() * 20)) for i in range(5)]
    broken = bytearray(good[2])
    broken[len(broken) // 2] ^= 0xFF
    data = good[0] + b"junk" + good[1] + bytes(broken) + good[3] + good[4][: len(good[4]) // 2]
    records, gaps = salvaged(data)
    assert [r.block[:9] for r in records] == [b"payload 0", b"payload 1", b"payload 3"]
    assert [(g.offset, g.size) for g in gaps] == [(len(good[0]), 4), (len(good[0]) + 4 + len(good[1]), len(broken)), (len(data) - len(good[4]) // 2, len(good[4]) // 2)]
    assert salvaged(b"") == ([], []) and salvaged(b"nothing here")[1][0].size == 12


def test_warc_member_with_damaged_record():
    inner = record(b"first") + b"noise" + record(b"second")
    records, gaps = salvaged(gzip.compress(b"x" + inner))
    assert [r.block for r in records] == [b"first", b"second"] and [g.size for g in gaps] == [1, 5]
    assert salvaged(gzip.compress(b"no record"))[0] == []


def test_warc_checks_payload_digests(spark, tmp_path):
    wrong = record(b"body", **{"WARC-Payload-Digest": "sha1:" + warc.base32_sha1(b"other")})
    assert salvaged(wrong + record(b"next"))[1][0].reason == "payload digest"
    answer = record(b"body", **{"WARC-Record-ID": "<urn:x:1>", "WARC-Payload-Digest": "sha1:" + warc.base32_sha1(b"body")})
    revisit = lambda to, of: record(b"", **{"WARC-Type": "revisit", "WARC-Refers-To": to, "WARC-Payload-Digest": "sha1:" + warc.base32_sha1(of)})
    (tmp_path / "a.warc").write_bytes(answer + revisit("<urn:x:1>", b"body") + revisit("<urn:x:1>", b"else") + b"junk" + revisit("<urn:x:2>", b"body"))
    rows = warc.read(spark, str(tmp_path))
    assert warc.loose_revisits(rows).count() == 2 and rows.where("gap_bytes = 4").count() == 1 and rows.count() == 5


def test_warc_round_trip_fails_on_gaps(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    plain = warc.write
    monkeypatch.setattr(warc, "write", lambda pages, path, *a: (plain(pages, path, *a), spark.createDataFrame([("junk",)], "value string").write.mode("append").text(path)))
    with pytest.raises(Exception, match="quarantined bytes"):
        warc.round_trip(pages).collect()


# -- top-k


def test_topk_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, []), (204, [0.5]), (205, rows[0][1]), (None, rows[1][1]), (250, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    old, topk.BLOCK = topk.BLOCK, 40
    try:
        got = sorted(tuple(r) for r in topk.search(df, lambda i: i % 50 == 0).collect())
    finally:
        topk.BLOCK = old
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in ok if i % 50 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c], strict=False)), c) for c in ok if c != q))[:5]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    assert got == want


# -- SimHash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(ids, fps, bits=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_brute_force(spark, corpus):
    fps = {i: brute_fingerprint(t) for i, t in enumerate(corpus)}
    want = brute_components(list(fps), fps)
    got = simhash.near_duplicates(documents(spark, corpus, fingerprint=1, component_id=1, fp=1)).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (fps[i], want[i]) for i in fps}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash.first_of_each(documents(spark, corpus))
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == documents(spark, []).columns


@pytest.mark.parametrize("direct", [4, 60, 4096])
def test_simhash_long_lists(monkeypatch, direct):
    """A ball of near copies: the split and the flips lose no link."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng, centre = random.Random(7), 0x0123456789ABCDEF
    fps = {centre}
    for _ in range(400):
        x = rng.choice(sorted(fps)) if rng.random() < 0.5 else centre
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    u = np.array(sorted(fps), np.uint64)
    want, got = np.arange(len(u)), np.arange(len(u))
    for i, j in simhash._tiles(u):
        simhash._hook(want, i, j)
    for k, triple in enumerate(simhash.TRIPLES):
        key = u & np.uint64(sum(255 << (56 - 8 * p) for p in triple))
        order = np.argsort(key, kind="stable")
        a, b = simhash._forest(np.full(len(u), k), key[order].view(np.int64), u[order])
        simhash._hook(got, np.searchsorted(u, a), np.searchsorted(u, b))
    assert (want == got).all()


# -- mixing


def test_mixing_counts_and_columns(spark):
    texts = [sentence(20) for _ in range(300)]
    docs = documents(spark, texts, copy_no=1, rank=1)
    out = mixing.mix(docs, weights={"s0": 3.0, "s1": 1.0}, total=3 * sum(map(len, texts)), copy_col="_nth")
    assert out.columns == [*docs.columns, "_nth"]
    mass = {r.source: r.m for r in out.selectExpr("source", "length(text) m").groupBy("source").sum("m").withColumnRenamed("sum(m)", "m").collect()}
    assert set(mass) == {"s0", "s1"} and 2.5 < mass["s0"] / mass["s1"] < 3.6
    again = mixing.mix(docs, weights={"s0": 3.0, "s1": 1.0}, total=3 * sum(map(len, texts)), copy_col="_nth")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    # a mean far above CHUNK keeps its mean
    one = mixing.mix(docs.where("doc_id < 30"), weights={"s0": 1.0, "s1": 1.0, "s2": 1.0}, total=100.0 * sum(map(len, texts[:30])))
    assert 2700 < one.count() < 3300


def test_mixing_odd_rows(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, None, "x"), (None, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix(docs, total=100.0).count() > 0


# -- languages


def test_langid_held_out(spark):
    alphabets = {"aa": "abcdehilnost", "bb": "krzwvujmpygx", "cc": "éèàùçôîabels"}
    rows = []
    for i in range(300):
        lang = sorted(alphabets)[i % 3]
        rows.append((i, " ".join("".join(RND.choice(alphabets[lang]) for _ in range(RND.randint(2, 7))) for _ in range(30)), lang))
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, rows[0][1] * 50, None), (1003, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", langid.held_out())
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs.where("not held_out")), keep=("held_out",)).collect()}
    test = [(i, lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in test)
    assert sum(got[i].lang_pred == lang for i, lang in test) >= 0.95 * len(test)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1003)) and got[1002].lang_pred == rows[0][2]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def brute_vector(text):
    """Bundle of the bound, rotated letter vectors of a text, one n-gram after the other."""
    points = [32]
    for c in (text or "").lower():
        if c.isalpha():
            points.append(ord(c))
        elif points[-1] != 32:
            points.append(32)
    points.append(32)  # the frame, besides the blank that a run of other characters leaves
    total = [0.0] * langid.DIMENSIONS
    for a, b, c in zip(points, points[1:], points[2:], strict=False):
        va, vb, vc = (langid._letter_vector(p) for p in (a, b, c))
        for k in range(langid.DIMENSIONS):
            total[k] += va[k - 2] * vb[k - 1] * vc[k]
    return np.array(total)


def test_langid_brute_force(spark):
    rnd = random.Random(8)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6)))
    alphabets = {"aa": "abcdehil", "bb": "krzwvuÄmé", "cc": "你好世界éaß"}
    texts = [(i, " ".join(word(alphabets[lang]) for _ in range(6)) + rnd.choice(["", ".", "!! 12 ", "\n"]), lang) for i in range(4) for lang in alphabets]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(texts)] + [(90, "Ab1c", None), (91, "z", None), (92, "a\n\n-b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = langid.learn(docs)
    want = {lang: sum(brute_vector(t) for _, t, x in rows if x == lang) for lang in alphabets}
    assert set(learned) == set(want) and all(np.allclose(learned[x], want[x]) for x in want)
    got = {r.doc_id: r for r in langid.identify(docs, learned).collect()}
    for i, t, _ in rows:
        own = brute_vector(t)
        cosines = {x: float(own @ v / np.linalg.norm(own) / np.linalg.norm(v)) for x, v in want.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i].lang_pred == best and abs(got[i].score - max(cosines[best], 0)) < 1e-5


def test_langid_bounds_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    docs = spark.range(8).selectExpr("id doc_id", "'some text' text", "concat('l', id) lang").repartition(8)
    with pytest.raises(Exception, match="more than 3 values"):
        langid.learn(docs)


# -- suffix dedup


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_brute_force(spark, corpus):
    texts = [*corpus, "q" * 99, "q" * 100, "q" * 101, "ab" * 200, corpus[3] * 3, "z" * 300 + "y" * 200 + "z" * 300]
    docs = documents(spark, texts, start=1, end=1, _spans=1)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs.repartition(4)).collect()}
    assert got == brute_removed(list(enumerate(texts)))
    assert suffix_dedup.digests(documents(spark, [])).count() == 0


def test_suffix_dedup_repeated_ids(spark):
    t = sentence(60)
    rows = [(1, t), (1, t), (None, t), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed) for r in suffix_dedup.digests(docs).collect())
    assert got == [(False, 0), (False, len(t.encode())), (False, len(t.encode())), (True, 0)]


def test_suffix_dedup_map_side_limits(spark, monkeypatch):
    """Few surroundings sent, small segments: the same bytes are found."""
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 1)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    import pyarrow as pa

    rnd = random.Random(5)
    shared = " ".join(rnd.choice(WORDS) for _ in range(40))
    texts = [" ".join(rnd.choice(WORDS) for _ in range(30)) + shared[rnd.randint(0, 30) :] + " ".join(rnd.choice(WORDS) for _ in range(30)) for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts)], names=["_id", "text"])

    def in_order(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["bucket"])
        return [pa.RecordBatch.from_pylist(rows)] if rows else []

    parts = [batch.slice(0, 10), batch.slice(10, 10), batch.slice(20)]
    entries = [b for p in parts for b in suffix_dedup._positions(8, "text")([p])]
    status = [r for b in suffix_dedup._statuses(in_order(entries)) for r in b.to_pylist()]
    left = {i: [s["at"] for s in status if s["_id"] == i and not s["settled"]] for i in range(30)}
    cores = []
    for p in parts:
        p = p.append_column("_left", pa.array([left[i] for i in p.column("_id").to_pylist()], pa.list_(pa.int64())))
        cores += list(suffix_dedup._cores("text")([p]))
    assert sum(c.num_rows for c in cores)
    table = spark.createDataFrame(pa.Table.from_batches(cores), suffix_dedup._CORE)
    found = suffix_dedup._repeated_windows(table).collect()
    spans = [tuple(r) for r in found] + [(s["_id"], s["at"] - suffix_dedup.SPAN, s["at"] + 100) for s in status if s["settled"]]
    bytes_of = lambda rows: {(r[0], b) for r in rows for b in range(r[1], r[2])}
    monkeypatch.setattr(suffix_dedup, "FLUSH", 40)  # a core's windows in pieces
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    for n in (1, 2, 40):  # a core in one partition, or in many
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert bytes_of(suffix_dedup._repeated_windows(table).collect()) == bytes_of(found)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    out = {}
    for i, t in enumerate(texts):
        raw = t.encode()
        own = suffix_dedup.merged([{"start": a, "end": b} for k, a, b in spans if k == i], len(raw))
        out[i] = (len(raw), sum(b - a for a, b in own), len(own), hashlib.sha256(suffix_dedup._kept(raw, own)).hexdigest())
    assert out == brute_removed(list(enumerate(texts)))


def test_suffix_dedup_remove_keeps_text(spark):
    t = "é" * 200
    docs = documents(spark, [t, "x" + t, None])
    out = {r.doc_id: r for r in suffix_dedup.remove(docs).collect()}
    assert out[1].text == "x" or out[1].text.startswith("x")
    assert out[2].text is None and out[0].n_chars == len(out[0].text)


# -- BPE


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, corpus, reference):
    rnd, letters = random.Random(1), "abcdeéßthon  \n\t'sSllveRE.,!?0123你好😀 \x1c\x85　"
    texts = [*corpus, "".join(rnd.choice(letters) for _ in range(4000)), " " * 300 + "x", "-" * 200, "I'll we've 'LL ''s"]
    got = {r.doc_id: r for r in bpe.digests(documents(spark, texts, n_tokens=1)).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    rows = bpe.detokenize(bpe.tokenize(documents(spark, texts))).collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in rows)


def test_bpe_appends_and_edits(reference):
    own, text = bpe.encoder(), b"thereupon-internationalisation" * 12
    table = bpe.Prefixes(own, text[:50])
    table.append(text[50:])
    assert table.ids() == bpe.Prefixes(own, text).ids()
    renewed = table.replace(100, 104, b"QQ")
    assert table.ids() == bpe.Prefixes(own, bytes(table.data)).ids() and renewed < len(table.data)


# -- token files


def test_token_files_equal_library(spark, corpus):
    texts = [*corpus, "".join(random.Random(2).choice("abcdeéßthon  \n\t'sSllveRE.,!?0123你好😀 ΣσİǅÅ") for _ in range(3000))]
    tokenizer = token_files.word_encoder().tokenizer
    got = {r.doc_id: r for r in token_files.round_trip(documents(spark, texts, start=1, part=1)).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.round_trip(documents(spark, [])).count() == 0


@pytest.mark.parametrize("ids", [np.zeros(5000, "<u4"), np.tile(np.arange(7), 900), np.random.default_rng(0).integers(0, 40, 20000), np.empty(0, int)])
def test_grammar_round_trip(ids):
    shard = token_files.Shard.of(0, 0, [None, 2], [np.asarray(ids, "<u4").tobytes(), b""], 50_000)
    back = token_files.Shard.from_bytes(shard.to_bytes())
    assert (back.ids() == ids).all() and back.doc_ids == [None, 2]
    rnd = random.Random(1)
    for _ in range(30 if len(ids) else 0):
        a = rnd.randrange(len(ids))
        b = rnd.randint(a, len(ids))
        assert (back.read(a, b) == ids[a:b]).all()


def test_grammar_until_no_pair_occurs_twice():
    rnd = np.random.default_rng(1)
    passage = rnd.permutation(300)  # each copy becomes one symbol, though there are only three
    ids = np.concatenate([np.concatenate((rnd.permutation(600) + 1000 * k, passage)) for k in range(1, 4)])
    symbols, rules = token_files.compress(ids, 50_000)
    lengths = token_files.expansion_lengths(rules, 50_000)
    assert lengths.max() == 300 and (symbols == 50_000 + lengths.argmax()).sum() == 3
    for ids in (ids, rnd.integers(0, 40, 20_000), np.zeros(5000, int), np.repeat(rnd.integers(0, 5, 3000), rnd.integers(1, 6, 3000))):
        symbols, rules = token_files.compress(ids, 50_000)
        assert (token_files.expand(symbols, rules, 50_000) == ids).all()
        seen = {}
        for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist(), strict=False)):
            assert i - seen.setdefault(pair, i) <= 1  # only within a run of three


def plain_grammar(ids, first):
    """Rounds over whole lists: every pair is counted anew, and the sequence is rewritten."""
    seq, rules = [int(i) for i in ids], []

    def every_other(at):
        kept = []
        for i in at:
            if not (kept and kept[-1] == i - 1):
                kept.append(i)
        return kept

    for least in token_files.LEAST:
        while True:
            pairs = list(zip(seq, seq[1:], strict=False))
            places = {}
            for i, pair in enumerate(pairs):
                places.setdefault(pair, []).append(i)
            counts = {p: len(every_other(at) if p[0] == p[1] else at) for p, at in places.items()}
            ranked = sorted((p for p in counts if counts[p] >= least), key=lambda p: (-counts[p], p))
            if not ranked:
                break
            rank = {p: r for r, p in enumerate(ranked)}
            own = [rank.get(p, len(rank)) for p in pairs]
            chosen = every_other([i for i, r in enumerate(own) if r < len(rank) and r <= min(own[max(i - 1, 0) : i + 2])])
            wins = Counter(own[i] for i in chosen)
            new = {r: first + len(rules) + k for k, r in enumerate(sorted(r for r in wins if wins[r] >= least))}
            rules += [ranked[r] for r in new]
            put = {i: new[own[i]] for i in chosen if own[i] in new}
            seq = [put.get(i, x) for i, x in enumerate(seq) if i - 1 not in put]
    return seq, rules


@pytest.mark.parametrize("dense", [1, 16, 10**9])
def test_grammar_equals_plain_rounds(monkeypatch, dense):
    """Rounds on slices and on linked places give the rules and symbols of plain ones."""
    monkeypatch.setattr(token_files, "DENSE", dense)
    rnd = np.random.default_rng(4)
    runs = np.repeat(rnd.integers(0, 5, 1500), rnd.integers(1, 9, 1500))
    for ids in (np.empty(0, int), [7], [7, 7], np.zeros(999, int), runs, rnd.integers(0, 30, 4000), np.tile(rnd.permutation(200), 12), np.minimum(rnd.zipf(1.3, 6000), 500)):
        for first in (50_000, 2**31 - 10**5):  # pairs and places in one number, and not
            symbols, rules = token_files.compress(np.asarray(ids), first)
            assert (symbols.tolist(), [tuple(r) for r in rules.tolist()]) == plain_grammar(ids, first)


def test_expand_copies_many_symbols():
    """Symbols far more than rules and ids are copied from short nonterminals expanded once; the long ones are placed."""
    rnd = np.random.default_rng(6)
    passage = rnd.integers(0, 50, 300)
    ids = np.concatenate([x for _ in range(20) for x in (rnd.integers(0, 50, 400), passage)])
    symbols, rules = token_files.compress(ids, 50)
    lengths = token_files.expansion_lengths(rules, 50)
    assert lengths.max() > token_files.SHORT
    symbols = np.tile(symbols, 2 * len(rules))
    assert len(symbols) > 50 + 4 * len(rules)
    assert (token_files.expand(symbols, rules, 50, lengths) == np.tile(ids, 2 * len(rules))).all()


def test_grammar_costs_some_sorts():
    """CPU time of 2^20 ids by that of sorting as many numbers: 30 to 41 with links in every round, 12 to 16 on slices."""

    def seconds(f, *args):
        best = float("inf")
        for _ in range(4):
            began = time.process_time()
            f(*args)
            best = min(best, time.process_time() - began)
        return best

    rnd = np.random.default_rng(7)
    words = [rnd.integers(0, 40_000, k) for k in rnd.integers(1, 6, 30_000)]
    ids = np.concatenate([words[i] for i in np.minimum(rnd.zipf(1.3, 400_000) - 1, 29_999)])[: 1 << 20]
    assert seconds(token_files.compress, ids, 50_000) < 24 * seconds(np.sort, rnd.integers(0, 1 << 60, 1 << 20, dtype=np.uint64))


# -- quality


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, repeat = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, n < 50 or 100 * repeat > 50 * n


def test_quality_base_brute_force(spark, corpus):
    texts = [*corpus, "a b c " * 40, "# | <b> & $5 50% *"]
    got = {r.doc_id: r for r in quality.verdicts(documents(spark, texts, kept=1, n_words=1)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
        assert not (r.base_failed and r.kept)


def test_quality_lines(spark):
    prose = "\n".join(sentence(15) for _ in range(8))
    menu = "Home | About | Contact | Login"
    docs = documents(spark, [prose, prose + "\n" + menu + "\nAll rights reserved.", "\n".join([menu] * 3 + [" ".join(WORDS[:60])])])
    out = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert set(out) == {0, 1} and out[0].text == prose and out[1].text == prose and out[1].n_chars == len(prose)


def test_quality_phrases_in_prose(spark):
    prose = [" ".join(sentence(14) for _ in range(12)) for _ in range(3)]
    clean = [f"{prose[0]} They log in and sign up to read more books.", f"{prose[1]} A catalog in the backlog infers a design upstream.", f"{prose[2]} Blog in Rome."]
    footer = ["All rights reserved.", "Click here to read more about our offers.", "“Sign up”, or log in!"]
    kept = {r.doc_id: r.text for r in quality.clean(documents(spark, [*clean, "\n".join([prose[0], *footer])])).collect()}
    assert kept == {**dict(enumerate(clean)), 3: prose[0]}
    assert not quality.line_fails(b"The blog in Rome.", 4) and quality.line_fails(b"The log in page.", 4)
    for phrase in quality.BOILERPLATE:
        n = len(phrase.split())
        assert quality.line_fails(f"{phrase.capitalize()}.".encode(), n) and not quality.line_fails(f"{phrase} {'word ' * 3 * n}more.".encode(), 4 * n + 1)


# -- licences


def brute_places(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses_base_brute_force(spark, corpus):
    texts = [*corpus, "Licensed under CC BY-NC 4.0.", "x under the MIT license, under the mit license", "Apache License, Version 2.0", "cc by nc cc by nc"]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, texts, labels=1, score=1)).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute_places(t)
        assert 0 <= got[i].score <= 1 and set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))


def test_licenses_templates():
    own = licenses.scanner()
    gpl = own.scan("intro words This work is licensed under the GNU General Public License, version 3. more")
    assert "gpl-3.0" in gpl[5].split(",") and gpl[6] == 1.0
    mit = licenses.TEMPLATES["mit"][1]
    assert "mit" in own.scan("foo " + mit.replace("without restriction", "without any restriction") + " bar")[5].split(",")
    assert own.scan("the license of the work is unknown")[5] == ""


_HEADER = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."


@pytest.mark.parametrize(
    "text, labels",
    [
        (_HEADER.format("", 2), "gpl-2.0"),
        (_HEADER.format("", 3), "gpl-3.0"),
        (_HEADER.format("", 1), ""),
        (_HEADER.format("Affero ", 3), "agpl-3.0"),
        (_HEADER.format("Lesser ", "2.1"), "lgpl-2.1"),
        (_HEADER.format("Lesser ", 3), "lgpl-3.0"),
        (_HEADER.format("Library ", 2), ""),
        (_HEADER.format("", 3).replace("program is", "program, called x, is").replace("either", "in either"), "gpl-3.0"),
        ("You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation", "lgpl-2.1"),
        ("You can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "gpl-2.0"),
        *((f"Licensed under the GNU {name}General Public License, version {v}.", label) for name, v, label in [("", 3, "gpl-3.0"), ("", 2, "gpl-2.0"), ("Affero ", 3, "agpl-3.0"), ("Lesser ", 3, "lgpl-3.0"), ("Lesser ", "2.1", "lgpl-2.1")]),
        *((_CC.format(x), label) for x, label in [("", "cc-by-4.0"), ("-NonCommercial", "cc-by-nc"), ("-ShareAlike", "cc-by-sa-4.0"), ("-NoDerivatives", "cc-by-nd-4.0"), ("-NonCommercial-ShareAlike", "cc-by-nc-sa-4.0"), ("-NonCommercial-NoDerivatives", "cc-by-nc-nd-4.0")]),
        ("Licensed under CC BY-ND 4.0.", "cc-by-nd-4.0"),
    ],
)
def test_licenses_told_apart(text, labels):
    assert licenses.scanner().scan(f"# {text} Other words.")[5] == labels


@pytest.mark.parametrize("label", ["bsd-2-clause", "bsd-3-clause", "mit", "isc", "0bsd", "zlib", "apache-2", "mpl-2.0"])
def test_licenses_whole_texts(label):
    text = max(licenses.TEMPLATES[label], key=len)
    found = licenses.scanner().scan(f"/* Copyright (c) 2020 Someone. All rights reserved.\n{text.replace('. ', '.' + chr(10) + ' * ')}\n*/ int main() {{}}")
    assert (found[5], found[6]) == (label, 1.0)


def brute_spans(own, text_words):
    """Best chain of each template by listing every chain of every match."""
    templates = [[w for i in t for w, j in own.ids.items() if j == i] for t in own.templates]
    parts = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    longest = [max((n for n in range(1, k + 1) if tuple(text_words[k - n : k]) in parts), default=0) for k in range(1, len(text_words) + 1)] + [0]
    matches = [(k + 1 - n, n) for k, n in enumerate(longest[:-1]) if n >= own.least and longest[k + 1] <= n]
    out = {}
    for k, t in enumerate(templates):
        telling = lambda ws: sum(w in licenses.NAMES or bool(licenses.VERSION.fullmatch(w)) for w in ws)
        states = any(licenses.VERSION.fullmatch(w) for w in t)
        places = [(a, e - n, n) for a, n in matches if n >= min(licenses.MIN_MATCH, len(t)) for e in range(n, len(t) + 1) if t[e - n : e] == text_words[a : a + n]]
        best = None

        def grow(chain, whole, covered, k=k, t=t, places=places, states=states, telling=telling):
            nonlocal best
            a, e, n = chain[-1]
            full = whole and telling(t[e + n :]) == 0
            good = (full and covered >= licenses.MIN_COVER * len(t), covered)
            if best is None or good > best[0]:
                best = (good, full)
            for b, e2, n2 in places:
                gap = text_words[a + n : b]
                if 0 <= b - a - n <= licenses.MAX_GAP and 0 <= e2 - e - n <= licenses.MAX_GAP and telling(t[e + n : e2]) == 0 and not any(w in licenses.NAMES or (states and licenses.VERSION.fullmatch(w)) for w in gap):
                    grow([*chain, (b, e2, n2)], whole, covered + n2)

        for place in places:
            grow([place], telling(t[: place[1]]) == 0, place[2])
        if best:
            out[k] = (best[0][0], best[0][1] / len(t))
    return out


def test_licenses_chains_brute_force(monkeypatch):
    monkeypatch.setattr(licenses, "MAX_GAP", 3)
    rnd = random.Random(6)
    some = ["a", "b", "c", "d", "lesser", "2", "v3"]
    for _ in range(60):
        templates = {f"l{i}": (" ".join(rnd.choice(some[: rnd.choice([3, 5, 7])]) for _ in range(rnd.randint(2, 9))),) for i in range(3)}
        own = licenses.Scanner(templates, {})
        text = licenses.words(" ".join(rnd.choice([*some, "x"]) if rnd.random() < 0.5 else rnd.choice(list(templates.values()))[0] for _ in range(6)))[:22]
        want = brute_spans(own, text)
        got = own.spans(text)
        assert {own.labels[k]: round(c, 9) for k, (_, c) in want.items()} == {label: round(share, 9) for label, _, share, _, _ in got}
        assert {own.labels[k] for k, (good, _) in want.items() if good} == {label for label, whole, share, _, _ in got if whole and share >= licenses.MIN_COVER}


def test_automaton_statistics():
    rnd = random.Random(4)
    sequences = [[rnd.randint(1, 3) for _ in range(12)] for _ in range(4)]
    own = licenses.Automaton(sequences)
    text = [rnd.randint(0, 4) for _ in range(200)]
    subs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for k, (length, state) in enumerate(own.statistics(text)):
        want = max((n for n in range(0, 13) if n == 0 or (n <= k + 1 and tuple(text[k + 1 - n : k + 1]) in subs)), default=0)
        assert length == want
        if length:
            own_text = text[k + 1 - length : k + 1]
            assert own.ends[state] == {q: {j for j in range(length, 13) if x[j - length : j] == own_text} for q, x in enumerate(sequences) if any(x[j - length : j] == own_text for j in range(length, 13))}


# -- SQL


@pytest.mark.parametrize("module, of", [(quality, quality.verdicts), (suffix_dedup, suffix_dedup.digests)])
def test_sql_equals_operator(spark, corpus, module, of):
    import duckdb

    prose = "\n".join(sentence(15) for _ in range(8))
    texts = [*corpus, prose, prose + "\nHome | About | Login\nALL CAPS THAT SHOUT HERE AND THERE.\nWow! Yes! No! So!\nBut click here.\nThe backlog infers a blog in Rome and a design upstream.\nTous droits réservés, en savoir plus.\nÉread more_ élog in.\nIf you log in to the page you may read more of it there today.", "é" * 150 + "x" + "é" * 150, "\x0bread more.\x0c\n" * 60]
    docs = documents(spark, texts)
    held = docs.toArrow()
    con = duckdb.connect()
    con.register("documents", held)
    got, want = of(docs).toPandas(), con.execute(module.ORACLE_SQL).df()[of(docs).columns]
    rows = lambda df: sorted(map(str, df.astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
