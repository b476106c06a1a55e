"""Operators 2, 4, 5, 6, 8, 9 against the libraries or plain Python on a small, ugly fixture."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, packing, pieces, queries, records, rules, urls

BPE, PIECES = queries.BPE, queries.PIECES
BITS = [" ", "  ", "\n", "\t", "a", "foo", "é", "ß", "\u00a0", "\u3000", "▁", "<|endoftext|>", "</s>", "1", "23", "!", "'s", "\x1c", "\x85", "日本", "\x00", "😀", "#", "%%", "the cat sat\n", "the cat sat "]


def texts():
    r = random.Random(5)
    out = ["".join(r.choices(BITS, k=r.randint(0, 40))) for _ in range(150)]
    return [*out, None, "", " ", "\n", "same text here", "same text here", "x" * 3000, "word " * 4000, " lead", "trail "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3)


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def bpe(t):
    from tokenizers import Tokenizer

    k = Tokenizer.from_file(BPE)
    return k.encode(t or "", add_special_tokens=False).ids


def test_pieces(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in pieces.encode_decode(docs, PIECES).collect()}
    for i, t in enumerate(texts()):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(u32(ids)).hexdigest()
        assert got[i].decoded == sp.decode(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def shifted():
    """Two long spans whose bytes differ 4096 places apart in ways that once cancelled out."""
    one = bytearray(b"m" * 6000)
    two = bytearray(one)
    two[10] += 3
    two[10 + 4096] -= 1
    return bytes(one).decode(), bytes(two).decode()


def test_long_spans_differ(spark):
    from pagemill.llm import tokens
    from pagemill.llm.common import span_hashes_2, text_arrays
    import sentencepiece

    a, b = shifted()
    for table, plain in ((tokens.bpe(BPE), bpe), (tokens.pieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES).encode)):
        ids, at = table.encode(*text_arrays(pa.array([a, b])))
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [plain(a), plain(b)]
    assert rules.measure(*text_arrays(pa.array([f"{a}\n{b}"])))["n_dup_lines"].tolist() == [0]
    r = np.random.default_rng(0)
    spans = [bytes(r.integers(0, 4, int(n), dtype=np.uint8)) for n in [*r.integers(1, 200, 3000), *r.integers(4000, 13000, 60)]]
    buf = np.frombuffer(b"".join(spans), np.uint8)
    lens = np.array([len(x) for x in spans])
    starts = np.cumsum(lens) - lens
    for h in span_hashes_2(buf, starts, lens):
        assert len(set(h.tolist())) == len(set(spans))
        each = [span_hashes_2(np.frombuffer(x, np.uint8), np.zeros(1, int), np.array([len(x)])) for x in spans[-70:]]
        assert any(h[-70:].tolist() == [int(e[k][0]) for e in each] for k in range(2))


def test_chunks_that_share_a_key():
    from pagemill.llm import chunk_table, tokens
    from pagemill.llm.common import text_arrays

    real = chunk_table.span_hashes_2
    chunk_table.span_hashes_2 = lambda *x: [real(*x)[0] % np.uint64(5), real(*x)[1]]
    try:
        t = chunk_table.ChunkTable(tokens._bpe_cuts, lambda chunks, opening: (np.frombuffer(b"".join(chunks), np.uint8).astype(np.uint32), np.array([len(c) for c in chunks])))
        own = [f"w{j} v{j * j} z" for j in range(40)]
        assert bytes(t.encode(*text_arrays(pa.array(own)))[0].tolist()).decode() == "".join(own)
    finally:
        chunk_table.span_hashes_2 = real


def test_chunk_table_starts_anew():
    from pagemill.llm import tokens
    from pagemill.llm.chunk_table import ChunkTable
    from pagemill.llm.common import text_arrays

    t = ChunkTable(tokens._bpe_cuts, lambda chunks, opening: (np.frombuffer(b"".join(chunks), np.uint8).astype(np.uint32), np.array([len(c) for c in chunks])), capacity=50)
    for k in range(6):
        own = [f"w{k * 20 + j} w{j} z" for j in range(20)]
        ids, at = t.encode(*text_arrays(pa.array(own)))
        assert bytes(ids.tolist()).decode() == "".join(own)
        assert np.diff(at).tolist() == [len(x) for x in own]


def test_records(spark, docs):
    rows = [r.asDict() for r in records.round_trip(docs, BPE, 0, keep_ids=True).collect()]
    start = 0
    for i, t in enumerate(texts()):
        ids = [*bpe(t), 0]
        r = next(x for x in rows if x["doc_id"] == i)
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["start"] == start
        assert r["ids_crc32"] == zlib.crc32(u32(ids))
        start += len(ids)
    assert len(rows) == len(texts())
    empty = records.round_trip(docs.limit(0), BPE, 0)
    assert empty.count() == 0


def test_shuffled_reads_go_through_the_index(spark, docs, tmp_path):
    out = f"file://{tmp_path}/part-99999"  # a folder's name is no file's number
    records.write(docs, BPE, 0, out, file_bytes=4000)
    index = spark.read.parquet(f"{out}/index")
    assert index.select("file").distinct().count() > 3
    rows = index.collect()
    random.Random(2).shuffle(rows)
    asked = spark.createDataFrame([(k, r.file, r.offset) for k, r in enumerate(rows[:80])], "place long, file int, offset long")
    got = {r.place: r for r in records.read_at(spark, out, asked).collect()}
    ts = texts()
    for k, r in enumerate(rows[:80]):
        assert got[k].doc_id == r.doc_id and list(got[k].ids) == [*bpe(ts[r.doc_id]), 0] and r.n_tokens == len(got[k].ids)
    each = sorted((r.doc_id, r.start, r.n_tokens) for r in records.read(spark, out).collect())
    assert [s for _, s, _ in each] == np.cumsum([0, *(n for _, _, n in each)])[:-1].tolist()


def test_damage_is_found():
    data = bytearray(records.frame(-5, np.array([1, 70000], np.uint32), 4) + b"\n")
    assert records.unframe(memoryview(bytes(data)), 0)[0] == -5
    data[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(bytes(data)), 0)


def test_records_repeat_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (1, "a")], "doc_id long, text string")
    got = records.round_trip(df, BPE, 0).collect()
    assert Counter(r.doc_id for r in got) == {1: 3, None: 1}
    assert sorted(r.start for r in got) == [0, 2, 4, 6]


def test_packing(docs):
    rows = packing.pack_documents(docs, BPE, 2, 1024).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for i, t in enumerate(texts()):
        ids = [*bpe(t), 2]
        total += len(ids)
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(u32(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_seq) == -(-total // 1024)
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0


def test_best_two_fit_beats_greedy_gap():
    assert [sorted(b) for b in packing.best_two_fit(np.array([6, 3, 2, 2]), 10)] == [[2, 2, 6], [3]]
    r = np.random.default_rng(0)
    for _ in range(20):
        lengths = r.integers(1, 60, 200)
        bins = packing.best_two_fit(lengths, 64)
        assert sorted(x for b in bins for x in b) == sorted(lengths.tolist()) and max(map(sum, bins)) <= 64


def plain_measures(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = list(zip(words, words[1:], words[2:]))
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules(docs):
    got = {r["doc.doc_id"]: r for r in rules.judge(docs, ["doc_id", "n_words"]).collect()}
    for i, t in enumerate(texts()):
        r = got[i]
        want = plain_measures(t)
        assert (r.__getitem__("n_words"), r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
        assert r["doc.n_words"] == "clash"
    assert rules.judge(docs.limit(0), ["doc_id"]).count() == 0


def test_sketch_buckets(spark):
    v = [0, 1, 5, 31, 32, 33, 63, 64, 1000, 1024, 99999, 1 << 40]
    rows = spark.createDataFrame([(x,) for x in v], "v long").select("v", rules.bucket(F.col("v")).alias("b")).select("v", "b", rules.bucket_floor(F.col("b")).alias("f")).collect()
    for r in rows:
        assert r.f <= r.v <= r.f * 17 / 16 + 1 and (r.v >= 32 or r.f == r.v)


def test_thresholds_follow_the_group(spark):
    # source a is usually full of symbols, source b never is
    rows = [(i, " ".join(f"w{i}x{j}" + "#" * (j % 2 if s == "a" else 0) for j in range(60)), "en", s) for s in "ab" for i in range(300)]
    rows.append((999, " ".join(f"q{j}" + "#" * (j % 2) for j in range(60)), "en", "b"))
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"])
    kept = Counter((r["doc.source"], r["kept"]) for r in got.collect())
    assert kept == {("a", True): 300, ("b", True): 300, ("b", False): 1}


URLS = [None, "", "no scheme", "http://Example.com/en/x?q", "http://www.example.com/en/", "https://a.www.example.com/en/1#f", "http://example.com", "http://foo.net/fr/1", "http://net/es/", "http://x.org/en/", "http://ÉX.com/", "ftp://example.com/e", "a://b://c.com/", "http://evil-example.com/en/", "http://com?x/", "http://.com/", "http://x.net/fr"]


def plain_url(u, rules_):
    if u is None or "://" not in u:
        return "", "", None, "allow"
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((h + p, v) for h, p, v in rules_ if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, *best


@pytest.mark.parametrize("max_bytes", [urls.MAX_BYTES, 0])
def test_urls(spark, max_bytes):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urls.judge(df, queries.URL_RULES, max_bytes=max_bytes).collect()}
    assert got == {i: plain_url(u, queries.URL_RULES) for i, u in enumerate(URLS)}
    assert urls.judge(df.limit(0), queries.URL_RULES, max_bytes=max_bytes).count() == 0


def test_digest_collisions(monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda x: len(x) % 2)
    a = urls.DigestArray([("a.b", "/", "allow"), ("c.d", "/", "block"), ("ee.f", "/", "block")])
    names = ["c.d/", "a.b/", "x.y/", "ee.f/", "z"]
    found = a.find(np.array([len(x) % 2 for x in names]), pa.array(names))
    assert [a.names[j] if j >= 0 else None for j in found.tolist()] == ["c.d/", "a.b/", None, "ee.f/", None]


def test_digest_is_that_of_spark(spark):
    names = ["", "a", "com/", "é" * 40]
    got = spark.createDataFrame([(x,) for x in names], "x string").selectExpr("x", "xxhash64(x) AS d").collect()
    assert all(r.d == urls.digest(r.x) for r in got)


TALKS = {
    1: [("user", "hi"), ("assistant", "a</turn>\nb"), ("user", "### user: x"), ("assistant", "\\")],
    2: [("system", ""), ("user", None), ("assistant", "</turn>\n### assistant: y"), ("user", "tail \\# \\/ </")],
    3: [("user", "only"), ("user", "")],
    4: [("assistant", "")],
    5: [(None, "x"), ("we:ird\n: ", "y"), ("assistant", "\n\n: z</turn"), ("assistant", "两")],
}


def test_chat(spark):
    rows = [(c, k, r, t, "clash") for c, ts in TALKS.items() for k, (r, t) in enumerate(ts)]
    random.Random(1).shuffle(rows)
    examples = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target string")).cache()
    for c, ts in TALKS.items():
        replies = sum(r == "assistant" for r, _ in ts)
        assert examples.filter(f"conv_id = {c} and target is not null").count() == replies
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for c, ts in TALKS.items():
        whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in ts)
        loss = "".join(t or "" for r, t in ts if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(ts), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    plan = chat.read_back(examples)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.expand(none)).count() == 0
