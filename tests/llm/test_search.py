"""Ranked search against SQL and brute force, packing against its tokenizer, runs against all periods."""

import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajspark.llm import packing, queries, runs, search

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_rank(docs, items, top):
    bags = [Counter(TERM.findall((r.text or "").translate(LOW))) for r in docs]
    sizes = [sum(b.values()) for b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall((text or "").translate(LOW)))
    out = []
    for item, terms in asked.items():
        found = []
        for r, b, s in zip(docs, bags, sizes):
            m = 50 + (50 * s * n) // total if s else 0
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if b[t]
            )
            if score > 0:
                found.append((-score, r.doc_id is None, r.doc_id or 0))
        for rank, (score, none, doc) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, None if none else doc, -score))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_search_query_matches_sql(spark, small):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    got = ordered(queries.QUERIES["op11_search"](spark, small).collect())
    assert got == ordered(con.sql(queries.SQL["op11_search"]).fetchall())


@pytest.mark.parametrize("top", [1, 3, 50])
def test_search_matches_brute_force(spark, odd, top):
    items = [(1, "alpha beta Gamma delta alpha"), (2, "the of x 42"), (3, "word"), (4, None), (5, "..."), (6, "absent"), (1, "Été NAÏVE w7"), (None, "one text")]
    table = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, rank int")
    got = ordered(search.ranked(odd, table, top).collect())
    assert got == ordered(brute_rank(odd.collect(), items, top))


def test_search_prunes_and_keeps_all(spark):
    """Many small shards, one very common term: the same ranks, and most common blocks are never unpacked."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(["common"] + [vocab[min(int(rnd.expovariate(0.02)), 399)] for _ in range(rnd.randrange(1, 60))]), 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int").coalesce(2)
    items = [(k, "common " + " ".join(rnd.sample(vocab, 12))) for k in range(20)]
    shards = search.index(docs, shard_docs=300)
    got = ordered(search.search(shards, spark.createDataFrame(items, "item_id long, text string"), 5).collect())
    assert got == ordered(brute_rank([type("R", (), dict(doc_id=i, text=t)) for i, t, _ in rows], items, 5))
    one = search.index(docs.coalesce(1), shard_docs=300).first().asDict()
    shard = search.Shard(one, search.Scorer(one["docs"], one["terms"]))
    hashes = next(iter(search._hashed(iter([pa.array(["common w350"])]))))[0].as_py()
    weight = np.array([1, 9000], np.int64)
    shard.search(np.array(hashes, np.int64).view(np.uint64), weight, 0, 1)
    assert shard.unpacked < len(shard.last[shard.block[0] :]) and shard.unpacked <= 6


def test_search_in_blocks_of_items(spark, odd):
    items = [(k, t) for k, t in enumerate(["alpha", "beta of", "gamma", "x 42", "delta one"])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = search.search(search.index(odd), table, top=4, at_a_time=2).collect()
    assert ordered(got) == ordered(brute_rank(odd.collect(), items, 4))


def test_search_of_nothing(spark, none, odd):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert search.ranked(none, items).count() == 0
    assert search.ranked(odd, items.where("false")).count() == 0


def test_variable_bytes_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**31 - 1, 5], np.int64)
    data, width = search.pack(values)
    assert search.unpack(data).tolist() == values.tolist() and width.tolist() == [1, 1, 1, 2, 2, 3, 4, 5, 1]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def tokens(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def check_packing(rows, texts, capacity):
    """Pieces rebuild the documents, only first pieces are short, places have no gap and no overlap."""
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for doc, want in texts.items():
        mine = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [i for r in mine for i in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert len(mine) == -(-len(want) // capacity) and all(r.length == capacity for r in mine[1:])
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_rebuilds_every_document(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.packed(docs, BPE).collect()
    texts = {r.doc_id: tokens(r.text) for r in docs.collect()}
    n = check_packing(rows, texts, 1024)
    assert n <= 1.01 * -(-sum(map(len, texts.values())) // 1024)
    digest = {(r.doc_id, r.piece): r for r in queries.QUERIES["op12_packing"](spark, small).collect()}
    assert len(digest) == len(rows)
    for r in rows:
        d = digest[r.doc_id, r.piece]
        assert (d.start, d.length, d.ids_crc32) == (r.start, r.length, zlib.crc32(r.ids))


def test_packing_in_a_tree_of_rounds(spark, small):
    """Many small parts need a few sequences more than one part, and none of the rules breaks."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.packed(docs, BPE, capacity=256, part_items=20).collect()
    texts = {r.doc_id: tokens(r.text) for r in docs.collect()}
    n = check_packing(rows, texts, 256)
    assert n <= 1.03 * -(-sum(map(len, texts.values())) // 256)


def test_packing_of_odd_rows(spark, odd, none):
    docs = odd.where("doc_id <> 10")
    texts = {r.doc_id: tokens(r.text) for r in docs.collect()}
    check_packing(packing.packed(docs, BPE).collect(), texts, 1024)
    assert packing.packed(odd, BPE).agg(F.sum("length")).first()[0] == sum(len(tokens(r.text)) for r in odd.collect())
    assert packing.packed(none, BPE).count() == 0


def test_sequences_hold_their_pieces(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.packed(docs, BPE)
    made = {r.sequence_id: r for r in packing.sequences(rows).collect()}
    for r in rows.collect():
        whole = made[r.sequence_id]
        assert whole.ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids and len(whole.ids) == 4 * whole.n_tokens


def test_encoder_equals_its_tokenizer():
    encode = packing.Encoder(BPE)
    odd = [
        "", " ", "  lead", "trail \n", "a  b   c\n  d \n e\t f", "it's we've 'x ''", "x" * 5000, " \x1c a \x85 b", "a　 b ​ c\r\n d",
        "<|endoftext|> a", "日本 語 テキスト  é É", "🙂🙂 ok", "1 22 333 4,444.5", "w " * 300, "\n\n\n a", "a\n\n b",
    ]
    for _ in range(2):
        for text in odd:
            assert np.frombuffer(encode(text), "<u4").tolist() == tokens(text)[:-1], text


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 7)
    text = "some  words of \n different   lengths,and no more"
    assert np.frombuffer(packing.Encoder(BPE)(text), "<u4").tolist() == tokens(text)[:-1]


def brute_runs(words):
    n, w, out = len(words), np.array(words), []
    for q in range(1, n // 3 + 1):
        same = np.diff(np.concatenate([[0], (w[:-q] == w[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            x = w[s : e + q]
            if len(x) >= max(24, 3 * q) and not any((x[d:] == x[:-d]).all() for d in range(1, q)):
                out.append((s, len(x), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rnd = random.Random(1)
    seen = 0
    for _ in range(600):
        words = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randrange(260))]
        for _ in range(rnd.randrange(4)):
            if len(words) > 30:
                i = rnd.randrange(len(words) - 10)
                p = rnd.randrange(1, max(2, (len(words) - i) // 2))
                words = (words[:i] + words[i : i + p] * rnd.randrange(1, 7) + words[i + p :])[:400]
                if rnd.random() < 0.3:
                    words[rnd.randrange(len(words))] = 9
        got = runs.runs(np.array(words, np.int64))
        seen += len(got)
        assert got == brute_runs(words)
    assert seen > 300


def test_runs_whose_period_repeats_long_passages():
    """The period holds one passage of 40 words twice, so nearer occurrences hide the true lag of short k-grams."""
    a = [f"a{i}" for i in range(40)]
    period = [*a, "x", *a, "y", "z"]
    words = ["head", *period * 4, *a, "tail"]
    got = runs.runs(runs.numbers(words))
    assert got == brute_runs(words) and got == [(1, 4 * 83 + 40, 83)]


def brute_digest(doc_id, text):
    import hashlib

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w) if n < 3000 else runs.runs(runs.numbers(w))
    drop = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)),
        sha(" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


def test_runs_query_matches_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = ordered(queries.QUERIES["op13_runs"](spark, small).collect())
    assert got == ordered(brute_digest(r.doc_id, r.text) for r in rows)


def test_runs_of_odd_rows(odd, none):
    assert ordered(runs.digest(odd).collect()) == ordered(brute_digest(r.doc_id, r.text) for r in odd.collect())
    assert runs.digest(none).count() == 0


def test_strongest_run_is_told_by_exact_quotient(spark):
    """Equal quotients: the earlier run wins; a quotient larger by less than a thousandth wins over both."""
    words = [f"a{i % 10}" for i in range(40)] + ["|"] + [f"b{i % 20}" for i in range(80)]
    both = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + [f"c{i % 2000}" for i in range(8001)]))], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.digest(both, change=None).collect()}
    assert (got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (0, 40, 10, 4000)
    assert (got[2].start, got[2].length, got[2].period, got[2].exponent_milli) == (121, 8001, 2000, 4000)
