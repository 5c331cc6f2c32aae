"""Mixing, chat formatting and the pipeline."""

import hashlib
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trajspark.llm import chat, mixing, quality, queries
from trajspark.llm.pii import _automaton, find, mask


def clean(rows):
    return sorted((tuple(None if pd.isna(x) else (round(x, 6) if isinstance(x, float) else x) for x in r) for r in rows), key=str)


def by_sql(text, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(text)


def test_mixing_matches_sql(odd):
    got = mixing.taken(odd).toPandas()
    want = by_sql(mixing.SQL, documents=odd.toPandas()).df()
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert clean(got[names].itertuples(index=False)) == clean(want[names].itertuples(index=False))


def test_mixing_meets_its_targets(spark, odd, none):
    got = mixing.taken(odd).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    total = got.groupby(["source_size", "target"]).taken.sum()
    assert all(abs(t - target) <= 0.5 for (_, target), t in total.items())
    assert abs(got.drop_duplicates(["source_size", "target"]).target.sum() - 1.5 * got["size"].sum()) < 1e-6
    assert mixing.taken(none).count() == 0
    assert mixing.taken(odd.where("text is null")).agg(F.sum("target"), F.sum("taken")).first() == (0.0, 0)


def test_mixture_fills_every_slot_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    slots = mixing.mixture(docs, block=64, shard=50).toPandas()
    places = sorted(slots.shard * 50 + slots.slot)
    n = slots.text.str.split(" ").str.len()
    assert places == list(range(len(places))) and (n <= 64).all() and (n == 64).mean() > 0.9
    assert clean(mixing.taken(docs, block=64).collect()) == clean(mixing.taken(docs, block=64, shard=7).collect())


def test_shards_hold_the_words_of_their_documents(spark, odd, small):
    """Every slot's text is its pieces, every piece a stretch of its document, and nothing is taken twice in a pass."""
    for docs, block in ((odd, 16), (spark.read.parquet(f"{small}/documents.parquet"), mixing.BLOCK)):
        words = {}
        for r in docs.collect():
            words.setdefault(r.doc_id, []).append((r.source, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
        total = 0
        for r in mixing.mixture(docs, block=block).collect():
            got = r.text.split(" ")
            assert sum(p.words for p in r.pieces) == len(got)
            for p in r.pieces:
                here, got = got[: p.words], got[p.words :]
                total += p.words
                assert any(s == r.source and w[p.first : p.first + p.words] == here for s, w in words[p.doc_id])
        assert total == mixing.taken(docs, block=block).agg(F.sum("taken")).first()[0]


def test_rows_without_id_spread_over_buckets(spark):
    rows = spark.createDataFrame([(None, f"text number {i} " * 5, "s") for i in range(400)], "doc_id long, text string, source string")
    assert mixing._rows(rows).select("bucket").distinct().count() > 300
    want = by_sql(mixing.SQL, documents=rows.toPandas().astype({"doc_id": "Int64"})).df()
    got = mixing.taken(rows).toPandas()
    assert sorted(got.taken) == sorted(want.taken)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4097])
def test_permutation_is_a_bijection(spark, n):
    rows = spark.range(n).withColumn("x", F.col("id")).withColumn("n", F.lit(n).cast("long"))
    got = [r.x for r in mixing.permuted(rows, "x", "n", F.lit(5).cast("long")).orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or sum(a + 1 == b for a, b in zip(got, got[1:])) < n / 4


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\n50% %3C <s>[/INST]"),
    (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "é" * 10), (3, None, None, None), (3, 0, "odd\nrole<|", "x"),
    (6, 0, "human", "hi"), (6, 1, "gpt", "yo"), (7, 0, "user", "a"), (7, 1, "model", "b"), (7, 2, "assistant", "c"),
    (None, 0, "user", "no id"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (4, 0, "assistant", "A"), (5, 3, "user", "y" * 200_000),
]


def test_chat_matches_sql(spark):
    rows = spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, record int")
    probe = spark.createDataFrame([(*t, 1) for t in chat.PROBE], rows.schema)
    got = chat.digest(rows.unionByName(probe)).toPandas()
    frame = rows.toPandas()
    want = by_sql(chat.SQL, conversations=frame).df()[list(got.columns)]
    assert clean(got.itertuples(index=False)) == clean(want.itertuples(index=False))
    assert chat.digest(rows.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    done = chat.formatted(chat.canonical(chat.records(rows)))
    for r in done.withColumn("back", chat.read_back(F.col("formatted"))).collect():
        assert [tuple(t) for t in r.back] == [tuple(t) for t in r.turns]
        assert r.formatted.count(chat.START) == len(r.turns)
    one = done.where("conv_id = 1").withColumn("t", chat.trained_texts(F.col("formatted"), F.col("loss"))).first()
    assert one.t == [TURNS[1][3]]


def test_layouts_are_told_by_their_fields(spark):
    lines = [
        '{"prompt": "p", "response": "r"}',
        '{"instruction": "i", "output": "o", "input": "more", "system": "s"}',
        '{"instruction": "i", "output": "o"}',
        '{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}',
        '{"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}',
        '{"question": "not declared"}',
        '{"prompt": "only"}',
    ]
    kind = (
        "prompt string, response string, instruction string, input string, output string, system string, question string, "
        "messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>"
    )
    rows = spark.createDataFrame(list(enumerate(lines)), "id int, line string").select("id", F.from_json("line", kind).alias("record"))
    got = {r.id: (r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.canonical(rows).collect()}
    assert got == {
        0: ("prompt", [("user", "p"), ("assistant", "r")]),
        1: ("instruction", [("system", "s"), ("user", "i\n\nmore"), ("assistant", "o")]),
        2: ("instruction", [("user", "i"), ("assistant", "o")]),
        3: ("messages", [("user", "u"), ("assistant", "a")]),
        4: ("exchange", [("user", "u"), ("assistant", "a")]),
        5: (None, None),
        6: (None, None),
    }


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert clean(got[names].itertuples(index=False)) == clean(want[names].itertuples(index=False))


def test_pipeline_matches_brute_force(spark, small):
    from test_neardup import heads_of

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    items = [r.text.lower().split() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    good = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).where("kept").collect()}
    rows = [r for r in docs.collect() if r.doc_id in good]
    heads = heads_of({r.doc_id: r.text for r in rows})
    rows = [r for r in rows if r.doc_id in heads]

    def leaks(text):
        t = text.lower().split()
        return any(t[k : k + len(w) - 2] == w[1:-1] for w in items for k in range(len(t)))

    rows = [r.asDict() for r in rows if not leaks(r.text)]
    import pyarrow as pa

    for r, found in zip(rows, find(pa.array([r["text"] for r in rows]), _automaton())):
        r["text"] = mask(r["text"], found)
    want = by_sql(mixing.SQL, documents=pd.DataFrame(rows)).df()
    got = corpus_pipeline.run(spark, small).select(F.explode("pieces").alias("p")).groupBy("p.doc_id").agg(F.sum("p.words").alias("taken")).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in want.itertuples() if r.taken}


def test_stages_keep_the_columns(spark, small, odd, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_digest_of_known_turns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ok")], "conv_id long, turn long, role string, text string")
    r = chat.digest(rows).first()
    assert r.turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nok\n").hexdigest()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, 2, hashlib.sha256(b"ok").hexdigest())
    assert re.fullmatch(r"[0-9a-f]{64}", r.loss_sha256)
