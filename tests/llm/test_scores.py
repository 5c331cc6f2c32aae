"""Language model, repetition rules, quality and toxicity."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.llm import lm, quality, queries, repetition, toxicity
from trajspark.llm.text import BYTE, Rolling, blocks

WORD = r"[^\x20\x09-\x0D]+"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def fold(doc_id, modulus):
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def test_words_and_hashes(odd):
    import pyarrow as pa

    texts = [r.text for r in odd.select("text").collect()]
    got = [[] for _ in texts]
    seen = {}
    for b in blocks(pa.array(texts), 1000):
        start, end = b.words()
        raw = b.data.tobytes()
        for s, e, o, h in zip(start, end, b.owner(start), Rolling(BYTE[b.data]).slices(start, end)):
            word = raw[s:e].decode()
            got[b.first + o].append(word)
            assert seen.setdefault(word, h) == h
    assert got == [re.findall(WORD, t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def check_base(rows, out):
    tokens = [[*re.findall(WORD, (r.text or "").translate(LOW)), None] for r in rows]
    train = [fold(r.doc_id, 7) != 2 for r in rows]
    c = collections.Counter(w for t, x in zip(tokens, train) if x for w in t)
    total = sum(c.values())
    want = sorted(
        (
            (-1 if r.doc_id is None else r.doc_id), not x, len(t), sum(w in c for w in t), total,
            round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in t), 6),
        )
        for r, t, x in zip(rows, tokens, train)
    )
    got = sorted(
        ((-1 if r.doc_id is None else r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out
    )
    assert got == want


@pytest.mark.parametrize("options", [{}, {"common": 3, "outcomes": 2, "fan_in": 2}])
def test_lm_base_matches_counts(odd, options):
    out = lm.score(odd, **options).collect()
    check_base(odd.collect(), out)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_lm_beats_the_base_on_held_out_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = queries.QUERIES["op1_lm"](spark, small).collect()
    check_base(docs.collect(), out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_does_not_depend_on_the_layout(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    few, many = ({r.doc_id: r.score for r in lm.score(docs.repartition(n), part=1 << 12, fan_in=3).collect()} for n in (2, 7))
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-5 * abs(few[k]) for k in few)


def test_lm_gives_most_tokens_vectors_of_their_own(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    table = lm.counts(docs)
    model, tokens = lm.train(docs, table)
    vectors = lm.tail(tokens, model)
    own = {r.word for r in vectors.collect()}
    rows = {r.word: r.n for r in table.collect()}
    top = set(model.words[model.outcome >= 0].view(np.int64).tolist())
    assert own == {w for w, n in rows.items() if n >= lm.RARE and w not in top}


def test_lm_rare_words_are_joined_to_their_vectors(spark, small):
    """Words that do not travel to the tasks get the same score from the join; heavy words are counted first."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sent, joined = ({r.doc_id: r.score for r in lm.score(docs, common=n).collect()} for n in (lm.COMMON, lm.OUTCOMES))
    assert all(abs(sent[k] - joined[k]) < 1e-4 * abs(sent[k]) for k in sent)


def test_lm_words_of_a_block_share_a_row(spark, small):
    """One row for each shard, that holds every occurrence; the rounds' tasks are sent no table of words."""
    docs = spark.read.parquet(f"{small}/documents.parquet").coalesce(1)
    table = lm.counts(docs)
    model, tokens = lm.train(docs, table)
    light = tokens.where("class is not null and n is null")
    assert light.count() <= model.shards
    top = {r.word for r in table.orderBy(F.desc("n"), "word").limit(lm.OUTCOMES).collect()}
    inside = sum(r.n for r in table.collect() if r.word not in top and lm.RARE <= r.n < lm.HEAVY)
    assert light.agg(F.sum(F.length("codes"))).first()[0] == 2 * inside
    slim = model.slim()
    assert len(slim.words) <= 1 and slim.end == model.end


def test_lm_words_of_a_class_add_up_to_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model, tokens = lm.train(docs, lm.counts(docs), outcomes=50)
    lm.tail(tokens, model)
    table = {r.word: r["class"] for r in lm.counts(docs).collect()}
    cls = np.array([table[w] for w in model.words.view(np.int64).tolist()])
    before = model.before()
    for c, one in ((3, 0), (7, 20), (40, 60)):
        mine = (cls == c) & (model.outcome < 0)
        dot = (model.vectors[mine] @ before[one]).clip(-lm.TAIL_TOP, lm.TAIL_TOP)
        shares = (model.counts[mine] + 1) / 10 ** model.log_rest[c]
        unseen = 10 ** -model.log_rest[c]
        assert abs((shares * np.exp(dot)).sum() + unseen - math.exp(model.inside[one, c])) < 1e-3
        assert mine.any()


def test_lm_vector_of_a_word_maximises_its_objective():
    """Against plain gradient ascent on one word."""
    rng = np.random.default_rng(1)
    before = rng.normal(size=(30, lm.DIM))
    n, seen, share = rng.poisson(3.0, 30).astype(float), rng.poisson(400.0, 30).astype(float), 0.01
    noise = lm.TAIL_NOISE * share * seen

    def objective(r):
        x = before @ r - math.log(lm.TAIL_NOISE)
        return -(n * np.logaddexp(0, -x) + noise * np.logaddexp(0, x)).sum() - lm.TAIL_RIDGE / 2 * r @ r

    best = np.zeros(lm.DIM)
    for _ in range(4000):
        p = 1 / (1 + lm.TAIL_NOISE * np.exp(-(before @ best)))
        best += 2e-3 * (before.T @ (n - (n + noise) * p) - lm.TAIL_RIDGE * best)
    found = lm.solve(n[None], np.array([share]), seen, before)[0].astype(float)
    start = objective(np.zeros(lm.DIM))
    assert objective(found) - start > 0.9 * (objective(best) - start) > 0


def test_lm_is_normalised(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model, tokens = lm.train(docs, lm.counts(docs))
    lm.tail(tokens, model)
    scorer = lm.Scorer(model)
    one, two = np.array([0, 5, 1030]), np.array([3, 1024, 0])
    norm = scorer.normalisers(one, two)
    h = scorer.c[0] * scorer.q[one] + scorer.c[1] * scorer.q[two]
    assert np.allclose(np.exp(h @ scorer.r.T + scorer.bias - norm[:, None]).sum(1), 1, atol=1e-4)


@pytest.fixture(scope="module")
def heavy(spark):
    """Texts of few words, each found more often than HEAVY."""
    rnd = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rnd.integers(0, 12, 200)) for _ in range(400)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_lm_heavy_words_share_rows_too(heavy):
    """Rows of words grow with blocks and shards, not with words and the outcomes before them."""
    table = lm.counts(heavy)
    model, tokens = lm.train(heavy, table, outcomes=4, rounds=1)
    assert table.where(F.col("n") >= lm.HEAVY).count() >= 10
    assert tokens.where("class is not null").count() <= model.shards


def test_lm_shards_hold_counts_and_vectors_of_heavy_words(heavy):
    table = {r.word: r.n for r in lm.counts(heavy).collect()}
    model, tokens = lm.train(heavy, lm.counts(heavy), outcomes=4, rounds=1)
    got = {}
    for r in lm.shards(tokens, model).collect():
        words, count, vectors = lm._unpacked(r.words, r.counts, r.vectors)
        got |= dict(zip(words.view(np.int64).tolist(), zip(count.tolist(), vectors[np.cumsum(count >= lm.RARE) - 1])))
    top = set(model.words[model.outcome >= 0].view(np.int64).tolist())
    assert {w: n for w, (n, _) in got.items()} == {w: n for w, n in table.items() if w not in top}
    text = [r.text for r in heavy.collect() if fold(r.doc_id, 7) != 2]
    seen = np.zeros((lm.CLASSES, model.size))
    mine = collections.defaultdict(lambda: np.zeros(model.size))
    import pyarrow as pa

    for b in blocks(pa.array(text)):
        hashes, classes, whose = lm._tokens(b)
        outcome, _ = model.outcomes(hashes, classes)
        one = model.contexts(outcome, whose, model.end)[0]
        for h, o, c in zip(hashes.view(np.int64).tolist(), outcome, one):
            if o >= model.head:
                seen[o - model.head, c] += 1
                mine[h][c] += 1
                cls = o - model.head
                got[h] = (*got[h][:2], cls)
    room = model.classes.sum(1) + 1
    for h, (n, vector, c) in got.items():
        want = lm.solve(mine[h][None], np.array([(n + 1) / room[c]]), seen[c], model.before().astype(float))[0]
        assert np.allclose(vector, want, atol=1e-3)


def test_lm_contexts_of_a_shard_stay_small(monkeypatch):
    """Heavy words are counted while they are gathered; the sums stay exact."""
    import pyarrow as pa

    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    monkeypatch.setattr(lm, "HEAVY", 50)
    rnd, found, want = np.random.default_rng(2), lm._Contexts(), collections.Counter()
    for _ in range(60):
        words = np.sort(rnd.choice(40, 5, replace=False)).astype(np.uint64)
        times = rnd.integers(1, 60, 5).astype(np.uint32)
        codes = rnd.integers(0, 6, times.sum()).astype(np.uint16)
        want.update(zip(np.repeat(words, times).tolist(), codes.tolist()))
        row = {"codes": codes, "words": words, "classes": (words % 7).astype(np.uint8), "times": times}
        found.add(pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in row.items()}))
        assert found.size <= 2 * 500 + 40 * 50
    found.count()
    got = collections.Counter()
    for w, o, n in zip(*found.rows):
        got[int(found.words[w]), int(o)] += int(n)
    assert got == want and (found.classes == found.words.astype(np.int64) % 7).all()


def test_lm_places_are_those_of_a_search():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        table = np.unique(np.append(rnd.integers(0, 2**64, n, np.uint64), np.array([0, 5, 2**64 - 1], np.uint64)[:n]))
        keys = np.concatenate([table, table + np.uint64(1), rnd.integers(0, 2**64, 500, np.uint64)])
        assert (lm.Places(table).find(keys) == lm.lookup(keys, table)).all()


def test_lm_rows_of_words_grow_with_the_words(spark):
    """Many shards: a pack of occurrences is larger, so that a shard's row keeps its length."""
    model = lm.Model(*[np.zeros(0)] * 3, np.ones(1), np.zeros(1), 0, 0, classes=np.array([[0, 1e4 * lm.SHARD]]))
    assert model.pack >= lm.ROW * model.shards > lm.PACK


def test_lm_without_training_texts(spark):
    rows = [(i, f"some text {i} " * 3) for i in range(400) if fold(i, 7) == 2]
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out) == [i for i, _ in rows]
    assert all(r.held_out and r.n_known == r.train_tokens == 0 and math.isfinite(r.score) for r in out)


def test_lm_of_nothing(none):
    assert lm.score(none).count() == 0


def plain_repetition(text):
    words = re.findall(WORD, text or "")

    def covered(n, later):
        seen, marks = collections.Counter(), set()
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = collections.Counter(grams)
        for i, g in enumerate(grams):
            if (seen[g] if later else count[g] > 1):
                marks.update(range(i, i + n))
            seen[g] += 1
        return marks

    lines, again = set(), []
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            if line in lines:
                again.append(line)
            lines.add(line)
    chars = sum(map(len, words))
    counts = [len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(again), len(covered(3, False))]
    counts.append(sum(len(w) for line in again for w in re.findall(WORD, line)))
    counts += [sum(len(words[i]) for i in covered(n, True)) for n in repetition.SHARES]
    failed = len(words) < 50 or 100 * counts[4] > 50 * len(words)
    bad = counts[5] > 0.2 * chars or any(c > s * chars for c, s in zip(counts[6:], repetition.SHARES.values()))
    return (*counts, failed, not failed and not bad)


def test_repetition_matches_plain_counting(odd):
    got = repetition.repetition(odd).collect()
    want = [((-1 if r.doc_id is None else r.doc_id), *plain_repetition(r.text)) for r in odd.collect()]
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(want)


def test_repetition_of_nothing(none):
    assert repetition.repetition(none).count() == 0


def labelled(spark, n=900, seed=1):
    """Prose and junk; prose with and without words of a toxic family."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30, 200))]
        bad, toxic = rnd.random() < 0.25, rnd.random() < 0.3
        if toxic:
            for _ in range(4):
                words[rnd.randrange(len(words))] = "zgrub" + rnd.choice(["", "en", "ish", "le", "ata"])
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        rows.append((i, text, rnd.choice(["en", "fr", None]), f"src{rnd.randrange(4)}", len(text)))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(out, truth):
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    return sum(int(r[-1]) == truth[r.doc_id] for r in held) / len(held)


def test_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert accuracy(out, {r.doc_id: r.quality for r in labels.collect()}) > 0.97
    model = quality.train(docs, labels)
    kept = {r.doc_id for r in quality.kept(docs, model).collect()}
    assert kept == {r.doc_id for r in quality.score(docs, model).where("kept").collect()}


def test_toxicity_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert accuracy(out, {r.doc_id: r.toxic for r in labels.collect()}) > 0.97


def spelled(text):
    """The spellings of a text, straight from the definition."""
    out = []
    for m in re.finditer(r"[a-zA-Z0-9\x80-\u07ff]+|[\u0800-\U0010ffff]+", text):
        word = m.group()
        if ord(word[0]) >= 0x800:
            out += [word[i : i + toxicity.SCRIPT].encode() for i in range(len(word))]
            continue
        after = text[m.end() : m.end() + 1]
        whole = word.translate(LOW).encode() + (b"" if after and ord(after) >= 0x800 else b"\0")
        starts = [0]
        if len(whole) > toxicity.ORDER:
            starts = [len(word[:i].encode()) for i in range(len(word))]
        out += [whole[i:][: toxicity.ORDER] for i in starts]
    return out


def brute_models(rows):
    """Log probability of every beginning with mass of its own, ordinary and toxic."""
    count = [collections.Counter(), collections.Counter()]
    for text, y in rows:
        count[y].update(u[:k] for u in spelled(text) for k in range(1, len(u) + 1))
    below = collections.defaultdict(set)
    for node in set(count[0]) | set(count[1]):
        below[node[:-1]].add(node)

    def log_p(node, k):
        some = below[node[:-1]]
        n, types = (sum(count[k][x] for x in some), [sum(count[c][x] > 0 for x in some) for c in (0, 1)])
        shared = sum(count[c][node] > 0 for c in (0, 1)) / sum(types)
        p = (max(count[k][node] - 1, 0) + types[k] * shared) / n if n else shared
        return math.log(p) + (log_p(node[:-1], k) if len(node) > 1 else 0.0)

    return {x: (log_p(x, 0), log_p(x, 1)) for x in set(count[0]) | set(count[1]) if max(count[0][x], count[1][x]) > 1}


def test_toxicity_matches_brute_force(spark):
    import pyarrow as pa

    rnd = random.Random(4)
    words = ["zgrub", "Zgruben", "lotus", "lot", "été", "слово", "你好世界", "天气很好今天", "“quoted”", "x" * 30, "Donaudampfschifffahrtsgesellschaft", "пере" * 9]
    rows = [(" ".join(rnd.choices(words, k=rnd.randrange(0, 12))) + rnd.choice(["", "!", "。"]), i % 2) for i in range(40)]
    model = toxicity.counted(spark.createDataFrame(rows, "text string, y int").repartition(3))
    want = brute_models(rows)
    assert len(model.beginnings) == len(want)
    column = pa.array([t for t, _ in rows] + ["", None, "unseen ЖЖ", "zgrubish" * 5])
    got = model.evidence(column)
    for text, e in zip(column.to_pylist(), got):
        sums, ratios, letters = [0.0, 0.0], [], 0
        for u in spelled(text or ""):
            k = max((k for k in range(1, len(u) + 1) if u[:k] in want), default=0)
            ll = [x - (len(u) - k) * toxicity.EVEN for x in (want[u[:k]] if k else (0.0, 0.0))]
            sums, letters = [a + b for a, b in zip(sums, ll)], letters + len(u)
            ratios.append(ll[1] - ll[0])
        assert abs(e[0] - sum(ratios) / max(len(ratios), 1)) < 1e-9
        if letters:
            assert abs(e[6] - sums[1] / letters) < 1e-9 and abs(e[7] - sums[0] / letters) < 1e-9
        else:
            assert math.isnan(e[6]) and math.isnan(e[7])


def test_toxicity_reads_whole_words(spark):
    """What stands late in a long word, or in a text without blanks, is evidence."""
    import pyarrow as pa

    rows = [("ein grauer hund lief heim 天气很好今天我们去公园散步吧", 0)] * 6 + [("ein zgrubo hund lief heim 天气很好今天我们去公园坏蛋", 1)] * 6
    model = toxicity.counted(spark.createDataFrame(rows, "text string, y int"))
    ratio = model.evidence(pa.array(["天气很好今天我们去公园散步吧", "天气很好今天我们去公园坏蛋", "n" * 26 + "grauer", "n" * 26 + "zgrubo"]))[:, 0]
    assert ratio[1] > ratio[0] + 0.1 and ratio[3] > ratio[2] + 0.05


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_survive_odd_rows(spark, odd, none, module):
    docs, labels = labelled(spark, 300)
    mixed = docs.withColumns({c: F.lit(None).cast(t) for c, t in odd.dtypes if c not in docs.columns}).unionByName(odd)
    more = labels.unionByName(spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 0, 1)], labels.schema))
    model = module.train(mixed, more)
    got = module.score(mixed, model).collect()
    assert len(got) == mixed.count() and all(0 <= r.score <= 1 for r in got)
    assert module.score(none, model).count() == 0
    empty = labels.limit(0)
    single = module.train(docs, labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)}))
    for m in (module.train(mixed, empty), module.train(none, labels), module.train(none, empty), single):
        assert len({r.score for r in module.score(odd, m).collect()}) == 1
