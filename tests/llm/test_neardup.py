"""Near duplicates of five-word shingles: exact groups, recall on planted edits, hot buckets, odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trajspark.llm import neardup

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def heads_of(texts):
    """The smallest id of every group of texts linked at a Jaccard similarity of 0.8."""
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in ids}


def prose(rnd, n):
    return [f"w{int(rnd.paretovariate(0.9))}x{rnd.randrange(40)}" for _ in range(n)]


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def planted():
    """Pairs (2k, 2k + 1) with some words replaced, down to a similarity of 0.8, among unrelated texts."""
    rnd = random.Random(11)
    rows, pairs = [], []
    for k in range(400):
        words = prose(rnd, rnd.randrange(60, 400))
        other = list(words)
        for _ in range(rnd.randrange(1, max(2, len(words) // 30))):
            other[rnd.randrange(len(words))] = f"changed{rnd.randrange(10**6)}"
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * k, a), (2 * k + 1, b)]
        if similarity(a, b) >= 0.8:
            pairs.append(2 * k)
    return rows, pairs


def test_recall_of_planted_edits(spark, planted):
    rows, pairs = planted
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    hard = [k for k in pairs if similarity(texts[k], texts[k + 1]) < 0.85]
    assert len(pairs) > 250 and len(hard) > 40
    assert sum(found[k] == found[k + 1] for k in pairs) >= 0.97 * len(pairs)
    assert sum(found[k] == found[k + 1] for k in hard) >= 0.9 * len(hard)
    for k in range(0, len(rows), 2):  # what is less similar stays apart, as does all that is unrelated
        if k not in pairs:
            assert found[k] == k and found[k + 1] == k + 1
    assert len(set(found.values())) >= 400


def test_groups_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = heads_of({r.doc_id: r.text for r in docs.collect()})
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_hot_bucket_of_many_tiles(spark):
    """Hundreds of near copies of one text and as many texts that share half of it, in tiles of 32."""
    rnd = random.Random(2)
    base = prose(rnd, 200)
    rows = []
    for i in range(300):
        w = list(base)
        w[rnd.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:100] + prose(rnd, 100))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, tile=32).collect()}
    assert all(found[i] == 0 for i in range(300)) and all(found[1000 + i] == 1000 + i for i in range(150))


def test_shortest_forest_keeps_all_groups():
    rnd = random.Random(4)
    bits = np.unique(np.array([rnd.getrandbits(64) for _ in range(40)] + [(1 << 40) - 1 ^ rnd.getrandbits(6) for _ in range(40)], np.uint64))
    for radius in (0, 3, 20, 31):
        i, j = neardup._forest(bits, radius)
        root = list(range(len(bits)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(i, j):
            assert (int(bits[a]) ^ int(bits[b])).bit_count() <= radius and find(a) != find(b)
            root[find(a)] = find(b)
        for a in range(len(bits)):
            for b in range(a):
                if (int(bits[a]) ^ int(bits[b])).bit_count() <= radius:
                    assert find(a) == find(b)


def test_prints_do_not_depend_on_the_batch():
    texts = ["", None, "one", "a b c d e f", "x " * 300, "a b c d e g", "A B c D e F"]
    whole = neardup._prints(pa.array(texts), 5)
    assert whole.tolist() == [int(neardup._prints(pa.array([t], pa.string()), 5)[0]) for t in texts]
    keys = neardup._keys(pa.array(texts), 5)
    assert whole[0] == whole[1] == 0 and whole[3] == whole[6] and (keys[3] == keys[6]).all() and (keys[3] != keys[5]).any()


def test_odd_rows(odd, none):
    assert neardup.deduplicated(none).count() == 0
    rows = odd.collect()
    out = neardup.deduplicated(odd)
    assert out.columns == odd.columns
    kept = [shingles(r.text) for r in out.collect()]
    assert len(kept) == len(set(kept)) == len({shingles(r.text) for r in rows})  # here all groups are exact copies
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[shingles(r.text)] = min(least.get(shingles(r.text), r.doc_id), r.doc_id)
    assert {shingles(r.text): r.doc_id for r in out.collect() if r.doc_id is not None} == least
