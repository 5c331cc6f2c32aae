"""Near duplicates, components and benchmark decontamination."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from trajspark.llm import decontam, queries, simhash
from trajspark.llm.components import components

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def print_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=2):
    """Smallest index reachable for each."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def expected(rows):
    prints = [print_of(r.text) for r in rows]
    root = groups(prints)
    least = {}
    for r, g in zip(rows, root):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    return [(r.doc_id, f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, root)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_simhash_matches_brute_force(odd):
    got = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(got, key=key) == sorted(expected(odd.collect()), key=key)


def test_simhash_query_matches_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = [tuple(r) for r in queries.QUERIES["op10_simhash"](spark, small).collect()]
    assert sorted(got) == sorted(expected(rows))


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0


def ball(n, seed, spread=6):
    """Fingerprints that differ from one another in few bits, and others."""
    rnd = random.Random(seed)
    base = rnd.getrandbits(64)
    out = set()
    while len(out) < n:
        x = base
        for _ in range(rnd.randrange(spread)):
            x ^= 1 << rnd.randrange(64)
        out.add(x if rnd.random() < 0.8 else rnd.getrandbits(64))
    return sorted(out)


@pytest.mark.parametrize("tile", [1 << 11, 16])
def test_tiles_lose_no_link(spark, tile):
    prints = ball(300, 4)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(i, b) for i, b in enumerate(signed)], "node long, bits long")
    found = components(simhash.links(table, tile=tile))
    root = {r.node: r.root for r in found.collect()}
    assert [root.get(i, i) for i in range(len(prints))] == groups(prints)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0


def test_deduplicated_keeps_one_of_each_group(odd, none):
    rows = odd.collect()
    want = {(g, p) for (d, p, g) in expected(rows)}
    heads = {g for g, _ in want}
    out = simhash.deduplicated(odd)
    assert out.columns == odd.columns
    got = out.collect()
    prints = [print_of(r.text) for r in rows]
    root = dict(zip(prints, groups(prints)))
    assert sorted(root[print_of(r.text)] for r in got) == sorted(set(root.values()))
    assert {r.doc_id for r in got} == heads
    assert simhash.deduplicated(none).count() == 0


ITEM = "The train from Berlin leaves with 12 wagons of coal and Clara counts 30 km before it stops again near the old mill at night."
OTHER = "A very different question about seven green apples, three red pears and what remains of them when winter comes to town."
BENCH = [(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "too short"), (1, ITEM), (None, ITEM)]
FILL = "some filler words that nobody asks about stand here in a row of their own for a while. "


def bench(spark):
    return spark.createDataFrame([(*r, 9) for r in BENCH], "item_id long, text string, hash int")


def reworded(train="Berlin", wagons="12", who="Clara", far="30"):
    return ITEM.replace("Berlin", train).replace("12", wagons).replace("Clara", who).replace("30", far)


DOCS = {
    10: (FILL + ITEM + " " + FILL, {1}, True),
    11: (FILL + reworded("Lyon", "15", "Marta", "77") + " " + FILL, {1}, False),
    12: (FILL * 20, set(), None),
    13: (ITEM.upper() + " " + OTHER, {2}, True),
    14: ((FILL + reworded("Lyon", "15") + " ") * 3 + reworded("Oslo", "9"), {1}, False),
    15: (ITEM[:40], set(), None),
    16: (None, set(), None),
    17: ("", set(), None),
}


def decontaminate(spark, **options):
    docs = spark.createDataFrame([(i, t, 5) for i, (t, _, _) in DOCS.items()] + [(10, DOCS[10][0], 5), (None, ITEM, 5)], "doc_id long, text string, place int")
    return docs, decontam.matches(docs, bench(spark), **options).collect()


@pytest.mark.parametrize("broadcast", [decontam.BROADCAST, 0])
def test_contaminated_documents(spark, broadcast):
    docs, got = decontaminate(spark, broadcast=broadcast)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, {})[r.item_id] = r.same
    for i, (_, items, same) in DOCS.items():
        assert set(found.get(i, {})) - ({1} if i == 13 else set()) == items, (i, found.get(i))
        if same is not None and i != 13:
            assert set(found[i].values()) == {same}
    kept = decontam.clean(docs, bench(spark), broadcast=broadcast)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["12", "15", "16", "17", "None"]


def test_inconsistent_slots_do_not_match(spark):
    item = "Compare 12 with 12 and then 12 with 12 once more until 12 becomes 12 in the end of 12 rounds"
    values = iter(range(100, 200))
    mixed = re.sub("12", lambda _: str(next(values)), item)
    steady = item.replace("12", "77")
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, mixed), (2, steady)], "doc_id long, text string")
    assert [(r.doc_id, r.same) for r in decontam.matches(docs, table).collect()] == [(2, False)]


def test_decontamination_survives_odd_rows(spark, odd, none):
    assert decontam.matches(odd, bench(spark)).count() == 0
    assert decontam.clean(odd, bench(spark)).count() == odd.count()
    assert decontam.matches(none, bench(spark)).count() == 0
    assert decontam.matches(odd, bench(spark).limit(0)).count() == 0
    assert decontam.clean(none, bench(spark)).count() == 0


def test_query_finds_every_planted_passage(spark, small):
    docs = {r.doc_id: r.text.lower().split() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, w in items.items() if any(t[k : k + len(w) - 2] == w[1:-1] for k in range(len(t)))}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op9_decontam"](spark, small).collect()}
    assert whole <= got and len(got) <= len(whole) + 2


def test_templates_type_their_slots():
    from trajspark.llm.text import blocks

    (b,) = blocks(pa.array(["He met Anna after 5 km, then 7 apples. Then ÉTÉ Été."]))
    template, value, slot, _ = decontam.templates(b)
    kinds = {decontam.NAME: "name", decontam.NUMBER: "number", decontam.UNIT: "unit"}
    assert [kinds.get(t, "-") for t in template] == ["-", "-", "name", "-", "number", "unit", "-", "number", "-", "-", "-", "-"]
    assert value[-1] == value[-2]


NUMBERS = "12 cm x 7 cm x 9 cm or 14 cm x 3 cm x 8 cm?"
NAMES = "Anna Berta Clara Doris Emma Frieda Gerda Hanna"
LONG = " ".join(f"term{i}" for i in range(200))


def test_verbatim_copies_of_any_item(spark):
    items = spark.createDataFrame([(1, NUMBERS), (2, NAMES), (3, LONG)], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, FILL + NUMBERS + " " + FILL),
            (2, FILL + "with " + NAMES + " " + FILL),
            (3, FILL + " ".join(LONG.split()[70:130]) + " " + FILL),
            (4, FILL + NUMBERS.replace("12", "13").replace("9", "6").replace("14", "15").replace("8", "2") + " " + FILL),
            (5, FILL + "with " + " ".join(reversed(NAMES.split())) + " " + FILL),
            (6, FILL + " ".join(LONG.split()[70:82]) + " " + FILL),
        ],
        "doc_id long, text string",
    )
    for broadcast in (decontam.BROADCAST, 0):
        got = {(r.doc_id, r.item_id): (r.windows, r.item_windows, r.same) for r in decontam.matches(docs, items, broadcast=broadcast).collect()}
        assert set(got) == {(1, 1), (2, 2), (3, 3)} and got[3, 3] == (56, 196, True)


def test_other_values_are_found_beside_windows_without_a_template(spark):
    item = "12 cm x 7 cm x 9 cm x 4 cm x 5 cm is the box that Anna carries home on foot"
    docs = [(1, item.replace("12", "15").replace("7", "8").replace("9", "3").replace("4", "6").replace("5", "2").replace("Anna", "Marta"))]
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [(r.doc_id, r.same) for r in got.collect()] == [(1, False)]


def test_clean_matches_rows_without_a_name(spark):
    docs = spark.createDataFrame(
        [(None, FILL + ITEM, 1), (None, FILL, 2), (None, None, 3), (7, FILL, 4), (8, ITEM, 5)], "doc_id long, text string, found long"
    )
    kept = decontam.clean(docs, bench(spark), unnamed=True)
    assert kept.columns == docs.columns and sorted(r.found for r in kept.collect()) == [2, 3, 4]


def test_pipeline_drops_benchmark_copies_without_a_name(spark, tmp_path):
    import corpus_pipeline

    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, FILL + ITEM), (1, FILL)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.unseen(spark, docs, str(tmp_path)).collect()] == [1]


def test_short_item_needs_all_its_windows(spark):
    items = spark.createDataFrame([(1, "What is the capital of Peru?")], "item_id long, text string")
    rows = [(1, "We know that Berlin is the capital of Germany and like it"), (2, "Please say: what is the capital of Chile? Thank you"), (3, "what is the capital of Peru?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in decontam.matches(docs, items).collect()} == {2, 3}
