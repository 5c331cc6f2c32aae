"""Benchmark decontamination: questions found again in documents, also with other numbers and names.

Texts become templates: a number, a name or a unit after a number turns into a placeholder of its type, other
words lose case and outer punctuation. Hashes of windows of five template words are joined with those of the
benchmark. Windows of one document and one item that lie on one diagonal (same distance between
their places) are one occurrence; it counts if its slots are consistent, that is each value of the item stands for one
and the same value of the document throughout. Windows are also compared as written (lower case), all of them: those
that agree in every word count whatever the rest of the occurrence does. A document is contaminated by an item if
counted windows cover at least half of the item's (of all, or of those that have a template; all where they number one or
two), or if a run of them without a gap reaches RUN words.

The benchmark's window hashes travel to the tasks as a sorted array while they number at most
BROADCAST; beyond that all windows of the documents meet them in the join, with the same result.

A word is a name if it begins with an upper-case letter, has a lower-case one, and begins neither a sentence nor a
line. Windows of fewer than three words that are not placeholders say too little as templates and are compared only as
written. Items shorter than a window are one window; null or empty items and documents match nothing. Rows without
doc_id have no name for ``matches`` and are left out there; ``clean`` keeps them, or with ``unnamed`` tells them apart
by a hash of their text and drops those that an item contaminates. Repeated rows of a document or an item
count once in ``matches``, and ``clean`` keeps or drops all repeats alike. Empty tables give empty results. Columns of
other names are ignored, or passed on by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.llm.text import BYTE, LOWER, SEP, Block, Rolling, batch, blocks, free, lookup, mix
from trajspark.plans.scratch import cut_lineage

WINDOW = 5
#: Least words of a template window that are not placeholders; windows as written need none.
PLAIN = 3
#: Least share of an item's windows.
COVER = 0.5
#: Windows up to which all of them are needed: one of two is found by chance ("is the capital of NAME").
SHORT = 2
#: Words of a run without a gap that suffice, whatever the share.
RUN = 13
BROADCAST = 1 << 20

#: Units that become a placeholder after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms ton tons "
    "oz lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years cent cents dollar dollars euro euros percent degree degrees hz khz mhz kw kwh w j v a k c f "
    "meter meters metre metres kilometer kilometers centimeter centimeters"
).split()
NUMBER, NAME, UNIT = (mix(np.array([k], np.uint64) + np.uint64(0xABCDEF))[0] for k in range(3))
#: Tells the hash of a window as written from that of a template.
WRITTEN = np.uint64(0x5851F42D4C957F2D)

_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LOWER = np.isin(np.arange(256), list(range(97, 123)))
_INNER = np.isin(np.arange(256), list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(0x80, 0xFF)))
_STOPS = np.isin(np.arange(256), list(b".!?:\n") + [SEP])


def _hash_of(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return Rolling(BYTE[LOWER[data]]).slices(np.array([0]), np.array([len(data)]))[0]


_UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in UNITS], np.uint64))


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of the Latin letters of ASCII and Latin-1."""
    low = LOWER[data]
    accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[1:][accented] += 0x20
    return low


def templates(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: template hash, hash as written (lower case), whether it is a placeholder, and its text."""
    start, end = b.words()
    # outer punctuation goes; words of punctuation alone stay as they are
    inner = np.flatnonzero(_INNER[b.data])
    left, right = np.searchsorted(inner, start), np.searchsorted(inner, end) - 1
    some = right >= left
    head, tail = start.copy(), end.copy()
    head[some], tail[some] = inner[left[some]], inner[right[some]] + 1
    value = Rolling(BYTE[_lower(b.data)]).slices(head, tail)
    owner = b.owner(start)
    digits, lower = b.prefix(_DIGIT), b.prefix(_LOWER)
    number = digits[tail] > digits[head]
    # the byte that ends the word before: a sentence's stop, or a line's or a text's end in between
    last = np.concatenate([[0], end[:-1] - 1]) if len(end) else end
    stops = b.prefix(_STOPS)
    opens = np.diff(owner, prepend=-1) != 0
    opens |= stops[start] > stops[last]
    name = ~number & _UPPER[b.data[np.minimum(head, len(b.data) - 1)]] & ~opens & (lower[tail] > lower[head])
    known = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    unit = _UNIT_HASHES[known] == value
    unit[1:] &= number[:-1] & (owner[1:] == owner[:-1])
    unit[:1] = False
    slot = number | name | unit
    template = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, value)))
    return template, value, slot, owner


def _windows(b: Block, window: int, whole: bool) -> tuple[np.ndarray, ...]:
    """First word, words, hash, text, place and form of every window; whole: shorter texts are one window.

    Forms: 0 a template, 1 as written where there is a template too, 2 as written alone.
    """
    template, value, slot, owner = templates(b)
    n = np.bincount(owner, minlength=b.n)
    begin = np.cumsum(n) - n
    at = np.arange(max(len(owner) - window + 1, 0))
    at = at[owner[at] == owner[at + window - 1]]
    size = np.full(len(at), window)
    if whole:
        short = np.flatnonzero((n > 0) & (n < window))
        at, size = np.concatenate([at, begin[short]]), np.concatenate([size, n[short]])
    written = mix(Rolling(value).slices(at, at + size) ^ WRITTEN)
    plain = np.concatenate([[0], np.cumsum(~slot)])
    enough = plain[at + size] - plain[at] >= np.minimum(PLAIN, size)
    key = np.concatenate([Rolling(template).slices(at[enough], at[enough] + size[enough]), written])
    form = np.concatenate([np.zeros(enough.sum(), np.int32), np.where(enough, 1, 2).astype(np.int32)])
    at, size = np.concatenate([at[enough], at]), np.concatenate([size[enough], size])
    return at, size, key, owner[at], at - begin[owner[at]], form, value, slot


def _rows(b: Block, window: int, whole: bool, keep: np.ndarray | None):
    at, size, key, owner, place, form, value, slot = _windows(b, window, whole)
    if keep is not None:
        hit = lookup(key, keep) < len(keep)
        at, size, key, owner, place, form = (x[hit] for x in (at, size, key, owner, place, form))
    slots = [value[a : a + n][slot[a : a + n]].view(np.int64).tolist() for a, n in zip(at.tolist(), size.tolist())]
    return owner, key, place, form, slots


def windows(table: DataFrame, identity: str, window: int = WINDOW, whole: bool = False, keep=None) -> DataFrame:
    """id, hash, place, form and the slots' values of the windows of each text; keep: broadcast hashes to look for."""
    fields = pa.schema(
        [("id", pa.int64()), ("hash", pa.int64()), ("place", pa.int32()), ("form", pa.int32()), ("slots", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column(0)
            for b in blocks(rows.column(1)):
                owner, key, place, form, slots = _rows(b, window, whole, keep.value if keep is not None else None)
                if len(owner):
                    yield batch(fields, [ids.take(pa.array(b.first + owner)), key.view(np.int64), place.astype(np.int32), form, slots])

    rows = table.select(F.col(identity).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, hash long, place int, form int, slots array<long>")


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, run: int = RUN, broadcast: int = BROADCAST
) -> DataFrame:
    """doc_id, item_id, windows (matched), item_windows, same (no slot differs): contaminated documents."""
    spark = docs.sparkSession
    items = cut_lineage(
        windows(benchmark.where("item_id is not null"), "item_id", window, whole=True).dropDuplicates(["id", "hash", "place"])
    )
    known = items.select("hash").distinct()
    keep = None
    if known.count() <= broadcast:
        keep = spark.sparkContext.broadcast(np.sort(known.toArrow().column("hash").to_numpy().view(np.uint64)))
    found = windows(docs.where("doc_id is not null"), "doc_id", window, whole=True, keep=keep).drop("form")
    size = items.groupBy(F.col("id").alias("item_id")).agg(
        F.countDistinct("place").alias("item_windows"), F.countDistinct(F.when(F.col("form") < 2, F.col("place"))).alias("item_typed")
    )
    asked = items.select(
        "hash", (F.col("form") > 0).alias("exact"), (F.col("form") < 2).alias("typed"), F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots")
    )
    # words as written have the item's values, also where the document's sentence tells names apart otherwise
    given = F.when(F.col("exact"), F.col("item_slots")).otherwise(F.col("slots"))
    met = found.join(asked, "hash").select(
        F.col("id").alias("doc_id"), "item_id", (F.col("place") - F.col("item_place")).alias("diagonal"), "item_place", "exact", "typed",
        F.explode_outer(F.arrays_zip(F.col("item_slots").alias("item"), given.alias("doc"))).alias("slot"),
    )
    met = met.select("doc_id", "item_id", "diagonal", "item_place", "exact", "typed", F.col("slot.item").alias("asked"), F.col("slot.doc").alias("given"))
    # used twice: without this the documents are read twice
    met = cut_lineage(met.groupBy(*(c for c in met.columns if c not in ("exact", "typed"))).agg(*[F.max(c).alias(c) for c in ("exact", "typed")]))
    occurrence = ["doc_id", "item_id", "diagonal"]
    values = met.groupBy(*occurrence, "asked").agg(
        F.min("given").alias("low"), F.max("given").alias("high"), F.max(~F.col("asked").eqNullSafe(F.col("given"))).alias("other")
    )
    steady = values.groupBy(*occurrence).agg(
        F.min(F.col("low").eqNullSafe(F.col("high"))).alias("consistent"), F.max("other").alias("other")
    )
    counted = (
        met.join(steady, occurrence)
        .where("consistent or exact")
        .groupBy(*occurrence, "item_place")
        .agg(F.min(~(F.col("other") & F.col("consistent"))).alias("same"), F.max("typed").alias("typed"))
    )
    # places of one run without a gap are as far from their ranks
    rank = F.row_number().over(Window.partitionBy(*occurrence).orderBy("item_place"))
    runs = counted.withColumn("run", F.col("item_place") - rank).groupBy(*occurrence, "run").agg(
        F.count("*").alias("length"), F.collect_list("item_place").alias("places"), F.min("same").alias("same"),
        F.collect_list(F.when(F.col("typed"), F.col("item_place"))).alias("typed"),
    )
    covered = (
        runs.groupBy("doc_id", "item_id")
        .agg(
            *[F.size(F.array_distinct(F.flatten(F.collect_set(c)))).alias(n) for c, n in (("places", "windows"), ("typed", "typed"))],
            F.max("length").alias("length"),
            F.min("same").alias("same"),
        )
        .join(size, "item_id")
    )
    # half of all windows, or of those that have a template: other values leave the rest of them without a match
    share = lambda n: F.when(n <= SHORT, n).otherwise(F.lit(cover) * n)
    enough = F.col("windows") >= share(F.col("item_windows"))
    enough |= (F.col("item_windows") > SHORT) & (F.col("typed") > 0) & (F.col("typed") >= share(F.col("item_typed")))
    return covered.where(enough | (F.col("length") >= max(1, run - window + 1))).select("doc_id", "item_id", F.col("windows").cast("long"), "item_windows", "same")


def clean(docs: DataFrame, benchmark: DataFrame, unnamed: bool = False, **options) -> DataFrame:
    """The documents that no item contaminates, all columns as they were; unnamed: also among rows without doc_id."""
    name = free(docs, "found")
    found = matches(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(found, F.col("doc_id").cast("long") == F.col(name), "left_anti")
    rest = docs.where("doc_id is null")
    if not unnamed or rest.isEmpty():
        return kept
    own = F.xxhash64(F.col("text").cast("string"))
    found = matches(rest.select(own.alias("doc_id"), "text").distinct(), benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return kept.where("doc_id is not null").unionByName(rest.join(found, own == F.col(name), "left_anti"))
