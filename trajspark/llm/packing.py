"""Best-fit packing: token pieces of documents into sequences of fixed capacity, in a tree of rounds.

Texts become token ids once, in tasks, and are cut into pieces that are written to the shared folder. The
sizes of the pieces are dealt over parts of bounded size; each part packs its own by best fit, largest
first. Sequences that are full or nearly so are final. The others are items of the next round, in which
neighbouring parts merge into fewer, and so on up the tree until one part is left or a round no longer
helps. Pieces are then joined to their places, tokens and all.

A null or empty text is one piece that holds only the end id. Rows with a null or repeated doc_id are
packed like any other; pieces are told apart by a key of their own. An empty table gives an empty result.
Other columns are ignored. Of items of one size the one with the smaller key goes first, and of the
sequences that fit one best the one opened or filled to that level last is taken.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.text import batch, texts
from trajspark.plans.scratch import cut_lineage, scratch_path

CAPACITY = 1024
#: Id that ends a document.
END = 2
#: Free tokens up to which a sequence counts as nearly full and takes part in no further round.
NEARLY = 2
#: Items that one task packs.
PART_ITEMS = 1 << 16
#: A round that leaves more than this share of its items as sequences is the last.
LEAST_GAIN = 0.8
#: Code points of a text that are encoded at a time.
SLICE = 1 << 20
OUT_BYTES = 1 << 22

# White space and signs that some engine may take for white space.
_BLANKS = "\\s\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff"
#: A blank before a word: byte-level vocabularies attach it to the word, so no token reaches over this place.
_CUT = re.compile(f"(?= [^{_BLANKS}])")
LONGEST = 1024
_LONG = re.compile(rf"\s{{{LONGEST}}}")

_PIECE = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
)
_PLACE = pa.schema([("id", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])


#: How byte-level tokenizers split a text before merging (fixed value).
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _ranked(tokenizer, file: dict):
    """The same byte-level merges as a table of ranks, which is several times faster; None for another kind."""
    import tiktoken

    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not file.get("normalizer") and before.get("type") == "ByteLevel"
    if not plain or before.get("add_prefix_space") or model.get("dropout"):
        return None
    # printable bytes stand for themselves, the others for the code points from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in file.get("added_tokens", [])}
    ranks = {bytes(map(byte.get, token)): i for token, i in model["vocab"].items() if token not in special}
    found = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    probe = "It's 12,345  words…\n\n\tnaïve Ünïcode 日本語テキスト 🙂 <|x|> 'tis   we'll\r\n"
    same = found.encode_ordinary(probe) == tokenizer.encode(probe, add_special_tokens=False).ids
    return found if same else None


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            self.ranks = _ranked(self.tokenizer, json.load(file))

    def _ids(self, text: str) -> bytes:
        # merging one long word or stretch of white space takes ranks quadratic time
        if self.ranks is None or max(map(len, text.split(" "))) > LONGEST or _LONG.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.frombuffer(array("I", ids), np.uintc).astype("<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            out.append(self._ids(text[at:end]))
            at = end
        return b"".join(out)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """key, doc_id, piece, start, length, ids: documents as token pieces; only the first may be short.

    ``ids`` holds little-endian 32-bit ids. ``key`` names a piece; it is stable once the result is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = Encoder(tokenizer), np.array([end], "<u4").tobytes()
        key = TaskContext.get().partitionId() << 36
        rows, size = [], 0
        for got in batches:
            for doc, text in zip(got.column(0).to_pylist(), got.column(1)):
                ids = encode(text.as_py() or "") + last
                total = len(ids) // 4
                first = total % capacity or capacity
                start = 0
                for piece, stop in enumerate(range(first, total + 1, capacity)):
                    rows.append((key, doc, piece, start, stop - start, ids[4 * start : 4 * stop]))
                    start, key = stop, key + 1
                size += len(ids)
                if size > OUT_BYTES:
                    yield batch(_PIECE, list(zip(*rows)))
                    rows, size = [], 0
        if rows:
            yield batch(_PIECE, list(zip(*rows)))

    rows = texts(docs)
    return rows.select(rows.doc_id.cast("long"), "text").mapInArrow(
        run, "key long, doc_id long, piece int, start long, length long, ids binary"
    )


def best_fit(size: np.ndarray, key: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin: best fit, largest items first.

    Open bins lie in stacks by their free room; the set bits of one number say which stacks hold any.
    """
    order = np.lexsort((key, -size))
    place, offset = [0] * len(size), [0] * len(size)
    room: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0
    for i, need in zip(order.tolist(), size[order].tolist()):
        fits = filled >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            at = stacks[free].pop()
            if not stacks[free]:
                filled ^= 1 << free
        else:
            free, at = capacity, len(room)
            room.append(0)
        place[i], offset[i] = at, capacity - free
        free -= need
        room[at] = free
        if free:
            if not stacks[free]:
                filled |= 1 << free
            stacks[free].append(at)
    return np.array(place, np.int64), np.array(offset, np.int64), capacity - np.array(room, np.int64)


def _round(items: DataFrame, number: int, capacity: int) -> DataFrame:
    """id, bin, offset, fill for items (id, size, part). A bin's number holds its round and its part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, size = table.column("id").to_numpy(), table.column("size").to_numpy()
        place, offset, fill = best_fit(size, ids, capacity)
        name = (number << 57) | (key[0].as_py() << 24)
        return pa.table([ids, name + place, offset, fill[place]], schema=_PLACE)

    return cut_lineage(items.groupBy("part").applyInArrow(run, "id long, bin long, offset long, fill long"))


def place(
    items: DataFrame, capacity: int = CAPACITY, nearly: int = NEARLY, part_items: int = PART_ITEMS
) -> DataFrame:
    """key, sequence_id, offset for items (key, size) with sizes from 1 to ``capacity``."""
    open_ = items.where(F.col("size") < capacity).select(F.col("key").alias("id"), "size")
    n = open_.count()
    parts = max(1, -(-n // part_items))
    open_ = open_.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    rounds = []
    while True:
        done = _round(open_, len(rounds), capacity)
        rounds.append(done)
        bins = done.groupBy("bin").agg(F.first("fill").alias("size")).where(F.col("size") < capacity - nearly)
        if parts == 1:
            break
        left = bins.count()
        if left > LEAST_GAIN * n or left < 2:
            break
        fewer = min(-(-left // part_items), parts - 1)
        part = F.shiftright(F.col("bin"), 24).bitwiseAND((1 << 33) - 1)
        open_ = bins.select(F.col("bin").alias("id"), "size", F.floor(part * fewer / parts).cast("long").alias("part"))
        parts, n = fewer, left
    moved = rounds[-1].select("id", "bin", "offset")
    for done in reversed(rounds[:-1]):
        up = moved.select(F.col("id").alias("bin"), F.col("bin").alias("outer"), F.col("offset").alias("shift"))
        moved = done.join(up, "bin", "left").select(
            "id", F.coalesce("outer", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
        )
    whole = items.where(F.col("size") == capacity).select(
        "key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return whole.unionByName(moved.select(F.col("id").alias("key"), F.col("bin").alias("sequence_id"), "offset"))


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, nearly: int = NEARLY, part_items: int = PART_ITEMS
) -> DataFrame:
    """Every piece with its tokens, its sequence and its place there."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    pieces(docs, tokenizer, capacity, end).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    places = place(rows.select("key", F.col("length").alias("size")), capacity, nearly, part_items)
    return rows.join(places, "key").drop("key")


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, doc_ids and ids (little-endian 32-bit) of each sequence of packed pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids", "length")))  # at most a capacity's worth
    return rows.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"),
    )


def digest(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
