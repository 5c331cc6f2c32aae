"""Quality rules: how much of a text lies inside n-grams and lines that it repeats.

Rolling hashes over the word hashes give every n-gram of several lengths in one pass each; a repeated
hash inside one text marks its words, and the marked words' characters are the coverage.

Null or empty texts have no words: every count is zero, ``base_failed`` is true, ``kept`` false. Repeated
rows are judged one by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trajspark.llm.text import BYTE, LEAD, SEP, Rolling, batch, blocks, firsts, later, mix, repeated, texts, totals

#: Largest share of a text's word characters that repeats of n-grams may hold, by n, and repeated lines.
SHARES = {5: 0.15, 7: 0.13, 10: 0.10}
LINE_SHARE = 0.20
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in _COUNTS + [f"dup_chars_{n}" for n in SHARES]]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def _covered(flags: np.ndarray, n: int) -> np.ndarray:
    """Words inside any flagged window of n words."""
    at = np.flatnonzero(flags)
    steps = np.bincount(at, minlength=len(flags) + n + 1) - np.bincount(at + n, minlength=len(flags) + n + 1)
    return np.cumsum(steps)[: len(flags)] > 0


def _measure(column: pa.Array) -> list[np.ndarray]:
    parts = []
    for b in blocks(column):
        chars = b.prefix(LEAD)
        raw = Rolling(BYTE[b.data])
        start, end = b.words()
        owner = b.owner(start)
        bounds = firsts(owner, b.n)
        size = chars[end] - chars[start]
        grams = Rolling(raw.slices(start, end))
        symbols = b.prefix(_SYMBOL)

        stop = np.flatnonzero((b.data == 10) | (b.data == SEP))
        begin = np.concatenate([[0], stop[:-1] + 1])
        whose = b.owner(begin)
        inside = np.zeros(len(b.data) + 1, np.int64)
        np.add.at(inside, end, size)
        inside = np.cumsum(inside)
        in_line = inside[stop] - inside[begin]
        key = mix(raw.slices(begin, stop) ^ mix(whose))
        filled = in_line > 0
        again = np.zeros(len(key), bool)
        again[filled] = later(key[filled], repeated(key[filled]))

        def windows(n):
            at = np.arange(max(len(start) - n + 1, 0))
            at = at[owner[at] == owner[at + n - 1]]
            return at, mix(grams.slices(at, at + n) ^ mix(owner[at]))

        def words_in(at, flags, n):
            marks = np.zeros(len(start), bool)
            marks[at[flags]] = True
            return _covered(marks, n)

        at, key3 = windows(3)
        part = [
            np.diff(bounds),
            totals(size, bounds),
            symbols[b.end] - symbols[b.start],
            np.bincount(whose[again], minlength=b.n),
            totals(words_in(at, repeated(key3), 3), bounds),
            np.bincount(whose, weights=in_line * again, minlength=b.n).astype(np.int64),
        ]
        for n in SHARES:
            at, key = windows(n)
            part.append(totals(size * words_in(at, later(key, repeated(key)), n), bounds))
        parts.append(part)
    return [np.concatenate(x) for x in zip(*parts)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if not rows.num_rows:
            continue
        m = _measure(rows.column(1))
        n_words, chars, repeat, lines = m[0], m[1], m[4], m[5]
        failed = (n_words < MIN_WORDS) | (100 * repeat > 50 * n_words)
        bad = lines > LINE_SHARE * chars
        for share, covered in zip(SHARES.values(), m[6:]):
            bad |= covered > share * chars
        yield batch(SCHEMA, [rows.column(0), *m, failed, ~failed & ~bad])


def repetition(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, its coverage in characters and the verdict."""
    spark_schema = ", ".join(
        f"{f.name} {'boolean' if f.type == pa.bool_() else 'long'}" for f in SCHEMA
    )
    rows = texts(docs)
    return rows.select(rows.doc_id.cast("long"), "text").mapInArrow(_run, spark_schema)


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t),
g AS (SELECT doc_id, i, length(w) AS cp, {grams} FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, cp,
        g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS f3,
        g5 IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g5 ORDER BY i) > 1 AS f5,
        g7 IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g7 ORDER BY i) > 1 AS f7,
        g10 IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g10 ORDER BY i) > 1 AS f10 FROM g),
c AS (SELECT doc_id, cp, {cover} FROM f),
words AS (SELECT doc_id, count(*) AS n_words, sum(cp) AS word_chars, count(*) FILTER (c3) AS n_repeat_words,
        coalesce(sum(cp) FILTER (c5), 0) AS d5, coalesce(sum(cp) FILTER (c7), 0) AS d7,
        coalesce(sum(cp) FILTER (c10), 0) AS d10 FROM c GROUP BY 1),
l AS (SELECT doc_id, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS cp,
        row_number() OVER (PARTITION BY doc_id, line) > 1 AS again
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lines AS (SELECT doc_id, count(*) AS n, sum(cp) AS cp FROM l WHERE again GROUP BY 1),
a AS (SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        coalesce(lines.n, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(lines.cp, 0) AS dup_line_chars, coalesce(d5, 0) AS dup_chars_5,
        coalesce(d7, 0) AS dup_chars_7, coalesce(d10, 0) AS dup_chars_10
      FROM t LEFT JOIN words USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  dup_line_chars::BIGINT AS dup_line_chars, dup_chars_5::BIGINT AS dup_chars_5,
  dup_chars_7::BIGINT AS dup_chars_7, dup_chars_10::BIGINT AS dup_chars_10, base_failed,
  NOT base_failed AND dup_line_chars <= 0.20::DOUBLE * word_chars AND dup_chars_5 <= 0.15::DOUBLE * word_chars
    AND dup_chars_7 <= 0.13::DOUBLE * word_chars AND dup_chars_10 <= 0.10::DOUBLE * word_chars AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
""".format(
    grams=", ".join(
        " || ' ' || ".join(["w"] + [f"lead(w, {k}) OVER p" for k in range(1, n)]) + f" AS g{n}" for n in (3, *SHARES)
    ),
    cover=", ".join(
        f"max(f{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"
        for n in (3, *SHARES)
    ),
)
