"""Quality rules on repetition: suffix arrays of words within each text.

Every text's words get a suffix array (prefix doubling, all texts of a block
at once; texts never compare equal across documents because the first rank
holds the document too).  The longest common prefix of neighbours in suffix
order gives the LCP intervals.  For a word position the deepest interval that
holds it starts the longest maximal repeat there, so the union of the spans
``[i, i + longest[i])`` is the union of all maximal repeats' occurrences.  A
text fails when that union covers too large a share of its words, or when its
longest repeat is too long a share of it.

Edge cases: a null or empty text has no words and fails the base rule; a text
shorter than the shortest repeat has no repeat; ties do not arise (a document
is judged alone); repeated rows get equal verdicts; an empty table gives an
empty result; further columns are passed through untouched, and result
columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.text_bytes import Block, blocks, mix

#: symbols counted by the base rule
SYMBOLS = "#*$%&|<>"
MIN_REPEAT = 5  # words of the shortest repeat that counts
MAX_COVERED = 0.45  # share of words inside repeats
MAX_LONGEST = 0.25  # longest repeat as a share of the words
LEAST_LONGEST = 50  # ... and at least this many words

SIGNALS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long"
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _groups(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def longest_repeats(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word position the length of the longest prefix of its suffix
    that occurs elsewhere in the same text.

    ``keys``: one integer per word, equal only for equal words of one text;
    ``ends``: for each word the position just past its text's last word.
    """
    n = len(keys)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    head = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    sizes = np.repeat(np.diff(np.append(head, n)), np.diff(np.append(head, n)))
    active = order[sizes > 1]  # positions whose order is still open
    levels, span = [rank.copy()], 1
    while len(active):
        nxt = active + span
        second = np.where(nxt < ends[active], rank[np.minimum(nxt, n - 1)], -1)
        place = np.lexsort((second, rank[active]))
        active, second = active[place], second[place]
        first = rank[active]
        new_group = np.concatenate(([True], first[1:] != first[:-1]))
        new_run = new_group | np.concatenate(([True], second[1:] != second[:-1]))
        at = np.arange(len(active))
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        run_at = np.maximum.accumulate(np.where(new_run, at, 0))
        rank[active] = first + (run_at - group_at)
        runs = np.flatnonzero(new_run)
        lengths = np.diff(np.append(runs, len(active)))
        active = active[np.repeat(lengths, lengths) > 1]
        span *= 2
        levels.append(rank.copy())
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    # Longest common prefix of neighbours in suffix order: equal ranks of
    # level t mean that 2**t words agree.
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    lcp = np.zeros(n - 1, dtype=np.int64)
    for t in range(len(levels) - 1, -1, -1):
        step, level = 1 << t, levels[t]
        inside = (a < ends[suffixes[:-1]]) & (b < ends[suffixes[1:]])
        hit = inside & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)])
        lcp += step * hit
        a += step * hit
        b += step * hit
    deepest = np.zeros(n, dtype=np.int64)
    deepest[:-1] = lcp
    deepest[1:] = np.maximum(deepest[1:], lcp)
    out = np.empty(n, dtype=np.int64)
    out[suffixes] = deepest
    return out


def block_signals(block: Block, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Repetition and base signals, one value per text of the block."""
    starts, ends, row = block.words
    n_words = block.count(row).astype(np.int64)
    inside = np.zeros(len(block.data) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    letters = in_word & ((block.data & 0xC0) != 0x80)  # first bytes of code points
    seed = mix(row.astype(np.uint64) + np.uint64(1))
    hashes = block.hashes(starts, ends)
    keys = mix(hashes + seed)

    line_s, line_e, line_row = block.lines
    filled = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(in_word, out=filled[1:])
    with_word = filled[line_e] > filled[line_s]
    line_s, line_e, line_row = line_s[with_word], line_e[with_word], line_row[with_word]
    line_keys = mix(block.hashes(line_s, line_e) + mix(line_row.astype(np.uint64) + np.uint64(1)))

    total = len(keys)
    last = np.cumsum(n_words)[row] if total else np.zeros(0, np.int64)
    covered3 = np.zeros(total, dtype=bool)
    if total >= 3:
        window = mix(mix(keys[:-2]) + keys[1:-1]) * np.uint64(31) + keys[2:]
        whole = np.flatnonzero(row[2:] == row[:-2])
        twice = whole[_groups(window[whole])]
        for k in range(3):
            covered3[twice + k] = True

    longest = longest_repeats(keys, last)
    longest[longest < min_repeat] = 0
    at = np.flatnonzero(longest)
    cover = np.zeros(total + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + longest[at], -1)
    covered = np.cumsum(cover[:-1]) > 0
    deepest = np.zeros(block.rows, dtype=np.int64)
    np.maximum.at(deepest, row, longest)
    return {
        "n_words": n_words,
        "word_chars": block.per_row(letters),
        "n_symbols": block.per_row(_SYMBOL[block.data]),
        "n_dup_lines": block.count(line_row, _later(line_keys)).astype(np.int64),
        "n_repeat_words": block.count(row, covered3).astype(np.int64),
        "covered_words": block.count(row, covered).astype(np.int64),
        "longest_repeat": deepest,
    }


def repetition_signals(
    docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT
) -> DataFrame:
    """``docs`` plus the columns of ``SIGNALS``, from whole texts."""
    names = [f.split()[0] for f in SIGNALS.split(", ")]
    text_at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(docs.columns) if c not in names]
    schema = docs.select(*[docs.columns[i] for i in kept]).schema
    for f in SIGNALS.split(", "):
        schema = schema.add(*f.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [block_signals(b, min_repeat) for b in blocks(batch.column(text_at))]
            if parts:
                columns = [batch.column(i) for i in kept]
                columns += [pa.array(np.concatenate([p[c] for p in parts])) for c in names]
                yield pa.RecordBatch.from_arrays(
                    columns, names=[batch.schema.names[i] for i in kept] + names
                )

    return docs.mapInArrow(run, schema)


def judge_quality(
    docs: DataFrame,
    text_col: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: float = MAX_LONGEST,
    least_longest: int = LEAST_LONGEST,
) -> DataFrame:
    """``docs`` plus signals, ``base_failed`` and ``kept``."""
    out = repetition_signals(docs, text_col, min_repeat)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeats = (F.col("covered_words") > max_covered * F.col("n_words")) | (
        (F.col("longest_repeat") >= least_longest)
        & (F.col("longest_repeat") > max_longest * F.col("n_words"))
    )
    return out.withColumns({"base_failed": base, "kept": ~(base | repeats)})
