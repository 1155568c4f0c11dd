"""Runs of words that repeat with a period, found by matching blocks and extending them exactly.

A run of period q and at least three periods holds, for the power of two L with L <= q < 2 L, a block of L words that starts
at a multiple of L and occurs again q words on (L = 8 serves all periods under 16, as runs have 24 words or more). So the
aligned blocks of every scale L are the keys of an automaton that is searched over the document, and an occurrence at a
distance that fits the scale is a seed: it is extended to both sides as long as words one distance apart are equal.

A key is the sequence of a block's eight pieces of L / 8 words, and a piece's name is a number, equal for equal pieces, made by
pairing the names of its halves. So a key has eight numbers at any scale, and the document is searched as L / 8 sequences
of every (L / 8)th piece. Names of pieces that occur once are 0 and part the sequences. The same names, from long pieces to
short ones, give the exact length of an extension in as many steps as there are scales, for all seeds at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and periods that a run has at least.
LEAST, PERIODS = 24, 3
#: Pieces of a block.
PIECES = 8
#: Characters of text whose results are handed on at once (or one longer text's).
AT_ONCE = 1 << 22


def in_recurring(words: np.ndarray) -> np.ndarray:
    """Which words lie in a stretch of PIECES words that occurs again, and some more, as stretches are told apart by a hash. Words
    of a block and of what it is extended by do, so no run is lost by leaving the others out."""
    n, hashed = len(words) - PIECES + 1, words.astype(np.uint64) + np.uint64(1)
    total = hashed[:n].copy()
    for i in range(1, PIECES):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashed[i : n + i]
    ordered = np.sort(total)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    edges = np.zeros(len(words) + 1, np.int64)
    if len(again):
        at = np.flatnonzero(again[np.minimum(np.searchsorted(again, total), len(again) - 1)] == total)
        edges[at] += 1
        edges[at + PIECES] -= 1
    return np.cumsum(edges[:-1]) > 0


def piece_names(words: np.ndarray) -> list[np.ndarray]:
    """Per power of two, for every position (and one after the last) the name of the piece of so many words that starts there: equal
    for equal pieces, over 0; 0 for a piece that occurs once, passes the end or leaves ``in_recurring``. The list ends where no piece recurs."""
    n = len(words)
    at, names = np.flatnonzero(in_recurring(words)), np.zeros(n + 1, np.int64)
    _, name, count = np.unique(words[at], return_inverse=True, return_counts=True)
    names[at] = np.where(count[name] > 1, name + 1, 0)
    found, size = [], 1
    while names.any():
        found.append(names.astype(np.int32))
        at = np.flatnonzero(names[: max(0, n - size)])
        at = at[names[at + size] > 0]
        _, name, count = np.unique(names[at] * (n + 1) + names[at + size], return_inverse=True, return_counts=True)
        names = np.zeros(n + 1, np.int64)
        names[at] = np.where(count[name] > 1, name + 1, 0)
        size *= 2
    return found


def extended(names: list[np.ndarray], at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From words ``at`` that equal the words ``distance`` on: the first and the last + 1 of the words around them that do so."""
    n = len(names[0]) - 1
    low, high = at.copy(), at.copy()
    for k in range(len(names) - 1, -1, -1):
        size, own = 1 << k, names[k]
        left = np.maximum(low - size, 0)
        same = (low >= size) & (own[left] > 0) & (own[left] == own[left + distance])
        low -= np.where(same, size, 0)
        same = (own[high] > 0) & (own[high] == own[np.minimum(high + distance, n)])
        high += np.where(same, size, 0)
    return low, high


def seeds(names: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the aligned blocks of PIECES << k words, and distances at which they occur again that fit this scale."""
    import ahocorasick

    n, size = len(names[0]) - 1, 1 << k
    block = PIECES * size
    recurs = np.flatnonzero(names[k + PIECES.bit_length() - 1][: n - block + 1 : block]) * block
    ids: dict[tuple, int] = {}
    key_at = np.full(n // block + 1, -1)
    for at, key in zip(recurs.tolist(), names[k][recurs[:, None] + size * np.arange(PIECES)].tolist(), strict=True):
        key_at[at // block] = ids.setdefault(tuple(key), len(ids))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for key, i in ids.items():
        automaton.add_word(key, i)
    automaton.make_automaton()
    rows = -(-n // size)
    table = np.zeros((rows + 1) * size, np.int32)  # a row of zeros parts the sequences
    table[:n] = names[k][:n]
    flat = table.reshape(rows + 1, size).T.ravel()
    there = np.flatnonzero((flat > 0) | (np.concatenate(([0], flat[:-1])) > 0))
    hits = np.fromiter(automaton.iter(tuple(flat[there].tolist())), np.dtype((np.int64, 2)))
    if not len(hits):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, key = there[hits[:, 0]] - (PIECES - 1), hits[:, 1]
    place = first % (rows + 1) * size + first // (rows + 1)
    least = 1 if k == 0 else block  # nearest distance of this scale
    found = []
    for back in range(2 if k == 0 else 1):
        at = ((place - least) // block - back) * block
        fits = (at >= 0) & (place - at < 2 * block) & (place - at >= least)
        fits &= key_at[np.maximum(at, 0) // block] == key
        found.append((at[fits], (place - at)[fits]))
    return np.concatenate([a for a, _ in found]), np.concatenate([d for _, d in found])


def runs_of(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of the sequence of numbers ``words``, by start, then period."""
    n, found = len(words), []
    names = piece_names(words) if n >= LEAST else []
    for k in range(len(names) - PIECES.bit_length() + 1):
        if PERIODS * (PIECES << k) > max(n, LEAST):
            break
        at, distance = seeds(names, k)
        if len(at):
            low, high = extended(names, at, distance)
            long = high - low + distance >= np.maximum(LEAST, PERIODS * distance)
            found.append(np.unique(np.stack([low, high - low + distance, distance], 1)[long], axis=0))
    runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # a multiple of a run's period gives the same words: the least period counts
    again = (runs[1:, :2] == runs[:-1, :2]).all(axis=1)
    runs = runs[np.concatenate(([True], ~again))]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that are in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def strongest(runs: np.ndarray) -> dict | None:
    """The run with the greatest length / period; of equals the one with the smallest start, then period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best["period"] > best["length"] * period:
            best = {"start": start, "length": length, "period": period}
    return best


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, ``n_words`` (long), ``runs`` (array of start, length, period; numbers of words), ``strongest``
    (the run with the greatest length / period, null if there is none) and ``collapsed``, the words less all repetitions, with
    single blanks.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch of words with smallest period q that has at least 24 words and 3 q, and that
    no neighbouring word extends. A word goes if any run holds it after that run's first q words. Null and empty texts
    have no words, no runs and an empty ``collapsed``. Texts are taken whole: a text of n words takes 4 n bytes for each
    doubling up to its longest repeated passage. Repeated rows and null ids are rows like any other, further columns are
    left out, an empty table gives no rows. Nothing is shuffled.
    """
    import pyarrow as pa

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def batches(parts):
        for part in parts:
            out, size, first = [], 0, 0
            for row in range(part.num_rows):
                text = (part.column(1)[row].as_py() or "").encode()
                words = text.split()
                ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
                runs = runs_of(np.array([*map(ids.__getitem__, words)], np.int64))
                left = words if not len(runs) else [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                out.append((len(words), runs, b" ".join(left)))
                size += len(text)
                if size >= AT_ONCE or row + 1 == part.num_rows:
                    found = np.concatenate([x[1] for x in out])
                    offsets = pa.array(np.cumsum([0, *(len(x[1]) for x in out)]), pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(found[:, c], pa.int64()) for c in range(3)], fields=list(run)))
                    columns = [part.column(0)[first : row + 1], pa.array([x[0] for x in out], pa.int64()), lists, pa.array([strongest(x[1]) for x in out], run), pa.array([x[2].decode() for x in out], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "strongest", "collapsed"])
                    out, size, first = [], 0, row + 1

    one = "struct<start:bigint,length:bigint,period:bigint>"
    out = rows.mapInArrow(batches, f"id {kind}, n_words long, runs array<{one}>, strongest {one}, collapsed string")
    return out.withColumnRenamed("id", id_col)
