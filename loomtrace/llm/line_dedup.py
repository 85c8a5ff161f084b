"""Line dedup (operator 9): winnowing over line hashes.

A document is its sequence of non-blank lines, each stripped and hashed. A window is ``run``
consecutive lines, or fewer that hold more than ``long_words`` words together, down to a single long line.

1. Sketch: of each window the line of least hash (the leftmost of equal ones) is selected. A document's fingerprints are
   its selected lines, each once, with their positions; two documents that share a window share its fingerprint.
2. Positions of one fingerprint meet: those that occur at one place only are let go, by a sieve and without a shuffle of rows.
3. Matches are extended from the fingerprint both ways, by up to ``run`` - 1 lines, to each window it was
   selected in. All positions with the same extension meet in one aggregate, which keeps the earliest and how many there are,
   never a pair; a window that stands earlier (in a smaller doc_id, or further up in its document) is a repeat.
4. Overlapping repeats add up to maximal runs of any length, and every line of a later run is deleted. Texts that lose
   nothing are not shuffled.

Lines are named by 64 bits and windows by 128 bits of their lines' text. Windows are judged on the input.

Edge cases: null text counts as empty; documents of fewer than ``run`` lines lose long windows only, and
nothing where ``long_words`` is None; null doc_ids come last; rows of equal doc_id are ordered by
their text's hash, and equal rows are one document, treated alike; blank lines stay; a document that is one very long line
is one window; an empty table gives no rows. All columns of the input are kept, whatever their names, but one named like
the report, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, materialise, numbered, sieved, small_batches

RUN = 3
#: Fewer lines than ``RUN`` are a repeat if they hold more words than this.
LONG_WORDS = 50
#: What is stripped from a line's ends before it is compared.
BLANKS = " \t\x0b\x0c\r"
REPORT = "line_report"
_BLANKS = BLANKS.encode()


#: A window in a fingerprint's row: its first line (by non-blank lines), its number of lines, its name.
_WINDOW = np.dtype([("at", np.int32), ("size", np.int32), ("one", np.int64), ("two", np.int64)])


def _named(h: np.ndarray, turn: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
    return h ^ (h >> np.uint64(29))


def fingerprints(texts: list[str], run: int = RUN, long_words: int | None = LONG_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The selected lines of texts: number of the text, hash, place among its non-blank lines, and the windows it was selected in."""
    lines, owner = [], []
    for i, text in enumerate(texts):
        found = [s for x in text.encode("utf-8", "surrogatepass").split(b"\n") if (s := x.strip(_BLANKS))]
        lines += found
        owner.append(len(found))
    n = len(lines)
    ends = np.cumsum(owner, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), owner)
    base = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)) if n else np.zeros(0, np.int64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, n)
    two = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, n)
    words = np.zeros(n, np.int64)
    if long_words is not None:
        most = (np.fromiter(map(len, lines), np.int64, n) + 1) // 2  # a line of b bytes has no more words
        around = np.convolve(most, np.ones(2 * run - 1, np.int64))[run - 1 : run - 1 + n] if n else most
        for i in np.nonzero(around > long_words)[0].tolist():
            words[i] = len(lines[i].split())
    cells, marks = [], []
    for size in range(run if long_words is None else 1, run + 1):
        at = np.arange(max(0, n - size + 1))
        at = at[owner[at] == owner[at + size - 1]]
        if size < run:
            at = at[sum(words[at + j] for j in range(size)) > long_words]
        names = [np.full(len(at), size, np.uint64), np.full(len(at), size, np.uint64)]
        chosen = at.copy()
        for j in range(size):
            names = [_named(_named(x, 1) + h[at + j], 2) for x, h in zip(names, (one, two), strict=True)]
            chosen = np.where(one[at + j] < one[chosen], at + j, chosen)
        cell = np.zeros(len(at), _WINDOW)
        cell["at"], cell["size"], cell["one"], cell["two"] = at - base[at], size, names[0].view(np.int64), names[1].view(np.int64)
        cells.append(cell)
        marks.append(chosen)
    cells, marks = np.concatenate(cells), np.concatenate(marks)
    order = np.argsort(marks, kind="stable")
    cells, marks = cells[order], marks[order]
    begin = np.nonzero(np.diff(marks, prepend=-1))[0]
    data, cuts = cells.tobytes(), (np.append(begin, len(marks)) * _WINDOW.itemsize).tolist()
    at = marks[begin]
    return owner[at], one[at].view(np.int64), (at - base[at]).astype(np.int32), [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _sketch(run: int, long_words: int | None):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            which, mark, line, windows = fingerprints(rows["text"].tolist(), run, long_words)
            yield rows[["last", "id", "th"]].iloc[which].astype({"id": "Int64"}).assign(mark=mark, line=line, windows=windows)

    return sketch


def _extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows around fingerprints that recur."""
    for rows in batches:
        cells = np.frombuffer(b"".join(rows["windows"]), _WINDOW)
        held = rows["windows"].str.len().to_numpy(np.int64) // _WINDOW.itemsize
        each = rows[["last", "id", "th"]].iloc[np.repeat(np.arange(len(rows)), held)].astype({"id": "Int64"})
        yield each.assign(at=cells["at"], size=cells["size"], one=cells["one"], two=cells["two"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """For every document that loses lines: id, th (hash of its text), gone (places of deleted lines among its non-blank ones)."""
    small_batches(docs.sparkSession)
    held, name = numbered(docs)
    text = F.coalesce(F.col(name[text_col]), F.lit(""))
    base = held.select(F.col(name[id_col]).isNull().alias("last"), F.col(name[id_col]).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    marked = materialise(base.mapInPandas(_sketch(run, long_words), "last boolean, id long, th long, mark long, line int, windows binary"))
    spot = F.struct("last", "id", "th", "line")
    shared = marked.groupBy("mark").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a != b")
    met, _ = sieved(marked, F.col("mark"), shared, F.col("mark"))  # what the sieve lets through wrongly is alone in its windows
    each = materialise(met.select("last", "id", "th", "windows").mapInPandas(_extend, "last boolean, id long, th long, at int, size int, one long, two long"))
    place = F.struct("last", "id", "th", "at")
    first = materialise(each.groupBy("one", "two").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a != b").select("one", "two", "a", "n"))
    later = join_keyed(each, first, ["one", "two"], "n", each.count()).where(place != F.col("a"))
    lines = later.select("id", "th", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("line"))
    return lines.groupBy("id", "th").agg(F.collect_set("line").alias("gone"))


def without(text: str, gone: np.ndarray) -> tuple[str, int, int, int]:
    """A text without some of its non-blank lines, its number of lines, and how many lines and runs of them went."""
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip(BLANKS)]
    lost = sorted(filled[k] for k in gone)
    dropped = set(lost)
    return "\n".join(x for i, x in enumerate(lines) if i not in dropped), len(lines), len(lost), sum(1 for i in lost if i - 1 not in dropped)


def _clean(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([without(t, g) for t, g in zip(text, gone, strict=True)], columns=["text", "n_lines", "n_removed", "n_runs"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """``docs`` with cleaned texts, and line_report: n_lines, n_removed, n_runs (maximal deleted runs of line numbers)."""
    kept = [c for c in docs.columns if c.lower() != REPORT]
    gone = materialise(repeated_lines(docs, id_col, text_col, run, long_words))
    held, name = numbered(docs)
    content = F.coalesce(F.col(name[text_col]), F.lit(""))
    held = held.withColumn("th", F.xxhash64(content)).withColumn("own", F.col(name[id_col]).cast("long"))
    touched, whole = sieved(held, F.xxhash64("own", "th"), gone, F.xxhash64("id", "th"))
    gone = gone.select(F.col("id").alias("other"), F.col("th").alias("other_th"), "gone")
    touched = touched.join(gone, F.col("own").eqNullSafe(F.col("other")) & (F.col("th") == F.col("other_th")), "left")
    clean = F.pandas_udf(_clean, "text string, n_lines long, n_removed long, n_runs long").asNondeterministic()  # so that a filter on it does not compute it again
    touched = touched.withColumn("done", clean(content, F.coalesce("gone", F.array().cast("array<int>"))))
    cleaned = F.when(F.col("gone").isNull(), F.col(name[text_col])).otherwise(F.col("done.text"))
    plain = F.struct(F.size(F.split(content, "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_runs"))

    def made(rows: DataFrame, text: Column, report: Column) -> DataFrame:
        return rows.select(*[text if name[c] == name[text_col] else F.col(name[c]) for c in kept], report).toDF(*kept, REPORT)

    return made(touched, cleaned, F.struct("done.n_lines", "done.n_removed", "done.n_runs")).unionAll(made(whole, F.col(name[text_col]), plain))
