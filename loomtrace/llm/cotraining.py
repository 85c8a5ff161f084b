"""Quality classifier (operator 2): co-training of two views.

One view is a document's content: the presence of hashed words, the shape of its characters and its lines. The
other is its page's metadata (METADATA: source, language, recorded length), of which nothing is read from the text. A
logistic model per view is fitted on labelled documents. In each round both views score every unlabelled document
in a distributed pass; those of which a view is confident are drawn from all of them, by a hash and in equal
numbers of either class, as pseudo-labelled documents from which the other view learns too. On labelled documents that neither
model has seen, each view's log-odds are calibrated and weights are fitted to combine them; then every document is scored.

Fitting uses bounded samples of labelled rows, chosen by hash: LABELLED documents with labels (a quarter of them for
calibration) and, per round, view and class, TAUGHT pseudo-labelled ones. All features of the samples are used. What is counted and
scored are all documents, over their whole texts.

A document is good if its quality label is 1 and it is not toxic; a null label counts as 0, and of repeated labels the
worst holds. Edge cases: null text counts as empty; null or missing metadata is a value of its own; documents with a null id are unlabelled;
rows of equal id and text are one document for the fit and get equal scores, also in ties; labels of documents that
are not there teach nothing; with fewer than two held-out or two fitted documents of a class there is no model, and every
document gets the share of good ones (1.0 without labels); a very long text is scored whole; an empty table gives no rows.
Extra columns are kept, whatever their names; those named like the results, in any case of letters, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log2
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, small, small_batches

LABELLED, TAUGHT = 16_000, 500
ROUNDS = 3
METADATA = ("source", "lang", "n_chars")
RESULTS = ("quality_score", "accepted")
#: Documents whose log-odds are summed at a time.
ODDS_BLOCK = 512
CONFIDENT = 0.97
WORD_BITS, META_BITS = 18, 12
ACCEPT = 0.5
#: Bytes of a word that count as its beginning.
START_BYTES = 4
#: Bytes of a text that are taken apart at a time.
STRETCH_BYTES = 1 << 16
_LETTERS, _CAPITALS, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_OTHER = bytes(sorted(set(range(33, 127)) - set(_LETTERS + _CAPITALS + _DIGITS)))
#: Capitals to small letters; blanks and ASCII marks to spaces.
_FOLD = bytes.maketrans(_CAPITALS + bytes(range(33)) + _OTHER, _LETTERS + b" " * (33 + len(_OTHER)))
_CLASSES = (bytes(sorted(set(_OTHER) - set(b".,;:!?'-"))), _CAPITALS, _DIGITS)
_RANDOM = np.random.RandomState(7)
_BYTES = _RANDOM.randint(1, 2**62, 256).astype(np.uint64)
_TURNS = _RANDOM.randint(1, 2**62, 64).astype(np.uint64) | np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _steps(name: str, value: float, width: float) -> bytes:
    return f"{name}={int(value / width)}".encode()


def _words(folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash of the beginning, and bytes of each word of a folded text, a stretch of whole words at a time."""
    found, low = [], 0
    while low < len(folded):
        high = len(folded)
        if high - low > STRETCH_BYTES:
            high = folded.rfind(b" ", low, low + STRETCH_BYTES) + 1 or folded.find(b" ", low + STRETCH_BYTES) + 1 or high
        data = np.frombuffer(folded, np.uint8, high - low, low)
        inside = np.nonzero(data != 32)[0]
        opens = np.nonzero(np.diff(inside, prepend=-2) > 1)[0]
        lengths = np.diff(opens, append=len(inside))
        offset = inside - np.repeat(inside[opens], lengths)
        parts = _BYTES[data[inside]] * _TURNS[offset & 63]
        if len(opens):
            found.append((np.add.reduceat(parts, opens), np.add.reduceat(np.where(offset < START_BYTES, parts, 0), opens), lengths))
        low = high
    none = np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def content_features(text: str | None) -> np.ndarray:
    """Feature numbers of the content view."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size, lines = max(1, len(raw)), raw.count(b"\n") + 1
    words, starts, lengths = _words(raw.translate(_FOLD))
    n, keep = max(1, len(words)), np.uint64(64 - WORD_BITS)
    seen, begun = np.unique((words * _SPREAD) >> keep), np.unique((starts * _SPREAD) >> keep)
    marks, capitals, digits = (len(raw) - len(raw.translate(None, chars)) for chars in _CLASSES)
    shape = [
        _steps("marks", min(marks / size, 0.3), 0.01), _steps("repeats", min((words[1:] == words[:-1]).sum() / n, 0.5), 0.02), _steps("kinds", len(seen) / n, 0.05),
        _steps("short", min((lengths < 2).sum() / n, 0.5), 0.02), _steps("capitals", min(capitals / size, 0.3), 0.01), _steps("digits", min(digits / size, 0.3), 0.01),
        _steps("length", size / n, 1.0), _steps("empty", not len(words), 1), _steps("size", log2(size), 1.0), _steps("lines", log2(lines), 1.0),
        _steps("line", log2(1 + size / lines), 0.5),
    ]
    shapes = np.unique([(2 << WORD_BITS) + (crc32(x) & 0xFFF) for x in shape])
    return np.concatenate([seen.astype(np.int64), begun.astype(np.int64) + (1 << WORD_BITS), shapes]).astype(np.int32)


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Feature numbers of the metadata view."""
    size = "none" if n_chars is None or n_chars != n_chars else str(int(log2(max(1, n_chars))))
    meta = [f"source={source}", f"lang={lang}", f"size={size}", f"lang-size={lang}-{size}", f"source-lang={source}-{lang}", f"source-size={source}-{size}"]
    return np.unique([crc32(m.encode("utf-8", "surrogatepass")) & ((1 << META_BITS) - 1) for m in meta]).astype(np.int32)


@dataclass
class View:
    """A logistic model over feature numbers: log-odds = bias + sum of weights."""

    weights: np.ndarray
    bias: float = 0.0

    def odds(self, rows: list[np.ndarray]) -> np.ndarray:
        found = np.zeros(len(rows))
        for low in range(0, len(rows), ODDS_BLOCK):  # to bound what is gathered at a time
            part = rows[low : low + ODDS_BLOCK]
            ends = np.cumsum([len(r) for r in part])
            sums = np.concatenate([[0.0], np.cumsum(self.weights[np.concatenate(part)])])
            found[low : low + len(part)] = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        return self.bias + found


def fit(rows: list[np.ndarray], good: np.ndarray, width: int, passes: int = 10, rate: float = 0.5, decay: float = 2e-4, batch: int = 128, start: float = 1e-2) -> View:
    """Logistic regression by AdaGrad over batches in a fixed order; documents of both classes weigh alike."""
    view, sums, at_bias = View(np.zeros(width)), np.full(width, start), 1e-6
    weight = np.where(good, 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9))
    order = np.random.RandomState(2)
    for _ in range(passes):
        turn = order.permutation(len(rows))
        for low in range(0, len(rows), batch):
            picked = turn[low : low + batch]
            part = [rows[i] for i in picked]
            off = (_sigmoid(view.odds(part)) - good[picked]) * weight[picked] / len(picked)
            step = np.bincount(np.concatenate(part), np.repeat(off, [len(r) for r in part]), width)
            at = np.nonzero(step)[0]
            change = step[at] + decay * view.weights[at]
            sums[at] += change * change
            view.weights[at] -= rate * change / np.sqrt(sums[at])
            at_bias += off.sum() ** 2
            view.bias -= rate * off.sum() / np.sqrt(at_bias)
    return view


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a small dense logistic regression (a column of ones is the last), by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
    return w


@dataclass
class Model:
    content: View | None
    meta: View | None
    calibration: list[np.ndarray]
    combine: np.ndarray
    flat: float

    def score(self, content: list[np.ndarray], meta: list[np.ndarray]) -> np.ndarray:
        """Probability that each document is good."""
        if self.content is None:
            return np.full(len(content), self.flat)
        return _sigmoid(_combined(self, content, meta))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _combined(m: Model, content: list[np.ndarray], meta: list[np.ndarray]) -> np.ndarray:
    odds = [np.clip(v.odds(r), -30, 30) * c[0] + c[1] for v, r, c in ((m.content, content, m.calibration[0]), (m.meta, meta, m.calibration[1]))]
    return odds[0] * m.combine[0] + odds[1] * m.combine[1] + m.combine[2]


_WIDTHS = ((2 << WORD_BITS) + 4096, 1 << META_BITS)


class CoTraining:
    """Two views over labelled documents, and what each has been taught by the other."""

    def __init__(self, content: list[np.ndarray], meta: list[np.ndarray], good: np.ndarray):
        self.rows, self.good = (content, meta), good
        self.held = np.arange(len(good)) % 4 == 3
        self.taught: tuple[list, list] = ([], [])  # per view: (feature numbers, label)
        self.share = float(good.mean()) if len(good) else 1.0
        counts = (good[self.held].sum(), (~good[self.held]).sum(), good[~self.held].sum(), (~good[~self.held]).sum())
        self.able = min(counts) >= 2

    def fit(self) -> Model:
        """Both views fitted and calibrated, and their combination."""
        if not self.able:
            return Model(None, None, [], np.zeros(3), self.share)
        held, views, scales, odds = np.nonzero(self.held)[0], [], [], []
        for rows, extra, width in zip(self.rows, self.taught, _WIDTHS, strict=True):
            fitted = [rows[i] for i in np.nonzero(~self.held)[0]] + [r for r, _ in extra]
            views.append(fit(fitted, np.concatenate([self.good[~self.held], np.array([g for _, g in extra], bool)]), width))
            odds.append(np.clip(views[-1].odds([rows[i] for i in held]), -30, 30))
            scales.append(logistic(odds[-1][:, None], self.good[held], 1.0))
        scaled = np.column_stack([o * c[0] + c[1] for o, c in zip(odds, scales, strict=True)])
        return Model(*views, scales, logistic(scaled, self.good[held], 1.0), self.share)

    def teach(self, view: int, rows: list[np.ndarray], good: np.ndarray) -> None:
        """Documents, in this view's features, that the other view is sure of."""
        self.taught[view].extend(zip(rows, good.tolist(), strict=True))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of picked documents, of rows of equal key the first in each task."""
    seen: set[int] = set()
    for rows in batches:
        rows = rows[~rows["key"].duplicated() & ~rows["key"].isin(seen)]
        seen.update(rows["key"].tolist())
        made = rows.drop(columns=["text", "source", "lang", "n_chars"])
        yield made.assign(
            content=[content_features(t).tobytes() for t in rows["text"]],
            meta=[meta_features(*m).tobytes() for m in zip(rows["source"], rows["lang"], rows["n_chars"], strict=True)],
        )


def _base(docs: DataFrame) -> DataFrame:
    """id, text, source, lang, n_chars and key (hash of id and text) of every row; what ``docs`` does not have is null."""
    held, name = numbered(docs)
    have = {c.lower() for c in docs.columns}
    source, lang, size = (F.col(name[m]).cast(t) if m in have else F.lit(None).cast(t) for m, t in zip(METADATA, ("string", "string", "double"), strict=True))
    return held.select(
        F.col(name["doc_id"]).alias("id"), F.col(name["text"]).alias("text"), source.alias("source"), lang.alias("lang"), size.alias("n_chars"),
        F.xxhash64(F.lit("co"), F.col(name["doc_id"]), F.col(name["text"])).alias("key"),
    )


def _drawn(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows of least key, without bringing more than about that many together."""
    total = rows.count()
    if total > 2 * n:  # keys are even, so this share holds n rows but for a chance below 1e-9
        share = (n + 6 * n**0.5 + 40) / total
        rows = rows.where(F.col("key") <= int(-(2**63) + share * 2**64))
    return rows.orderBy("key").limit(n)


def _features_of(base: DataFrame, picked: DataFrame, columns: str) -> pd.DataFrame:
    """Features of the documents of ``picked`` (at most LABELLED, or the pseudo-labelled ones of a round), in the order of their keys."""
    rows = base.drop("id").join(F.broadcast(picked), "key").mapInPandas(_read, f"key long, {columns}, content binary, meta binary")
    return rows.dropDuplicates(["key"]).toPandas().sort_values("key", kind="stable")


def _arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column]


def _confident(model: Model, confident: float):
    """For each unlabelled document of which a view is sure: per view 1 (good), 0 (bad) or null."""

    def sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = rows[["id", "key"]].astype({"id": "Int64"})
            odds = np.zeros((2, len(rows)))
            for low in range(0, len(rows), ODDS_BLOCK):  # to bound what is held at a time
                part = rows.iloc[low : low + ODDS_BLOCK]
                odds[0, low : low + len(part)] = model.content.odds([content_features(t) for t in part["text"]])
                odds[1, low : low + len(part)] = model.meta.odds([meta_features(*m) for m in zip(part["source"], part["lang"], part["n_chars"], strict=True)])
            for n, c in enumerate(model.calibration):
                p = _sigmoid(np.clip(odds[n], -30, 30) * c[0] + c[1])
                out[f"v{n}"] = pd.array(np.where(p >= confident, 1, 0), "Int64")
                out.loc[(p < confident) & (p > 1 - confident), f"v{n}"] = pd.NA
            yield out[out["v0"].notna() | out["v1"].notna()]

    return sure


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, taught: int = TAUGHT, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Model:
    small_batches(docs.sparkSession)
    held, name = numbered(labels)
    bad = (F.coalesce(F.col(name["quality"]), F.lit(0)) != 1) | (F.coalesce(F.col(name["toxic"]), F.lit(0)) != 0)
    known = materialise(held.where(F.col(name["doc_id"]).isNotNull()).groupBy(F.col(name["doc_id"]).alias("id")).agg((F.max(bad.cast("int")) == 0).cast("int").alias("good")))
    base = _base(docs)
    there = materialise(base.select("id", "key").join(small(known), "id").select("key", "good").dropDuplicates(["key"]))
    rows = _features_of(base, _drawn(there, labelled), "good int")
    work = CoTraining(_arrays(rows["content"]), _arrays(rows["meta"]), rows["good"].to_numpy().astype(bool))
    del rows
    model = work.fit()
    for turn in range(rounds if work.able else 0):
        sure = base.mapInPandas(_confident(model, confident), "id long, key long, v0 int, v1 int")
        free = materialise(sure.join(small(known.select("id")), "id", "left_anti").select("key", "v0", "v1").dropDuplicates(["key"]))
        used = F.pmod(F.xxhash64("key"), F.lit(rounds)) == turn  # each round draws from another part, so that none is drawn twice
        picks = [_drawn(free.where(used & (F.col(f"v{v}") == label)), taught).select("key", F.lit(1 - v).alias("view"), F.lit(label).alias("good")) for v in (0, 1) for label in (0, 1)]
        picked = reduce(DataFrame.unionAll, picks).groupBy("key").agg(F.collect_list(F.struct("view", "good")).alias("gets"))
        rows = _features_of(base, picked, "gets array<struct<view:int,good:int>>")
        content, meta = _arrays(rows["content"]), _arrays(rows["meta"])
        for view, each in enumerate((content, meta)):
            at = [(i, g["good"]) for i, gets in enumerate(rows["gets"]) for g in gets if g["view"] == view]
            work.teach(view, [each[i] for i, _ in at], np.array([g for _, g in at], bool))
        model = work.fit()
    return model


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, labelled: int = LABELLED, taught: int = TAUGHT, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with quality_score (probability of being good) and accepted."""
    model = train(docs, labels, labelled, taught, rounds)
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    held, name = numbered(docs)
    have = {c.lower() for c in docs.columns}
    source, lang, size = (F.col(name[m]).cast(t) if m in have else F.lit(None).cast(t) for m, t in zip(METADATA, ("string", "string", "double"), strict=True))
    scored = held.select(*[F.col(name[c]) for c in kept], _score_udf(model)(F.col(name["text"]), source, lang, size).alias("score"))
    return scored.select("*", F.col("score") >= accept).toDF(*kept, *RESULTS)


def _score_udf(model: Model):
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, *meta in batches:
            found = np.zeros(len(text))
            for low in range(0, len(text), ODDS_BLOCK):  # to bound what is held at a time
                part = slice(low, low + ODDS_BLOCK)
                found[part] = model.score([content_features(t) for t in text[part]], [meta_features(*m) for m in zip(*(x[part] for x in meta), strict=True)])
            yield pd.Series(found, dtype="float64")

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double").asNondeterministic()  # so that a filter on it does not compute it again
