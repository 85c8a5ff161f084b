"""Suffix-array dedup (operator 6): a run-length index over repeated passages.

Every byte that is covered by a string of ``length`` bytes which also starts in a document of smaller
id is removed; strings are judged on the input and never cross documents.

1. Documents are dealt into batches by hash. In each window of ``length`` bytes the least hash of a GRAM is its
   anchor; equal windows have equal anchors. Batches send each distinct anchor once, with its least document.
2. Anchors of one document only are let go. Each other anchor gets a shard, that of its first document, so
   a copied passage stays whole; a document whose passages would fill more than a shard is dealt by anchor too.
3. Each batch cuts its documents into segments of windows that go to one shard. Equal segments are sent once.
4. A shard builds a run-length index over its segments, in order of document: the Burrows-Wheeler transform of its
   suffixes (sorted by their first ``length`` bytes, then by place) in runs, with samples at run ends only. Matching statistics
   (how many bytes match, and where) are streamed from the samples against the direction of the text. A match of
   ``length`` bytes leads to the nearest earlier equal window; following matches inside a document, it is seen whether one
   stands in a smaller document, and long matches are marked.
5. Each document's matches are joined, and its bytes that stay are hashed.

Hashes only decide where windows meet: what is removed is equal byte for byte, and equal windows always meet.

Edge cases: null text is empty; documents shorter than ``length`` lose nothing; a null id counts as larger than
all others, and rows of equal id do not remove from each other; repeated rows give equal results; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, small_batches

LENGTH = 50
GRAM = 24
BATCH_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
#: Anchors of one hash range that are compared at a time.
RANGE_ANCHORS = 1 << 20
LAST = np.iinfo(np.int64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def packed8(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number, first byte highest."""
    out = data.astype(np.uint64)
    for step in (1, 2, 4):
        out = (out[: max(0, len(out) - step)] << np.uint64(8 * step)) | out[step:]
    return out


def window_anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For every window of ``length`` bytes, the least hash of its grams (even numbers)."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    eight = packed8(data)
    n = len(data) - gram + 1
    least = eight[:n].copy()
    for at in range(8, gram - 7, 8):
        least = _mixed(least) + eight[at : at + n]
    least = _mixed(least) & ~np.uint64(1)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.concatenate([[0], np.nonzero(values[1:] != values[:-1])[0] + 1]) if len(values) else np.zeros(0, np.int64)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform over segments, with sampled run ends.

    Suffixes (of the places that start a whole window) are sorted by their first ``length`` bytes, then by place. A run is a
    stretch of neighbours that have one byte before them and whose rows, one byte earlier, are neighbours again. So the
    neighbour of a place moves on with the text, and their common length grows by one per byte, except at run ends: only
    there the neighbour and the common length (to ``length`` at most) are sampled. Nothing else of the sort is kept.
    """

    def __init__(self, segments: list[bytes], length: int = LENGTH):
        self.length = length
        sizes = np.array([len(s) for s in segments], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(segments), np.uint8)
        inside = np.ones(len(self.data), bool)
        for back in range(1, length):
            ends = self.starts + sizes - back
            inside[ends[ends >= self.starts]] = False
        self.places = np.nonzero(inside)[0]
        order = self._sorted()
        n = len(order)
        self.run_heads, self.run_starts = np.zeros(0, np.int16), np.zeros(0, np.int64)
        self.samples, self.neighbours, self.common = (np.zeros(0, np.int64) for _ in range(3))
        if not n:
            return
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        opens = np.zeros(len(self.data) + 1, bool)
        opens[self.starts] = True
        first = opens[self.places[order]]  # windows at the start of a segment have no byte before them
        transform = np.where(first, -1, self.data[self.places[order] - 1].astype(np.int16))
        back = np.where(first, -1, row[np.maximum(order - 1, 0)])
        ends = np.ones(n, bool)
        ends[1:] = (transform[1:] != transform[:-1]) | first[1:] | (back[1:] != back[:-1] + 1)
        self.run_starts = np.nonzero(ends)[0]
        self.run_heads = transform[self.run_starts]
        # what is one byte before a run end, and the last window of each segment, cannot be told from the window after it
        last = np.ones(n, bool)
        last[:-1] = np.diff(self.places) != 1
        heads = self.run_starts[~first[self.run_starts]]
        sampled = last
        sampled[order[heads] - 1] = True
        self.samples = np.nonzero(sampled)[0]
        at = row[self.samples]
        self.neighbours = np.where(at > 0, order[np.maximum(at - 1, 0)], -1)
        self.common = self._common(self.samples, self.neighbours)

    def _sorted(self) -> np.ndarray:
        """Windows in the order of their bytes, then of their places, by doubling from packed bytes."""
        rank, have = packed8(self.data), 8
        if not len(self.places):
            return np.zeros(0, np.int64)
        while True:
            step = min(have, self.length - have)
            rank = self._number(rank)
            if have + step >= self.length:
                return np.argsort(rank[self.places] * np.uint64(len(rank) + 1) + rank[self.places + step], kind="stable")
            n = max(0, len(rank) - step)
            rank, have = rank[:n] * np.uint64(len(rank) + 1) + rank[step:], have + step

    @staticmethod
    def _number(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ranked = keys[order]
        rank = np.zeros(len(keys), np.uint64)
        if len(keys):
            rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]).astype(np.uint64)
        return rank

    def _common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Bytes (``length`` at most) that windows have in common; 0 where there is no other."""
        found = np.zeros(len(one), np.int64)
        live = np.nonzero(other >= 0)[0]
        for k in range(self.length):
            live = live[self.data[self.places[one[live]] + k] == self.data[self.places[other[live]] + k]]
            if not len(live):
                break
            found[live] += 1
        return found

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(matched bytes, window they match) for each window, streamed from the sampled run ends toward the start of the text.

        The window matched is the one before it in sorted order: of equal windows, the one next before it in the text.
        """
        n = len(self.places)
        nearest = np.searchsorted(self.samples, np.arange(n))  # the next sample at or after each window
        away = self.samples[nearest] - np.arange(n) if n else np.zeros(0, np.int64)
        return np.minimum(self.common[nearest] + away, self.length), np.where(self.neighbours[nearest] >= 0, self.neighbours[nearest] - away, -1)

    def segment(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def repeats(segments: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(segment, start, end) of what also starts in a segment of smaller document; ``docs`` must not fall."""
    distinct: dict[bytes, int] = {}
    chosen, out = [], []
    for i, s in enumerate(segments):
        if (j := distinct.setdefault(s, i)) == i:
            chosen.append(i)
        elif docs[j] < docs[i]:
            out.append((i, 0, len(s)))
    copies: dict[int, list[int]] = {}  # copies in the first one's own document share its matches
    for i, s in enumerate(segments):
        if (j := distinct[s]) != i and docs[j] == docs[i]:
            copies.setdefault(j, []).append(i)
    index = RunLengthIndex([segments[i] for i in chosen], length)
    matched, source = index.statistics()
    places, own = index.places, index.segment(index.places)
    ids = docs[np.array(chosen, np.int64)][own] if chosen else docs[:0]
    met = matched >= length
    # matches lead from window to window toward smaller documents; those in one document are skipped
    inner = np.arange(len(places))
    same = np.nonzero(met)[0]
    same = same[ids[source[same]] == ids[same]]
    inner[same] = source[same]
    while len(same):
        onward = inner[inner[same]]
        same, onward = same[onward != inner[same]], onward[onward != inner[same]]
        inner[same] = onward
    hit = met[inner]
    places, own = places[hit], own[hit]
    if len(places):
        opens = np.concatenate([[True], (np.diff(places) > length) | (np.diff(own) > 0)])
        begin = np.nonzero(opens)[0]
        end = np.concatenate([begin[1:], [len(places)]]) - 1
        for seg, a, b in zip(own[begin].tolist(), places[begin].tolist(), places[end].tolist(), strict=True):
            low = int(index.starts[seg])
            for i in (chosen[seg], *copies.get(chosen[seg], ())):
                out.append((i, a - low, b - low + length))
    return out


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one string of bytes, equal places of all numbers together so that they compress."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a, a.dtype if a.dtype.itemsize == 8 else np.int64)
        out += [np.array([len(a)], np.int64).tobytes(), a.view(np.uint8).reshape(-1, 8).T.tobytes()]
    return b"".join(out)


def _unblob(data: bytes) -> list[np.ndarray]:
    out, at = [], 8
    for _ in range(int(np.frombuffer(data, np.int64, 1)[0])):
        n = int(np.frombuffer(data, np.int64, 1, at)[0])
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at + 8).reshape(8, n).T).view(np.int64).reshape(n))
        at += 8 + 8 * n
    return out


def _bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as compressed bundles by batch number."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for rows in batches:
        out = []
        for b, part in rows.groupby("b", sort=False):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"]]
            keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)
            head = _blob(part["id"].fillna(LAST).to_numpy(np.int64) if part["id"].isna().any() else part["id"].to_numpy(np.int64), part["id"].isna().to_numpy(np.int64), keys, np.array([len(t) for t in texts], np.int64))
            out.append((b, squeeze.compress(np.array([len(head)], np.int64).tobytes() + head + b"".join(texts))))
        yield pd.DataFrame(out, columns=["b", "bundle"])


def _documents(bundles: pd.Series) -> Iterator[tuple[int, bool, int, bytes]]:
    """(id, whether null, key, bytes) of the documents in bundles."""
    for data in bundles:
        raw = zstandard.ZstdDecompressor().decompress(data)
        size = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, nulls, keys, sizes = _unblob(raw[8 : 8 + size])
        at = 8 + size
        for i, none, key, n in zip(ids.tolist(), nulls.tolist(), keys.tolist(), sizes.tolist(), strict=True):
            yield i, bool(none), key, raw[at : at + n]
            at += n


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _sketch(length: int, ranges: int):
    def sketch(bundles: pd.DataFrame) -> pd.DataFrame:
        anchors, owners = [], []
        for i, _, _, text in _documents(bundles["bundle"]):
            least = window_anchors(_bytes(text), length)
            found = np.unique(least[_runs(least)])
            anchors.append(found)
            owners.append(np.full(len(found), i, np.int64))
        anchor = np.concatenate([*anchors, np.zeros(0, np.uint64)])
        owner = np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        order = order[np.argsort(anchor[order], kind="stable")]
        anchor, owner = anchor[order], owner[order]
        starts = _runs(anchor)
        ends = np.concatenate([starts[1:], [len(anchor)]]) - 1 if len(starts) else starts
        several = owner[starts] != owner[ends] if len(starts) else np.zeros(0, bool)
        anchor, owner = anchor[starts] | several.astype(np.uint64), owner[starts]
        part = (anchor >> np.uint64(32)) % np.uint64(ranges)
        out, b = [], int(bundles["b"].iloc[0])
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(ranges + 1, dtype=np.uint64))
        for r in range(ranges):
            at = order[cuts[r] : cuts[r + 1]]
            if len(at):
                base = int(owner[at].min())
                out.append((r, b, anchor[at].tobytes(), _blob(owner[at] - base), base))
        return pd.DataFrame(out, columns=["r", "b", "anchors", "owners", "base"])

    return sketch


def _route(ranges: int, shards: int, length: int):
    step = (length - GRAM + 2) // 2  # bytes from one anchor to the next, as a rule

    def route(rows: pd.DataFrame) -> pd.DataFrame:
        counts = [len(a) // 8 for a in rows["anchors"]]
        marked = np.concatenate([np.frombuffer(a, np.uint64) for a in rows["anchors"]])
        owner = np.concatenate([_unblob(o)[0] + int(base) for o, base in zip(rows["owners"], rows["base"], strict=True)])
        batch = np.repeat(np.arange(len(rows)), counts)
        anchor, several = marked & ~np.uint64(1), (marked & np.uint64(1)).astype(bool)
        order = np.argsort(anchor, kind="stable")
        anchor, owner, several, batch = anchor[order], owner[order], several[order], batch[order]
        starts = _runs(anchor)
        sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
        shared = (sizes > 1) | np.maximum.reduceat(several.astype(np.int8), starts).astype(bool)
        first = np.minimum.reduceat(owner, starts)
        # the bytes that would go to the shard of one document, as seen in this range of anchors
        which, place = np.unique(first[shared], return_inverse=True)
        load = np.bincount(place, sizes[shared], len(which)) * step * ranges
        pieces = np.maximum(1, np.ceil(load / SHARD_BYTES)).astype(np.uint64)
        target = np.zeros(len(starts), np.int64)
        mixed = _mixed(first[shared].astype(np.uint64) + np.uint64(1)) + (anchor[starts][shared] >> np.uint64(1)) % pieces[place]
        target[shared] = (_mixed(mixed) % np.uint64(shards)).astype(np.int64)
        target, shared = np.repeat(target, sizes), np.repeat(shared, sizes)
        anchor, target, batch = anchor[shared], target[shared], batch[shared]
        out, names = [], rows["b"].tolist()
        order = np.argsort(batch, kind="stable")
        cuts = np.searchsorted(batch[order], np.arange(len(rows) + 1))
        for k, name in enumerate(names):
            at = order[cuts[k] : cuts[k + 1]]
            if len(at):
                out.append((name, anchor[at].tobytes(), _blob(target[at])))
        return pd.DataFrame(out, columns=["b", "anchors", "targets"])

    return route


def _cut(length: int):
    columns = ["b", "shard", "segments", "about", "id", "key", "spans"]

    def cut(bundles: pd.DataFrame, routes: pd.DataFrame) -> pd.DataFrame:
        if not len(bundles) or not len(routes):
            return pd.DataFrame([], columns=columns)
        anchor = np.concatenate([np.frombuffer(a, np.uint64) for a in routes["anchors"]])
        target = np.concatenate([_unblob(t)[0] for t in routes["targets"]])
        order = np.argsort(anchor)
        anchor, target = anchor[order], target[order]
        held: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        for i, _, key, text in _documents(bundles["bundle"]):
            least = window_anchors(_bytes(text), length)
            if not len(least):
                continue
            starts = _runs(least)
            near = np.minimum(np.searchsorted(anchor, least[starts]), len(anchor) - 1)
            goes = np.where(anchor[near] == least[starts], target[near], -1)
            merged = _runs(goes)
            starts, goes = starts[merged], goes[merged]
            ends = np.concatenate([starts[1:], [len(least)]]) + length - 1
            for a, b, shard in zip(starts.tolist(), ends.tolist(), goes.tolist(), strict=True):
                if shard >= 0:
                    held.setdefault((shard, text[a:b]), []).append((i, key, a))
        sent: dict[int, list[tuple[bytes, int, int, int]]] = {}
        gone: dict[tuple[int, int], list[int]] = {}
        for (shard, content), where in held.items():
            low = min(where)[0]
            for i, key, a in where:
                if i == low:
                    sent.setdefault(shard, []).append((content, i, key, a))
                else:  # the whole segment starts in a smaller document of this batch
                    gone.setdefault((i, key), []).extend((a, a + len(content)))
        out, b = [], int(bundles["b"].iloc[0])
        for shard, each in sent.items():
            contents, ids, keys, places = zip(*each, strict=True)
            about = _blob(np.array([len(c) for c in contents]), np.array(ids, np.int64), np.array(keys, np.int64), np.array(places, np.int64))
            out.append((b, shard, zstandard.compress(b"".join(contents), 1), about, None, None, None))
        out += [(b, None, None, None, i, key, spans) for (i, key), spans in gone.items()]
        made = pd.DataFrame(out, columns=columns, dtype=object)  # numbers beside nulls must not turn into floats
        return made.astype({c: "Int64" for c in ("b", "shard", "id", "key")})

    return cut


def _mark(length: int):
    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        segments, ids, keys, places, batches = [], [], [], [], []
        for b, data, about in zip(rows["b"], rows["segments"], rows["about"], strict=True):
            raw, (sizes, i, k, p), at = zstandard.decompress(data), _unblob(about), 0
            for n in sizes.tolist():
                segments.append(raw[at : at + n])
                at += n
            ids.append(i), keys.append(k), places.append(p), batches.append(np.full(len(i), b, np.int64))
        i, k, p, b = map(np.concatenate, (ids, keys, places, batches))
        order = np.lexsort([p, k, i])
        segments, i, k, p, b = [segments[o] for o in order], i[order], k[order], p[order], b[order]
        gone: dict[tuple[int, int, int], list[int]] = {}
        for s, low, high in repeats(segments, i, length):
            gone.setdefault((int(b[s]), int(i[s]), int(k[s])), []).extend((int(p[s]) + low, int(p[s]) + high))
        return pd.DataFrame([(*at, spans) for at, spans in gone.items()], columns=["b", "id", "key", "spans"])

    return mark


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _finish(bundles: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    gone: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, key, spans in zip(marks["id"], marks["key"], marks["spans"], strict=True):
        flat = [int(x) for x in spans]
        gone.setdefault((int(i), int(key)), []).extend(zip(flat[::2], flat[1::2], strict=True))
    out = []
    for i, none, key, text in _documents(bundles["bundle"]):
        runs, kept, at = union(gone.get((i, key), [])), [], 0
        for a, b in runs:
            kept.append(text[at:a])
            at = b
        rest = b"".join([*kept, text[at:]])
        out.append((None if none else i, len(text), len(text) - len(rest), [x for r in runs for x in r], rest))
    made = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "spans", "kept"])
    made["id"] = pd.array([o[0] for o in out], dtype="Int64")
    return made


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (starts and ends of removed runs, flat), kept (bytes) for every row."""
    small_batches(docs.sparkSession)
    docs, name = numbered(docs)
    text = F.coalesce(F.col(name[text_col]), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches, shards = max(1, -(-total // BATCH_BYTES)), max(1, -(-total // SHARD_BYTES))
    ranges = max(1, -(-total // ((length - GRAM + 2) // 2 * RANGE_ANCHORS)))
    place = F.pmod(F.xxhash64(F.col(name[id_col]), F.xxhash64(text)), F.lit(batches)).alias("b")
    bundles = docs.select(F.col(name[id_col]).cast("long").alias("id"), place, text.alias("text")).mapInPandas(_bundle, "b long, bundle binary")
    grouped = bundles.groupBy("b")
    sketches = grouped.applyInPandas(_sketch(length, ranges), "r long, b long, anchors binary, owners binary, base long")
    routes = sketches.groupBy("r").applyInPandas(_route(ranges, shards, length), "b long, anchors binary, targets binary")
    pieces = materialise(grouped.cogroup(routes.groupBy("b")).applyInPandas(_cut(length), "b long, shard long, segments binary, about binary, id long, key long, spans array<long>"))
    marks = pieces.where("shard is not null").select("b", "shard", "segments", "about").groupBy("shard").applyInPandas(_mark(length), "b long, id long, key long, spans array<long>")
    marks = marks.unionAll(pieces.where("shard is null").select("b", "id", "key", "spans"))
    found = grouped.cogroup(marks.groupBy("b")).applyInPandas(_finish, "id long, n_bytes long, n_removed long, spans array<long>, kept binary")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "spans", "kept")
