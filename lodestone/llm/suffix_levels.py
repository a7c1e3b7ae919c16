"""Suffix-array dedup: a logarithmic family of sparse suffix arrays, exact on substrings of `width` bytes.

A window of `width` bytes is represented by its anchor: the place of the smallest hash among its `head`-byte
substrings.  Equal windows have equal anchors at equal offsets, so suffixes need to be indexed at anchors only
(about one byte in 35).  An anchor's entry holds the fingerprint of its head (the order of the suffix array), the
fingerprint of its reach (all windows that the anchor represents, as one string) and the place of the text.

Map tasks sort their batch's entries into suffix arrays and deal them out by ranges of the head fingerprint.  In each
range a family of levels takes them in: a new array is merge-scanned against every level, equal reaches resolve to
the earliest place, and levels of like size merge, so an entry is rewritten a logarithmic number of times.  Entries
that share a head but not the reach (the edges of repeats) come back with their text, and their windows are compared
one by one in the same manner.  The order is by fingerprints of 64 bits rather than by raw bytes: ranges of it are
even however skewed the text is, and equal strings, which are all that is sought, are adjacent in either order.

SuffixIndex keeps the family in a folder, as versioned tables: a new batch meets the stored levels in the same scan,
is stored as a level of its own, and stored levels of like size merge.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import U64, Rolling, materialize, mix64, ship, shuffle_partitions, slices, utf8

#: Bytes of text whose windows are anchored at once, and that make one suffix array (more where buckets are many).
PIECE, BATCH, LARGEST_BATCH = 1 << 19, 6 << 20, 64 << 20
#: Bytes of text whose windows are hashed one by one at once.
WINDOWED = 2 << 20
#: Bytes of text for a task (a task takes SHARE buckets, one after another, so tasks are near equal), and most tasks.
TASK_BYTES, SHARE, TASKS = 32 << 20, 8, 25_000


@dataclass(frozen=True)
class Repeats:
    width: int = 100
    head: int = 32
    hot: int = 4000  # heads with more distinct reaches in all, or more than hot_batch in a batch,
    hot_batch: int = 64  # have their windows dealt out one by one


# Entries are columns: fingerprints, batch, doc, tag (the text's hash), lo (start of the first window), n (windows), hot.
_ENTRY = (("head", np.uint64), ("reach", np.uint64), ("batch", np.int32), ("doc", np.int64), ("tag", np.uint32), ("lo", np.int64), ("n", np.int32), ("hot", np.uint8))
_SPAN = (("batch", np.int32), ("doc", np.int64), ("tag", np.uint32), ("lo", np.int64), ("n", np.int32))
_PLACE = ("batch", "doc", "tag", "lo")


def _take(rows: dict, at) -> dict:
    return {k: v[at] for k, v in rows.items()}


def _cat(parts: list[dict]) -> dict:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _empty(kinds) -> dict:
    return {k: np.zeros(0, t) for k, t in kinds}


def pack(rows: dict, kinds) -> bytes:
    """Columns with their bytes transposed, compressed."""
    n = len(rows[kinds[0][0]])
    raw = b"".join(np.ascontiguousarray(rows[k], t).view(np.uint8).reshape(n, -1).T.tobytes() for k, t in kinds) if n else b""
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, kinds) -> dict:
    n, raw, at, out = int.from_bytes(blob[:8], "little"), zstandard.ZstdDecompressor().decompress(blob[8:]), 0, {}
    for k, t in kinds:
        size = np.dtype(t).itemsize
        out[k] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(t) if n else np.zeros(0, t)
        at += n * size
    return out


def _argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the least value in each window of `width` values."""
    place, span = np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        right = values[step:] < values[:-step]
        values = np.where(right, values[step:], values[:-step])
        place = np.where(right, place[step:], place[:-step])
        span += step
    return place


def anchors(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, tag: np.ndarray, cfg: Repeats, batch: int = 0) -> dict:
    """Entries of all texts of a buffer. Pieces overlap by width - 1 bytes, so long texts need no more memory than short ones."""
    out = [_empty(_ENTRY)]
    for at in range(0, max(len(data) - cfg.width + 1, 0), PIECE):
        piece = data[at : at + PIECE + cfg.width - 1]
        rolling = Rolling(piece)
        n = len(piece)
        heads = rolling.spans(np.arange(n - cfg.head + 1), np.arange(cfg.head, n + 1))
        chosen = _argmin((heads >> U64(32)).astype(np.uint32), cfg.width - cfg.head + 1)
        start = np.arange(len(chosen))
        owner = np.searchsorted(offsets, start + at, "right") - 1
        inside = start + at + cfg.width <= offsets[owner + 1]
        start, chosen, owner = start[inside], chosen[inside], owner[inside]
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        lo, hi, anchor, who = start[first], start[last], chosen[first], owner[first]
        shape = ((anchor - lo) * 4096 + hi - lo).astype(np.uint64)
        reach = mix64(rolling.spans(lo, hi + cfg.width) ^ mix64(shape))
        # Anchors are the least hashes around, so they are mixed again: ranges of the result hold like shares.
        out.append({"head": mix64(heads[anchor] + U64(0x632BE59BD9B4E019)), "reach": reach, "batch": np.full(len(lo), batch, np.int32), "doc": doc[who], "tag": tag[who], "lo": lo + at - offsets[who], "n": (hi - lo + 1).astype(np.int32), "hot": np.zeros(len(lo), np.uint8)})
    return _cat(out)


def _later(a: dict, b: dict) -> np.ndarray:
    """Whether a's places come after b's: by batch, doc, the text's hash (rows that share an id), and start."""
    out = np.zeros(len(a["lo"]), bool)
    for k in reversed(_PLACE):
        out = (a[k] > b[k]) | ((a[k] == b[k]) & out)
    return out


def _same_place(a: dict, b: dict) -> np.ndarray:
    return np.logical_and.reduce([a[k] == b[k] for k in _PLACE])


def suffix_array(rows: dict) -> tuple[dict, dict]:
    """Entries in suffix order with one, the earliest, for each (head, reach); and the spans of the others."""
    order = np.lexsort((rows["lo"], rows["tag"], rows["doc"], rows["batch"], rows["reach"], rows["head"]))
    rows = _take(rows, order)
    again = np.zeros(len(order), bool)
    again[1:] = (rows["head"][1:] == rows["head"][:-1]) & (rows["reach"][1:] == rows["reach"][:-1])
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(order)))) if len(order) else np.zeros(0, np.int64)
    spans = _take(rows, again & ~_same_place(rows, _take(rows, lead)))
    return _take(rows, ~again), {k: spans[k] for k, _ in _SPAN}


def _find(level: dict, head: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In an array ordered by (head, reach): the range of each head, where its reach would stand in it, and whether it does."""
    low, high = np.searchsorted(level["head"], head), np.searchsorted(level["head"], head, "right")
    a, b = low.copy(), high.copy()
    live = np.flatnonzero(a < b)
    while len(live):
        mid = (a[live] + b[live]) // 2
        less = level["reach"][mid] < reach[live]
        a[live[less]], b[live[~less]] = mid[less] + 1, mid[~less]
        live = live[a[live] < b[live]]
    at = np.where(a < high, a, 0)
    there = (a < high) & (level["reach"][at] == reach) if len(level["head"]) else np.zeros(len(head), bool)
    return low, high, at, there


class Levels:
    """The family: suffix arrays whose sizes fall geometrically. Entries are flagged as edges where a head has several reaches.

    Levels that were stored before stay as they are; what is new makes levels of its own.
    """

    def __init__(self, stored: list[dict] = ()):
        self.stored = [{k: v.copy() for k, v in level.items()} | {"edge": np.zeros(len(level["head"]), bool)} for level in stored]
        self.levels: list[dict] = []
        self.spans: list[dict] = []

    def add(self, run: dict) -> None:
        """Merge-scan an array (from suffix_array) against every level, then take in what is new."""
        run = run | {"edge": np.zeros(len(run["head"]), bool)}
        same = run["head"][1:] == run["head"][:-1]
        run["edge"][1:] |= same
        run["edge"][:-1] |= same
        alive = np.ones(len(run["head"]), bool)
        for level in [*self.stored, *self.levels]:
            low, high, at, there = _find(level, run["head"], run["reach"])
            same = alive & there
            other = _take(level, at) if len(level["head"]) else run
            later = same & _later(run, other)
            self.spans.append({k: run[k][later] for k, _ in _SPAN})
            earlier = same & _later(other, run)
            self.spans.append({k: other[k][earlier] for k, _ in _SPAN})
            for k in _PLACE:
                level[k][at[earlier]] = run[k][earlier]
            level["hot"][at[same]] |= run["hot"][same]  # a crowd's marker may stand here already
            alive &= ~same
            near = (high > low) & ~there
            run["edge"] |= near
            touched = near | (same & (run["hot"] > 0))
            mark = np.zeros(len(level["head"]) + 1, np.int64)
            np.add.at(mark, low[touched], 1)
            np.add.at(mark, high[touched], -1)
            level["edge"] |= np.cumsum(mark[:-1]) > 0
        run = _take(run, alive)
        if len(run["head"]):
            self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2]["head"]) < 2 * len(self.levels[-1]["head"]):
            self.levels[-2:] = [merged(self.levels[-2:])]

    def finish(self) -> tuple[dict, dict]:
        """(spans that repeat an earlier place, the earliest entries at edges)."""
        rows = _cat([{k: x[k] for k in (*(n for n, _ in _ENTRY), "edge")} for x in [*self.stored, *self.levels]] or [_empty((*_ENTRY, ("edge", bool)))])
        return _cat([*self.spans, _empty(_SPAN)]), _take({k: rows[k] for k, _ in _ENTRY}, rows["edge"])

    def new_level(self) -> dict:
        """What the family took in, as one array."""
        out = merged(self.levels) if self.levels else _empty(_ENTRY)
        return {k: out[k] for k, _ in _ENTRY}


def merged(levels: list[dict]) -> dict:
    both = _cat(levels)
    return _take(both, np.lexsort((both["reach"], both["head"])))


_RUN = "bucket int, run binary, spans binary, crowd binary"


def _runs(docs: DataFrame, cfg: Repeats, buckets: int, batch_number: int) -> DataFrame:
    """(bucket, run, spans): each batch's suffix array cut into ranges of the head's fingerprint."""
    most = min(LARGEST_BATCH, max(BATCH, buckets * 1024))  # a bucket's share is some 30 entries at least

    def run(batches):
        for batch in batches:
            whole, bounds = utf8(batch.column("text"))
            docs_, tags = np.asarray(batch.column("doc")), np.asarray(batch.column("tag")).astype(np.uint32)
            for first, last in slices(bounds, most):
                data, offsets = whole[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
                array, spans = suffix_array(anchors(data, offsets, docs_[first:last], tags[first:last], cfg, batch_number))
                array, crowd = _crowds(array, cfg)
                cuts = np.searchsorted(array["head"] >> U64(32), (np.arange(buckets + 1, dtype=np.uint64) << U64(32)) // U64(buckets))
                # Repeats inside the batch are settled and crowds are known as edges; they travel with any bucket.
                share, deal = (np.linspace(0, len(x["lo"]), buckets + 1).astype(np.int64) for x in (spans, crowd))
                numbers, blobs, more, crowds = [], [], [], []
                for b in range(buckets):
                    if cuts[b] < cuts[b + 1] or share[b] < share[b + 1] or deal[b] < deal[b + 1]:
                        numbers.append(b)
                        blobs.append(pack(_take(array, slice(cuts[b], cuts[b + 1])), _ENTRY))
                        more.append(pack(_take(spans, slice(share[b], share[b + 1])), _SPAN))
                        crowds.append(pack(_take(crowd, slice(deal[b], deal[b + 1])), _ENTRY))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *[pa.array(x, pa.binary()) for x in (blobs, more, crowds)]], ["bucket", "run", "spans", "crowd"])

    return docs.mapInArrow(run, _RUN)


def _crowds(array: dict, cfg: Repeats) -> tuple[dict, dict]:
    """(array, crowd): of a head with more than cfg.hot_batch reaches only two stay, as markers; all are edges for certain."""
    _, first, place, many = np.unique(array["head"], return_index=True, return_inverse=True, return_counts=True)
    if not len(many) or many.max() <= cfg.hot_batch:
        return array, _take(array, slice(0, 0))
    hot = (many > cfg.hot_batch)[place]
    array = array | {"hot": hot.astype(np.uint8)}
    return _take(array, ~hot | (np.arange(len(hot)) < first[place] + 2)), _take(array, hot)


#: hot: 0, 1 for an edge whose windows are dealt out one by one, 2 for one that stands in no level besides.
_FOUND = "batch int, doc long, tag long, lo long, n int, head long, hot tinyint"


def _found(spans: dict, edges: dict, hot: np.ndarray) -> pa.Table:
    """Spans have no head."""
    k = len(spans["lo"])
    none = pa.nulls(k, pa.int64())
    cols = [pa.array(np.concatenate([spans[c], edges[c]]).astype(t)) for c, t in (("batch", np.int32), ("doc", np.int64), ("tag", np.int64), ("lo", np.int64), ("n", np.int32))]
    heads = pa.concat_arrays([none, pa.array(edges["head"].view(np.int64))])
    return pa.table([*cols, heads, pa.array(np.concatenate([np.zeros(k, np.int8), hot.astype(np.int8)]))], ["batch", "doc", "tag", "lo", "n", "head", "hot"])


def _scan(runs: DataFrame, cfg: Repeats, buckets: int, stored: DataFrame | None = None, store: bool = False) -> DataFrame:
    """runs, and stored(level, bucket, entries), the levels of earlier batches -> found spans and edges, with store also
    the new level's entries (in the columns bucket and entries, on rows of their own)."""

    def bucket(table: pa.Table) -> pa.Table:
        blobs: dict[str, list[bytes]] = {c: table.column(c).to_pylist() for c in ("run", "spans", "crowd", "entries")}
        family = Levels([unpack(x, _ENTRY) for x in blobs["entries"] if x is not None])
        crowds = [_empty(_ENTRY)]
        for blob, more, crowd in zip(blobs["run"], blobs["spans"], blobs["crowd"], strict=True):
            if blob is not None:
                family.spans.append(unpack(more, _SPAN))
                family.add(unpack(blob, _ENTRY))
                crowds.append(unpack(crowd, _ENTRY))
        spans, edges = family.finish()
        heads, place, many = np.unique(edges["head"], return_inverse=True, return_counts=True)
        hot = np.zeros(len(place), bool)
        if len(heads):  # a marker makes its head hot wherever it is met
            hot = ((np.bincount(place, edges["hot"] > 0) > 0) | (many > cfg.hot))[place]
        crowd = _cat(crowds)
        out = _found(spans, _cat([edges, crowd]), np.concatenate([hot.astype(np.int8), np.full(len(crowd["lo"]), 2)]))
        if not store:
            return out
        number = table.column("bucket")[0].as_py()
        out = out.append_column("bucket", pa.nulls(len(out), pa.int32())).append_column("entries", pa.nulls(len(out), pa.binary()))
        row = {n: pa.nulls(1, out.schema.field(n).type) for n in out.schema.names} | {"bucket": pa.array([number], pa.int32()), "entries": pa.array([pack(family.new_level(), _ENTRY)], pa.binary())}
        return pa.concat_tables([out, pa.table(row)])

    rows = runs.withColumn("entries", F.lit(None).cast("binary"))
    if stored is not None:
        none = [F.lit(None).cast("binary").alias(c) for c in ("run", "spans", "crowd")]
        rows = rows.union(stored.select("bucket", *none, "entries"))
    return _by_bucket(rows, buckets).applyInArrow(bucket, _FOUND + ", bucket int, entries binary" * store)


def _by_bucket(rows: DataFrame, buckets: int):
    """SHARE buckets for a task; a given number keeps adaptive execution from joining them into large ones."""
    return rows.repartition(max(1, buckets // SHARE), "bucket").groupBy("bucket")


def bucket_count(spark: SparkSession, n_bytes: int) -> int:
    return SHARE * max(shuffle_partitions(spark), min(TASKS, -(-n_bytes // TASK_BYTES)))


# The windows of an edge: w (of the window's bytes) and their places.
_WINDOW = (("w", np.uint64), ("batch", np.int32), ("doc", np.int64), ("tag", np.uint32), ("lo", np.int64))


def _window_hashes(content: np.ndarray, start: np.ndarray, cfg: Repeats) -> np.ndarray:
    return Rolling(content).spans(start, start + cfg.width)


def _first_windows(rows: dict) -> tuple[dict, dict]:
    """The earliest place of each distinct window, and the places of the others."""
    order = np.lexsort((rows["lo"], rows["tag"], rows["doc"], rows["batch"], rows["w"]))
    rows = _take(rows, order)
    again = np.zeros(len(order), bool)
    again[1:] = rows["w"][1:] == rows["w"][:-1]
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(order)))) if len(order) else np.zeros(0, np.int64)
    return _take(rows, ~again), _take(rows, again & ~_same_place(rows, _take(rows, lead)))


def _to_spans(rows: dict) -> dict:
    """Windows at successive places as one span."""
    order = np.lexsort((rows["lo"], rows["tag"], rows["doc"], rows["batch"]))
    batch, doc, tag, lo = (rows[k][order] for k in _PLACE)
    new = np.ones(len(lo), bool)
    new[1:] = (batch[1:] != batch[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (lo[1:] > lo[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(lo)) - 1 if len(at) else at
    return {"batch": batch[at], "doc": doc[at], "tag": tag[at], "lo": lo[at], "n": (lo[last] - lo[at] + 1).astype(np.int32)}


# An edge with its text: kind 0 (all windows of one reach, met by head) or 1 (single windows of hot heads, met by window).
def _edge_texts(joined: DataFrame, cfg: Repeats, buckets: int) -> DataFrame:
    """joined(batch, doc, tag, text, edges array<struct<lo, n, head, hot>>) -> found spans."""
    kinds = (("head", np.uint64), ("batch", np.int32), ("doc", np.int64), ("tag", np.uint32), ("lo", np.int64), ("n", np.int32))

    def run(batches):
        for whole in batches:
            # Windows take some forty times the bytes of their text, so few texts are taken at once.
            for first, last in slices(utf8(whole.column("text"))[1], WINDOWED):
                yield dealt_out(whole.slice(first, last - first))

    def dealt_out(batch):
        data, offsets = utf8(batch.column("text"))
        edges = batch.column("edges")
        values = edges.flatten()
        many = np.diff(np.asarray(edges.offsets)) if len(edges) else np.zeros(0, np.int64)
        who = np.repeat(np.arange(batch.num_rows), many)
        lo, n = (np.asarray(values.field(k)).astype(np.int64) for k in (0, 1))
        head, hot = np.asarray(values.field(2)).view(np.uint64), values.field(3).to_numpy(zero_copy_only=False).astype(bool)
        number_, doc, tag = np.asarray(batch.column("batch"))[who], np.asarray(batch.column("doc"))[who], np.asarray(batch.column("tag")).astype(np.uint32)[who]
        start, size = offsets[who] + lo, n + cfg.width - 1
        number = ((head >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        single = _empty(_WINDOW)
        if hot.any():
            places = np.repeat(start[hot] - np.concatenate([[0], np.cumsum(n[hot])[:-1]]), n[hot]) + np.arange(int(n[hot].sum()))
            single = {"w": np.concatenate([_window_hashes(data[s : s + z], np.arange(m), cfg) for s, z, m in zip(start[hot], size[hot], n[hot], strict=True)]), "batch": np.repeat(number_[hot], n[hot]), "doc": np.repeat(doc[hot], n[hot]), "tag": np.repeat(tag[hot], n[hot]), "lo": places - np.repeat(offsets[who][hot], n[hot])}
        single, settled = _first_windows(single)
        settled = _to_spans(settled)
        by_window = (mix64(single["w"]) % U64(buckets)).astype(np.int64)
        plain = np.flatnonzero(~hot)
        plain = plain[np.argsort(number[plain], kind="stable")]
        order = np.argsort(by_window, kind="stable")
        single, by_window, number = _take(single, order), by_window[order], number[plain]
        numbers = np.union1d(np.union1d(number, by_window), np.zeros(1 if len(settled["lo"]) else 0, np.int64)).astype(np.int64)
        of_plain, of_single = ([np.searchsorted(x, numbers, side) for side in ("left", "right")] for x in (number, by_window))
        texts, places, singles, done = [], [], [], []
        for k, b in enumerate(numbers):
            own = plain[of_plain[0][k] : of_plain[1][k]]
            texts.append(b"".join(data[s : s + z].tobytes() for s, z in zip(start[own], size[own], strict=True)))
            places.append(pack({"head": head[own], "batch": number_[own], "doc": doc[own], "tag": tag[own], "lo": lo[own], "n": n[own].astype(np.int32)}, kinds))
            singles.append(pack(_take(single, slice(of_single[0][k], of_single[1][k])), _WINDOW))
            done.append(pack(settled if not b else _empty(_SPAN), _SPAN))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *[pa.array(x, pa.binary()) for x in (texts, places, singles, done)]], ["bucket", "texts", "places", "singles", "done"])

    def bucket(table: pa.Table) -> pa.Table:
        parts, spans = [_empty(_WINDOW)], [_empty(_SPAN)]
        for row in table.to_pylist():
            content, own = np.frombuffer(row["texts"], np.uint8), unpack(row["places"], kinds)
            n = own["n"].astype(np.int64)
            if len(n):
                begin = np.concatenate([[0], np.cumsum(n + cfg.width - 1)[:-1]])
                step = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                w = _window_hashes(content, np.repeat(begin, n) + step, cfg)
                parts.append({"w": w, "batch": np.repeat(own["batch"], n), "doc": np.repeat(own["doc"], n), "tag": np.repeat(own["tag"], n), "lo": np.repeat(own["lo"], n) + step})
            parts.append(unpack(row["singles"], _WINDOW))
            spans.append(unpack(row["done"], _SPAN))
        _, others = _first_windows(_cat(parts))
        spans.append(_to_spans(others))
        return _found(_cat(spans), _empty(_ENTRY), np.zeros(0, np.int8))

    dealt = joined.mapInArrow(run, "bucket int, texts binary, places binary, singles binary, done binary")
    return _by_bucket(dealt, buckets).applyInArrow(bucket, _FOUND)


def _apply_spans(joined: DataFrame, key: str, cfg: Repeats, with_text: bool) -> DataFrame:
    """joined(key, carry, text, spans array<struct<lo, n>>) -> key, carry, n_bytes, n_removed, spans (maximal removed runs), kept."""
    own = joined.schema

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            spans = batch.column("spans")
            values, cuts = spans.flatten(), np.zeros(batch.num_rows + 1, np.int64)
            sizes = np.array([0 if x is None else x for x in pc.list_value_length(spans).to_pylist()], np.int64)
            np.cumsum(sizes, out=cuts[1:])
            lo, n = (np.asarray(values.field(k)).astype(np.int64) for k in (0, 1))
            removed, runs, kept = [], [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                a, b = cuts[i], cuts[i + 1]
                if a == b:
                    removed.append(0)
                    runs.append([])
                    kept.append(own.tobytes())
                    continue
                order = np.argsort(lo[a:b], kind="stable")
                begin, end = lo[a:b][order], (lo[a:b] + n[a:b] + cfg.width - 1)[order]
                far = np.maximum.accumulate(end)
                new = np.ones(len(begin), bool)
                new[1:] = begin[1:] > far[:-1]
                first = np.flatnonzero(new)
                begin, end = begin[first], far[np.append(first[1:], len(far)) - 1]
                removed.append(int((end - begin).sum()))
                runs.append([{"start": int(x), "end": int(y)} for x, y in zip(begin, end, strict=True)])
                rest = np.concatenate([[0], end]), np.concatenate([begin, [len(own)]])
                kept.append(b"".join(own[x:y].tobytes() for x, y in zip(*rest, strict=True)))
            fields = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            whole = pa.array([k.decode("utf-8", "ignore") for k in kept] if with_text else [None] * len(kept), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("carry"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, fields), pa.array(kept, pa.binary()), whole], [key, "carry", "n_bytes", "n_removed", "spans", "kept", "kept_text"])

    schema = T.StructType([T.StructField(key, own["key"].dataType), own["carry"]]).add("n_bytes", "long").add("n_removed", "long")
    schema = schema.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))).add("kept", "binary").add("kept_text", "string")
    return joined.select("key", "carry", "text", "spans").mapInArrow(run, schema)


def _numbered(docs: DataFrame, text: str, key: str, carry: list[str] | None) -> DataFrame:
    """(key, carry, doc, tag, text): doc orders rows, tag tells apart texts that share an id."""
    with_row = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    rows = docs.select(F.col(key).alias("key"), with_row.alias("carry"), F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Rows without a key come first and in the order of a hash, so they differ in doc (negative as no key's is) and tag.
    loose = F.shiftright(F.xxhash64("text", F.lit(7)), 2) + F.lit(-(1 << 62) - (1 << 61))
    return rows.withColumns({"doc": F.coalesce("doc", loose), "tag": F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))})


def _repeated(rows: DataFrame, texts: DataFrame, cfg: Repeats, buckets: int, batch: int, stored: DataFrame | None = None, crowds: DataFrame | None = None, store: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spans(doc, tag, lo, n) of this batch's windows that repeat, found: the scan's table, with the new level if store).

    texts: (batch, doc, tag, text) of all batches, for the edges.
    """
    found = materialize(_scan(_runs(rows.select("doc", "tag", "text"), cfg, buckets, batch), cfg, buckets, stored, store), "repeats")
    edges = found.where("head is not null").select("batch", "doc", "tag", "lo", "n", "head", "hot")
    if crowds is not None:  # stored crowds stand in no level: they join again where their head is met
        known = crowds.select("head").distinct().withColumn("known", F.lit(1))
        again = crowds.join(edges.select("head").distinct(), "head", "left_semi").select(edges.columns)
        edges = edges.join(known, "head", "left").withColumn("hot", F.greatest("hot", F.col("known").cast("tinyint"))).select(edges.columns).union(again)
    edges = edges.groupBy("batch", "doc", "tag").agg(F.collect_list(F.struct("lo", "n", "head", "hot")).alias("edges"))
    # Repeated rows would double their windows at equal places, which is harmless.
    joined = texts.join(edges, ["batch", "doc", "tag"]).select("batch", "doc", "tag", "text", "edges")
    more = materialize(_edge_texts(joined, cfg, buckets), "edges")
    spans = found.where("head is null and lo is not null").select("batch", "doc", "tag", "lo", "n").union(more.select("batch", "doc", "tag", "lo", "n"))
    return spans.where(F.col("batch") == batch).drop("batch"), found


def _shown(rows: DataFrame, spans: DataFrame, key: str, cfg: Repeats, carry: list[str] | None) -> DataFrame:
    spans = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    out = _apply_spans(rows.join(spans, ["doc", "tag"], "left"), key, cfg, bool(carry))
    return out if carry else out.drop("carry", "kept_text")


def remove_repeats(docs: DataFrame, cfg: Repeats = Repeats(), text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Per row: key, n_bytes, n_removed, spans and kept (binary): the text without bytes that lie in a repeated window.

    carry: columns of docs to hand through, as a struct of that name; adds kept_text, without characters cut apart.

    A window of cfg.width bytes is repeated if the same bytes start earlier: in a smaller key, or earlier in the
    same text.  Null and short texts have no windows.  A null key is smaller than any key; rows with a null key are
    ordered by their texts' hashes, as are rows that repeat a key; rows that repeat key and text count as one document
    and get equal results.  Keys are integers from -2^61 on; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows = _numbered(docs, text, key, carry)
    spans, _ = _repeated(rows, rows.select(F.lit(0).alias("batch"), "doc", "tag", "text"), cfg, bucket_count(spark, n_bytes), 0)
    return _shown(rows, spans, key, cfg, carry)


class SuffixIndex:
    """A family of levels in a folder: a manifest for each version, suffix arrays by bucket, and the batches' texts.

    A manifest is written whole before it counts, and nothing that it names is changed; a batch that fails leaves the
    version before.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, cfg: Repeats = Repeats(), buckets: int = 96):
        """buckets holds for the life of the index: SHARE for each 32 MB or so of the text that it is to reach."""
        self.spark, self.folder, self.cfg = spark, folder.rstrip("/"), cfg
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(path))
        versions = [n for n in names if n.startswith("version-") and n.endswith(".json")]
        self.state = {"version": 0, "buckets": buckets, "batches": [], "crowds": [], "levels": []}
        if versions:
            self.state = json.loads(spark.read.text(f"{self.folder}/{versions[-1]}", wholetext=True).first()[0])

    def _publish(self, state: dict) -> None:
        state = state | {"version": self.state["version"] + 1}
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, final = make(f"{self.folder}/.{uuid.uuid4().hex}"), make(f"{self.folder}/version-{state['version']:06d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError("another writer was faster")
        self.state = state

    def _level(self, places: list[str]) -> DataFrame:
        return self.spark.read.schema("bucket int, entries binary").parquet(*places)

    def add(self, docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
        """remove_repeats() for a new batch, whose text comes after all that the index holds; the batch then is part of it."""
        ship(self.spark)
        number, buckets = len(self.state["batches"]), self.state["buckets"]
        rows = _numbered(docs, text, key, carry)
        place = f"{self.folder}/texts-{number:06d}-{uuid.uuid4().hex}"
        rows.select(F.lit(number).alias("batch"), "doc", "tag", "text").write.parquet(place)
        batches = [*self.state["batches"], place]
        texts = self.spark.read.schema("batch int, doc long, tag long, text string").parquet(*batches)
        levels = self.state["levels"]
        stored = self._level([p["place"] for p in levels]) if levels else None
        crowds = self.spark.read.schema(_FOUND).parquet(*self.state["crowds"]) if self.state["crowds"] else None
        spans, found = _repeated(rows, texts, self.cfg, buckets, number, stored, crowds, True)
        new = f"{self.folder}/level-{uuid.uuid4().hex}"
        found.where("entries is not null").select("bucket", "entries").write.parquet(new)
        crowd = f"{self.folder}/crowd-{uuid.uuid4().hex}"
        found.where("hot = 2").select("batch", "doc", "tag", "lo", "n", "head", "hot").write.parquet(crowd)
        levels = [*levels, {"place": new, "bytes": self._bytes(new)}]
        while len(levels) > 1 and levels[-2]["bytes"] < 2 * levels[-1]["bytes"]:
            levels = [*levels[:-2], self._merged(levels[-2:])]
        self._publish(self.state | {"batches": batches, "crowds": [*self.state["crowds"], crowd], "levels": levels})
        return _shown(rows, spans, key, self.cfg, carry)

    def _bytes(self, place: str) -> int:
        return self._fs.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(place)).getLength()

    def _merged(self, pair: list[dict]) -> dict:
        """Two stored levels as one, bucket by bucket."""

        def bucket(table: pa.Table) -> pa.Table:
            parts = [unpack(x, _ENTRY) for x in table.column("entries").to_pylist()]
            return pa.table({"bucket": table.column("bucket").slice(0, 1), "entries": pa.array([pack(merged(parts), _ENTRY)], pa.binary())})

        place = f"{self.folder}/level-{uuid.uuid4().hex}"
        _by_bucket(self._level([p["place"] for p in pair]), self.state["buckets"]).applyInArrow(bucket, "bucket int, entries binary").write.parquet(place)
        return {"place": place, "bytes": self._bytes(place)}
