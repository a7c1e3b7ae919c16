"""Media columns: local image descriptors that find cropped, rotated or re-toned copies.

Corners are taken at several scales; each gets an orientation (intensity centroid) and a binary descriptor of
orientation-normalised intensity tests.  Descriptors meet in Hamming tables: each table keys a descriptor by a fixed
subset of its bits, and an equi-join on (table, key) brings candidates together, of which those stay whose whole
descriptors differ in few bits.  Two images that meet in a few corners are then compared whole, every corner with every
other, and the matches vote for a rotation, a scale and a shift; enough votes for one transform, from corners spread over
the image, make a copy.

Every corner counts: an image has as many as its area holds, and none is dropped for being weak.  Stored images are
described at three sizes from full to half and queries, which are fewer, at thirteen, so that copies from half to
double size meet an image of their own size within 3 %.

Images are binary grey maps (PGM, "P5"), the one media format that needs no decoder beyond numpy.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, ship


@dataclass(frozen=True)
class Settings:
    stored_scales: tuple[float, ...] = tuple(2 ** (-k / 2) for k in range(3))
    asked_scales: tuple[float, ...] = tuple(2 ** (-k / 12) for k in range(13))
    apart: int = 3  # pixels around a corner without a stronger one
    tests: int = 256  # a multiple of 64
    tables: int = 2
    key_bits: int = 18
    distance: int = 36  # bits in which two descriptors may differ
    radius: int = 10
    blur: int = 1  # of what the tests compare, beyond the smoothing of the image
    inliers: int = 4
    meetings: int = 2  # corners of a query that must meet an image's in the tables before the two are compared whole
    compared: int = 1 << 26  # pairs of corners up to which images are compared whole; beyond, by `large_tables` tables
    large_tables: int = 16
    least_response: float = 1e-4  # of intensities in [0, 1]; flat patches have no corners
    stack_bytes: int = 4 << 20  # pixels that are described at once

    @property
    def margin(self) -> int:
        return self.radius + 2


def encode_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels, or None for what isn't a whole grey map."""
    if not data or not data.startswith(b"P5"):
        return None
    parts = data.split(None, 3)
    if len(parts) < 4 or not (parts[1].isdigit() and parts[2].isdigit()):
        return None
    w, h = int(parts[1]), int(parts[2])
    at = data.index(parts[2], data.index(parts[1]) + len(parts[1])) + len(parts[2])
    end = data.find(b"\n255\n", at - 1)
    body = data[end + 5 :] if end >= 0 else b""
    return np.frombuffer(body, np.uint8).reshape(h, w) if w and h and len(body) == w * h else None


def _shift(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a moved by (dy, dx), edges repeated."""
    h, w = a.shape[1:]
    y = np.clip(np.arange(h) + dy, 0, h - 1)
    x = np.clip(np.arange(w) + dx, 0, w - 1)
    return a[:, y][:, :, x]


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over (2r + 1)^2 squares, edges repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        wide, n = np.pad(a, pad, mode="edge"), a.shape[axis]
        cut = [slice(None)] * 3
        cut[axis] = slice(0, n)
        total = wide[tuple(cut)].copy()
        for k in range(1, 2 * r + 1):
            cut[axis] = slice(k, k + n)
            total += wide[tuple(cut)]
        a = total / np.float32(2 * r + 1)
    return a


def _resized(a: np.ndarray, factor: float) -> np.ndarray:
    if factor == 1.0:
        return a
    h, w = max(1, int(a.shape[1] * factor)), max(1, int(a.shape[2] * factor))
    y, x = (np.arange(h) + 0.5) / factor - 0.5, (np.arange(w) + 0.5) / factor - 0.5
    y, x = y.astype(a.dtype), x.astype(a.dtype)
    y0, x0 = np.clip(np.floor(y).astype(int), 0, a.shape[1] - 2), np.clip(np.floor(x).astype(int), 0, a.shape[2] - 2)
    fy, fx = np.clip(y - y0, 0, 1)[None, :, None], np.clip(x - x0, 0, 1)[None, None, :]
    top, low = a[:, y0], a[:, y0 + 1]
    return (top[:, :, x0] * (1 - fx) + top[:, :, x0 + 1] * fx) * (1 - fy) + (low[:, :, x0] * (1 - fx) + low[:, :, x0 + 1] * fx) * fy


class Describer:
    def __init__(self, s: Settings):
        self.s = s
        draw = np.random.default_rng(5)
        ends = draw.normal(0, s.radius / 2.2, (2 * s.tests, 2))
        ends *= np.minimum(1, s.radius / np.maximum(np.hypot(ends[:, 0], ends[:, 1]), 1e-9))[:, None]  # inside the disc
        self.pairs = ends.reshape(s.tests, 4).astype(np.float32)
        self.subsets = [np.sort(draw.choice(s.tests, s.key_bits, replace=False)) for _ in range(s.tables)]
        span = np.arange(-s.radius, s.radius + 1)
        self.dy, self.dx = np.meshgrid(span, span, indexing="ij")
        self.disc = (self.dy**2 + self.dx**2 <= s.radius**2).astype(np.float32)

    def __call__(self, images: np.ndarray, scales: tuple[float, ...]) -> dict[str, np.ndarray]:
        """For a stack of equally large images: image, x, y, angle, scale (one for each corner) and bits (corners x tests)."""
        s = self.s
        found: list[dict] = [{"image": np.zeros(0, int), "x": np.zeros(0), "y": np.zeros(0), "angle": np.zeros(0), "scale": np.zeros(0), "bits": np.zeros((0, s.tests), bool)}]
        base = images.astype(np.float32) / 255
        # Tones are stretched, so that a change of brightness or contrast alters no response.
        low, high = base.min((1, 2), keepdims=True), base.max((1, 2), keepdims=True)
        base = (base - low) / np.maximum(high - low, np.float32(1e-9))
        for factor in scales:
            a = _resized(base, factor)
            m = s.margin
            if min(a.shape[1:]) <= 2 * m + 2:
                continue
            smooth = _box(a, 1)
            gy, gx = (_shift(smooth, 1, 0) - _shift(smooth, -1, 0)) / 2, (_shift(smooth, 0, 1) - _shift(smooth, 0, -1)) / 2
            xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
            response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
            peak = response >= s.least_response**1.5
            peak[:, :m] = peak[:, -m:] = peak[:, :, :m] = peak[:, :, -m:] = False
            i, y, x = np.nonzero(peak)
            centre = response[i, y, x]
            steps = [(dy, dx) for dy in range(-s.apart, s.apart + 1) for dx in range(-s.apart, s.apart + 1) if (dy, dx) != (0, 0)]
            for dy, dx in sorted(steps, key=lambda d: abs(d[0]) + abs(d[1])):  # near neighbours leave few
                other = response[i, y + dy, x + dx]
                top = centre > other if (dy, dx) < (0, 0) else centre >= other
                i, y, x, centre = i[top], y[top], x[top], centre[top]
            blurred = _box(smooth, s.blur)
            for at in range(0, len(i), 4096):
                found.append(self._corners(smooth, blurred, i[at : at + 4096], y[at : at + 4096], x[at : at + 4096], factor))
        return {k: np.concatenate([f[k] for f in found]) for k in found[0]}

    def _corners(self, smooth: np.ndarray, blurred: np.ndarray, i: np.ndarray, y: np.ndarray, x: np.ndarray, factor: float) -> dict[str, np.ndarray]:
        patches = smooth[i[:, None, None], y[:, None, None] + self.dy, x[:, None, None] + self.dx] * self.disc
        angle = np.arctan2((patches * self.dy).sum((1, 2)), (patches * self.dx).sum((1, 2)))
        c, n = np.cos(angle).astype(np.float32)[:, None], np.sin(angle).astype(np.float32)[:, None]

        flat, at = blurred.reshape(-1), ((i * blurred.shape[1] + y) * blurred.shape[2] + x)[:, None]

        def sample(px, py):
            """Bilinear, for turns other than quarter turns."""
            u, v = px[None] * c - py[None] * n, px[None] * n + py[None] * c
            u0, v0 = np.floor(u), np.floor(v)
            fu, fv = u - u0, v - v0
            k = at + (v0 * blurred.shape[2] + u0).astype(np.int32)
            top, low = flat[k], flat[k + blurred.shape[2]]
            return (top + fu * (flat[k + 1] - top)) * (1 - fv) + (low + fu * (flat[k + blurred.shape[2] + 1] - low)) * fv

        bits = sample(self.pairs[:, 0], self.pairs[:, 1]) < sample(self.pairs[:, 2], self.pairs[:, 3]) - 1e-6
        return {"image": i, "x": (x + 0.5) / factor, "y": (y + 0.5) / factor, "angle": angle, "scale": np.full(len(i), 1 / factor), "bits": bits}

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """corners x tables: the bits of each table's subset as a number."""
        return np.stack([(bits[:, sub] * (1 << np.arange(len(sub)))).sum(1) for sub in self.subsets], 1).astype(np.int64)

    def words(self, bits: np.ndarray) -> np.ndarray:
        """corners x (tests / 64): all bits."""
        return np.packbits(bits, axis=1).view(np.int64)

    def masks(self) -> np.ndarray:
        """tables x (tests / 64): the bits of each table's subset, as words() places them."""
        bits = np.zeros((len(self.subsets), self.s.tests), bool)
        for own, sub in zip(bits, self.subsets, strict=True):
            own[sub] = True
        return self.words(bits)


def packed_type(settings: Settings) -> np.dtype:
    """A corner as the images' comparison reads it."""
    return np.dtype([("x", "<f4"), ("y", "<f4"), ("angle", "<f4"), ("scale", "<f4"), ("bits", "<u8", (settings.tests // 64,))])


class Comparer:
    """Compares two images' corners, packed."""

    def __init__(self, s: Settings):
        self.s, self.type = s, packed_type(s)
        self.describer = Describer(replace(s, tables=s.large_tables))
        self.block = 1 << 17  # pairs of corners at once
        self.halves = np.stack(np.meshgrid(*[[0.0, 0.5]] * 3, indexing="ij"), -1).reshape(-1, 3)

    def __call__(self, asked: bytes, stored: bytes) -> tuple[int, float, float, float] | None:
        """inliers, mean sine and cosine of the turn, and mean size of the best transform; None if it has too few."""
        q, m = np.frombuffer(asked, self.type), np.frombuffer(stored, self.type)
        place, n = np.unique(np.column_stack([m["x"] // 4, m["y"] // 4]), axis=0, return_inverse=True)[1].ravel(), max(1, len(m))
        bins, sums, held, places = [], [], [], []
        for qn, mn in self._near(q, m):
            every, turn, size = self._votes(q[qn], m[mn])
            own, which = np.unique(every, return_inverse=True)
            # No corner of q is in two blocks, so their counts add up.
            corners = np.bincount(np.unique(which * len(q) + np.tile(qn, len(self.halves))) // len(q), minlength=len(own))
            weights = [np.bincount(which, np.tile(w, len(self.halves)), len(own)) for w in (np.ones(len(qn)), np.sin(turn), np.cos(turn), size)]
            at = np.unique(which * n + np.tile(place[mn], len(self.halves)))
            bins.append(own)
            sums.append(np.stack([corners, *weights], 1))
            held.append(own[at // n])
            places.append(at % n)
        if not bins:
            return None
        own, which = np.unique(np.concatenate(bins), return_inverse=True)
        total = np.zeros((len(own), 5))
        np.add.at(total, which, np.concatenate(sums))
        spread = np.bincount(np.unique(np.searchsorted(own, np.concatenate(held)) * n + np.concatenate(places)) // n, minlength=len(own))
        inliers = np.minimum(total[:, 0].astype(np.int64), spread)
        best = len(own) - 1 - int(np.argmax(inliers[::-1]))  # of equal ones, the last bin
        if inliers[best] < self.s.inliers:
            return None
        _, votes, sin, cos, size = total[best]
        return int(inliers[best]), sin / votes, cos / votes, size / votes

    def _near(self, q: np.ndarray, m: np.ndarray):
        """Blocks of (corner of q, corner of m) whose descriptors differ in few bits, each of other corners of q."""
        if len(q) * len(m) > self.s.compared:
            yield from self._near_by_tables(q, m)
            return
        step = max(1, self.block // max(1, len(m)))
        for at in range(0, len(q), step):
            apart = np.zeros((len(q[at : at + step]), len(m)), np.uint16)
            for w in range(q["bits"].shape[1]):
                apart += np.bitwise_count(q["bits"][at : at + step, None, w] ^ m["bits"][None, :, w])
            qn, mn = np.nonzero(apart <= self.s.distance)
            if len(qn):
                yield qn + at, mn

    def _near_by_tables(self, q: np.ndarray, m: np.ndarray):
        asked, stored = (np.concatenate([self.describer.keys(np.unpackbits(np.ascontiguousarray(x["bits"][at : at + 4096]).view(np.uint8), axis=1).astype(bool)) for at in range(0, len(x), 4096)]) for x in (q, m))
        order = np.argsort(stored, axis=0, kind="stable")
        first, last = (np.stack([np.searchsorted(stored[order[:, t], t], asked[:, t], side) for t in range(self.s.large_tables)], 1) for side in ("left", "right"))
        until = np.concatenate([[0], np.cumsum((last - first).sum(1))])
        at = 0
        while at < len(q):
            # As many corners as meet a block of others; one that meets more stands alone.
            end = max(at + 1, int(np.searchsorted(until, until[at] + self.block, "right")) - 1)
            found = []
            for t in range(self.s.large_tables):
                count = (last - first)[at:end, t]
                qn = np.repeat(np.arange(at, end), count)
                mn = order[np.repeat(first[at:end, t] - np.cumsum(count) + count, count) + np.arange(len(qn)), t]
                near = np.bitwise_count(q["bits"][qn] ^ m["bits"][mn]).sum(1) <= self.s.distance
                qn, mn = qn[near], mn[near]
                new = ~(asked[qn, :t] == stored[mn, :t]).any(1)  # once, by the first table
                found.append((qn[new], mn[new]))
            qn, mn = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(qn):
                yield qn, mn
            at = end

    def _votes(self, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins of each vote as numbers, one for each choice of halves (they overlap by half, so no cluster is cut by a border), turn and size."""
        turn = np.mod(m["angle"].astype(float) - q["angle"], 2 * np.pi)
        size = m["scale"].astype(float) / q["scale"]
        x = m["x"] - size * (np.cos(turn) * q["x"] - np.sin(turn) * q["y"])
        y = m["y"] - size * (np.sin(turn) * q["x"] + np.cos(turn) * q["y"])
        bt, bs = turn / (2 * np.pi / 12), np.floor(np.log2(size) * 2 + 0.5) + 32
        bins = []
        for k, (h1, h2, h3) in enumerate(self.halves):
            number = np.zeros(len(q), np.int64)
            for part, bits in ((np.mod(np.floor(bt + h1), 12), 4), (bs, 7), (np.floor(x / 24 + h2) + (1 << 20), 21), (np.floor(y / 24 + h3) + (1 << 20), 21), (np.full(len(q), k), 3)):
                number = (number << bits) + part.astype(np.int64)
            bins.append(number)
        return np.concatenate(bins), turn, size


_CORNER = "array<struct<x:float,y:float,angle:float,scale:float,keys:array<bigint>,bits:array<bigint>>>"


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def describe(media: DataFrame, scales: tuple[float, ...], settings: Settings = Settings(), key: str = "media_id", image: str = "image") -> DataFrame:
    """Per row: key, digest (128 bits, of the image), corners, and these packed. What doesn't decode, null too, has a null digest and no corners."""
    ship(media.sparkSession)

    def run(batches):
        describer = Describer(settings)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # As many rows as a stack may hold; a larger image stands alone.
                raw, pixels, size = [], [], 0
                while at < batch.num_rows and (not raw or size < settings.stack_bytes):
                    raw.append(batch.column(image)[at].as_py())
                    pixels.append(decode_pgm(raw[-1]))
                    size += 64 if pixels[-1] is None else 16 * pixels[-1].size
                    at += 1
                yield _described(batch.column(key).slice(at - len(raw), len(raw)), raw, pixels, describer)

    def _described(keys, raw, pixels, describer):
        shapes: dict[tuple, list[int]] = {}
        for k, p in enumerate(pixels):
            if p is not None:
                shapes.setdefault(p.shape, []).append(k)
        parts = [describer(np.stack([pixels[k] for k in own]), scales) | {"row": np.array(own)} for own in shapes.values()]
        parts = [p | {"row": p["row"][p["image"]]} for p in parts] or [describer(np.zeros((1, 1, 1), np.uint8), scales) | {"row": np.zeros(0, int)}]
        d = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        d = {k: v[np.argsort(d["row"], kind="stable")] for k, v in d.items()}
        fields = [pa.array(d[f].astype(np.float32)) for f in ("x", "y", "angle", "scale")] + [_lists(describer.keys(d["bits"])), _lists(describer.words(d["bits"]))]
        bounds = np.searchsorted(d["row"], np.arange(len(raw) + 1))
        corners = pa.StructArray.from_arrays(fields, ["x", "y", "angle", "scale", "keys", "bits"])
        corners = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), corners)
        packed = np.zeros(len(d["row"]), packed_type(settings))
        for f in ("x", "y", "angle", "scale"):
            packed[f] = d[f]
        packed["bits"] = describer.words(d["bits"]).view(np.uint64)
        packed = [packed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        digests = [hashlib.blake2b(x, digest_size=16).digest() if p is not None else None for x, p in zip(raw, pixels, strict=True)]
        return pa.RecordBatch.from_arrays([keys, pa.array(digests, pa.binary()), corners, pa.array(packed, pa.binary())], [key, "digest", "corners", "packed"])

    return media.select(key, image).mapInArrow(run, f"`{key}` {media.schema[key].dataType.simpleString()}, digest binary, corners {_CORNER}, packed binary")


def _entries(described: DataFrame, owner: str, prefix: str, settings: Settings) -> DataFrame:
    """One row for each corner and table."""
    corner = described.select(owner, F.posexplode("corners").alias(f"{prefix}n", "c"))
    keyed = corner.select(owner, f"{prefix}n", *[F.col(f"c.{f}").alias(f"{prefix}{f}") for f in ("x", "y", "angle", "scale")], *[F.col("c.bits")[i].alias(f"{prefix}b{i}") for i in range(settings.tests // 64)], F.posexplode("c.keys").alias("tbl", "key"))
    # Table and key in one number: keys have at most 56 bits.
    return keyed.withColumn("code", F.shiftleft("key", 7) + F.col("tbl")).drop("tbl", "key")


def corner_pairs(asked: DataFrame, stored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Corners of asked (query, corners) and of stored (digest, corners) that share a key and differ in few bits.

    A pair whose keys agree in several tables is one row: only the first of these tables reports it.
    """
    left, right = _entries(asked, "query", "q", settings), _entries(stored, "digest", "m", settings)
    differ = [F.col(f"qb{i}").bitwiseXOR(F.col(f"mb{i}")) for i in range(settings.tests // 64)]
    met = (left["code"] == right["code"]) & (sum((F.bit_count(d) for d in differ), F.lit(0)) <= settings.distance)
    for tbl, mask in enumerate(Describer(settings).masks()[:-1]):
        # Keys agree where no bit of the table's subset differs.
        inside = [d.bitwiseAND(F.lit(int(m)).cast("bigint")) != 0 for d, m in zip(differ, mask, strict=True)]
        met &= (left["code"].bitwiseAND(F.lit(127)) <= tbl) | reduce(or_, inside)
    return left.join(right, met).drop("code")


def compare(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows of query, digest, asked and stored (packed corners) that are copies: query, digest and the best transform."""
    ship(pairs.sparkSession)

    def run(batches):
        comparer = Comparer(settings)
        for batch in batches:
            found = [comparer(a.as_py(), b.as_py()) for a, b in zip(batch.column("asked"), batch.column("stored"), strict=True)]
            rows = pa.array([k for k, f in enumerate(found) if f], pa.int64())
            best = zip(*[f for f in found if f], strict=True) if len(rows) else [[]] * 4
            values = [pa.array(list(v), t) for v, t in zip(best, (pa.int64(), *[pa.float64()] * 3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("query").take(rows), batch.column("digest").take(rows), *values], ["query", "digest", "inliers", "ts", "tc", "size"])

    return pairs.select("query", "digest", "asked", "stored").mapInArrow(run, "query binary, digest binary, inliers bigint, ts double, tc double, size double")


def find_copies(media: DataFrame, queries: DataFrame, settings: Settings = Settings(), key: str = "media_id", image: str = "image") -> DataFrame:
    """Rows of two kinds: `member`, one for each row of media, and `match`, one for each query and class that it copies.

    member: media_id and class_id, the smallest key of the rows with an equal image; a row that doesn't decode has a
    null class.  match: media_id (the query's), class_id, inliers, rotation (degrees), scale.  So equal images aren't
    expanded in matches, and no link is lost.  Images that are null, too small or flat match nothing.  Rows that
    repeat a key are members; classes whose keys are all null have a null class_id.  Other columns are ignored.
    """
    described = materialize(describe(media, settings.stored_scales, settings, key, image), "media")
    asked = materialize(describe(queries, settings.asked_scales, settings, key, image).where("digest is not null"), "asked")
    decoded = described.where("digest is not null")
    classes = decoded.groupBy("digest").agg(F.min(key).alias("class_id"))
    # Equal images are compared once, on either side.
    pairs = corner_pairs(asked.groupBy(F.col("digest").alias("query")).agg(F.first("corners").alias("corners")), decoded.groupBy("digest").agg(F.first("corners").alias("corners")), settings)
    met = materialize(pairs.groupBy("query", "digest").agg(F.count_distinct("qn").alias("n")).where(F.col("n") >= settings.meetings).select("query", "digest", F.pmod(F.xxhash64("digest"), F.lit(16)).alias("slice")), "met")
    whole = decoded.select("digest", "packed").join(met.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("packed").alias("stored"))
    sought = asked.groupBy(F.col("digest").alias("query")).agg(F.first("packed").alias("asked"))
    # A query that meets many images is dealt over slices of them.
    sought = met.select("query", "slice").distinct().join(sought, "query")
    best = compare(met.join(whole, "digest").join(sought, ["query", "slice"]), settings)
    out = asked.select(F.col(key).alias("query_id"), F.col("digest").alias("query")).distinct().join(best, "query").join(classes, "digest")
    rotation = F.pmod(F.round(F.degrees(F.atan2("ts", "tc"))), F.lit(360)).cast("int")
    kind = media.schema[key].dataType.simpleString()
    matches = out.select(F.lit("match").alias("kind"), F.col("query_id").cast(kind).alias("media_id"), "class_id", "inliers", rotation.alias("rotation"), F.round("size", 2).alias("scale"))
    members = described.select(key, "digest").join(classes.select("digest", "class_id"), "digest", "left")
    return members.select(F.lit("member").alias("kind"), F.col(key).alias("media_id"), "class_id", *[F.lit(None).cast(t).alias(n) for n, t in (("inliers", "long"), ("rotation", "int"), ("scale", "double"))]).union(matches)


# The driver's tables hold no media: an embedding is drawn as a grey map, a blend of fixed textures weighted by its
# values, so that near vectors look alike; a query is an edited copy.


def textures(n: int, side: int) -> np.ndarray:
    """n fixed patterns of side x side, smooth enough to have corners of several sizes."""
    return _box(np.random.default_rng(11).normal(size=(n, side, side)), 1).reshape(n, -1)


SIDE = 96


def drawn(vectors: np.ndarray, patterns: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A stack of images, one for each row."""
    full = vectors @ patterns[: vectors.shape[1]]
    spread = np.maximum(full.std(1, keepdims=True), 1e-9)
    return np.clip(128 + 55 * (full - full.mean(1, keepdims=True)) / spread, 0, 255).astype(np.uint8).reshape(-1, side, side)


def turned(pixels: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the centre, bilinear; what comes from outside is grey."""
    h, w = pixels.shape
    cos, sin = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    u, v = cos * x - sin * y + (w - 1) / 2, sin * x + cos * y + (h - 1) / 2
    u0, v0 = np.clip(np.floor(u).astype(int), 0, w - 2), np.clip(np.floor(v).astype(int), 0, h - 2)
    fu, fv = np.clip(u - u0, 0, 1), np.clip(v - v0, 0, 1)
    top = pixels[v0, u0] * (1 - fu) + pixels[v0, u0 + 1] * fu
    low = pixels[v0 + 1, u0] * (1 - fu) + pixels[v0 + 1, u0 + 1] * fu
    return np.where((u < 0) | (u > w - 1) | (v < 0) | (v > h - 1), 128.0, top * (1 - fv) + low * fv)


def edited(pixels: np.ndarray, seed: int) -> np.ndarray:
    """An edit in other tones, by turns: a crop of three quarters turned by a multiple of 90 degrees; a free turn; a
    smaller size; noise."""
    kind, k = (seed // 50) % 4, seed // 200
    h, w = pixels.shape
    if kind == 0:
        y, x = k % 3 * (h // 8), k // 3 % 3 * (w // 8)
        out = np.rot90(pixels[y : y + h * 3 // 4, x : x + w * 3 // 4], k % 4)
    elif kind == 1:
        out = turned(pixels.astype(float), 7 + 31 * (k % 11))
    elif kind == 2:
        out = _resized(pixels[None].astype(float), (0.9, 0.8, 0.75)[k % 3])[0]
    else:
        out = pixels + np.random.default_rng(seed).normal(0, 12, pixels.shape)
    return np.clip(out * 0.8 + 20, 0, 255).astype(np.uint8)


def draw_media(vectors: DataFrame, edit: bool = False, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """media_id and image for each row; null vectors have no image."""
    ship(vectors.sparkSession)

    def run(batches):
        patterns = None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, rows = part.column(key).to_pylist(), part.column(vector).to_pylist()
                width = max((len(v) for v in rows if v), default=0)
                if patterns is None or len(patterns) < width:
                    patterns = textures(max(width, 1), SIDE)
                full = np.zeros((len(rows), max(width, 1)))
                for k, v in enumerate(rows):
                    if v:
                        full[k, : len(v)] = np.nan_to_num(np.array([0 if e is None else e for e in v], float))
                pixels = drawn(full, patterns)
                images = [None if not v else encode_pgm(edited(p, i or 0) if edit else p) for i, v, p in zip(ids, rows, pixels, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(images, pa.binary())], ["media_id", "image"])

    return vectors.select(key, vector).mapInArrow(run, f"media_id {vectors.schema[key].dataType.simpleString()}, image binary")
