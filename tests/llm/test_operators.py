"""Each operator against a brute-force version on small tables, and its edge cases."""

import base64
import dataclasses
import hashlib
import json
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import functions as F

from lodestone.llm import image_copies, lsh_forest, piece_codec, quality_classifier, quality_rules, slot_shards, suffix_levels, temperature_mix, url_filter, warc_zst
from lodestone.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: A null text, empty and blank ones, ties, repeated rows, null columns, odd characters.
ODD = [(1, None), (2, ""), (3, "   "), (4, "one"), (5, "one"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "\u2581x  y \n\t z\u0000 <s> <0x41> 漢字 🎈"), (None, "no id here at all, none"), (8, " lead"), (9, "trail  "), (10, "é" * 40)]


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in pairs], SCHEMA)


def prose(draw, words, vocabulary=400):
    return " ".join("".join(draw.choice("aeioustrnm") for _ in range(draw.randrange(2, 8))) if draw.random() < 0.3 else f"w{draw.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    texts = [prose(draw, draw.randrange(5, 160)) for _ in range(60)]
    passage = prose(draw, 40)
    out = [(100 + i, t) for i, t in enumerate(texts)]
    out += [(200 + i, texts[i % 7]) for i in range(20)]  # exact copies
    for i in range(25):  # near copies
        words = texts[10].split(" ")
        words[draw.randrange(len(words))] = f"x{i}"
        out.append((300 + i, " ".join(words)))
    out += [(400 + i, prose(draw, 20) + "\n" + passage + "\n" + prose(draw, 20)) for i in range(6)]
    return out + [(500, "ab " * 300), (501, prose(draw, 6000))]


def test_hashes_do_not_collide_by_construction():
    """A Thue-Morse string and its complement, which polynomials modulo 2^64 can't tell apart; and a large vocabulary."""
    from lodestone.llm.common import span_hashes

    for size in (64, 512, 1024, 4096):
        bit = np.array([bin(i).count("1") & 1 for i in range(size)], np.uint8)
        both = np.concatenate([97 + bit, 98 - bit])
        a, b = span_hashes(both, np.array([0, size]), np.array([size, 2 * size]))
        assert a != b
    words = [f"{i:x}" for i in range(200000)] + ["", "a", "a\0", "aa" * 8, "a" * 9, "a" * 700, "a" * 701]
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer("".join(words).encode(), np.uint8)
    assert len(np.unique(span_hashes(data, ends - [len(w) for w in words], ends))) == len(set(words))
    line = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    text = line + "\n" + line.translate(str.maketrans("ab", "ba"))
    columns, *_ = quality_rules.judge(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), quality_rules.LineRules())
    assert columns["n_dup_lines"].tolist() == [0]


# 1


def test_pieces(spark, corpus):
    pairs = ODD + corpus
    piece = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_codec.digests(piece_codec.encode_decode(frame(spark, pairs), MODEL)).collect())
    want = Counter()
    for i, t in pairs:
        ids = piece.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(piece.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    assert piece_codec.encode_decode(frame(spark, []), MODEL).count() == 0


def test_piece_table_is_bounded(monkeypatch, corpus):
    monkeypatch.setattr(piece_codec, "TABLE_CHARACTERS", 60)
    run = piece_codec._encode_batches(MODEL, "text", ["doc_id"])
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in corpus], "text": [t for _, t in corpus]})
    piece = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = [x for b in run([batch, batch]) for x in b.column("ids").to_pylist()]
    assert got == [piece.encode(t) for _, t in corpus] * 2


def test_pieces_of_long_chunks(spark, monkeypatch):
    """Chunks too long for the table, and a table that is started anew all the time."""
    monkeypatch.setattr(piece_codec, "TABLE_CHARACTERS", 20)
    monkeypatch.setattr(piece_codec, "LONG_CHUNK", 6)
    piece = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["x" * 5000 + " y", "abcdefghij klmnop abcdefghij", "a" + " " * 40, " " * 30, "ab cd " * 50]
    run = piece_codec._encode_batches(MODEL, "text", ["doc_id"])
    out = [b for b in run([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])])]
    got = [(ids, shown) for b in out for ids, shown in zip(b.column("ids").to_pylist(), b.column("decoded").to_pylist(), strict=True)]
    assert got == [(piece.encode(t), piece.decode(piece.encode(t))) for t in texts]


# 2


def plain_repeats(pairs, width=100):
    seen, out = set(), []
    for i, t in sorted(pairs, key=lambda p: p[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                gone[k : k + width] = b"\1" * width
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), len(b) - len(kept), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), kept))
    return out


@pytest.mark.parametrize("hot", [4000, 2])
def test_repeats(spark, corpus, hot):
    pairs = [p for p in dict((i, (i, t)) for i, t in ODD if i is not None).values()] + corpus
    cfg = suffix_levels.Repeats(hot=hot, hot_batch=3 if hot == 2 else 64)
    df = suffix_levels.remove_repeats(frame(spark, pairs).repartition(5), cfg)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in df.collect())
    assert got == plain_repeats(pairs)


def test_repeats_of_odd_rows(spark):
    long = "q" * 30 + " many words follow here to make a text that is longer than a window of one hundred bytes, surely"
    rows = suffix_levels.remove_repeats(frame(spark, [(1, long), (1, long), (2, long), (None, long + "!"), (3, None)])).collect()
    assert [r["n_removed"] for r in rows if r["doc_id"] == 1] == [len(long)] * 2  # the row without an id comes first
    assert [r["n_removed"] for r in rows if r["doc_id"] == 2] == [len(long)]
    assert [r["n_removed"] for r in rows if r["doc_id"] is None] == [0]
    assert suffix_levels.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [4000, 2])
def test_batches_meet_stored_levels(spark, corpus, tmp_path, hot):
    """Batch after batch against brute force over all of them; like levels merge, and a reopened index goes on."""
    draw = random.Random(21)
    whole = list(corpus)
    draw.shuffle(whole)
    cfg = suffix_levels.Repeats(hot=hot, hot_batch=3 if hot == 2 else 64)
    folder, done = (tmp_path / "index").as_uri(), []
    for k in range(5):
        batch = [(i, t) for i, t in sorted(whole[k * 25 : (k + 1) * 25])]
        index = suffix_levels.SuffixIndex(spark, folder, cfg, buckets=7)
        assert index.state["version"] == k and len(index.state["batches"]) == k
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in index.add(frame(spark, batch).repartition(3)).collect())
        ordered = [((b, i), t) for b, own in enumerate([*done, batch]) for i, t in own]
        assert got == sorted((i[1], *rest) for i, *rest in plain_repeats(ordered) if i[0] == k)
        done.append(batch)
    sizes = [x["bytes"] for x in index.state["levels"]]
    assert len(sizes) < 5 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert index.add(frame(spark, [])).count() == 0


def test_rows_without_a_key_are_apart(spark):
    draw = random.Random(2)
    texts = [prose(draw, 60) for _ in range(20)]
    rows = suffix_levels.remove_repeats(frame(spark, [(None, t) for t in texts] + [(0, texts[3])])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0] * 20 + [len(texts[3])]


@pytest.mark.parametrize("crowd_first", [False, True])
def test_crowds_meet_small_batches(crowd_first):
    """A batch with 2 reaches of a head and a crowded batch with the same two as its lowest."""
    cfg = suffix_levels.Repeats(hot_batch=3)

    def batch(reaches, doc):
        n = len(reaches)
        return {"head": np.full(n, 9 << 40, np.uint64), "reach": np.array(reaches, np.uint64) << np.uint64(33), "batch": np.zeros(n, np.int32), "doc": np.full(n, doc), "tag": np.zeros(n, np.uint32), "lo": np.arange(n) * 200, "n": np.ones(n, np.int32), "hot": np.zeros(n, np.uint8)}

    small, _ = suffix_levels.suffix_array(batch([1, 2], 0))
    marked, crowd = suffix_levels._crowds(suffix_levels.suffix_array(batch([1, 2, 3, 4, 5], 1))[0], cfg)
    assert len(marked["lo"]) == 2 and len(crowd["lo"]) == 5
    family = suffix_levels.Levels()
    for run in (marked, small) if crowd_first else (small, marked):
        family.add(run)
    spans, edges = family.finish()
    assert sorted(spans["doc"]) == [1, 1] and sorted(edges["doc"]) == [0, 0]
    assert edges["hot"].all()


@pytest.mark.parametrize("crowd_first", [False, True])
def test_repeats_of_crowds_met_before(spark, crowd_first):
    """Texts share a passage; one partition holds the two lowest reaches of its head, the other these and many more."""
    draw, cfg = random.Random(12), suffix_levels.Repeats(hot_batch=3)
    core = prose(draw, 40)[:150]
    texts = sorted({prose(draw, 30)[:110] + core + prose(draw, 30)[:110] for _ in range(40)})
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows = suffix_levels.anchors(data, offsets, np.arange(40), np.zeros(40, np.uint32), cfg)
    head = Counter(rows["head"].tolist()).most_common(1)[0][0]
    own = rows["head"] == np.uint64(head)
    lowest = rows["doc"][own][np.argsort(rows["reach"][own])][:2].tolist()
    pairs = [(i, texts[k]) for i, k in enumerate(lowest)] + [(10 + k, t) for k, t in enumerate(texts)]
    parts = [frame(spark, p).coalesce(1) for p in (pairs[:2], pairs[2:])]
    df = parts[crowd_first].union(parts[not crowd_first])
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_levels.remove_repeats(df, cfg).collect())
    assert got == plain_repeats(pairs)


def test_levels_fall_geometrically():
    draw, family = np.random.default_rng(1), suffix_levels.Levels()
    for i in range(40):
        n = 50
        rows = {"head": draw.integers(0, 1 << 62, n).astype(np.uint64), "reach": draw.integers(0, 1 << 62, n).astype(np.uint64), "batch": np.zeros(n, np.int32), "doc": np.full(n, i), "tag": np.zeros(n, np.uint32), "lo": np.arange(n), "n": np.ones(n, np.int32), "hot": np.zeros(n, np.uint8)}
        family.add(suffix_levels.suffix_array(rows)[0])
        sizes = [len(x["head"]) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == n * (i + 1)


# 3


def test_image_copies(spark):
    draw = np.random.default_rng(4)
    vectors = [(i, draw.normal(size=64).tolist()) for i in range(120)] + [(500, None), (501, []), (502, [0.0] * 64)]
    vectors += [(600, vectors[0][1]), (600, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").withColumn("digest", F.lit(1)).withColumn("corners", F.lit("x"))
    media = image_copies.draw_media(df)
    queries = image_copies.draw_media(df.where("vec_id % 10 = 0"), edit=True)
    rows = image_copies.find_copies(media, queries).collect()
    got = {(r["media_id"], r["class_id"]) for r in rows if r["kind"] == "match"}
    wanted = {(i, 0 if i == 600 else i) for i in range(0, 120, 10)} | {(600, 0)}
    assert len(wanted & got) >= 0.9 * len(wanted)
    assert got - wanted <= {(0, 0)}
    members = Counter((r["media_id"], r["class_id"]) for r in rows if r["kind"] == "member")
    assert members == Counter({(i, None if i in (500, 501) else 0 if i == 600 else i): 2 if i == 600 else 1 for i, _ in vectors})
    assert image_copies.decode_pgm(b"P5\n2 2\n255\n123") is None and image_copies.decode_pgm(None) is None
    assert image_copies.decode_pgm(image_copies.encode_pgm(np.arange(6).reshape(2, 3))).tolist() == [[0, 1, 2], [3, 4, 5]]
    empty = df.limit(0)
    assert image_copies.find_copies(image_copies.draw_media(empty), image_copies.draw_media(empty)).count() == 0
    assert image_copies.find_copies(media, image_copies.draw_media(empty)).count() == len(vectors)


def test_image_copies_against_brute_force(spark):
    """Links of whole descriptors, all pairs compared: the tables find nearly all images that brute force links, and no other."""
    draw, s = np.random.default_rng(8), image_copies.Settings()
    images = image_copies.drawn(draw.normal(size=(40, 64)), image_copies.textures(64, image_copies.SIDE))
    big = image_copies.drawn(draw.normal(size=(1, 64)), image_copies.textures(64, 400), 400)[0]  # a large image, and a small part of it
    shape = "media_id bigint, image binary"
    stored = {i: p for i, p in enumerate(images)} | {900: big}
    asked = {i: image_copies.edited(images[i], 50 * i) for i in range(40)} | {900: big[250:330, 40:120]}
    describer, want = image_copies.Describer(s), set()
    described = {i: describer(p[None], s.stored_scales) for i, p in stored.items()}
    for q, p in asked.items():
        own = describer(p[None], s.asked_scales)
        for m, other in described.items():
            near = (own["bits"][:, None] != other["bits"][None]).sum(2) <= s.distance
            turn = np.round((other["angle"][None] - own["angle"][:, None]) / (np.pi / 12)) % 24
            votes = Counter(t for t, ok in zip(turn.ravel(), near.ravel(), strict=True) if ok)
            if votes and max(votes.values()) >= 2 * s.inliers:
                want.add((q, m))
    frames = [spark.createDataFrame([(i, image_copies.encode_pgm(p)) for i, p in d.items()], shape) for d in (stored, asked)]
    got = {(r["media_id"], r["class_id"]) for r in image_copies.find_copies(*frames).collect() if r["kind"] == "match"}
    assert {(i, i) for i in asked} >= got and len(want) >= 36
    assert len(got & want) >= 0.9 * len(want) and (900, 900) in got


def test_image_copies_pairs_of_corners_once(spark):
    """In a group of near copies, corners that meet in several tables are one row, and no pair is lost."""
    draw, s = np.random.default_rng(6), image_copies.Settings(tables=3)
    base = draw.normal(size=64)
    images = image_copies.drawn(np.stack([base + draw.normal(0, 0.08, 64) for _ in range(8)] + [draw.normal(size=64) for _ in range(3)]), image_copies.textures(64, image_copies.SIDE))
    shape = "media_id bigint, image binary"
    stored = spark.createDataFrame([(i, image_copies.encode_pgm(p)) for i, p in enumerate(images)], shape)
    asked = spark.createDataFrame([(i, image_copies.encode_pgm(image_copies.edited(images[i], 50 * i))) for i in (0, 1, 3, 9)], shape)
    stored = image_copies.describe(stored, s.stored_scales, s).select(F.col("media_id").alias("digest"), "corners")
    asked = image_copies.describe(asked, s.asked_scales, s).select(F.col("media_id").alias("query"), "corners")
    want, met = set(), 0
    others = [(r["digest"], r["corners"]) for r in stored.collect()]
    unpacked = {d: (np.array([c["keys"] for c in corners]), np.unpackbits(np.array([c["bits"] for c in corners]).view(np.uint8), axis=1)) for d, corners in others}
    for r in asked.collect():
        for qn, c in enumerate(r["corners"]):
            bits = np.unpackbits(np.array(c["bits"]).view(np.uint8))
            for d, (keys, far) in unpacked.items():
                shared = (keys == np.array(c["keys"])).sum(1) * ((far != bits).sum(1) <= s.distance)
                want |= {(r["query"], d, qn, int(mn)) for mn in np.flatnonzero(shared)}
                met += int(shared.sum())
    got = Counter(image_copies.corner_pairs(asked, stored, s).select("query", "digest", "qn", "mn").collect())
    assert got == Counter(want) and met > 1.1 * len(want)
    assert len({(q, d) for q, d, _, _ in want if q < 8 and d < 8}) >= 20  # the group's links


def test_image_copies_in_a_group_of_near_copies(spark):
    """Every query of a group of near copies is linked with nearly all of them, as brute force does, and with no other."""
    draw = np.random.default_rng(12)
    base = draw.normal(size=64)
    vectors = [(i, (base + draw.normal(0, 0.13, 64)).tolist()) for i in range(60)] + [(i, draw.normal(size=64).tolist()) for i in range(60, 90)]
    df = spark.createDataFrame([*vectors, (None, vectors[0][1])], "vec_id bigint, embedding array<double>")
    media = image_copies.draw_media(df.where("vec_id is not null"))
    asked = image_copies.draw_media(df.where("vec_id % 6 = 0 or vec_id is null"), edit=True)
    got = {(r["media_id"], r["class_id"]) for r in image_copies.find_copies(media, asked).collect() if r["kind"] == "match"}
    group = {(q, m) for q in [None, *range(0, 60, 6)] for m in range(60)}
    alone = {(q, q) for q in range(60, 90, 6)}
    assert len(got & group) >= 0.95 * len(group) and len(got & alone) >= 4 and got <= group | alone


def test_image_copies_compared_whole():
    """Large images are compared by tables, in blocks: the same transforms as with every corner against every other."""
    s, side = image_copies.Settings(), 160
    images = image_copies.drawn(np.random.default_rng(2).normal(size=(4, 64)), image_copies.textures(64, side), side)
    describer = image_copies.Describer(s)

    def packed(pixels, scales):
        d = describer(pixels[None], scales)
        out = np.zeros(len(d["x"]), image_copies.packed_type(s))
        for f in ("x", "y", "angle", "scale"):
            out[f] = d[f]
        out["bits"] = describer.words(d["bits"]).view(np.uint64)
        return out.tobytes()

    stored = [packed(p, s.stored_scales) for p in images]
    asked = [packed(image_copies.edited(p, 50 * i), s.asked_scales) for i, p in enumerate(images)]
    whole, blocks, tables = image_copies.Comparer(s), image_copies.Comparer(s), image_copies.Comparer(dataclasses.replace(s, compared=0))
    blocks.block = tables.block = 3000
    for i, q in enumerate(asked):
        for j, m in enumerate(stored):
            want, got, near = whole(q, m), blocks(q, m), tables(q, m)
            assert (want is None) == (got is None) == (near is None) == (i != j)
            if want:
                assert got == pytest.approx(want) and 0.7 * want[0] <= near[0] <= want[0]
    assert whole(b"", stored[0]) is whole(asked[0], b"") is tables(b"", b"") is None


def test_image_copies_resized_turned_noisy(spark):
    """Recall of edits that change every pixel, on maps of 128 pixels."""
    side, draw = 128, np.random.default_rng(4)
    images = image_copies.drawn(draw.normal(size=(60, 64)), image_copies.textures(64, side), side)

    def turned(p, degrees):
        t, mid = np.deg2rad(degrees), (side - 1) / 2
        yy, xx = np.mgrid[:side, :side] - mid
        y, x = mid + yy * np.cos(t) - xx * np.sin(t), mid + yy * np.sin(t) + xx * np.cos(t)
        y0, x0 = (np.clip(np.floor(v).astype(int), 0, side - 2) for v in (y, x))
        fy, fx, p = y - y0, x - x0, p.astype(float)
        low, high = (p[y0 + k, x0] * (1 - fx) + p[y0 + k, x0 + 1] * fx for k in (0, 1))
        return np.where((np.abs(y - mid) <= mid) & (np.abs(x - mid) <= mid), low * (1 - fy) + high * fy, 128)

    edits = [lambda p: turned(p, 30), lambda p: turned(p, 10), lambda p: p + draw.normal(0, 15, p.shape), lambda p: p.reshape(side // 2, 2, side // 2, 2).mean((1, 3)), lambda p: image_copies._resized(p[None].astype(float), 0.8)[0]]
    shape = "media_id bigint, image binary"
    media = spark.createDataFrame([(i, image_copies.encode_pgm(p)) for i, p in enumerate(images)], shape)
    asked = [(100 * n + i, image_copies.encode_pgm(np.clip(edit(images[i]), 0, 255))) for n, edit in enumerate(edits) for i in range(0, 60, 6)]
    found = {(r["media_id"], r["class_id"]) for r in image_copies.find_copies(media, spark.createDataFrame(asked, shape)).collect() if r["kind"] == "match"}
    for n in range(len(edits)):
        assert sum((100 * n + i, i) in found for i in range(0, 60, 6)) >= 9
    assert all(q % 100 == m for q, m in found)


# 4


def test_shards(spark, corpus):
    pairs = ODD + corpus
    df, used = slot_shards.shard(frame(spark, pairs), 5, slots=64)
    rows = df.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert used.version == 2 and all(used.shard_of[r["virtual_slot"]] == r["shard"] for r in rows)
    assert slot_shards.shard(frame(spark, []), 5)[0].count() == 0


def spark_hash(data: bytes, seed: int = 42) -> int:
    """xxhash64 of Spark as a signed number."""
    x = xxhash.xxh64_intdigest(data, seed)
    return x - (1 << 64) if x >> 63 else x


def test_shards_against_brute_force(spark, tmp_path):
    """Equal texts stay together unless they outweigh their part; loads are near equal; the stored map places every row."""
    draw = random.Random(17)
    pairs = [(i, prose(draw, draw.randrange(5, 60))) for i in range(1500)] + [(2000 + i, "small group") for i in range(3)] + [(3000 + i, "a large group of copies " * 8) for i in range(700)]
    docs, folder = frame(spark, pairs).withColumns({"virtual_slot": F.lit("x"), "heavy": F.lit(1), "size": F.lit("y"), "shard": F.lit(2)}), tmp_path.as_uri()
    df, used = slot_shards.shard(docs, 6, slots=512, folder=folder)
    rows = df.collect()
    text, total = dict(pairs), sum(len(t.encode()) + 8 for _, t in pairs)
    weight = Counter()
    for _, t in pairs:
        weight[t] += len(t.encode()) + 8
    for r in rows:
        t = text[r["doc_id"]]
        heavy = weight[t] > total / (6 * slot_shards.PARTS)
        h = spark_hash(t.encode())
        if heavy:
            h = spark_hash(struct.pack("<q", r["doc_id"]), spark_hash(struct.pack("<q", h)) & (1 << 64) - 1)
        assert r["virtual_slot"] == spark_hash(struct.pack("<q", h)) % 512
    together = defaultdict(set)
    for r in rows:
        together[text[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for t, v in together.items() if weight[t] <= total / (6 * slot_shards.PARTS)) and len(together["a large group of copies " * 8]) == 6
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 6 and max(loads.values()) <= 1.01 * total / 6 and min(loads.values()) >= 0.99 * total / 6
    assert slot_shards.newest_version(spark, folder) == used.version == 2
    # Other rows later: the map goes on from the stored version, and few slots move.
    more, third = slot_shards.shard(frame(spark, [*pairs, *[(5000 + i, prose(draw, 30)) for i in range(300)]]), 6, slots=512, folder=folder)
    assert third.version == 3 and len({s for s, _, _ in third.edits}) < 256
    moved = {s for s in range(512) if third.shard_of[s] != used.shard_of[s]}
    assert moved <= {s for s, _, _ in third.edits} and more.count() == len(pairs) + 300


def test_slot_maps(spark, tmp_path):
    draw = random.Random(5)
    loads = {s: draw.randrange(1, 1000) for s in range(512)}
    first = slot_shards.SlotMap.balanced(loads, 8, 512)
    total = first.loads(loads)
    assert max(total) - min(total) <= 1000
    loads[7] += 20_000
    second = first.rebalanced(loads)
    assert second.version == 2 and 0 < len(second.edits) < 400
    changed = [s for s in range(512) if first.shard_of[s] != second.shard_of[s]]
    assert {s for s, _, _ in second.edits} == set(changed)
    grown = first.rebalanced({s: 10 for s in range(512)}, n_shards=9, tolerance=0.05)
    assert all(a == b or b == 8 for a, b in zip(first.shard_of, grown.shard_of, strict=True)) or max(grown.loads({s: 10 for s in range(512)})) <= 1.05 * 5120 / 9 + 10
    second.save(spark, tmp_path.as_uri())
    assert slot_shards.SlotMap.load(spark, tmp_path.as_uri(), 2).shard_of == second.shard_of


# 5


def test_classifier(spark):
    draw = random.Random(6)
    good = [(5000 + i, prose(draw, 60).capitalize() + ".") for i in range(120)]
    bad = [(7000 + i, " | ".join(prose(draw, 60).upper().split(" ")[:40])) for i in range(60)]
    docs = frame(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:80]] + [(i, 0) for i, _ in bad[:40]] + [(5, None), (6, 0), (6, 1), (None, 1)], "doc_id bigint, quality int")
    settings = quality_classifier.Settings(bits=14)
    model = quality_classifier.train(docs, labels, settings)
    scores = defaultdict(list)
    for r in quality_classifier.score(docs, model, settings).collect():
        scores[r["doc_id"]].append(r["score"])
    assert all(scores[i][0] >= 0.7 for i, _ in good[80:]) and all(scores[i][0] < 0.7 for i, _ in bad[40:])
    assert scores[1] == scores[2] == scores[3] and scores[4] == scores[5] and len(scores[6]) == 2
    empty = quality_classifier.train(docs, labels.where("quality = 1"), settings)
    assert {r["score"] for r in quality_classifier.score(docs, empty, settings).collect()} == {0.5}


def test_classifier_of_odd_rows(spark):
    """Repeated keys, empty and very long texts: the model and the scores don't depend on how rows lie."""
    draw = random.Random(16)
    good = [(i, prose(draw, 40).capitalize() + ".") for i in range(40)]
    bad = [(100 + i, "| # " * 20) for i in range(40)]
    long = (300, prose(draw, 150000))
    pairs = [*good, *bad, (0, "| # " * 20), (100, good[3][1]), (1, None), (2, ""), long, (None, good[5][1])]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in [*good, *bad]], "doc_id bigint, quality int")
    settings = quality_classifier.Settings(bits=12)
    models = [quality_classifier.train(frame(spark, own).repartition(n), labels, settings) for own, n in ((pairs, 1), (pairs[::-1], 5))]
    assert np.array_equal(models[0][0], models[1][0]) and models[0][1] == models[1][1]
    scores = [Counter((r["doc_id"], round(r["score"], 9)) for r in quality_classifier.score(frame(spark, own), models[0], settings).collect()) for own in (pairs, pairs[::-1])]
    assert scores[0] == scores[1] and sum(scores[0].values()) == len(pairs)
    assert quality_classifier.score(frame(spark, []), models[0], settings).count() == 0


def test_scores_against_a_plain_dot_product(spark):
    """Sparse rows against the features one by one, and FTRL against a scalar version."""
    texts = ["The cat sat, on the mat! $5", "a a a a a a b a a a a a", "", "é É x"]
    settings = quality_classifier.Settings(bits=10, epochs=2, batch=1)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    rows, labels = quality_classifier.sparse_rows(data, offsets, settings), np.array([1.0, 0.0, 1.0, 0.0])
    assert [round(float(v.sum())) for _, v in rows] == [6, 6, 0, 5] and len(rows[2][0]) == 0
    weights, bias = quality_classifier.fit(rows, labels, settings)
    z, n = defaultdict(float), defaultdict(float)

    def w(k):
        if abs(z[k]) <= settings.l1:
            return 0.0
        return -(z[k] - math.copysign(settings.l1, z[k])) / ((settings.beta + math.sqrt(n[k])) / settings.alpha + settings.l2)

    draw = np.random.default_rng(settings.seed)
    for _ in range(2):
        for i in draw.permutation(4):
            own = dict(zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True)) | {"bias": 1.0}
            now = {k: w(k) for k in own}
            error = 1 / (1 + math.exp(-sum(now[k] * x for k, x in own.items()))) - labels[i]
            for k, x in own.items():
                g = error * x
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / settings.alpha * now[k]
                n[k] += g * g
    assert abs(bias - w("bias")) < 1e-9 and all(abs(weights[k] - w(k)) < 1e-6 for k in range(1024))


def test_classifier_holds_out(spark):
    """On the driver's rows, rows that weren't learned from."""
    from lodestone.llm import queries

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op5_quality_classifier(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.9 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


# 6


def plain_mix(tokens, repetition):
    """Copies of each source: bisect the exponent."""
    t = sorted(x for x in tokens.values() if x)
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        if (t[0] / t[-1]) ** (mid - 1) <= repetition:
            hi = mid
        else:
            lo = mid
    return {s: (x / t[-1]) ** (round(hi, 6) - 1) if x else 1.0 for s, x in tokens.items()}


def test_mixing(spark):
    draw = random.Random(7)
    pairs = [(i, "big" if i % 3 else "mid", prose(draw, draw.randrange(1, 40))) for i in range(300)] + [(900 + i, None, prose(draw, 10)) for i in range(12)] + [(950, "none", ""), (951, "none", None), (952, "big", "x y"), (952, "big", "x y")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, s, t in pairs], SCHEMA)
    rows = temperature_mix.mix(docs, repetition=2.0, blocks=16).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    tokens = defaultdict(int)
    for _, s, t in pairs:
        tokens[s] += size(t)
    want = plain_mix(tokens, 2.0)
    out = defaultdict(int)
    for r in rows:
        out[r["source"]] += size(r["text"])
    for s, x in tokens.items():
        assert want[s] * x - 40 <= out[s] <= want[s] * x + 1
    copies = Counter(r["doc_id"] for r in rows)
    assert set(copies) == {i for i, _, _ in pairs} and max(v for k, v in copies.items() if k != 952) <= 2
    assert copies[950] == copies[951] == 1
    per = defaultdict(set)
    for r in rows:
        per[r["doc_id"]].add(r["copy"])
    assert all(v == set(range(len(v))) for v in per.values())
    assert temperature_mix.mix(docs.limit(0)).count() == 0
    clash = temperature_mix.mix(docs.withColumns({"Copy": F.lit("x"), "whole": F.lit(1), "last": F.lit("y"), "room": F.lit(2)}), blocks=16)
    assert clash.count() == len(rows) and "Copy" not in clash.columns and {r["whole"] for r in clash.collect()} == {1}


def plain_copies(pairs, repetition, n_blocks):
    """How often each row of (id, source, text) is read: whole passes, then blocks in permuted order until the budget,
    the last of them cut at a row."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, _, t in pairs}
    tokens = Counter()
    for i, s, _ in pairs:
        tokens[s] += size[i]
    times = plain_mix(tokens, repetition)
    order = lambda *parts: hashlib.md5("|".join(["mix", *map(str, parts)]).encode()).hexdigest()
    want = Counter()
    for s, x in tokens.items():
        budget = math.floor(round(times[s] * x, 3))
        room, blocks = budget - budget // x * x, defaultdict(list)
        for i, own, _ in pairs:
            if own == s:
                want[i] += budget // x
                blocks[spark_hash(struct.pack("<q", i)) % n_blocks].append(i)
        for b in sorted(blocks, key=lambda b: (order("+" + s, b), b)):
            filled = 0
            for i in sorted(blocks[b], key=order):
                filled += size[i]
                if filled <= room:
                    want[i] += 1
            room = max(0, room - filled)
    return want


def test_mixing_against_brute_force(spark):
    draw = random.Random(23)
    pairs = [(i, draw.choice("aaaaaabbc"), prose(draw, draw.randrange(0, 30))) for i in range(500)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, s, t in pairs], SCHEMA).withColumns({c: F.lit(7) for c in ("of_0", "OF_1", "at_0", "passes_0", "cut_0", "__source", "mix_source")})
    got = Counter(r["doc_id"] for r in temperature_mix.mix(docs, repetition=2.5, blocks=8).collect())
    want = plain_copies(pairs, 2.5, 8)
    assert got == want


def test_mixing_without_keys(spark):
    """Rows without a key are dealt one by one, not all or none."""
    draw = random.Random(29)
    rows = [(None, prose(draw, 10), None, "b", 0) for _ in range(60)] + [(k, prose(draw, 10), None, "a", 0) for k in range(100)]
    got = Counter(r["text"] for r in temperature_mix.mix(spark.createDataFrame(rows, SCHEMA), repetition=1.5, blocks=8).collect())
    own = [got[r[1]] for r in rows[:60]]
    assert set(own) == {1, 2} and 85 <= sum(own) <= 90 and all(got[r[1]] == 1 for r in rows[60:])


def test_mixing_many_sources(spark):
    """The entropy target over thousands of sources, against a bisection over all of them."""
    sizes = [(f"s{k}", 1 + (k * k) % 9973) for k in range(3000)]
    row = temperature_mix.weights(spark.createDataFrame(sizes, "source string, tokens bigint"), repetition=None, entropy=0.97).first()
    total = sum(x for _, x in sizes)

    def entropy(a):
        p = [(x / total) ** a for _, x in sizes]
        z = sum(p)
        return -sum(q / z * math.log(q / z) for q in p)

    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (low, mid) if entropy(mid) <= 0.97 * math.log(len(sizes)) else (mid, high)
    assert abs(row["exponent"] - high) < 3e-6


def test_mixing_weights(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens bigint")
    rows = {r["source"]: r for r in temperature_mix.weights(totals, repetition=None, entropy=0.9).collect()}
    entropy = -sum(r["weight"] * math.log(r["weight"]) for r in rows.values())
    assert abs(entropy - 0.9 * math.log(3)) < 1e-3 and abs(sum(r["weight"] for r in rows.values()) - 1) < 1e-9
    rows = {r["source"]: r for r in temperature_mix.weights(totals, repetition=3.0).collect()}
    assert rows["a"]["copies"] == 1 and 2.8 <= rows["c"]["copies"] <= 3
    rows = {r["source"]: r for r in temperature_mix.weights(totals, repetition=3.0, budget=555).collect()}
    assert 552 <= sum(r["budget"] for r in rows.values()) <= 555
    assert temperature_mix.weights(totals.where("source = 'a'")).first()["copies"] == 1


# 7


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in rules:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return host, path, best and best.name, best.verdict if best else "allow"


def test_urls(spark):
    from lodestone.llm.queries import URL_RULES

    draw = random.Random(8)
    urls = [None, "", "no scheme.com/", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com/en", "http://a.net/x.com/", "http://xexample.com/en/", "a://b://c.com/", "http://com/", "http://.com/", "http://net/es/", "x://" + "a" * 3000 + ".net/fr/é", "http://ÉX.com/É"]
    urls += [f"http{draw.choice(['', 's'])}://{draw.choice(['', 'www.', 'm.', 'x.www.'])}{draw.choice(['example.com', 'b.net', 'net', 'c.org', 'example.com.net'])}{draw.choice(['', '/', '/en/1', '/es/2', '/fr', '/fr/'])}{draw.choice(['', '?a=/en/', '#/es/'])}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(df, URL_RULES).collect()}
    assert got == {i: plain_verdict(u, URL_RULES) for i, u in enumerate(urls)}


def test_long_urls(spark):
    from lodestone.llm.queries import URL_RULES

    urls = ["http://m.example.com/en/" + "x" * (2 << 20), "http://b.net/" + "é/" * (1 << 20), "http://" + "a." * 20000 + "com/", "u" * (1 << 20)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    assert {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(df, URL_RULES).collect()} == {i: plain_verdict(u, URL_RULES) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_globs():
    patterns = ["*.ex?mple.com/**", "a*b*c", "**/wp-*/x", "lit\\*eral", "", "**"] + ["p" * 70 + "*"]
    texts = ["m.example.com/a/b", "example.com/", "aXXbYc", "a/bc", "abc", "q/r/wp-admin/x", "lit*eral", "literal", "", "p" * 70 + "tail", "p" * 69]

    def plain(p):
        out, k = "", 0
        while k < len(p):
            if p[k] == "\\":
                out += re.escape(p[k + 1])
                k += 2
            elif p[k : k + 2] == "**":
                out += ".*"
                k += 2
            else:
                out += "[^/]*" if p[k] == "*" else "[^/]" if p[k] == "?" else re.escape(p[k])
                k += 1
        return re.compile(out, re.DOTALL)

    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = url_filter.ShiftAnd(patterns).matches(data, offsets)
    assert got.tolist() == [[bool(plain(p).fullmatch(t)) for p in patterns] for t in texts]


# 8


def test_archives(spark, tmp_path):
    pairs = [(i, f"<html>{'page ' * (i % 9)}{i % 9}</html>") for i in range(300)] + [(1000, None), (1001, ""), (1002, "é\r\n\r\nWARC/1.1"), (5, pytest.__name__)]
    df = spark.createDataFrame(pairs, "page_id bigint, html string").withColumn("payload", F.lit("clash")).repartition(3)
    df = df.withColumn("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://a.example/ü \n?q="), "page_id")))
    archives = warc_zst.write_pages(df)
    folder = (tmp_path / "files").as_uri()
    files = warc_zst.export_archives(archives, folder).collect()
    assert sum(r["n_records"] for r in files) == len(pairs) and all(r["file"].endswith(".warc.zst") for r in files)
    rows = warc_zst.read_files(spark, folder).select(warc_zst.record_key("record_id").cast("long").alias("i"), "*").collect()
    trip = warc_zst.round_trip(df).collect()
    plain = lambda r: (r["record_type"], r["record_id"], r["target_uri"], r["refers_to"], r["payload_digest"], r["payload_bytes"])
    assert Counter(map(plain, rows)) == Counter(map(plain, trip))
    assert {r["target_uri"] for r in rows if r["i"] in (6, 7)} == {"http://a.example/%C3%BC%20%0A?q=6", "urn:page:7"}
    keeper = {}
    for i, h in pairs:
        keeper[h or ""] = max(i, keeper.get(h or "", -1))
    got = Counter((r["i"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)
    want = Counter()
    for i, h in pairs:
        b, k = (h or "").encode(), keeper[h or ""]
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if k == i else "revisit", None if k == i else f"<urn:page:{k}>"] += 1
    assert got == want
    assert all(bytes(r["payload"]).decode() == dict((keeper[h or ""], h or "") for _, h in pairs)[r["i"]] for r in rows if r["record_type"] == "response")
    assert warc_zst.round_trip(df.limit(0)).count() == 0


def test_archives_of_odd_rows(spark, monkeypatch):
    """Null keys, very long and very common payloads, no url column."""
    monkeypatch.setattr(warc_zst, "HOT_ROWS", 4)
    long = "x" * (9 << 20)
    pairs = [(None, "a"), (None, "a"), (None, "b"), (1, "a"), (2, long), (3, long), *[(k, "") for k in range(10, 40)]]
    rows = warc_zst.round_trip(spark.createDataFrame(pairs, "page_id bigint, html string")).collect()
    got = Counter((r["record_id"][10:-1], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows)
    want = Counter({("", 1, "revisit", "<urn:page:1>"): 2, ("", 1, "response", None): 1, ("1", 1, "response", None): 1, ("2", len(long), "revisit", "<urn:page:3>"): 1, ("3", len(long), "response", None): 1})
    want += Counter((str(k), 0, "response" if k == 39 else "revisit", None if k == 39 else "<urn:page:39>") for k in range(10, 40))
    assert got == want


def test_revisits_are_held_against_responses(spark):
    shape = "record_type string, record_id string, refers_to string, payload_digest string, payload_bytes long"
    good = [("response", "<a>", None, "D", 3), ("revisit", "<b>", "<a>", "D", 3), ("response", "<c>", None, "E", 3)]
    warc_zst.check_revisits(spark.createDataFrame(good, shape))
    for bad in (("revisit", "<x>", "<c>", "D", 3), ("revisit", "<x>", "<a>", "D", 4), ("revisit", "<x>", "<a>", "F", 3)):
        with pytest.raises(ValueError):
            warc_zst.check_revisits(spark.createDataFrame([*good, bad], shape))


def test_archive_format():
    record = warc_zst.build_record([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", "http://a/"), ("Content-Type", "application/http; msgtype=response")], b"body")
    samples = [json.dumps({"k": i, "text": "words and words " * (i % 5)}).encode() for i in range(400)]
    for dictionary in (b"", warc_zst.trained(samples)):
        archive = warc_zst.write_archive([record, record], dictionary)
        assert archive[:4] == bytes.fromhex("5d2a4d18")
        assert list(warc_zst.read_archive(archive)) == [record, record]
        with pytest.raises(ValueError):
            list(warc_zst.read_archive(archive[:-3]))
    assert list(warc_zst.read_archive(zstandard.compress(record))) == [record]
    assert warc_zst.parse_record(record)[1] == b"body"
    for bad in (record[:-1], record.replace(b"WARC/1.1", b"WARC/9"), record.replace(b"Content-Length: 4", b"Content-Length: 5"), record.replace(b"WARC-Type", b"WARC-Record-ID"), record.replace(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b""), record.replace(b"WARC-Target-URI: http://a/\r\n", b"")):
        with pytest.raises(ValueError):
            warc_zst.parse_record(bad)


# 9


def plain_links(pairs):
    sets = []
    for _, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(pairs)
    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    members = defaultdict(list)
    for k in range(len(pairs)):
        members[find(k)].append(pairs[k][0])
    return Counter((pairs[k][0], min((i for i in members[find(k)] if i is not None), default=None), links[k]) for k in range(len(pairs)))


@pytest.mark.parametrize("block", [384, 4])
def test_near_duplicates(spark, corpus, block):
    pairs = ODD + corpus
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in lsh_forest.near_duplicates(frame(spark, pairs), lsh_forest.Forest(block=block)).collect())
    assert got == plain_links(pairs)


def test_near_duplicates_of_nothing(spark):
    assert lsh_forest.near_duplicates(frame(spark, [])).count() == 0
    assert lsh_forest.near_duplicates(frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (None, None)])).where("n_links = 1").count() == 2


def test_forest_depth_is_measured(spark):
    """Probes at the threshold: the fitted prefix is as long as theory lets it be, and longer where all sets lose little."""
    draw = random.Random(9)
    texts = [prose(draw, 200) for _ in range(300)]
    docs = frame(spark, list(enumerate(texts))).withColumn("text_key", F.xxhash64("text"))
    rows = [(i, t, lsh_forest.set_key(s), len(s)) for i, t in enumerate(texts) for s in lsh_forest.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)]
    classes = spark.createDataFrame(rows, "doc_id bigint, text string, set_key binary, n_shingles long").select("set_key", "n_shingles", F.struct(F.col("doc_id").alias("key"), F.xxhash64("text").alias("text_key")).alias("place"))
    forest = lsh_forest.Forest()
    depth = lsh_forest.fitted_depth(docs, classes, forest, "doc_id", "text")
    reach = lambda k, j: 1 - (1 - j**k) ** forest.trees
    assert reach(depth, 0.8) >= 0.995 and reach(depth + 2, 0.8) < forest.recall
    near = lsh_forest.fitted_depth(docs, classes, lsh_forest.Forest(threshold=(19, 20)), "doc_id", "text")
    assert near > depth
    assert lsh_forest.fitted_depth(docs, classes.limit(0), forest, "doc_id", "text") == forest.max_depth


def test_large_groups_are_compared_by_trie_node(spark):
    """A chain of texts, each near the next: one group, few links; and two crowds of like texts."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    pairs = [(i, " ".join(words[3 * i : 3 * i + 90])) for i in range(60)]
    crowd = [f"c{i}" for i in range(80)]
    pairs += [(1000 + i, " ".join([*crowd[:60], *draw.sample(crowd[60:], 1), *crowd[61:], "z"])) for i in range(50)]
    want = plain_links(pairs)
    for block in (8, 400):
        got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in lsh_forest.near_duplicates(frame(spark, pairs), lsh_forest.Forest(block=block)).collect())
        assert got == want


def test_components_with_a_hub(spark, monkeypatch):
    from lodestone.llm import components as c

    monkeypatch.setattr(c, "HOT_ROWS", 5)
    monkeypatch.setattr(c, "HOT_KEYS", 100)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200), (None, 3), (7, 0)]
    got = {(r["u"], r["root"]) for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {(i, 0) for i in range(1, 60)} | {(i, 100) for i in range(101, 141)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components(spark):
    draw = random.Random(9)
    edges = [(f"{draw.randrange(200):03d}", f"{draw.randrange(200):03d}") for _ in range(150)] + [("hub", f"{k:03d}") for k in range(0, 200, 9)] + [("x", "x"), (None, "y")]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


# 10


def plain_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    marked = set()
    for k in range(len(w) - 4):
        if grams[tuple(w[k : k + 5])] > 1:
            marked |= set(range(k, k + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked), len(w) < 10 or 100 * len(marked) > 20 * len(w)


def test_quality_rules(spark, corpus):
    pairs = [*ODD, *corpus, (600, "same line here\nsame line here\n\n  \nother\rline\nsame line here"), (601, "x#*$%&|<> y")]
    rows = quality_rules.apply_rules(frame(spark, pairs)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in rows) == Counter((i, *plain_rules(t or "")) for i, t in pairs)
    assert all(not r["kept"] for r in rows if r["base_failed"])


def test_line_rules(spark):
    draw = random.Random(10)
    clean = "\n".join(prose(draw, 14).capitalize() + "." for _ in range(8))
    junk = ["home | about | news | contact | more", "ALL THE SHOUTING WORDS GO HERE!!", "x$$$ y### z%%% w***", "All rights reserved.", "a long line that runs on and on without any end"]
    docs = [(1, clean), (2, clean + "\n" + junk[0] + "\n" + junk[3]), (3, "\n".join(junk * 3)), (4, clean + "\n" + clean.split("\n")[0] + "\n"), (5, junk[4] + "\n" + clean)]
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(frame(spark, docs)).collect()}
    assert rows[1]["kept"] and rows[1]["cleaned"] == clean
    assert rows[2]["kept"] and rows[2]["cleaned"] == clean and rows[2]["n_failed_lines"] == 2
    assert not rows[3]["kept"]
    assert rows[5]["kept"] and rows[5]["cleaned"] == clean
    kept = {r["doc_id"]: r for r in quality_rules.filter_documents(frame(spark, docs).withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert set(kept) == {k for k, r in rows.items() if r["kept"]} and all(len(r["text"]) == r["n_chars"] for r in kept.values())
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0


def test_line_rules_spare_prose(spark):
    """Several sentences in a line without a last stop, and boilerplate phrases inside words."""
    docs = [(1, "The river rose in spring. Nobody had seen it so high before. Boats were tied to the old bridge and"), (2, "They share one design in common, empowered by a small team."), (3, "Please share on every page you like, or sign in."), (4, "a long line that runs on and on without any end")]
    failed = {r["doc_id"]: r["n_failed_lines"] for r in quality_rules.apply_rules(frame(spark, docs)).collect()}
    assert failed == {1: 0, 2: 0, 3: 1, 4: 1}


def plain_line_fails(line, before):
    """The line rules, one by one, on a line with words."""
    rules, words = quality_rules.LineRules(), re.findall(r"[^\x20\x09-\x0D]+", line)
    letters, upper = len(re.findall("[A-Za-z]", line)), len(re.findall("[A-Z]", line))
    bars, symbols = line.count("|"), len(re.findall(r"[#*$%&<>]", line))
    if line in before or bars >= max(rules.min_bars, rules.bars_per_word * len(words)) or symbols >= rules.symbols_per_word * len(words):
        return True
    if len(words) >= rules.shout_words and upper and upper >= rules.shout_share * letters:
        return True
    if len(words) >= rules.min_terminated_words and not any(w[-1] in quality_rules._SENTENCE_ENDS for w in words):
        kind = unicodedata.category(words[-1][-1])
        if kind[0] not in "PNS" or kind == "Ps":
            return True
    phrases = [p for own in quality_rules.BOILERPLATE.values() for p in own]
    low = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return len(words) <= rules.max_boilerplate_words and any(re.search(rf"(?<![A-Za-z0-9\u0080-\U0010ffff]){re.escape(p)}(?![A-Za-z0-9\u0080-\U0010ffff])", low) for p in phrases)


def plain_clean(text):
    """(text without failing lines, their number, their bytes, whether the document stays)."""
    lines, failed, lost, whole, stay = text.split("\n"), 0, 0, 0, []
    for k, line in enumerate(lines):
        size = len(re.sub(r"[\x20\x09-\x0D]", "", line).encode())
        bad = size > 0 and plain_line_fails(line, lines[:k])
        failed, lost, whole = failed + bad, lost + size * bad, whole + size
        stay += [] if bad else [line]
    return "\n".join(stay), failed, lost, not plain_rules(text)[-1] and 2 * lost <= whole


def test_line_rules_against_brute_force(spark):
    draw = random.Random(15)
    parts = ["tous", "droits", "réservés", "Tous droits réservés", "sign in", "design in", "sign", "|", "| |", "##", "$9", "ABC", "DEF", "GHI", "word", "mots", "été", "漢字。", "end.", "so?", "(", "bye»", "año", "12", "x…", "Politique de confidentialité", "hier klicken"]
    docs = []
    for i in range(300):
        lines = [draw.choice([" ", "  ", "\t"]).join(draw.choice(parts) for _ in range(draw.randrange(0, 12))) for _ in range(draw.randrange(1, 9))]
        docs.append((i, "\n".join([*lines, *draw.sample(lines, draw.randrange(0, 2))])))
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(frame(spark, docs)).collect()}
    for i, t in docs:
        cleaned, failed, lost, kept = plain_clean(t)
        assert (rows[i]["n_failed_lines"], rows[i]["lost_bytes"], rows[i]["kept"], rows[i]["cleaned"]) == (failed, lost, kept, cleaned), t
