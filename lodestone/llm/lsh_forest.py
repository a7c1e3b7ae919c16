"""N-gram Jaccard join: an LSH forest of MinHash signatures, then exact verification.

A document is its set of distinct five-word shingles; equal sets form one text class from the start.  A class is
signed once: for each of the forest's trees a sequence of max_depth MinHash values, kept whole, so that the sorted
sequences of a tree are its prefix trie and a node at depth d is the run of classes that share d values.

Matched prefixes start at max_depth and are shortened, value by value, until the recall measured on the data meets
the target: classes drawn by hash lose as many shingles as the threshold allows, and what counts is the longest prefix
that such a class still shares with itself in some tree.  Classes that share a prefix of that length are candidates.
Candidates are verified exactly and in no more pairs than share a prefix: a connected group that fits one task is
compared there, a larger one by its trie nodes, each in blocks, where a pair belongs to the first tree in which it
meets.  No pair is ever emitted as a row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, Words, materialize, mix64, ship, slices, span_hashes, utf8, windows
from lodestone.llm.components import components, meet


@dataclass(frozen=True)
class Forest:
    """sample: classes that the prefix length is measured on, and probes of each; the bound doesn't depend on the input."""

    width: int = 5
    threshold: tuple[int, int] = (4, 5)  # Jaccard 0.8 as a fraction, so that verification is in integers
    trees: int = 24
    max_depth: int = 12
    recall: float = 0.999
    sample: tuple[int, int] = (512, 16)
    block: int = 384
    group_rows: int = 1500


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; a text of fewer words than width has one shingle of all of them."""
    words = Words(data, offsets)
    hashes = span_hashes(data, words.start, words.end)
    gram, at = windows(words, hashes, width)
    cuts = np.searchsorted(at, words.first)
    out = []
    for i in range(len(offsets) - 1):
        own = gram[cuts[i] : cuts[i + 1]]
        if not len(own) and words.count[i]:
            short = hashes[words.first[i] : words.first[i + 1]]
            own = mix64(np.array([int.from_bytes(hashlib.blake2b(short.tobytes(), digest_size=8).digest(), "little")], np.uint64))
        out.append(np.unique(own))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Signer:
    def __init__(self, forest: Forest):
        self.trees, self.depth = forest.trees, forest.max_depth
        draw = np.random.default_rng(20)
        n = self.trees * self.depth
        self.flip = draw.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
        self.mult = (draw.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """trees x max_depth values of 16 bits: a hash of each MinHash value."""
        short = (shingles >> U64(32)).astype(np.uint32)
        least = None
        for k in range(0, len(short), 2048):
            now = ((short[None, k : k + 2048] ^ self.flip) * self.mult).min(axis=1)
            least = now if least is None else np.minimum(least, now)
        return (mix64(least.astype(np.uint64) + U64(1)) >> U64(48)).astype(">u2").reshape(self.trees, self.depth)


def _signed(docs: DataFrame, forest: Forest, key: str, text: str) -> DataFrame:
    def run(batches):
        signer = Signer(forest)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for a, b in slices(offsets):
                keys, sizes, signatures = [], [], []
                for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], forest.width):
                    keys.append(set_key(s) if len(s) else None)
                    sizes.append(len(s))
                    signatures.append(signer.signature(s).tobytes() if len(s) else None)
                own = [batch.column(c).slice(a, b - a) for c in (key, "text_key")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())], [key, "text_key", "set_key", "n_shingles", "signature"])

    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, text_key long, set_key binary, n_shingles long, signature binary")


def shared_depths(shingles: np.ndarray, signer: Signer, forest: Forest) -> list[int]:
    """For probes that lost as many shingles as the threshold allows: the longest prefix they share with the whole in any tree."""
    whole = signer.signature(shingles)
    stay = -(-len(shingles) * forest.threshold[0] // forest.threshold[1])
    draw = np.random.default_rng(int(shingles[0] & U64(0xFFFFFFFF)))
    out = []
    for _ in range(forest.sample[1]):
        same = signer.signature(np.sort(draw.choice(shingles, stay, replace=False))) == whole
        out.append(int(np.where(same.all(1), signer.depth, same.argmin(1)).max()))
    return out


def fitted_depth(docs: DataFrame, classes: DataFrame, forest: Forest, key: str, text: str) -> int:
    """The longest prefix at which the share of probes that meet is the target recall or more; 1 at least.

    Measured on the classes with the smallest hashes, at most forest.sample[0] of them, that are large enough to
    lose a shingle; their texts are read again, and one row for each depth reaches the driver.  Without any, max_depth.
    """
    least = -(-forest.threshold[1] // (forest.threshold[1] - forest.threshold[0]))
    drawn = classes.where(F.col("n_shingles") >= least).orderBy("set_key").limit(forest.sample[0]).select("place.key", "place.text_key")
    drawn = drawn.withColumnsRenamed({"key": "drawn_key", "text_key": "drawn_text"})
    rows = docs.join(F.broadcast(drawn), docs[key].eqNullSafe(drawn["drawn_key"]) & docs["text_key"].eqNullSafe(drawn["drawn_text"]), "left_semi").dropDuplicates([key, "text_key"]).select(text)

    def run(batches):
        signer = Signer(forest)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for a, b in slices(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], forest.width)
                depths = [d for s in sets for d in shared_depths(s, signer, forest)]
                yield pa.RecordBatch.from_arrays([pa.array(depths, pa.int32())], ["depth"])

    found = {r["depth"]: r["n"] for r in rows.mapInArrow(run, "depth int").groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, met = sum(found.values()), 0
    for depth in range(forest.max_depth, 0, -1):
        met += found.get(depth, 0)
        if met >= forest.recall * total:
            return depth
    return 1


def _group_sets(members: DataFrame, forest: Forest, text: str) -> DataFrame:
    """members(set_key, n_docs, labels, units, text) -> the same with shingles (binary) for text; rows whose text has another set go."""
    names = ["set_key", "n_docs", "labels", "units"]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for a, b in slices(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], forest.width)
                own = [set_key(s) if len(s) else None for s in sets]
                part = batch.slice(a, b - a)
                same = pa.array([k == w for k, w in zip(own, part.column("set_key").to_pylist(), strict=True)], pa.bool_())
                rows = pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "shingles"])
                yield rows.filter(same)

    return members.select(*names, text).mapInArrow(run, f"set_key binary, n_docs long, labels array<long>, units {members.schema['units'].dataType.simpleString()}, shingles binary")


def _linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], top: int, bottom: int) -> np.ndarray:
    """Exact test |a & b| / |a | b| >= top / bottom for all pairs of two lists, as a boolean matrix."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    flat_b = np.concatenate(sets_b)
    vocabulary, place_b = np.unique(flat_b, return_inverse=True)
    flat_a = np.concatenate(sets_a)
    found = np.searchsorted(vocabulary, flat_a)
    found[found == len(vocabulary)] = 0
    hit = vocabulary[found] == flat_a
    row_a, col_a = np.repeat(np.arange(len(sets_a)), size_a)[hit], found[hit]
    row_b = np.repeat(np.arange(len(sets_b)), size_b)
    used, col_a = np.unique(col_a, return_inverse=True)
    map_b = np.full(len(vocabulary), -1)
    map_b[used] = np.arange(len(used))
    col_b = map_b[place_b]
    row_b, col_b = row_b[col_b >= 0], col_b[col_b >= 0]
    common = np.zeros((len(sets_a), len(sets_b)), np.float32)
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    row_a, col_a, row_b, col_b = row_a[order_a], col_a[order_a], row_b[order_b], col_b[order_b]
    for k in range(0, len(used), 8192):
        a0, a1 = np.searchsorted(col_a, (k, k + 8192))
        b0, b1 = np.searchsorted(col_b, (k, k + 8192))
        width = min(8192, len(used) - k)
        left, right = np.zeros((len(sets_a), width), np.float32), np.zeros((len(sets_b), width), np.float32)
        left[row_a[a0:a1], col_a[a0:a1] - k] = 1
        right[row_b[b0:b1], col_b[b0:b1] - k] = 1
        common += left @ right.T
    both = common.astype(np.int64)
    return (top + bottom) * both >= top * (size_a[:, None] + size_b[None, :])


def _roots(links: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix the lowest node that it is connected with."""
    root = np.arange(len(links))
    reach = links | np.eye(len(links), dtype=bool)
    while True:
        now = np.where(reach, root[None, :], len(links)).min(axis=1)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _meeting(labels_a: np.ndarray, labels_b: np.ndarray, tree: int) -> np.ndarray:
    """Pairs of rows that share a prefix; for a trie node (tree >= 0) only those that share none in an earlier tree."""
    met = np.zeros((len(labels_a), len(labels_b)), bool)
    for t in range(labels_a.shape[1] if tree < 0 else tree):
        met |= labels_a[:, t][:, None] == labels_b[:, t][None, :]
    return met if tree < 0 else ~met


def _verify(sets: DataFrame, n_units: int, forest: Forest) -> DataFrame:
    """(set_key, links, root): other documents linked to each class in one task's pairs, and a class it is linked with.

    Units: groups (tree -1) and trie nodes, each of a size.
    """
    top, bottom = forest.threshold
    rows = sets.select("set_key", "n_docs", "labels", "shingles", F.explode("units").alias("unit")).select("set_key", "n_docs", "labels", "shingles", "unit.*")
    spread = F.greatest(F.lit(1), F.ceil(F.col("size") / forest.block)).cast("int")
    rows = rows.withColumn("n_blocks", spread).withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("n_blocks")).cast("int"))
    # Small units share a task by a hash of the unit; each pair of blocks of a large one is a task's work of its own.
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    rows = rows.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    bins = max(8, -(-n_units // forest.group_rows))
    task = F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("grp", "tree"), F.lit(bins))).otherwise(F.xxhash64("grp", "tree", "low", "high"))
    rows = rows.select(task.alias("task"), "grp", "tree", "low", "high", "block", "set_key", "n_docs", "labels", "shingles")

    def run(table: pa.Table) -> pa.Table:
        col = {n: table.column(n).to_pylist() for n in ("grp", "tree", "low", "high", "block", "set_key", "n_docs")}
        sets_ = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        labels = np.array(table.column("labels").to_pylist(), np.int64)
        parts: dict = {}
        for i in range(len(sets_)):  # repeated rows bring a set twice
            parts.setdefault((col["grp"][i], col["tree"][i], col["low"][i], col["high"][i]), {})[col["set_key"][i]] = i
        keys, links, roots = [], [], []
        for (_, tree, low, high), by_set in parts.items():
            own = list(by_set.values())
            own.sort(key=lambda i: (col["block"][i], col["set_key"][i]))
            left = [i for i in own if col["block"][i] == low]
            right = left if low == high else [i for i in own if col["block"][i] == high]
            if not left or not right:
                continue
            linked = _linked([sets_[i] for i in left], [sets_[i] for i in right], top, bottom) & _meeting(labels[left], labels[right], tree)
            docs = np.array([col["n_docs"][i] for i in own], np.int64)
            if low == high:
                np.fill_diagonal(linked, False)
                count, whole = linked @ docs, linked
            else:
                count = np.concatenate([linked @ docs[len(left) :], linked.T @ docs[: len(left)]])
                whole = np.zeros((len(own), len(own)), bool)
                whole[: len(left), len(left) :] = linked
                whole |= whole.T
            root = _roots(whole)
            for k in np.flatnonzero(count):
                keys.append(col["set_key"][own[k]])
                links.append(int(count[k]))
                roots.append(col["set_key"][own[root[k]]])
        return pa.table([pa.array(keys, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], ["set_key", "links", "root"])

    return rows.groupBy("task").applyInArrow(run, "set_key binary, links long, root binary")


def _units(entries: DataFrame, nodes: DataFrame, n_classes: int, forest: Forest) -> DataFrame:
    """(set_key, units): the groups and trie nodes in which each class is to be compared."""
    shared = meet(entries, nodes, ["tree", "label"], n_classes * forest.trees)
    edges = shared.where("set_key <> v").select(F.col("set_key").alias("u"), "v").distinct()
    stars = components(edges)
    groups = stars.select(F.col("u").alias("set_key"), F.col("root").alias("grp")).union(stars.select("root", "root").distinct())
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    groups = materialize(meet(groups, sizes, ["grp"], n_classes, "size"), "groups")
    small = groups.where(F.col("size") <= forest.block).select("set_key", F.struct(F.col("grp"), F.lit(-1).alias("tree"), "size").alias("unit"))
    # A large group's trie nodes; of nodes with the same classes only that of the first tree is compared.
    large = shared.join(groups.where(F.col("size") > forest.block).select("set_key"), "set_key", "left_semi")
    kept = nodes.groupBy("n", "v", "mark").agg(F.min(F.struct("tree", "label")).alias("first")).select("first.*", "n")
    inner = meet(large.drop("n", "v", "mark"), kept, ["tree", "label"], n_classes * forest.trees)
    unit = F.struct(F.col("label").cast("string").cast("binary").alias("grp"), F.col("tree").cast("int").alias("tree"), F.col("n").alias("size"))
    return small.union(inner.select("set_key", unit.alias("unit"))).groupBy("set_key").agg(F.collect_list("unit").alias("units"))


def near_duplicates(docs: DataFrame, forest: Forest = Forest(), text: str = "text", key: str = "doc_id", with_keeper: bool = False) -> DataFrame:
    """Per row: key, class_id (the smallest key of its class) and n_links (other rows at the threshold or more).

    with_keeper adds text_key (a hash of the text) and keeper: whether (key, text_key) is the one of its class to keep.

    A class is a connected component of links.  Rows with equal sets of shingles (exact copies among them) are links
    of each other without being expanded.  Texts that are null, empty or blank have no shingles and no links and
    are classes of their own; texts of fewer words than the width are one shingle.  Rows that repeat a key are
    rows.  Null keys may be members; they name a class only if no member has a key.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    docs = docs.select(key, text).withColumn("text_key", F.xxhash64(text))
    kind = docs.schema[key].dataType.simpleString()
    signed = materialize(_signed(docs, forest, key, text), "signed")
    place = F.min(F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), "text_key"))
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min(key).alias("first_key"), place.alias("place"), F.count(F.lit(1)).alias("n_docs"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
    classes = materialize(classes, "classes")
    n_classes, depth = classes.count(), fitted_depth(docs, classes, forest, key, text)
    step = 2 * forest.max_depth
    label = F.transform(F.sequence(F.lit(0), F.lit(forest.trees - 1)), lambda t: F.xxhash64(F.substring(F.col("signature"), t * step + 1, F.lit(2 * depth))))
    classes = classes.withColumn("labels", label)
    entries = classes.select("set_key", F.posexplode("labels").alias("tree", "label"))
    nodes = entries.groupBy("tree", "label").agg(F.min("set_key").alias("v"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_key")).alias("mark")).where("n > 1")
    units = _units(entries, materialize(nodes, "nodes"), n_classes, forest)
    members = materialize(units.join(classes.select("set_key", "place", "n_docs", "labels"), "set_key"), "members")
    one_text = docs[key].eqNullSafe(members["place.key"]) & docs["text_key"].eqNullSafe(members["place.text_key"])
    sets = _group_sets(docs.join(members, one_text), forest, text)
    n_units = members.agg(F.sum(F.size("units"))).first()[0] or 0
    checked = materialize(_verify(sets, n_units, forest), "checked")
    roots = components(checked.select(F.col("set_key").alias("u"), F.col("root").alias("v")))
    links = checked.groupBy("set_key").agg(F.sum("links").alias("links"))
    known = classes.select("set_key", "first_key", "place", "n_docs").join(links, "set_key", "left").join(roots.withColumnRenamed("u", "set_key"), "set_key", "left")
    known = known.withColumn("root", F.coalesce("root", "set_key"))
    names = known.groupBy("root").agg(F.min("first_key").alias("class_id"), F.min("place").alias("kept"), F.count(F.lit(1)).alias("n"))
    named = meet(known, names, ["root"], n_classes).select("set_key", "class_id", "kept", "n_docs", (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    own = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), "text_key")

    def shown(rows: DataFrame) -> DataFrame:
        keeper = ["text_key", (F.col("set_key").isNull() | own.eqNullSafe(F.col("kept"))).alias("keeper")] if with_keeper else []
        return rows.select(key, *keeper, F.coalesce("class_id", F.col(key)).cast(kind).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

    rows = signed.select(key, "text_key", "set_key")
    named = materialize(named, "named")
    blank = rows.where("set_key is null").withColumns({"class_id": F.lit(None).cast(kind), "n_links": F.lit(0), "kept": F.lit(None).cast(named.schema["kept"].dataType)})
    return shown(meet(rows.where("set_key is not null"), named, ["set_key"], signed.count(), "n_docs")).union(shown(blank))
