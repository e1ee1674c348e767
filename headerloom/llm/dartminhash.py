"""MinHash near-duplicates by DartMinHash (T. Christiani, 2020).

Every element owns the same random darts in every document: a Poisson process over the plane
(weight, rank), made cell by cell from a hash of the element. A document sees those of its elements'
darts whose weight coordinate is below the element's weight, assigns each dart to one of ``k``
coordinates, and keeps the earliest (lowest rank) dart of each. Two documents keep the same dart in
a coordinate with the probability of their weighted Jaccard similarity. Darts are thrown only up to
a rank at which all coordinates are expected to be hit, so a signature costs about
``max(words, k ln k)`` darts and not ``k`` times the words.

Signatures are cut into bands; texts that share a band form a bucket. In each bucket members are
compared with its leader (the member whose buckets hold most texts), not with each other. The
texts of a bucket whose members then lie in more than one class get a second, longer signature with
narrower bands, and members of different classes that share such a band are compared on it, in bounded
blocks, each pair of blocks a unit of work of its own. Likely pairs are checked
exactly on their word shingles, and links are joined into classes by alternating large and small stars.

Keys that hold more than a set share of all rows are few, and what is known of them is broadcast; their rows are never
shuffled by the key alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.shared import checkpointed, mixed, run_hashes, shingles_of, steps, texts_of, written

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: P(Poisson(1) <= n) for n = 0, 1, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(16)])
#: Coordinates and rows per band of the second signature: its bands miss a pair at 0.8 with probability 7e-4.
NARROW = (640, 10)
#: Darts that a task holds at once, at some hundred bytes each.
DARTS = 1 << 20
#: Elements whose darts are thrown at once.
AT_ONCE = 1 << 17
#: Members of a bucket that are laid together, to be compared with another such block.
BLOCK = 256
#: A key with more than one HOT-th of all rows is hot: there are fewer than HOT of them, whatever the data.
HOT = 10_000


def _throw(element, weight, row, low, high, k, seed, out):
    """Throws the darts of each element in ranks low[row] <= rank < high[row], and lowers out[row, coordinate] to the earliest."""
    across = np.ceil(weight).astype(np.int64)
    deep = (high - low)[row]
    cells = across * deep
    of = np.repeat(np.arange(len(element)), cells)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    wide, rank = nth // deep[of], nth % deep[of] + low[row[of]]
    cell = mixed(element[of] ^ mixed((wide.astype(np.uint64) << np.uint64(32)) + rank.astype(np.uint64) + np.uint64(seed)))
    count = np.searchsorted(_POISSON, (cell >> np.uint64(11)) * 2.0**-53, "right")
    at = np.repeat(np.arange(len(cell)), count)
    which = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    dart = mixed(cell[at] + (which + 1).astype(np.uint64) * _GOLDEN)
    inside = wide[at] + (dart >> np.uint64(32)) * 2.0**-32 < weight[of[at]]
    at, dart = at[inside], dart[inside]
    more = mixed(dart ^ _GOLDEN)
    value = (rank[at].astype(np.uint64) << np.uint64(48)) | ((dart & np.uint64(0xFFFFFFF)) << np.uint64(20)) | (more & np.uint64(0xFFFFF))
    np.minimum.at(out.reshape(-1), row[of[at]] * k + ((more >> np.uint64(32)) % np.uint64(k)).astype(np.int64), value)


def signatures(element: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int, k: int, seed: int = 1) -> np.ndarray:
    """(rows, k) darts, as integers ordered by rank; rows without positive weight have NONE everywhere."""
    out = np.full((rows, k), NONE)
    total = np.bincount(row, weight, rows)
    open_ = total > 0
    low = np.zeros(rows, np.int64)
    high = np.ceil(k * (math.log(k) + 3) / np.maximum(total, 1e-9)).clip(1, 1 << 14).astype(np.int64)
    while open_.any():
        for at in range(0, len(element), AT_ONCE):
            mine = open_[row[at : at + AT_ONCE]]
            _throw(element[at : at + AT_ONCE][mine], weight[at : at + AT_ONCE][mine], row[at : at + AT_ONCE][mine], low, high, k, seed, out)
        open_ &= (out == NONE).any(axis=1)
        low, high = high, high * 2
    return out


def _rows_at_once(k: int) -> int:
    """Rows whose darts are thrown together: every row throws about k ln k of them, however short it is."""
    return max(1, int(DARTS / (k * (math.log(k) + 3))))


def _weighted(hashes, row, weights):
    """Distinct elements of each row with their weights: 1 each for "set", their number for "count"."""
    if weights == "set":
        return hashes, np.ones(len(hashes)), row  # repeated elements throw the same darts again
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, int)
    return hashes[first], np.diff(np.r_[first, len(row)]).astype(float), row[first]


def _band_keys(sig: np.ndarray, rows_per_band: int) -> np.ndarray:
    """(rows, bands) hashes of the signatures' bands."""
    out = []
    for b in range(0, sig.shape[1], rows_per_band):
        key = np.full(len(sig), np.uint64(b))
        for j in range(b, b + rows_per_band):
            key = mixed(key + sig[:, j])
        out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def _lists(keys: np.ndarray, some: np.ndarray) -> pa.Array:
    """The keys of each row as a list column; empty where ``some`` is false."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some * keys.shape[1])], pa.int32()), pa.array(keys[some].reshape(-1)))


def _digest(text_col: str):
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def banded(docs: DataFrame, id_col: str, text_col: str, shingle: int, k: int, rows_per_band: int, weights: str) -> DataFrame:
    """doc_id, digest of the text, and the hash of each band of its signature (none for a text without words)."""

    def run(batches):
        for part in steps(batches, rows=_rows_at_once(k)):
            raw, at = texts_of(part.column("text"))
            hashes, row = shingles_of(raw, at, shingle)
            sig = signatures(*_weighted(hashes, row, weights), len(at) - 1, k)
            bands = _lists(_band_keys(sig, rows_per_band), sig[:, 0] != NONE)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), bands], ["doc_id", "digest", "bands"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """node, n, and its distinct shingles as sorted 32-bit fingerprints."""

    def run(batches):
        for part in steps(batches):
            raw, at = texts_of(part.column(1))
            hashes, row = shingles_of(raw, at, shingle)
            short = (hashes >> np.uint64(32)).astype(np.uint64) | (row.astype(np.uint64) << np.uint64(32))
            short = np.unique(short)
            ends = np.searchsorted(short >> np.uint64(32), np.arange(len(at)), "left")
            body = short.astype(np.uint32)
            sets = [body[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends).astype(np.int32)), pa.array(sets, pa.binary())], ["node", "n", "body"])

    return docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "node long, n int, body binary")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have at least the Jaccard similarity ``threshold``."""
    a = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("body").alias("bu"))
    b = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("body").alias("bv"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("bu"), batch.column("bv")):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= threshold * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    near = pairs.join(a, "u").join(b, "v").where(F.least("nu", "nv") >= threshold * F.greatest("nu", "nv"))
    return near.select("u", "v", "bu", "bv").mapInArrow(run, "u long, v long")


def classes_of(links: DataFrame) -> DataFrame:
    """(node, class_id) of every node of the undirected links (u, v): class_id is the least node it is connected with.

    Alternating large and small stars (Kiveris et al., 2014): each round is a minimum by node and a
    join back, so no component is ever gathered; rounds grow with the logarithm of the paths.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, before = checkpointed(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = checkpointed(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("class_id"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class_id")).unionByName(roots)


def _narrow(sets: DataFrame) -> DataFrame:
    """node, its second signature with one byte for each coordinate, and that signature's bands."""
    k, rows_per_band = NARROW

    def run(batches):
        for part in steps(batches, "body", rows=_rows_at_once(k)):
            size = part.column("n").to_numpy(zero_copy_only=False)
            element = np.frombuffer(b"".join(x.as_py() for x in part.column("body")), np.uint32).astype(np.uint64)
            sig = signatures(mixed(element), np.ones(len(element)), np.repeat(np.arange(len(size)), size), len(size), k, 2)
            folded = (mixed(sig) & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([x.tobytes() for x in folded], pa.binary()), _lists(_band_keys(sig, rows_per_band), size > 0)], ["node", "sig", "narrow"])

    return sets.mapInArrow(run, "node long, sig binary, narrow array<long>")


def _likely(blocks: DataFrame, least: float) -> DataFrame:
    """Pairs of members in different classes, from two blocks of a bucket, whose second signatures agree in a share ``least``."""

    def side(batch, name):
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat, at = column.flatten(), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
        number = lambda f: flat.field(f).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(x.as_py() for x in flat.field("sig")), np.uint8).reshape(len(flat), NARROW[0])
        return at, number("node"), number("class_id"), number("main"), sig

    def run(batches):
        for batch in batches:
            at, node, kind, main, sig = side(batch, "a")
            at2, node2, kind2, main2, sig2 = side(batch, "b")
            u, v = [], []
            for r in range(batch.num_rows):
                two = slice(at2[r], at2[r + 1])
                for i in range(at[r], at[r + 1]):
                    apart = (kind2[two] != kind[i]) & ~(main2[two] & main[i]) & (node2[two] != node[i])
                    which = np.flatnonzero(apart) + at2[r]
                    which = which[(sig2[which] == sig[i]).mean(axis=1) >= least]
                    u.append(np.minimum(node[i], node2[which]))
                    v.append(np.maximum(node[i], node2[which]))
            if u:
                pair = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["u", "v"])

    return blocks.mapInArrow(run, "u long, v long").distinct()


def by_key(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with the facts of their key; facts: key, n (its rows among ``total``), and more, written.

    Facts of hot keys, fewer than HOT, are broadcast to the rows where they lie; all others are joined
    by a shuffle in which no key holds more than one HOT-th of the rows.
    """
    hot = F.broadcast(facts.where(F.col("n") * HOT > total))
    others = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col("n") * HOT <= total), key)
    return rows.join(hot, key).unionByName(others)


def _block_pairs(rows: DataFrame) -> DataFrame:
    """a, b: two blocks of members of a bucket that have to be compared.

    rows: key, node, class_id, main, sig, and the numbers of blocks: ``rest`` of members outside the bucket's
    main class and ``of`` of all (1 if one block holds the bucket). Main blocks do not meet each other.
    """
    place = F.when(F.col("of") == 1, 0).when(F.col("main"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("of") - F.col("rest"))).otherwise(F.pmod(F.xxhash64("node"), "rest"))
    blocks = rows.withColumn("block", place.cast("int")).groupBy("key", "block", "rest", "of").agg(F.collect_list(F.struct("node", "class_id", "main", "sig")).alias("a"))
    blocks = written(blocks)
    wide = blocks.where("of > 1")
    low = wide.where("block < rest").select("key", F.col("block").alias("lo"), F.explode(F.expr("sequence(block, of - 1)")).alias("hi"), "a")
    high = wide.select("key", F.explode(F.expr("sequence(0, least(block, rest - 1))")).alias("lo"), F.col("block").alias("hi"), F.col("a").alias("b"))
    return blocks.where("of = 1").select("a", F.col("a").alias("b")).unionByName(low.join(high, ["key", "lo", "hi"]).select("a", "b"))


def _classed(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    """rows (node, ...) with class_id: the node's class, or the node itself."""
    if classes is None:
        return rows.withColumn("class_id", F.col("node"))
    return rows.join(classes, "node", "left").withColumn("class_id", F.coalesce("class_id", "node"))


def _second_round(buckets: DataFrame, classes: DataFrame | None, sets: DataFrame, threshold: float, total: int) -> DataFrame:
    """Likely pairs between the classes that share a bucket (node, key, n), by the second signature.

    Pairs within a narrower bucket's largest class are left out, as they are linked already.
    """
    placed = written(_classed(buckets.select("node", "key"), classes))
    apart = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("class_id").alias("x"), F.max("class_id").alias("y")).where("x <> y")
    open_ = by_key(placed.select("node", "key"), written(apart.select("key", "n")), "key", total).select("node").distinct()
    narrow = written(_narrow(sets.join(open_, "node")))
    placed = written(_classed(narrow.select("node", "narrow"), classes).select("node", "class_id", F.explode("narrow").alias("key")))
    kinds = placed.groupBy("key", "class_id").agg(F.count("*").alias("size"))
    kinds = kinds.groupBy("key").agg(F.sum("size").alias("n"), F.count("*").alias("kinds"), F.max(F.struct("size", "class_id")).alias("x")).where("kinds > 1")
    rest = F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil((F.col("n") - F.col("x.size")) / BLOCK))
    of = F.when(F.col("n") <= BLOCK, 1).otherwise(F.col("rest") + F.ceil(F.col("x.size") / BLOCK))
    kinds = written(kinds.withColumn("rest", rest.cast("int")).select("key", "n", F.col("x.class_id").alias("main_class"), "rest", of.cast("int").alias("of")))
    rows = by_key(placed, kinds, "key", placed.count()).withColumn("main", F.col("class_id") == F.col("main_class")).drop("main_class", "n")
    blocks = _block_pairs(rows.join(narrow.select("node", "sig"), "node"))
    return _likely(blocks, threshold - 3 * math.sqrt(threshold * (1 - threshold) / NARROW[0]))


def linked_classes(nodes: DataFrame, sets_of, threshold: float) -> DataFrame | None:
    """(node, class_id) of the texts (node, bands) that have a link; None if there are none.

    ``sets_of(ids)`` gives the shingle sets of the texts ``ids`` (node).
    """
    rows = nodes.select("node", F.explode("bands").alias("key"))
    total = nodes.agg(F.sum(F.size("bands"))).first()[0] or 0
    shared = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    buckets = written(by_key(rows, shared, "key", total))
    if buckets.isEmpty():
        return None
    rank = written(buckets.groupBy("node").agg(F.sum("n").alias("rank")))
    sets = written(sets_of(rank.select("node")))
    members = buckets.join(rank, "node")
    lead = members.groupBy("key").agg(F.max(F.struct("rank", (-F.col("node")).alias("minus"))).alias("x"), F.first("n").alias("n")).select("key", "n", (-F.col("x.minus")).alias("lead"))
    pairs = by_key(buckets.select("node", "key"), written(lead), "key", total).where("node <> lead").select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v"))
    links = written(_similar(pairs.distinct(), sets, threshold))
    classes = None if links.isEmpty() else classes_of(links)
    more = written(_similar(_second_round(buckets, classes, sets, threshold, total), sets, threshold))
    if not more.isEmpty():
        classes = classes_of(links.unionByName(more))
    return classes


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, k: int = 64, rows_per_band: int = 4, weights: str = "set") -> DataFrame:
    """One row per row of docs: doc_id, digest (MD5 of the text), root: the same number for all texts of a class, null for null texts.

    A distinct text is a node: its number is its least doc_id, or a hash where another text has that doc_id too, or none of its rows has one.
    """
    one = written(banded(docs, id_col, text_col, shingle, k, rows_per_band, weights))
    total = one.count()
    equal = one.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    equal = written(equal)
    least = equal.where("doc is not null").groupBy("doc").agg(F.min("digest").alias("least"), F.count("*").alias("texts")).where("texts > 1").select("doc", "least")
    made = F.xxhash64("digest").bitwiseOR(F.lit(-(2**63)))
    other = F.col("doc").isNull() | F.coalesce(F.col("least") != F.col("digest"), F.lit(False))
    equal = written(equal.join(least, "doc", "left").select("digest", "n", "bands", F.when(other, made).otherwise(F.col("doc")).alias("node"), other.alias("made")))

    repeated = not one.where("doc_id is not null and digest is not null").groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
    nameless = not equal.where("made").isEmpty()

    def sets_of(ids):
        plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text")).where("text is not null")
        wanted = written(equal.select("digest", "n", "node", "made").join(ids, "node"))
        own = plain.groupBy("doc_id", "digest").agg(F.first("text").alias("text")) if repeated else plain
        named = wanted.where("not made").select(F.col("node").alias("doc_id"), "digest").hint("merge")  # the same plan at every size
        texts = own.join(named, ["doc_id", "digest"]).select(F.col("doc_id").alias("node"), "text")
        if nameless:
            found = by_key(plain.select("digest", "text"), wanted.where("made").select("digest", "n", "node"), "digest", total)
            texts = texts.unionByName(found.groupBy("node").agg(F.first("text").alias("text")))
        return shingle_sets(texts, "node", "text", shingle)

    of = linked_classes(equal.select("node", "bands"), sets_of, threshold)
    named = equal.select("digest", "n", F.col("node").alias("root"))
    if of is not None:
        of = of.select(F.col("node").alias("root"), F.col("class_id").alias("class"))
        named = named.join(of, "root", "left").select("digest", "n", F.coalesce("class", "root").alias("root"))
    named, one = written(named), one.select("doc_id", "digest")
    without = one.where("digest is null").withColumn("root", F.lit(None).cast("long"))
    return by_key(one.where("digest is not null"), named, "digest", total).drop("n").unionByName(without)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, k: int = 64, rows_per_band: int = 4, weights: str = "set") -> DataFrame:
    """One row per row of docs: doc_id, class_id (the least doc_id of its class), is_first (doc_id = class_id).

    Documents are linked if their texts are equal or the Jaccard similarity of their runs of
    ``shingle`` white-space separated words is at least ``threshold``; classes are the connected
    components. A text of fewer words is one shingle. weights "set" estimates the Jaccard similarity
    of shingle sets; "count" weighs candidates by how often a shingle occurs (the exact check stays
    the sets'). With 64 coordinates in bands of 4, a pair at 0.8 is missed in all bands with
    probability 2e-4; one that no leader links needs a band of the second signature too (7e-4 at 0.8).

    Null texts are in a class of their own, texts without words in one with their equals
    only. Rows with the same doc_id are one document: all have its class, which links what its texts link. Rows with a
    null doc_id take part by their texts; a class without a doc_id has a null class_id. Other columns
    of docs, whatever their names, are ignored. An empty table gives an empty one.
    """
    rows = written(text_classes(docs, id_col, text_col, shingle, threshold, k, rows_per_band, weights).select("doc_id", "root"))
    total = rows.count()
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count("*").alias("c"), F.count("root").alias("d"))
    several = written(several.where("one <> other or d > 0 and d < c").select("doc_id", "one"))
    if not several.isEmpty():  # documents of several texts
        rows = rows.join(several, "doc_id", "left")
        links = rows.where("root <> one").select(F.col("root").alias("u"), F.col("one").alias("v")).distinct()
        rows = rows.select("doc_id", F.coalesce("root", "one").alias("node"))
        rows = written(_classed(rows, None if links.isEmpty() else classes_of(links)).select("doc_id", F.col("class_id").alias("root")))
    first = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = written(first.where("first is null or first <> root"))
    if first.isEmpty():
        named = rows.withColumn("class_id", F.coalesce("root", "doc_id"))
    else:
        hot = F.broadcast(first.where(F.col("n") * HOT > total))
        named = rows.join(hot.select("root", F.col("first").alias("hot"), F.lit(True).alias("is_hot")), "root", "left")
        cold = first.where(F.col("n") * HOT <= total).select("root", F.col("first").alias("cold"), F.lit(True).alias("is_cold"))
        spread = F.when(F.col("is_hot"), None).otherwise(F.col("root"))  # hot rows have their class and need not meet in one task
        named = named.withColumn("key", spread).join(cold.withColumnRenamed("root", "key"), "key", "left")
        named = named.withColumn("class_id", F.when(F.col("is_hot"), F.col("hot")).when(F.col("is_cold"), F.col("cold")).otherwise(F.coalesce("root", "doc_id")))
    return named.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("is_first"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs, with all its columns, of each class of texts: that of the least doc_id (null last), then of the least MD5 digest.

    Classes are as in near_duplicates(), but of texts: rows that share a doc_id and not a text are judged
    apart, and of rows equal in both one stays. Rows with a null text stay. An empty table gives an empty one.
    """
    rows = written(text_classes(docs, id_col, text_col, **options))
    total = rows.count()
    copies = rows.where("root is not null").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("many"))
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "many")
    chosen = written(copies.groupBy("root").agg(F.min(best).alias("x")).select(F.col("x.doc_id").alias("d"), F.col("x.digest").alias("g"), F.col("x.many").alias("many")))
    of = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(id_col).cast("long").alias("id"), _digest(text_col).alias("digest"))
    on = of["id"].eqNullSafe(chosen["d"]) & (of["digest"] == chosen["g"])
    fields = [f"c{i}" for i in range(len(docs.columns))]
    back = [F.col(f).alias(c) for f, c in zip(fields, docs.columns)]
    out = of.join(chosen.where("many = 1").hint("merge"), on, "left_semi").select(*fields).unionByName(of.where("digest is null").select(*fields))
    if not chosen.where("many > 1").isEmpty():
        row = F.first(F.struct(*fields)).alias("x")  # combined in each task before it shuffles
        hot = F.broadcast(chosen.where((F.col("many") > 1) & (F.col("many") * HOT > total)))
        cold = chosen.where((F.col("many") > 1) & (F.col("many") * HOT <= total))
        for repeated in (hot, cold):
            out = out.unionByName(of.join(repeated, on).groupBy("g", "d").agg(row).select("x.*"))
    return out.select(*back)
