"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, and how often.

A text is cut into chunks at spaces between two characters that are no white space: both tokenizers encode a chunk as they would in the whole
text, so both have a token that ends there. A worker encodes and aligns each chunk that it does not remember once. An alignment is
arithmetic on arrays of many chunks at a time: the cumulative sums of token lengths are the ends, np.intersect1d of both gives the common cuts,
np.searchsorted labels tokens with their groups and finds the tokens that overlap, and np.repeat expands them into links. Links of an id pair are counted in each task,
added up under a salt and then without it. A task writes its documents as the numbers of their chunks with the pairs of each, so that texts
are encoded once. Counts come back to the documents in two ways: the commonest pairs, of a
bounded number, as a broadcast; all others by a join on the pair.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.shared import STEP_BYTES, steps, written

#: A pair with more than one COMMON-th of all links is common: there are fewer than COMMON of them, whatever the data.
COMMON = 1 << 20
#: Chunks and characters that a worker remembers; distinct pairs that a task holds; parts that a pair's counts are first added up in.
CHUNKS, CHARACTERS, HELD, SALTS = 1 << 16, 1 << 22, 1 << 19, 16
#: Characters of a chunk from which on the tokenizer whose work does not grow with the square of a word is taken.
LONG = 256
_CUT = re.compile(r"(?<=\S)(?= \S)")


@cache
def _bytes_by_character() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: bytes that are none, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _fast(said: dict):
    """A quicker tokenizer of the same file, or None: byte-level pieces of the usual pattern whose merges are made in the order of their ids are what ranks stand for."""
    known, model, pieces = _bytes_by_character(), said["model"], said.get("pre_tokenizer") or {}
    plain = pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not pieces.get("add_prefix_space") and model["type"] == "BPE" and said.get("normalizer") is None
    if not plain or model.get("ignore_merges") or model.get("dropout"):
        return None
    made = [model["vocab"]["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")] for pair in model["merges"]]
    special = {x["id"] for x in said.get("added_tokens") or ()}
    ranks = {bytes(known[c] for c in token): i for token, i in model["vocab"].items() if i not in special}
    if any(b <= a for a, b in zip(made, made[1:])) or sum(len(token) == 1 for token in ranks) < 256:
        return None
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pair:
    """The two tokenizers of a worker, with the bytes of their tokens."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece

        self.file, said = byte_level, json.loads(byte_level)
        self.fast, self.slow = _fast(said), None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        known = _bytes_by_character()
        tokens = {i: token for token, i in said["model"]["vocab"].items()} | {x["id"]: "" for x in said.get("added_tokens") or ()}
        self.bytes_a = [bytes(known[c] for c in tokens.get(i, "")) for i in range(max(tokens) + 1)]
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())

    def _slow(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            self.slow = Tokenizer.from_str(self.file.decode())
            self.slow.encode_special_tokens = True
        return self.slow

    def encode(self, text: str, long: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text that begins with a space in both, or None where the ids' bytes are not the text's. ``long``: whether it may hold a long word."""
        a = self._slow().encode(text, add_special_tokens=False).ids if long or self.fast is None else self.fast.encode_ordinary(text)
        b = self.b.encode(text[1:])
        raw = text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None


def aligned(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cuts, groups of a's tokens, of b's, token of a and token of b of each link) of two tokenizations of the same bytes, by their tokens' lengths."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    first = np.searchsorted(end_b, end_a - size_a, "right")
    count = np.searchsorted(end_b - size_b, end_a, "left") - first
    link_a = np.repeat(np.arange(len(end_a)), count)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(count) - count - first, count)
    return cuts, np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), link_a, link_b


class Chunks:
    """What a worker remembers of chunks: numbers of tokens, groups and links, the links' pairs, and the groups as text."""

    def __init__(self, pair: Pair, keeps_ids: bool = False):
        self.keeps_ids = keeps_ids
        self.pair, self.wide = pair, len(pair.bytes_b)
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (pair.bytes_a, pair.bytes_b)]
        self.most = max(len(side) for side in self.sizes)
        self.marked = [f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(self.most)]
        self._reset()

    def forget(self) -> None:
        """Forgets all chunks if they are too many."""
        if len(self.code) > CHUNKS or self.characters > CHARACTERS:
            self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.characters, self.texts = 0, []
        #: ids in a and in b, and where a chunk's begin
        self.ids = ([], [0]), ([], [0])
        #: sound (1 or 0), tokens of a, of b, groups, links of each chunk; pairs of the links, and where a chunk's begin
        self.numbers = np.zeros((5, 1 << 10), np.int64)
        self.pairs, self.begin = [], [np.zeros(1, np.int64)]

    def codes(self, chunks: list[str]) -> np.ndarray:
        """The number of each chunk; new ones are encoded and aligned together."""
        new = [chunk for chunk in dict.fromkeys(chunks) if chunk not in self.code]
        for at in range(0, len(new), 1 << 12):
            self._learn(new[at : at + (1 << 12)])
        return np.fromiter(map(self.code.__getitem__, chunks), np.int64, len(chunks))

    def _encoded(self, chunks: list[str]):
        """(sound, tokens of a, of b) of each chunk and the ids in both, from one text of all of them; by halves where that can't be given back."""
        found = self.pair.encode("".join(chunks), max(map(len, chunks)) > LONG)
        if found is not None:
            ends, sizes = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in chunks]), []
            for ids, size in zip(found, self.sizes):
                end = np.cumsum(size[ids])
                upto = np.searchsorted(end, ends, "right")
                if not (upto > 0).all() or not (end[upto - 1] == ends).all():
                    break
                sizes.append(np.diff(upto, prepend=0))
            else:
                return np.ones(len(chunks), np.int64), *sizes, *found
        if len(chunks) == 1:
            none = np.zeros(1, np.int64)
            return none, none, none, none[:0], none[:0]
        half = len(chunks) // 2
        return tuple(np.concatenate(x) for x in zip(self._encoded(chunks[:half]), self._encoded(chunks[half:])))

    def _learn(self, new: list[str]) -> None:
        # Chunks of one space in front and none inside the ends may follow each other in one text.
        plain = [c for c in new if len(c) > 1 and not c[1].isspace() and not c[-1].isspace()]
        others = [c for c in new if not (len(c) > 1 and not c[1].isspace() and not c[-1].isspace())]
        parts = ([self._encoded(plain)] if plain else []) + [self._encoded([c]) for c in others]
        good, n_a, n_b, a, b = (np.concatenate(x) for x in zip(*parts))
        new = plain + others
        first = len(self.code)
        self.code.update(zip(new, range(first, first + len(new))))
        self.characters += sum(map(len, new))
        for held, n, ids in zip(self.ids, (n_a, n_b), (a, b)) if self.keeps_ids else ():
            held[0].append(ids)
            held[1].extend((held[1][-1] + np.cumsum(n)).tolist())
        while first + len(new) > self.numbers.shape[1]:
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)], axis=1)
        sound = np.flatnonzero(good)
        texts, found, own = [""] * len(new), np.zeros((5, len(new)), np.int64), np.zeros(len(new), np.int64)
        if len(sound):
            n_a, n_b = n_a[sound], n_b[sound]
            _, group_a, group_b, of_a, of_b = aligned(self.sizes[0][a], self.sizes[1][b])
            links = np.bincount(np.repeat(np.arange(len(sound)), n_a)[of_a], minlength=len(sound))
            # A chunk ends a group, so the group of its last token tells how many there are.
            found[:, sound] = [np.ones(len(sound), np.int64), n_a, n_b, np.diff(group_a[np.cumsum(n_a) - 1] + 1, prepend=0), links]
            own[sound] = links
            self.pairs.append(a[of_a] * self.wide + b[of_b])
            # In the order of groups, a's ids first; 0 to 3: what stands behind an id.
            behind_a = np.where(np.append(group_a[1:], -1) != group_a, 1, 0)
            behind_b = np.where(np.append(group_b[1:], -1) != group_b, 2, 0)
            behind_b[np.cumsum(n_b) - 1] = 3
            code = np.empty(len(a) + len(b), np.int64)
            code[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + behind_a * self.most
            code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + behind_b * self.most
            words, begin = list(map(self.marked.__getitem__, code.tolist())), 0
            for i, end in zip(sound.tolist(), np.cumsum(n_a + n_b).tolist()):
                texts[i], begin = "".join(words[begin:end]), end
        self.numbers[:, first : first + len(new)] = found
        self.texts += texts
        self.begin.append(self.begin[-1][-1] + np.cumsum(own))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of all links of all chunks, in order; where a chunk's begin)."""
        self.pairs = [np.concatenate(self.pairs)] if self.pairs else [np.zeros(0, np.int64)]
        self.begin = [np.concatenate(self.begin)]
        return self.pairs[0], self.begin[0]


_chunks: dict[str, Chunks] = {}


def _remembered(name: str, files, keeps_ids: bool = False) -> Chunks:
    if name not in _chunks or keeps_ids > _chunks[name].keeps_ids:
        _chunks.clear()
        _chunks[name] = Chunks(Pair(*files.value), keeps_ids)
    return _chunks[name]


def pieces_of(text: str, every: int = STEP_BYTES) -> list[str]:
    """Space+text in pieces of about ``every`` characters that begin at a space between two characters that are no white space; a text without such places is one piece."""
    text = " " + text
    out, begin = [], 0
    while len(text) - begin > 2 * every:
        at = text.find(" ", begin + every)
        while 0 <= at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if not 0 <= at < len(text) - 1:
            break
        out.append(text[begin:at])
        begin = at
    return [*out, text[begin:]]


def _shared(spark, path_a: str, path_b: str):
    """A name of the two files and a broadcast of them (a few MB, whatever the data)."""
    with open(path_a, "rb") as one, open(path_b, "rb") as two:
        files = one.read(), two.read()
    return hashlib.sha256(files[0] + b"\0" + files[1]).hexdigest(), spark.sparkContext.broadcast(files)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _short(texts: list, memory: Chunks) -> list[tuple[int, np.ndarray]]:
    """(row, codes of its chunks) of the short texts that both tokenizers give back, in order."""
    memory.forget()
    plain = [i for i, text in enumerate(texts) if text and len(text) <= 2 * STEP_BYTES]
    chunks = [_CUT.split(" " + texts[i]) for i in plain]
    codes = memory.codes([chunk for part in chunks for chunk in part])
    ends = np.cumsum([len(part) for part in chunks])
    return [(i, part) for i, part in zip(plain, np.split(codes, ends[:-1]) if len(ends) else ()) if memory.numbers[0, part].all()]


def _long(texts: list, memory: Chunks):
    """(row, codes of a piece's chunks, whether it is the last) of the long texts that both tokenizers give back, piece by piece; codes hold until the next is asked for."""
    for i, text in enumerate(texts):
        if text and len(text) > 2 * STEP_BYTES:
            pieces = pieces_of(text)
            # First whether the whole can be given back: what can't has no tokens at all.
            for piece in pieces:
                memory.forget()
                if not memory.numbers[0, memory.codes(_CUT.split(piece))].all():
                    break
            else:
                for n, piece in enumerate(pieces, 1):
                    memory.forget()
                    yield i, memory.codes(_CUT.split(piece)), n == len(pieces)


def token_ids(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids_a, ids_b (arrays of int) of every row of docs.

    path_a: a byte-level tokenizer's JSON; path_b: a piece model; files on the driver. A text that is null, empty, or that either can't give back has no tokens.
    """
    name, files = _shared(docs.sparkSession, path_a, path_b)

    def run(batches):
        memory = _remembered(name, files, True)
        for part in steps(batches):
            found = [([], []) for _ in range(part.num_rows)]
            texts = part.column("text").to_pylist()
            for i, codes, *_ in itertools.chain(_short(texts, memory), _long(texts, memory)):
                for side, (ids, begin) in enumerate(memory.ids):
                    ids[:] = [np.concatenate(ids)]
                    found[i][side].extend(ids[0][begin[code] : begin[code + 1]] for code in codes.tolist())
            lists = [pa.array([np.concatenate(own[side]) if own[side] else [] for own in found], pa.list_(pa.int32())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "ids_a", "ids_b"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids_a array<int>, ids_b array<int>")


def _blocks(texts: DataFrame, name: str, files) -> DataFrame:
    """Blocks of some documents each: row, doc_id, sha (of the groups; blank but in a text's last block), numbers (tokens of a, of b, groups, links), ends (chunks up to
    a row's end), codes (numbers of its chunks, within the block), links and pairs (how many links each chunk has, and their pairs)."""
    names = ["row", "doc_id", "sha", "numbers", "ends", "codes", "links", "pairs"]

    def block(rows, docs, sha, found, memory):
        parts = [codes for _, codes in found] or [np.zeros(0, np.int64)]
        own, codes = np.unique(np.concatenate(parts), return_inverse=True)
        numbers, size = np.zeros((4, len(rows)), np.int64), np.zeros(len(rows), np.int64)
        for i, part in found:
            numbers[:, i], size[i] = memory.numbers[1:, part].sum(axis=1), len(part)
        pairs, begin = memory.links()
        count = begin[own + 1] - begin[own]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - begin[own], count)
        data = [numbers, np.cumsum(size), codes.astype(np.int32), count.astype(np.int32), pairs[at].astype(np.uint32 if memory.wide * memory.most < 1 << 32 else np.uint64)]
        cells = [pa.array([x], k) for x, k in zip((rows, docs, sha), (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())))]
        return pa.RecordBatch.from_arrays([*cells, *[pa.array([x.tobytes()], pa.binary()) for x in data]], names)

    def text_of(memory, codes):
        return ";".join(map(memory.texts.__getitem__, codes.tolist())).encode()

    def run(batches):
        memory = _remembered(name, files)
        for part in steps(batches):
            rows, docs, texts = (part.column(c).to_pylist() for c in ("row", "doc_id", "text"))
            found = _short(texts, memory)
            sha = [""] * len(rows)
            for i, codes in found:
                sha[i] = hashlib.sha256(text_of(memory, codes)).hexdigest()
            yield block(rows, docs, sha, found, memory)
            digest = None
            for i, codes, last in _long(texts, memory):
                if digest is None:
                    digest = hashlib.sha256(text_of(memory, codes))
                else:
                    digest.update(b";" + text_of(memory, codes))
                yield block(rows[i : i + 1], docs[i : i + 1], [digest.hexdigest() if last else ""], [(0, codes)], memory)
                digest = None if last else digest

    return texts.mapInArrow(run, "row array<long>, doc_id array<long>, sha array<string>, numbers binary, ends binary, codes binary, links binary, pairs binary")


def _read(batch, *fields):
    """The named binary fields of each row of a batch of blocks, as arrays."""
    for r in range(batch.num_rows):
        found = {f: batch.column(f)[r].as_buffer() for f in fields}
        arrays = {f: np.frombuffer(x, np.int32 if f in ("codes", "links") else np.int64) for f, x in found.items() if f != "pairs"}
        n = int(arrays["links"].sum())
        arrays["pairs"] = np.frombuffer(found["pairs"], np.uint32 if found["pairs"].size == 4 * n else np.uint64).astype(np.int64)
        yield r, *[arrays[f] for f in fields]


def _counted(blocks: DataFrame) -> DataFrame:
    """pair (id of a times b's number of ids, and id of b), n: the links of each pair of ids in all texts."""

    def run(batches):
        keys, counts, size = [], [], 0

        def merged():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            return key, n

        for batch in batches:
            for _, codes, links, pairs in _read(batch, "codes", "links", "pairs"):
                keys.append(pairs)
                counts.append(np.repeat(np.bincount(codes, minlength=len(links)), links))
                size += len(pairs)
                if size > HELD:
                    key, n = merged()
                    keys, counts, size = [key], [n], len(key)
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])
                        keys, counts, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["pair", "n"])

    found = blocks.select("codes", "links", "pairs").mapInArrow(run, "pair long, n long")
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_a, id_b, n: how many links of all texts hold each pair of ids linked."""
    name, files = _shared(docs.sparkSession, path_a, path_b)
    wide = len(Pair(*files.value).bytes_b)
    return _counted(_blocks(_texts(docs, id_col, text_col), name, files)).select((F.col("pair") / wide).cast("long").alias("id_a"), (F.col("pair") % wide).alias("id_b"), "n")


def aligned_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    Space+text is encoded by both; groups are what lies between common ends; links are all pairs of token occurrences whose
    bytes overlap; a pair's count is its number of links in all rows. n_best: links whose count is the highest of their
    id of b, ties included; count_sum: counts over links; groups_sha256: of the groups' ids, '' without tokens. Texts that are null, empty, or that either tokenizer
    can't give back have no tokens and zeros. Long texts are encoded and aligned piece by piece; a text without a space between
    other characters is one piece. Repeated rows and ids count each; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    name, files = _shared(spark, path_a, path_b)
    wide = len(Pair(*files.value).bytes_b)
    blocks = written(_blocks(_texts(docs, id_col, text_col), name, files))
    counts = written(_counted(blocks))
    best = counts.groupBy((F.col("pair") % wide).alias("b")).agg(F.max("n").alias("most"))  # no more rows than ids of b
    counts = counts.withColumn("b", F.col("pair") % wide).join(F.broadcast(best), "b")
    counts = written(counts.select("pair", "n", (F.col("n") == F.col("most")).alias("top")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.where(F.col("n") * COMMON > total).orderBy("pair").toArrow()  # fewer than COMMON rows
    common = spark.sparkContext.broadcast(tuple(common.column(c).to_numpy() for c in ("pair", "n", "top")))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    names = ["row", "doc_id", *columns, "groups_sha256", "rare"]

    def run(batches):
        keys, number, top = common.value
        for batch in batches:
            for r, numbers, ends, codes, links, pairs in _read(batch, "numbers", "ends", "codes", "links", "pairs"):
                place = np.searchsorted(keys, pairs)
                usual = place < len(keys)
                usual[usual] = keys[place[usual]] == pairs[usual]
                chunk = np.repeat(np.arange(len(links)), links)
                of = np.zeros((3, len(links)), np.int64)  # best links, sum of counts, rare links of each chunk
                np.add.at(of[0], chunk[usual], top[place[usual]].astype(np.int64))
                np.add.at(of[1], chunk[usual], number[place[usual]])
                np.add.at(of[2], chunk[~usual], 1)
                sums = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(of[:, codes], axis=1)], axis=1)
                starts = np.append(0, ends)
                best, total, rares = np.diff(sums[:, starts], axis=1)
                count = of[2][codes]
                some, first = pairs[~usual], np.append(0, np.cumsum(of[2]))
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first[codes], count)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rares)), pa.int32()), pa.array(some[at]))
                sent = [*numbers.reshape(4, -1), best, total]
                yield pa.RecordBatch.from_arrays([batch.column("row")[r].values, batch.column("doc_id")[r].values, *map(pa.array, sent), batch.column("sha")[r].values, lists], names)

    found = written(blocks.mapInArrow(run, "row long, doc_id long, " + ", ".join(f"{c} long" for c in columns) + ", groups_sha256 string, rare array<long>"))
    rare = found.where("size(rare) > 0").select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("links"))
    rare = rare.join(counts.where(F.col("n") * COMMON <= total), "pair")
    nothing = [F.lit(0).cast("long").alias(c) for c in columns[:4]]
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), *nothing, F.when(F.col("top"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"), F.lit("").alias("groups_sha256"))
    both = found.drop("rare").unionByName(rare).groupBy("row")
    return both.agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in columns], F.max("groups_sha256").alias("groups_sha256")).drop("row")
