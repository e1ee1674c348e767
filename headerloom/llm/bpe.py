"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, and decoding by retained offsets.

Texts are laid end to end as code points. Each code point becomes a symbol (its class, with what
follows where the pattern looks ahead), and each symbol is a function from states to states of a small
automaton. These functions have finitely many compositions, so a composition is a number and composing
two is one table lookup; it is associative, so the state before every code point comes from a blocked
prefix scan, without a regular expression and without a loop over the text. A token starts where state
and symbol say so. Equal slices are encoded once: pairs are merged by rank, and the ids are kept in a
cache of bounded size. Ids come with the byte at which each ends, so any part can be decoded.

The automaton states the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|\\s+(?!\\S)|\\s+``, where
L, N and O are letters, numbers and all else but white space.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.shared import STEP_BYTES, mixed, slice_hashes, steps, texts_of

# Symbols. APOS2 and APOS3 are apostrophes that a contraction of two or three characters follows; WHITE is
# white space before white space or the end; LAST is the last of a run but a space, SPACE a last space.
LETTER, NUMBER, OTHER, APOS2, APOS3, WHITE, LAST, SPACE, TEXT = range(9)
# States: which token the next code point may belong to. NEW: to none; SHORT1, SHORT2: a contraction lacks one or two.
NEW, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, SHORT1, SHORT2 = range(8)
#: Slices that a worker keeps the ids of.
CACHE = 200_000
#: Ids that are decoded at once.
AT_ONCE = 1 << 16
NO_RANK = np.int32(0x7FFFFFFF)
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token starts at this symbol)."""
    if symbol == TEXT:
        return NEW, False
    if state in (SHORT1, SHORT2):
        return (NEW if state == SHORT1 else SHORT1), False
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    if symbol in runs:
        return runs[symbol], state not in (runs[symbol], AFTER_SPACE)
    if symbol in (APOS2, APOS3):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return (SHORT1 if symbol == APOS2 else SHORT2), True
    if symbol == WHITE:
        return IN_WHITE, state != IN_WHITE
    return (NEW if symbol == LAST else AFTER_SPACE), True


@functools.cache
def _automaton():
    """(number of each symbol's function, composition table, functions as rows, starts[state, symbol])."""
    starts = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])
    functions = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    number = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    for f in todo:  # all compositions
        for g in functions:
            h = tuple(g[s] for s in f)
            if h not in number:
                number[h] = len(number)
                todo.append(h)
    table = np.array([[number[tuple(g[s] for s in f)] for g in todo] for f in todo], np.uint16)
    return np.array([number[f] for f in functions], np.uint16), table, np.array(todo, np.uint8), starts


def _prefixes(items: np.ndarray, table: np.ndarray, width: int = 64) -> np.ndarray:
    """The composition of all items before each item: blocks in parallel, then the blocks' own prefixes."""
    n = len(items)
    if n <= width:
        out, now = np.zeros(n, np.uint16), 0
        for i in range(n):
            out[i] = now
            now = table[now, items[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)
    grid[:n] = items
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, size = table.reshape(-1), table.shape[1]
    inside = np.zeros_like(grid)
    now = np.zeros(rows, np.uint16)
    for j in range(width):
        inside[j] = now
        now = flat[now.astype(np.int32) * size + grid[j]]
    before = _prefixes(now, table, width)
    out = flat[before.astype(np.int32)[None, :] * size + inside]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def code_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE for each of the 0x110000 code points, by the tables of the tokenizer library."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        out[np.frombuffer(bytes(found.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
    return out


def pretokens(raw: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The bytes at which pre-tokens start, in the texts raw[at[i]:at[i + 1]]."""
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte at which each code point starts
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[code]
    begin = np.searchsorted(lead, at[:-1])  # of texts, in code points
    final = np.zeros(n + 1, bool)
    final[begin] = True
    final[n] = True
    ends = final[1:]  # the text ends after this code point
    next1 = np.append(code[1:], 0)
    next1[ends] = 0
    two = np.append(next1[1:], 0)
    two[ends] = 0
    symbol = kind.copy()
    last = (kind == WHITE) & ~ends & (np.append(kind[1:], WHITE) != WHITE)
    symbol[last] = np.where(code[last] == 32, SPACE, LAST)
    apos = np.flatnonzero(code == ord("'"))
    after, after2 = next1[apos], two[apos]
    symbol[apos[np.isin(after, [ord(c) for c in "stmd"])]] = APOS2
    pair = np.zeros(len(apos), bool)
    for x, y in ("re", "ve", "ll"):
        pair |= (after == ord(x)) & (after2 == ord(y))
    symbol[apos[pair]] = APOS3
    own, table, functions, starts = _automaton()
    # A TEXT symbol before each text that has code points brings the state back to NEW.
    heads = np.unique(begin[begin < n])
    place = np.arange(n) + np.searchsorted(heads, np.arange(n), "right")
    full = np.full(n + len(heads), TEXT, np.uint8)
    full[place] = symbol
    state = functions[_prefixes(own[full], table), NEW][place]
    return lead[starts[state, symbol]].astype(np.int64)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of the lowest rank is merged, the leftmost first, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != stop or end[i] != j:
            continue  # one of its parts has changed
        end[i], end[j] = stop, 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            k = after[i]
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]


class Codec:
    """Ranks and classes with the cache of slices; made once in a worker."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.ranks, self.classes, self.cache = ranks, classes, {}
        pairs = sorted((ranks[w[:i]] << 32 | ranks[w[i:]], r) for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks)
        self.pairs = np.array([x for x, _ in pairs] or [-1], np.int64)  # two ids that make a third
        self.made = np.array([x for _, x in pairs] or [NO_RANK], np.int32)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        words = sorted(ranks.items(), key=lambda x: x[1])
        size = np.zeros((words[-1][1] if words else 0) + 2, np.int64)
        for word, i in words:
            size[i + 1] = len(word)
        self.begin = np.cumsum(size)
        self.words = np.frombuffer(b"".join(w for w, _ in words), np.uint8)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that pairs of ids make; NO_RANK for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], NO_RANK)

    def _merged(self, pieces: list[bytes], width: int) -> list[bytes]:
        """merge() of many pieces of 2 to ``width`` bytes at once, each as the bytes of its ids: one merge of every piece a round."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        part = np.zeros((n, width + 1), np.int32)
        inside = np.arange(width + 1) < size[:, None]
        part[inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width), NO_RANK, np.int32)  # of the pair that starts at each part
        paired = inside[:, 1:]
        rank[paired] = self._joined(part[:, :-1][paired], part[:, 1:][paired])
        done, todo = np.zeros((n, width), np.int32), np.arange(n)
        left, where = size.copy(), np.arange(width)
        while len(todo):
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(at)), at]
            over = least == NO_RANK
            if over.any():
                done[todo[over]] = part[over, :width]
                keep = ~over
                todo, part, rank, at, least = todo[keep], part[keep], rank[keep], at[keep], least[keep]
                if not len(todo):
                    break
            row = np.arange(len(todo))
            left[todo] -= 1
            # The parts after the merged pair move up by one.
            part[:, :-1] = np.where(where > at[:, None], part[:, 1:], part[:, :-1])
            rank[:, :-1] = np.where(where[:-1] > at[:, None], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NO_RANK
            part[row, at] = least
            follows = at + 1 < left[todo]
            rank[row, at] = NO_RANK
            rank[row[follows], at[follows]] = self._joined(least[follows], part[row[follows], at[follows] + 1])
            led = at > 0
            rank[row[led], at[led] - 1] = self._joined(part[row[led], at[led] - 1], least[led])
        body, end = done[np.arange(width) < left[:, None]].tobytes(), (np.cumsum(left) * 4).tolist()
        return [body[i:j] for i, j in zip([0, *end], end)]

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as bytes of 32-bit integers."""
        found = [self.cache.get(x) for x in pieces]
        by_width: dict[int, list[int]] = {}
        for i, x in enumerate(found):
            if x is None:
                whole = self.ranks.get(pieces[i])
                if whole is not None:
                    found[i] = whole.to_bytes(4, "little")
                else:
                    by_width.setdefault(8 if len(pieces[i]) <= 8 else 16 if len(pieces[i]) <= 16 else 32 if len(pieces[i]) <= 32 else 0, []).append(i)
        if len(self.cache) > CACHE:
            self.cache.clear()
        for width, those in by_width.items():
            own = [pieces[i] for i in those]
            ids = self._merged(own, width) if width else [np.array(merge(x, self.ranks), np.int32).tobytes() for x in own]
            for i, x in zip(those, ids):
                found[i] = x
            if width:
                self.cache.update(zip(own, ids))
        return found

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of the texts raw[at[i]:at[i + 1]]."""
        start = pretokens(raw, at, self.classes)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        end = np.append(start[1:], len(raw))
        # Equal slices share a hash; a slice of another length has another key.
        key = mixed(slice_hashes(raw, start, end) + (end - start).astype(np.uint64))
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        body = raw.tobytes()
        found = self._ids([body[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())])
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), np.int32), np.cumsum(count) - count
        many = count[which]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ids = flat[np.repeat(begin[which], many) + nth]
        before = np.append(0, np.cumsum(many))
        total = np.diff(before[np.searchsorted(start, at)])
        if not np.array_equal(self.decode(ids), raw):  # two slices had one hash: each piece by itself
            found = self._ids([body[i:j] for i, j in zip(start.tolist(), end.tolist())])
            ids = np.frombuffer(b"".join(found), np.int32)
            before = np.append(0, np.cumsum([len(x) // 4 for x in found]))
            total = np.diff(before[np.searchsorted(start, at)])
        return ids, total

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.begin[ids + 1] - self.begin[ids]

    def encode_long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one long text, piece by piece."""
        cut = [*safe_cuts(raw), len(raw)]
        return np.concatenate([self.encode(raw[i:j], np.array([0, j - i]))[0] for i, j in zip(cut, cut[1:])])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        out = []
        for at in range(0, max(len(ids), 1), AT_ONCE):
            part = ids[at : at + AT_ONCE]
            size = self.sizes(part)
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out.append(self.words[np.repeat(self.begin[part], size) + nth])
        return np.concatenate(out)


def safe_cuts(raw: np.ndarray, every: int | None = None) -> list[int]:
    """Places about ``every`` bytes apart, 0 first, at which a pre-token begins whatever surrounds them: a space between two ASCII letters."""
    every = every or STEP_BYTES
    cuts = [0]
    while len(raw) - cuts[-1] > 2 * every:
        at = cuts[-1] + every
        while at < len(raw) - 1:
            part = raw[at - 1 : at + every]
            letter = _LETTER[part]
            found = np.flatnonzero((part[1:-1] == 32) & letter[:-2] & letter[2:])
            if len(found):
                break
            at += every - 1
        else:
            break
        cuts.append(at + int(found[0]))
    return cuts


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its id in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_codecs: dict[str, Codec] = {}


def _codec(name: str, shared) -> Codec:
    if name not in _codecs:
        _codecs.clear()
        ranks, classes = shared.value
        _codecs[name] = Codec(ranks, np.frombuffer(classes, np.uint8))
    return _codecs[name]


def _shared(spark, path: str):
    """The ranks and classes of a file (at most a few MB, whatever the data) as a broadcast, and its name."""
    ranks = read_ranks(path)
    name = hashlib.blake2b(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()).hexdigest()
    return name, spark.sparkContext.broadcast((ranks, code_classes().tobytes()))


def _schema(plain: DataFrame, made: list[str], keep) -> str:
    kinds = dict(plain.dtypes)
    return ", ".join([f"doc_id {kinds['doc_id']}", *made, *[f"`{c}` {kinds[c]}" for c in keep]])


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>, ends array<int> (the byte of the text's UTF-8 at which each id ends).

    ``path``: a rank file on the driver. ``keep``: columns of docs that go along. Every whole text is encoded; null and empty texts give empty
    arrays; rows that repeat are encoded each; other columns are ignored; an empty table gives an empty one.
    """
    name, shared = _shared(docs.sparkSession, path)

    def run(batches):
        codec = _codec(name, shared)
        for part in steps(batches):
            raw, at = texts_of(part.column(1))
            if part.num_rows == 1 and len(raw) > 2 * STEP_BYTES:
                ids = codec.encode_long(raw)
                count = np.array([len(ids)])
            else:
                ids, count = codec.encode(raw, at)
            rows = np.append(0, np.cumsum(count))
            reach = np.cumsum(codec.sizes(ids)) - np.repeat(at[:-1], count)
            at32 = pa.array(rows, pa.int32())
            lists = [pa.ListArray.from_arrays(at32, pa.array(x, pa.int32())) for x in (ids, reach)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists, *part.columns[2:]], ["doc_id", "ids", "ends", *keep])

    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    return plain.mapInArrow(run, _schema(plain, ["ids array<int>", "ends array<int>"], keep))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))


def _decoding(coded: DataFrame, path: str, schema: str, out) -> DataFrame:
    name, shared = _shared(coded.sparkSession, path)

    def run(batches):
        codec = _codec(name, shared)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                ids, rows = _lists(part.column("ids"))
                raw = codec.decode(ids)
                at = np.append(0, np.cumsum(codec.sizes(ids)))[rows]
                yield out(part, ids, rows, raw, at)

    return coded.mapInArrow(run, schema)


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, body (binary): the bytes that the ids of ``coded`` (doc_id, ids) stand for; null ids give none."""

    def out(part, ids, rows, raw, at):
        body = raw.tobytes()
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([body[i:j] for i, j in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "body"])

    return _decoding(coded.select("doc_id", "ids"), path, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, body binary", out)


def digests(coded: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes); columns of ``keep`` go along."""

    def out(part, ids, rows, raw, at):
        words, body = ids.astype("<u4"), raw.tobytes()
        one = [hashlib.sha256(words[i:j].tobytes()).hexdigest() for i, j in zip(rows[:-1], rows[1:])]
        two = [hashlib.sha256(body[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:])]
        more = [part.column(c) for c in keep]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(rows).astype(np.int64)), pa.array(one), pa.array(two), *more], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    plain = coded.select(*dict.fromkeys(["doc_id", "ids", *keep]))
    return _decoding(plain, path, _schema(plain, ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"], keep), out)
