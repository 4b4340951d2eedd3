"""Byte-level BPE with vectorised pre-tokenisation.

The split pattern of the public vocabularies is run as a finite automaton, without a regular expression. Code points
become an array of classes, refined by what follows them so that the automaton never looks ahead. Each class is a
function from state to state; functions compose associatively, so blocks of text are composed side by side, a scan
over the blocks gives each its first state, and a replay marks the token starts. The slices between starts go through
a cache of merged pieces. Each id keeps the byte at which it starts, so any range of ids decodes to a known range.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import bounded_batches, sliced, tidy

#: The code points with the Unicode property White_Space.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Classes: letter, number, other, apostrophe before one or two letters of a contraction, space or other white space
#: before something else, white space before more of it or the end.
L, N, P, A1, A2, SPACE, BREAK, WS = range(8)
#: States: nothing open, inside letters, numbers, others or white space, after a space that joins what follows, and
#: two or one letters before a contraction ends.
START, IN_L, IN_N, IN_P, IN_WS, JOIN, TWO, ONE = range(8)
STATES = 8
BLOCK = 256
#: Pieces that a worker remembers before it forgets them all; bytes up to which pieces are merged side by side.
CACHE = 1 << 17
SHORT = 64
#: Bytes of texts or ids worked on at a time; what is made of them takes some forty times as many.
BYTES = 1 << 20


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and start[class, state]; classes from 8 on are those of a text's first code point."""
    after, start = np.zeros((8, STATES), np.uint8), np.ones((8, STATES), np.uint8)

    def put(kind: int, default: int, **known: tuple[int, int]) -> None:
        after[kind] = default
        for name, (state, begins) in known.items():
            after[kind, globals()[name]], start[kind, globals()[name]] = state, begins

    put(L, IN_L, IN_L=(IN_L, 0), JOIN=(IN_L, 0), TWO=(ONE, 0), ONE=(START, 0))
    put(N, IN_N, IN_N=(IN_N, 0), JOIN=(IN_N, 0))
    put(P, IN_P, IN_P=(IN_P, 0), JOIN=(IN_P, 0))
    put(A1, ONE, IN_P=(IN_P, 0), JOIN=(IN_P, 0))
    put(A2, TWO, IN_P=(IN_P, 0), JOIN=(IN_P, 0))
    put(SPACE, JOIN)
    put(BREAK, START)
    put(WS, IN_WS, IN_WS=(IN_WS, 0))
    first = np.repeat(after[:, START : START + 1], STATES, axis=1)
    return np.concatenate([after, first]), np.concatenate([start, np.ones((8, STATES), np.uint8)])


AFTER, BEGINS = _automaton()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The unrefined class of every code point: L, N, P or WS. Made once in a worker."""
    global _classes
    if _classes is None:
        kinds = {"L": L, "N": N}
        _classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], P) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        _classes[WHITE] = WS
    return _classes


def refined(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The class of each code point in its place; ``first`` are the places where texts begin."""
    kind = classes()[points]
    n = len(points)
    last = np.zeros(n + 2, bool)  # beyond here another text begins
    last[np.concatenate([first[1:], [n]]) - 1] = True
    one = np.concatenate([points[1:], [0, 0]])
    two = np.concatenate([points[2:], [0, 0, 0]])
    space = np.flatnonzero(kind == WS)
    follows = ~last[space]
    follows &= kind[np.minimum(space + 1, n - 1)] != WS
    before = space[follows]
    out = kind.copy()
    out[before] = np.where(points[before] == 0x20, SPACE, BREAK)
    quote = np.flatnonzero(points == 0x27)
    quote = quote[~last[quote]]
    b, c = one[quote], two[quote]
    out[quote[np.isin(b, [ord(x) for x in "stmd"])]] = A1
    pair = ((c == ord("e")) & ((b == ord("r")) | (b == ord("v")))) | ((b == ord("l")) & (c == ord("l")))
    out[quote[pair & ~last[np.minimum(quote + 1, n)]]] = A2
    out[first] += 8
    return out


def token_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a token starts at each place, by an associative scan of transition functions."""
    n = len(kinds)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, P, np.uint8)
    grid[:n] = kinds
    columns = np.ascontiguousarray(grid.reshape(rows, BLOCK).T).astype(np.int64) * STATES
    flat_after, flat_begins = AFTER.ravel(), BEGINS.ravel()
    made = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in columns:
        made = flat_after[column[:, None] + made]
    step = 1
    while step < rows:  # each block's function after those of all blocks before it
        made[step:] = np.take_along_axis(made[step:], made[:-step].astype(np.int64), axis=1)
        step *= 2
    state = np.concatenate([[START], made[:-1, START]]).astype(np.uint8)
    out = np.empty((BLOCK, rows), np.uint8)
    for i, column in enumerate(columns):
        at = column + state
        out[i] = flat_begins[at]
        state = flat_after[at]
    return out.T.ravel()[:n].astype(bool)


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts' UTF-8 in one, the bytes where pieces start (and the end), and the pieces before each text."""
    line = "".join(texts)
    if not line:
        return b"", np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(lengths) - lengths
    begins = token_starts(refined(points, np.unique(begin[lengths > 0])))
    places = np.flatnonzero(begins)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(width)])
    return line.encode(), np.concatenate([byte[places], byte[-1:]]), np.concatenate([np.searchsorted(places, begin), [len(places)]])


class Pairs:
    """From two neighbouring ids to the id of both joined, as a hash table in arrays; an id is its token's rank."""

    NONE = (1 << 31) - 1

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        made = [(left, right, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (left := get(token[:i])) is not None and (right := get(token[i:])) is not None]
        left, right, rank = np.array(made, np.uint64).reshape(-1, 3).T
        keys = left << np.uint64(32) | right
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64).view(np.uint64), np.full(1 << bits, self.NONE, np.int64)
        at, todo = self._place(keys), np.arange(len(keys))
        while len(todo):  # the first to reach an empty place has it, others go on to the next
            free = self.keys[at[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            place, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[place], self.ranks[place] = keys[won], rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined id of each pair, NONE if there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(keys), self.NONE, np.int64)
        at, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            seen = self.keys[at]
            hit = seen == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (seen != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, at = todo[more], (at[more] + 1) & self.mask
        return out


class Encoder(dict):
    """From a piece's bytes to its number; ``flat[first[k] : first[k] + count[k]]`` are the ids of number k."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = list(map(len, ranks))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, pieces: list[bytes]) -> None:
        """Merges pieces that aren't known, all short ones side by side."""
        get = self.ranks.get
        whole = [p for p in pieces if p in self.ranks]
        rest = [p for p in pieces if p not in self.ranks]
        short = [p for p in rest if len(p) <= SHORT]
        long = [p for p in rest if len(p) > SHORT]
        ids, count = self._merged(short)
        by_heap = [[get(t) for t in merged(p, self.ranks)] for p in long]
        known = len(self)
        self.update(zip(whole + short + long, range(known, known + len(pieces)), strict=True))
        count = np.concatenate([self.count, np.ones(len(whole), np.int64), count, np.array([len(x) for x in by_heap], np.int64)])
        self.flat = np.concatenate([self.flat, np.array([get(p) for p in whole], np.int64), ids, np.array([x for y in by_heap for x in y], np.int64)])
        self.count, self.first = count, np.cumsum(count) - count

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order and their number in each. A round joins one pair in every piece that has one:
        of lowest rank, leftmost first; pieces that are done leave."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(ids), Pairs.NONE, np.int64)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.pairs.joined(ids[inner], ids[inner + 1])
        done_ids, done_owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.concatenate([first, [len(ids)]])))
            over = least == Pairs.NONE
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank, least = ids[~over], owner[~over], rank[~over], least[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            ids[at] = rank[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # one element went for each pair before it
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            last = np.concatenate([owner[1:] != owner[:-1], [True]])
            rank[at] = Pairs.NONE
            after = at[~last[at]]
            before = at[(at > 0)] - 1
            before = before[~last[before]]
            rank[after] = self.pairs.joined(ids[after], ids[after + 1])
            rank[before] = self.pairs.joined(ids[before], ids[before + 1])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Joins the neighbours of lowest rank, leftmost first, until no two neighbours have one; n log n for n bytes."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been joined to another since
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    found, i = [], 0
    while i < n:
        found.append(piece[i : end[i]])
        i = after[i]
    return found


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_batch(texts: list[str], encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, the byte of its text at which each starts, and where each text's ids begin and end."""
    if len(encoder) > CACHE:
        encoder.forget()
    data, byte, upto = slices(texts)
    edges = byte.tolist()
    pieces = [data[i:j] for i, j in zip(edges, edges[1:], strict=False)]
    if fresh := set(pieces).difference(encoder):
        encoder.learn(list(fresh))
    number = np.fromiter(map(encoder.__getitem__, pieces), np.int64, len(pieces))
    n = encoder.count[number]
    ends = np.cumsum(n)
    ids = encoder.flat[np.arange(int(n.sum())) + np.repeat(encoder.first[number] - (ends - n), n)]
    bounds = np.concatenate([[0], ends])[upto]
    size = encoder.size[ids]
    start = np.cumsum(size) - size
    return ids.astype(np.int32), start - np.repeat(byte[upto[:-1]], np.diff(bounds)), bounds


def decode_batch(column: pa.ListArray, tokens: list[bytes]) -> pa.Array:
    """The bytes of each row's ids."""
    bounds = np.asarray(column.offsets)
    found = list(map(tokens.__getitem__, np.asarray(column.values.slice(bounds[0], bounds[-1] - bounds[0])).tolist()))
    edges = (bounds - bounds[0]).tolist()
    return pa.array([b"".join(found[i:j]) for i, j in zip(edges, edges[1:], strict=False)], pa.binary())


def by_rank(ranks: dict[bytes, int]) -> list[bytes]:
    ordered = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        ordered[rank] = token
    return ordered


def sent_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The ranks, of a fixed vocabulary of under a megabyte, are read on the driver and broadcast."""
    ranks = read_ranks(path)
    if sum(map(len, ranks)) > 64 << 20:
        raise ValueError("this vocabulary is too large to broadcast")
    return spark.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None, starts: bool = True, decoded: bool = False) -> DataFrame:
    """The columns ``keep``, ``ids`` array<int> and ``starts`` array<int>, the byte where each id's text starts.

    With ``decoded`` also the bytes that the ids give when they are decoded, in the same pass. A null text is encoded as
    an empty one: no ids. Texts of any length are encoded whole; repeated rows stay, no rows give none.
    """
    keep = keep or []
    bounded_batches(docs.sparkSession)
    sent = sent_ranks(docs.sparkSession, ranks_path)
    now = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = [*keep, "ids", *["starts"] * starts, *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        tokens = by_rank(sent.value) if decoded else []
        for batch in batches:
            for part in sliced(batch, BYTES):
                ids, start, bounds = encode_batch(part.column(len(keep)).to_pylist(), encoder)
                offsets = pa.array(bounds.astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                more = [pa.ListArray.from_arrays(offsets, pa.array(start.astype(np.int32)))] if starts else []
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists, *more, *([decode_batch(lists, tokens)] if decoded else [])], names=names)
        del encoder, tokens
        tidy()

    schema = "".join(f"`{c}` {now.schema[c].dataType.simpleString()}, " for c in keep) + "ids array<int>" + ", starts array<int>" * starts + ", decoded binary" * decoded
    return now.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and ``decoded`` binary, the bytes of the ids; null or empty ids give no bytes."""
    keep = keep or []
    bounded_batches(encoded.sparkSession)
    sent = sent_ranks(encoded.sparkSession, ranks_path)
    now = encoded.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = by_rank(sent.value)
        for batch in batches:
            for part in sliced(batch, BYTES):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], decode_batch(part.column(len(keep)), tokens)], names=[*keep, "decoded"])
        tidy()

    schema = "".join(f"`{c}` {now.schema[c].dataType.simpleString()}, " for c in keep) + "decoded binary"
    return now.mapInArrow(run, schema)
