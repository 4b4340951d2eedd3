"""SimHash near-duplicates by anchor-point covering.

A fingerprint of one or more 64-bit words is cut into blocks; two fingerprints that differ in fewer than twice as many
places as there are blocks differ in at most one place of some block. The anchors of a block are a covering code: the
perfect (15, 11) Hamming code on its first 15 places, with all words on the others, whose covering radius is 1. A
fingerprint has its home at the anchor that it decodes to, and is replicated to the anchors within the covering radius
plus the block's threshold of one that hold a point one step away. So two such fingerprints meet at the home of one of
them, and each anchor compares what it holds. A step of one changes a block's parity, so only words of even parity
need be replicated.

Links found at an anchor leave it as a spanning forest, never as all pairs of a group; components of the forests
are the components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.llm.common import ROW, bounded_batches, cut, identified, once, sliced, spread_join, stored, tidy
from lumenspark.llm.components import components, forest

#: Fixed values of the contract: XXH64's seed, and the length of the perfect code's words.
SEED = 42
CODE = 15
#: For near-duplicates by similarity: words of a shingle and of a fingerprint, blocks, places in which candidates may
#: differ, and the least similarity of shingle sets. Two texts that share 0.8 of their shingles differ in 39 of 256
#: places on average, with a deviation of 6.
WIDTH, WORDS, BLOCKS, BITS = 5, 4, 14, 64
SIMILARITY = 0.8
#: Rows of an anchor beyond which its comparisons are dealt to several cells.
CELL = 8192
#: Pairs compared at a time.
PAIRS = 1 << 21
#: Shingles and rows of a group of candidates beyond which its verification is dealt to several cells.
SHINGLES, MEMBERS = 1 << 18, 2048


def shingle_hashes(data: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8, repeats included; none without words.

    Words are runs of other than ASCII white space, A-Z lower-cased; a shingle is ``width`` words joined by a space, or
    the whole sequence if it is shorter.
    """
    words = data.lower().split() if data else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) <= width:
        starts, stops = [0], [len(line)]
    else:
        starts = [0, *ends[: len(words) - width].tolist()]
        stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)), np.uint64, len(starts))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hashes for a fingerprint's k-th word: as they are for the first, permuted by a finalizer for others."""
    if not k:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 of none."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        set_bits += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes | None, width: int, words: int = 1) -> list[int]:
    """One 64-bit word or more; all 0 for a text without words."""
    hashes = shingle_hashes(data, width)
    return [majority(mixed(hashes, k)) for k in range(words)]


def fingerprints(docs: DataFrame, text: str, keep: list[str], width: int, words: int = 1, sets: bool = False) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint's words as signed bigints. A null text has no words.

    With ``sets`` also ``same``, a hash of the set of shingles.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col(text).cast("binary").alias("_data"))
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep) + ", fp array<bigint>" + ", same bigint" * sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                hashes = [shingle_hashes(x, width) for x in part.column(len(keep)).to_pylist()]
                found = np.array([[majority(mixed(h, k)) for k in range(words)] for h in hashes], np.uint64).reshape(-1, words)
                offsets = pa.array(np.arange(0, found.size + 1, words, dtype=np.int32))
                same = [pa.array(np.array([xxhash.xxh64_intdigest(np.unique(h).tobytes(), SEED) for h in hashes], np.uint64).view(np.int64))] if sets else []
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(offsets, pa.array(found.view(np.int64).ravel())), *same], names=[*keep, "fp", *["same"] * sets])
        tidy()

    return kept.mapInArrow(run, schema)


def block_places(words: int, blocks: int) -> list[tuple[int, int, int]]:
    """(word, first place, places) of the blocks, as long as can be; none goes from one word into the next."""
    each = [blocks // words + (k < blocks % words) for k in range(words)]
    if 64 // max(each) < CODE:
        raise ValueError(f"{blocks} blocks of {words} words have under {CODE} places")
    return [(k, 64 * i // n, 64 * (i + 1) // n - 64 * i // n) for k, n in enumerate(each) for i in range(n)]


def decode(words: np.ndarray) -> np.ndarray:
    """The anchor of each word: its first 15 places moved to the code word within one step."""
    syndrome = np.zeros(words.shape, np.uint64)
    for place in range(CODE):
        syndrome ^= ((words >> np.uint64(place)) & np.uint64(1)) * np.uint64(place + 1)
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1)), np.uint64(0))
    return words ^ flip


def anchors(fps: np.ndarray, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, home) for each fingerprint's home and replicas; the anchor's number holds its block."""
    rows = np.arange(len(fps))
    for k, (word, first, places) in enumerate(block_places(fps.shape[1], blocks)):
        words = (fps[:, word] >> np.uint64(first)) & np.uint64((1 << places) - 1)
        name = np.uint64(k << 48)
        home = decode(words)
        yield name | home, rows, np.ones(len(fps), bool)
        even = np.bitwise_count(words) % 2 == 0
        near = np.stack([decode(words[even] ^ np.uint64(1 << p)) for p in range(places)], axis=1)
        near.sort(axis=1)
        new = near != home[even][:, None]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        yield name | near[new], np.repeat(rows[even], new.sum(axis=1)), np.zeros(int(new.sum()), bool)


def links(cell: np.ndarray, node: np.ndarray, fp: np.ndarray, role: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within the cells; rows are sorted by cell. Role 1: asks; 2: is asked; 3: both."""
    bounds = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = np.repeat(np.diff(bounds), np.diff(bounds))
    start = np.repeat(bounds[:-1], np.diff(bounds))
    asks = np.flatnonzero((role & 1 > 0) & (size > 1))
    asked = role & 2 > 0
    words = [np.ascontiguousarray(fp[:, k]) for k in range(fp.shape[1])]
    work = np.cumsum(size[asks])
    at = 0
    while at < len(asks):
        done = work[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(work, done + PAIRS, "right")))
        own = asks[at:upto]
        n = size[own]
        for low in range(0, int(n.max()), PAIRS):  # one row's partners alone may be more than PAIRS
            m = np.minimum(n - low, PAIRS).clip(0)
            i = np.repeat(own, m)
            j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[own] + low, m)
            apart = np.zeros(len(i), np.int64)
            for word in words:  # most pairs are too far apart after a word or two
                apart += np.bitwise_count(word[i] ^ word[j])
                near = apart <= bits
                if len(words) > 1:
                    i, j, apart = i[near], j[near], apart[near]
            near = (apart <= bits) & (node[i] != node[j]) & asked[j]
            if near.any():
                a, b = forest(node[i[near]], node[j[near]])
                found_a.append(a)
                found_b.append(b)
        at = upto
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def fingerprint_links(fps: DataFrame, bits: int, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) of nodes whose components are those of the links of ``bits`` or fewer differing places.

    ``fps`` has a bigint ``node`` and array ``fp`` for each distinct fingerprint. All links are found whose blocks leave one
    with a step at most; with the default number of blocks that is every link. Cells take an anchor's rows; an anchor
    with more than CELL rows is dealt to a square of cells, each row to a line of them, so that no task holds an
    unbounded group.
    """
    blocks = blocks or bits // 2 + 1

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                nodes, values = np.asarray(part.column(0)), np.asarray(part.column(1).flatten()).view(np.uint64).reshape(part.num_rows, -1)
                for anchor, row, home in anchors(values, blocks):
                    offsets = pa.array(np.arange(0, row.size * values.shape[1] + 1, values.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(nodes[row]), pa.ListArray.from_arrays(offsets, pa.array(values[row].view(np.int64).ravel())), pa.array(home)], names=["anchor", "node", "fp", "home"])
        tidy()

    wide = fps.select(F.size("fp")).first()
    wide = wide[0] if wide else 1
    placed = fps.select("node", "fp").mapInArrow(replicate, "anchor bigint, node bigint, fp array<bigint>, home boolean")
    placed = placed.select("anchor", "node", "home", *[F.col("fp")[k].alias(f"w{k}") for k in range(wide)])
    # written, so that the planner knows how small it is and needn't deal the replicas out for it
    hot = stored(placed.groupBy("anchor").count().where(F.col("count") > CELL).select(F.col("anchor").alias("hot"), F.ceil(F.col("count") / CELL).cast("int").alias("side")), "hot")
    dealt = placed.join(hot, placed.anchor == hot.hot, "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("side", F.lit(1))).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce("side", F.lit(1)) - 1)

    def cells(row: Column, column: Column) -> Column:
        return F.xxhash64("anchor", row, column)

    one = F.array(F.struct(F.xxhash64("anchor").alias("cell"), F.when(F.col("home"), 3).otherwise(2).alias("role")))
    asked = F.transform(every, lambda k: F.struct(cells(k, F.col("own")).alias("cell"), F.lit(2).alias("role")))
    asking = F.when(F.col("home"), F.transform(every, lambda k: F.struct(cells(F.col("own"), k).alias("cell"), F.lit(1).alias("role")))).otherwise(F.array())
    names = [f"w{k}" for k in range(wide)]
    spread = dealt.select("node", *names, F.inline(F.when(F.col("side").isNull(), one).otherwise(F.concat(asked, asking))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def of(node: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
            a, b = links(rest[-2], node, np.stack([w.view(np.uint64) for w in rest[:-2]], axis=1), rest[-1], bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cell = now[-2]
            last = int(np.searchsorted(cell, cell[-1], "left")) if len(cell) else 0
            held = [x[last:] for x in now]
            if last:
                yield of(*[x[:last] for x in now])
        if held is not None and len(held[0]):
            yield of(*held)
        held = None
        tidy()

    return spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a bigint, b bigint")


def classes(marked: DataFrame, bits: int, blocks: int | None = None) -> DataFrame:
    """(node, fp, root, component_id) of each distinct fingerprint of ``marked`` (_key, fp): the least key that links reach.

    A node is the fingerprint itself where it is one word, else 64 bits of it.
    """
    node = F.when(F.size("fp") == 1, F.col("fp")[0]).otherwise(F.xxhash64("fp"))
    fps = cut(marked.groupBy("fp").agg(F.min("_key").alias("least")).withColumn("node", node))
    roots = components(fingerprint_links(fps, bits, blocks))
    rooted = cut(fps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(rooted, least, ["root"]).select("node", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: the key, ``fp`` and ``component_id``, the least key that links reach.

    ``fp`` is one word, and every pair that differs in ``bits`` or fewer places links. Null texts and texts without
    words have fingerprint 0 and are linked like any other. Repeated rows stay and share a component; null keys are
    never the least, unless a component has no other (then it is null). An empty table gives no rows. Other columns of
    ``docs`` are not looked at.
    """
    marked = cut(fingerprints(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", ["_key"], width))
    known = cut(classes(marked, bits).select("fp", "component_id"))
    return spread_join(marked, known, ["fp"]).select(F.col("_key").alias(key), F.col("fp")[0].alias("fp"), "component_id")


def verified(node: np.ndarray, line: np.ndarray, fp: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, bits: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of one cell's links: pairs of up to ``bits`` places whose sets share ``least`` or more of their union.

    ``shingles`` are the rows' sets, one after the other, ``sizes`` long. Rows of line 2 meet all rows, others those of the
    other line. Rows that links already join are not compared again.
    """
    starts = np.cumsum(sizes) - sizes
    known, numbers = np.unique(shingles, return_inverse=True)
    own = np.zeros(len(known), bool)
    group = np.arange(len(node))
    found: list[tuple[int, int]] = []
    for i in range(len(node) - 1):
        if not sizes[i]:
            continue
        n = sizes[i + 1 :]
        able = (group[i + 1 :] != group[i]) & (np.minimum(n, sizes[i]) >= least * np.maximum(n, sizes[i]) - 1e-9)
        if line[i] != 2:
            able &= line[i + 1 :] != line[i]
        j = np.flatnonzero(able) + i + 1
        j = j[np.bitwise_count(fp[j] ^ fp[i]).sum(axis=1) <= bits]
        if not len(j):
            continue
        n = sizes[j]
        first = np.cumsum(n) - n
        mine = numbers[starts[i] : starts[i] + sizes[i]]
        own[mine] = True
        shared = np.add.reduceat(own[numbers[np.arange(n.sum()) - np.repeat(first - starts[j], n)]], first, dtype=np.int64)
        own[mine] = False
        j = j[shared >= least * (sizes[i] + n - shared) - 1e-9]
        if len(j):
            labels, at = np.unique(group[j], return_index=True)
            found += [(i, k) for k in j[at].tolist()]
            group[np.isin(group, labels)] = group[i]
    ends = np.array(found, np.int64).reshape(-1, 2)
    return node[ends[:, 0]], node[ends[:, 1]]


def similar(members: DataFrame, width: int, words: int, bits: int, least: float) -> DataFrame:
    """Edges (a, b) whose components are those of the links within each group of candidates.

    ``members`` has node, fp, group and _text. A link is a pair of one group that differs in ``bits`` or fewer places and whose
    sets of shingles share ``least`` or more of their union. Groups are compared in cells, which emit forests, never pairs; one of
    over SHINGLES shingles or MEMBERS rows is dealt to a triangle of cells, so that no task holds an unbounded group.
    """
    names = [f"w{k}" for k in range(words)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                sets = [np.unique(shingle_hashes(x, width)).view(np.int64) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.list_(pa.int64()))], names=["node", "group", *names, "shingles"])
        tidy()

    slim = members.select("node", "group", *[F.col("fp")[k].alias(c) for k, c in enumerate(names)], F.col("_text").cast("binary").alias("_data"))
    sets = stored(slim.mapInArrow(hashed, ", ".join(f"`{c}` bigint" for c in ("node", "group", *names)) + ", shingles array<bigint>"), "shingles")
    sizes = sets.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("total"))
    side = F.least("n", F.greatest(F.ceil(F.col("total") / SHINGLES), F.ceil(F.col("n") / MEMBERS))).cast("int")
    # written, so that the planner knows how small it is
    hot = stored(sizes.select(F.col("group").alias("hot"), side.alias("side")).where("side > 1"), "hot")
    dealt = sets.join(hot, sets.group == hot.hot, "left").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("side", F.lit(1))).cast("int"))
    own = F.col("own")
    line = lambda k: F.when(own == k, 2).when(own < k, 0).otherwise(1)
    cells = F.transform(F.sequence(F.lit(0), F.coalesce("side", F.lit(1)) - 1), lambda k: F.struct(F.xxhash64("group", F.least(own, k), F.greatest(own, k)).alias("cell"), line(k).alias("line")))
    spread = dealt.select("node", *names, "shingles", F.inline(cells))

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, node, place = (rows[c].to_numpy() for c in ("cell", "node", "line"))
        fp = np.stack([rows[c].to_numpy().view(np.uint64) for c in names], axis=1)
        lists = rows["shingles"].combine_chunks()
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        values, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(count)])
        bounds = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        for low, high in zip(bounds, bounds[1:], strict=False):
            if high - low > 1:
                a, b = verified(node[low:high], place[low:high], fp[low:high], count[low:high], values[ends[low] : ends[high]], bits, least)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            cell = now["cell"].to_numpy()
            last = int(np.searchsorted(cell, cell[-1], "left"))
            if last:
                yield from of(now.slice(0, last))
            held = now.slice(last)
        if held is not None:
            yield from of(held)
        held = now = None
        tidy()

    return stored(spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a bigint, b bigint"), "similar")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, words: int = WORDS, blocks: int = BLOCKS, bits: int = BITS, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row of least key stays, once if it is repeated.

    Links are pairs whose sets of shingles share ``least`` or more, computed from the sets. Fingerprints of ``words``
    words only bring the candidates: pairs of up to ``bits`` places that leave some block with a step at most join groups, and
    each group is verified within. Texts without words are equal and one of them stays.
    """
    rows = identified(docs)
    marked = stored(fingerprints(rows.select(*ROW, F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", [*ROW, "_key"], width, words, sets=True), "marked")
    nodes = cut(marked.groupBy("fp", "same").agg(F.min("_key").alias("least"), F.min(F.struct(*ROW)).alias("_row")).withColumn("node", F.xxhash64("fp", "same")))
    near = components(fingerprint_links(nodes, bits, blocks)).withColumnRenamed("root", "group")
    asked = nodes.join(near, "node").select("node", "fp", "group", *[F.col(f"_row.{c}").alias(c) for c in ROW])
    links = similar(once(rows.select(*ROW, F.col(text).alias("_text")).join(asked, ROW)), width, words, bits, least)
    rooted = cut(nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))
    known = cut(spread_join(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), ["root"]).select("fp", "same", "root", "component_id"))
    # of the rows with a component's least key, one text and one row stay
    lowest = spread_join(marked, known, ["fp", "same"]).where(F.col("_key").eqNullSafe(F.col("component_id")))
    stays = lowest.groupBy("root").agg(F.min(F.struct("fp", *ROW)).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in ROW])
    return once(rows.join(stays, ROW)).select(*docs.columns)
