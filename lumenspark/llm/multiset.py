"""Order-independent fingerprints of documents, in DataFrame operations only.

A text is the multiset of its paragraphs' pieces: each line is a paragraph and is cut into pieces of eight words from
its start. (With whole paragraphs as elements a text of one paragraph would be unlike any edit of itself; a paragraph of
eight words or fewer is one piece.) A piece hashes to a wide vector of zeros and ones; a fingerprint is the sum of the
vectors of all pieces, each lane modulo a power of two, and the number of pieces. Sums commute, so equal multisets have
equal fingerprints in whatever order they come, and a piece is inserted or deleted by adding or subtracting its vector.
Read as sums of plus and minus ones, two fingerprints have the cosine of their multisets, within about one over the root
of the lanes. No text that a row can hold has enough pieces to wrap a lane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two 64-bit hashes give 63 lanes each; three lanes of 21 bits share a partial sum of up to CHUNK pieces.
SEEDS = (0, 1)
SPREAD = 21
MASK = (1 << SPREAD) - 1
ONES = 1 | 1 << SPREAD | 1 << 2 * SPREAD
CHUNK = 16
LANES = 63 * len(SEEDS)
#: Lanes are kept modulo 2**32, twice what the longest string could have as pieces.
MODULUS = 1 << 32
DIGITS = 8
#: Words of a piece; words are parted by ASCII white space, paragraphs by line ends.
PIECE = r"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+){0,7}"
#: Rows of a bucket of neighbours, about; the most bounds from a sketch, between which buckets are of even width; rows
#: of such a bucket; bits of the hash that deal out the rows without a key.
BUCKET = 512
BOUNDS = 1 << 14
WIDE = 4096
LOOSE = 10


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def summed(rows: DataFrame, keys: list[str], piece: str, chunk: str) -> DataFrame:
    """(keys, lanes, n): the sum over the rows of each key; a null piece adds nothing.

    Sums in the task first, three lanes to a number within each ``chunk`` of at most 2**CHUNK pieces, then a number a lane.
    """
    sums = []
    for seed in SEEDS:
        # hashed with a seed of its own; a null piece must not count as one
        rows = rows.withColumn(f"_h{seed}", F.when(F.col(piece).isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), piece)))
        sums += [F.sum(F.shiftrightunsigned(f"_h{seed}", k).bitwiseAND(F.lit(ONES))).alias(f"_s{seed}_{k}") for k in range(SPREAD)]
    made = rows.groupBy(*keys, chunk).agg(*sums, F.count(piece).alias("n"))
    bits = [(seed, part, k) for seed in SEEDS for part in range(3) for k in range(SPREAD)]
    lanes = [F.sum(F.shiftrightunsigned(f"_s{seed}_{k}", part * SPREAD).bitwiseAND(F.lit(MASK))).alias(f"_l{i}") for i, (seed, part, k) in enumerate(bits)]
    whole = made.groupBy(*keys).agg(*lanes, F.sum("n").alias("n"))
    return whole.select(*keys, F.array(*[F.col(f"_l{i}") % MODULUS for i in range(LANES)]).alias("lanes"), "n")


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the union of two multisets, or with sign -1 of the first without the second."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS)))


def written(lanes: Column, n: Column) -> Column:
    """Hex, eight digits a lane, after the number of pieces in sixteen."""
    return F.lower(F.concat(F.lpad(F.hex(n), 16, "0"), F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), DIGITS, "0")), "")))


def likeness(a: Column, n: Column, b: Column, m: Column) -> Column:
    """0 to 1, from two fingerprints alone: the cosine of their multisets, 1 if equal, 0 if one alone is empty."""

    def signed(x: Column, count: Column) -> Column:
        half = MODULUS // 2
        return (F.pmod(2 * x - count + half, F.lit(MODULUS)) - half).cast("double")

    def dot(x: Column, xn: Column, y: Column, yn: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: signed(p, xn) * signed(q, yn)), F.lit(0.0), lambda s, v: s + v)

    # lanes that cancel to nothing are like nothing but their equal
    cosine = F.try_divide(dot(a, n, b, m), F.sqrt(dot(a, n, a, n)) * F.sqrt(dot(b, m, b, m)))
    return F.when((n == m) & (a == b), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(cosine, F.lit(0.0)), F.lit(0.0)))))


def document_fingerprints(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, lanes, n) for each row of ``docs``, whose keys must tell rows apart; a null text has no pieces."""
    each = docs.select(*keys, F.posexplode_outer(pieces(F.col(text))).alias("_at", "_piece"))
    return summed(each.withColumn("_chunk", F.shiftright(F.coalesce("_at", F.lit(0)), CHUNK)), keys, "_piece", "_chunk")


def bucketed(docs: DataFrame, key: str, tie: str) -> DataFrame:
    """Adds ``_bucket``, which rises with the key: ranges of about BUCKET rows each; null keys go below, by ``tie``.

    Bounds come from a sketch of the whole column, no more than BOUNDS of them; each row finds its own by halving. A table
    of more rows has ranges of even width between two bounds, so buckets don't grow with it.
    """
    one = docs.agg(F.count(key).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    count = max(1, min(BOUNDS, one.n // BUCKET))
    fine = max(1, -(-one.n // (WIDE * count)))
    bounds = []
    if count > 1:
        fractions = [i / count for i in range(1, count)]
        bounds = sorted(set(docs.agg(F.percentile_approx(key, fractions, 8 * count)).first()[0] or []))
    loose = F.shiftright(F.col(tie), 64 - LOOSE) - (1 << (LOOSE - 1)) - 1
    if not bounds:
        return docs.withColumn("_bucket", F.when(F.col(key).isNull(), loose).otherwise(F.lit(0)).cast("bigint"))
    padded = bounds + [(1 << 63) - 1] * ((1 << len(bounds).bit_length()) - len(bounds))
    table = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.element_at(table, low + step) <= F.col(key), low + step).otherwise(low))
    found = F.least(found, F.lit(len(bounds))).cast("bigint")
    if fine > 1:
        docs = docs.withColumn("_found", found)
        found = F.col("_found")
        low = F.when(found == 0, F.lit(one.low)).otherwise(F.element_at(table, F.greatest(found, F.lit(1)).cast("int"))).cast("double")
        high = F.when(found == len(bounds), F.lit(one.high)).otherwise(F.element_at(table, F.least(found + 1, F.lit(len(bounds))).cast("int"))).cast("double")
        part = F.floor(F.coalesce(F.try_divide(F.col(key).cast("double") - low, high - low), F.lit(0.0)) * fine)
        found = found * fine + F.least(F.greatest(part, F.lit(0)), F.lit(fine - 1))
    return docs.withColumn("_bucket", F.when(F.col(key).isNull(), loose).otherwise(found).cast("bigint")).drop("_found")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and the next row's, in descending order of the key.

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of the next row's
    text; after the last row comes the first. Rows with equal keys follow each other by a hash of their texts, null
    keys come last, a null text is empty, and a lone row is its own next. No rows give no rows. Texts are dealt once,
    by range; the first row of each range is also put behind the range before it, so that every row's next is at hand.

    Returns the key, n_chars, edited_sha256, and lanes and n of the three: own, edited, next.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = bucketed(rows.withColumn("_tie", F.xxhash64("_text")), "_key", "_tie")
    heads = rows.groupBy("_bucket").agg(F.max_by("_text", F.struct("_key", "_tie")).alias("_text"))
    # a number for each bucket
    order = heads.select("_bucket").withColumn("_to", F.lag("_bucket").over(Window.orderBy(F.asc("_bucket"))))
    top = heads.agg(F.max("_bucket")).first()[0]
    before = order.withColumn("_to", F.coalesce("_to", F.lit(top))).select(F.col("_to").alias("_bucket"), F.col("_bucket").alias("_from"))
    # the next of bucket b is the head of the greatest bucket below b; after the lowest, of the highest
    follow = before.select(F.col("_from").alias("_into"), F.col("_bucket").alias("_head"))
    extra = heads.join(follow, heads._bucket == follow._head).select(F.lit(None).cast(rows.schema["_key"].dataType).alias("_key"), "_text", F.col("_into").alias("_bucket"), F.lit(0).cast("bigint").alias("_tie"), F.lit(True).alias("_extra"))
    every = rows.withColumn("_extra", F.lit(False)).unionByName(extra)
    line = Window.partitionBy("_bucket").orderBy(F.asc("_extra"), F.desc_nulls_last("_key"), F.desc("_tie"))
    placed = every.withColumn("_row", F.row_number().over(line)).withColumn("_next", F.lead("_text").over(line))
    n = F.length("_text")
    half = F.floor(n / F.lit(2)).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    placed = placed.withColumn("_edited", F.when(F.col("_extra"), F.lit(None)).otherwise(edited))
    keys = ["_bucket", "_row", "_extra", "_key", "n_chars", "edited_sha256", "_which"]
    both = placed.select("_bucket", "_row", "_extra", "_key", n.cast("bigint").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), F.posexplode(F.array("_text", "_edited")).alias("_which", "_content")).where("not _extra or _which = 0")
    found = document_fingerprints(both, keys, "_content")
    along = Window.partitionBy("_bucket").orderBy("_row", "_which")
    for name, step in (("edited", 1), ("next", 2)):
        found = found.withColumn(f"{name}_lanes", F.lead("lanes", step).over(along)).withColumn(f"{name}_n", F.lead("n", step).over(along))
    return found.where("_which = 0 and not _extra").select(F.col("_key").alias(key), "n_chars", "edited_sha256", "lanes", "n", "edited_lanes", "edited_n", "next_lanes", "next_n")
