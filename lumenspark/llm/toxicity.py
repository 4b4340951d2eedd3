"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled documents (EXAMPLES of each class, those whose ids hash lowest, near copies once) is turned
into TF-IDF vectors over all words that any of them holds: none is left out. The document frequencies behind the weights
are counted over the whole corpus, and a word's weight is scaled by what it tells of the class among the examples (its
log-likelihood ratio), for plain TF-IDF finds the neighbours of a text's subject rather than of its tone. The postings are
kept by blocks of examples with each block's largest weight, so a query bounds the cosine that any example of a block can
reach, scores the most promising blocks and then only those whose bound exceeds the k-th best cosine: the neighbours are
exact. Their votes, weighted by cosine, are calibrated on the examples themselves, each left out in turn, at the class
shares of all labelled rows. The index is bounded by the words of 2 * EXAMPLES texts and is broadcast; every document is
scored whole, where it is read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspark.llm.common import bounded_batches, sliced, stored, tidy, unused

#: Labelled examples of each class; neighbours asked; examples of a block; the share of runs that makes a copy.
EXAMPLES = 2000
NEIGHBOURS = 15
BLOCK = 64
COPY = 0.8
#: Cells of the product of the commonest words, which only settles how much of the work is one product; queries of one.
DENSE = 1 << 20
QUERIES = 32

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter[str]:
    """Runs of letters, lower-cased. What stands between white space is looked into only if it isn't all letters."""
    found = Counter(text.lower().split()) if text else Counter()
    for piece in [p for p in found if not p.isalpha()]:
        n = found.pop(piece)
        for word in WORD.findall(piece):
            found[word] += n
    return found


def counted(words: Counter[str], vocabulary: dict[str, int]) -> dict[int, int]:
    """Counts of the vocabulary's words, by their numbers."""
    return {vocabulary[w]: n for w, n in words.items() if w in vocabulary}


def runs_of(text: str | None) -> np.ndarray:
    """The set of a text's runs of three words, as hashes; a shorter text is one run."""
    words = (text or "").lower().split()
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return np.unique(np.array([zlib.crc32(r.encode()) for r in runs], np.uint32))


def without_copies(examples: list[tuple]) -> set:
    """The keys of (key, class, runs) less near copies, which would outvote what they repeat.

    In the order of keys, an example is a copy if it shares COPY of its runs, or more, with one of its class that stays.
    Runs meet through postings, so nothing is compared that shares none.
    """
    kept: set = set()
    for toxic in sorted({r[1] for r in examples}):
        own = sorted((r for r in examples if r[1] == toxic), key=lambda r: (str(r[0]), r[0]))
        size = np.array([len(r[2]) for r in own], np.int64)
        run = np.unique(np.concatenate([r[2] for r in own]), return_inverse=True)[1]
        posting = np.repeat(np.arange(len(own)), size)[np.argsort(run, kind="stable")]
        end = np.cumsum(np.bincount(run))
        stays = np.zeros(len(own), bool)
        for i, at in enumerate((np.cumsum(size) - size).tolist()):
            mine = run[at : at + size[i]]
            shared = np.bincount(posting[ranges(np.where(mine > 0, end[mine - 1], 0), end[mine])[0]], minlength=len(own))
            stays[i] = not (stays & (shared >= COPY * (size + size[i] - shared) - 1e-9)).any()
        kept |= {own[i][0] for i in np.flatnonzero(stays).tolist()}
    return kept


def class_information(words: np.ndarray, toxic: np.ndarray, size: int, one: int, zero: int) -> np.ndarray:
    """For each of ``size`` words, twice its log-likelihood ratio between the classes; one place of ``words`` and its
    example's class for each word that an example holds, ``one`` and ``zero`` examples of the classes in all."""
    t = np.bincount(words, toxic, size)
    c = np.bincount(words, 1 - toxic, size)

    def term(n: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n * np.log(np.maximum(n, 1) / np.where(share > 0, share, 1)), 0.0)

    n, every = t + c, one + zero
    return 2 * np.maximum(0.0, term(t, n * one / every) + term(c, n * zero / every) + term(one - t, (every - n) * one / every) + term(zero - c, (every - n) * zero / every))


@dataclass(frozen=True)
class Index:
    """Postings by word and block. Weights of an example and a query are of unit length; ``idf``
    is what a word's count is weighed by."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    toxic: np.ndarray  # of each example
    keys: list  # of each example
    example: np.ndarray  # postings: by feature, then example
    weight: np.ndarray
    entry_from: np.ndarray  # of each feature's first block entry, and the end
    entry_block: np.ndarray
    entry_most: np.ndarray
    entry_first: np.ndarray  # of each entry's postings, and the end

    @classmethod
    def of(cls, vocabulary: dict[str, int], idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], keys: list) -> Index:
        """``vectors`` are the words of each example and their counts."""
        rows = [weighed(*v, idf) for v in vectors]
        # examples that share their weightiest feature stand together, so that a block's largest weights are tight
        order = sorted(range(len(rows)), key=lambda i: (int(rows[i][0][np.argmax(rows[i][1])]) if len(rows[i][0]) else -1, i))
        n = [len(rows[i][0]) for i in order]
        feature = np.concatenate([rows[i][0] for i in order] + [np.zeros(0, np.int64)])
        weight = np.concatenate([rows[i][1] for i in order] + [np.zeros(0)])
        example = np.repeat(np.arange(len(order)), n)
        sort = np.lexsort((example, feature))
        feature, weight, example = feature[sort], weight[sort], example[sort]
        entry = feature * (len(order) // BLOCK + 1) + example // BLOCK
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        return cls(
            vocabulary, idf, np.array([toxic[i] for i in order], np.int64), [keys[i] for i in order], example, weight,
            np.searchsorted(feature[first], np.arange(len(vocabulary) + 1)), example[first] // BLOCK, most, np.concatenate([first, [len(entry)]]),
        )

    def nearest(self, words: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return next(self.each_nearest([(words, weights)], k, [without]))

    def each_nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, the k examples of largest cosine above 0, ties by place, and the cosines. An example that is
        named in ``without`` is left out.

        What the commonest words give every example is one product for QUERIES queries; other words go through blocks, whose
        bounds are the best of that in the block and the block's largest weights of the rest.
        """
        column, dense = self._common()
        width = dense.shape[0] // BLOCK
        for first in range(0, len(queries), QUERIES):
            some = queries[first : first + QUERIES]
            asked = np.zeros((len(some), dense.shape[1]))
            for i, (words, weights) in enumerate(some):
                at = column[words]
                asked[i, at[at >= 0]] = weights[at >= 0]
            for i, ((words, weights), score) in enumerate(zip(some, asked @ dense.T, strict=True)):
                rare = column[words] < 0
                yield self._best(words[rare], weights[rare], score, width, k, -1 if without is None else without[first + i])

    def _common(self) -> tuple[np.ndarray, np.ndarray]:
        """The column of each of the commonest words, -1 for others, and their weights by example, DENSE of them; made once
        in a worker and left out of what is sent."""
        if "_made" not in self.__dict__:
            held = np.diff(self.entry_first[self.entry_from]) if len(self.vocabulary) else np.zeros(0, np.int64)
            rows = max(1, -(-len(self.toxic) // BLOCK)) * BLOCK
            words = np.argsort(-held, kind="stable")[: DENSE // rows]
            column = np.full(len(held), -1)
            column[words] = np.arange(len(words))
            dense = np.zeros((rows, len(words)))
            places, of = ranges(self.entry_first[self.entry_from[words]], self.entry_first[self.entry_from[words + 1]])
            dense[self.example[places], of] = self.weight[places]
            object.__setattr__(self, "_made", (column, dense))
        return self.__dict__["_made"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def _best(self, words: np.ndarray, weights: np.ndarray, score: np.ndarray, width: int, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """``score`` is what other words give."""
        if without >= 0:
            score[without] = -1.0
        entries, which = ranges(self.entry_from[words], self.entry_from[words + 1])
        blocks, own = self.entry_block[entries], weights[which]
        bound = np.bincount(blocks, own * self.entry_most[entries], width) + score.reshape(width, BLOCK).max(axis=1)
        order = np.argsort(-bound)
        least = float(np.partition(score, -k)[-k]) if len(score) >= k else 0.0
        at, wave = 0, max(2, -(-2 * k // BLOCK))
        while at < width:
            now = order[at : at + wave]
            now = now[bound[now] * (1 + 1e-9) >= least]  # in order of their bounds: the rest fails where the first fails
            if not len(now):
                break
            chosen = np.zeros(width, bool)
            chosen[now] = True
            some = np.flatnonzero(chosen[blocks])
            if len(some):
                places, of = ranges(self.entry_first[entries[some]], self.entry_first[entries[some] + 1])
                score += np.bincount(self.example[places], self.weight[places] * own[some][of], len(score))
                if without >= 0:
                    score[without] = -1.0
                least = float(np.partition(score, -k)[-k]) if len(score) >= k else 0.0
            at += wave
            wave = width
        found = np.flatnonzero(score >= max(least, 1e-12))  # what is less is rounding
        found = found[np.lexsort((found, -score[found]))][:k]
        return found, score[found]


def ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges in a row, and the range that each is of."""
    n = end - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[which], which


def unit(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return weighed(np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts)), idf)


def weighed(words: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in order and their weights, of length 1; those of no weight are left out."""
    weights = (1 + np.log(counts)) * idf[words]
    some = np.flatnonzero(weights > 0)
    some = some[np.argsort(words[some])]
    words, weights = words[some].astype(np.int64), weights[some]
    length = math.sqrt(float(weights @ weights))
    return (words, weights / length) if length else (words[:0], weights[:0])


def vote(index: Index, found: np.ndarray, cosines: np.ndarray) -> float | None:
    return float((cosines * index.toxic[found]).sum() / cosines.sum()) if len(found) else None


@dataclass(frozen=True)
class Model:
    index: Index
    slope: float
    offset: float
    alone: float  # the score of a text without neighbours

    def score(self, share: float | None) -> float:
        return self.alone if share is None else 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * share + self.offset))))


def calibrated(shares: list[float | None], toxic: list[int], weights: tuple[float, float]) -> tuple[float, float, float]:
    """Slope and offset of a logistic curve by Newton's steps with a small ridge, and the rate without neighbours."""
    some = [(s, y) for s, y in zip(shares, toxic, strict=True) if s is not None]
    slope, offset = 0.0, 0.0
    if some:
        x = np.array([[s, 1.0] for s, _ in some])
        y = np.array([y for _, y in some], float)
        w = np.where(y == 1, weights[1], weights[0])
        beta, ridge = np.zeros(2), np.diag([1e-3, 1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
            beta += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        slope, offset = map(float, beta)
    none = [y for s, y in zip(shares, toxic, strict=True) if s is None]
    ones, zeros = weights[1] * sum(none), weights[0] * (len(none) - sum(none))
    # few examples lean on the rate of all
    rate = weights[1] * sum(toxic) / max(1e-9, weights[1] * sum(toxic) + weights[0] * (len(toxic) - sum(toxic)))
    return slope, offset, (ones + rate) / (ones + zeros + 1)


def held_out(key: str):
    """Whether a row's label may not be learned from: crc32 of the id as text leaves 0 by 5; a null id does not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from the labels of rows that are not held out. Null labels don't count; of several the largest does.

    Without labelled examples, or with one class alone, no word tells anything and all scores are the class's rate.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_toxic"))
    known = known.where("_key is not null and _toxic in (0, 1)").where(~held_out("_key")).groupBy("_key").agg(F.max("_toxic").alias("_toxic"))
    known = stored(known.join(rows.select("_key").distinct(), "_key", "left_semi"), "labels")
    totals = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    picked = [r for c in (0, 1) for r in known.where(F.col("_toxic") == c).orderBy(F.xxhash64("_key", F.lit(7)), "_key").limit(EXAMPLES).collect()]
    ids = spark.createDataFrame([tuple(r) for r in picked], known.schema)  # 2 * EXAMPLES ids at most
    examples = rows.join(F.broadcast(ids), "_key").dropDuplicates(["_key"])

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                found = [words_of(t) for t in part.column(1).to_pylist()]
                runs = [runs_of(t).tobytes() for t in part.column(1).to_pylist()]
                words = ["\n".join(f).encode() for f in found]
                counts = [np.fromiter(f.values(), np.int32, len(f)).tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *[pa.array(x, pa.binary()) for x in (words, counts, runs)]], names=["_key", "_toxic", "words", "counts", "runs"])
        tidy()

    kind = rows.schema["_key"].dataType.simpleString()
    # words and counts as bytes, since lists of strings would be objects one by one in the driver's JVM
    looked = stored(examples.select("_key", "_text", "_toxic").mapInArrow(look, f"_key {kind}, _toxic int, words binary, counts binary, runs binary"), "examples")
    single = without_copies([(r["_key"], r["_toxic"], np.frombuffer(r["runs"], np.uint32)) for r in looked.select("_key", "_toxic", "runs").collect()])
    tidy()  # here too, since the driver's Python would keep what its allocators hold until the session ends
    chosen = {r["_key"]: r["_toxic"] for r in picked if r["_key"] in single}
    one, zero = max(1, sum(chosen.values())), max(1, len(chosen) - sum(chosen.values()))
    vocabulary: dict[str, int] = {}
    held: dict = {}
    for r in looked.select("_key", "words", "counts").toLocalIterator():  # the words of 2 * EXAMPLES texts, a file's at a time
        if r["_key"] in single:
            counts = np.frombuffer(r["counts"], np.int32).copy()
            words = r["words"].decode().split("\n") if len(counts) else []
            held[r["_key"]] = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32), counts
    order = sorted(vocabulary)  # the same numbers whatever the order of files
    number = np.zeros(len(order), np.int64)
    number[[vocabulary[w] for w in order]] = np.arange(len(order))
    vocabulary = {w: i for i, w in enumerate(order)}
    held = {k: (number[held[k][0]].astype(np.int32), held[k][1]) for k in sorted(held, key=lambda k: (str(k), k))}
    total, frequency = document_frequencies(rows, "_text", vocabulary)
    places = np.concatenate([w for w, _ in held.values()] or [np.zeros(0, np.int32)])
    classes = np.repeat(np.array([chosen[k] for k in held], np.int64), np.array([len(w) for w, _ in held.values()], np.int64))
    both = len(set(chosen.values())) == 2
    scale = class_information(places, classes, len(order), one, zero) if both else np.zeros(len(order))
    index = Index.of(vocabulary, (np.log((1 + total) / (1 + frequency)) + 1) * scale, list(held.values()), [chosen[k] for k in held], list(held))
    shares = left_out(spark, index, [held[k] for k in index.keys])
    slope, offset, alone = calibrated(shares, index.toxic.tolist(), (totals.get(0, 0) / zero, totals.get(1, 0) / one))
    del held, places, classes
    tidy()
    return Model(index, slope, offset, alone)


def left_out(spark: SparkSession, index: Index, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[float | None]:
    """The vote on each example of the others, which are as many as the sample's bound; in tasks, not on the driver."""
    sent = spark.sparkContext.broadcast((index, vectors))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vectors = sent.value
        for batch in batches:
            own = batch.column(0).to_pylist()
            votes = [vote(index, *near) for near in index.each_nearest([weighed(*vectors[i], index.idf) for i in own], NEIGHBOURS, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], names=["at", "share"])
        tidy()

    out: list[float | None] = [None] * len(vectors)
    for r in spark.range(len(vectors)).toDF("at").mapInArrow(run, "at bigint, share double").collect():
        out[r.at] = r.share
    sent.destroy()
    return out


def document_frequencies(rows: DataFrame, text: str, vocabulary: dict[str, int]) -> tuple[int, np.ndarray]:
    """The number of rows, and of those that hold each word, over the whole frame; summed in each task first."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)
    size = len(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, n = sent.value, np.zeros(size + 1, np.int64), 0
        for batch in batches:
            for part in sliced(batch):
                for t in part.column(0).to_pylist():
                    seen[[own[w] for w in words_of(t) if w in own]] += 1
                    n += 1
        seen[size] = n
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], names=["word", "n"])
        tidy()

    out = np.zeros(size + 1, np.int64)
    sums = rows.select(text).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out[sums.column("word").to_numpy()] = sums.column("n").to_numpy()
    sent.destroy()
    return int(out[size]), out[:size]


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", evidence: int = 3, names: tuple[str, str] = ("score", "evidence")) -> DataFrame:
    """The columns ``keep`` and, by the given names, the score and the evidence: the ids of the nearest examples, their
    cosines and labels. With ``evidence`` 0 there is no such column.

    A null or empty text, or one that shares no word that tells of the class with any example, has no neighbours and the
    rate of such examples. Nothing but the text is looked at; equal texts have equal scores.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    now = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(unused(docs, "text")))
    at = keep.index(text) if text in keep else len(keep)
    made = [*keep, names[0], *[names[1]] * (evidence > 0)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        index = model.index
        for batch in batches:
            for part in sliced(batch):
                scores, proof = [], []
                for found, cosines in index.each_nearest([unit(counted(words_of(t), index.vocabulary), index.idf) for t in part.column(at).to_pylist()], NEIGHBOURS):
                    scores.append(model.score(vote(index, found, cosines)))
                    if evidence:
                        proof.append([{"example": str(index.keys[i]), "cosine": c, "toxic": int(index.toxic[i])} for i, c in zip(found[:evidence].tolist(), cosines[:evidence].tolist(), strict=True)])
                kind = pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(scores, pa.float64()), *[pa.array(proof, kind)] * (evidence > 0)], names=made)
        tidy()

    schema = "".join(f"`{c}` {now.schema[c].dataType.simpleString()}, " for c in keep) + f"`{names[0]}` double" + f", `{names[1]}` array<struct<example:string,cosine:double,toxic:int>>" * (evidence > 0)
    return now.mapInArrow(run, schema)
