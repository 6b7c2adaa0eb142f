"""Links between near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A fingerprint of 64 bits can't tell such pairs at a selective distance: at a similarity of 0.8 two of them differ in
about ten bits. So a text also has ``BANDS`` keys of ``ROWS`` minimal hashes each, which two texts of similarity s
share with probability 1 - (1 - s ** ROWS) ** BANDS (0.99 at 0.8), and a sketch, the ``KEPT`` least shingle hashes.
Texts that share a key are compared by their sketches: exactly if both have under ``KEPT`` shingles, else with a
standard error of 0.025. Inside a bucket each text is compared with the leaders so far and leads itself if it is like
none of them; that makes classes. Two texts of different classes may be alike too, though each is like another leader: only texts
that share four fifths of their sketch values with other classes can be, and those are compared with each other until their classes are one.
So links tie all texts of a bucket that alike ones tie, if not by every pair. Which texts a text may be like is told by an
index of sketch values: only those that share four fifths of its own are compared, so unlike texts cost no comparison.

A bucket of more than ``LIMIT`` texts is cut into parts of half as many, and each pair of its parts is a group of its own: every two
texts of a key meet in some group, and no task holds more than ``LIMIT`` of them.

Cases: a text of fewer than five words is one shingle; one without words has no links here; equal texts count once;
an empty table gives no rows.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import mix64, spread
from echoline.llm.decontaminate import gram_hashes, word_hashes
from echoline.operators.grouped import runs_of
from echoline.session import stored

WORDS, ROWS, BANDS, KEPT, ALIKE, LIMIT = 5, 5, 12, 256, 0.8, 4096
TURNS = mix64(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts, and how many each text has."""
    words, counts = word_hashes(data, offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = gram_hashes(words, WORDS)
    whole = whole[doc[: len(whole)] == doc[WORDS - 1 :]] if len(whole) else whole
    per = np.maximum(counts - WORDS + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        first = np.cumsum(counts) - counts
        alone = np.array([gram_hashes(words[first[i] : first[i] + counts[i]], int(counts[i]))[0] for i in short], np.uint64)
        whole = np.insert(whole, (np.cumsum(per) - per)[short], alone)
        per[short] = 1
    return whole, per


def sketched(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Band keys and sketch of each text; texts without words have neither."""
    h, per = shingles(data, offsets)
    some, first = np.flatnonzero(per), np.cumsum(per) - per
    keys = np.zeros((len(some), BANDS), np.uint64)
    if len(some):
        for band in range(BANDS):
            for r in range(ROWS):
                keys[:, band] = mix64(keys[:, band] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * TURNS[band * ROWS + r], first[some]) + np.uint64(band))
    high = (h >> np.uint64(32)).astype(np.uint32)
    sketch: list = [None] * len(per)
    for i in some.tolist():
        sketch[i] = np.unique(high[first[i] : first[i] + per[i]])[:KEPT].tobytes()
    ends = pa.array(np.r_[0, np.cumsum(per > 0)] * BANDS, pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64))), pa.array(sketch, pa.binary())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity by two sketches."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    twice = both[1:] == both[:-1]
    union = len(both) - int(twice.sum())
    if union <= KEPT or max(len(a), len(b)) < KEPT:
        return int(twice.sum()) / union
    last = both[np.flatnonzero(np.r_[True, ~twice])[KEPT - 1]]
    return int((both[:-1][twice] <= last).sum()) / KEPT


class Leaders:
    """Texts of a bucket, such as its leaders, with their sketches, and for each sketch value the texts that have it."""

    def __init__(self):
        self.names: list[int] = []
        self.sketches: list[np.ndarray] = []
        self.having: dict[int, array] = {}

    def like(self, own: np.ndarray, wanted=None) -> list[int]:
        """Names of the leaders that a sketch is like, of those that are ``wanted`` if that is given."""
        lists = [np.frombuffer(x, np.int32) for x in map(self.having.get, own.tolist()) if x is not None]
        if not lists:
            return []
        shared = np.bincount(np.concatenate(lists))
        del lists  # an array can't grow while it is looked at
        near = np.flatnonzero(shared >= ALIKE * len(own))
        return [self.names[i] for i in near.tolist() if (wanted is None or wanted(self.names[i])) and similarity(own, self.sketches[i]) >= ALIKE]

    def add(self, name: int, own: np.ndarray) -> None:
        for v in own.tolist():
            self.having.setdefault(v, array("i")).append(len(self.names))
        self.names.append(name)
        self.sketches.append(own)


def across(sketches: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    """Places of texts that share enough sketch values with other classes than their own to be like a text there."""
    flat, sizes = np.concatenate(sketches), np.array([len(x) for x in sketches])
    both = np.unique(np.stack([flat.astype(np.int64), np.repeat(classes, sizes)]), axis=1)[0]
    shared = np.unique(both[1:][both[1:] == both[:-1]])
    found = np.isin(flat, shared.astype(np.uint32))
    return np.flatnonzero(np.add.reduceat(found, np.cumsum(sizes) - sizes) >= ALIKE * sizes)


def linked(sketches: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links by place that tie all texts which alike pairs tie: with leaders, then between their classes."""
    up = list(range(len(sketches)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    leaders, links = Leaders(), []

    def tie(i: int, j: int) -> None:
        links.append((i, j))
        up[max(root(i), root(j))] = min(root(i), root(j))

    for i, own in enumerate(sketches):
        met = leaders.like(own)
        for j in met:
            tie(i, j)
        if not met:
            leaders.add(i, own)
    classes = np.array([root(i) for i in range(len(sketches))])
    # Classes of one text each are those of leaders, which have all met.
    if 1 < len(np.unique(classes)) < len(classes):
        texts = Leaders()
        for i in across(sketches, classes).tolist():
            for j in texts.like(sketches[i], lambda j, i=i: root(i) != root(j)):
                if root(i) != root(j):
                    tie(i, j)
            texts.add(i, sketches[i])
    return links


def _groups(batches):
    """Links (a, b) of the groups in rows (key, i, j, fp, sketch) that are sorted by group."""
    for g in runs_of(batches, ["key", "i", "j"]):
        names = g.column("fp").to_pylist()
        links = [(names[i], names[j]) for i, j in linked([np.frombuffer(x, np.uint32) for x in g.column("sketch").to_pylist()]) if names[i] != names[j]]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])


def near_links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between fingerprints of near copies, from rows (th, fp, keys, sketch)."""
    texts = stored(prints.filter("sketch is not null").groupBy("th").agg(F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys")), "near-texts")
    keyed = texts.select("th", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = counts.withColumn("parts", F.when(F.col("n") > limit, F.ceil(F.col("n") / max(1, limit // 2))).otherwise(1).cast("int"))
    met = stored(spread(keyed, stored(sizes, "near-sizes"), "key", "n", "th"), "near-met")
    dealt = met.join(texts, "th").withColumn("mine", F.pmod(F.xxhash64("th"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "sketch")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(_groups, "a long, b long").distinct()
