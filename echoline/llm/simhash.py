"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits in ``M`` = 8 segments on a ring. If two differ in at most ``tau`` bits, then from some
segment on, every chain of l segments has at most floor(l * tau / M) differences (the strong pigeonring
principle). With tau = 2 the first three segments of that chain are equal: they are the key of a bucket. Inside
a bucket the chain budgets prune pairs before the full Hamming check.

A bucket of more than ``LIMIT`` fingerprints is dealt anew: of the chain's next four segments at most one may
differ, so each fingerprint goes to four buckets that fix the other three; 48 fixed bits leave at most 65,536
different fingerprints. A bucket gives the edges of a spanning forest of its links, never all its pairs, and
components come from iterated star contraction over tables in the shared folder.

Cases: null and empty texts, and texts without words, have fingerprint 0 and link like any other; texts of
fewer than three words have one shingle; equal texts are one class; repeated rows are reported each; a null
doc_id never names a component that has another id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.llm.common import STEP, blocks, row_hash, rows_of, spread, text_bytes
from echoline.llm.nearcopies import near_links, sketched
from echoline.session import stored

M, WIDTH, TAU, LIMIT = 8, 8, 2, 8192
FULL = (1 << 64) - 1

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


def simhashes(data: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprint of each text: per bit, whether over half of its shingles' XXH64 have it set."""
    n = len(offsets) - 1
    folded = FOLD[data]
    gap = folded == 32
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = ~gap
    start[1:] &= gap[:-1] | first[1:-1]
    # A word and the one separator after it stay; texts without a separator at their end get none.
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1] & ~first[1:-1]
    place = np.cumsum(keep) - keep
    s = np.flatnonzero(start)
    end = ~gap
    end[:-1] &= gap[1:] | first[1:-1]
    e = place[np.flatnonzero(end)] + 1
    counts = np.searchsorted(s, offsets[1:]) - np.searchsorted(s, offsets[:-1])
    s, text, digest = place[s], folded[keep].tobytes(), xxhash.xxh64_intdigest
    doc = np.repeat(np.arange(n), counts)
    size = np.minimum(counts, shingle)[doc]
    last = np.arange(len(s)) + size - 1
    ok = last < len(s)
    ok[ok] &= doc[last[ok]] == doc[np.flatnonzero(ok)]
    a, b = s[ok], e[last[ok]]
    h = np.fromiter((digest(text[i:j], seed) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    per = np.bincount(doc[ok], minlength=n)
    out = np.zeros(n, np.uint64)
    some = np.flatnonzero(per)
    if len(some):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, (np.cumsum(per) - per)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > per[some][:, None], axis=1).view(">u8").ravel()
    return out


PRINTS = "doc_id long, th long, fp long"


def fingerprint(docs: DataFrame, shingle: int = 3, seed: int = 42, near: bool = False) -> DataFrame:
    """(doc_id, th, fp) of each row; a map over Arrow batches. ``th`` hashes the text, to find the row again; ``near`` adds keys and sketches."""

    def run(batches):
        for b in batches:
            ids, th, (data, offsets) = b.column("doc_id"), b.column("th"), text_bytes(b.column("text"))
            for i, j in blocks(offsets, STEP):
                part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                out = [ids.slice(i, j - i), th.slice(i, j - i), pa.array(simhashes(*part, shingle, seed).view(np.int64))]
                names = ["doc_id", "th", "fp"]
                if near:
                    out += sketched(*part)
                    names += ["keys", "sketch"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = PRINTS + ", keys array<long>, sketch binary" if near else PRINTS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def budgets(m: int = M, tau: int = TAU) -> list[tuple[int, int]]:
    """(chain length, differences allowed) where the allowance is about to rise, and for the whole ring."""
    return [(n, n * tau // m) for n in range(1, m + 1) if n == m or (n + 1) * tau // m > n * tau // m]


def ring_links(group: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside a bucket of distinct fingerprints with chains from segment ``start``."""
    turn, limits, n = start * WIDTH, budgets(), len(group)
    if n <= 24:
        left, links = [int(x) for x in group], []
        while left:
            front = [left.pop()]
            while front and left:
                u, rest = front.pop(), []
                for v in left:
                    x = u ^ v
                    r = ((x << turn) | (x >> (64 - turn))) & FULL
                    if all((r >> (64 - c * WIDTH)).bit_count() <= b for c, b in limits):
                        links.append((u, v))
                        front.append(v)
                    else:
                        rest.append(v)
                left = rest
        return links
    left, links = group.copy(), []
    while len(left):
        front, left = [left[-1]], left[:-1]
        while front and len(left):
            u = front.pop()
            x = left ^ u
            r = (x << np.uint64(turn)) | (x >> np.uint64(64 - turn)) if turn else x
            near = np.ones(len(left), bool)
            for c, b in limits:
                near &= np.bitwise_count(r >> np.uint64(64 - c * WIDTH)) <= b
            if near.any():
                links += [(int(u), int(v)) for v in left[near]]
                front += list(left[near])
                left = left[~near]
    return links


def _rotated(fp: Column, start: int) -> Column:
    n = start * WIDTH
    return F.shiftleft(fp, n).bitwiseOR(F.shiftrightunsigned(fp, 64 - n)) if n else fp


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` whose components are those of all pairs within TAU bits."""
    top = F.lit(_signed(0xFFFFFF0000000000))
    first = F.array(*[_rotated(F.col("fp"), i).bitwiseAND(top).bitwiseOR(F.lit(i)) for i in range(M)])
    keyed = fps.select("fp", F.explode(first).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(sizes, "key")
    start = F.col("key").bitwiseAND(F.lit(7))
    rotated = F.element_at(F.array(*[_rotated(F.col("fp"), i) for i in range(M)]), (start + 1).cast("int"))
    masks = [_signed(FULL & ~0xFF & ~(0xFF << (32 - 8 * j))) for j in range(4)]
    deeper = F.array(*[rotated.bitwiseAND(F.lit(x)).bitwiseOR(start).bitwiseOR(F.lit(32 + 8 * j)) for j, x in enumerate(masks)])
    keys = F.when(F.col("n") <= limit, F.array("key")).otherwise(deeper)
    dealt = shared.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def groups(key, fp, edges):
            a, b = [], []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if j - i > 1:
                    for u, v in ring_links(fp[i:j], int(key[i]) & 7):
                        a.append(u), b.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(1, np.int64)
            yield groups(key, fp, edges)  # all but the last bucket, which may go on
            key, fp = key[edges[-1] :], fp[edges[-1] :]
        yield groups(key, fp, np.array([0, len(key)]))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component, for all nodes that have edges.

    Alternates large stars (neighbours above a node go to its least neighbour) and small stars (a node and its
    neighbours below go to the least) until nothing moves; each round is a table in the shared folder.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "edges")
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    mark = state(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).withColumn("m", F.least("hi", "m"))
        large = both.join(least, "hi").filter("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi")
        small = moved.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        now = stored(small, "edges")
        before, mark = mark, state(now)
        if before == mark:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def classes(docs: DataFrame, limit: int = LIMIT, near: bool = False) -> DataFrame:
    """One row per document: doc_id, th, fp, root (fingerprint that names the class) and the class's least doc_id.

    ``near`` also links near copies that are further apart than fingerprints tell.
    """
    prints = stored(fingerprint(docs, near=near), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    edges = link(distinct.select("fp"), limit)
    if near:
        edges = edges.unionByName(near_links(prints))
    roots = components(edges)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    lookup = stored(named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "n", "root", "component_id"), "simhash-classes")
    return spread(prints.select("doc_id", "th", "fp"), lookup, "fp", "n", "doc_id")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and the least doc_id that links reach."""
    return classes(docs, limit).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, limit: int = LIMIT, near: bool = False) -> DataFrame:
    """``docs`` with one row of each class, that of the least doc_id, every column untouched; of rows with its id and text, that of the least hash of all columns.

    With ``near``, texts that five-word shingles link at a similarity of 0.8 or more are of one class too, wherever their fingerprints
    lie; which links are found is said in ``nearcopies``.
    """
    first = classes(docs, limit, near).groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("f")).select("f.doc_id", "f.th")
    met = rows_of(docs, first, "left_semi").withColumn("__row", row_hash(docs))
    k = F.row_number().over(Window.partitionBy("doc_id", "__th").orderBy("__row"))
    return met.withColumn("__k", k).filter("__k = 1").drop("__th", "__row", "__k")
