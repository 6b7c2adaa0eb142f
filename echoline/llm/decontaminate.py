"""Benchmark decontamination by winnowing.

Words are hashed, k-grams of words are hashed, and of every ``span - k + 1`` consecutive k-grams the least hash
is kept, for documents and items alike: two texts that share ``span`` words share a kept k-gram. Documents'
and items' fingerprints are joined, and each joined pair is extended word by word in both directions; a run of
``span`` or more equal words is a hit. Items shorter than ``span`` words are looked for whole.

Words compare by 64-bit hashes, ten of which agree in a hit. Cases: a null text has no words; an item without
words never occurs; equal items share one fingerprint entry and are all reported; repeated documents are
reported each; ties between equal hashes keep the last one on both sides; an empty table gives no rows, an
empty benchmark leaves all documents clean; other columns are ignored.

The tasks drop hashes that no item has by a Bloom filter of the items' hashes, which Spark builds block by block. It has ``BITS`` bits
for each hash up to ``MOST_BITS`` in all; with more hashes than that it lets more through, and the join decides all the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import STEP, blocks, mix64, rows_of, text_bytes
from echoline.session import stored

#: Bits of the filter for each hash, least and most bits in all (64 MB), bits of a block of it, and places that a hash sets.
BITS, LEAST_BITS, MOST_BITS, FILTER_BLOCK, PLACES = 16, 1 << 16, 1 << 29, 1 << 16, 3
R = np.uint64(0x9E3779B97F4A7C15 | 1)
R_INV = np.uint64(pow(int(R), -1, 1 << 64))

#: Lower-cases A-Z and turns bytes outside words into 0: words are digits, letters and all bytes from 0x80.
FOLD = np.zeros(256, np.uint8)
FOLD[48:58], FOLD[97:123], FOLD[65:91], FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of R and of its inverse, modulo 2**64."""
    up, down = np.full(n, R, np.uint64), np.full(n, R_INV, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' folded bytes, and where each word starts and ends."""
    folded = FOLD[data]
    on = folded != 0
    start = on.copy()
    start[1:] &= ~on[:-1]
    end = on.copy()
    end[:-1] &= ~on[1:]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    start[inner] |= on[inner]  # a text's first word doesn't go on from the text before
    before = inner[inner > 0] - 1
    end[before] |= on[before]
    return folded, np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and how many words each text has. ``known``: powers to reuse."""
    return hashed(*word_spans(data, offsets), offsets, known)


def hashed(folded: np.ndarray, s: np.ndarray, e: np.ndarray, offsets: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of the words from ``s`` to ``e``."""
    power, back = known if known is not None and len(known[0]) > len(folded) else powers(len(folded) + 1)
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum(folded * power[: len(folded)], out=sums[1:])
    h = mix64((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
    counts = np.searchsorted(s, offsets[1:]) - np.searchsorted(s, offsets[:-1])
    return h, counts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total = total * R + words[j : j + m]
    return mix64(total + np.uint64(n))


def winnow(words: np.ndarray, doc: np.ndarray, span: int, k: int) -> np.ndarray:
    """Places of the kept k-grams: the last least hash of each window that lies in one text."""
    grams, w = gram_hashes(words, k), span - k + 1
    m = len(words) - span + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:m].copy(), np.arange(m)
    for j in range(1, w):
        less = grams[j : j + m] <= best
        best[less] = grams[j : j + m][less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at[doc[:m] == doc[span - 1 :]])


def _contexts(words: np.ndarray, doc: np.ndarray, at: np.ndarray, before: int, length: int) -> np.ndarray:
    """Word hashes around each place, as a row of ``length``; places outside the text are 0."""
    i = at[:, None] + np.arange(-before, length - before)[None, :]
    ok = (i >= 0) & (i < len(words))
    j = np.where(ok, i, 0)
    return np.where(ok & (doc[j] == doc[at][:, None]), words[j], np.uint64(0))


def filter_places(g: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of hashes in a filter of ``bits`` bits, a power of two."""
    for _ in range(PLACES):
        yield (g & np.uint64(bits - 1)).astype(np.int64)
        g = mix64(g)


def may_hold(held: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which hashes the filter (its bits as bytes) may hold; none that it holds is missed."""
    ok = np.ones(len(g), bool)
    for at in filter_places(g, 8 * len(held)):
        ok &= (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def hash_filter(hashes: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """A filter of the column ``gram``, as bytes: tasks find the places, others set them block by block; the blocks come to the driver."""
    n = hashes.count()
    bits = min(most, max(LEAST_BITS, 1 << (BITS * max(1, n) - 1).bit_length()))

    def find(batches):
        for b in batches:
            g = b.column("gram").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(list(filter_places(g, bits))))
            yield pa.RecordBatch.from_arrays([pa.array(at // FILTER_BLOCK), pa.array((at % FILTER_BLOCK).astype(np.int32))], ["block", "at"])

    def put(batches):
        now, held = None, np.zeros(0, np.uint8)
        told = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])
        for b in batches:
            block, at = b.column("block").to_numpy(), b.column("at").to_numpy()
            for i in np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() if len(block) else []:
                if block[i] != now:
                    if now is not None:
                        yield told()
                    now, held = int(block[i]), np.zeros(FILTER_BLOCK, np.uint8)
                held[at[i : int(np.searchsorted(block, block[i], "right"))]] = 1
        if now is not None:
            yield told()

    places = hashes.select("gram").mapInArrow(find, "block long, at int")
    blocks_of = places.repartition("block").sortWithinPartitions("block").mapInArrow(put, "block long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks_of.toLocalIterator():
        out[r["block"] * (FILTER_BLOCK // 8) : (r["block"] + 1) * (FILTER_BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def fingerprints(span: int, k: int, lengths: list[int], held: np.ndarray):
    """Arrow function: (rid, text) to (rid, n_words, hits); a hit is (gram hash, place, length, context).

    ``lengths``: whole texts of so many words (under ``span``) are looked for too, by all their n-grams.
    ``held``: the items' filter; hashes that it doesn't hold are not emitted.
    """
    hit = pa.struct([("gram", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("around", pa.list_(pa.int64()))])
    reach = span - k

    def run(batches):
        known = powers(STEP + 1)
        for b in batches:
            rid, (data, offsets) = b.column("rid").to_numpy(zero_copy_only=False), text_bytes(b.column("text"))
            for i, j in blocks(offsets, STEP):
                words, counts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], known)
                doc = np.repeat(np.arange(j - i), counts)
                first = np.cumsum(counts) - counts
                at = winnow(words, doc, span, k)
                g = gram_hashes(words, k)[at]
                ok = may_hold(held, g)
                places, grams, sizes, around = [at[ok]], [g[ok]], [np.full(int(ok.sum()), k)], [_contexts(words, doc, at[ok], reach, k + 2 * reach)]
                for n in lengths:
                    g = gram_hashes(words, n)
                    ok = may_hold(held, g) & (doc[: len(g)] == doc[n - 1 : n - 1 + len(g)])
                    at = np.flatnonzero(ok)
                    places.append(at), grams.append(g[at]), sizes.append(np.full(len(at), n)), around.append(np.zeros((len(at), k + 2 * reach), np.uint64))
                at, g, n, ctx = np.concatenate(places), np.concatenate(grams), np.concatenate(sizes), np.concatenate(around)
                order = np.argsort(at, kind="stable")
                at, g, n, ctx = at[order], g[order], n[order], ctx[order]
                owner = doc[at]
                ends = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * ctx.shape[1]), pa.array(ctx.ravel().view(np.int64)))
                hits = pa.StructArray.from_arrays([pa.array(g.view(np.int64)), pa.array((at - first[owner]).astype(np.int32)), pa.array(n.astype(np.int32)), lists], fields=list(hit))
                yield pa.RecordBatch.from_arrays([pa.array(rid[i:j]), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), hits)], ["rid", "n_words", "hits"])

    return run


HITS = "rid long, n_words long, hits array<struct<gram: bigint, pos: int, n: int, around: array<bigint>>>"


def item_index(benchmark: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprints of the distinct item texts by ``cls``, items of each ``cls``)."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("cls"))
    texts = items.groupBy("cls", "text").agg(F.lit(1)).select(F.col("cls").alias("rid"), "text")

    def run(batches):
        for b in batches:
            rid, (data, offsets) = b.column("rid").to_numpy(zero_copy_only=False), text_bytes(b.column("text"))
            words, counts = word_hashes(data, offsets)
            cls, gram, n, around = [], [], [], []
            for r, end, c in zip(rid, np.cumsum(counts), counts, strict=True):
                own, doc = words[end - c : end], np.zeros(c, np.int64)
                at = winnow(own, doc, span, k) if c >= span else np.zeros(min(c, 1), np.int64)
                size = k if c >= span else int(c)
                around += _contexts(own, doc, at, span - k, 2 * span - k).view(np.int64).tolist() if c >= span else [[]] * len(at)
                gram += gram_hashes(own, size)[at].view(np.int64).tolist()
                cls += [r] * len(at)
                n += [size if c < span else 0] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(gram, pa.int64()), pa.array(n, pa.int32()), pa.array(around, pa.list_(pa.int64()))], ["cls", "gram", "whole", "ctx"])

    prints = texts.mapInArrow(run, "cls long, gram long, whole int, ctx array<bigint>")
    return prints, items.select("item_id", "cls")


def hits_of(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """One row per document: doc_id, th (hash of the text), n_words, n_hit, items (sorted ids as strings).

    Hits of a document are bounded by its own length; items are gathered as classes of equal texts.
    """
    prints, items = item_index(benchmark, span, k)
    prints = stored(prints.distinct(), "decon-items")
    lengths = [r[0] for r in prints.filter("whole > 0").select("whole").distinct().orderBy("whole").collect()]
    held = hash_filter(prints.select("gram").distinct())
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("rid"), "text")
    schema = "doc_id long, th long, " + HITS
    find = fingerprints(span, k, lengths, held)

    def with_id(batches):
        for b in batches:
            ids, th, at = b.column("doc_id"), b.column("th"), 0
            for out in find(iter([b])):
                yield pa.RecordBatch.from_arrays([ids.slice(at, out.num_rows), th.slice(at, out.num_rows), *out.columns], ["doc_id", "th", *out.schema.names])
                at += out.num_rows

    found = stored(rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(with_id, schema), "decon-docs")

    hits = found.select("rid", F.inline("hits")).join(prints, "gram").filter("(whole = 0 and n = %d) or whole = n" % k)
    same = F.zip_with("around", "ctx", lambda a, b: (a == b) & (a != 0))
    # Equal words next to the k-gram on each side: up to the first that differs.
    run = lambda part: F.when(F.array_position(part, F.lit(False)) == 0, F.size(part)).otherwise(F.array_position(part, F.lit(False)) - 1)
    reach = span - k
    left, right = run(F.reverse(F.slice(same, 1, reach))), run(F.slice(same, span + 1, reach))
    hits = hits.withColumn("center", F.forall(F.slice(same, reach + 1, k), lambda x: x)).withColumns({"left": F.when(F.col("whole") > 0, 0).otherwise(left), "right": F.when(F.col("whole") > 0, 0).otherwise(right)})
    hits = hits.filter((F.col("whole") > 0) | (F.col("center") & (F.col("left") + F.col("right") + k >= span)))
    hits = hits.select("rid", "cls", F.col("pos") - F.col("left"), F.col("pos") + F.col("n") + F.col("right")).toDF("rid", "cls", "from", "to")
    words = hits.groupBy("rid", "from", "to").agg(F.lit(1)).groupBy("rid").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    words = words.select("rid", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["from"], s["to"] - 1))))).cast("long").alias("n_hit"))
    of_items = (
        hits.select("rid", "cls").distinct().join(items, "cls").select("rid", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    out = found.select("doc_id", "th", "rid", "n_words").join(words, "rid", "left").join(of_items, "rid", "left")
    return out.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """One row per document: word and hit counts, the items that occur in it and whether it is contaminated."""
    return hits_of(docs, benchmark, span, k).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """``docs`` without the documents that hold a window of an item, every column untouched."""
    bad = hits_of(docs, benchmark, span, k).filter("n_hit > 0").select("doc_id", "th")
    return rows_of(docs, bad, "left_anti").drop("__th")


DECON_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
h AS (SELECT dw.rid, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hw AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM h)) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hw.n_hit, 0)::BIGINT AS n_hit, coalesce(hi.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(hi.items, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.rid = hw.rid LEFT JOIN hi ON d.rid = hi.rid
"""
