"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes cuts the text where its leading bits are 0. Chunk sizes are normalised: up
to the normal size a cut needs two more zero bits than the size's own, beyond it two fewer. A fingerprint is
the set of chunk digests with their lengths, which does not shift with the text; containment is the share of
a fingerprint's length that another one holds.

Cases: a null text is an empty one, whose fingerprint is empty; an empty fingerprint is contained wholly (1.0)
in an empty one and not at all (0.0) in others; the next document goes by ascending doc_id, null last, repeated
ids by text; the only document follows itself; a text of fewer than four code points is its own edited text; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import mix64

LEAST, NORMAL, MOST, REACH = 16, 64, 256, 32
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
STRICT, LOOSE = np.uint32(1 << 24), np.uint32(1 << 28)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte over the last 32 bytes, by doubling the reach."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    return h


def cuts(data: bytes, known: list[int] | None = None) -> list[int]:
    """Ends of the chunks of ``data``; ``known`` gives ends that are already sure, in order."""
    ends = list(known or [])
    n, start = len(data), ends[-1] if ends else 0
    if start >= n:
        return ends
    base = max(0, start - REACH + 1)
    h = gear(np.frombuffer(data, np.uint8)[base:])
    loose = np.flatnonzero(h < LOOSE)
    strict = (loose[h[loose] < STRICT] + (base + 1)).tolist()
    loose = (loose + (base + 1)).tolist()
    while start < n:
        i = bisect_left(strict, start + LEAST)
        if i < len(strict) and strict[i] <= start + NORMAL:
            start = strict[i]
        else:
            i = bisect_left(loose, start + NORMAL + 1)
            start = loose[i] if i < len(loose) and loose[i] < start + MOST else min(start + MOST, n)
        ends.append(start)
    return ends


def chunk_set(data: bytes, ends: list[int]) -> dict[int, int]:
    """Digest to length of the distinct chunks."""
    digest, at, out = xxhash.xxh3_64_intdigest, 0, {}
    for end in ends:
        out[digest(data[at:end]) & 0xFFFFFFFFFFFF] = end - at
        at = end
    return out


def packed(chunks: dict[int, int]) -> str:
    """Fingerprint as text: per chunk, in order of digest, six bytes of digest and two of length, in base64."""
    order = sorted(chunks)
    digests, lengths = np.array(order, np.uint64), np.array([chunks[x] for x in order], np.uint64)
    return base64.b64encode(((digests << np.uint64(16)) | lengths).astype(">u8").tobytes()).decode()


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the length of ``a`` whose chunks ``b`` has too."""
    if not a:
        return 0.0 if b else 1.0
    return sum(n for x, n in a.items() if x in b) / sum(a.values())


COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _pairs(batches):
    """Arrow function over rows sorted by (part, ghost, doc_id): each document with the one after it."""
    names = [x.split(" ")[0] for x in COLUMNS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split(" ")[1]] for x in COLUMNS.split(", ")]
    last = part = None
    out: list[list] = [[] for _ in names]

    def told(doc_id, text, data, ends, chunks, next_text, next_chunks):
        n = len(text)
        cut = n // 4
        if cut:
            head = text[: n - cut].encode()
            edited = head + next_text[:cut].encode()
            # Ends inside the shared head were decided by bytes before them, and hold for the edited text too.
            edited_chunks = chunk_set(edited, cuts(edited, ends[: bisect_left(ends, len(head) + 1)]))
        else:
            edited, edited_chunks = data, chunks
        row = (doc_id, n, hashlib.sha256(edited).hexdigest(), packed(chunks), packed(edited_chunks), containment(chunks, edited_chunks), containment(chunks, next_chunks))
        for c, x in zip(out, row, strict=True):
            c.append(x)

    for b in batches:
        held = 0
        for doc_id, text, at, ghost in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part", "ghost")), strict=True):
            if at != part:
                last, part = None, at
            if ghost and last is None:
                continue
            text = text or ""
            data = text.encode()
            ends = cuts(data)
            chunks = chunk_set(data, ends)
            if last is not None:
                told(*last, text, chunks)
                held += len(data)
            last = None if ghost else (doc_id, text, data, ends, chunks)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                out, held = [[] for _ in names], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
            out = [[] for _ in names]


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document with its fingerprint, its edited text's, and how they and the next one's agree.

    Documents are dealt once, into ranges of doc_id that one task reads in order; the first document of each
    range also goes to the range before it, as the follower of its last. Only split points and first ids, one
    per range, come to the driver.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select("doc_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))).alias("x"))
    splits = ids.filter("doc_id is not null").agg(F.percentile_approx("x", [i / parts for i in range(1, parts)] or [0.5], max(10000, 10 * parts))).first()[0]
    deal = Bucketizer(splits=[-float("inf"), *sorted(set(splits or [0.0])), float("inf")], inputCol="x", outputCol="part", handleInvalid="keep")
    first = [(r["part"], r["doc_id"]) for r in deal.transform(ids).groupBy("part").agg(F.min("doc_id").alias("doc_id")).orderBy("part").collect()]
    followed = [(doc_id, first[i - 1][0]) for i, (_, doc_id) in enumerate(first)]
    heads = spark.createDataFrame(followed, "first_id long, before double")
    dealt = deal.transform(rows.withColumn("x", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))))
    dealt = dealt.join(F.broadcast(heads), dealt["doc_id"].eqNullSafe(heads["first_id"]), "left")  # one row per range
    seat = lambda part, ghost: F.struct(F.col(part).alias("part"), F.lit(ghost).alias("ghost"))
    seats = F.when(F.col("before").isNull(), F.array(seat("part", 0))).otherwise(F.array(seat("part", 0), seat("before", 1)))
    dealt = dealt.select("doc_id", "text", F.explode(seats).alias("s")).select("doc_id", "text", "s.part", "s.ghost")
    return dealt.repartition(parts, "part").sortWithinPartitions("part", "ghost", "doc_id", "text").mapInArrow(_pairs, COLUMNS)
