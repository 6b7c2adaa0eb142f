"""Exact long repeats, by run-length indexes.

A byte goes if a string of ``span`` bytes over it also starts elsewhere. Every window of ``span`` bytes picks an
anchor, the leftmost least hash of its grams, so equal windows pick equal anchors; the windows of an anchor form
a segment of under 2 * span bytes, and each window lies in exactly one segment. Segments whose anchor occurs
once are unique and go no further; equal segments are gathered to one with their number. The distinct segments
of whole anchor groups make up a batch of bounded size, and each batch gets a ``RunIndex``: its Burrows-Wheeler
transform as runs of letters, with text places sampled at the runs' ends only. The segments are streamed against
the index from right to left: the row follows the runs, the neighbours' places follow with it and a match grows
by one, until a run ends; there a sample names the neighbour and the texts are compared. Matches of ``span`` or
more with another place mark repeats.

An anchor with more than ``LIMIT`` distinct segments is split, exactly: windows are dealt by their offset from the
anchor into ever narrower classes, whose common core is the new key, down to single windows, which are counted.
No group outgrows a task, and nothing is capped. Joins on an anchor or a segment deal hot keys over many tasks.

``shared_words`` tells of shorter passages too: winnowed grams of 26 words that also stand elsewhere. A passage of
50 words that repeats always has one; a repeat of under 26 words never has.

Cases: a null text is empty; texts shorter than ``span`` keep everything; a row that occurs twice repeats itself;
other rows with its doc_id are documents of their own; an empty table gives no rows; other columns are ignored.
Documents are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import STEP, blocks, mix64, spread, text_bytes
from echoline.llm.decontaminate import gram_hashes, powers, winnow, word_hashes
from echoline.session import stored

SPAN, GRAM, LIMIT, BATCH = 400, 16, 500, 1 << 19
WIDTHS = (64, 8, 1)
#: A number under one of these has as many leading bytes 0 as that one's place says, counted from 1.
FIRST_BYTES = np.array([1 << (64 - 8 * s) for s in range(1, 8)], np.uint64)
#: A repeated passage of so many words shows by a gram of so many.
PASSAGE, SHARED = 50, 26


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place on."""
    x = _words(data)
    return mix64(x[:-8] * np.uint64(0x9E3779B97F4A7C15) + mix64(x[8:]))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number."""
    x = data.astype(np.uint64)
    for s in (1, 2, 4):
        x = (x[:-s] << np.uint64(8 * s)) | x[s:]
    return x


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each ``w`` neighbours: block-wise running minima from both sides."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchored(data: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(start, end, anchor place, anchor hash) of the segments of a text."""
    if len(data) < span:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    g = _grams(data)
    low = np.uint64(0xFFFFFFFF)
    at = (_least((g & ~low) | np.arange(len(g), dtype=np.uint64), span - GRAM + 1) & low).astype(np.int64)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    end = np.r_[start[1:] - 1, len(at) - 1] + span
    return start, end, at[start], g[at[start]]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as sorted, separate ones; those that touch are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


SEGMENT = "rid long, start int, end int, at int, key long, content long, n int"


def _segments(span: int):
    """Arrow function: (rid, text) to segments; ``at`` is the anchor's place in the segment.

    Segments that a text holds more than once come once, with their number; where they lie is told by rows
    without a key, whose bytes are all repeats.
    """
    names = [x.split(" ")[0] for x in SEGMENT.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.int32() for x in SEGMENT.split(", ")]

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            rids, (data, offsets) = b.column("rid").to_numpy(), text_bytes(b.column("text"))
            raw = memoryview(data)
            parts = []
            for rid, i, j in zip(rids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if j - i < span:
                    continue
                start, end, at, key = anchored(data[i:j], span)
                content = np.fromiter((digest(raw[i + s : i + e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
                rows = np.stack([np.full(len(start), rid), start, end, at - start, key.view(np.int64), content.view(np.int64), np.ones(len(start), np.int64)], axis=1)
                both, first, back, n = np.unique(rows[:, 4] ^ (rows[:, 5] * 3), return_index=True, return_inverse=True, return_counts=True)
                if len(both) < len(rows):
                    s, e = merged(*(x[n[back] > 1] for x in (start, end)))
                    known = np.zeros((len(s), 7), np.int64)
                    known[:, 0], known[:, 1], known[:, 2] = rid, s, e
                    rows = rows[first]
                    rows[:, 6] = n
                    parts.append(known)
                parts.append(rows)
            if parts:
                rows = np.concatenate(parts)
                absent = rows[:, 6] == 0
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, k].astype(t.to_pandas_dtype()), mask=absent if k in (4, 5) else None) for k, t in enumerate(types)], names)

    return run


def _order(words: np.ndarray, left: np.ndarray, owner: np.ndarray, longest: int) -> np.ndarray:
    """Places of the text in the order of their suffixes, sorted by 6 bytes, 18, 54 and so on up to ``longest``.

    Segment ends count as distinct signs, above all bytes, in the order of the segments, so that the order is total
    and no match passes an end: within 6 bytes of one (``left``: bytes before it) the segment stands in place of
    what follows. Three ranks fit one key of the next sort, since a batch has under 2**21 places.
    """
    n = len(words)
    near = left < 6
    gone = np.uint64(8) * (np.uint64(8) - np.where(near, left, 6).astype(np.uint64))
    high = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = words & np.where(gone >= 64, np.uint64(0), high << np.minimum(gone, np.uint64(63)))
    first |= np.where(near, np.uint64(0xFF) << np.minimum(np.uint64(56) - np.minimum(left, 6).astype(np.uint64) * np.uint64(8), np.uint64(56)), np.uint64(0))
    first |= np.where(near, (owner + 1).astype(np.uint64), np.uint64(0))

    def dense(x):
        order = np.argsort(x)
        up = x[order]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.r_[0, up[1:] != up[:-1]])
        return out, order

    rank, order = dense(first)
    reach, shift = 6, np.int64(n.bit_length())
    while reach < longest and rank.max() < n - 1:
        times = 2 if 2 * reach >= longest else 3
        key = rank.copy()
        for k in range(1, times):
            key <<= shift
            key[: max(0, n - k * reach)] |= rank[k * reach :] + 1
        reach *= times
        rank, order = dense(key)
    return order


@dataclass
class RunIndex:
    """Run-length Burrows-Wheeler transform of segments, each followed by an end, with samples at the runs' ends.

    Run j fills the rows ``start[j]`` to ``stop[j]``: it is found by counting, in ``bits``, the runs that start up to a
    row, from ``counts`` at each 64th row on. Its letter is ``letters[j]``. Its first row leads to row ``to[j]``, the others
    to the rows after it. In the order of where runs lead, ``samples[j]`` is the text place of the last row of the run
    before j and, in the second half, that of the first row of the run after j; ``same`` tells whether those runs have
    the same letter.
    """

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    letters: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    bits: np.ndarray
    counts: np.ndarray
    to: np.ndarray
    samples: np.ndarray
    same: np.ndarray
    highest: int

    @classmethod
    def of(cls, segments: list[bytes]) -> RunIndex:
        text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
        sizes = np.array([len(s) for s in segments])
        ends = np.cumsum(sizes + 1) - 1
        n, m = len(text), len(segments)
        owner = np.repeat(np.arange(m), sizes + 1)
        order = _order(_words(np.r_[text, np.zeros(7, np.uint8)]), ends[owner] - np.arange(n), owner, int(sizes.max()) + 1)
        before = text[order - 1]
        first = np.zeros(-(-n // 64) * 64, bool)
        first[:n] = np.r_[True, before[1:] != before[:-1]]
        start, bits = np.flatnonzero(first), np.packbits(first, bitorder="little").view("<u8")
        counts = np.cumsum(np.r_[0, np.bitwise_count(bits[:-1])], dtype=np.int64)
        stop = np.r_[start[1:], n] - 1
        letters, by = before[start], np.argsort(before[start], kind="stable")
        length, to = (stop - start + 1)[by], np.empty(len(start), np.int64)
        to[by] = np.cumsum(length) - length
        above, below = np.full(len(by), -1), np.full(len(by), -1)
        above[by[1:]], below[by[:-1]] = order[stop[by[:-1]]], order[start[by[1:]]]
        same_above, same_below = np.zeros(len(by), bool), np.zeros(len(by), bool)
        same_above[by[1:]] = same_below[by[:-1]] = letters[by[1:]] == letters[by[:-1]]
        # The row after the last letter is the first end.
        last = np.flatnonzero(letters[by] < 0xFF)[-1:]
        below[by[last]] = ends[0] + 1
        return cls(text, ends - sizes, ends, letters, start, stop, bits, counts, to, np.concatenate([above, below]), np.concatenate([same_above, same_below]), int(order[n - m - 1]) if n > m else -1)

    def longest(self, wanted: np.ndarray, span: int) -> np.ndarray:
        """Matching statistics of the ``wanted`` segments: at each of their places, the longest match that also starts elsewhere, told exactly up to ``span``.

        All segments are streamed at once, one letter a step, from their ends to their starts. Only rows at the end
        of a run compare texts, eight bytes at a time; all others take the length of the step before and one more.
        """
        n, m = len(self.text), len(self.ends)
        words = _words(np.r_[self.text, np.zeros(7, np.uint8)])
        left = self.ends[np.repeat(np.arange(m), self.ends + 1 - self.starts)] - np.arange(n)
        best = np.zeros(n, np.int64)
        size = (self.ends - self.starts)[wanted]
        seg = wanted[np.argsort(-size, kind="stable")]
        size = (self.ends - self.starts)[seg]
        active = np.searchsorted(-size, -np.arange(1, size.max(initial=0) + 1), "right")

        def common(a, b):
            most = np.minimum(np.minimum(left[a], left[b]), span)
            got, on = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
            while len(on):
                x = words[a[on] + got[on]] ^ words[b[on] + got[on]]
                step = np.full(len(on), 8)
                differ = np.flatnonzero(x)
                y = x[differ]
                step[differ] = (y[:, None] < FIRST_BYTES).sum(axis=1)
                got[on] += step
                on = on[(x == 0) & (got[on] < most[on])]
            return np.minimum(got, most)

        # An end's own row, and the places of its neighbours above (first half) and below, which share nothing with it.
        row, p, k = n - m + seg, self.ends[seg].copy(), len(seg)
        place = np.concatenate([np.where(seg > 0, self.ends[seg - 1], self.highest), np.where(seg < m - 1, self.ends[np.minimum(seg + 1, m - 1)], -1)])
        match = np.zeros(2 * k, np.int64)
        for still in active:
            if still < k:
                place, match = (np.concatenate([x[:still], x[k : k + still]]) for x in (place, match))
                row, p, k = row[:still], p[:still], still
            j = self.counts[row >> 6] + np.bitwise_count(self.bits[row >> 6] << (63 - (row & 63)).astype(np.uint64)) - 1
            place -= 1
            match += 1
            away = row - self.start[j]
            up, down = np.flatnonzero(away == 0), np.flatnonzero(row == self.stop[j])
            edge, run = np.concatenate([up, down + k]), np.concatenate([j[up], j[down] + len(self.start)])
            other = self.samples[run]
            place[edge] = other - 1
            match[edge] = 0
            ok = np.flatnonzero(self.same[run])
            match[edge[ok]] = 1 + common(p[edge[ok] % k], other[ok])
            row = self.to[j] + away
            p = p - 1
            best[p] = np.maximum(match[:k], match[k:])
        return best


def marked(segments: list[bytes], span: int, wanted: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(segment, start, end) of the runs of bytes whose windows also start elsewhere among the segments; ``wanted``: segments to ask about."""
    index = RunIndex.of(segments)
    starts, ends = index.starts, index.ends
    owner = np.repeat(np.arange(len(segments)), ends + 1 - starts)
    best = index.longest(np.arange(len(segments)) if wanted is None else wanted, span)
    hit = np.flatnonzero((best >= span) & (np.arange(len(best)) + span <= ends[owner]))
    if not len(hit):
        return []
    seg, at = owner[hit], hit - starts[owner[hit]]
    new = np.flatnonzero(np.r_[True, (np.diff(hit) > 1) | (np.diff(seg) > 0)])
    last = np.r_[new[1:] - 1, len(hit) - 1]
    return list(zip(seg[new].tolist(), at[new].tolist(), (at[last] + span).tolist(), strict=True))


SPANS = "rid long, start int, end int"


def _likely(group: list[tuple], span: int) -> list[tuple]:
    """Rows (key, rid, start, n, at, bytes) of an anchor group that can share a window with another row.

    A window has half of what it holds beside the anchor's gram on one of its sides at least, so rows that share
    neither that stretch before the anchor nor that after it share no window.
    """
    half = (span - GRAM) // 2
    sides = [(r[5][r[4] - half : r[4] + GRAM] if r[4] >= half else None, r[5][r[4] : r[4] + GRAM + half]) for r in group]
    before, after = Counter(x for x, _ in sides), Counter(x for _, x in sides)
    kept = [r for r, (x, y) in zip(group, sides, strict=True) if (x is not None and before[x] > 1) or (len(y) == GRAM + half and after[y] > 1)]
    return kept if any(r[3] == 1 for r in kept) else []


def _indexed(span: int):
    """Arrow function over rows (key, rid, start, n, at, bytes) sorted by key: repeats inside whole anchor groups."""

    def told(rows):
        # A segment that occurs more than once is known to be a repeat; it only answers.
        single = np.flatnonzero([r[3] == 1 for r in rows])
        out = [(rows[i][1], rows[i][2] + a, rows[i][2] + b) for i, a, b in marked([r[5] for r in rows], span, single)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["rid", "start", "end"])

    def run(batches):
        held, size, group, key = [], 0, [], None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "rid", "start", "n", "at", "bytes")), strict=True):
                if row[0] != key:
                    rows = _likely(group, span)
                    held += rows
                    size += sum(len(r[5]) for r in rows)
                    if size >= BATCH:
                        yield told(held)
                        held, size = [], 0
                    group, key = [], row[0]
                group.append(row)
        held += _likely(group, span)
        if held:
            yield told(held)

    return run


BYTES = SEGMENT + ", bytes binary"


def _narrower(span: int, width: int):
    """Arrow function: segments to the parts whose windows start in one class of ``width`` offsets before the anchor."""
    names = [x.split(" ")[0] for x in BYTES.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.binary() if x.endswith("binary") else pa.int32() for x in BYTES.split(", ")]

    def run(batches):
        digest = xxhash.xxh3_64
        signed = lambda x: int.from_bytes(x.digest(), "big", signed=True)
        for b in batches:
            out = []
            for rid, start, at, n, data in zip(*(b.column(c).to_pylist() for c in ("rid", "start", "at", "n", "bytes")), strict=True):
                last = len(data) - span
                for j in range((at - min(last, at)) // width, at // width + 1):
                    low, high = max(0, at - j * width - width + 1), min(last, at - j * width)
                    if low <= high:
                        core = data[at - j * width : at - j * width - width + 1 + span]
                        part = data[low : high + span]
                        out.append((rid, start + low, start + high + span, at - low, signed(digest(core, j)), signed(digest(part)), n, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)

    return run


def _settle(rows: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Split segments into spans that are repeats for sure and, per distinct content of an anchor with several
    contents, one representative row with the number of occurrences ``n`` and of contents ``kinds``."""
    of_key = [F.sum("n").alias("all"), F.count(F.lit(1)).alias("rows"), (F.min("content") != F.max("content")).alias("several")]
    keys = stored(rows.groupBy("key").agg(*of_key).filter("all > 1").drop("all"), f"{tag}-keys")
    shared = stored(spread(rows, keys, "key", "rows", "rid"), f"{tag}-shared")
    contents = shared.filter("several").groupBy("key", "content").agg(F.sum("n").cast("int").alias("times"), F.count(F.lit(1)).alias("rows"), F.min("rid").alias("rep"))
    contents = stored(contents, f"{tag}-contents")
    kinds = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    known = stored(spread(shared.filter("several").drop("several"), contents.drop("key"), "content", "rows", "rid"), f"{tag}-known")
    sure = shared.filter("not several").select("rid", "start", "end").unionByName(known.filter("times > 1").select("rid", "start", "end"))
    reps = known.filter("rid = rep").dropDuplicates(["content"]).drop("n", "rep").withColumnRenamed("times", "n").join(kinds, "key")
    return sure, reps


def repeated(docs: DataFrame, span: int = SPAN, limit: int = LIMIT) -> DataFrame:
    """(rid, start, end): spans of repeated bytes of rows (rid, text); they may overlap."""
    found = stored(docs.mapInArrow(_segments(span), SEGMENT), "repeat-segments")
    sure, reps = _settle(found.filter("key is not null"), "repeat-0")
    spans = [found.filter("key is null").select("rid", "start", "end"), sure]
    wanted = reps.groupBy("rid").agg(F.collect_list(F.struct("start", "end", "at", "key", "content", "n", "kinds")).alias("parts"))
    cut = F.transform("parts", lambda p: F.struct(*[p[c].alias(c) for c in ("start", "end", "at", "key", "content", "n", "kinds")], F.substring(F.col("text").cast("binary"), p["start"] + 1, p["end"] - p["start"]).alias("bytes")))
    rows = stored(docs.join(wanted, "rid").dropDuplicates(["rid"]).select("rid", F.inline(cut)), "repeat-bytes")
    for level, width in enumerate((*WIDTHS, 0)):
        cold = rows.filter(F.col("kinds") <= limit).select("key", "rid", "start", "n", "at", "bytes")
        spans.append(cold.repartition("key").sortWithinPartitions("key").mapInArrow(_indexed(span), SPANS))
        hot = rows.filter(F.col("kinds") > limit)
        if not width or hot.isEmpty():
            break
        narrow = stored(hot.mapInArrow(_narrower(span, width), BYTES), f"repeat-narrow-{width}")
        sure, reps = _settle(narrow, f"repeat-{level + 1}")
        spans.append(sure)
        rows = stored(reps, f"repeat-rows-{width}")
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def shared_words(docs: DataFrame, passage: int = PASSAGE, k: int = SHARED) -> DataFrame:
    """(rid, places): where winnowed ``k``-grams of words of rows (rid, text) start that also stand elsewhere."""

    def run(batches):
        known = powers(STEP + 1)
        for b in batches:
            rids, (data, offsets) = b.column("rid").to_numpy(), text_bytes(b.column("text"))
            for i, j in blocks(offsets, STEP):
                words, counts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], known)
                doc = np.repeat(np.arange(j - i), counts)
                at = winnow(words, doc, passage, k)
                own = doc[at]
                place = at - (np.cumsum(counts) - counts)[own]
                yield pa.RecordBatch.from_arrays([pa.array(gram_hashes(words, k)[at].view(np.int64)), pa.array(rids[i:j][own]), pa.array(place.astype(np.int32))], ["gram", "rid", "place"])

    grams = stored(docs.mapInArrow(run, "gram long, rid long, place int"), "repeat-grams")
    again = stored(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "repeat-grams-again")
    return spread(grams, again, "gram", "rows", "rid").groupBy("rid").agg(F.collect_set("place").alias("places"))


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long"


def _removed(batches):
    """Arrow function: (doc_id, text, spans, places) to the contract's row and the words of shared grams."""
    names = [x.split(" ")[0] for x in OUT.split(", ")]
    for b in batches:
        data, offsets = text_bytes(b.column("text"))
        raw, cols = memoryview(data), ([], [], [], [], [])
        spans, places = b.column("spans").to_pylist(), b.column("places").to_pylist()
        for i, j, own, words in zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans, places, strict=True):
            pairs = np.array([(s["start"], s["end"]) for s in own or []], np.int64).reshape(-1, 2)
            start, end = merged(pairs[:, 0], pairs[:, 1])
            h, at = hashlib.sha256(), i
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                h.update(raw[at : i + s])
                at = i + e
            h.update(raw[at:j])
            w = np.array(words or [], np.int64)
            s, e = merged(w, w + SHARED)
            for c, x in zip(cols, (j - i, int((end - start).sum()), len(start), h.hexdigest(), int((e - s).sum())), strict=True):
                c.append(x)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3]), pa.array(cols[4], pa.int64())], names)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))


def remove_repeats(docs: DataFrame, span: int = SPAN, limit: int = LIMIT) -> DataFrame:
    """One row per document: bytes, removed bytes, maximal removed runs, the digest of what is kept, and the words of passages that also stand elsewhere."""
    rows = _rows(docs)
    texts = rows.select("rid", "text")
    spans = repeated(texts, span, limit).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = rows.join(spans, "rid", "left").join(shared_words(texts), "rid", "left")
    return out.select("doc_id", "text", "spans", "places").mapInArrow(_removed, OUT)
