"""Masked pseudo-likelihood: a bidirectional window network scores documents.

The network predicts a word from ``REACH`` words on each side: a table of vectors per offset, their sum x through
x / (1 + |x|), then a softmax over classes of units and one over the units of a class. A document's score is the sum of
the log-probabilities of all its words, each given its neighbours on both sides.

All counted words are leaves of that tree. The most frequent ones are units of their own; every other word belongs to the unit of
its ending, to the network also as a neighbour, and has that unit's probability times its share of it, from the counts of all words;
a part of the unit, as large as that of the words seen once, is for words never seen, spelled at random. How many units there are
grows with the number of distinct words (``size_of``). The tasks know the shares of up to ``LISTED`` words; the counts of all rarer ones are joined.

Training masks every place of every document once. Texts become rows of units, pieces of at most ``PIECE`` words, which are dealt
by a hash over ``ROUNDS`` rounds and seats; a seat's pieces are sorted, it goes on from the shared weights in numpy, and Spark averages
the weights of the seats, block by block and seat by seat. The number of seats follows from the words and the model's weights alone, so the result
doesn't depend on how many tasks or partitions a session has. Only the model comes to the driver.

Cases: a null text has no words, as has one without letters or digits: sum 0, mean null; a text of one word is
predicted from its borders; repeated rows are scored each; equally frequent words rank by hash; an empty table
gives no rows, a corpus without words the untrained network; other columns are ignored. Scores are rounded to 1e-3.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import blocks, mix64, text_bytes
from echoline.llm.decontaminate import hashed, powers, word_spans
from echoline.session import stored

#: Units are about so many times the cube root of the distinct words; the part of them that holds the rarer words by ending.
GROWTH, LEAST_UNITS, RARE = 40, 256, 4
REACH, WIDTH = 2, 24
ROUNDS, RATE = 3, 0.1
#: A seat has at least so many places for each of the model's weights, and about so many steps if a batch between the bounds allows it.
PER_WEIGHT, STEPS, BATCHES = 2, 200, (256, 8192)
#: Words of a piece; places that a seat shuffles and learns at a time.
PIECE, HELD = 1 << 15, 1 << 16
#: Bytes of text in a step of the scans, most distinct words a task holds before it hands counts on, words in a step of scoring.
STEP, DISTINCT, SLICE = 1 << 20, 1 << 18, 8192
BLOCK = 2048
#: Most words outside the units whose counts the tasks hold; bytes a word can have, and the chance that a spelling ends.
LISTED, SIGNS, LAST = 1 << 18, 164, 1 / 8


@dataclass(frozen=True)
class Size:
    """How many units and classes a network has: known words first, then the units of rarer words."""

    units: int
    classes: int

    @property
    def rest(self) -> int:
        return self.units // RARE

    @property
    def known(self) -> int:
        return self.units - self.rest

    @property
    def wide(self) -> int:
        return self.units // self.classes

    @property
    def border(self) -> int:
        return self.units

    @property
    def kind(self) -> type:
        """The integers that hold a unit or the border."""
        return np.uint16 if self.units < 1 << 16 else np.uint32

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {
            "near": (2 * REACH, self.units + 1, WIDTH), "bias": (WIDTH,), "kind": (self.classes, WIDTH), "kind_bias": (self.classes,),
            "word": (self.classes, self.wide, WIDTH), "word_bias": (self.classes, self.wide),
        }

    def weights(self) -> int:
        return sum(int(np.prod(v)) for v in self.shapes().values())


def size_of(distinct: int) -> Size:
    """The network's size for so many distinct words: powers of two, classes about as many as units in a class."""
    units = max(LEAST_UNITS, 1 << round(log2(GROWTH * max(1, distinct) ** (1 / 3))))
    return Size(units, 1 << (units.bit_length() - 1) // 2)


@dataclass
class Shares:
    """Counts of words by sorted hash; by rare unit, the words in it and the part for unseen words; counts of all words, if some are not listed."""

    hashes: np.ndarray
    n: np.ndarray
    total: np.ndarray
    unseen: np.ndarray
    counts: DataFrame | None


@dataclass
class Model:
    """Known words (sorted hashes and their units), the network's weights by name, the words' shares of their units, and the words counted."""

    size: Size
    hashes: np.ndarray
    units: np.ndarray
    weights: dict[str, np.ndarray]
    shares: Shares | None = None
    total: int = 0


def unpacked(flat: np.ndarray, size: Size) -> dict[str, np.ndarray]:
    """Weights by name as views of one vector."""
    out, at = {}, 0
    for name, shape in size.shapes().items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def packed(weights: dict[str, np.ndarray], size: Size) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in size.shapes()]).astype(np.float32)


def endings(folded: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of the last three bytes of each word."""
    last = folded[e - 1].astype(np.uint64)
    for k in (2, 3):
        last |= np.where(e - s >= k, folded[np.maximum(e - k, s)], 0).astype(np.uint64) << np.uint64(8 * (k - 1))
    return mix64(last)


def _scan(docs: DataFrame, schema: str, tell):
    """Map steps of documents: ``tell(batch, i, j, hashes, counts, sizes, tails)`` yields Arrow batches; ``tell(None, ...)`` ends a task."""

    def run(batches):
        known = powers(STEP + 1)
        told = tell()
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for i, j in blocks(offsets, STEP):
                at = offsets[i : j + 1] - offsets[i]
                folded, s, e = word_spans(data[offsets[i] : offsets[j]], at)
                yield from told(b, i, j, *hashed(folded, s, e, at, known), e - s, endings(folded, s, e))
        yield from told(None, 0, 0, None, None, None, None)

    return docs.mapInArrow(run, schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, ending, n) over all documents; tasks add up what they can hold before the shuffle."""

    def tell():
        parts, held = [], 0

        def added():
            h, t, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
            own, first, back = np.unique(h, return_index=True, return_inverse=True)
            return own, t[first], np.bincount(back, weights=n, minlength=len(own)).astype(np.int64)

        def step(batch, i, j, hashes, counts, sizes, tails):
            nonlocal parts, held
            if batch is not None:
                own, first, n = np.unique(hashes, return_index=True, return_counts=True)
                parts.append((own, tails[first], n))
                held += len(own)
                if held < DISTINCT:
                    return
                parts = [added()]
                held = len(parts[0][0])
                if held < DISTINCT // 2:
                    return
            if parts:
                h, t, n = added()
                parts, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.view(np.int64)), pa.array(n)], ["word", "ending", "n"])

        return step

    return _scan(docs.select("text"), "word long, ending long, n long", tell).groupBy("word", "ending").agg(F.sum("n").alias("n"))


def word_shares(counts: DataFrame, size: Size, known: np.ndarray, n: np.ndarray, tails: np.ndarray, listed: int = LISTED) -> Shares:
    """Shares of the words outside ``known`` (hashes, with counts ``n`` and their endings) of their units."""
    total, once = np.zeros(size.rest), np.zeros(size.rest)
    own = counts.groupBy(F.col("ending").bitwiseAND(size.rest - 1).alias("unit")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once"))
    for r in own.collect():
        total[r["unit"]], once[r["unit"]] = r["n"], r["once"]
    unit = (tails % np.uint64(size.rest)).astype(np.int64)
    total -= np.bincount(unit, weights=n, minlength=size.rest)
    once -= np.bincount(unit, weights=n == 1, minlength=size.rest)
    least, room = None, listed + len(known)
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        room -= r["count"]
        if room < 0:
            break
        least = r["n"]
    found = counts.limit(0) if least is None else counts.filter(F.col("n") >= least)
    found = found.select("word", "n").toArrow()
    h, m = found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return Shares(h[order], m[order], total, np.maximum(once, 1), counts.select("word", "n") if room < 0 else None)


def untrained(counts: DataFrame, seed: int = 1, listed: int = LISTED) -> Model:
    """The most frequent words, most frequent first, and a network that gives each unit its share of the corpus."""
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = size_of(distinct)
    top = counts.orderBy(F.desc("n"), "word").limit(size.known).collect()
    hashes, tails = (np.array([r[c] for r in top], np.int64).view(np.uint64) for c in ("word", "ending"))
    n = np.array([r["n"] for r in top], np.int64)
    shares = word_shares(counts, size, hashes, n, tails, listed)
    share = np.ones(size.units)
    share[: len(top)] += n
    share[size.known :] += shares.total
    share = np.log(share / share.sum()).reshape(size.classes, size.wide)
    kinds = np.log(np.exp(share).sum(axis=1))
    weights = {k: np.zeros(v, np.float32) for k, v in size.shapes().items()}
    rng = np.random.default_rng(seed)
    weights["near"][:] = rng.normal(0, 0.1, weights["near"].shape)
    weights["kind_bias"][:], weights["word_bias"][:] = kinds, share - kinds[:, None]
    order = np.argsort(hashes)
    return Model(size, hashes[order], order, weights, shares, total)


def units_of(hashes: np.ndarray, tails: np.ndarray, model: Model) -> np.ndarray:
    """The unit of each word: its own, or that of its ending."""
    out = (tails % np.uint64(model.size.rest)).astype(model.size.kind) + model.size.kind(model.size.known)
    if len(model.hashes):
        at = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
        hit = model.hashes[at] == hashes
        out[hit] = model.units[at[hit]]
    return out


def in_unit(hashes: np.ndarray, sizes: np.ndarray, tails: np.ndarray, shares: Shares) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words outside the known: log of their share of the unit, whether their count is still missing, and log of the part that needs none.

    The share is (n + unseen * spelled) / (total + unseen); where the count is missing, the first result is only
    the log of the divisor's inverse. The spellings of all words add up to the number of rare units, those of a unit to about 1.
    """
    rest = len(shares.total)
    unit = (tails % np.uint64(rest)).astype(np.int64)
    spelled = log(rest * LAST / (1 - LAST)) + sizes * log((1 - LAST) / SIGNS) + np.log(shares.unseen)[unit]
    base = -np.log(shares.total + shares.unseen)[unit]
    n = np.zeros(len(hashes))
    if len(shares.hashes):
        at = np.minimum(np.searchsorted(shares.hashes, hashes), len(shares.hashes) - 1)
        hit = shares.hashes[at] == hashes
        n[hit] = shares.n[at[hit]]
    missing = (n == 0) & (shares.counts is not None)
    with np.errstate(divide="ignore"):
        found = base + np.logaddexp(np.log(n), spelled)
    return np.where(missing, base, found), missing, spelled


def bordered(units: np.ndarray, counts: np.ndarray, size: Size) -> tuple[np.ndarray, np.ndarray]:
    """All units with ``REACH`` borders around each text, and the places of the units in it."""
    places = np.arange(len(units)) + REACH * (np.repeat(np.arange(len(counts)), counts) + 1)
    row = np.full(len(units) + REACH * (len(counts) + 1), size.border, size.kind)
    row[places] = units
    return row, places


OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]


def _log_sums(x: np.ndarray) -> np.ndarray:
    """Logs of the sums of exponentials by row; ``x`` is left with the exponentials, largest one by row."""
    top = x.max(axis=1, keepdims=True)
    x -= top
    np.exp(x, out=x)
    return np.log(x.sum(axis=1)) + top[:, 0]


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax by row, in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _hidden(near: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    h = w["near"][0][near[0]]
    for k in range(1, 2 * REACH):
        h += w["near"][k][near[k]]
    h += w["bias"]
    size = np.abs(h)
    size += 1
    h /= size
    return h


def log_probabilities(near: np.ndarray, target: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Log-probability of each target unit given its neighbours (one row of ``near`` per offset)."""
    classes, wide, _ = w["word"].shape
    kind = (target // wide).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    near, target, kind = near[:, order], target[order], kind[order]
    h = _hidden(near, w)
    every = np.arange(len(target))
    logits = h @ w["kind"].T + w["kind_bias"]
    out = logits[every, kind]
    out -= _log_sums(logits)
    ends = np.cumsum(np.bincount(kind, minlength=classes))
    logits = np.empty((len(target), wide), np.float32)
    for c in range(classes):
        a, b = ends[c - 1] if c else 0, ends[c]
        if a < b:
            logits[a:b] = h[a:b] @ w["word"][c].T + w["word_bias"][c]
    out += logits[every, target % wide]
    out -= _log_sums(logits)
    back = np.empty_like(out)
    back[order] = out
    return back


def step(near: np.ndarray, target: np.ndarray, w: dict[str, np.ndarray], seen: dict[str, np.ndarray], rate: float = RATE) -> None:
    """One Adagrad step on a batch; ``seen`` sums the squared gradients."""
    classes, wide, _ = w["word"].shape
    n, every = len(target), np.arange(len(target))
    kind = (target // wide).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    near, target, kind = near[:, order], target[order], kind[order]
    h = _hidden(near, w)
    g = _softmax(h @ w["kind"].T + w["kind_bias"])
    g[every, kind] -= 1
    back = g @ w["kind"]
    grads = {"kind": g.T @ h, "kind_bias": g.sum(axis=0)}
    ends = np.cumsum(np.bincount(kind, minlength=classes))
    logits = np.empty((n, wide), np.float32)
    spans = [(c, ends[c - 1] if c else 0, ends[c]) for c in range(classes) if (ends[c - 1] if c else 0) < ends[c]]
    for c, a, b in spans:
        logits[a:b] = h[a:b] @ w["word"][c].T + w["word_bias"][c]
    g = _softmax(logits)
    g[every, target % wide] -= 1
    for c, a, b in spans:
        back[a:b] += g[a:b] @ w["word"][c]
        own, bias = g[a:b].T @ h[a:b] / n, g[a:b].sum(axis=0) / n
        for name, grad in (("word", own), ("word_bias", bias)):
            seen[name][c] += grad * grad
            w[name][c] -= rate * grad / np.sqrt(seen[name][c])
    back *= np.square(1 - np.abs(h))
    grads["bias"] = back.sum(axis=0)
    for name, grad in grads.items():
        grad = grad / n
        seen[name] += grad * grad
        w[name] -= rate * grad / np.sqrt(seen[name])
    for k in range(2 * REACH):
        by = np.argsort(near[k], kind="stable")
        unit = near[k][by]
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        grad, unit = np.add.reduceat(back[by], first, axis=0) / n, unit[first]
        past = seen["near"][k][unit] + grad * grad
        seen["near"][k][unit] = past
        w["near"][k][unit] -= rate * grad / np.sqrt(past)


def encoded(docs: DataFrame, model: Model, slots: int) -> DataFrame:
    """(slot, key, part, cells binary): texts as units between their borders or neighbours, in pieces that are dealt over ``slots``.

    A slot and the order in it follow from the document and its piece alone.
    """
    own, size = Model(model.size, model.hashes, model.units, {}), model.size

    def tell():
        def run(batch, i, j, hashes, counts, sizes, tails):
            if batch is None or not len(hashes):
                return
            row, _ = bordered(units_of(hashes, tails, own), counts, size)
            ends = np.cumsum(counts) + REACH * np.arange(1, len(counts) + 1)
            keys, parts, cells, which = batch.column("key").slice(i, j - i), [], [], []
            for d in np.flatnonzero(counts).tolist():
                last, first = int(ends[d]), int(ends[d] - counts[d])
                for part, at in enumerate(range(first, last, PIECE)):
                    which.append(d)
                    parts.append(part)
                    cells.append(row[at - REACH : min(at + PIECE, last) + REACH].tobytes())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(which, pa.int64())), pa.array(parts, pa.int32()), pa.array(cells, pa.binary())], ["key", "part", "cells"])

        return run

    found = _scan(docs.select("text", F.xxhash64("doc_id", "text").alias("key")), "key long, part int, cells binary", tell)
    return found.select(F.pmod(F.xxhash64("key", "part"), F.lit(slots)).cast("int").alias("slot"), "key", "part", "cells")


def trained(pieces: DataFrame, weights: dict[str, np.ndarray], size: Size, batch: int) -> dict[str, np.ndarray]:
    """One round over pieces sorted by slot in their partitions: every slot goes on from ``weights``; the results are averaged by places."""
    start = packed(weights, size)

    class Seat:
        """Learns the places of one slot as they come, ``HELD`` at a time."""

        def __init__(self, slot: int):
            self.slot, self.flat, self.rng, self.total = slot, start.copy(), np.random.default_rng((7, slot)), 0
            self.w, self.held, self.size = unpacked(self.flat, size), [], 0
            self.seen = {k: np.full(v, 1e-6, np.float32) for k, v in size.shapes().items()}

        def take(self, cells: bytes) -> None:
            row = np.frombuffer(cells, size.kind)
            n = len(row) - 2 * REACH
            self.held.append(np.stack([row[REACH + o : REACH + o + n] for o in (*OFFSETS, 0)]))
            self.size += n
            if self.size >= HELD:
                self.learn()

        def learn(self) -> None:
            if self.size:
                cells = np.concatenate(self.held, axis=1)
                cells = cells[:, self.rng.permutation(self.size)]
                for a in range(0, self.size, batch):
                    step(cells[:-1, a : a + batch], cells[-1, a : a + batch], self.w, self.seen)
                self.total += self.size
            self.held, self.size = [], 0

        def done(self) -> pa.RecordBatch:
            self.learn()
            parts = [self.flat[a : a + BLOCK].tobytes() for a in range(0, len(self.flat), BLOCK)]
            n = len(parts)
            return pa.RecordBatch.from_arrays([pa.array([self.slot] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([self.total] * n, pa.int64()), pa.array(parts, pa.binary())], ["slot", "block", "n", "w"])

    def fit(batches):
        now = None
        for b in batches:
            for slot, cells in zip(b.column("slot").to_pylist(), b.column("cells"), strict=True):
                if now is None or now.slot != slot:
                    if now is not None:
                        yield now.done()
                    now = Seat(slot)
                now.take(cells.as_py())
        if now is not None:
            yield now.done()

    def added(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for block, n, w in zip(*(b.column(c).to_pylist() for c in ("block", "n", "w")), strict=True):
                own = sums.setdefault(block, [0, 0.0])
                own[0] += n
                own[1] = own[1] + n * np.frombuffer(w, np.float32).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(x / n).astype(np.float32).tobytes() for n, x in sums.values()], pa.binary())], ["block", "w"])

    parts = pieces.select("slot", "cells").mapInArrow(fit, "slot int, block int, n long, w binary")
    # Sums of floats in the order of the slots, whoever delivers first.
    means = parts.repartition("block").sortWithinPartitions("block", "slot").mapInArrow(added, "block int, w binary").collect()
    if not means:
        return weights
    return unpacked(np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(means, key=lambda r: r["block"])]), size)


def fit(docs: DataFrame, listed: int = LISTED) -> Model:
    """A model of the words of all documents, trained on all their places."""
    model = untrained(stored(word_counts(docs), "lm-counts"), listed=listed)
    seats = max(1, model.total // (ROUNDS * PER_WEIGHT * model.size.weights()))
    batch = min(BATCHES[1], max(BATCHES[0], model.total // (ROUNDS * seats * STEPS)))
    pieces = stored(encoded(docs, model, seats * ROUNDS), "lm-pieces")
    for r in range(ROUNDS):
        own = pieces.filter(F.col("slot").between(r * seats, (r + 1) * seats - 1))
        model.weights = trained(own.repartition(seats, "slot").sortWithinPartitions("slot", "key", "part"), model.weights, model.size, batch)
    return model


SCORES = "doc_id long, n_words long, log_likelihood double, words array<long>, spelled array<double>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, n_words, log_likelihood (sum over all words) and its mean per word."""
    names = [x.split(" ")[0] for x in SCORES.split(", ")]
    # The shares go to the tasks without the table of counts.
    shares = model.shares and replace(model.shares, counts=None if model.shares.counts is None else ())
    own = Model(model.size, model.hashes, model.units, model.weights)

    def tell():
        def run(batch, i, j, hashes, counts, sizes, tails):
            if batch is None:
                return
            units = units_of(hashes, tails, own)
            row, places = bordered(units, counts, own.size)
            found = np.empty(len(places))
            for a in range(0, len(places), SLICE):
                p = places[a : a + SLICE]
                found[a : a + SLICE] = log_probabilities(np.stack([row[p + o] for o in OFFSETS]), row[p], own.weights)
            doc = np.repeat(np.arange(j - i), counts)
            at, spelled = np.zeros(0, np.int64), np.zeros(0)
            if shares is not None:
                at = np.flatnonzero(units >= own.size.known)
                share, missing, spelled = in_unit(hashes[at], sizes[at], tails[at], shares)
                found[at] += share
                at, spelled = at[missing], spelled[missing]
            sums = np.bincount(doc, weights=found, minlength=j - i)
            ends = pa.array(np.searchsorted(doc[at], np.arange(j - i + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hashes[at].view(np.int64), spelled)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(counts.astype(np.int64)), pa.array(sums), *lists], names)

        return run

    out = _scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), SCORES, tell)
    if shares is not None and shares.counts is not None:
        out = _with_rare(out, model.shares.counts)
    out = out.select("doc_id", "n_words", F.round("log_likelihood", 3).alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_words"))


def _with_rare(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """Add to each row's sum the logs of (n + spelled) of its ``words``, which are joined with the counts of all words."""
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "spelled")).alias("x")).select("row", "x.words", "x.spelled")
    met = rare.join(counts, rare["words"] == counts["word"], "left")
    part = F.when(F.col("n") > 0, F.log(F.col("n") + F.exp("spelled"))).otherwise(F.col("spelled"))
    sums = met.groupBy("row").agg(F.sum(part).alias("rest"))
    out = scored.drop("words", "spelled").join(sums, "row", "left")
    return out.withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("rest", F.lit(0.0)))


def score_documents(docs: DataFrame) -> DataFrame:
    """Fit on all documents and score each of them."""
    return score(docs, fit(docs))
