"""Toxicity by a lexicon of learned terms, met through Levenshtein automata, and the context of each hit.

Terms are words, and stems that many words begin with, which labelled toxic texts use far more than labelled clean ones. They
stand in a trie; the Levenshtein automata of all terms run over it as one automaton, whose states are sets of (node, edits)
and are made when first met. So a misspelled term costs one walk over its letters. What a hit weighs follows from how often
its very spelling was seen in toxic and clean texts; an unseen spelling weighs as spellings that were seen once. The words
around a hit, and whether it stands in quotation marks, scale its weight: they tell abuse from quotation. A document's score
is logistic in the sum, the largest and the density of its hits' weights.

Everything is learned from a bounded sample: ``PER_LABEL`` distinct texts of either label, by a hash, from rows that are not held
out. Words count once per pair of neighbours, so that copies and near copies of a text don't make its words terms.

Cases: a null or empty text, or one without words, has no hits and the score of such texts; a null doc_id is not held out and has
no label; a doc_id or text with several labels has that of the majority, toxic on a tie; rows with a null label teach
nothing; without toxic and clean examples every score is ``PRIOR``; equal texts have equal scores; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from echoline.session import stored

PER_LABEL, PRIOR = 8000, 0.1
WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
MARKS = re.compile("[\"“”„«»\n]")
#: Shortest and longest stem; contexts and words a stem or term needs; how much likelier it is in toxic texts; most terms.
SHORT, LONG, CONTEXTS, KINDS, ODDS, TERMS = 4, 9, 4, 3, 8.0, 2000
#: Words on each side of a hit; spellings and context words that the model keeps; share of toxic uses taken to be misspelled.
WINDOW, SPELLINGS, AROUND, MISSPELLED = 4, 50_000, 2000, 0.02
QUOTED, TOP = '"', 6.0
#: Lengths from which a term may differ by one and by two edits.
ONE, TWO = 5, 10
#: States and words that a task remembers at most; rows it hands on at a time.
STATES, SEEN, CHUNK = 100_000, 300_000, 100_000


class Automaton:
    """The Levenshtein automata of all terms over their trie, made state by state.

    A term is (text, stem): a stem also meets every word that goes on after it.
    """

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.edits: list[int] = [0]
        for i, (text, _) in enumerate(terms):
            allowed, node, path = (len(text) >= ONE) + (len(text) >= TWO), 0, [0]
            for c in text:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.edits.append(0)
                node = nxt
                path.append(node)
            self.ends[node].append(i)
            for p in path:
                self.edits[p] = max(self.edits[p], allowed)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.met: list[tuple] = []
        self._state(self._closed({0: 0}))

    def _closed(self, least: dict[int, int]) -> frozenset:
        """With the nodes that letters left out lead to."""
        todo = list(least)
        while todo:
            node = todo.pop()
            e = least[node] + 1
            for nxt in self.child[node].values():
                if e <= self.edits[nxt] and e < least.get(nxt, 9):
                    least[nxt] = e
                    todo.append(nxt)
        return frozenset(least.items())

    def _state(self, nodes: frozenset) -> int:
        known = self.number.get(nodes)
        if known is None:
            known = self.number[nodes] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            stem = whole = None
            for node, e in nodes:
                for i in self.ends[node]:
                    text, open_ = self.terms[i]
                    if e <= (len(text) >= ONE) + (len(text) >= TWO):
                        whole = min(whole or (9, 0), (e, i))
                        stem = min(stem or (9, 0), (e, i)) if open_ else stem
            self.met.append((stem, whole))
        return known

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.edits[node] and e < least.get(node, 9):
                least[node] = e

        for node, e in self.sets[state]:
            for letter, nxt in self.child[node].items():
                reach(nxt, e + (letter != c))
            reach(node, e + 1)
        after = self._state(self._closed(least))
        self.steps[state][c] = after
        return after

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within its edits, the earlier term on a tie."""
        if len(self.sets) > STATES:
            self._clear()
        state, best = 0, None
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            stem = self.met[state][0]
            if stem is not None and (best is None or stem < best):
                best = stem
            if not self.sets[state]:
                return best
        whole = self.met[state][1]
        return whole if whole is not None and (best is None or whole < best) else best


@dataclass
class Model:
    """Terms, weights of known spellings and of unseen ones by kind, weights of words around a hit, and the logistic's."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    unseen: list[float] = field(default_factory=lambda: [0.0] * 4)
    around: dict[str, float] = field(default_factory=dict)
    logistic: list[float] = field(default_factory=lambda: [log(PRIOR / (1 - PRIOR)), 0.0, 0.0, 0.0])


@dataclass
class Hit:
    """A word that meets a term: start and end in the text, term, edits, kind (stem + 2 * misspelled), words around, in quotation marks."""

    start: int
    end: int
    word: str
    term: int
    edits: int
    kind: int
    around: list[str]
    quoted: bool


class Reader:
    """Finds hits in texts; remembers what it knows of words, up to ``SEEN`` of them."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms, self.automaton, self.seen, self.found = terms, Automaton(terms), set(), {}

    def hits(self, text: str | None) -> tuple[int, list[Hit]]:
        """(number of words, hits in order) of a whole text."""
        text = (text or "").lower()
        words = WORD.findall(text)
        own = set(words)
        fresh = own - self.seen
        if fresh:
            if len(self.seen) > SEEN:
                self.seen, self.found, fresh = set(), {}, own
            self.seen |= fresh
            for w in fresh:
                met = self.automaton.match(w)
                if met is not None:
                    self.found[w] = met
        if not self.terms or self.found.keys().isdisjoint(own):
            return len(words), []
        at = [i for i, w in enumerate(words) if w in self.found]
        wanted, spans = set(at), {}
        for i, m in enumerate(WORD.finditer(text)):
            if i in wanted:
                spans[i] = m.span()
        marks, quoted = quotes(text)
        out = []
        for i in at:
            edits, term = self.found[words[i]]
            start, end = spans[i]
            k = bisect_right(marks, start) - 1
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            out.append(Hit(start, end, words[i], term, edits, self.terms[term][1] + 2 * (edits > 0), near, k >= 0 and quoted[k]))
        return len(words), out


def quotes(text: str) -> tuple[list[int], list[bool]]:
    """Places of quotation marks and line ends, and whether what follows each is quoted; a quotation ends with its line."""
    places, inside, now = [], [], False
    for m in MARKS.finditer(text):
        c = m.group()
        now = not now if c == '"' else c in "„«" or (c == "“" and not now)
        places.append(m.start())
        inside.append(now)
    return places, inside


def unquoted(text: str) -> list[str]:
    """Words of a lower-cased text outside quotation marks."""
    if not any(c in text for c in '"“”„«»'):
        return WORD.findall(text)
    marks, inside = quotes(text)
    out = []
    for m in WORD.finditer(text):
        k = bisect_right(marks, m.start()) - 1
        if k < 0 or not inside[k]:
            out.append(m.group())
    return out


def features(n: int, hits: list[Hit], model: Model) -> tuple[float, float, float]:
    """Sum, largest and density of the hits' weights, each scaled by its surroundings."""
    total = most = 0.0
    for h in hits:
        w = model.weights.get(h.word)
        w = model.unseen[h.kind] if w is None else w
        if w > 0:
            around = sum(model.around.get(x, 0.0) for x in h.around) + (model.around.get(QUOTED, 0.0) if h.quoted else 0.0)
            w *= 1 / (1 + exp(-max(-30.0, min(30.0, 3.0 + around))))
            total, most = total + w, max(most, w)
    return log1p(total), most, log1p(100 * total / (n + 20))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(text, toxic, weight): about ``per_label`` distinct texts of either label; a weight is how many texts one stands for.

    Ids and hashes of texts meet the labels; the picked ones, a bounded number, go to the documents.
    """
    mean = F.avg(F.col("toxic").cast("double"))
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg((mean >= 0.5).alias("toxic")).filter(~_held_out())
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th")).filter(~_held_out())
    texts = rows.join(known, "doc_id").groupBy("th").agg(F.min("doc_id").alias("doc_id"), (F.avg(F.col("toxic").cast("double")) >= 0.5).alias("toxic"))
    texts = stored(texts, "toxicity-texts")
    share = {r["toxic"]: min(1.0, per_label / r["n"]) for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.when(F.col("toxic"), share.get(True, 1.0)).otherwise(share.get(False, 1.0))
    picked = texts.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "th"), F.lit(1 << 30)) < rate * (1 << 30)).withColumn("weight", 1 / rate)
    whole = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "th"])
    return stored(whole.dropDuplicates(["th"]).select("text", "toxic", "weight"), "toxicity-sample")


def _each(rows: DataFrame, schema: str, tell):
    """Map texts: ``tell()`` gives a function from a row of the batch to rows, asked once more with None at the end of a task."""

    target, nothing = to_arrow_schema(StructType.fromDDL(schema)), [None] * len(rows.columns)

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), target.types, strict=True)], schema=target)

    def run(batches):
        say = tell()
        for b in batches:
            out = []
            for i in range(b.num_rows):
                out += say(*(c[i].as_py() for c in b.columns))
                if len(out) > CHUNK:
                    yield table(out)
                    out = []
            if out:
                yield table(out)
        out = list(say(*nothing))
        if out:
            yield table(out)

    return rows.mapInArrow(run, schema)


def candidates(texts: DataFrame) -> tuple[DataFrame, int]:
    """(term, stem, n1): words and stems of the toxic texts with the pairs of neighbours they have; and the pairs of all words."""

    def tell():
        def say(text):
            if text is None:
                return []
            words = ["", *WORD.findall(text.lower()), ""]
            return list({(w, f"{a} {b}") for a, w, b in zip(words, words[1:], words[2:]) if len(w) >= 3})

        return say

    pairs = _each(texts.select("text"), "word string, pair string", tell)
    words = stored(pairs.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n1")), "toxicity-pairs")
    stem = F.sequence(F.lit(SHORT), F.least(F.lit(LONG), F.length("word") - 1))
    stems = words.filter(F.length("word") > SHORT).select(F.explode(F.transform(stem, lambda k: F.substring("word", F.lit(1), k))).alias("term"), "n1")
    stems = stems.groupBy("term").agg(F.sum("n1").alias("n1"), F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") >= KINDS)
    both = words.select(F.col("word").alias("term"), F.lit(False).alias("stem"), "n1").unionByName(stems.select("term", F.lit(True).alias("stem"), "n1"))
    return both.filter(F.col("n1") >= CONTEXTS), words.agg(F.coalesce(F.sum("n1"), F.lit(0))).first()[0]


def clean_counts(texts: DataFrame, words: set[str], stems: set[str]) -> DataFrame:
    """(term, stem, n0): uses of candidate words and stems in clean texts, added up in the tasks; (null, false, n) counts all words.

    Quoted words don't count: that clean texts quote a term doesn't make it clean.
    """

    def tell():
        counts: Counter = Counter()

        def say(text):
            if text is not None:
                counts.update(unquoted(text.lower()))
                if len(counts) < SEEN:
                    return []
            out: Counter = Counter()
            for w, n in counts.items():
                out[None, False] += n
                if w in words:
                    out[w, False] += n
                for k in range(SHORT, min(LONG, len(w) - 1) + 1):
                    if w[:k] in stems:
                        out[w[:k], True] += n
            counts.clear()
            return [(t, s, n) for (t, s), n in out.items()]

        return say

    return _each(texts.select("text"), "term string, stem boolean, n long", tell).groupBy("term", "stem").agg(F.sum("n").alias("n0"))


def chosen(found: list, clean: dict, toxic_words: int, clean_words: int) -> list[tuple[str, bool]]:
    """The terms among candidates: those whose share of toxic texts is beyond chance by the likelihood ratio, stems before the words under them."""
    least, good = 2 * log(len(found) + 1) + 6, []
    for r in found:
        a, b = r["n1"], clean.get((r["term"], r["stem"]), 0)
        p, share = toxic_words / (toxic_words + clean_words), a / (a + b)
        ratio = 2 * (a * log(share / p) + (b * log((1 - share) / (1 - p)) if b else 0))
        odds = (a / toxic_words) / ((b + 0.5) / clean_words)
        if share > p and ratio >= least and odds >= ODDS:
            good.append((r["term"], r["stem"], ratio))
    stems, out = set(), []
    for term, stem, ratio in sorted(good, key=lambda g: (not g[1], len(g[0]), g[0])):
        if not any(term[:k] in stems for k in range(SHORT, len(term))):
            if stem:
                stems.add(term)
            out.append((ratio, term, stem))
    return [(t, s) for _, t, s in sorted(out, key=lambda x: (-x[0], x[1], x[2]))[:TERMS]]


def evidence(rows: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    """Hits in the sample: (toxic, word, kind, around, pair, quoted); quoted hits have the mark among the words around."""

    def tell():
        reader = Reader(terms)

        def say(text, toxic):
            if text is None:
                return []
            return [(toxic, h.word, h.kind, h.around + [QUOTED] * h.quoted, " ".join(h.around[WINDOW - 1 : WINDOW + 1]), h.quoted) for h in reader.hits(text)[1]]

        return say

    return _each(rows.select("text", "toxic"), "toxic boolean, word string, kind int, around array<string>, pair string, quoted boolean", tell)


def weighed(model: Model, hits: DataFrame, ratio: float) -> Model:
    """Weights of spellings and of words around; ``ratio`` is how many clean words there are for a toxic one."""
    of = lambda toxic, what: F.count_distinct(F.when(F.col("toxic") == toxic, F.col(what)))
    words = hits.groupBy("word", "kind").agg(of(True, "pair").alias("n1"), F.count_if(~F.col("toxic") & ~F.col("quoted")).alias("n0"))
    words = stored(words, "toxicity-words")
    kinds = {r["kind"]: r for r in words.groupBy("kind").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count_if(F.expr("n1 = 1 and n0 = 0")).alias("s1"), F.count_if(F.expr("n0 = 1 and n1 = 0")).alias("s0")).collect()}
    got = lambda kind, c: float(kinds[kind][c]) if kind in kinds else 0.0
    for kind in range(4):
        # Spellings seen once tell how often new ones come; of misspelled ones more come than a sample shows.
        more = MISSPELLED * got(kind - 2, "n1") if kind >= 2 else 0.1 * got(kind, "n1")
        model.unseen[kind] = min(TOP, max(0.0, log((got(kind, "s1") + more + 0.5) * ratio / (got(kind, "s0") + 0.5))))
    for r in words.orderBy(F.desc(F.col("n1") + F.col("n0")), "word").limit(SPELLINGS).collect():
        p = 1 / (1 + exp(-model.unseen[r["kind"]]))
        model.weights[r["word"]] = min(TOP, max(0.0, log((r["n1"] + 2 * p) * ratio / (r["n0"] + 2 * (1 - p) * ratio))))
    sure = hits.filter("kind < 2")
    n1, n0 = sure.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    near = sure.select("toxic", F.explode("around").alias("x")).groupBy("x").agg(F.count_if("toxic").alias("c1"), F.count_if(~F.col("toxic")).alias("c0"))
    for r in near.orderBy(F.desc(F.col("c1") + F.col("c0")), "x").limit(AROUND).collect():
        model.around[r["x"]] = _lean(r["c1"], r["c0"], n1, n0)
    model.around[QUOTED] = model.around.get(QUOTED, 0.0) - 2.0
    return model


def _lean(c1: int, c0: int, n1: int, n0: int) -> float:
    """How far a neighbour leans to hits of toxic texts, damped, between -3 and 3."""
    share = n1 / max(1, n1 + n0)
    e1, e0 = (c1 + c0) * share, (c1 + c0) * (1 - share)
    return max(-3.0, min(3.0, log((c1 + 1) / (e1 + 1)) - log((c0 + 1) / (e0 + 1))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge regression by Newton steps; the first column is the constant, which isn't damped."""
    beta = np.zeros(x.shape[1])
    damp = np.full(x.shape[1], ridge)
    damp[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(damp), x.T @ (weight * (y - p)) - damp * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Terms, weights and the logistic from the bounded sample."""
    rows, model = sample(docs, labels, per_label), Model()
    seen = {r["toxic"]: r["w"] for r in rows.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    if len(seen) < 2:
        return model
    found, toxic_words = candidates(rows.filter("toxic"))
    found, toxic_words = found.collect(), max(1, toxic_words)
    counted = clean_counts(rows.filter("not toxic"), {r["term"] for r in found if not r["stem"]}, {r["term"] for r in found if r["stem"]}).collect()
    clean = {(r["term"], r["stem"]): r["n0"] for r in counted}
    clean_words = max(1, clean.pop((None, False), 0))
    model.terms = chosen(found, clean, toxic_words, clean_words)
    model = weighed(model, stored(evidence(rows, model.terms), "toxicity-hits"), clean_words / toxic_words)

    def tell():
        reader = Reader(model.terms)
        return lambda text, toxic, weight: [] if text is None else [(toxic, weight, *features(*reader.hits(text), model))]

    table = _each(rows.select("text", "toxic", "weight"), "toxic boolean, weight double, a double, b double, c double", tell).toPandas()
    table = table.sort_values(list(table.columns))  # sums of floats in one order, whatever the tasks
    x = np.column_stack([np.ones(len(table)), table[["a", "b", "c"]].to_numpy()])
    model.logistic = logistic(x, table["toxic"].to_numpy(np.float64), table["weight"].to_numpy()).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_terms, n_misspelled, n_quoted) of every row of ``docs``."""
    schema = "doc_id long, score double, n_terms long, n_misspelled long, n_quoted long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        reader, beta = Reader(model.terms), model.logistic
        for b in batches:
            out = []
            for text in b.column("text"):
                n, hits = reader.hits(text.as_py())
                z = beta[0] + sum(w * x for w, x in zip(beta[1:], features(n, hits, model), strict=True))
                hits = [h for h in hits if model.weights.get(h.word, model.unseen[h.kind]) > 0]
                out.append((1 / (1 + exp(-max(-30.0, min(30.0, z)))), len(hits), sum(h.edits > 0 for h in hits), sum(h.quoted for h in hits)))
            if out:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in zip(*out, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and its hits by kind; learned from rows that are not held out."""
    out = score(docs, fit(docs, labels, per_label))
    return out.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms", "n_misspelled", "n_quoted")
