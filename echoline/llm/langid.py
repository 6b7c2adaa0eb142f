"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (1 to 3, inside words with their borders). A
document goes to the language whose profile is nearest by out-of-place distance: per n-gram of the document
the difference of ranks, or the profile's length where the language lacks it.

The profiles are fitted on a bounded sample: per language about ``per_lang`` documents, picked by a hash of
their id. Cases: a text that is null or has no letter is ``und`` with score 0; n-grams of equal frequency rank
by code point; languages at equal distance go by name; without any learned language all are ``und``; a null
doc_id is neither held out nor learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEPT, PER_LANG = 400, 1500
SPAN = 1 << 16


def letters() -> np.ndarray:
    """Per UTF-16 code unit range: the code point if it is a letter, else 0."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(SPAN)], np.uint64)


def grams(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of the lower-cased text; letters beyond the basic plane count as one letter each by low bits."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    high = points >= SPAN
    if high.any():
        alpha = np.array([chr(p).isalpha() for p in points[high].tolist()], bool)
        c = table[np.where(high, 0, points)]
        c[high] = np.where(alpha, np.maximum(points[high] & (SPAN - 1), 1), 0)
    else:
        c = table[points]
    on = c != 0
    keep = on.copy()
    keep[1:] |= on[:-1]
    c = np.concatenate([[np.uint64(0)], c[keep], [np.uint64(0)]])
    if len(c) < 3:
        return np.zeros(0, np.uint64)
    a, b, d = c[:-2], c[1:-1], c[2:]
    mid = b != 0
    two = (c[:-1] != 0) | (c[1:] != 0)
    tag = np.uint64(1 << 48)
    return np.concatenate([b[mid], (c[:-1][two] << np.uint64(16)) | c[1:][two] | tag, (a[mid] << np.uint64(32)) | (b[mid] << np.uint64(16)) | d[mid] | tag + tag])


def ranked(codes: np.ndarray, kept: int) -> np.ndarray:
    """The most frequent codes, most frequent first, equal ones in code order."""
    found, n = np.unique(codes, return_counts=True)
    down = n.max(initial=0) - n
    return found[np.argsort(down.astype(np.uint16) if n.max(initial=0) < SPAN else down, kind="stable")[:kept]]


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, kept: int = KEPT) -> dict[str, np.ndarray]:
    """Profile of each language among (doc_id, text, lang): at most ``kept`` codes for each language come to the driver."""
    rows = docs.filter("lang is not null and text is not null and doc_id is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, v in sorted(counts.items()) for x in (k, min(1.0, per_lang / v))])
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", "text")

    def count(batches):
        table = letters()
        for b in batches:
            parts = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                codes, n = np.unique(grams(text, table), return_counts=True)
                parts.append(pd.DataFrame({"lang": lang, "gram": codes.view(np.int64), "n": n}))
            if parts:
                yield pa.RecordBatch.from_pandas(pd.concat(parts).groupby(["lang", "gram"], as_index=False)["n"].sum(), preserve_index=False)

    totals = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("rank", rank).filter(F.col("rank") <= kept)
    profiles: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in profiles.items()}


def nearest(text: str | None, profiles: list[tuple[str, np.ndarray, np.ndarray]], table: np.ndarray, kept: int) -> tuple[str, float]:
    """(language, score) of a text; the score is 1 less the distance's share of the largest possible one."""
    codes = grams(text, table) if text else np.zeros(0, np.uint64)
    if not len(codes) or not profiles:
        return "und", 0.0
    own = ranked(codes, kept)
    place, most = np.arange(len(own)), kept * len(own)
    best, at = "und", most + 1
    for lang, known, ranks in profiles:
        i = np.minimum(np.searchsorted(known, own), len(known) - 1)
        d = int(np.where(known[i] == own, np.abs(ranks[i] - place), kept).sum())
        if d < at:
            best, at = lang, d
    return best, 1.0 - at / most


def predictor(profiles: dict[str, np.ndarray], kept: int = KEPT):
    """A pandas UDF from a text to struct<lang_pred, score>."""
    sorted_profiles = [(lang, p[(o := np.argsort(p))], o) for lang, p in sorted(profiles.items())]

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        table = letters()
        return pd.DataFrame([nearest(t, sorted_profiles, table, kept) for t in texts], columns=["lang_pred", "score"], index=texts.index)

    return predict


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from documents that are not held out.

    lang, source and doc_id are no inputs of a prediction.
    """
    rows = docs.select("doc_id", "text", "lang")
    predict = predictor(fit(rows.filter(~_held_out())))
    out = rows.select("doc_id", _held_out().alias("held_out"), predict("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def in_known_language(docs: DataFrame, least: float = 0.1) -> DataFrame:
    """``docs`` without those that have no letter or are near no learned language, every column untouched."""
    predict = predictor(fit(docs.select("doc_id", "text", "lang").filter(~_held_out())))
    return docs.withColumn("__lid", predict("text")).filter((F.col("__lid.lang_pred") != "und") & (F.col("__lid.score") >= least)).drop("__lid")
