"""Secret scans: fixed patterns, and random-looking strings by character Markov models.

Two first-order models, of random strings and of ordinary identifiers, are trained from labelled samples; a
run of token characters is a secret where the log-likelihood ratio passes a threshold. All of it is DataFrame
functions; the models reach the expressions as one constant table of the ratios of all pairs of characters.

The ordinary samples come from about ``sample_docs`` documents picked by a hash of their id (the documented
bound of the fit); random samples are generated from hashes. Cases: a null text is an empty one and has no
spans; spans count code points, end exclusive; spans of a kind never overlap, those of different kinds may,
except that a model span that meets a pattern's span is left out; equal starts go by kind; repeated rows are
reported each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in their order, each with its pattern and the group whose length counts, and the least length.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Characters of tokens; the models' states.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE, LEAST = r"[A-Za-z0-9+/_=-]{20,}", 20
SAMPLE_DOCS, SAMPLE_RANDOM = 200, 4000


def spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern as array<struct<start, order, end, kind, value>>: where matches lie follows from the
    lengths of the pieces between them. Texts without a match are not split."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.zip_with(F.arrays_zip(found.alias("m"), value.alias("v")), F.split(text, pattern, -1), lambda mv, gap: F.struct(mv["m"].alias("m"), mv["v"].alias("v"), F.length(gap).alias("gap")))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
        kept = F.when(F.length(x["v"]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    walked = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def random_samples(spark: SparkSession, n: int = SAMPLE_RANDOM) -> DataFrame:
    """(text, label 1): strings in hex, upper-case hex, base64 and base64 without signs, from hashes of numbers."""
    rows = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit("random:"), F.col("id").cast("string")), 256))
    b64 = F.base64(F.unhex("h"))
    shapes = [F.substring("h", 1, 40), F.upper(F.substring("h", 1, 40)), b64, F.regexp_replace(b64, "[+/=]", ""), F.upper(F.regexp_replace(b64, "[+/=]", ""))]
    return rows.select(F.explode(F.array(*shapes)).alias("text"), F.lit(1).alias("label"))


def ordinary_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, label 0): identifiers made of neighbouring words of a bounded hash sample of documents, numbers and rules."""
    n = max(1, docs.select("doc_id").count())
    picked = docs.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < min(1.0, sample_docs / n) * 1_000_000)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    pairs = picked.select(F.explode(F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 30).alias("b"))).alias("p")).select("p.a", F.coalesce("p.b", F.lit("")).alias("b"))
    low, cap, up = (lambda c: F.lower(c)), (lambda c: F.initcap(c)), (lambda c: F.upper(c))
    forms = [f(x) if sep is None else F.concat(f("a"), F.lit(sep), g("b")) for x, f, g, sep in (
        ("a", low, low, None), ("a", up, up, None), ("a", low, low, "_"), ("a", low, low, "-"), ("a", low, low, "/"), ("a", up, up, "_"), ("a", low, cap, ""), ("a", cap, cap, ""),
    )]
    number = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 15), 16, 10)
    rules = F.concat(*[F.repeat(F.lit(x), 20) for x in ("-", "=", "_", "/", "+", "A", "a")])
    plain = [number, F.regexp_replace(number, "(..)", "$1-"), F.regexp_replace(number, "(....)", "$1_"), rules, F.lit(ALPHABET)]
    numbers = docs.sparkSession.range(SAMPLE_RANDOM).select(F.explode(F.array(*plain)).alias("text"))
    return pairs.select(F.explode(F.array(*forms)).alias("text")).unionByName(numbers).withColumn("label", F.lit(0))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio, random to ordinary, of each pair of characters, row by row over ALPHABET.

    Counts are aggregated by Spark; at most two rows for each pair of the alphabet come to the driver.
    """
    chars = F.regexp_extract_all("text", F.lit(f"[{ALPHABET}]"), F.lit(0))
    both = samples.select("label", F.explode(F.arrays_zip(chars.alias("a"), F.slice(chars, 2, 1 << 30).alias("b"))).alias("p"))
    n = len(ALPHABET)
    at = lambda c: F.expr(f"locate({c}, '{ALPHABET}') - 1")
    counts = both.filter("p.b is not null").groupBy("label", "p.a", "p.b").count().select("label", at("a").alias("i"), at("b").alias("j"), "count").collect()
    tables = [[[smooth] * n for _ in range(n)] for _ in range(2)]
    for r in counts:
        tables[r["label"]][r["i"]][r["j"]] += r["count"]
    logs = [[[math.log(x / sum(row)) for x in row] for row in table] for table in tables]
    return [round(logs[1][i][j] - logs[0][i][j], 6) for i in range(n) for j in range(n)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token: the sum over its neighbouring characters."""
    n = len(ALPHABET)
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(table, acc["last"] * n + c))).alias("sum"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, model: list[float], least_ratio: float = 12.0, least_mean: float = 0.4) -> DataFrame:
    """Add ``base`` and ``found`` (array of spans) to rows with a ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [spans(text, kind, i, *rule) for i, (kind, rule) in enumerate(BASE.items())]
    out = docs.withColumn("base", F.array_sort(F.concat(*kinds)))
    tokens = spans(text, "random", len(BASE), CANDIDATE, 0, LEAST)
    alone = F.filter(tokens, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    secret = lambda t: (ratio(t["value"], model) >= least_ratio) & (ratio(t["value"], model) >= (F.length(t["value"]) - 1) * least_mean)
    return out.withColumn("found", F.array_sort(F.concat("base", F.filter(alone, secret))))


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the patterns' spans, and all spans with the models' own."""
    rows = docs.select("doc_id", "text")
    model = train(random_samples(docs.sparkSession).unionByName(ordinary_samples(rows)))
    scanned = scan(rows, model)
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *[count(k) for k in BASE], F.sha2(said("base"), 256).alias("base_sha256"), said("found").alias("spans"))
