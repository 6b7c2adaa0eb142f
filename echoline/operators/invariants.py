"""Invariants of a study: the same ids on both sides, nothing that belongs together spread over folds, whole partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.operators.audit import check

#: Sensors per group and, by partition, recordings and how many of them are quiet.
SENSORS = ("H1", "H2")
POPULATION = {"train": (40, 8), "validation": (20, 4), "confirmation": (60, 12)}
#: The files of a result drop, what its receipt names, and the mark of a fixture.
DROP = ("comparison.json", "metrics.json", "receipt.json")
RECEIPT = {"metrics.json": "metrics_sha256", "comparison.json": "comparison_sha256"}
FIXTURE_MARK = "SYNTHETIC"
#: Fixed value: body, window and repetition of a recording's file name.
FILE_NAME = r"^(.+?)[-_](\d+)-(\d+)(?:_(\d+))?\.wav$"
NO_VALUE = "NA"


def named(paths: DataFrame, kind: str = "cls", path: str = "path") -> DataFrame:
    """Add body, w0, w1, rep, material, region, pressure and flow, read from file names; all null if a name has another form.

    Names of noise have three fields (category, region, device), other names five (material, region, pressure, flow,
    device); fields of any other count are NA.
    """
    name = F.element_at(F.split(path, "/"), -1)
    part = lambda i: F.nullif(F.regexp_extract(name, FILE_NAME, i), F.lit(""))
    rows = paths.withColumns({"body": part(1), "w0": part(2).cast("int"), "w1": part(3).cast("int"), "rep": part(4).cast("int")})
    fields = F.transform(F.split("body", "-"), lambda x: F.trim(x))
    noise = F.col(kind) == "noise"
    whole, short = ~noise & (F.size(fields) == 5), noise & (F.size(fields) == 3)
    read = lambda ok, i: F.when(F.col("body").isNotNull(), F.when(ok, F.get(fields, F.lit(i))).otherwise(NO_VALUE))
    region = F.when(short | whole, F.get(fields, F.lit(1))).otherwise(NO_VALUE)
    return rows.withColumns({"material": read(whole, 0), "region": F.when(F.col("body").isNotNull(), region), "pressure": read(whole, 2), "flow": read(whole, 3)})


def spread(rows: DataFrame, keys: list[Column], name: str, applies: Column | None = None) -> DataFrame:
    """Check that no key lies in several folds; ``coverage`` counts the rows that have the key, ``failures`` the keys."""
    given = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys]) & (F.lit(True) if applies is None else F.coalesce(applies, F.lit(False)))
    per = rows.filter(given).groupBy(*[k.alias(f"__{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"), (F.min("fold") != F.max("fold")).alias("bad"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("coverage"), F.count_if("bad").alias("failures"))
    return total.select(F.lit(name).alias("name"), (F.col("failures") == 0).alias("passed"), "coverage", "failures")


def near_copies_apart(pairs: DataFrame, rows: DataFrame, name: str = "near_duplicate") -> DataFrame:
    """Check that no near pair (a, b) of clips lies in two folds; the coverage is all clips."""
    side = lambda c: rows.select(F.col("clip_id").alias(c), F.col("fold").alias(f"fold_{c}"))
    bad = pairs.join(side("a"), "a").join(side("b"), "b").agg(F.count_if(F.col("fold_a") != F.col("fold_b")).alias("failures"))
    n = rows.agg(F.count(F.lit(1)).alias("coverage"))
    return bad.crossJoin(n).select(F.lit(name).alias("name"), (F.col("failures") == 0).alias("passed"), "coverage", "failures")  # one row each


def fold_invariants(clips: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Checks over (clip_id, fold, cls, digest, body, material, region, pressure, flow) and, if given, near pairs (a, b)."""
    c = F.col
    measured = (c("cls") == "leak") & (c("pressure") != NO_VALUE) & (c("flow") != NO_VALUE)
    parts = [
        spread(clips, [c("digest")], "exact_duplicate"), spread(clips, [c("cls"), c("body")], "session"),
        spread(clips, [c("pressure"), c("flow")], "leak_condition", measured), spread(clips, [c("material"), c("region")], "quiet_condition", c("cls") == "no_leak"),
    ]
    return reduce(DataFrame.unionByName, parts + ([near_copies_apart(pairs, clips)] if pairs is not None else []))


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(n, only_left, only_right): distinct keys in all, and those of one side only. A null key counts as a key."""
    a, b = (d.select(F.col(key).alias("k")).distinct().withColumn("side", F.lit(s)) for s, d in enumerate((left, right)))
    per = a.unionByName(b).groupBy("k").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hi") == 0).alias("only_left"), F.count_if(F.col("lo") == 1).alias("only_right"))


def same_on_all(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that are not in every one of the tables, with the array of those (by position) that have them."""
    parts = [t.select(key).distinct().withColumn("at", F.lit(i)) for i, t in enumerate(tables)]
    per = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sort_array(F.collect_list("at")).alias("found_in"))
    return per.filter(F.size("found_in") < len(tables))


def fold_partition(rows: DataFrame, dealt: DataFrame, folds: int = 3) -> DataFrame:
    """Checks of a cross-validation: ``dealt`` (clip_id, cv_fold) holds every clip of ``rows`` (clip_id, group_id, y) out once."""
    held = rows.select("clip_id", "group_id", "y").join(dealt, "clip_id", "full_outer")
    per_clip = held.groupBy("clip_id").agg(F.count("cv_fold").alias("n"), F.count("group_id").alias("known"))
    per_group = held.filter("group_id is not null").groupBy("group_id").agg(F.countDistinct("cv_fold").alias("folds"), F.countDistinct("y").alias("classes"))
    per_fold = held.filter("cv_fold is not null").groupBy("cv_fold").agg(F.countDistinct("y").alias("classes"))
    parts = [
        check(per_clip, "held_out_once", (F.col("n") != F.col("known")) | (F.col("known") != 1)), check(per_group, "group_in_one_fold", F.col("folds") > 1),
        check(per_group, "group_of_one_class", F.col("classes") > 1), check(per_fold, "both_classes", F.col("classes") != 2),
        per_fold.agg(F.count(F.lit(1)).alias("coverage")).select(F.lit("all_folds").alias("name"), (F.col("coverage") == folds).alias("passed"), "coverage", F.abs(F.col("coverage") - folds).alias("failures")),
    ]
    return reduce(DataFrame.unionByName, parts)


def registration(recordings: DataFrame) -> DataFrame:
    """Checks of primary recordings (recording_id, group, sensor, partition, label): pairs of sensors and populations."""
    groups = recordings.groupBy("group").agg(F.sort_array(F.collect_list("sensor")).alias("sensors"), F.countDistinct("partition").alias("p"), F.countDistinct("label").alias("l"))
    whole = F.coalesce(F.col("sensors") == F.array(*map(F.lit, SENSORS)), F.lit(False)) & (F.col("p") == 1) & (F.col("l") == 1)
    counts = recordings.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "no_leak").alias("quiet"), F.count_if(~F.col("label").isin("leak", "no_leak")).alias("other"))
    fits = reduce(lambda a, b: a | b, [(F.col("partition") == p) & (F.col("n") == n) & (F.col("quiet") == q) & (F.col("other") == 0) for p, (n, q) in POPULATION.items()])
    parts = [
        check(recordings.groupBy("recording_id").count(), "unique_recording", F.col("count") > 1), check(groups, "sensor_pairs", ~whole), check(counts, "population", ~F.coalesce(fits, F.lit(False))),
        counts.agg(F.count(F.lit(1)).alias("coverage")).select(F.lit("partitions").alias("name"), (F.col("coverage") == len(POPULATION)).alias("passed"), "coverage", F.abs(F.col("coverage") - len(POPULATION)).alias("failures")),
    ]
    return reduce(DataFrame.unionByName, parts)


def drop_problems(files: DataFrame) -> DataFrame:
    """Problems (problem) of a result drop (name, content binary); an empty drop or a sound one has none.

    The drop must hold exactly the three files, each hash of the receipt must be that of its file, and no file may
    carry the mark of a fixture. Other files than JSON are not looked at.
    """
    rows = files.filter(F.col("name").endswith(".json")).select("name", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("sha256"))
    names = F.sort_array(F.collect_list("name"))
    one = rows.agg(names.alias("names"), F.map_from_entries(F.collect_list(F.struct("name", "sha256"))).alias("hashes"),
                   F.max(F.when(F.col("name") == "receipt.json", F.col("text"))).alias("receipt"),
                   F.sort_array(F.collect_list(F.when(F.col("text").contains(FIXTURE_MARK), F.col("name")))).alias("marked"))
    receipt = F.from_json("receipt", ", ".join(f"{k} string" for k in RECEIPT.values()))
    json_ok = F.coalesce(F.try_parse_json("receipt").isNotNull(), F.lit(False))
    wrong = F.filter(F.array(*[F.when(~F.element_at("hashes", n).eqNullSafe(receipt[k]), F.lit(f"{n} sha256 does not match receipt")) for n, k in RECEIPT.items()]), lambda v: v.isNotNull())
    marked = F.transform("marked", lambda n: F.concat(n, F.lit(" contains a synthetic fixture marker")))
    found = F.when(F.size("names") == 0, F.array().cast("array<string>")).when(
        F.col("names") != F.array(*map(F.lit, DROP)), F.array(F.concat(F.lit(f"expected exactly {', '.join(DROP)}; found "), F.array_join("names", ", ")))
    ).when(~json_ok, F.array(F.lit("receipt.json is not valid JSON"))).otherwise(F.concat(wrong, marked))
    return one.select(F.explode(found).alias("problem"))


def first_groups(rows: DataFrame, k: int) -> DataFrame:
    """The first clip of each of the first ``k`` groups of every class, in the order of clip_id."""
    leads = rows.groupBy("y", "group_id").agg(F.min("clip_id").alias("clip_id"))
    ranked = leads.withColumn("__k", F.row_number().over(Window.partitionBy("y").orderBy("clip_id")))
    return ranked.filter(F.col("__k") <= k).drop("__k")


def identity_chain(files: DataFrame, inputs: DataFrame, visuals: DataFrame) -> DataFrame:
    """Per recording (recording, sha256) whether its input (recording, input_sha256) and its display (input_sha256, visual) hang on it."""
    chained = files.join(inputs, "recording", "left").join(visuals.select("input_sha256", "visual").distinct(), "input_sha256", "left")
    problem = F.when(F.col("input_sha256").isNull(), "no input").when(F.col("input_sha256") != F.col("sha256"), "other input").when(F.col("visual").isNull(), "no display")
    return chained.select("recording", "visual", problem.alias("problem"))
