"""Evidence in JSON, read all or nothing: an ordered table of rules over variant values, and chains of digests.

The first rule that fails names the status; nothing of a document is shown unless all hold. Documents are canonical JSON: keys sorted,
no spaces, so that two spellings of one document have one digest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.functions.intake import outcome
from echoline.operators.evaluation import CONTROLS

#: The mark of a fixture, the verdicts, the stress changes, names and digests, and what an accepted receipt says.
FIXTURE_MARK = "SYNTHETIC"
VERDICTS = ("compatible with improvement", "compatible with degradation", "inconclusive")
TRANSFORMS = ("T1", "T2", "T3")
NAME, DIGEST = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$", r"^[0-9a-f]{64}$"
RECEIPT = {"status": "OFFICIAL", "contract_check": "PASS", "provenance_check": "PASS", "final_report": "GENERATED"}


@dataclass(frozen=True)
class Protocol:
    """What a result must name: the protocol's tag and commit, the split's file and digest."""

    tag: str
    commit: str
    split_name: str
    split_sha256: str

    def receipt(self) -> dict[str, str]:
        return RECEIPT | {"protocol_tag": self.tag, "protocol_commit": self.commit, "report_commit": self.commit}


def canonical(text: Column) -> Column:
    """A JSON text with its keys sorted and without spaces; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


# --- rules over variants ----------------------------------------------------------------------------------------------
def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _is(v: Column, path: str, *kinds: str) -> Column:
    found = F.schema_of_variant(_get(v, path))
    return F.coalesce(reduce(lambda a, b: a | b, [found.startswith(k) for k in kinds]), F.lit(False))


def number(v: Column, path: str) -> Column:
    return F.when(_is(v, path, "BIGINT", "DOUBLE", "DECIMAL"), _get(v, path, "double"))


def text(v: Column, path: str) -> Column:
    return F.when(_is(v, path, "STRING"), _get(v, path, "string"))


def _finite(v: Column, path: str) -> Column:
    n = number(v, path)
    return F.coalesce(~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False))


def _unit(v: Column, path: str) -> Column:
    return F.coalesce(number(v, path).between(0, 1), F.lit(False))


def _whole(v: Column, path: str, least: int) -> Column:
    n = number(v, path)
    return F.coalesce((n == F.floor(n)) & (n >= least), F.lit(False))


def _like(v: Column, path: str, pattern: str) -> Column:
    return F.coalesce(text(v, path).rlike(pattern), F.lit(False))


def _text_or_null(v: Column, path: str) -> Column:
    return F.coalesce(_is(v, path, "STRING", "VOID"), F.lit(False))


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _map(v: Column, path: str) -> Column:
    """The members of an object by name; null if there is no object."""
    return F.when(_is(v, path, "OBJECT"), _get(v, path, "map<string,variant>"))


def _every(members: Column, rule) -> Column:
    return F.coalesce(F.forall(F.map_values(members), rule), F.lit(False))


def sound_run(v: Column) -> Column:
    """Whether a run has its name, model and all numbers of its test fold."""
    t = "folds.test"
    return _all(
        _like(v, "run_id", NAME), _like(v, "model_name", "."), _text_or_null(v, "checkpoint"), _text_or_null(v, "training_commit"),
        *[_whole(v, f"{t}.{n}", 1) for n in ("n_clips", "n_clusters")], *[_whole(v, f"{t}.{n}", 0) for n in ("n_clusters_leak", "n_clusters_non_leak")],
        *[_unit(v, f"{t}.clip_level.{n}") for n in ("roc_auc", "pr_auc", "macro_f1", "brier")], *[_unit(v, f"{t}.cluster_level.{n}") for n in ("roc_auc", "macro_f1")],
        *[_unit(v, f"{t}.bootstrap_ci95.{level}_roc_auc.{side}") for level in ("clip", "cluster") for side in ("ci95_low", "ci95_high")],
    )


def sound_pair(v: Column) -> Column:
    """Whether a paired comparison has both names, its population, and both differences with interval and verdict."""
    parts = [_is(v, "a", "STRING"), _is(v, "b", "STRING"), F.coalesce(text(v, "fold") == "test", F.lit(False)), _whole(v, "n_clusters", 1)]
    for level in ("clip_roc_auc", "cluster_roc_auc"):
        parts += [_finite(v, f"{level}.{n}") for n in ("delta_observe", "ci95_low", "ci95_high")]
        parts.append(F.coalesce(text(v, f"{level}.lecture").isin(*VERDICTS), F.lit(False)))
    return _all(*parts)


def sound_receipt(v: Column, protocol: Protocol) -> Column:
    """Whether a receipt has exactly its fields, with their fixed values, names and digests."""
    fixed = protocol.receipt()
    names = sorted([*fixed, "tslm_run_id", "metrics_sha256", "comparison_sha256"])
    members = F.try_variant_get(v, "$", "map<string,variant>")
    return _all(
        F.coalesce(F.sort_array(F.map_keys(members)) == F.array(*map(F.lit, names)), F.lit(False)), *[F.coalesce(text(v, k) == x, F.lit(False)) for k, x in fixed.items()],
        _like(v, "tslm_run_id", NAME), _like(v, "metrics_sha256", DIGEST), _like(v, "comparison_sha256", DIGEST),
    )


def sound_metrics(v: Column) -> Column:
    """Whether a report has its split, ladder, runs and stress runs, each of them sound."""
    bases = F.try_variant_get(v, "$.stress_run_bases", "map<string,array<string>>")
    return _all(
        _is(v, "split.filename", "STRING"), _is(v, "split.sha256", "STRING"), _is(v, "control_ladder", "ARRAY"), _every(_map(v, "runs"), sound_run),
        F.coalesce(F.forall(F.map_keys(bases), lambda k: k.rlike(NAME)) & F.forall(F.map_values(bases), lambda b: (F.size(b) == 2) & F.get(b, F.lit(0)).rlike(NAME) & F.get(b, F.lit(1)).isin(*TRANSFORMS)), F.lit(False)),
        _every(_map(v, "stress_comparisons"), sound_pair), _like(v, "tslm_run_id", NAME) | _is(v, "tslm_run_id", "VOID"),
    )


def _same_population(a: Column, b: Column) -> Column:
    return _all(*[F.coalesce(number(a, f"folds.test.{n}") == number(b, f"folds.test.{n}"), F.lit(False)) for n in ("n_clips", "n_clusters")])


def _pair_of(pair: Column, a: Column, b: Column) -> Column:
    return F.coalesce((text(pair, "a") == a) & (text(pair, "b") == b), F.lit(False))


def official_result(files: DataFrame, protocol: Protocol, shown: dict[str, tuple[float, float]], clusters: int, quiet_clusters: int, allow_fixture: bool = False, by: list[str] = ()) -> DataFrame:
    """One row (status, reason, result) for each drop, by the columns ``by``, of files (name, content text): ``OFFICIAL`` with the result, or ``NOT_EVALUATED`` with the first rule that fails.

    ``shown`` has the clip and cluster AUC of each control as it is displayed, ``clusters`` and ``quiet_clusters`` the displayed test population: the
    report must carry the same numbers. Only whole results come out; ``result`` is a struct of run, population, scores, comparisons and stress runs.
    """
    if tuple(shown) != CONTROLS:
        raise ValueError("the displayed controls are not the ladder")
    of = lambda n: F.max(F.when(F.col("name") == f"{n}.json", F.col("content")))
    one = files.groupBy(*by).agg(*[of(n).alias(f"{n}_text") for n in ("receipt", "metrics", "comparison")])
    one = one.select("*", *[F.try_parse_json(f"{n}_text").alias(n) for n in ("receipt", "metrics", "comparison")])
    m, r = F.col("metrics"), F.col("receipt")
    pairs = F.try_variant_get("comparison", "$", "map<string,variant>")
    one = one.select(
        "*", _map(m, "runs").alias("runs"), F.when(F.schema_of_variant("comparison").startswith("OBJECT"), pairs).alias("pairs"), _map(m, "stress_comparisons").alias("stressed"),
        F.try_variant_get(m, "$.stress_run_bases", "map<string,array<string>>").alias("bases"), text(m, "tslm_run_id").alias("id"),
    )
    run = F.col("id")
    own = F.element_at("runs", run)
    versus = lambda c: F.element_at("pairs", F.concat(run, F.lit(f"_vs_{c}")))
    stress = F.array_sort(F.filter(F.map_entries("bases"), lambda e: F.get(e["value"], F.lit(0)) == run))
    stress_pair = lambda e: F.element_at("stressed", F.concat(run, F.lit("_vs_"), e["key"]))
    stress_run = lambda e: F.element_at("runs", e["key"])
    not_there = [F.col(f"{n}_text").isNull() for n in ("receipt", "metrics", "comparison")]
    yes = lambda c: F.coalesce(c, F.lit(False))
    rules: list[tuple[str | Column, Column]] = [
        ("No official TSLM result delivered.", ~_all(*not_there)), ("Receipt missing or invalid.", sound_receipt(r, protocol)), ("metrics.json invalid.", sound_metrics(m)),
        ("comparison.json invalid.", _every(F.col("pairs"), sound_pair)),
        ("Synthetic fixture refused.", F.lit(allow_fixture) | ~yes(F.concat("receipt_text", "metrics_text", "comparison_text").contains(FIXTURE_MARK))),
        ("Report has no TSLM run.", run.isNotNull()), ("Receipt and report name different TSLM runs.", text(r, "tslm_run_id") == run),
        ("Control ladder differs from the frozen ladder.", F.try_variant_get(m, "$.control_ladder", "array<string>") == F.array(*map(F.lit, CONTROLS))),
        ("Report is not on the frozen split.", (text(m, "split.filename") == protocol.split_name) & (text(m, "split.sha256") == protocol.split_sha256)),
        ("TSLM run id collides with a control.", ~F.lower(run).isin(*CONTROLS)), ("TSLM run missing from metrics.json.", own.isNotNull()),
    ]
    for c, (clip, cluster) in shown.items():
        control = F.element_at("runs", F.lit(c))
        auc = lambda level, v=control: F.round(number(v, f"folds.test.{level}_level.roc_auc"), 3)
        rules += [(f"Control {c} differs from the displayed evidence.", (auc("clip") == clip) & (auc("cluster") == cluster)), (f"TSLM and {c} test populations differ.", _same_population(own, control))]
    rules.append(("Test cluster counts differ from the displayed evidence.", (number(own, "folds.test.n_clusters") == clusters) & (number(own, "folds.test.n_clusters_non_leak") == quiet_clusters)))
    rules += [(F.concat(F.lit("Paired comparison "), run, F.lit(f" vs {c} missing.")), _pair_of(versus(c), run, F.lit(c))) for c in CONTROLS]
    broken = F.filter(stress, lambda e: ~yes(stress_run(e).isNotNull() & _pair_of(stress_pair(e), run, e["key"])))
    other = F.filter(stress, lambda e: ~yes(_same_population(stress_run(e), own)))
    first = lambda a: F.get(a, F.lit(0))["key"]
    rules += [(F.concat(F.lit("Stress run "), first(broken), F.lit(" incomplete.")), F.size(broken) == 0), (F.concat(F.lit("Stress run "), first(other), F.lit(" test population differs.")), F.size(other) == 0)]
    reason = F.coalesce(*[F.when(~yes(holds), F.lit(name) if isinstance(name, str) else name) for name, holds in rules])

    delta = lambda p, level: F.struct(*[number(p, f"{level}.{n}").alias(a) for n, a in (("delta_observe", "delta"), ("ci95_low", "low"), ("ci95_high", "high"))], text(p, f"{level}.lecture").alias("reading"))
    turned = F.create_map(*[F.lit(x) for x in (VERDICTS[0], "compatible with degradation under stress", VERDICTS[1], "compatible with improvement under stress", VERDICTS[2], VERDICTS[2])])
    ci = lambda level: F.array(*[number(own, f"folds.test.bootstrap_ci95.{level}_roc_auc.{s}") for s in ("ci95_low", "ci95_high")])
    result = F.struct(
        run.alias("run_id"), text(own, "model_name").alias("model_name"), text(own, "training_commit").alias("training_commit"), text(m, "split.sha256").alias("split_sha256"),
        *[number(own, f"folds.test.{n}").cast("long").alias(n) for n in ("n_clips", "n_clusters", "n_clusters_leak", "n_clusters_non_leak")],
        *[number(own, f"folds.test.{level}_level.{n}").alias(f"{level}_{n}") for level, names in (("clip", ("roc_auc", "pr_auc", "macro_f1", "brier")), ("cluster", ("roc_auc", "macro_f1"))) for n in names],
        ci("clip").alias("clip_auc_ci"), ci("cluster").alias("cluster_auc_ci"),
        F.array(*[F.struct(F.lit(c).alias("control"), delta(versus(c), "clip_roc_auc").alias("clip"), delta(versus(c), "cluster_roc_auc").alias("cluster")) for c in CONTROLS]).alias("versus"),
        F.transform(stress, lambda e: F.struct(
            F.get(e["value"], F.lit(1)).alias("transform"), e["key"].alias("run_id"), number(stress_run(e), "folds.test.clip_level.roc_auc").alias("clip_auc"), number(stress_run(e), "folds.test.cluster_level.roc_auc").alias("cluster_auc"),
            turned[text(stress_pair(e), "clip_roc_auc.lecture")].alias("clip_verdict"), turned[text(stress_pair(e), "cluster_roc_auc.lecture")].alias("cluster_verdict"),
        )).alias("stress"),
        outcome(F.array(text(versus("c1"), "clip_roc_auc.lecture"), text(versus("c1"), "cluster_roc_auc.lecture"))).alias("outcome"),
    )
    told = one.withColumn("reason", reason)
    return told.select(*by, F.when(F.col("reason").isNull(), "OFFICIAL").otherwise("NOT_EVALUATED").alias("status"), "reason", F.when(F.col("reason").isNull(), result).alias("result"))


def gate_problem(gate: Column, ids: Column, variant: str, versions: dict[str, str]) -> Column:
    """Why a gate (JSON text) doesn't open for a variant, or null: its ids in order, representation, version and flags."""
    v = F.try_parse_json(gate)
    amplitude = variant == "C"
    flag = lambda path: F.when(_is(v, path, "BOOLEAN"), _get(v, path, "boolean"))
    tokens = F.sort_array(F.map_keys(_map(v, "amplitude_tokens")))
    rules = [
        ("json", v.isNotNull()), ("clip_ids", F.try_variant_get(v, "$.clip_ids", "array<string>") == ids), ("amplitude_evidence", flag("amplitude_evidence") == amplitude),
        ("version", text(v, "scoring_spec.version") == versions[variant]), ("batching", text(v, "scoring_spec.acoustic_batching") == "one_clip_four_channels"),
        ("test_opened", flag("test_audio_or_cache_opened") == False), ("metrics_calculated", flag("quality_metrics_calculated") == False),  # noqa: E712
    ]
    if amplitude:
        rules.append(("amplitude_tokens", tokens == F.sort_array(F.array_distinct(ids))))
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules])


# --- chains of digests ------------------------------------------------------------------------------------------------
ARTIFACTS = "name string, content string"
LINKS = "place int, child string, field string, parent string"


def chain_problems(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """(place, link, problem) of the links that don't hold, of ``ARTIFACTS`` (JSON texts) and ``LINKS``.

    A link holds if the child's ``field`` is the digest of the parent's canonical JSON. Names must be unique.
    """
    known = artifacts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("content"))
    side = lambda s: known.select(F.col("name").alias(s), F.col("n").alias(f"{s}_n"), F.try_parse_json("content").alias(f"{s}_v"), digest(F.col("content")).alias(f"{s}_sha256"))
    both = links.join(side("child"), "child", "left").join(side("parent"), "parent", "left")
    says = F.try_variant_get("child_v", F.concat(F.lit("$."), "field"), "string")
    problem = (
        F.when(F.col("child_n").isNull() | F.col("parent_n").isNull(), "missing").when((F.col("child_n") > 1) | (F.col("parent_n") > 1), "ambiguous")
        .when(F.col("child_v").isNull() | F.col("parent_v").isNull(), "not JSON").when(says.isNull(), "no digest").when(says != F.col("parent_sha256"), "other digest")
    )
    return both.select("place", F.concat_ws(".", "child", "field").alias("link"), problem.alias("problem")).filter("problem is not null")


def receipt_problem(receipt: Column, rule: str, split_sha256: str, method_sha256: str) -> Column:
    """Why a threshold's receipt can't be used, or null; the threshold must be a number that its text spells in full."""
    v = F.try_parse_json(receipt)
    value, shown = number(v, "threshold"), text(v, "threshold_repr")
    sound = _finite(v, "threshold") & shown.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    rules = [
        ("json", v.isNotNull()), ("fit_fold", text(v, "fit_fold") == "val"), ("threshold", sound), ("threshold_repr", shown.try_cast("double") == value), ("rule", text(v, "rule") == rule),
        ("split", text(v, "split_sha256") == split_sha256), ("predictions", _like(v, "validation_predictions_sha256", DIGEST)), ("method", text(v, "threshold_method_sha256") == method_sha256),
    ]
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules])


def bound_threshold(artifacts: DataFrame, links: DataFrame, receipt: str, rule: str, split_sha256: str, method_sha256: str) -> float:
    """The threshold of a receipt, only if every link of the chain holds and the receipt is sound; else a refusal with the first broken link's name."""
    broken = chain_problems(artifacts, links).orderBy("place", "link").limit(1).collect()
    if broken:
        raise ValueError(f"link {broken[0]['link']} is broken: {broken[0]['problem']}")
    rows = artifacts.filter(F.col("name") == receipt).select(receipt_problem(F.col("content"), rule, split_sha256, method_sha256).alias("p"), number(F.try_parse_json("content"), "threshold").alias("t")).collect()
    if len(rows) != 1 or rows[0]["p"] is not None:
        raise ValueError(f"receipt {receipt} is refused: {rows[0]['p'] if rows else 'missing'}")
    return rows[0]["t"]


def unchanged_run(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Problems (clip_id, problem) between a run's frozen scores (clip_id, p) and those found now: its scope and every bit of its scores."""
    a, b = declared.select("clip_id", F.col("p").alias("a"), F.lit(True).alias("da")), found.select("clip_id", F.col("p").alias("b"), F.lit(True).alias("db"))
    problem = F.when(F.col("da").isNull(), "unknown").when(F.col("db").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "other score")
    return a.join(b, "clip_id", "full_outer").select("clip_id", problem.alias("problem")).filter("problem is not null")

