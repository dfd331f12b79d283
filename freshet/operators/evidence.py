"""Provenance of models: identities of definitions, recipes, finalised candidates, promotions and pinned rows.

Each rule gives the rows that break it (see `validation`), so a guard is a query that comes back empty."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.validation import raise_if_any
from freshet.session import small_side


def definition_id(definition: Mapping, digits: int = 64) -> str:
    """The SHA-256 (or its first digits) of a definition as JSON with sorted keys and no spaces."""
    text = json.dumps(definition, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()[:digits]


def definition_column(**parts: Column) -> Column:
    """The SHA-256 of each row's definition, as `definition_id` makes it: JSON with sorted keys and no spaces."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def own_parameters(parameters: Mapping, reserved: Sequence[str]) -> dict:
    """The parameters of an estimator without those that the library sets itself."""
    return {k: v for k, v in parameters.items() if k not in set(reserved)}


def owner(**keys: Column) -> Column:
    """`kind:key` of the only key that is set; NULL where none is or several are."""
    n = sum((k.isNotNull().cast("int") for k in keys.values()), F.lit(0))
    named = F.coalesce(*[F.concat(F.lit(f"{kind}:"), k.cast("string")) for kind, k in keys.items()])
    return F.when(n == 1, named)


def recipe_matches(candidates: DataFrame, finalised: DataFrame, artifacts: DataFrame, recipe: Sequence[str]) -> DataFrame:
    """candidate_id, model_id where a finalised candidate and an artifact agree on the whole recipe (no NULL agrees)."""
    done = candidates.join(finalised.select("candidate_id").distinct(), "candidate_id", "left_semi")
    return done.join(artifacts, list(recipe)).select("candidate_id", "model_id")


def recipe_counts(candidates: DataFrame, finalised: DataFrame, artifacts: DataFrame, recipe: Sequence[str]) -> DataFrame:
    """candidate_id, n, least and most: how many rows of `recipe_matches` a candidate has, and the least and greatest model_id
    among them. Artifacts are summed up by recipe before the join, so no pairs are made."""
    done = candidates.join(finalised.select("candidate_id").distinct(), "candidate_id", "left_semi")
    per = artifacts.groupBy(*recipe).agg(F.count(F.lit(1)).alias("n"), F.min("model_id").alias("least"), F.max("model_id").alias("most"))
    return done.join(small_side(per), list(recipe)).groupBy("candidate_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def links_off_recipe(links: DataFrame, candidates: DataFrame, finalised: DataFrame, artifacts: DataFrame, recipe: Sequence[str]) -> DataFrame:
    """Links that aren't among the `recipe_matches`. Each link looks up its own candidate and its own artifact, so work grows
    with the links, not with the pairs that share a recipe."""
    done = candidates.join(finalised.select("candidate_id").distinct(), "candidate_id", "left_semi").select("candidate_id", *recipe)
    fitting = links.select("candidate_id", "model_id").distinct().join(done, "candidate_id").join(artifacts.select("model_id", *recipe), ["model_id", *recipe], "left_semi")
    return unmatched_links(links, fitting.select("candidate_id", "model_id"))


def unmatched_links(links: DataFrame, matches: DataFrame) -> DataFrame:
    """Links (candidate_id, model_id) whose recipes don't match."""
    return links.join(matches, ["candidate_id", "model_id"], "left_anti")


def candidate_coverage(candidates: DataFrame, links: DataFrame, evaluations: DataFrame, members: DataFrame, results: DataFrame, oof: DataFrame) -> DataFrame:
    """candidate_id, fold_count, complete and other evaluations, results of validation runs without an out-of-fold row, and
    whether the candidate may be finalised: one COMPLETE evaluation a fold, none else, nothing uncovered."""
    linked = links.join(evaluations.select("evaluation_id", "status"), "evaluation_id")
    done = F.count_if(F.col("status") == "COMPLETE")
    states = linked.groupBy("candidate_id").agg(done.alias("complete"), (F.count(F.lit(1)) - done).alias("other"))
    wanted = linked.join(members.filter(F.col("role") == "validation"), "evaluation_id").join(results.select("run_id", "node_id"), "run_id")
    open_ = wanted.join(oof.select("evaluation_id", "run_id", "node_id").distinct(), ["evaluation_id", "run_id", "node_id"], "left_anti")
    gaps = open_.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("uncovered"))
    out = candidates.select("candidate_id", "fold_count").join(states, "candidate_id", "left").join(gaps, "candidate_id", "left").fillna(0, ["complete", "other", "uncovered"])
    return out.withColumn("final", (F.col("complete") == F.col("fold_count")) & (F.col("other") == 0) & (F.col("uncovered") == 0))


def unmatched_promotions(promotions: DataFrame, winners: DataFrame, links: DataFrame) -> DataFrame:
    """Promotions whose metric, value or artifact isn't the winner's of their ranking. winners: ranking_id, primary_metric,
    value, candidate_id (NULL: no artifact is asked for)."""
    pairs = links.select(F.col("candidate_id"), F.col("model_id")).distinct().withColumn("_linked", F.lit(True))
    wide = promotions.join(winners.withColumnsRenamed({"primary_metric": "_metric", "value": "_value"}), "ranking_id", "left").join(pairs, ["candidate_id", "model_id"], "left")
    fits = (F.col("primary_metric") == F.col("_metric")) & (F.col("primary_value") == F.col("_value")) & (F.col("candidate_id").isNull() | F.col("_linked"))
    return wide.filter(~F.coalesce(fits, F.lit(False))).select("promotion_id", "ranking_id")


def changed_pinned(current: DataFrame, batch: DataFrame, pinned: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that training pins and that a batch would change or delete (a batch row with other values, or `deleted`)."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in current.columns if c not in keys]
    both = batch.join(pinned.select(*keys).distinct(), keys, "left_semi").join(current.select(*keys, F.struct(*rest).alias("_now")), keys)
    return both.filter(F.coalesce(F.col("deleted"), F.lit(False)) | ~F.struct(*rest).eqNullSafe(F.col("_now"))).select(*keys)


def guarded_update(current: DataFrame, batch: DataFrame, pinned: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """The current rows with those of a batch in place; rows that training pins may not change."""
    keys = [key] if isinstance(key, str) else list(key)
    raise_if_any(changed_pinned(current, batch, pinned, keys), "rows are pinned by training")
    return current.join(batch.select(*keys), keys, "left_anti").unionByName(batch.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted"))


def registered(registry: DataFrame, batch: DataFrame, key: str = "run_id", number: str = "artifact_id") -> DataFrame:
    """The registry with a batch of artifacts behind it, numbered on from its greatest number. A batch is a folder listing."""
    from freshet.operators.folds import sample_index

    start = registry.agg(F.coalesce(F.max(number), F.lit(0)).alias("_start"))
    fresh = sample_index(batch, key).join(F.broadcast(start)).withColumn(number, (F.col("_start") + F.col("sample_idx") + 1).cast("long"))
    return registry.unionByName(fresh.select(*registry.columns))


def artifact_sizes(series: DataFrame, key: str, node: str, step: str) -> DataFrame:
    """Rows, distinct nodes and whole steps a node of each artifact."""
    out = series.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(node).alias("nodes"))
    return out.withColumn("steps", F.floor(F.col("rows") / F.greatest("nodes", F.lit(1))))


def first_run(artifacts: DataFrame, by: str, multiplier: str, key: str) -> DataFrame:
    """The artifact with the lowest multiplier of each group (ties: the least key; a value that is missing comes last): what
    a surrogate scales from. Groups are few and large, so each task first finds its own least."""
    rank = F.struct(*[x for c in (multiplier, key) for x in (F.col(c).isNull(), F.col(c))])
    return artifacts.groupBy(F.col(by).alias("_by")).agg(F.min_by(F.struct(*artifacts.columns), rank).alias("_row")).select("_row.*")


def outside_manifest(manifest: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys of a manifest that aren't known."""
    return manifest.select(key).distinct().join(known.select(key), key, "left_anti")
