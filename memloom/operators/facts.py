"""Adjudication of explicit facts: validity, replacement, cycles, conflict."""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.shared import delete_stored, stored

# Replacements that a fact may name, and members of a group that are read.
MOST_REFERENCES, GROUP_LIMIT = 16, 100
#: References of a partition that one task peels whole.
GROUP_EDGES = 20_000
PARTITION = ["user_id", "scope", "scope_identity", "kind", "fact_group"]


def temporal(valid_from: Column, valid_until: Column, at: Column) -> Column:
    """Half-open validity: not_yet_valid, expired or null."""
    return F.when(at < valid_from, "not_yet_valid").when(at >= valid_until, "expired")


def references(facts: DataFrame, at: Column, by: list[str] = PARTITION) -> DataFrame:
    """Replacements named by active facts: partition, memory_id, replaces, resolved (a sibling has that id, source event and version).

    ``facts.replaces``: array of struct<memory_id, source_event_id, version>, MOST_REFERENCES at most (more raise); null is none.
    """
    bounded = F.when(F.size("replaces") > MOST_REFERENCES, F.raise_error(F.lit(f"a fact names more than {MOST_REFERENCES} replacements")).cast(facts.schema["replaces"].dataType)).otherwise(F.col("replaces"))
    active = facts.where(temporal(F.col("valid_from"), F.col("valid_until"), at).isNull()).select(*by, "memory_id", F.explode(bounded).alias("ref"))
    named = active.select(*by, "memory_id", F.col("ref.memory_id").alias("replaces"), F.col("ref.source_event_id").alias("source_event_id"), F.col("ref.version").alias("version"))
    siblings = facts.select(*by, F.col("memory_id").alias("replaces"), "source_event_id", "version").distinct().withColumn("found", F.lit(True))
    met = named.join(siblings, [*by, "replaces", "source_event_id", "version"], "left")
    return met.select(*by, "memory_id", "replaces", F.col("found").isNotNull().alias("resolved")).distinct()


def cyclic_groups(refs: DataFrame, by: list[str] = PARTITION) -> DataFrame:
    """Partitions with a cycle, found by peeling: a reference whose target has none of its own is dropped, until nothing changes; what is left
    runs in circles. No path is built, and edges only ever get fewer.

    Partitions of up to GROUP_EDGES references are peeled whole, one in a task's memory at a time; larger ones by rounds of semi-joins over all of them.
    """
    edges = stored(refs.where("resolved").select(*by, "memory_id", "replaces").distinct(), "edges")
    sizes = edges.groupBy(*by).agg(F.count("*").alias("edges"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.select(*by).schema)

    def peel(group: pd.DataFrame) -> pd.DataFrame:
        targets, named_by = Counter(group.memory_id), defaultdict(list)
        for fact, target in zip(group.memory_id, group.replaces, strict=True):
            named_by[target].append(fact)
        done = [t for t in named_by if t not in targets]
        while done:
            for fact in named_by[done.pop()]:
                targets[fact] -= 1
                if not targets[fact]:
                    done.append(fact)
        return group[by].head(int(any(targets.values())))

    small = edges.join(sizes.where(F.col("edges") <= GROUP_EDGES).drop("edges"), by).groupBy(*by).applyInPandas(peel, kinds)
    large = edges.join(sizes.where(F.col("edges") > GROUP_EDGES).drop("edges"), by, "left_semi")
    if not large.isEmpty():
        left = stored(large, "peeled")
        before, now = None, left.count()
        while now and now != before:
            live = left.select(*by, F.col("memory_id").alias("replaces")).distinct()
            kept = stored(left.join(live, [*by, "replaces"], "left_semi").select(*left.columns), "peeled")
            delete_stored(left)
            left, before, now = kept, now, kept.count()
        small = small.unionAll(left.select(*by).distinct())
    return small.withColumn("cyclic", F.lit(True))


def adjudicate(facts: DataFrame, at: Column, by: list[str] = PARTITION) -> DataFrame:
    """``facts`` with status, usable and reason; ``by``: what siblings share. Equal keys meet once: all flags come from one grouping a partition."""
    refs = references(facts, at, by)
    broken = refs.where("NOT resolved").select(*by).distinct().withColumn("broken", F.lit(True))
    replaced = refs.where("resolved").select(*by, F.col("replaces").alias("memory_id")).distinct().withColumn("replaced", F.lit(True))
    timed = facts.withColumn("temporal", temporal(F.col("valid_from"), F.col("valid_until"), at))
    marked = (timed.join(broken, by, "left").join(cyclic_groups(refs, by), by, "left").join(replaced, [*by, "memory_id"], "left")
              .withColumn("stands", F.col("temporal").isNull() & F.col("replaced").isNull()))
    groups = marked.where("stands").groupBy(*by).agg(F.count("*").alias("standing"), F.countDistinct("fact_value").alias("values"))
    judged = marked.join(groups, by, "left")
    open_ = F.col("broken").isNotNull() | F.col("cyclic").isNotNull()
    status = (F.when(F.col("temporal").isNotNull(), F.col("temporal")).when(open_, "unresolved").when(F.col("replaced").isNotNull(), "superseded")
              .when(F.col("values") > 1, "conflict").when(F.col("standing") > 1, "consistent_assertions").otherwise("active_assertion"))
    reason = (F.when(F.col("temporal") == "expired", "validity_end").when(F.col("temporal").isNotNull(), "validity_start").when(F.col("cyclic").isNotNull(), "replacement_cycle")
              .when(F.col("broken").isNotNull(), "unverified_reference").when(F.col("replaced").isNotNull(), "verified_replacement").when(F.col("values") > 1, "different_visible_values")
              .when(F.col("standing") > 1, "equal_visible_values").otherwise("single_visible_assertion"))
    return judged.select(*facts.columns, status.alias("status"), status.isin("active_assertion", "consistent_assertions").alias("usable"), reason.alias("reason"))


def over_budget_groups(facts: DataFrame, limit: int) -> DataFrame:
    """Partitions too large to be read whole: all their members are unusable."""
    return facts.groupBy(*PARTITION).agg(F.count("*").alias("members")).withColumn("truncated", F.col("members") > limit)


def resolve(ranked: DataFrame, facts: DataFrame, requests: DataFrame, at: Column, limit: int = GROUP_LIMIT) -> DataFrame:
    """``ranked`` (request_id, memory_id, final_rank) with status, usable, reason, coverage and accepted_rank (null: omitted).

    A ranked memory with a fact is judged within its group as the request sees it: private siblings count only for requests (request_id,
    include_private, require_confirmed) that include them. Of each group that any list touches, ``limit`` + 1 members are read, the latest
    first: the bound holds in every task before members are shuffled, so a group of any size costs no more; one over the limit is
    unresolved. Memories without a fact stay, unannotated. ``facts``: PARTITION, memory_id, source_event_id, version, fact_value,
    valid_from, valid_until, replaces, sensitivity, user_confirmed, updated_at.
    """
    by = [*PARTITION, "include_private", "require_confirmed"]
    own = facts.select("memory_id", *PARTITION)
    placed = ranked.join(own, "memory_id").join(requests.select("request_id", "include_private", "require_confirmed"), "request_id")
    held = stored(placed.select("request_id", "memory_id", *by).distinct(), "placed")
    touched = held.select(*by).distinct()
    seen = facts.join(touched, PARTITION).where((F.col("include_private") | (F.col("sensitivity") != "private")) & (~F.col("require_confirmed") | F.col("user_confirmed")))
    w = Window.partitionBy(*by).orderBy(F.desc("updated_at"), F.desc("memory_id"))
    members = stored(seen.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= limit + 1), "members")
    over = members.where(F.col("__place") > limit).select(*by).withColumn("over", F.lit(True))
    judged = adjudicate(members.join(over, by, "left_anti").drop("__place"), at, by).select(*by, "memory_id", "status", "usable", "reason")
    met = held.join(over, by, "left").join(judged, [*by, "memory_id"], "left").select("request_id", "memory_id", "over", "status", "usable", "reason")
    decided = ranked.join(met.withColumn("fact", F.lit(True)), ["request_id", "memory_id"], "left")
    none, beyond = F.col("fact").isNull(), F.col("over").isNotNull()
    pick = lambda a, b, c: F.when(none, F.lit(a)).when(beyond, F.lit(b)).otherwise(c)
    usable = pick(True, False, F.coalesce("usable", F.lit(False)))
    out = decided.select(*ranked.columns, pick("unannotated", "unresolved", F.col("status")).alias("status"), usable.alias("usable"), pick("legacy_unverified", "group_budget", F.col("reason")).alias("reason"),
                         pick("not_applicable", "truncated", F.lit("visible_filtered_group")).alias("coverage"))
    order = Window.partitionBy("request_id", "usable").orderBy("final_rank")
    return out.withColumn("accepted_rank", F.when(F.col("usable"), F.row_number().over(order)))


def review(resolved: DataFrame) -> DataFrame:
    """request_id, accepted, omitted (memory ids and reasons in order of rank) of each request."""
    left_out = F.array_sort(F.collect_list(F.when(~F.col("usable"), F.struct("final_rank", "memory_id", "reason"))))
    return resolved.groupBy("request_id").agg(F.count_if("usable").alias("accepted"), F.transform(left_out, lambda x: F.struct(x["memory_id"].alias("memory_id"), x["reason"].alias("reason"))).alias("omitted"))
