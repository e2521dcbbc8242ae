"""Entity resolution: verified pairs, their components, and the registry's reference for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import connected_components


def merge_verdicts(pairs: DataFrame, verdicts: DataFrame | None = None, keys: tuple[str, ...] = ("batch_no", "pair_id")) -> DataFrame:
    """pairs with are_same, updated_name and updated_description of a verifier's answers; verdicts on unknown pairs are ignored, pairs without one are not the same. Without verdicts, pairs have these columns already, null where an answer is
    missing: a verifier that is asked where pairs are made needs no join of all pairs with all answers."""
    if verdicts is None:
        return pairs.withColumn("are_same", F.coalesce("are_same", F.lit(False)))
    said = verdicts.dropDuplicates(list(keys)).select(*keys, "are_same", "updated_name", "updated_description")
    return pairs.join(said, list(keys), "left").withColumn("are_same", F.coalesce("are_same", F.lit(False)))


def updates(verified: DataFrame, order: Column, ident: str = "src") -> DataFrame:
    """For each object on the input side of pairs that are the same: the last name and the last description, each by itself, that isn't empty."""
    same = verified.filter("are_same")

    def last(column: str) -> Column:
        told = F.coalesce(F.length(column) > 0, F.lit(False))
        return F.max_by(F.when(told, F.col(column)), F.when(told, order)).alias(column)

    return same.groupBy(ident).agg(last("updated_name"), last("updated_description"))


def component_of(objects: DataFrame, verified: DataFrame, ident: str = "hash") -> DataFrame:
    """objects with component: the least ident among those reached over verified pairs of inputs; an object without any is its own."""
    edges = verified.filter(F.col("are_same") & F.col("dst").isNotNull()).select("src", "dst")
    found = connected_components(edges).select(F.col("node").alias(ident), "component")
    return objects.join(found, ident, "left").withColumn("component", F.coalesce("component", ident))


def resolve(objects: DataFrame, verified: DataFrame, registry: DataFrame, link_mode: str = "verified", ident: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(resolved, new): every object with component, reference (null where the component is new), is_new and its updated name and description; and for each new component the name and description to insert, by component.

    objects has ident, name, description and maybe reference; verified has src, dst, ref, are_same, updated_name, updated_description and seq. A component's reference is the least that a member has; else, with link_mode "verified",
    the least row of the registry that a member was found the same as; else the least row with the representative's name. With link_mode "name_only" the second isn't looked at.
    """
    if link_mode not in ("verified", "name_only"):
        raise ValueError(f"unknown link_mode: {link_mode}")
    have = objects if "reference" in objects.columns else objects.withColumn("reference", F.lit(None).cast("long"))
    news = updates(verified, F.col("seq")).withColumnRenamed("src", ident)
    members = component_of(have, verified, ident).join(news, ident, "left")
    members = members.withColumn("new_name", F.coalesce("updated_name", "name")).withColumn("new_description", F.coalesce("updated_description", "description"))
    if link_mode == "verified":
        stored = verified.filter(F.col("are_same") & F.col("ref").isNotNull()).groupBy(F.col("src").alias(ident)).agg(F.min("ref").alias("stored"))
        members = members.join(stored, ident, "left")
    else:
        members = members.withColumn("stored", F.lit(None).cast("long"))
    head = F.struct(ident, "new_name", "new_description")
    groups = members.groupBy("component").agg(F.min("reference").alias("own"), F.min("stored").alias("seen"), F.min(head).alias("head"))
    names = registry.groupBy(F.col("name").alias("__name")).agg(F.min("id").alias("named"))
    groups = groups.join(names, F.col("head.new_name") == F.col("__name"), "left").withColumn("found", F.coalesce("own", "seen", "named"))
    new = groups.filter("found is null").select("component", F.col("head.new_name").alias("name"), F.col("head.new_description").alias("description"))
    linked = members.join(groups.select("component", "own", "found"), "component")
    resolved = linked.select(ident, "component", F.col("found").alias("reference"), F.col("own").isNull().alias("is_new"), F.col("new_name").alias("name"), F.col("new_description").alias("description"), (F.col("updated_name").isNotNull() | F.col("updated_description").isNotNull()).alias("has_updates"))
    return resolved, new
