"""Versioned rows: latest, retention, upserts, manifests, precondition checks, lineage and override folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint
from .ranks import first_rows, latest

OPEN = ("draft", "checked")
ACTIVE = ("pending", "running")


def latest_version(rows: DataFrame) -> DataFrame:
    return latest(rows, ["section_id"], [F.col("version")])


def keep_last(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return first_rows(rows, keys, order, most, "_rank").drop("_rank")


def upsert(stored: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, those replaced that a changed row has the keys of, and new ones."""
    return changed.unionByName(stored.join(changed.select(*keys).distinct(), keys, "left_anti"))


def overlay(stored: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with every known live value in place of the stored one; live rows alone add nothing."""
    values = [c for c in stored.columns if c not in keys]
    renamed = live.select(*keys, *[F.col(c).alias(f"_live_{c}") for c in values if c in live.columns])
    joined = stored.join(renamed, keys, "left")
    return joined.select(*keys, *[F.coalesce(f"_live_{c}", c).alias(c) if c in live.columns else F.col(c) for c in values])


def cascade_delete(documents: DataFrame, chunks: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the documents in gone (doc_id); null identifiers stay."""
    return tuple(t.join(gone, "doc_id", "left_anti") for t in (documents, chunks, items))


def interrupted(tasks: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Active tasks that no live worker has are marked as interrupted."""
    known = live.select(*keys).distinct().withColumn("_live", F.lit(True))
    lost = F.col("status").isin(*ACTIVE) & F.col("_live").isNull()
    return tasks.join(known, keys, "left").withColumn("status", F.when(lost, "interrupted").otherwise(F.col("status"))).drop("_live")


def manifest(rows: DataFrame, keys: list[str], name: str, label: str, *content: str) -> DataFrame:
    """One row for each keyed input: its label and the digest of its content."""
    return rows.select(*keys, F.col(name).cast("string").alias("input"), F.col(label).cast("string").alias("label"), fingerprint(*[F.col(c) for c in content]).alias("sha"))


def manifest_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs that were added, removed or changed between two manifests."""
    a = old.select(*keys, "input", F.col("label").alias("old_label"), F.col("sha").alias("old_sha"))
    b = new.select(*keys, "input", F.col("label").alias("new_label"), F.col("sha").alias("new_sha"))
    both = a.join(b, [*keys, "input"], "full").filter(~F.col("old_sha").eqNullSafe(F.col("new_sha")))
    change = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").otherwise("changed")
    return both.select(*keys, "input", F.coalesce("new_label", "old_label").alias("label"), change.alias("change"))


def conflicts(writes: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Writes with accepted: whether their base revision is the current one (null-safe)."""
    return writes.join(current.select(*keys, F.col("revision").alias("_now")), keys, "left").withColumn("accepted", F.col("base_revision").eqNullSafe(F.col("_now"))).drop("_now")


def supersede(proposals: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Only the newest open proposal of a section stays open; closed ones are left as they are."""
    rank = F.row_number().over(Window.partitionBy(*keys, F.col("status").isin(*OPEN)).orderBy(*order))
    older = F.col("status").isin(*OPEN) & (rank > 1)
    return proposals.withColumn("status", F.when(older, "superseded").otherwise(F.col("status")))


def merge_trees(client: DataFrame, server: DataFrame, owned: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes as the client has them, with the server's values in owned columns where it knows the node; and the removed identifiers."""
    kept = server.select("id", *[F.col(c).alias(f"_server_{c}") for c in owned], F.lit(True).alias("_known"))
    merged = client.join(kept, "id", "left")
    merged = merged.select(*[F.when(F.col("_known"), F.col(f"_server_{c}")).otherwise(F.col(c)).alias(c) if c in owned else F.col(c) for c in client.columns])
    return merged, server.select("id").join(client.select("id"), "id", "left_anti")


def lineage(rows: DataFrame, start: DataFrame, most: int = 20) -> DataFrame:
    """start_id, id and depth along parent_id from each start, as long as origin and section stay the same, at most `most` rows.

    One join for each step, none larger than the chains that still go on.
    """
    parents = rows.select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent"), F.col("origin").alias("_origin"), F.col("section_id").alias("_section"))
    own = start.select(F.col("id").alias("_id")).distinct().join(parents, "_id")
    step = own.select(F.col("_id").alias("start_id"), F.col("_id").alias("id"), F.lit(0).alias("depth"), "_parent", "_origin", "_section")
    out = step
    for depth in range(1, most):
        up = parents.select(F.col("_id").alias("id"), F.col("_parent").alias("_up"), F.col("_origin").alias("_o"), F.col("_section").alias("_s"))
        step = step.drop("id", "depth").join(up, (F.col("_parent") == F.col("id")) & F.col("_o").eqNullSafe(F.col("_origin")) & F.col("_s").eqNullSafe(F.col("_section")))
        step = step.select("start_id", "id", F.lit(depth).alias("depth"), F.col("_up").alias("_parent"), "_origin", "_section")
        out = out.unionByName(step)
    return out.select("start_id", "id", "depth")


def apply_overrides(clauses: DataFrame, overrides: DataFrame) -> DataFrame:
    """Clauses (id, text, points) after their confirmed overrides, in confirmed order; a row each, also of withdrawn clauses.

    An override replaces, appends to or revokes the text, if its basis is the fingerprint of the text and points that it
    meets; one that meets another text stops the fold with an error that names its place, and the text from before stays.
    """
    confirmed = overrides.filter("state = 'confirmed'").groupBy(F.col("clause_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("confirmed_order", "action", "text", "basis"))).alias("steps")
    )
    joined = clauses.join(confirmed, "id", "left")
    start = F.struct(F.col("text").alias("text"), F.lit(True).alias("active"), F.lit(None).cast("int").alias("error"))

    def apply(state: Column, step: Column) -> Column:
        meets = step["basis"].eqNullSafe(fingerprint(state["text"], F.col("points")))
        changed = F.when(step["action"] == "append", F.concat(F.coalesce(state["text"], F.lit("")), F.lit("\n"), step["text"])).when(step["action"] == "replace", step["text"]).otherwise(state["text"])
        done = F.struct(changed.alias("text"), (state["active"] & (step["action"] != "revoke")).alias("active"), F.lit(None).cast("int").alias("error"))
        failed = F.struct(state["text"].alias("text"), state["active"].alias("active"), step["confirmed_order"].cast("int").alias("error"))
        return F.when(state["error"].isNotNull(), state).when(meets, done).otherwise(failed)

    none = F.array().cast(confirmed.schema["steps"].dataType)
    folded = joined.withColumn("state", F.aggregate(F.coalesce("steps", none), start, apply))
    return folded.select("id", "points", F.col("state.text").alias("text"), F.col("state.active").alias("active"), F.col("state.error").alias("error"))
