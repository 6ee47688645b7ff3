"""Saved views against a catalog.

``views`` is [view, line, path, held_axes]: one row per line a view draws, plus
one for its time base; ``held_axes`` is how many axes the line's subscript holds
at an index.  ``nodes`` has ``kind`` and, for datasets, ``type`` (the type's
description), ``numeric`` and ``rank``.

Datasets of structs can be drawn by a member: ``nodes`` may have ``members``, a map
from each member's name to (type, numeric, rank), null where there are none, and
``views`` a column ``member``, null or empty where a line names none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.sources.catalog import DATASET, UNRESOLVED

# The states of a view, best first.
STATES = ("full", "partial", "none")


def _facts(nodes: DataFrame) -> DataFrame:
    none = F.lit(None).cast("map<string, struct<type: string, numeric: boolean, rank: int>>").alias("members")
    return nodes.select("path", "kind", "type", "numeric", "rank", F.col("members") if "members" in nodes.columns else none)


def _problem() -> Column:
    """Why a path cannot be drawn; null when it can.  A struct can, by a member."""
    return (
        F.when(F.col("kind").isNull(), F.lit("missing"))
        .when(F.col("kind") == UNRESOLVED, F.lit("link without an object"))
        .when(F.col("kind") != DATASET,
              F.concat(F.lit("no dataset: "), F.lower("kind")))
        .when(F.col("rank").isNull(), F.lit("no elements"))
        .when(~F.col("numeric") & F.col("members").isNull(),
              F.concat(F.lit("not numeric: "), F.col("type")))
        .when(F.col("rank") == 0, F.lit("single value"))
    )


def _member_problem() -> Column:
    """Why the member a line names, or the lack of one, cannot be drawn."""
    named = F.coalesce(F.trim("member"), F.lit("")) != ""
    kind = F.element_at("members", F.col("member"))
    return (
        F.when(named & F.col("members").isNull(), F.concat(F.lit("no struct: "), F.col("type")))
        .when(named & kind.isNull(), F.concat(F.lit("no member "), F.col("member")))
        .when(named & ~kind["numeric"], F.concat(F.lit("not numeric: "), kind["type"]))
        .when(~named & F.col("members").isNotNull(), F.lit("a struct without a member"))
    )


def view_match(views: DataFrame, nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """[view, named, here, state]: how much of a view's datasets a file serves.

    ``names`` lists every view, so one that names nothing is there as ``none``.
    """
    wanted = views.where(F.trim("path") != "").select("view", "path").distinct()
    found = wanted.join(_facts(nodes), "path", "left").withColumn("_ok", _problem().isNull())
    counted = found.groupBy("view").agg(F.count(F.lit(1)).alias("named"), F.count(F.when(F.col("_ok"), 1)).alias("here"))
    if names is not None:
        counted = names.select("view").join(counted, "view", "left").na.fill(0, ["named", "here"])
    state = (F.when(F.col("here") == 0, F.lit("none")).when(F.col("here") == F.col("named"), F.lit("full"))
             .otherwise(F.lit("partial")))
    return counted.withColumn("state", state)


def view_issues(views: DataFrame, nodes: DataFrame) -> DataFrame:
    """[view, line, path, reason] of every line of a view that cannot be drawn.

    A line is drawn when its subscript leaves exactly one axis.
    """
    if "member" not in views.columns:
        views = views.withColumn("member", F.lit(None).cast("string"))
    # A member's own axes come after the dataset's.
    more = F.coalesce(F.element_at("members", F.col("member"))["rank"], F.lit(0))
    left = F.col("rank") - F.col("held_axes")
    shape = (
        F.when(F.col("held_axes") > F.col("rank"), F.concat(F.col("held_axes").cast("string"), F.lit(" subscripts for "),
                                                            F.col("rank").cast("string"), F.lit(" axes")))
        .when(left == 0, F.lit("not one line: one element"))
        .when(left > 1, F.concat(F.lit("not one line: "), left.cast("string"), F.lit(" axes left")))
    )
    joined = views.join(_facts(nodes), "path", "left")
    checked = joined.withColumns({"_problem": F.coalesce(_problem(), _member_problem()), "rank": F.col("rank") + more}).withColumn(
        "reason", F.coalesce("_problem", shape))
    return checked.where(F.col("reason").isNotNull()).select("view", "line", "path", "reason")


def issue_counts(issues: DataFrame) -> DataFrame:
    """[view, reason, issues]: how many lines of each view have which problem.

    The lines themselves stay rows of ``view_issues``: a view may name millions.
    """
    return issues.groupBy("view", "reason").agg(F.count(F.lit(1)).alias("issues"))


def rank_views(matched: DataFrame) -> DataFrame:
    """Full, then partial, then none; then by name without case, then by name."""
    place = F.coalesce(*[F.when(F.col("state") == s, F.lit(k)) for k, s in enumerate(STATES)])
    return matched.orderBy(place, F.lower("view"), "view")
