"""The catalog: named objects, links, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.runtime import written

GROUP, DATASET, NAMED_TYPE, UNRESOLVED = "Group", "Dataset", "NamedType", "Unresolved"

def normalised(path: str | Column) -> Column:
    """A path with one separator between names and none at its end."""
    column = F.col(path) if isinstance(path, str) else path
    return F.concat(F.lit("/"), F.trim(F.regexp_replace(column, "/+", "/"), F.lit("/")))


def depth_of(path: str | Column) -> Column:
    """Names along a normalised path; the root has none."""
    column = F.col(path) if isinstance(path, str) else path
    slashes = F.length(column) - F.length(F.replace(column, F.lit("/"), F.lit("")))
    return F.when(column == "/", 0).otherwise(slashes)


def name_of(path: str | Column) -> Column:
    column = F.col(path) if isinstance(path, str) else path
    return F.when(column == "/", F.lit("/")).otherwise(F.substring_index(column, "/", -1))


def parent_of(path: str | Column) -> Column:
    column = F.col(path) if isinstance(path, str) else path
    above = F.substring_index(column, "/", -1)
    cut = F.left(column, F.greatest(F.length(column) - F.length(above) - 1, F.lit(1)))
    return F.when(column != "/", cut)


def with_ancestors(df: DataFrame, path: str, name: str, own: bool = False) -> DataFrame:
    """One row per group above ``path``, its path in ``name`` and its depth in
    ``_depth``; with ``own``, the path itself too.

    Prefixes are cut with string functions, which stay in generated code.
    """
    last = depth_of(path) - (0 if own else 1)
    opened = df.where(last >= 0).withColumn("_depth", F.explode(F.sequence(F.lit(0), last)))
    prefix = F.expr(f"CASE WHEN _depth = 0 THEN '/' ELSE substring_index({path}, '/', _depth + 1) END")
    return opened.withColumn(name, prefix)


def build_nodes(paths: DataFrame, kind: str = DATASET) -> DataFrame:
    """Node table of a path listing: every path and every group above it.

    ``paths`` has ``path`` and, where links or kinds are known, ``kind``,
    ``link`` and ``target``.  A path with others below it is a group.  The
    groups above are combined per task before the shuffle, so a root above
    everything costs one row a task.
    """
    listed = paths.withColumn("path", normalised("path"))
    above = with_ancestors(listed.select("path"), "path", "_above").select(F.col("_above").alias("path"))
    facts = [c for c in ("kind", "link", "target") if c in paths.columns]
    hard, nothing = F.lit("hard"), F.lit(None).cast("string")
    if not facts:
        every = listed.select("path", F.lit(0).alias("_g")).unionByName(above.withColumn("_g", F.lit(1)))
        nodes = every.groupBy("path").agg(F.max("_g").alias("_g")).withColumns({"link": hard, "target": nothing})
        said = F.lit(kind)
    else:
        known = listed.select("path", *facts).distinct()
        nodes = known.join(above.distinct().withColumn("_g", F.lit(1)), "path", "full")
        nodes = nodes.withColumns({
            "link": F.coalesce("link", hard) if "link" in facts else hard,
            "target": F.col("target") if "target" in facts else nothing})
        said = F.coalesce("kind", F.lit(kind)) if "kind" in facts else F.lit(kind)
    return nodes.select("path", name_of("path").alias("name"), parent_of("path").alias("parent"),
                        F.when(F.col("_g") == 1, F.lit(GROUP)).otherwise(said).alias("kind"), "link", "target")


def children(nodes: DataFrame, path: str) -> DataFrame:
    """Immediate children, in increasing order of name."""
    return nodes.where(F.col("parent") == path).orderBy("name")


def member_counts(nodes: DataFrame) -> DataFrame:
    """[path, members] of every group; an empty one has none."""
    counts = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("path")).agg(
        F.count(F.lit(1)).alias("members"))
    groups = nodes.where(F.col("kind") == GROUP).select("path")
    return groups.join(counts, "path", "left").select("path", F.coalesce("members", F.lit(0)).alias("members"))


def _followed(links: DataFrame, hops: int | None = None) -> list[DataFrame]:
    """Where ``links`` [path, goal] end: tables of [path, goal, used], together a row for each.

    The topmost part of a goal that is a link itself is what has to be followed first.  A
    link waits for that one; links that wait for each other in a circle have no end and
    their goal is null.  Two kinds of rows: settled ones, which no link is part of any
    more, are written once and never joined among the open ones again; open ones go on.
    In a phase every open link jumps along the chain it waits for, in steps of 1, 2, 4, …
    links, to the link the chain ends with; what is still waiting after as many links as
    there are open is in a circle.  What a settled link puts in for itself is free of links,
    so a goal has fewer parts that may be links after each phase, and the phases end.
    """
    paths = links.select(F.col("path").alias("_part"))
    open_ = links.select("path", "goal", F.lit(1).cast("long").alias("used"))
    settled: list[DataFrame] = []
    while True:
        parts = with_ancestors(open_.where(F.col("goal").isNotNull()), "goal", "_part", own=True).where(F.col("_depth") > 0)
        first = parts.select("path", "_depth", "_part").join(paths, "_part").groupBy("path").agg(F.min(F.struct("_depth", "_part")).alias("_s"))
        part = F.col("_s._part")
        over = part == F.col("path") if hops is None else (part == F.col("path")) | (F.col("used") > hops)
        state = open_.join(first, "path", "left").select(
            "path", F.when(F.coalesce(over, F.lit(False)), F.lit(None).cast("string")).otherwise(F.col("goal")).alias("goal"), "used",
            F.when(~F.coalesce(over, F.lit(False)), part).alias("next"),
            F.expr("substring(goal, length(_s._part) + 1)").alias("rest"))
        state = written(state, "waiting")
        done = state.where("next IS NULL").select("path", "goal", "used")
        waiting = state.where("next IS NOT NULL")
        count = waiting.count()
        settled.append(done)
        if not count:
            return settled
        # What is waited for: a settled link of before, one settled just now, or a waiting one.
        known = settled[0]
        for table in settled[1:]:
            known = known.unionByName(table)
        known = known.select(F.col("path").alias("next"), F.col("goal").alias("_goal"), F.col("used").alias("_used"), F.lit(True).alias("_known"))
        chain = written(waiting.join(known, "next", "left").select(
            "path", F.when(F.col("_known"), F.concat("_goal", "rest")).alias("goal"), (F.col("used") + F.coalesce("_used", F.lit(0))).alias("used"),
            F.when(F.col("_known").isNull(), F.col("next")).alias("next"), "rest"), "chain")
        jumped = 1
        while not chain.where("next IS NOT NULL").isEmpty():
            if jumped >= count:
                chain = chain.withColumns({"goal": F.when(F.col("next").isNull(), F.col("goal")), "next": F.lit(None).cast("string")})
                break
            ahead = chain.select(F.col("path").alias("next"), F.col("goal").alias("_goal"), F.col("used").alias("_used"),
                                 F.col("next").alias("_next"), F.col("rest").alias("_rest"))
            stay = chain.where("next IS NULL")
            moved = chain.where("next IS NOT NULL").join(ahead, "next").select(
                "path", F.when(F.col("_next").isNull(), F.concat("_goal", "rest")).alias("goal"), (F.col("used") + F.col("_used")).alias("used"),
                F.col("_next").alias("next"), F.concat("_rest", "rest").alias("rest"))
            chain = written(stay.unionByName(moved), "chain")
            jumped *= 2
        open_ = chain.select("path", "goal", "used")


def _goal_of(target: str = "target", parent: str = "parent") -> Column:
    return normalised(F.when(F.col(target).startswith("/"), F.col(target)).otherwise(F.concat_ws("/", parent, target)))


def resolve_links(nodes: DataFrame, hops: int | None = None) -> DataFrame:
    """``nodes`` with ``resolved``, the path of the object each one stands for.

    A soft link is followed to its object, through other soft links where its
    target is one or lies below one; a relative target starts at the link's own
    group.  A loop or a target that is not there resolve to nothing, and the node's
    kind is Unresolved; so do more than ``hops`` links in a row where that is given.
    Chains have no bound (``_followed``).  External links keep the kind they have;
    ``resolve_external`` follows them.
    """
    nodes = written(nodes.select("path", "name", "parent", "kind", "link", "target"), "nodes")  # made once, read three times
    links = written(nodes.where(F.col("link") == "soft").select("path", _goal_of().alias("goal")), "links")
    ends = None
    for table in _followed(links, hops):
        ends = table if ends is None else ends.unionByName(table)
    if hops is not None:
        ends = ends.where(F.col("used") <= hops)
    objects = nodes.where(F.col("link") == "hard").select(F.col("path").alias("goal"), F.col("kind").alias("_kind"))
    found = ends.join(objects, "goal").select("path", F.col("goal").alias("_goal"), "_kind")
    is_soft = F.col("link") == "soft"
    return nodes.join(found, "path", "left").select(
        "path", "name", "parent",
        F.when(is_soft, F.coalesce("_kind", F.lit(UNRESOLVED))).otherwise(F.col("kind")).alias("kind"),
        "link", "target",
        F.when(is_soft, F.col("_goal")).when(F.col("link") == "hard", F.col("path")).alias("resolved"))


def resolve_external(catalogs: DataFrame, hops: int | None = None) -> DataFrame:
    """Links followed through the catalogs of several files: ``catalogs``, with
    ``resolved_file, resolved`` and the kind of the object each node stands for.

    ``catalogs`` is [file, path, name, parent, kind, link, target, link_file], a row for each node of
    each file; an external link names a path in another file and is followed there, through
    that file's own links, soft or external.  A file that is not there, a target that is not
    there and a circle, also through several files, are Unresolved.
    """
    # One name for a path in a file, a file being a group above everything in it.
    home = F.concat(F.lit("/"), F.hex(F.encode("file", "utf-8")))
    away = F.concat(F.lit("/"), F.hex(F.encode("link_file", "utf-8")))
    within = lambda top, path: F.concat(top, F.when(path == "/", F.lit("")).otherwise(path))
    is_link = F.col("link").isin("soft", "external")
    placed = catalogs.withColumn("_at", within(home, F.col("path")))
    goal = F.when(F.col("link") == "external", within(away, normalised("target"))).otherwise(within(home, _goal_of()))
    links = written(placed.where(is_link & goal.isNotNull()).select(F.col("_at").alias("path"), goal.alias("goal")), "links")
    ends = None
    for table in _followed(links, hops):
        ends = table if ends is None else ends.unionByName(table)
    if hops is not None:
        ends = ends.where(F.col("used") <= hops)
    objects = placed.where(F.col("link") == "hard").select(
        F.col("_at").alias("goal"), F.col("kind").alias("_kind"), F.col("file").alias("_file"), F.col("path").alias("_path"))
    found = ends.join(objects, "goal").select(F.col("path").alias("_at"), "_kind", "_file", "_path")
    return placed.join(found, "_at", "left").select(
        *[F.when(is_link, F.coalesce("_kind", F.lit(UNRESOLVED))).otherwise(F.col("kind")).alias("kind") if c == "kind" else F.col(c) for c in catalogs.columns],
        F.when(is_link, F.col("_file")).otherwise(F.col("file")).alias("resolved_file"),
        F.when(is_link, F.col("_path")).otherwise(F.col("path")).alias("resolved"))


def walk_tree(links: DataFrame, root: str) -> DataFrame:
    """Breadth-first walk of a graph of groups: [path, object, kind, depth, cyclic].

    ``links`` is [parent, name, child, kind]: one row per name an object has.  A
    group that is one of its own ancestors is listed once, marked cyclic, and
    not entered again.
    """
    spark = links.sparkSession
    start = spark.range(1).select(
        F.lit("/").alias("path"), F.lit(root).alias("object"), F.lit(GROUP).alias("kind"),
        F.lit(0).alias("depth"), F.lit(False).alias("cyclic"), F.array(F.lit(root)).alias("_above"))
    levels, frontier, depth = [start], start, 0
    while True:
        open_groups = frontier.where((F.col("kind") == GROUP) & ~F.col("cyclic")).select(
            F.col("path").alias("_path"), F.col("object").alias("parent"), "_above")
        sep = F.when(F.col("_path") == "/", F.lit("/")).otherwise(F.concat(F.col("_path"), F.lit("/")))
        below = links.join(open_groups, "parent").select(
            F.concat(sep, F.col("name")).alias("path"), F.col("child").alias("object"), "kind",
            F.lit(depth + 1).alias("depth"),
            F.array_contains("_above", F.col("child")).alias("cyclic"),
            F.concat("_above", F.array("child")).alias("_above"))
        # Written per level: the next join reads it, and so does the answer.
        below = written(below, "level")
        if below.isEmpty():
            break
        levels.append(below)
        frontier, depth = below, depth + 1
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.drop("_above")


def outline(nodes: DataFrame, shapes: DataFrame) -> DataFrame:
    """[path, kind, rank, elements, readout] of every node.

    ``shapes`` is [path, shape ARRAY<BIGINT>]: an empty shape is a scalar, a null
    one a dataset without elements.  Nodes may carry ``link, target, link_file`` (a
    link says where it points and whether anything is there), ``cyclic`` (a group
    that is one of its own ancestors says so) and ``type`` (what a named type is of).
    """
    members = member_counts(nodes)
    more = {"link": "string", "target": "string", "link_file": "string", "cyclic": "boolean", "type": "string"}
    said = [F.col(c) if c in nodes.columns else F.lit(None).cast(kind).alias(c) for c, kind in more.items()]
    facts = nodes.select("path", "kind", *said).join(members, "path", "left").join(
        shapes.withColumn("_known", F.lit(True)), "path", "left")
    rank = F.size("shape")
    elements = F.when(F.col("shape").isNull(), F.lit(0)).otherwise(
        F.aggregate("shape", F.lit(1).cast("bigint"), lambda total, n: total * n))
    points = F.concat(F.lit("→ "), F.coalesce(F.concat("link_file", F.lit(":")), F.lit("")), F.coalesce("target", F.lit("")),
                      F.when(F.col("kind") == UNRESOLVED, F.lit("  (missing)")).otherwise(F.lit("")))
    text = (
        F.when(F.col("link") != "hard", points)
        .when(F.col("cyclic"), F.lit("cycle"))
        .when(F.col("kind") == NAMED_TYPE, F.coalesce("type", F.lit("")))
        .when(F.col("kind") == GROUP, F.concat(F.col("members").cast("string"),
                                                F.when(F.col("members") == 1, F.lit(" item")).otherwise(F.lit(" items"))))
        .when((F.col("kind") == DATASET) & F.col("_known") & F.col("shape").isNull(), F.lit("null"))
        .when((F.col("kind") == DATASET) & (rank == 0), F.lit("scalar"))
        .when((F.col("kind") == DATASET) & F.col("_known"),
              F.concat(F.lit("("), F.array_join(F.transform("shape", lambda n: n.cast("string")), " × "), F.lit(")")))
        .otherwise(F.lower("kind"))
    )
    data = (F.col("kind") == DATASET) & F.col("_known") & F.coalesce(F.col("link") == "hard", F.lit(True))
    return facts.select("path", "kind",
                        F.when(data, F.when(F.col("shape").isNull(), 0).otherwise(rank)).alias("rank"),
                        F.when(data, elements).alias("elements"), text.alias("readout"))


def cell_shapes(cells: DataFrame, rank: int) -> DataFrame:
    """[path, shape] out of stored cells [path, i0, …]: the largest position of each axis."""
    extents = [(F.max(f"i{a}") + 1).alias(f"_n{a}") for a in range(rank)]
    return cells.groupBy("path").agg(*extents).select(
        "path", F.array(*[f"_n{a}" for a in range(rank)]).cast("array<bigint>").alias("shape"))


def attribute_counts(nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    """``nodes`` with ``attribute_count``; attrs is [path, name, idx, value]."""
    # Two steps, so a name with many elements is one row before it is counted.
    counts = attrs.groupBy("path", "name").agg(F.lit(1).alias("_one")).groupBy("path").agg(
        F.count(F.lit(1)).alias("attribute_count"))
    rest = [c for c in nodes.columns if c != "attribute_count"]
    return nodes.select(*rest).join(counts, "path", "left").select(
        *rest, F.coalesce("attribute_count", F.lit(0)).alias("attribute_count"))


def render_attributes(attrs: DataFrame, max_elements: int = 256) -> DataFrame:
    """[path, name, text]: one value plain, several as [a, b, …], none as [].

    Only the elements that are shown are gathered, so a list holds at most
    ``max_elements``.  An attribute without elements is a row whose idx is null.
    """
    shown = F.when(F.col("idx") < max_elements, F.struct("idx", "value"))
    gathered = attrs.groupBy("path", "name").agg(F.count("idx").alias("n"), F.sort_array(F.collect_list(shown)).alias("_l"))
    values = F.array_join(F.transform("_l", lambda e: F.coalesce(e["value"], F.lit(""))), ", ")
    more = F.when(F.col("n") > max_elements,
                  F.concat(F.lit(", ... ("), (F.col("n") - max_elements).cast("string"), F.lit(" more)"))).otherwise("")
    text = (F.when(F.col("n") == 0, F.lit("[]")).when(F.col("n") == 1, values)
            .otherwise(F.concat(F.lit("["), values, more, F.lit("]"))))
    return gathered.select("path", "name", text.alias("text"))
