"""Search over the paths of a catalog."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.runtime import small_side
from cellfold.sources.catalog import DATASET, GROUP, with_ancestors

# Hits listed before the caller is told there are more.
HIT_LIMIT = 200


def _class_end(text: str, at: int) -> int:
    """Where the class opened at ``at`` closes; -1 when it does not.

    A bracket straight after the opening (or after its ! or ^) is a member.
    """
    first = at + 1
    if text[first:first + 1] in ("!", "^"):
        first += 1
    return text.find("]", first + 1)


def is_pattern(text: str) -> bool:
    """Anything with a star, a question mark or a class, if every class closes."""
    at, special = 0, False
    while at < len(text):
        if text[at] == "[":
            end = _class_end(text, at)
            if end < 0:
                return False
            special, at = True, end
        elif text[at] in "*?":
            special = True
        at += 1
    return special


def to_regex(pattern: str) -> str:
    """An anchored, case-blind regular expression for a wildcard pattern.

    A star takes anything, separators included.
    """
    out, at = [], 0
    while at < len(pattern):
        letter = pattern[at]
        if letter == "*":
            out.append(".*")
        elif letter == "?":
            out.append(".")
        elif letter == "[":
            end = _class_end(pattern, at)
            body = pattern[at + 1:end]
            negated = body.startswith(("!", "^"))
            body = body[1:] if negated else body
            members, k = [], 0
            while k < len(body):
                if body[k + 1:k + 2] == "-" and k + 2 < len(body):
                    if body[k] <= body[k + 2]:
                        members.append(f"{_quoted(body[k])}-{_quoted(body[k + 2])}")
                    k += 3
                else:
                    members.append(_quoted(body[k]))
                    k += 1
            named = "".join(members)
            if named:
                out.append(f"[{'^' if negated else ''}{named}]")
            else:
                out.append("." if negated else "(?!)")
            at = end
        else:
            out.append(_quoted(letter))
        at += 1
    return f"(?isu)\\A{''.join(out)}\\z"


def _quoted(letter: str) -> str:
    return letter if letter.isalnum() or letter in "/_ " else "\\" + letter if letter.isascii() else letter


def _literal(pattern: str) -> str:
    """The longest run of plain letters every match has to contain."""
    bare = re.sub(r"\[[!^]?.[^\]]*\]", "*", pattern)
    return max(re.split(r"[*?]", bare), key=len)


def accepts(text: str, path: str | Column = "path", name: str | Column = "name") -> Column:
    """Whether a node matches: plain text anywhere in its path, a pattern on its
    whole name or its whole path, both without regard to case."""
    path, name = (F.col(c) if isinstance(c, str) else c for c in (path, name))
    if not text:
        return F.lit(True)
    if not is_pattern(text):
        return F.contains(F.lower(path), F.lit(text.lower()))
    regex = to_regex(text)
    # A name is the tail of its path, so a pattern that opens with a star needs
    # only the path; and letters it spells out are a cheap first test.
    found = path.rlike(regex) if text.startswith("*") else name.rlike(regex) | path.rlike(regex)
    literal = _literal(text).lower()
    return F.contains(F.lower(path), F.lit(literal)) & found if literal else found


def search(nodes: DataFrame, text: str) -> DataFrame:
    """The nodes that match; a scan and a filter."""
    return nodes.where(accepts(text))


def branches(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``mark``: ``hit``, ``above`` (a hit lies below it) or null.

    Every hit names itself and each group above it once; the names are combined
    per task before the shuffle.
    """
    named = with_ancestors(hits.select("path"), "path", "_node", own=True)
    hit = F.max(F.when(F.col("_node") == F.col("path"), 1).otherwise(0)).alias("_hit")
    marks = named.groupBy("_node").agg(hit).withColumnRenamed("_node", "path")
    mark = F.when(F.col("_hit") == 1, F.lit("hit")).when(F.col("_hit") == 0, F.lit("above"))
    return nodes.join(marks, "path", "left").withColumn("mark", mark).drop("_hit")


def top_hits(hits: DataFrame, limit: int = HIT_LIMIT) -> DataFrame:
    """Hits with no hit above them, in order of path: ``limit`` and one more."""
    above = with_ancestors(hits.select("path"), "path", "_above").select("path", "_above")
    # The hits that have hits below are few beside the hits themselves; each
    # ancestor is combined per task before it is looked up.
    covering = above.select("_above").distinct().join(hits.select(F.col("path").alias("_above")), "_above", "left_semi")
    covered = above.join(small_side(covering), "_above", "left_semi").select("path").distinct()
    return hits.join(covered, "path", "left_anti").orderBy("path").limit(limit + 1)


def match_mark(nodes: DataFrame, text: str) -> DataFrame:
    """``nodes`` with where the match starts in the name and how long it is."""
    if not text:
        start, length = F.lit(-1), F.lit(0)
    elif is_pattern(text):
        whole = F.col("name").rlike(to_regex(text))
        start, length = F.when(whole, 0).otherwise(-1), F.when(whole, F.length("name")).otherwise(0)
    else:
        start = F.instr(F.lower("name"), F.lit(text.lower())) - 1
        length = F.when(start >= 0, F.lit(len(text))).otherwise(0)
    return nodes.withColumns({"mark_start": start.cast("int"), "mark_length": length.cast("int")})


def prefix_listing(nodes: DataFrame, group: str, fragment: str, shapes: DataFrame | None = None) -> DataFrame:
    """Children of a group whose name starts with the fragment, as completions.

    A group ends in a separator, a dataset in the subscript that takes all of it
    (when ``shapes`` [path, shape] knows its rank).
    """
    listed = nodes.where((F.col("parent") == group) & F.col("name").startswith(fragment)
                         & F.col("kind").isin(GROUP, DATASET))
    if shapes is None:
        listed = listed.withColumn("_r", F.lit(None).cast("int"))
    else:
        listed = listed.join(shapes.select("path", F.size("shape").alias("_r")), "path", "left")
    whole = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit(":"), F.col("_r")), ", "), F.lit("]"))
    tail = F.when(F.col("kind") == GROUP, F.lit("/")).when(F.col("_r") > 0, whole).otherwise(F.lit(""))
    return listed.select("name", F.concat("path", tail).alias("completion"))


def common_head(listing: DataFrame, column: str = "completion") -> DataFrame:
    """Longest head all the answers share: what the first and the last share."""
    ends = listing.agg(F.min(column).alias("_a"), F.max(column).alias("_z"))
    shared = F.filter(F.sequence(F.lit(0), F.least(F.length("_a"), F.length("_z"))),
                      lambda k: F.substring("_a", F.lit(1), k) == F.substring("_z", F.lit(1), k))
    return ends.select(F.coalesce(F.substring(F.col("_a"), F.lit(1), F.array_max(shared)), F.lit("")).alias("head"))
