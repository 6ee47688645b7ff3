"""Catalog, search and views on small fixtures."""

import re

import pytest

from cellfold.operators import searching, views
from cellfold.sources import catalog


def tree(spark, *rows):
    full = [(r, "Dataset", "hard", None) if isinstance(r, str) else r for r in rows]
    return catalog.build_nodes(spark.createDataFrame(full, "path string, kind string, link string, target string"))


def soft(path, target):
    return (path, "Dataset", "soft", target)


def test_build_nodes(spark):
    rows = {r.path: r for r in tree(spark, "/a/b/c", "/a/d", "//a//e/", "/f").collect()}
    assert set(rows) == {"/", "/a", "/a/b", "/a/b/c", "/a/d", "/a/e", "/f"}
    assert {p for p, r in rows.items() if r.kind == "Group"} == {"/", "/a", "/a/b"}
    assert (rows["/a/b/c"].name, rows["/a/b/c"].parent) == ("c", "/a/b")
    assert (rows["/f"].name, rows["/f"].parent, rows["/"].name, rows["/"].parent) == ("f", "/", "/", None)
    plain = catalog.build_nodes(spark.createDataFrame([("/a/b",), ("/a/b/c",), ("/a/b",)], "path string"))
    assert sorted((r.path, r.kind) for r in plain.collect()) == [
        ("/", "Group"), ("/a", "Group"), ("/a/b", "Group"), ("/a/b/c", "Dataset")]


def test_members_and_children(spark):
    nodes = tree(spark, "/g/z", "/g/B", "/g/a", ("/empty", "Group", "hard", None))
    counts = {r.path: r.members for r in catalog.member_counts(nodes).collect()}
    assert counts == {"/": 2, "/g": 3, "/empty": 0}
    assert [r.name for r in catalog.children(nodes, "/g").collect()] == ["B", "a", "z"]


def test_resolve_links(spark):
    chain = [soft(f"/chain/{k}", f"/chain/{k + 1}") for k in range(40)] + ["/chain/40"]
    nodes = tree(spark, "/data/m", *chain, soft("/l/data", "/data/m"), soft("/l/group", "/data"),
                 soft("/l/through", "/l/group/m"), soft("/l/relative", "through"), soft("/l/self", "/l/self"),
                 soft("/l/deeper", "/l/deeper/x"), soft("/l/a", "/l/b"), soft("/l/b", "/l/a"), soft("/l/nothing", "/nope"),
                 soft("/l/r1", "/l/r2"), soft("/l/r2", "/l/r3"), soft("/l/r3", "/l/r1"), soft("/l/into", "/l/r2/x"))
    rows = {r.path: (r.kind, r.resolved) for r in catalog.resolve_links(nodes).collect()}
    assert rows["/l/data"] == ("Dataset", "/data/m")
    assert rows["/l/group"] == ("Group", "/data")
    assert rows["/l/through"] == ("Dataset", "/data/m")
    assert rows["/l/relative"] == ("Dataset", "/data/m")
    for lost in ("self", "deeper", "a", "b", "nothing"):
        assert rows[f"/l/{lost}"] == ("Unresolved", None)
    assert all(rows[f"/chain/{k}"] == ("Dataset", "/chain/40") for k in range(40))
    for lost in ("r1", "r2", "r3", "into"):
        assert rows[f"/l/{lost}"] == ("Unresolved", None)
    assert rows["/data/m"] == ("Dataset", "/data/m")
    # With a number of links that may follow each other, one more is too many.
    few = {r.path: r.kind for r in catalog.resolve_links(nodes, hops=16).collect()}
    assert (few["/chain/24"], few["/chain/23"]) == ("Dataset", "Unresolved")


def test_goals_run_through_one_link_again_and_again(spark):
    nodes = tree(spark, ("/g", "Group", "hard", None), soft("/g/x", "/g"), soft("/l", "/g" + "/x" * 12), "/g/end", soft("/m", "/l/x/end"))
    rows = {r.path: (r.kind, r.resolved) for r in catalog.resolve_links(nodes).collect()}
    assert rows["/l"] == ("Group", "/g") and rows["/m"] == ("Dataset", "/g/end")


def test_settled_links_are_not_written_again(spark, monkeypatch):
    """Every phase writes the links that are still open, and there are fewer of them."""
    sizes, real = [], catalog.written
    monkeypatch.setattr(catalog, "written", lambda df, label: sizes.append((label, (out := real(df, label)).count())) or out)
    chain = [soft(f"/c/{k}", f"/c/{k + 1}") for k in range(20)] + ["/c/20", soft("/g/x", "/g"), "/g/y"]
    nodes = tree(spark, *chain, *[soft(f"/l/{k}", f"/c/{k}") for k in range(20)], soft("/t", "/g/x/x/y"))
    catalog.resolve_links(nodes)
    waiting = [n for label, n in sizes if label == "waiting"]
    assert waiting[0] == 42 and waiting == sorted(waiting, reverse=True) and waiting[-1] == 1


def test_resolve_external(spark):
    row = lambda file, path, link, target=None, away=None, kind="Dataset": (file, path, path, "/", kind, link, target, away)
    rows = [row("a", "/1", "external", "/d", "b"), row("a", "/2", "soft", "1"), row("a", "/3", "external", "/s/x", "b"), row("a", "/4", "external", "/d", "none"),
            row("a", "/5", "external", "/back", "b"), row("a", "/6", "external", "/", "b"), row("a", "/7", "external", None, "b"), row("a", "/d", "hard"),
            row("b", "/d", "hard"), row("b", "/s", "soft", "/g"), row("b", "/g/x", "hard", kind="NamedType"), row("b", "/back", "external", "/5", "a"),
            row("b", "/", "hard", kind="Group"), row(None, "/n", "external", "/d", "b")]
    df = spark.createDataFrame(rows, "file string, path string, name string, parent string, kind string, link string, target string, link_file string")
    got = {(r.file, r.path): (r.kind, r.resolved_file, r.resolved) for r in catalog.resolve_external(df).collect()}
    assert got["a", "/1"] == got["a", "/2"] == ("Dataset", "b", "/d") and got["a", "/3"] == ("NamedType", "b", "/g/x")
    assert got["a", "/d"] == ("Dataset", "a", "/d") and got["a", "/6"] == ("Group", "b", "/")
    for lost in ("/4", "/5", "/7"):
        assert got["a", lost] == ("Unresolved", None, None)


def test_walk_tree(spark):
    links = spark.createDataFrame([
        ("root", "a", "A", "Group"), ("root", "x", "X", "Dataset"), ("A", "again", "root", "Group"),
        ("A", "b", "B", "Group"), ("B", "a", "A", "Group"), ("root", "b", "B", "Group"),
    ], "parent string, name string, child string, kind string")
    rows = {r.path: (r.depth, r.cyclic) for r in catalog.walk_tree(links, "root").collect()}
    assert rows == {"/": (0, False), "/a": (1, False), "/x": (1, False), "/b": (1, False), "/a/again": (2, True),
                    "/a/b": (2, False), "/b/a": (2, False), "/a/b/a": (3, True), "/b/a/again": (3, True), "/b/a/b": (3, True)}


def test_outline(spark):
    nodes = tree(spark, "/g/m", "/g/s", "/n", ("/u", "Unresolved", "soft", "/x"))
    shapes = spark.createDataFrame([("/g/m", [4, 3]), ("/g/s", []), ("/n", None)], "path string, shape array<bigint>")
    rows = {r.path: (r.rank, r.elements, r.readout) for r in catalog.outline(nodes, shapes).collect()}
    assert rows == {"/": (None, None, "3 items"), "/g": (None, None, "2 items"), "/g/m": (2, 12, "(4 × 3)"),
                    "/g/s": (0, 1, "scalar"), "/n": (0, 0, "null"), "/u": (None, None, "→ /x  (missing)")}


def test_attributes(spark):
    rows = [("/a", "one", 0, "1")] + [("/a", "many", k, str(k)) for k in range(5)] + [("/a", "none", None, None)]
    attrs = spark.createDataFrame(rows, "path string, name string, idx bigint, value string")
    text = {r.name: r.text for r in catalog.render_attributes(attrs, 3).collect()}
    assert text == {"one": "1", "many": "[0, 1, 2, ... (2 more)]", "none": "[]"}
    assert {r.name: r.text for r in catalog.render_attributes(attrs).collect()}["many"] == "[0, 1, 2, 3, 4]"
    counts = {r.path: r.attribute_count for r in catalog.attribute_counts(tree(spark, "/a", "/b"), attrs).collect()}
    assert counts == {"/": 0, "/a": 3, "/b": 0}


PATHS = ["/run/1/temp", "/run/2/Temp_a", "/run/2/temperature", "/run/2/time", "/x[1]", "/a.b", "/a+b", "/a]b", "/a-b", "/aéb", "/run"]
PATTERNS = {
    # pattern: regular expression for the whole name or the whole path
    "temp*": r"temp.*", "*2*": r".*2.*", "/run/?/t*": r"/run/./t.*", "t[ei]m*": r"t[ei]m.*", "t[!e]*": r"t[^e].*",
    "t[^e]*": r"t[^e].*", "a[+-.]b": r"a[+-.]b", "a[]]b": r"a\]b", "a[!]]b": r"a[^\]]b", "*": r".*", "a?b": r"a.b",
    "[a-c].B": r"[a-c]\.b", "x[[]1]": r"x\[1\]", "/RUN/*/TEMP": r"/run/.*/temp", "a[.-]b": r"a[.\-]b",
}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns(spark, pattern):
    assert searching.is_pattern(pattern)
    want = re.compile(PATTERNS[pattern], re.I | re.S)
    nodes = tree(spark, *PATHS)
    every = [r.path for r in nodes.collect()]
    names = lambda p: "/" if p == "/" else p.rsplit("/", 1)[1]
    expected = sorted(p for p in every if want.fullmatch(p) or want.fullmatch(names(p)))
    assert sorted(r.path for r in searching.search(nodes, pattern).collect()) == expected
    marks = {r.path: r.mark_start for r in searching.match_mark(nodes, pattern).collect()}
    assert sorted(p for p, m in marks.items() if m == 0) == sorted(p for p in every if want.fullmatch(names(p)))


def test_plain_text_and_open_classes(spark):
    nodes = tree(spark, *PATHS)
    assert not searching.is_pattern("x[1") and not searching.is_pattern("plain") and not searching.is_pattern("[!]")
    assert [r.path for r in searching.search(nodes, "X[1").collect()] == ["/x[1]"]
    assert sorted(r.path for r in searching.search(nodes, "2/TEMP").collect()) == ["/run/2/Temp_a", "/run/2/temperature"]
    assert searching.search(nodes, "").count() == nodes.count()


def test_branches_and_top_hits(spark):
    nodes = tree(spark, "/run/a/run", "/run/b", "/c/run", "/d")
    hits = searching.search(nodes, "run")
    marks = {r.path: r.mark for r in searching.branches(hits, nodes).collect()}
    assert marks == {"/": "above", "/run": "hit", "/run/a": "hit", "/run/a/run": "hit", "/run/b": "hit", "/c": "above",
                     "/c/run": "hit", "/d": None}
    assert [r.path for r in searching.top_hits(hits).collect()] == ["/c/run", "/run"]
    assert len(searching.top_hits(hits, limit=0).collect()) == 1


def test_prefixes(spark):
    nodes = tree(spark, "/g/temp/x", "/g/tempo", "/g/Temp", soft("/g/temple", "/no"))
    shapes = spark.createDataFrame([("/g/tempo", [2, 3]), ("/g/Temp", [])], "path string, shape array<bigint>")
    listing = searching.prefix_listing(nodes, "/g", "te", shapes)
    assert sorted(r.completion for r in listing.collect()) == ["/g/temp/", "/g/temple", "/g/tempo[:, :]"]
    assert searching.common_head(listing).first().head == "/g/temp"
    assert searching.common_head(listing.where("false")).first().head == ""


def test_views(spark):
    nodes = spark.createDataFrame([
        ("/ok", "Dataset", "float64", True, 2), ("/text", "Dataset", "string", False, 1), ("/g", "Group", None, False, None),
        ("/lost", "Unresolved", None, False, None), ("/null", "Dataset", "int32", True, None), ("/one", "Dataset", "int32", True, 0),
    ], "path string, kind string, type string, numeric boolean, rank int")
    saved = spark.createDataFrame([
        ("Both", "a", "/ok", 1), ("Both", "b", "/ok", 1), ("half", "c", "/ok", 0), ("half", "d", "/gone", 1),
        ("half", "e", "/text", 0), ("none", "f", "/g", 0), ("none", "g", "/lost", 0), ("none", "h", "/null", 0),
        ("none", "i", "/one", 0), ("over", "j", "/ok", 3), ("over", "k", "/ok", 2),
    ], "view string, line string, path string, held_axes int")
    names = spark.createDataFrame([(n,) for n in ("Both", "half", "none", "over", "blank")], "view string")
    matched = views.view_match(saved, nodes, names)
    assert {r.view: (r.named, r.here, r.state) for r in matched.collect()} == {
        "Both": (1, 1, "full"), "half": (3, 1, "partial"), "none": (4, 0, "none"), "over": (1, 1, "full"), "blank": (0, 0, "none")}
    assert [r.view for r in views.rank_views(matched).collect()] == ["Both", "over", "half", "blank", "none"]
    issues = views.view_issues(saved, nodes)
    assert {(r.view, r.line): r.reason for r in issues.collect()} == {
        ("half", "c"): "not one line: 2 axes left",
        ("half", "d"): "missing",
        ("half", "e"): "not numeric: string",
        ("none", "f"): "no dataset: group",
        ("none", "g"): "link without an object",
        ("none", "h"): "no elements",
        ("none", "i"): "single value",
        ("over", "j"): "3 subscripts for 2 axes",
        ("over", "k"): "not one line: one element",
    }
    assert views.issue_counts(issues).where("view = 'none'").count() == 4
