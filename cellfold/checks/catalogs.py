"""The catalog: nodes, links, attributes, search, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellfold.checks import check
from cellfold.checks.inputs import CUSTOMERS, NODES, customer_paths, nodes
from cellfold.operators import searching, views
from cellfold.sources import catalog
from cellfold.sources.tables import element_positions, scan, series_positions


def shown(df):
    return df.select("path", "name", "parent", "kind")


# --- nodes and links ----------------------------------------------------------


@check("build_nodes", f"WITH {NODES} SELECT path, name, parent, kind FROM nodes")
def _(spark, d):
    return shown(nodes(spark, d))


@check("children", f"WITH {NODES} SELECT path, name, parent, kind FROM nodes WHERE parent = '/ASIA'")
def _(spark, d):
    return shown(catalog.children(nodes(spark, d), "/ASIA"))


@check("member_counts", f"""
WITH {NODES} SELECT g.path, count(m.path) AS members FROM nodes g LEFT JOIN nodes m ON m.parent = g.path
WHERE g.kind = 'Group' GROUP BY 1""")
def _(spark, d):
    return catalog.member_counts(nodes(spark, d))


def linked_nodes(spark, d):
    """Customers and links to them: straight, through a linked group, in chains,
    to themselves and to nothing, by market segment."""
    people = customer_paths(spark, d)
    before = F.concat(F.lit("/by_name/Customer#"), F.lpad((F.col("c_custkey") - 1).cast("string"), 9, "0"))
    own = F.concat(F.lit("/by_name/"), F.col("c_name"))
    through = F.concat(F.lit("/nations/"), F.col("n_name"), F.lit("/"), F.col("c_name"))
    segment = F.col("c_mktsegment")
    target = (F.when(segment == "BUILDING", F.col("path")).when(segment == "AUTOMOBILE", through)
              .when(segment == "HOUSEHOLD", before).when(segment == "MACHINERY", own)
              .otherwise(F.concat(F.lit("/nowhere/"), F.col("c_name"))))
    hard = people.select("path", F.lit("Dataset").alias("kind"), F.lit("hard").alias("link"),
                         F.lit(None).cast("string").alias("target"))
    soft = people.select(own.alias("path"), F.lit("Dataset").alias("kind"), F.lit("soft").alias("link"), target.alias("target"))
    groups = people.select(F.concat(F.lit("/nations/"), F.col("n_name")).alias("path"), F.lit("Group").alias("kind"),
                           F.lit("soft").alias("link"),
                           F.concat(F.lit(".."), F.col("nation")).alias("target")).distinct()
    absolute = groups.withColumn("target", F.expr("substring(target, 3)"))
    return catalog.build_nodes(hard.unionByName(soft).unionByName(absolute))


@check("resolve_links", f"""
WITH RECURSIVE {CUSTOMERS},
objects AS (SELECT path, 'Dataset' AS kind FROM customers UNION SELECT nation, 'Group' FROM customers
            UNION SELECT region, 'Group' FROM customers),
links AS (
  SELECT '/by_name/' || c_name AS path, CASE c_mktsegment WHEN 'BUILDING' THEN path
      WHEN 'AUTOMOBILE' THEN '/nations/' || n_name || '/' || c_name
      WHEN 'HOUSEHOLD' THEN '/by_name/Customer#' || lpad(CAST(c_custkey - 1 AS VARCHAR), 9, '0')
      WHEN 'MACHINERY' THEN '/by_name/' || c_name ELSE '/nowhere/' || c_name END AS target
  FROM customers
  UNION SELECT '/nations/' || n_name, nation FROM customers),
walk AS (
  SELECT path, target AS goal, 1 AS used FROM links
  UNION ALL
  SELECT w.path, l.target || substr(w.goal, length(l.path) + 1), used + 1
  FROM walk w JOIN links l ON array_to_string(string_split(w.goal, '/')[1:3], '/') = l.path WHERE used < 16)
SELECT l.path, coalesce(o.kind, 'Unresolved') AS kind, l.target, o.path AS resolved
FROM links l LEFT JOIN (SELECT w.path AS link, objects.* FROM walk w JOIN objects ON objects.path = w.goal) o ON o.link = l.path""")
def _(spark, d):
    found = catalog.resolve_links(linked_nodes(spark, d))
    return found.where(F.col("link") == "soft").select("path", "kind", "target", "resolved")


def object_graph(spark, d):
    """[parent, name, child, kind]: regions, nations and customers as objects, where
    every nation also holds its region and every region the root."""
    region = scan(spark, d, "region", ["r_regionkey", "r_name"])
    nation = scan(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    customer = scan(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey"])
    tag = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    group, data = F.lit("Group").alias("kind"), F.lit("Dataset").alias("kind")
    parts = [
        region.select(F.lit("root").alias("parent"), F.col("r_name").alias("name"), tag("r", "r_regionkey").alias("child"), group),
        region.select(tag("r", "r_regionkey").alias("parent"), F.lit("top").alias("name"), F.lit("root").alias("child"), group),
        nation.select(tag("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), tag("n", "n_nationkey").alias("child"), group),
        nation.select(tag("n", "n_nationkey").alias("parent"), F.lit("region").alias("name"), tag("r", "n_regionkey").alias("child"), group),
        customer.select(tag("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"), tag("c", "c_custkey").alias("child"), data),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@check("walk_tree", """
WITH RECURSIVE links AS (
  SELECT 'root' AS parent, r_name AS name, 'r' || r_regionkey AS child, 'Group' AS kind FROM region
  UNION ALL SELECT 'r' || r_regionkey, 'top', 'root', 'Group' FROM region
  UNION ALL SELECT 'r' || n_regionkey, n_name, 'n' || n_nationkey, 'Group' FROM nation
  UNION ALL SELECT 'n' || n_nationkey, 'region', 'r' || n_regionkey, 'Group' FROM nation
  UNION ALL SELECT 'n' || c_nationkey, c_name, 'c' || c_custkey, 'Dataset' FROM customer),
walk AS (
  SELECT '/' AS path, 'root' AS object, 'Group' AS kind, 0 AS depth, false AS cyclic, ['root'] AS above
  UNION ALL
  SELECT CASE WHEN path = '/' THEN '/' ELSE path || '/' END || name, child, l.kind, depth + 1,
         list_contains(above, child), list_append(above, child)
  FROM walk w JOIN links l ON l.parent = w.object WHERE w.kind = 'Group' AND NOT cyclic)
SELECT path, object, kind, depth, cyclic FROM walk""")
def _(spark, d):
    return catalog.walk_tree(object_graph(spark, d), "root")


TALK = """words AS (
  SELECT '/talks/' || conv_id AS path, turn AS i0, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS i1
  FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))"""


def talk_cells(spark, d):
    """Words of every conversation as cells [path, i0 = turn, i1 = word]."""
    df = scan(spark, d, "conversations", ["conv_id", "turn", "text"])
    return df.select(F.concat(F.lit("/talks/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("i0"),
                     F.posexplode(F.split("text", " ")).alias("i1", "word"))


@check("outline", f"""
WITH {TALK},
shapes AS (SELECT path, max(i0) + 1 AS r, max(i1) + 1 AS c FROM words GROUP BY 1),
data AS (
  SELECT path, 2 AS rank, r * c AS elements, '(' || r || ' × ' || c || ')' AS readout FROM shapes
  UNION ALL SELECT '/items/' || item_id, 0, 1, 'scalar' FROM benchmark
  UNION ALL SELECT '/pages/' || page_id, 0, 0, 'null' FROM pages)
SELECT path, 'Dataset' AS kind, rank, elements, readout FROM data
UNION ALL SELECT '/', 'Group', NULL, NULL, '3 items'
UNION ALL SELECT g, 'Group', NULL, NULL, CASE WHEN n = 1 THEN '1 item' ELSE n || ' items' END
FROM (SELECT '/talks' AS g, count(*) AS n FROM shapes UNION ALL SELECT '/items', count(*) FROM benchmark
      UNION ALL SELECT '/pages', count(*) FROM pages)""")
def _(spark, d):
    shapes = catalog.cell_shapes(talk_cells(spark, d), 2)
    items = scan(spark, d, "benchmark", ["item_id"]).select(
        F.concat(F.lit("/items/"), F.col("item_id").cast("string")).alias("path"), F.array().cast("array<bigint>").alias("shape"))
    empty = scan(spark, d, "pages", ["page_id"]).select(
        F.concat(F.lit("/pages/"), F.col("page_id").cast("string")).alias("path"), F.lit(None).cast("array<bigint>").alias("shape"))
    every = shapes.unionByName(items).unionByName(empty)
    return catalog.outline(catalog.build_nodes(every.select("path")), every)


def document_attrs(spark, d):
    docs = scan(spark, d, "documents", ["doc_id", "lang", "source", "n_chars"])
    labels = scan(spark, d, "labels", ["doc_id", "quality", "toxic"])
    path = F.concat(F.lit("/documents/"), F.col("doc_id").cast("string")).alias("path")
    one = lambda df, name: df.select(path, F.lit(name).alias("name"), F.lit(0).cast("bigint").alias("idx"),
                                     F.col(name).cast("string").alias("value"))
    out = one(docs, "lang")
    for df, name in ((docs, "source"), (docs, "n_chars"), (labels, "quality"), (labels, "toxic")):
        out = out.unionByName(one(df, name))
    return out


@check("attribute_counts", """
SELECT '/documents/' || d.doc_id AS path, CAST(3 + CASE WHEN l.doc_id IS NULL THEN 0 ELSE 2 END AS BIGINT) AS attribute_count
FROM documents d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT '/documents', 0 UNION ALL SELECT '/', 0""")
def _(spark, d):
    paths = scan(spark, d, "documents", ["doc_id"]).select(F.concat(F.lit("/documents/"), F.col("doc_id").cast("string")).alias("path"))
    return catalog.attribute_counts(catalog.build_nodes(paths), document_attrs(spark, d)).select("path", "attribute_count")


@check("render_attributes", """
WITH ranked AS (
  SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS idx FROM customer),
listed AS (
  SELECT c_nationkey, count(*) AS n, string_agg(c_name, ', ' ORDER BY idx) FILTER (idx < 25) AS shown FROM ranked GROUP BY 1)
SELECT '/nations/' || c_nationkey AS path, 'customers' AS name, CASE WHEN n = 1 THEN shown WHEN n <= 25 THEN '[' || shown || ']'
  ELSE '[' || shown || ', ... (' || (n - 25) || ' more)]' END AS "text" FROM listed
UNION ALL SELECT '/nations/' || n_nationkey, 'name', n_name FROM nation
UNION ALL SELECT '/nations/' || n_nationkey, 'notes', '[]' FROM nation""")
def _(spark, d):
    nation = scan(spark, d, "nation", ["n_nationkey", "n_name"])
    path = lambda key: F.concat(F.lit("/nations/"), F.col(key).cast("string")).alias("path")
    placed = series_positions(scan(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey"]), "c_nationkey", ["c_custkey"])
    attrs = placed.select(path("c_nationkey"), F.lit("customers").alias("name"), F.col("pos").alias("idx"), F.col("c_name").alias("value"))
    attrs = attrs.unionByName(nation.select(path("n_nationkey"), F.lit("name").alias("name"), F.lit(0).cast("bigint").alias("idx"),
                                            F.col("n_name").alias("value")))
    attrs = attrs.unionByName(nation.select(path("n_nationkey"), F.lit("notes").alias("name"), F.lit(None).cast("bigint").alias("idx"),
                                            F.lit(None).cast("string").alias("value")))
    return catalog.render_attributes(attrs, max_elements=25)


# --- search -------------------------------------------------------------------

TEXT, PATTERN, CLASSES = "EXAMPLE.net/de/1", "*.example.net/*/[0-4]?*.html", "[!c-z]*[0-9].?tml"
IN_SQL = {
    TEXT: "contains(lower(path), 'example.net/de/1')",
    PATTERN: r"(regexp_full_match(lower(path), '.*\.example\.net/.*/[0-4]..*\.html') OR regexp_full_match(lower(name), '.*\.example\.net/.*/[0-4]..*\.html'))",
    CLASSES: r"(regexp_full_match(lower(path), '[^c-z].*[0-9]\..tml') OR regexp_full_match(lower(name), '[^c-z].*[0-9]\..tml'))",
}

for _name, _text in (("search_text", TEXT), ("search_pattern", PATTERN), ("search_classes", CLASSES), ):
    @check(_name, f"WITH {NODES} SELECT path, name, parent, kind FROM nodes WHERE {IN_SQL[_text]}")
    def _(spark, d, text=_text):
        return shown(searching.search(nodes(spark, d), text))


@check("search_unclosed", f"WITH {NODES} SELECT path, name, parent, kind FROM nodes WHERE contains(lower(path), 'customer#0000000')")
def _(spark, d):
    # With the class left open this is plain text, which no path holds; closed, it is a pattern.
    tree = nodes(spark, d)
    open_class = searching.search(tree, "customer#[0*")
    return shown(searching.search(tree, "*/customer#0000000[0-9]*").unionByName(open_class))


@check("branches", f"""
WITH {NODES}, hits AS (SELECT path FROM nodes WHERE {IN_SQL[PATTERN]}),
up AS (SELECT DISTINCT CASE WHEN k = 1 THEN '/' ELSE array_to_string(string_split(path, '/')[1:k], '/') END AS path
       FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM hits))
SELECT n.path, CASE WHEN h.path IS NOT NULL THEN 'hit' WHEN u.path IS NOT NULL THEN 'above' END AS mark
FROM nodes n LEFT JOIN hits h ON h.path = n.path LEFT JOIN up u ON u.path = n.path""")
def _(spark, d):
    tree = nodes(spark, d)
    return searching.branches(searching.search(tree, PATTERN), tree).select("path", "mark")


@check("top_hits", f"""
WITH {NODES}, hits AS (SELECT path FROM nodes WHERE contains(lower(path), 'an') AND path <> '/'),
covered AS (
  SELECT DISTINCT path FROM (SELECT path, array_to_string(string_split(path, '/')[1:k], '/') AS above
    FROM (SELECT path, unnest(range(2, len(string_split(path, '/')))) AS k FROM hits)) WHERE above IN (SELECT path FROM hits))
SELECT path FROM hits WHERE path NOT IN (SELECT path FROM covered) ORDER BY path LIMIT 31""")
def _(spark, d):
    return searching.top_hits(searching.search(nodes(spark, d), "an"), 30).select("path")


@check("match_mark", f"""
WITH {NODES} SELECT path, CAST(strpos(lower(name), 'er') - 1 AS INTEGER) AS mark_start,
  CASE WHEN contains(lower(name), 'er') THEN 2 ELSE 0 END AS mark_length FROM nodes""")
def _(spark, d):
    return searching.match_mark(nodes(spark, d), "Er").select("path", "mark_start", "mark_length")


@check("match_mark_pattern", rf"""
WITH {NODES}, m AS (SELECT path, name, regexp_full_match(lower(name), 'c.*[5-9]') AS hit FROM nodes)
SELECT path, CASE WHEN hit THEN 0 ELSE -1 END AS mark_start, CAST(CASE WHEN hit THEN length(name) ELSE 0 END AS INTEGER) AS mark_length FROM m""")
def _(spark, d):
    return searching.match_mark(nodes(spark, d), "c*[5-9]").select("path", "mark_start", "mark_length")


LISTING = f"""{NODES}, listing AS (
  SELECT name, path || CASE WHEN kind = 'Group' THEN '/' ELSE '[:, :]' END AS completion FROM nodes
  WHERE parent = '/ASIA/NATION_12' AND starts_with(name, 'Cust') OR parent = '/pages' AND starts_with(name, 'blog'))"""


def listing(spark, d):
    tree = nodes(spark, d)
    shapes = tree.where(F.col("kind") == "Dataset").select("path", F.lit([3, 4]).cast("array<bigint>").alias("shape"))
    return searching.prefix_listing(tree, "/ASIA/NATION_12", "Cust", shapes).unionByName(
        searching.prefix_listing(tree, "/pages", "blog", shapes))


@check("prefix_listing", f"WITH {LISTING} SELECT name, completion FROM listing")
def _(spark, d):
    return listing(spark, d)


@check("common_head", f"""
WITH {LISTING}, ends AS (SELECT min(completion) AS a, max(completion) AS z FROM listing WHERE starts_with(completion, '/pages'))
SELECT a[1:max(k)] AS head FROM (SELECT a, z, unnest(range(0, least(length(a), length(z)) + 1)) AS k FROM ends)
WHERE a[1:k] = z[1:k] GROUP BY a""")
def _(spark, d):
    tree = nodes(spark, d)
    return searching.common_head(searching.prefix_listing(tree, "/pages", "blog"))


# --- views --------------------------------------------------------------------

FACTS = f"""{CUSTOMERS},
facts AS (
  SELECT path, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Unresolved' ELSE 'Dataset' END AS kind,
         CASE WHEN c_mktsegment = 'FURNITURE' THEN 'string' ELSE 'float64' END AS type,
         c_mktsegment <> 'FURNITURE' AS num,
         CASE c_mktsegment WHEN 'MACHINERY' THEN NULL WHEN 'AUTOMOBILE' THEN 0 ELSE 2 END AS rank FROM customers
  UNION ALL SELECT DISTINCT nation, 'Group', NULL, false, NULL FROM customers),
views AS (
  SELECT n_name AS view, c_name AS line, path, c_custkey % 4 AS held_axes FROM customers
  UNION ALL SELECT n_name || ' ' || lower(c_mktsegment), c_name, path, c_custkey % 4 FROM customers
  UNION ALL SELECT n_name || ' suppliers', s_name, '/suppliers/' || s_name, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT n_name, 'base', nation, 0 FROM customers)"""

PROBLEM = """CASE WHEN f.kind IS NULL THEN 'missing'
  WHEN f.kind = 'Unresolved' THEN 'link without an object'
  WHEN f.kind <> 'Dataset' THEN 'no dataset: ' || lower(f.kind)
  WHEN rank IS NULL THEN 'no elements'
  WHEN NOT num THEN 'not numeric: ' || type
  WHEN rank = 0 THEN 'single value' END"""


def view_facts(spark, d):
    people, segment = customer_paths(spark, d), F.col("c_mktsegment")
    leaves = people.select(
        "path", F.when(segment == "HOUSEHOLD", "Unresolved").otherwise("Dataset").alias("kind"),
        F.when(segment == "FURNITURE", "string").otherwise("float64").alias("type"), (segment != "FURNITURE").alias("numeric"),
        F.when(segment == "AUTOMOBILE", 0).when(segment != "MACHINERY", 2).alias("rank"))
    groups = people.select(F.col("nation").alias("path"), F.lit("Group").alias("kind"), F.lit(None).cast("string").alias("type"),
                           F.lit(False).alias("numeric"), F.lit(None).cast("int").alias("rank")).distinct()
    return leaves.unionByName(groups)


def saved_views(spark, d):
    people = customer_paths(spark, d)
    held = (F.col("c_custkey") % 4).cast("int").alias("held_axes")
    supplier = scan(spark, d, "supplier", ["s_name", "s_nationkey"])
    nation = scan(spark, d, "nation", ["n_nationkey", "n_name"])
    away = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    parts = [
        people.select(F.col("n_name").alias("view"), F.col("c_name").alias("line"), "path", held),
        people.select(F.concat("n_name", F.lit(" "), F.lower("c_mktsegment")).alias("view"), F.col("c_name").alias("line"), "path", held),
        away.select(F.concat("n_name", F.lit(" suppliers")).alias("view"), F.col("s_name").alias("line"),
                    F.concat(F.lit("/suppliers/"), F.col("s_name")).alias("path"), F.lit(1).alias("held_axes")),
        people.select(F.col("n_name").alias("view"), F.lit("base").alias("line"), F.col("nation").alias("path"),
                      F.lit(0).alias("held_axes")).distinct(),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


MATCHED = f"""{FACTS},
matched AS (
  SELECT view, count(*) AS named, count(*) FILTER (problem IS NULL) AS here FROM (
    SELECT DISTINCT v.view, v.path, {PROBLEM} AS problem FROM views v LEFT JOIN facts f ON f.path = v.path) GROUP BY 1),
stated AS (SELECT *, CASE WHEN here = 0 THEN 'none' WHEN here = named THEN 'full' ELSE 'partial' END AS state FROM matched)"""


@check("view_match", f"WITH {MATCHED} SELECT view, named, here, state FROM stated")
def _(spark, d):
    return views.view_match(saved_views(spark, d), view_facts(spark, d))


ISSUES = f"""{FACTS},
issues AS (
  SELECT v.view, v.line, v.path, coalesce({PROBLEM},
    CASE WHEN held_axes > rank THEN held_axes || ' subscripts for ' || rank || ' axes'
         WHEN held_axes = rank THEN 'not one line: one element'
         WHEN rank - held_axes > 1 THEN 'not one line: ' || (rank - held_axes) || ' axes left' END) AS reason
  FROM views v LEFT JOIN facts f ON f.path = v.path)"""


@check("view_issues", f"WITH {ISSUES} SELECT view, line, path, reason FROM issues WHERE reason IS NOT NULL")
def _(spark, d):
    return views.view_issues(saved_views(spark, d), view_facts(spark, d))


@check("issue_counts", f"WITH {ISSUES} SELECT view, reason, count(*) AS issues FROM issues WHERE reason IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return views.issue_counts(views.view_issues(saved_views(spark, d), view_facts(spark, d)))


@check("resolve_links_long", """
WITH k AS (SELECT c_custkey AS n FROM customer), top AS (SELECT max(n) AS most FROM k)
SELECT '/chain/' || n AS path, 'Dataset' AS kind, '/data/end' AS resolved FROM k
UNION ALL SELECT '/circle/' || n, 'Unresolved', NULL FROM k
UNION ALL SELECT '/turns/' || n, 'Group', '/g' FROM k
UNION ALL SELECT '/g/x', 'Group', '/g'""")
def _(spark, d):
    """A chain through every customer, a circle of all of them, and goals that run four
    times through one link."""
    n = F.col("c_custkey").cast("string")
    people = scan(spark, d, "customer", ["c_custkey"])
    least, most = people.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    name = lambda head, at: F.concat(F.lit(head), at)
    onward = (F.col("c_custkey") + 1).cast("string")
    last = F.col("c_custkey") == most
    soft = lambda path, target: people.select(path.alias("path"), F.lit("Dataset").alias("kind"), F.lit("soft").alias("link"), target.alias("target"))
    one = lambda path, kind, link, target: people.limit(1).select(
        F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.lit(link).alias("link"), F.lit(target).cast("string").alias("target"))
    listed = soft(name("/chain/", n), F.when(last, "/data/end").otherwise(name("/chain/", onward)))
    listed = listed.unionByName(soft(name("/circle/", n), name("/circle/", F.when(last, F.lit(str(least))).otherwise(onward))))
    listed = listed.unionByName(soft(name("/turns/", n), F.lit("/g" + "/x" * 4)))
    listed = listed.unionByName(one("/g/x", "Group", "soft", "/g")).unionByName(one("/data/end", "Dataset", "hard", None))
    found = catalog.resolve_links(catalog.build_nodes(listed))
    return found.where("link = 'soft'").select("path", "kind", "resolved")


@check("resolve_external", """
WITH RECURSIVE links AS (
  SELECT 'orders_' || o_orderkey % 7 AS file, '/of/' || o_orderkey AS path,
      'customers_' || o_custkey % 5 AS link_file, CASE WHEN o_orderkey % 11 = 0 THEN '/gone/' ELSE '/by_key/' END || o_custkey AS target FROM orders
  UNION ALL SELECT 'customers_' || c_custkey % 5, '/by_key/' || c_custkey,
      CASE WHEN c_custkey % 9 = 4 THEN 'customers_' || c_custkey % 5 WHEN c_custkey % 9 = 5 THEN 'lost' ELSE 'nations' END,
      CASE WHEN c_custkey % 9 = 4 THEN '/by_key/' || c_custkey ELSE '/n/' || c_nationkey END FROM customer),
walk AS (
  SELECT file, path, link_file AS f, target AS t, 1 AS used FROM links
  UNION ALL SELECT w.file, w.path, l.link_file, l.target, used + 1 FROM walk w JOIN links l ON l.file = w.f AND l.path = w.t WHERE used < 5)
SELECT l.file, l.path, coalesce(o.kind, 'Unresolved') AS kind, o.f AS resolved_file, o.t AS resolved
FROM links l LEFT JOIN (SELECT w.*, 'Dataset' AS kind FROM walk w JOIN nation ON f = 'nations' AND t = '/n/' || n_nationkey) o USING (file, path)""")
def _(spark, d):
    """Orders that point into files of customers, which point on into the nations' file."""
    text = lambda head, key: F.concat(F.lit(head), key.cast("string"))
    row = lambda df, file, path, link, target=None, away=None: df.select(
        file.alias("file"), path.alias("path"), F.lit("Dataset").alias("kind"), F.lit(link).alias("link"),
        *[(F.lit(None).cast("string") if c is None else c).alias(n) for c, n in ((target, "target"), (away, "link_file"))])
    c, o, key = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    orders = row(scan(spark, d, "orders", ["o_orderkey", "o_custkey"]), text("orders_", o % 7), text("/of/", o), "external",
                 F.when(o % 11 == 0, text("/gone/", key)).otherwise(text("/by_key/", key)), text("customers_", key % 5))
    people = scan(spark, d, "customer", ["c_custkey", "c_nationkey"])
    own, home = text("/by_key/", c), text("customers_", c % 5)
    turned = c % 9 == 4
    customers = row(people.where(~turned), home, own, "external", text("/n/", F.col("c_nationkey")), F.when(c % 9 == 5, "lost").otherwise("nations"))
    circles = row(people.where(turned), home, own, "soft", own)
    nations = row(scan(spark, d, "nation", ["n_nationkey"]), F.lit("nations"), text("/n/", F.col("n_nationkey")), "hard")
    listed = orders.unionByName(customers).unionByName(circles).unionByName(nations)
    listed = listed.withColumns({"name": catalog.name_of("path"), "parent": catalog.parent_of("path")})
    found = catalog.resolve_external(listed)
    return found.where("link <> 'hard'").select("file", "path", "kind", "resolved_file", "resolved")


@check("rank_views", f"""
WITH {MATCHED} SELECT view, state, row_number() OVER (ORDER BY CASE state WHEN 'full' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END,
  lower(view), view) - 1 AS place FROM stated""")
def _(spark, d):
    ranked = views.rank_views(views.view_match(saved_views(spark, d), view_facts(spark, d)))
    # The order as a column, so that the comparison sees it.
    keyed = ranked.withColumn("_k", F.when(F.col("state") == "full", 0).when(F.col("state") == "partial", 1).otherwise(2))
    keyed = keyed.withColumn("_l", F.lower("view"))
    return element_positions(keyed, ["_k", "_l", "view"], "place").select("view", "state", "place")


@check("outline_links", """
SELECT '/region/' || r_regionkey AS path, 'Dataset' AS kind, 0 AS rank, CAST(1 AS BIGINT) AS elements, 'scalar' AS readout FROM region
UNION ALL SELECT '/nation/' || n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Unresolved' ELSE 'Dataset' END, NULL, NULL,
  CASE WHEN n_nationkey % 3 = 0 THEN '→ /none/' || n_regionkey || '  (missing)' ELSE '→ /region/' || n_regionkey END FROM nation
UNION ALL SELECT '/part/' || p_size, 'NamedType', NULL, NULL, 'type ' || p_size FROM (SELECT DISTINCT p_size FROM part)
UNION ALL SELECT '/loop/' || s_nationkey, 'Group', NULL, NULL, 'cycle' FROM (SELECT DISTINCT s_nationkey FROM supplier)""")
def _(spark, d):
    at = lambda head, key: F.concat(F.lit(head), F.col(key).cast("string"))
    text = lambda value, name: F.lit(value).cast("string").alias(name)
    one = lambda df, path, kind, link="hard", target=None, of=None, cyclic=False: df.select(
        path.alias("path"), path.alias("name"), F.lit("/").alias("parent"), F.lit(kind).alias("kind"), F.lit(link).alias("link"),
        (text(None, "target") if target is None else target.alias("target")), (text(None, "type") if of is None else of.alias("type")),
        F.lit(cyclic).alias("cyclic"))
    regions = one(scan(spark, d, "region", ["r_regionkey"]), at("/region/", "r_regionkey"), "Dataset")
    goal = F.when(F.col("n_nationkey") % 3 == 0, at("/none/", "n_regionkey")).otherwise(at("/region/", "n_regionkey"))
    nations = one(scan(spark, d, "nation", ["n_nationkey", "n_regionkey"]), at("/nation/", "n_nationkey"), "Dataset", "soft", goal)
    types = one(scan(spark, d, "part", ["p_size"]).distinct(), at("/part/", "p_size"), "NamedType", of=at("type ", "p_size"))
    loops = one(scan(spark, d, "supplier", ["s_nationkey"]).distinct(), at("/loop/", "s_nationkey"), "Group", cyclic=True)
    nodes = regions.unionByName(nations).unionByName(types).unionByName(loops)
    kinds = catalog.resolve_links(nodes).select("path", F.col("kind").alias("_kind"))
    nodes = nodes.join(kinds, "path").withColumn("kind", F.col("_kind")).drop("_kind")
    shapes = regions.select("path", F.array().cast("array<bigint>").alias("shape"))
    return catalog.outline(nodes, shapes)


MEMBERS = """
WITH views AS (
  SELECT 'view ' || n_regionkey AS "view", n_name AS line, CASE WHEN n_nationkey % 2 = 0 THEN '/customers' ELSE '/events' END AS path,
    CASE n_nationkey % 6 WHEN 0 THEN 'c_acctbal' WHEN 2 THEN 'c_name' WHEN 4 THEN '' WHEN 1 THEN 'value' WHEN 3 THEN '' ELSE NULL END AS member,
    CAST(n_nationkey % 5 // 4 AS INT) AS held_axes FROM nation)"""


def member_views(spark, d):
    n = F.col("n_nationkey")
    rest = n % 6
    member = F.when(rest == 0, "c_acctbal").when(rest == 2, "c_name").when(rest.isin(4, 3), "").when(rest == 1, "value")
    return scan(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"]).select(
        F.concat(F.lit("view "), F.col("n_regionkey").cast("string")).alias("view"), F.col("n_name").alias("line"),
        F.when(n % 2 == 0, "/customers").otherwise("/events").alias("path"), member.alias("member"), F.expr("n_nationkey % 5 div 4").cast("int").alias("held_axes"))


def member_facts(spark, d):
    customers = scan(spark, d, "customer", ["c_acctbal", "c_name"])
    kinds = {f.name: (f.dataType.simpleString(), f.name == "c_acctbal", 0) for f in customers.schema}
    rows = [("/customers", "Dataset", "struct", False, 1, kinds), ("/events", "Dataset", "double", True, 1, None)]
    return spark.createDataFrame(rows, "path string, kind string, type string, numeric boolean, rank int, "
                                       "members map<string, struct<type: string, numeric: boolean, rank: int>>")


@check("view_match_members", f"""{MEMBERS}
SELECT "view", count(DISTINCT path) AS named, count(DISTINCT path) AS here, 'full' AS state FROM views GROUP BY 1""")
def _(spark, d):
    return views.view_match(member_views(spark, d), member_facts(spark, d))


@check("view_issues_members", f"""{MEMBERS}
SELECT * FROM (SELECT "view", line, path, CASE
  WHEN path = '/customers' AND member = 'c_name' THEN 'not numeric: string'
  WHEN path = '/customers' AND member = '' THEN 'a struct without a member'
  WHEN path = '/events' AND member = 'value' THEN 'no struct: double'
  WHEN held_axes = 1 THEN 'not one line: one element' END AS reason FROM views) WHERE reason IS NOT NULL""")
def _(spark, d):
    return views.view_issues(member_views(spark, d), member_facts(spark, d))
