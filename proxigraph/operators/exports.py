"""Graphs as text: one row per line of the file, in order, so a sink is a text write of one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxigraph.functions.columns import csv_field
from proxigraph.operators.local import _CLU, local_clustering
from proxigraph.operators.subgraph import _K, _WIN, growth
from proxigraph.plans.graph import TYPES, Graph, co_part, sql
from proxigraph.plans.numbering import numbered


def xml(c: Column) -> Column:
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _lines(g: Graph, head: list[str], node: Column, middle: list[str], edge: Column, tail: list[str]) -> DataFrame:
    spark = g.edges.sparkSession
    fixed = spark.createDataFrame([(k, i, "", x) for k, part in ((0, head), (2, middle), (4, tail)) for i, x in enumerate(part)], "part int, n int, k string, line string")
    v = g.vertices.select(F.lit(1).alias("part"), F.lit(0).alias("n"), F.col("id").alias("k"), node.alias("line"))
    e = g.edges.select(F.lit(3).alias("part"), F.lit(0).alias("n"), F.concat_ws(" ", "src", "dst").alias("k"), edge.alias("line"))
    return fixed.unionByName(v).unionByName(e)


def graphml(g: Graph) -> DataFrame:
    i, s, t = xml(F.col("id")), xml(F.col("src")), xml(F.col("dst"))
    return _lines(g, ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>', '<graph edgedefault="undirected">'], F.concat(F.lit('<node id="'), i, F.lit('"/>')), [],
                  F.concat(F.lit('<edge source="'), s, F.lit('" target="'), t, F.lit('"><data key="weight">'), F.col("weight").cast("string"), F.lit("</data></edge>")), ["</graph>", "</graphml>"])


def dot(g: Graph) -> DataFrame:
    return _lines(g, ["graph G {"], F.concat(quoted(F.col("id")), F.lit(";")), [], F.concat(quoted(F.col("src")), F.lit(" -- "), quoted(F.col("dst")), F.lit(";")), ["}"])


def gexf(g: Graph) -> DataFrame:
    i, s, t = xml(F.col("id")), xml(F.col("src")), xml(F.col("dst"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="undirected">', "<nodes>"]
    edge = F.concat(F.lit('<edge source="'), s, F.lit('" target="'), t, F.lit('" weight="'), F.col("weight").cast("string"), F.lit('" label="'), xml(F.coalesce("type", F.lit(""))), F.lit('"/>'))
    return _lines(g, head, F.concat(F.lit('<node id="'), i, F.lit('" label="'), i, F.lit('"/>')), ["</nodes>", "<edges>"], edge, ["</edges>", "</graph>", "</gexf>"])


def mermaid(g: Graph) -> DataFrame:
    """Characters that Mermaid does not take in a name become underscores; the name proper is the label."""
    name = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_]", "_")
    node = F.when(F.col("id").rlike("[^A-Za-z0-9_]"), F.concat(name("id"), F.lit('["'), F.replace("id", F.lit('"'), F.lit("#quot;")), F.lit('"]'))).otherwise(F.col("id"))
    return _lines(g, ["graph LR"], F.concat(F.lit("  "), node), [], F.concat(F.lit("  "), name("src"), F.lit(" --- "), name("dst")), [])


def write(lines: DataFrame, path: str) -> None:
    """Files in order of their names, each a stretch of the lines; a small graph is one file."""
    order = [F.col(c) for c in ("part", "n", "k")]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def dimacs(g: Graph) -> DataFrame:
    """The ``p edge n m`` line, and ``e i j`` lines with numbers from 1 in order of id."""
    n = numbered(g.vertices.select("id"), [F.col("id")], "n")
    counts = g.vertices.agg(F.count("*").alias("a")).join(g.edges.agg(F.count("*").alias("b")))  # one row
    return counts.select(F.concat_ws(" ", F.lit("p edge"), "a", "b").alias("line")).unionByName(_dimacs_edges(g, n))


def _dimacs_edges(g: Graph, n: DataFrame) -> DataFrame:
    return g.edges.select("src", "dst").join(n.select(F.col("id").alias("src"), F.col("n").alias("i")), "src").join(n.select(F.col("id").alias("dst"), F.col("n").alias("j")), "dst").select(F.concat_ws(" ", F.lit("e"), F.least("i", "j"), F.greatest("i", "j")).alias("line"))


def adjacency_lists(g: Graph) -> DataFrame:
    n = g.both().groupBy(F.col("v").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("u")), " ").alias("nbrs"))
    return g.vertices.join(n, "id", "left").select("id", F.coalesce("nbrs", F.lit("")).alias("neighbours"))


def laplacian(g: Graph) -> DataFrame:
    """Long form (i, j, v): degrees on the diagonal, -1 for edges."""
    return g.degrees().select(F.col("id").alias("i"), F.col("id").alias("j"), "degree").unionByName(g.both().select(F.col("v").alias("i"), F.col("u").alias("j"), F.lit(-1).cast("long").alias("degree"))).withColumnRenamed("degree", "x")


def adjacency_matrix(g: Graph) -> DataFrame:
    """Long form (i, j, x): 1 for an edge, either way; absent cells are 0."""
    return g.both().select(F.col("v").alias("i"), F.col("u").alias("j"), F.lit(1).alias("x"))


def incidence_matrix(g: Graph) -> DataFrame:
    """Long form (v, e, x): 1 for both ends of the edge named ``src|dst``."""
    e = F.concat_ws("|", "src", "dst")
    return g.edges.select(F.explode(F.array("src", "dst")).alias("v"), e.alias("e"), F.lit(1).alias("x"))


def normalised_laplacian(g: Graph) -> DataFrame:
    """Long form (i, j, x): 1 on the diagonal of vertices with edges, -1 / sqrt(d_i d_j) for edges."""
    d = g.degrees()
    e = g.both().join(d.select(F.col("id").alias("v"), F.col("degree").alias("a")), "v").join(d.select(F.col("id").alias("u"), F.col("degree").alias("b")), "u")
    off = e.select(F.col("v").alias("i"), F.col("u").alias("j"), F.round(-1 / F.sqrt(F.col("a").cast("double") * F.col("b")), 9).alias("x"))
    return d.filter("degree > 0").select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("x")).unionByName(off)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(part, line): a header, then a line per row with fields escaped."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, ",".join(columns))], "part int, line string")
    return head.unionByName(rows.select(F.lit(1).alias("part"), F.concat_ws(",", *[csv_field(F.col(c).cast("string")) for c in columns]).alias("line")))


def node_metrics_csv(g: Graph) -> DataFrame:
    """Degree, edges by type, clustering with six decimals."""
    t = g.both("type").groupBy(F.col("v").alias("id")).agg(*[F.sum(F.when(F.col("type") == x, 1).otherwise(0)).alias(x) for x in TYPES])
    m = local_clustering(g).join(t, "id", "left").select("id", "degree", *[F.coalesce(x, F.lit(0)).alias(x) for x in TYPES], F.format_string("%.6f", "clustering").alias("clustering"))
    return csv_lines(m, ["id", "degree", *TYPES, "clustering"])


def timeline_csv(g: Graph, k: int) -> DataFrame:
    return csv_lines(growth(g, k).select("w", "n", "m"), ["w", "n", "m"])


def json_nodes(g: Graph) -> DataFrame:
    return g.vertices.select(F.to_json(F.struct("id")).alias("line"))


def json_links(g: Graph) -> DataFrame:
    return g.edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type")).alias("line"))


QUERIES = {
    "export_graphml": lambda s, d: graphml(co_part(s, d)).select("part", "line"),
    "export_dot": lambda s, d: dot(co_part(s, d)).select("part", "line"),
    "export_mermaid": lambda s, d: mermaid(co_part(s, d)).select("part", "line"),
    "export_gexf": lambda s, d: gexf(co_part(s, d)).select("part", "line"),
    "export_adjacency_matrix": lambda s, d: adjacency_matrix(co_part(s, d)),
    "export_incidence_matrix": lambda s, d: incidence_matrix(co_part(s, d)),
    "export_normalised_laplacian": lambda s, d: normalised_laplacian(co_part(s, d)),
    "export_node_metrics_csv": lambda s, d: node_metrics_csv(co_part(s, d)),
    "export_timeline_csv": lambda s, d: timeline_csv(co_part(s, d), _K),
    "export_json_nodes": lambda s, d: json_nodes(co_part(s, d)),
    "export_dimacs": lambda s, d: dimacs(co_part(s, d)),
    "export_adjacency_lists": lambda s, d: adjacency_lists(co_part(s, d)),
    "export_laplacian": lambda s, d: laplacian(co_part(s, d)),
    "export_json_links": lambda s, d: json_links(co_part(s, d)),
}
SQL = {
    "export_dot": sql("SELECT 0 AS part, 'graph G {' AS line UNION ALL SELECT 1, '\"' || id || '\";' FROM v UNION ALL SELECT 3, '\"' || src || '\" -- \"' || dst || '\";' FROM e UNION ALL SELECT 4, '}'"),
    "export_graphml": sql("""SELECT 0 AS part, unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>', '<graph edgedefault="undirected">']) AS line UNION ALL SELECT 1, '<node id="' || id || '"/>' FROM v
 UNION ALL SELECT 3, '<edge source="' || src || '" target="' || dst || '"><data key="weight">' || weight::VARCHAR || '</data></edge>' FROM e UNION ALL SELECT 4, unnest(['</graph>', '</graphml>'])"""),
    "export_mermaid": sql("SELECT 0 AS part, 'graph LR' AS line UNION ALL SELECT 1, '  ' || id FROM v UNION ALL SELECT 3, '  ' || src || ' --- ' || dst FROM e"),
    "export_gexf": sql("""SELECT 0 AS part, unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3">', '<graph defaultedgetype="undirected">', '<nodes>']) AS line UNION ALL SELECT 1, '<node id="' || id || '" label="' || id || '"/>' FROM v
 UNION ALL SELECT 2, unnest(['</nodes>', '<edges>']) UNION ALL SELECT 3, '<edge source="' || src || '" target="' || dst || '" weight="' || weight::VARCHAR || '" label="' || type || '"/>' FROM e UNION ALL SELECT 4, unnest(['</edges>', '</graph>', '</gexf>'])"""),
    "export_adjacency_matrix": sql("SELECT v AS i, u AS j, 1 AS x FROM s"),
    "export_incidence_matrix": sql("SELECT unnest([src, dst]) AS v, src || '|' || dst AS e, 1 AS x FROM e"),
    "export_normalised_laplacian": sql("SELECT id AS i, id AS j, 1.0::DOUBLE AS x FROM d WHERE degree > 0 UNION ALL SELECT s.v, s.u, round(-1 / sqrt(a.degree::DOUBLE * b.degree), 9) FROM s JOIN d a ON a.id = s.v JOIN d b ON b.id = s.u"),
    "export_node_metrics_csv": sql("SELECT 0 AS part, 'id,degree,f,c,fs,s,sg,clustering' AS line UNION ALL SELECT 1, concat_ws(',', id, degree, " + ", ".join(f"(SELECT count(*) FROM s WHERE s.v = cl.id AND s.type = '{t}')" for t in TYPES) + ", printf('%.6f', clustering)) FROM cl", _CLU),
    "export_timeline_csv": sql("SELECT 0 AS part, 'w,n,m' AS line UNION ALL SELECT 1, concat_ws(',', w, n, m) FROM gr", _WIN),
    "export_json_nodes": sql("""SELECT '{"id":"' || id || '"}' AS line FROM v"""),
    "export_dimacs": sql("SELECT 'p edge ' || (SELECT count(*) FROM v) || ' ' || (SELECT count(*) FROM e) AS line UNION ALL SELECT 'e ' || least(x.n, y.n) || ' ' || greatest(x.n, y.n) AS line FROM e JOIN num x ON x.id = src JOIN num y ON y.id = dst", "num AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM v)"),
    "export_adjacency_lists": sql("SELECT id, coalesce(n, '') AS neighbours FROM v LEFT JOIN (SELECT v AS x, string_agg(u, ' ' ORDER BY u) AS n FROM s GROUP BY v) ON x = id"),
    "export_laplacian": sql("SELECT id AS i, id AS j, degree AS x FROM d UNION ALL SELECT v, u, -1 FROM s"),
    "export_json_links": sql("""SELECT '{"source":"' || src || '","target":"' || dst || '","type":"' || type || '"}' AS line FROM e"""),
}
