"""Text formats: edge lists, sectioned graph and specification files, statistics rows, plot data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

LINK = r"^\s*(\d+)_fso(\d+)To(\d+)_fso(\d+)\s+([-+0-9.eE]+)\s*(\S*)\s*$"


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of `u,v` lines; ends keep their order, unreadable lines are dropped."""
    return spark.read.schema("src bigint, dst bigint").option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).csv(path)


def edges_with_type(edges: DataFrame, nodes: DataFrame, short: float, long: float) -> DataFrame:
    """Adds con_type by the distance of the ends."""
    n = nodes.select("node_id", "x", "y")
    a = n.select(F.col("node_id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = n.select(F.col("node_id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d2 = G.squared_distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", G.edge_type(d2, short, long).alias("con_type"))


def tag_sections(lines: DataFrame, file: str = "file", no: str = "line_no", line: str = "value", block: str | None = None) -> DataFrame:
    """Adds the section each line stands in; section headers end in a colon and are dropped.

    With `block`, the part of the file a line was read in, lines are put in order within each part only; the
    last header of the parts before, one row for each part, is carried to it.
    """
    sofar = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.regexp_extract(F.trim(line), r"^([A-Za-z ]+):$", 1)
    keys = [file] if block is None else [file, block]
    tagged = lines.withColumn("_h", F.when(head != "", head)).withColumn("section", F.last("_h", ignorenulls=True).over(sofar(Window.partitionBy(*keys).orderBy(no))))
    if block is not None:
        last = tagged.groupBy(*keys).agg(F.max_by("section", no).alias("_l"))
        before = F.last("_l", ignorenulls=True).over(Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
        tagged = tagged.join(last.select(*keys, before.alias("_b")), keys).withColumn("section", F.coalesce("section", "_b")).drop("_b")
    return tagged.where(F.col("_h").isNull() & (F.trim(line) != "")).drop("_h")


def read_spec(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of flow specification files: sources, ports, links and gateways, each with its file.

    Large files are read in parts; lines are in order within a part, parts by where they start.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.rtrim("value").alias("value"))
    lines = tag_sections(read, block="block")
    of = lambda s: lines.where(F.lower("section") == s.lower())
    port = F.regexp_extract("value", r"^\s*(\d+)_fso(\d+)", 1), F.regexp_extract("value", r"^\s*(\d+)_fso(\d+)", 2)
    link = [F.regexp_extract("value", LINK, k) for k in range(1, 7)]
    return {
        "sources": of("trafficSources").select("file", F.trim("value").cast("bigint").alias("node")),
        "ports": of("FSONodes").select("file", port[0].cast("bigint").alias("node"), port[1].cast("int").alias("port")),
        "links": of("FSOLinks").select("file", link[0].cast("bigint").alias("u"), link[1].cast("int").alias("u_port"), link[2].cast("bigint").alias("v"), link[3].cast("int").alias("v_port"), link[4].cast("double").alias("capacity"), link[5].alias("unit")),
        "gateways": of("gateways").select("file", F.trim("value").cast("bigint").alias("node")),
    }


def _sections(*parts: tuple[str, DataFrame, list]) -> DataFrame:
    """Lines of sections: (section_no, row_no keys..., value) in one sortable table."""
    out = []
    for k, (title, df, order) in enumerate(parts):
        head = df.sparkSession.range(1).select(F.lit(k).alias("s"), F.lit(0).alias("h"), F.array().cast("array<bigint>").alias("o"), F.lit(title).alias("value"))
        out += [head, df.select(F.lit(k).alias("s"), F.lit(1).alias("h"), F.array(*[F.col(c).cast("bigint") for c in order]).alias("o"), F.col("value"))]
    return reduce(DataFrame.unionAll, out).orderBy("s", "h", "o").select("value")


def graph_lines(nodes: DataFrame, edges: DataFrame, gateways: DataFrame) -> DataFrame:
    """Lines of `Nodes:` n x y, `Edges:` u v type, `Gateways:` g."""
    n = nodes.withColumn("value", F.concat_ws(" ", "node_id", "x", "y"))
    e = edges.withColumn("value", F.concat_ws(" ", "src", "dst", "con_type"))
    g = gateways.withColumn("value", F.col("node_id").cast("string"))
    return _sections(("Nodes:", n, ["node_id"]), ("Edges:", e, ["src", "dst"]), ("Gateways:", g, ["node_id"]))


def los_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tab-separated lines of `Node Positions` and `Edges`."""
    n = nodes.withColumn("value", F.concat_ws("\t", "node_id", "x", "y"))
    e = edges.withColumn("value", F.concat_ws("\t", "src", "dst", "con_type"))
    return _sections(("Node Positions", n, ["node_id"]), ("Edges", e, ["src", "dst"]))


def ports(nodes: DataFrame, gateways: DataFrame, per_node: int, per_gateway: int) -> DataFrame:
    """(node_id, port): the transceivers of each node."""
    g = gateways.select("node_id", F.lit(True).alias("g")).distinct()
    k = F.when(F.col("g"), per_gateway).otherwise(per_node)
    return nodes.select("node_id").distinct().join(g, "node_id", "left").select("node_id", F.explode(F.sequence(F.lit(1), k)).alias("port"))


def dynamic_links(edges: DataFrame, all_ports: DataFrame) -> DataFrame:
    """(u, u_port, v, v_port): every transceiver of u with every one of v, both ways, for each edge."""
    both = edges.select(F.inline(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))))
    a = all_ports.select(F.col("node_id").alias("u"), F.col("port").alias("u_port"))
    b = all_ports.select(F.col("node_id").alias("v"), F.col("port").alias("v_port"))
    return both.join(a, "u").join(b, "v").select("u", "u_port", "v", "v_port")


def static_links(edges: DataFrame) -> DataFrame:
    """(u, u_port, v, v_port): one transceiver pair for each edge; ports are numbered along the edges of a node."""
    ends = edges.select("src", "dst", F.explode(F.array("src", "dst")).alias("n"))
    w = Window.partitionBy("n").orderBy("src", "dst")
    n = ends.withColumn("port", F.row_number().over(w))
    at = lambda c: F.max(F.when(F.col("n") == F.col(c), F.col("port")))
    one = n.groupBy("src", "dst").agg(at("src").alias("p"), at("dst").alias("q"))
    return one.select(F.inline(F.array(F.struct(F.col("src").alias("u"), F.col("p").alias("u_port"), F.col("dst").alias("v"), F.col("q").alias("v_port")), F.struct(F.col("dst").alias("u"), F.col("q").alias("u_port"), F.col("src").alias("v"), F.col("p").alias("v_port")))))


def spec_lines(sources: DataFrame, all_ports: DataFrame, links: DataFrame, gateways: DataFrame, capacity: float, unit: str = "Mbps") -> DataFrame:
    """Lines of a flow specification."""
    s = sources.withColumn("value", F.col("node_id").cast("string"))
    p = all_ports.withColumn("value", F.format_string("%d_fso%d", F.col("node_id"), F.col("port")))
    k = links.withColumn("value", F.concat(F.format_string("%d_fso%dTo%d_fso%d ", F.col("u"), F.col("u_port"), F.col("v"), F.col("v_port")), F.lit(f"{capacity:g}{unit}")))
    g = gateways.withColumn("value", F.col("node_id").cast("string"))
    return _sections(("trafficSources:", s, ["node_id"]), ("FSONodes:", p, ["node_id", "port"]), ("FSOLinks:", k, ["u", "v", "u_port", "v_port"]), ("gateways:", g, ["node_id"]))


def used_ports(links: DataFrame) -> DataFrame:
    """(node_id, port) of the transceivers that static links use: what the FSONodes section of their specification lists."""
    return links.select(F.col("u").alias("node_id"), F.col("u_port").alias("port")).distinct()


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.write.mode(mode).text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst").write.mode("overwrite").csv(path)


def read_stats(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of a statistics file without header, by its fixed layout; N/A and empty cells are null."""
    return spark.read.schema(", ".join(f"`{c}` {t}" for c, t in columns.items())).option("nullValue", "N/A").csv(path)


def append_stats(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("nullValue", "N/A").csv(path)


def plot_nodes(nodes: DataFrame, gateways: DataFrame, members: DataFrame) -> DataFrame:
    """What a plot shows of each node: gateway, member of the network, or other."""
    g, m = gateways.select("node_id", F.lit(True).alias("g")).distinct(), members.select("node_id", F.lit(True).alias("m")).distinct()
    return nodes.join(g, "node_id", "left").join(m, "node_id", "left").select("node_id", "x", "y", F.when(F.col("g"), "gateway").when(F.col("m"), "member").otherwise("other").alias("kind"))


def plot_series(rows: DataFrame, x: str, series: list[str]) -> DataFrame:
    """(series, x, y): the points of curves that share an axis."""
    return rows.select(F.col(x).alias("x"), F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("y")) for c in series]))).select("series", "x", "y")


def plot_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Line segments of a plot: both ends and the edge type."""
    a = nodes.select(F.col("node_id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "con_type", "x1", "y1", "x2", "y2")
