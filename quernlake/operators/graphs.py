"""Property graphs as two tables: vertices (id, label, ...) and edges (src, dst, type, ...). Patterns are chains of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(paths: DataFrame, at: str, edges: DataFrame, to: str, kind: str | None = None, reverse: bool = False, where: Column | None = None) -> DataFrame:
    """Extend paths from the vertex in column `at` along edges of a type; the vertex reached is column `to`."""
    e = edges if kind is None else edges.where(F.col("type") == kind)
    e = e if where is None else e.where(where)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return paths.join(e.select(F.col(a).alias(at), F.col(b).alias(to)), at)


def match(vertices: DataFrame, edges: DataFrame, labels: list[str | None], kinds: list[str | None]) -> DataFrame:
    """All paths v0 -> v1 -> ... whose vertices have the given labels and whose edges the given types (None: any)."""
    pick = lambda i, label: (vertices if label is None else vertices.where(F.col("label") == label)).select(F.col("id").alias(f"v{i}"))
    paths = pick(0, labels[0])
    for i, kind in enumerate(kinds):
        paths = step(paths, f"v{i}", edges, f"v{i + 1}", kind)
        if labels[i + 1] is not None:
            paths = paths.join(pick(i + 1, labels[i + 1]), f"v{i + 1}", "left_semi")
    return paths.select(*[f"v{i}" for i in range(len(labels))])


def within_hops(starts: DataFrame, edges: DataFrame, least: int, most: int, kind: str | None = None) -> DataFrame:
    """Distinct (start, end, hops): vertices that paths of least..most edges reach, with the fewest edges."""
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("at"))
    found = None
    for n in range(1, most + 1):
        front = step(front, "at", edges, "next", kind).select("start", F.col("next").alias("at")).distinct()
        if n >= least:
            here = front.withColumn("hops", F.lit(n))
            found = here if found is None else found.unionByName(here)
    return found.groupBy("start", F.col("at").alias("end")).agg(F.min("hops").alias("hops"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return vertices.select("id").join(out, "id", "left").join(into, "id", "left").fillna(0, ["out_degree", "in_degree"])


def set_properties(vertices: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """The vertices with properties set, or added, where the condition holds; elsewhere a new property is null."""
    for name, value in values.items():
        old = F.col(name) if name in vertices.columns else F.lit(None)
        vertices = vertices.withColumn(name, F.when(F.coalesce(where, F.lit(False)), value).otherwise(old))
    return vertices


def remove(vertices: DataFrame, edges: DataFrame, where: Column, detach: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without the vertices for which the condition holds, and without their edges; not detached, vertices that have edges stay."""
    gone = vertices.where(where).select("id")
    if not detach:
        gone = gone.join(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))), "id", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return vertices.join(gone, "id", "left_anti"), edges
