"""Command line: `advise` directories, `combine` adjacency text into one graph, `partition` a graph into components, as a table or as DOT clusters."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import graph, iterate, labels, reports
from .plans.advise import advise, by_subsystem
from .sources import dot_source, graphs, sinks, text_lines


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kitefin", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("advise", "nodes, edges and labels as Parquet (folders below the input) to advice and summaries"), ("combine", "adjacency text files to nodes and edges"), ("partition", "edges as Parquet to ranked components")):
        sub = commands.add_parser(name, help=what)
        sub.add_argument("-i", "--input", required=True)
        sub.add_argument("-o", "--output", required=True)
    commands.choices["advise"].add_argument("-s", "--subsystem", help="a single directory; all, at every depth, without it")
    commands.choices["combine"].add_argument("--points-to", action="store_true")
    commands.choices["partition"].add_argument("--dot", action="store_true", help="DOT files with a cluster a component instead of Parquet")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("kitefin").getOrCreate()
    read = lambda name: spark.read.parquet(f"{given.input}/{name}")
    if given.command == "advise":
        nodes, edges = by_subsystem(labels.label_types(read("nodes"), read("labels")), read("edges"))
        if given.subsystem:
            nodes, edges = (x.filter(F.col("subsystem") == given.subsystem) for x in (nodes, edges))
        sinks.write_advice(advise(nodes, edges, read("edges").select("src", "dst").distinct()), f"{given.output}/advice")
        summaries = reports.summary(spark.read.parquet(f"{given.output}/advice"))
        summaries.write.mode("overwrite").parquet(f"{given.output}/summary")
        sinks.write_module_lists(nodes, nodes.select("subsystem").distinct().join(summaries, "subsystem", "left_anti"), f"{given.output}/modules")
    elif given.command == "combine":
        nodes, edges = graphs.adjacency(text_lines.read_lines(spark, given.input), given.points_to)
        whole, joined = graph.union_first_wins(nodes.select(F.col("file").alias("graph"), "name", "file"), edges.withColumnRenamed("file", "graph"))
        whole.write.mode("overwrite").parquet(f"{given.output}/nodes")
        joined.write.mode("overwrite").parquet(f"{given.output}/edges")
    else:
        edges = spark.read.parquet(given.input)
        members = iterate.components(edges, graph.endpoints(edges))
        ranked = reports.rank_components(members)
        if given.dot:
            dot_source.write_clusters(ranked, edges, given.output)
        else:
            ranked.write.mode("overwrite").parquet(given.output)


if __name__ == "__main__":
    main()
