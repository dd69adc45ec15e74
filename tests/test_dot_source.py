"""DOT text as tools write it, and graphs through the data source."""

import pytest
from pyspark.sql import functions as F

from kitefin.operators import graph, iterate, reports
from kitefin.sources import dot_source


def parsed(text):
    return [(k, c, n, d, a) for k, c, _, n, d, a in dot_source.statements(text)]


def test_statements():
    text = """// made by hand
    strict digraph "G x" { rankdir=LR; node [shape=box, color="red"]; graph [label="all"]
      "a.1" [file="/x/y", type=INIT][recommendation="NORMAL"]; b; c -> d -> "e\\"q" [style=dashed; weight=2] /* two
      edges */ subgraph cluster_0 { label="Subgraph 0"; f [x = "1, ] }"]
        subgraph plain { g } { h; i->j }
        subgraph "cluster_1" { label = <b <i>t</i>>; k } }
      l:port:n -> m:w; "one" + "two" -> -3.5; # not a comment inside
      "\\n";
    }
    digraph second { z }"""
    got = parsed(text.replace("# not a comment inside", ""))
    assert got == [
        ("node", None, "a.1", None, {"file": "/x/y", "type": "INIT", "recommendation": "NORMAL"}),
        ("node", None, "b", None, {}),
        ("edge", None, "c", "d", {"style": "dashed", "weight": "2"}),
        ("edge", None, "d", 'e"q', {"style": "dashed", "weight": "2"}),
        ("node", "cluster_0", "f", None, {"x": "1, ] }"}),
        ("node", "cluster_0", "g", None, {}),
        ("node", "cluster_0", "h", None, {}),
        ("edge", "cluster_0", "i", "j", {}),
        ("node", "cluster_1", "k", None, {}),
        ("edge", None, "l", "m", {}),
        ("edge", None, "onetwo", "-3.5", {}),
    ]
    labels = {n: label for _, _, label, n, _, _ in dot_source.statements(text.replace("# not a comment inside", ""))}
    assert labels["h"] == "Subgraph 0" and labels["k"] == "<b <i>t</i>>" and labels["b"] is None
    assert parsed("") == [] and parsed("graph { a -- b }") == [("edge", None, "a", "b", {})] and parsed("digraph{}") == []
    assert parsed('# line\ndigraph {\n# another\na\n}') == [("node", None, "a", None, {})]
    with pytest.raises(ValueError):
        parsed("digraph { a -> }")


def rows(df):
    return sorted((r.kind, r.cluster or "", r.cluster_label or "", r.name, r.dst or "", tuple(sorted((r.attributes or {}).items()))) for r in df.collect())


def test_clusters_written_and_read(spark, tmp_path):
    pairs = [("a", "b"), ("b", "c"), ('d"q', "e \\ f"), ("g", "g")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = graph.endpoints(edges).unionByName(spark.createDataFrame([("alone",)], "name string"))
    members = reports.rank_components(iterate.components(edges, nodes)).withColumns({"file": F.concat(F.lit("/x/"), F.length("name").cast("string")), "type": F.when(F.col("name") == "a", "INIT")})
    path = str(tmp_path / "out")
    for _ in range(2):  # the second time over the first
        dot_source.write_clusters(members, edges, path)
        back = dot_source.read_dot(spark, path)
        found = rows(back)
        ranks = {r.name: r["rank"] for r in members.collect()}
        assert [(n, c) for k, c, _, n, _, _ in found if k == "node"] == sorted(((n, f"cluster_{k}") for n, k in ranks.items()), key=lambda x: (x[1], x[0]))
        assert sorted((n, d) for k, _, _, n, d, _ in found if k == "edge") == sorted(pairs)
        assert ("node", f"cluster_{ranks['a']}", f"Subgraph {ranks['a']}", "a", "", (("file", "/x/1"), ("type", "INIT"))) in found
    assert not list((tmp_path / "out").glob("_writing*"))
    # Written as it was read, it is the same; of files alone, and of one kind, the rest isn't read.
    dot_source.register(spark)
    back.withColumn("path", F.lit(None).cast("string")).coalesce(1).sortWithinPartitions(F.desc("kind"), "cluster").write.format("dot").mode("append").save(str(tmp_path / "again"))
    assert [r for r in rows(dot_source.read_dot(spark, str(tmp_path / "again")))] == [(k, c if k == "node" else "", label if k == "node" else "", *rest) for k, c, label, *rest in found]
    assert back.filter("kind = 'edge'").count() == 4
    one = sorted((tmp_path / "out").glob("*.dot"))[0]
    assert back.filter(F.col("path") == str(one)).select("path").distinct().count() == 1


def test_reader_prunes(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    for k in range(3):
        (tmp_path / f"{k}.dot").write_text(f"digraph {{ n{k} -> m }}")
    (tmp_path / "other.txt").write_text("no graph")
    reader = dot_source.DotReader(str(tmp_path), r"\.dot$")
    left = list(reader.pushFilters([EqualTo(("path",), str(tmp_path / "1.dot")), GreaterThan(("name",), "a")]))
    assert left == [GreaterThan(("name",), "a")] and [p.path for p in reader.partitions()] == [str(tmp_path / "1.dot")]
    reader = dot_source.DotReader(str(tmp_path), r"\.dot$")
    assert list(reader.pushFilters([EqualTo(("kind",), "node")])) == [] and len(reader.partitions()) == 3
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == []
    with pytest.raises(FileNotFoundError):
        dot_source.DotReader(str(tmp_path / "none"), "").partitions()
