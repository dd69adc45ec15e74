"""DOT graphs as a data source: `register(spark)`, then `spark.read.format("dot")` and `df.write.format("dot")`.

Rows are statements, nodes and edges alike: path, kind (`node` or `edge`), cluster (the name of the innermost subgraph that
is a cluster), cluster_label, name, dst (of edges), attributes. Reading takes DOT as graph tools write it: several
statements a line or one over many lines, chains `a -> b -> c`, attributes in any order and in several brackets, quoted
names, nested subgraphs, ports, comments. Of each file the first graph is read. Files are partitions; a filter on `path` or
`kind` is pushed down: other files aren't opened, other statements make no rows.

Writing makes a folder of files, one for each task, each a graph of its own with clusters around its nodes and edges behind
them, and moves them to their names when all tasks are done. `write_clusters` deals rows so that a cluster is in one file.
Paths are those of pyarrow's file systems, local ones, HDFS and object stores among them.
"""

from __future__ import annotations

import dataclasses
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, kind string, cluster string, cluster_label string, name string, dst string, attributes map<string,string>"
BATCH = 10_000

_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?m:^\s*\#[^\n]*)|(?P<quoted>"(?:[^"\\]|\\.)*")|(?P<html><(?:[^<>]|<[^<>]*>)*>)|(?P<arrow>->|--)|(?P<mark>[{}\[\];,=:+])|(?P<word>[^\s"{}\[\];,=:<>+\-]+(?:-(?![>-])[^\s"{}\[\];,=:<>+\-]+)*|-[^\s"{}\[\];,=:<>]+)', re.DOTALL)


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, value): quoted, word, html, arrow or mark; quotes are taken off and joined by a plus."""
    at, joined, held = 0, False, None
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"not DOT: {text[at : at + 40]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "quoted":
            said = re.sub(r"\\\n", "", m[kind][1:-1]).replace('\\"', '"')
            held, joined = ((held or "") + said if joined else said), False
            if held is not None and not joined:
                look = re.compile(r"\s*\+\s*(?=\")").match(text, at)
                if look:
                    at, joined = look.end(), True
                    continue
            yield "quoted", held
            held = None
        else:
            yield kind, m[kind]


def statements(text: str) -> Iterator[tuple[str, str | None, str | None, str, str | None, dict[str, str]]]:
    """(kind, cluster, cluster_label, name, dst, attributes) of the first graph in a text. A cluster's label counts for
    what comes behind it."""
    found = list(tokens(text))
    k, n = 0, len(found)
    while k < n and found[k] != ("mark", "{"):
        k += 1
    if k == n:
        return
    k += 1
    stack: list[list[str | None]] = [[None, None]]  # clusters around: name, label

    def is_(at: int, *values: str) -> bool:
        return at < n and found[at][0] in ("mark", "arrow") and found[at][1] in values

    def name_at(at: int) -> tuple[str, int]:
        """A name and what follows its port."""
        if at >= n or found[at][0] in ("mark", "arrow"):
            raise ValueError(f"a name is missing before {found[at : at + 1]}")
        name, at = found[at][1], at + 1
        while is_(at, ":"):
            at += 2
        return name, at

    def attributes_at(at: int) -> tuple[dict[str, str], int]:
        out: dict[str, str] = {}
        while is_(at, "["):
            at += 1
            while not is_(at, "]"):
                if is_(at, ",", ";"):
                    at += 1
                    continue
                key, at = name_at(at)
                value = "true"
                if is_(at, "="):
                    value, at = name_at(at + 1)
                out[key] = value
            at += 1
        return out, at

    while k < n and stack:
        if is_(k, ";", ","):
            k += 1
        elif is_(k, "}"):
            stack.pop()
            k += 1
        elif is_(k, "{"):
            stack.append(list(stack[-1]))
            k += 1
        elif found[k][0] == "word" and found[k][1].lower() == "subgraph":
            k += 1
            inner = list(stack[-1])
            if not is_(k, "{"):
                name, k = name_at(k)
                if name.startswith("cluster"):
                    inner = [name, None]
            if not is_(k, "{"):
                raise ValueError("a subgraph without a body")
            stack.append(inner)
            k += 1
        elif found[k][0] == "word" and found[k][1].lower() in ("node", "edge", "graph") and is_(k + 1, "["):
            held, k2 = attributes_at(k + 1)
            if found[k][1].lower() == "graph" and "label" in held and stack[-1][0] is not None:
                stack[-1][1] = held["label"]
            k = k2
        else:
            name, k = name_at(k)
            if is_(k, "="):
                value, k = name_at(k + 1)
                if name == "label" and stack[-1][0] is not None:
                    stack[-1][1] = value
                continue
            chain = [name]
            while is_(k, "->", "--"):
                name, k = name_at(k + 1)
                chain.append(name)
            held, k = attributes_at(k)
            cluster, label = stack[-1]
            if len(chain) == 1:
                if chain[0] not in ("\\n", "\n"):  # what some writers leave at the end of a file
                    yield "node", cluster, label, chain[0], None, held
            for a, b in zip(chain, chain[1:]):
                yield "edge", cluster, label, a, b, held


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclasses.dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class DotReader(DataSourceReader):
    def __init__(self, path: str, glob: str):
        self.path, self.glob = path, re.compile(glob)
        self.only: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("path",), ("kind",)) and f.attribute[0] not in self.only:
                self.only[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[_File]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [path] if info.type == fs.FileType.File else sorted(x.path for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and self.glob.search(x.path) and not re.search(r"/[_.][^/]*(/|$)", x.path[len(path) :]))
        return [_File(p) for p in found if self.only.get("path", p) == p] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _opened(self.path)
        with system.open_input_stream(partition.path) as f:
            text = f.read().decode("utf-8", "replace")
        schema = pa.schema([(c, pa.string()) for c in ("path", "kind", "cluster", "cluster_label", "name", "dst")] + [("attributes", pa.map_(pa.string(), pa.string()))])
        rows: list[tuple] = []
        for s in statements(text):
            if self.only.get("kind", s[0]) == s[0]:
                rows.append((partition.path, *s[:5], list(s[5].items())))
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


@dataclasses.dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


def quoted(name: str) -> str:
    return '"' + name.replace('"', '\\"') + '"'


def _attributes(held: dict[str, str] | None) -> str:
    said = ", ".join(f"{k if re.fullmatch(r'[A-Za-z_][A-Za-z_0-9]*', k) else quoted(k)}={quoted(v)}" for k, v in sorted((held or {}).items()) if v is not None)
    return f" [{said}]" if said else ""


class DotWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        system, path = _opened(self.path)
        folder = posixpath.join(path, f"_writing-{self.job}")
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        name, n, inside = posixpath.join(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}.dot"), 0, None
        with system.open_output_stream(name) as out:
            put = lambda line: out.write((line + "\n").encode())
            put("digraph G {")
            for r in rows:
                cluster = r.cluster if r.kind == "node" else None
                if cluster != inside:
                    if inside is not None:
                        put("}")
                    if cluster is not None:
                        put(f"subgraph {quoted(cluster)} {{")
                        if r.cluster_label is not None:
                            put(f"label={quoted(r.cluster_label)};")
                    inside = cluster
                put((quoted(r.name) if r.kind == "node" else f"{quoted(r.name)} -> {quoted(r.dst)}") + _attributes(r.attributes) + ";")
                n += 1
            if inside is not None:
                put("}")
            put("}")
        return _Written(name, n)

    def commit(self, messages: list[_Written | None]) -> None:
        system, path = _opened(self.path)
        kept = [m for m in messages if m is not None]
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.type == fs.FileType.File and x.path.endswith(".dot"):
                    system.delete_file(x.path)
        for m in kept:
            if m.rows:
                system.move(m.path, posixpath.join(path, f"{self.job[:8]}-{posixpath.basename(m.path)}"))
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        system, path = _opened(self.path)
        folder = posixpath.join(path, f"_writing-{self.job}")
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class DotSource(DataSource):
    """Options: path; `files`, a pattern of the paths to read in a folder, by default those that end in .dot."""

    @classmethod
    def name(cls) -> str:
        return "dot"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DotReader:
        return DotReader(self.options["path"], self.options.get("files", r"\.dot$"))

    def writer(self, schema: StructType, overwrite: bool) -> DotWriter:
        return DotWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DotSource)


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("dot").load(path)


def write_clusters(members: DataFrame, edges: DataFrame, path: str) -> None:
    """Ranked components (name, component, rank, and attributes of any name) and edges (src, dst) as clusters
    `cluster_<rank>` labelled `Subgraph <rank>`; a cluster is in one file with the edges from its nodes."""
    spark = members.sparkSession
    register(spark)
    pairs = [F.struct(F.lit(c), F.col(c).cast("string")) for c in members.columns if c not in ("name", "component", "rank", "size")]
    held = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["col2"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    where = lambda rank: (F.concat(F.lit("cluster_"), rank.cast("string")).alias("cluster"), F.concat(F.lit("Subgraph "), rank.cast("string")).alias("cluster_label"))
    none = F.lit(None).cast("string")
    nodes = members.select(none.alias("path"), F.lit("node").alias("kind"), *where(F.col("rank")), "name", none.alias("dst"), held.alias("attributes"))
    ranks = members.select(F.col("name").alias("src"), "rank")
    lines = edges.select("src", "dst").join(ranks, "src", "left").select(none.alias("path"), F.lit("edge").alias("kind"), *where(F.col("rank")), F.col("src").alias("name"), "dst", F.create_map().cast("map<string,string>").alias("attributes"))
    rows = nodes.unionByName(lines).repartition("cluster").sortWithinPartitions(F.desc("kind"), "cluster", "name", "dst")
    rows.write.format("dot").mode("overwrite").save(path)
