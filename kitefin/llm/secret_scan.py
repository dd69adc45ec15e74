"""Secret scans over an incremental blob ledger.

A text is a blob, addressed by the SHA-256 of its bytes; the rows that hold it are its paths. The ledger is a
Parquet table of (rule_version, blob, findings). A scan adds what the ledger lacks for the current rule version:
one representative of each unseen blob is scanned, however many copies there are, and all paths get their
findings from the ledger by a join. Historical versions are rows like any others.
"""

from __future__ import annotations

import itertools
import re
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import moved, shared_dir, stage, text_groups

#: Kinds in the order in which spans with equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "bearer", "forge")
BASE = KINDS[:3]
RULE_VERSION = "1"
FINDINGS = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 32 or more starts where a maximal run starts, so this finds the runs of the base that are long enough.
_HEX = re.compile(r"[0-9a-f]{32,}")
_ADDED = (
    ("private_key", "-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?")),
    ("forge", "gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
)
#: Parts of a web token, between dots; runs of them are looked at once, so that long ones take linear time.
_DOTTED = re.compile(r"[A-Za-z0-9_.-]++")


def _bearers(text: str) -> list[tuple[int, int]]:
    """Web tokens: `eyJ` and 8 characters or more, the same again, and 16 or more, with dots between."""
    found = []
    for run in _DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, k = run[0].split("."), run.start(), 0
        starts = list(itertools.accumulate((len(x) + 1 for x in parts), initial=at))
        while k + 2 < len(parts):
            begin = parts[k].find("eyJ")
            if begin >= 0 and len(parts[k]) - begin >= 11 and parts[k + 1].startswith("eyJ") and len(parts[k + 1]) >= 11 and len(parts[k + 2]) >= 16:
                found.append((starts[k] + begin, starts[k + 2] + len(parts[k + 2])))
                k += 2
            k += 1
    return found


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a whole text in code points, by start, then kind."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, literal, pattern in _ADDED:
        if literal in text:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    if "eyJ" in text:
        found += [("bearer", *x) for x in _bearers(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(batches):
    struct = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch, texts in text_groups(batches):
        found = [[dict(zip(("kind", "start", "end"), x)) for x in find_secrets(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, pa.list_(struct))], names=["blob", "findings"])


def _ledger(documents: DataFrame, path: str, rule_version: str) -> DataFrame:
    spark = documents.sparkSession
    try:
        known = spark.read.schema(f"blob binary, findings {FINDINGS}, rule_version string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], f"blob binary, findings {FINDINGS}, rule_version string")
    # Two runs at once may both have added a blob; their findings are equal.
    return known.filter(F.col("rule_version") == rule_version).select("blob", "findings")


def scan_secrets(documents: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION, text_too: bool = False) -> DataFrame:
    """One row for each row of documents: doc_id, blob, findings (kind, start, end by start, then kind)[, text].

    Only pairs of blob and rule version that the ledger lacks are scanned, once each. Null texts are the empty blob;
    repeated rows each give a row; rows with a null doc_id are scanned like others; an empty table adds nothing.
    Whole texts are scanned. Columns besides doc_id and text are ignored.
    """
    spark = documents.sparkSession
    shared_dir(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))
    paths = stage(keyed.select("doc_id", "blob"))
    unseen = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(_ledger(documents, ledger_path, rule_version).select("blob"), "blob", "left_anti")
    unseen = unseen.select(F.col("blob").alias("u_blob"), F.col("doc_id").alias("u_doc"))
    # One row holds each unseen blob, so that the texts are moved by a key without hot groups.
    first = keyed.join(unseen, (keyed.blob == unseen.u_blob) & keyed.doc_id.eqNullSafe(unseen.u_doc), "left_semi")
    first = first.select("blob", "text")
    rows, ids = paths.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows != ids:  # rows of one doc_id, or of none, may hold one blob
        first = first.dropDuplicates(["blob"])
    new = first.mapInArrow(_scan, f"blob binary, findings {FINDINGS}")
    new.withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger_path)
    known = _ledger(documents, ledger_path, rule_version)
    found = known.filter(F.size("findings") > 0).dropDuplicates(["blob"])
    left = keyed if text_too else paths
    return left.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"), *["text"] * text_too)


def new_ledger(spark) -> str:
    """A path for a ledger of this run alone, in the shared folder."""
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of findings for comparison."""
    spans = lambda array: F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(spans(base).cast("binary"), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))


def redact(documents: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """documents, with each run of overlapping findings in text replaced by `<secret>`; other columns as they are.

    Rows without findings, null texts included, stay as they are; n_chars, if there is such a column, follows the text.
    """
    names = documents.columns
    found = scan_secrets(documents, ledger_path, rule_version).select(F.col("blob").alias("f_blob"), F.col("findings").alias("f_findings")).filter(F.size("f_findings") > 0).dropDuplicates(["f_blob"])
    blob = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    held = documents.select(F.struct(*(F.col("`" + n.replace("`", "``") + "`") for n in names)).alias("row"), blob.alias("blob"))
    # Staged, so that Spark can split a text that very many rows hold.
    joined = held.join(moved(stage(found)), held.blob == F.col("f_blob"), "left").select("row", "f_findings")
    at = names.index("text")
    counted = [k for k, f in enumerate(documents.schema) if f.name == "n_chars"]

    def rewrite(batches):
        for batch in batches:
            rows, findings = batch.column("row"), batch.column("f_findings")
            columns = [rows.field(k) for k in range(len(names))]
            hit = [k for k, f in enumerate(findings.is_valid().to_pylist()) if f]
            if hit:
                texts = columns[at].to_pylist()
                lengths = {k: columns[k].to_pylist() for k in counted}
                for k in hit:
                    texts[k] = _without(texts[k], findings[k].as_py())
                    for n in lengths.values():
                        n[k] = len(texts[k])
                columns[at] = pa.array(texts, columns[at].type)
                for k, n in lengths.items():
                    columns[k] = pa.array(n, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(rewrite, documents.schema)


def _without(text: str, findings: list[dict]) -> str:
    out, done, held = [], 0, 0
    for f in findings:
        if f["start"] >= held:
            out += [text[done : f["start"]], "<secret>"]
        done = held = max(held, f["end"])
    return "".join([*out, text[done:]])
