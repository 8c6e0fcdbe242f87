"""Incremental secret scanning with a blob ledger.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger, a table in shared storage, has a row for each scanned blob with the
rule versions that were run over it and what they found.  A scan reads only
blobs with rule versions missing from the ledger, each blob once however many
paths hold it, and adds its rows; findings are then joined back to all paths.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_and_reload
from . import words


@dataclass(frozen=True)
class Rule:
    """A kind of secret: where ``pattern`` matches and ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the patterns of the secret kinds, in their order
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
_FOUND = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
LEDGER = T.StructType([T.StructField("blob", T.StringType()),
                       T.StructField("rules", T.ArrayType(T.StringType())), T.StructField("found", _FOUND)])


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, str]]:
    """(start, rank of the rule, end, kind) of all secrets in a text, in this order."""
    out = []
    for rank, rule in enumerate(rules):
        for m in _compiled(rule.pattern).finditer(text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)  # kept by re; ASCII: no foldings outside A-Z


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in ``path`` with one row for each blob; empty where nothing was written yet."""
    try:
        rows = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], LEDGER)
    return rows.groupBy("blob").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES,
           path_col: str = "path") -> DataFrame:
    """(blob, missing, text): each blob of versions and the rule versions not yet run over it.

    Null texts are empty ones.  A blob is given once, or as often as one path
    (the least) repeats it: such rows are scanned each and are one row of the
    ledger.  An empty table gives none, other columns are not read.
    """
    keyed = versions.select(F.col(path_col).cast("string").alias("_path"), "text", blob_id(F.col("text")).alias("blob"))
    one = keyed.groupBy("blob").agg(F.min(F.coalesce("_path", F.lit(""))).alias("_path"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    missing = F.array_except(wanted, F.coalesce("rules", F.array().cast("array<string>")))
    todo = (one.join(ledger.select("blob", "rules"), "blob", "left")
            .select("blob", "_path", missing.alias("missing")).where(F.size("missing") > 0))
    # copies share a blob but not a path, so a blob with very many copies does not gather
    return (keyed.withColumn("_path", F.coalesce("_path", F.lit("")))
            .join(todo, ["blob", "_path"]).select("blob", "missing", "text"))


def scan(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, path_col: str = "path") -> DataFrame:
    """Scans what the ledger in ``ledger_path`` lacks, adds it there, and returns the ledger.

    ``versions`` has a path column and ``text``, one row for each version of a
    path (null texts are empty, equal texts of different paths are scanned
    once, rows that repeat the least path and text each, a null path is an ordinary one, other columns are ignored).  An
    empty table adds nothing.  Stopped half-way, a scan adds nothing either,
    and the next one starts again.
    """
    spark = versions.sparkSession
    by_key = {r.key: (i, r) for i, r in enumerate(rules)}

    def run(batches):
        words.take_turn("secrets")
        for b in words.slices(batches, "text"):
            found = []
            for text, missing in zip(b.column("text").to_pylist(), b.column("missing").to_pylist()):
                rows = []
                for key in missing:
                    rank, rule = by_key[key]
                    rows += [(s, rank, e, k) for s, _, e, k in find(text or "", (rule,))]
                found.append([dict(zip(("start", "rank", "end", "kind"), r)) for r in sorted(rows)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()),
                                       ("kind", pa.string())]))
            yield pa.record_batch([b.column("blob"), b.column("missing"), pa.array(found, kind)],
                                  names=["blob", "rules", "found"])

    new = unseen(versions, read_ledger(spark, ledger_path), rules, path_col).mapInArrow(run, LEDGER)
    new.write.mode("append").parquet(ledger_path)
    # written with one row for each blob, so that a join's skew handling sees a plain exchange on both sides
    return write_and_reload(read_ledger(spark, ledger_path), "ledger-blobs")


def by_path(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """versions without ``text``, with ``blob`` and ``found`` (secrets of the blob, in order) for each row.

    Columns of versions named blob or found are replaced.  Null texts are
    empty ones, repeated rows stay; ``found`` is null for a blob that the ledger lacks.
    """
    kept = [c for c in versions.columns if c not in ("text", "blob", "found")]
    rows = versions.select(*kept, blob_id(F.col("text")).alias("blob"))
    return rows.join(ledger.select("blob", "found"), "blob", "left")


def redact(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """docs with every character of a found secret replaced by ``*`` (lengths stay).

    Null texts stay null, repeated rows stay, an empty table gives none.
    """
    hits = ledger.where(F.size("found") > 0).select(F.col("blob").alias("_secret_blob"), F.col("found").alias("_secret_spans"))
    masked = F.expr("""aggregate(_secret_spans, text, (t, s) -> concat(
        substring(t, 1, s.start), repeat('*', s.end - s.start), substring(t, s.end + 1)))""")
    keyed = docs.withColumn("_secret_blob", blob_id(F.col("text")))
    return (keyed.join(hits, "_secret_blob", "left").withColumn("text", F.when(F.col("_secret_spans").isNull(), F.col("text"))
            .otherwise(masked)).select(*docs.columns))
