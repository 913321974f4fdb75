"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every version of a text is content-addressed by its SHA-256.  The ledger holds
one row per (blob, rule, rule version) that has been scanned; a scan visits
only the pairs that the ledger lacks, however many paths carry the blob, and
findings are joined back to all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import cut, let, prefix_sums


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``measured`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    measured: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds rank at equal starts.  ``{12,}`` and ``{32,}``
#: find what the open patterns find once short matches are dropped: both match
#: whole runs of their class, and no shorter run holds a longer one.
RULES = (
    Rule("assign", 1, r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)

_SPANS = "array<struct<start:int,end:int>>"
#: The columns of a ledger.
LEDGER = f"blob_id string, rule string, version int, spans {_SPANS}"
_RANKED = "array<struct<start:int,rank:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans of the rule's leftmost, non-overlapping matches, in code points, end exclusive.

    Matches and the gaps between them alternate, so running sums of their
    lengths are the positions; texts without any match are left after one search.
    """
    pattern = F.lit(rule.pattern)
    found = F.struct(
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("match"),
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.measured)), F.length).alias("measured"),
    )

    def placed(m: Column) -> Column:
        totals = F.transform(m["match"], lambda n, i: n + m["gap"][i])
        all_spans = let(
            prefix_sums(totals),
            lambda before: F.transform(
                m["match"],
                lambda n, i: F.struct(
                    (before[i] + m["gap"][i]).alias("start"),
                    (before[i] + m["gap"][i] + n).alias("end"),
                    (m["measured"][i] >= rule.least).alias("long"),
                ),
            ),
        )
        return F.transform(F.filter(all_spans, lambda s: s["long"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return F.when(text.rlike(rule.pattern), let(found, placed)).otherwise(F.array()).cast(_SPANS)


def versions(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, blob_id, text): a content address for every version of a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob_id"), text.alias("text"))


def scan_unseen(docs: DataFrame, *, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New ledger rows (blob_id, rule, version, spans) for what ``ledger`` lacks.

    Copies of a blob meet after a map-side combine, so a blob that a third of
    all paths hold costs one row a task.  A pair without findings gets a row
    with no spans: it has been scanned.  Null texts count as empty.
    """
    blobs = versions(docs, path_col, text_col).groupBy("blob_id").agg(F.first("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob_id").agg(F.collect_set(F.concat_ws("@", "rule", F.col("version").cast("string"))).alias("seen"))
        blobs = blobs.join(seen, "blob_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    new = [
        F.when(
            ~F.array_contains("seen", r.key),
            F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")),
        )
        for r in rules
    ]
    return blobs.select("blob_id", F.explode(F.array(*new)).alias("new")).where("new is not null").select("blob_id", "new.*")


def findings_by_path(docs: DataFrame, ledger: DataFrame, *, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's findings under the given rule versions: (path, blob_id, found).

    ``found`` is sorted by start, then by the order of ``rules``, and holds
    structs (start, rank, end), rank being the rule's place.  Findings are
    written before they are joined, so that Spark knows their size, and splits
    the paths of a blob that very many have.
    """
    rank = F.coalesce(*[F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)])
    found = (
        ledger.where(F.size("spans") > 0)
        .withColumn("rank", rank)
        .where("rank is not null")
        .groupBy("blob_id")
        .agg(F.flatten(F.collect_set(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"))))).alias("found"))
    )
    found = cut(found)
    paths = versions(docs, path_col, text_col).select("path", "blob_id")
    return paths.join(found, "blob_id", "left").select("path", "blob_id", F.array_sort(F.coalesce("found", F.array().cast(_RANKED))).alias("found"))


def secret_scan(docs: DataFrame, *, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans unseen pairs and returns one row per input row: (path, blob_id, found).

    Null texts scan as empty and have no findings; repeated rows each keep
    their row; an empty table gives an empty result; further columns of the
    input are ignored.  ``scan_unseen`` returns the rows to add to the ledger.
    """
    new = scan_unseen(docs, ledger=ledger, rules=rules, path_col=path_col, text_col=text_col)
    known = new if ledger is None else new.unionByName(ledger.select("blob_id", "rule", "version", "spans"))
    return findings_by_path(docs, known, rules=rules, path_col=path_col, text_col=text_col)


def scan_into(docs: DataFrame, ledger_path: str, *, rules: tuple[Rule, ...] = RULES, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds what the ledger at ``ledger_path`` lacks to it, if there is one, and returns what ``secret_scan`` does.

    The folder is shared by driver and executors.  A scan that comes later finds
    its blobs there and reads no text of theirs but to address it.
    """
    spark = docs.sparkSession
    old = None
    try:
        old = spark.read.schema(LEDGER).parquet(ledger_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    scan_unseen(docs, ledger=old, rules=rules, path_col=path_col, text_col=text_col).write.mode("append").parquet(ledger_path)
    return findings_by_path(docs, spark.read.schema(LEDGER).parquet(ledger_path), rules=rules, path_col=path_col, text_col=text_col)


def written(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Findings as text: kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(found: Column, rank: int) -> Column:
    return F.size(F.filter(found, lambda s: s["rank"] == rank)).cast("long")
