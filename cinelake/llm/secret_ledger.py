"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed (SHA-256 of its text). A ledger row says
which rule versions a blob has been scanned with and what each of them found. A scan takes only the pairs of blob
and rule version that the ledger lacks, reads each such blob once, however many paths and versions carry
it, and joins the findings back to all of them. What a superseded version found stays in the ledger and out of the findings.

Defined cases: a null text is the empty text; empty texts have no findings; texts of any length are searched whole; repeated rows
and equal texts share one blob; findings that start together are in the rules' order, and the same span of two ledger rows
counts once; an empty table gives empty results; null paths keep their row. Offsets are code points,
ends exclusive. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import set_batches, shielded, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; those whose `group` is shorter than `least` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    #: Every match holds one of these, letter case aside; a text without them is not searched.
    needles: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in their order, then the method's own.
BASE_RULES = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32),
)
MORE_RULES = (
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, ("eyj",)),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, ("private key-----",)),
    Rule("hub", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = "blob_id string, scanned array<string>, spans array<struct<rule:string,kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_LONG_HEX = re.compile(r"[0-9a-f]{32}")


def find(text: str, rules: Iterable[Rule]) -> list[tuple[str, str, int, int]]:
    """All spans (rule version, kind, start, end) of `rules` in a whole text, by start, then by the rules' order."""
    out, low = [], None
    for k, rule in enumerate(rules):
        if rule.needles:
            low = text.lower() if low is None else low
            if not any(x in low for x in rule.needles):
                continue
        elif rule.pattern == "[0-9a-f]+" and not _LONG_HEX.search(text):
            continue
        for m in re.finditer(rule.pattern, text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), k, rule.key, rule.kind, m.end()))
    return [(key, kind, start, end) for start, _, key, kind, end in sorted(out)]


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """Adds `blob_id`, the content address of the version's text."""
    return versions.withColumn("blob_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the pairs of blob and rule version that `ledger` lacks.

    versions: blob_id, text. Copies of a blob meet in a grouping that keeps one text and combines before
    the shuffle, so a blob that a third of all rows carry is one row from each task.
    """
    spark = versions.sparkSession
    set_batches(spark)
    keys = [r.key for r in rules]
    blobs = versions.groupBy("blob_id").agg(F.first(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    if ledger is None:
        todo = blobs.withColumn("todo", F.array(*[F.lit(k) for k in keys]))
    else:
        seen = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        every = F.array(*[F.lit(k) for k in keys])
        todo = blobs.join(seen, "blob_id", "left").select("blob_id", "text", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        todo = todo.filter(F.size("todo") > 0)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blob, texts, keys_of = (b.column(i) for i in range(3))
            found = [find(t, [r for r in rules if r.key in k]) for t, k in zip(texts.to_pylist(), keys_of.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([blob, keys_of, pa.array(found, _SPANS)], ["blob_id", "scanned", "spans"])

    return todo.select("blob_id", "text", "todo").mapInArrow(kernel, LEDGER)


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at `path` lacks, appends it there, and returns the whole ledger."""
    spark = versions.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    old = spark.read.schema(LEDGER).parquet(path) if there else None
    # through a written table: a job must not append to the files it reads
    written(scan_unseen(address(versions), old, rules), "ledger").write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, salts: int = 8) -> DataFrame:
    """Each version's `keep` columns with `spans`, all findings of the rules' current versions in its blob.

    versions carries blob_id. Only blobs with findings are joined; the rows of a hot blob are dealt to
    `salts` tasks, for each of which the (few) findings are repeated.
    """
    # a rule's place, 0 for a version that is not current
    place = lambda x: F.array_position(F.array(*[F.lit(r.key) for r in rules]), x["rule"])
    current = F.transform(F.filter("spans", lambda x: place(x) > 0), lambda x: F.struct(x["start"], place(x), x["end"], x["kind"]))
    hits = (
        ledger.select("blob_id", current.alias("s"))
        .filter(F.size("s") > 0)
        .groupBy("blob_id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
        .select("blob_id", F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    salted = versions.select(*keep, "blob_id", F.pmod(F.xxhash64(*keep), F.lit(salts)).cast("int").alias("_salt"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return salted.join(hits, ["blob_id", "_salt"], "left").select(*keep, F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, salts: int = 8) -> DataFrame:
    """Documents with each finding of `rules` replaced by `[REDACTED:kind]`; n_chars follows. Other columns and rows stay, whatever they are called."""
    set_batches(docs.sparkSession)
    safe, restored = shielded(docs)
    addressed = address(safe).withColumn("_salt", F.pmod(F.xxhash64(*[c for c in safe.columns if c != "text"]), F.lit(salts)).cast("int"))
    ledger = scan_unseen(addressed.select("blob_id", "text"), None, rules)
    hits = ledger.filter(F.size("spans") > 0).select("blob_id", "spans", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    held = addressed.join(hits, ["blob_id", "_salt"], "left")
    # of overlapping findings the first is named; the cut reaches to the end of the longest
    clean = F.expr(
        "CASE WHEN spans IS NULL THEN text ELSE aggregate(spans, named_struct('out', '', 'at', 0L), (acc, x) -> named_struct("
        "'out', concat(acc.out, CASE WHEN x.start >= acc.at THEN concat(substring(text, int(acc.at) + 1, int(x.start - acc.at)), '[REDACTED:', x.kind, ']') ELSE '' END),"
        "'at', greatest(acc.at, x.end)), acc -> concat(acc.out, substring(text, int(acc.at) + 1))) END"
    )
    cleaned = held.withColumn("text", clean)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return restored(cleaned)
