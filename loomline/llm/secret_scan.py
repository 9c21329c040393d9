"""Secret scans with an incremental ledger of blobs.

Every version of every text is addressed by its content. The ledger is a table of (blob, rule, version of the rule) with the
spans that were found there; a scan reads only the texts of blobs with a pair that the ledger doesn't have, each blob once
however many paths hold it, appends what it finds, and joins the ledger's findings back to all paths.

A version of a rule is a digest of what it matches, so a changed rule is scanned anew and an unchanged one never. Rows of the
ledger are the same whoever writes them: after a lost job, or two at a time, a pair may stand there twice and counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.tables import file_system

from .common import hot_join, save, slices


@dataclass(frozen=True)
class Rule:
    """Leftmost matches, one after the other, whose ``group`` has ``least`` characters or more; any text with a match has
    one of the ``hints``, in lower case, if there are any, and matches ``probe``."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    hints: tuple[bytes, ...] = ()
    probe: bytes = b""

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.pattern, self.least, self.group, self.any_case)).encode()).hexdigest()[:16]

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def may_match(self, raw: bytes, low: bytes) -> bool:
        return (not self.hints or any(h in low for h in self.hints)) and (not self.probe or re.search(self.probe, raw) is not None)

    def find(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if len(m[self.group]) >= self.least]


# The three base kinds and what they match.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, (b"passw", b"secret", b"token", b"api")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hints=(b"akia",)),
    Rule("hex", r"[0-9a-f]+", 24, probe=rb"[0-9a-f]{24}"),
)
#: Further kinds; each starts with a mark of its own, so that clean prose has none.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, hints=(b"private key-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40, hints=(b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39, hints=(b"aiza",)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, hints=(b"xox",)),
    Rule("login", r"""(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D:/@"'<>]+:[^\x20\x09-\x0D/@"'<>]+@""", 0, hints=(b"://",)),
)
RULES = BASE + MORE

LEDGER = "blob binary, kind string, version string, spans array<struct<start: int, end: int>>"
#: Rows up to which the blobs to scan are broadcast, so that only their texts are shuffled.
FEW = 100_000


def _open(spark: SparkSession, ledger: str) -> DataFrame:
    target, fs = file_system(spark, ledger)
    return spark.read.schema(LEDGER).parquet(ledger) if fs.exists(target) else spark.createDataFrame([], LEDGER)


def _current(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's rows of the rules as they are, each pair once, with the rule's place."""
    place = F.coalesce(*(F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), i) for i, r in enumerate(rules)))
    return ledger.withColumn("rule", place).where("rule is not null").groupBy("blob", "rule").agg(F.first("spans").alias("spans"))


def _scan(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's rows for ``texts(blob, todo, text)``, todo being the places of the rules to apply."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                rows = []
                for blob, todo, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    low, text = raw.lower(), None
                    for i in todo:
                        rule, found = rules[i], []
                        if rule.may_match(raw, low):
                            text = raw.decode(errors="replace") if text is None else text
                            found = [{"start": a, "end": z} for a, z in rule.find(text)]
                        rows.append((blob, rule.kind, rule.version, found))
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.string(), pa.string(), spans), strict=True)], ["blob", "kind", "version", "spans"])

    return texts.select("blob", "todo", "text").mapInArrow(run, LEDGER)


def scan(versions: DataFrame, ledger: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``blob`` and ``found`` in place of the text: array<struct<start, rule, end, kind>> by start, then rule.

    A row is one version of one path, in whatever columns tell them; they are kept but for the text. Null texts count as empty,
    repeated rows stay, an empty table gives no rows and leaves the ledger as it is. Whole texts are scanned, spans are in code
    points. ``ledger`` is a path that all executors share; it is made by the first scan.
    """
    spark = versions.sparkSession
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    blob = F.unhex(F.sha2(raw, 256))
    kept = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in versions.columns if c != text))
    paths = save(versions.select(blob.alias("blob"), kept.alias("r")))
    copies = save(paths.groupBy("blob").agg(F.count("*").alias("copies")))
    seen = _current(_open(spark, ledger), rules).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array_except(F.array(*map(F.lit, range(len(rules)))), F.coalesce("seen", F.array().cast("array<int>")))
    pending = save(copies.join(seen, "blob", "left").select("blob", todo.alias("todo")).where("size(todo) > 0"))
    if new := pending.count():
        texts = versions.select(blob.alias("blob"), raw.alias("text"))
        if new <= FEW:
            texts = texts.join(F.broadcast(pending.select("blob")), "blob", "left_semi")  # at most FEW rows
        # Each task sends a blob once, so that thousands of copies don't meet in one.
        once = texts.groupBy("blob").agg(F.first("text").alias("text"))
        _scan(once.join(pending.hint("merge"), "blob"), rules).write.mode("append").parquet(ledger)
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    told = _current(_open(spark, ledger), rules).where("size(spans) > 0").withColumn("kind", F.get(kinds, F.col("rule")))
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rule").alias("rule"), s["end"].alias("end"), F.col("kind").alias("kind")))
    found = told.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(each))).alias("found"))  # of one text
    none = F.array().cast("array<struct<start: int, rule: int, end: int, kind: string>>")
    table = save(copies.join(found, "blob", "left").withColumn("found", F.coalesce("found", none)))
    total = copies.agg(F.sum("copies")).first()[0] or 0
    return hot_join(paths, table, "blob", "copies", total).select("r.*", "blob", "found").drop("_")


def told(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, ledger: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of ``docs(doc_id, text)``; other columns are ignored."""
    rows = scan(docs.select("doc_id", "text"), ledger)
    n = lambda rule: F.size(F.filter("found", lambda s: s["rule"] == rule)).cast("long")
    counts = (n(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE))
    base = F.filter("found", lambda s: s["rule"] < len(BASE))
    return rows.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
