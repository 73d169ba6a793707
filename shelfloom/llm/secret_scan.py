"""Secret scans over every version of every document, with a ledger of what was scanned.

A text is addressed by its content (SHA-256); the ledger has a row for each
(blob, rule version) that has been scanned, with the findings. A scan takes the
blobs of the given rows, leaves out those whose pair is in the ledger, scans each
of the rest once, and joins the findings of all back to every row that holds the
blob. Only digests and ids are aggregated; the text of an unseen blob is shuffled
once, to meet the one row that stands for it.

The scan itself runs in Python workers: offsets of matches in code points are
needed, which the SQL functions don't give. ``letters there in either case`` are
ASCII letters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import arrow, scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group that counts and its least length. Shorter matches are dropped, but take their place."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Public formats of keys that the base kinds miss.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE

_FINDINGS = "array<struct<kind:string,`start`:int,`end`:int>>"
_FINDINGS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_LEDGER = "blob string, rules string, findings array<struct<kind:string,`start`:int,`end`:int>>"


def version(rules: tuple[Rule, ...]) -> str:
    """Changes with any rule."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scan_text(text: str, rules: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """Findings (kind, start, end) by start, then kind as listed; leftmost and non-overlapping for each kind."""
    found = []
    for order, (rule, pattern) in enumerate(rules):
        for m in pattern.finditer(text):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs of hexadecimal digits that are too short need not be visited one by one: none overlaps another
        compiled = [(r, re.compile(r"[0-9a-f]{24,}") if r == BASE[2] else r.compiled()) for r in rules]
        for part in arrow.parts(batches, 1_000):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t, compiled)] for t in part.column("text").to_pylist()]
            yield arrow.with_columns(part, ["text"], {"findings": (found, _FINDINGS_ARROW)})

    return run


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], _LEDGER)


def scan_versions(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` to (findings of each row, rows to append to the ledger).

    Findings: (key, blob, findings), one row for each row of ``docs``. The second
    frame has (blob, rules, findings) of the blobs scanned now and is written in
    the shared folder. A ledger may have a pair more than once, as after a retried
    append. Null text is scanned as empty. A null key stays. Repeated rows give
    repeated rows, from one scan. Other columns are ignored; an empty table gives
    no rows.
    """
    now = version(rules)
    rows = docs.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    named = rows.select(key, F.sha2("text", 256).alias("blob"))
    known = ledger.filter(F.col("rules") == now).select("blob", "findings").dropDuplicates(["blob"])
    holder = named.groupBy("blob").agg(F.min(key).alias("holder"))
    unseen = holder.join(known, "blob", "left_anti")
    texts = rows.withColumn("blob", F.sha2("text", 256)).join(
        unseen.select(F.col("blob").alias("new_blob"), "holder"), F.col(key).eqNullSafe(F.col("holder")) & (F.col("blob") == F.col("new_blob")), "left_semi"
    )
    scanned = texts.select("blob", "text").mapInArrow(_scan(rules), f"blob string, findings {_FINDINGS}")
    added = scratch.table(scanned.dropDuplicates(["blob"]).select("blob", F.lit(now).alias("rules"), "findings"), "ledger")
    findings = known.unionByName(added.select("blob", "findings")).filter(F.size("findings") > 0)
    out = named.join(findings, "blob", "left").select(key, "blob", F.coalesce("findings", F.array().cast(_FINDINGS)).alias("findings"))
    return out, added


def scan_deliveries(deliveries: list[DataFrame], ledger: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows that arrive one delivery after another to (findings of all rows, the ledger after the last one): a delivery scans what no earlier one has had."""
    found = []
    for rows in deliveries:
        own, added = scan_versions(rows, ledger, rules, key, text)
        found.append(own)
        ledger = ledger.unionByName(added)
    return reduce(DataFrame.union, found), ledger
