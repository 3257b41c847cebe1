"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a
Parquet folder, says which blob was scanned with which version of which rule and what
was found. A scan takes the blobs that still lack a rule, runs only the rules that they
lack, appends what it did to the ledger and joins the findings of all current rules back
to all paths and versions that have the blob. A second scan of the same history reads no
content but for its hashes; a new version of one rule runs that rule alone.

Copies are reduced to one text inside each partition before the one shuffle of texts;
everything else that moves is an address. Findings come out of whole texts.

Defined results: null and empty texts are one blob without findings; the same path and
version given twice is reported twice; an empty table gives an empty result and leaves
the ledger as it is; a ledger folder that does not exist yet is an empty ledger; further
columns of the versions are kept as they are named in ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "sha256 string, scanned array<string>, spans array<struct<kind string, start int, end int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` that ``accept`` lets pass."""

    kind: str
    version: int
    pattern: str
    accept: Callable[[re.Match], bool] = lambda match: True
    begin: Callable[[re.Match], int] = lambda match: match.start()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for match in re.finditer(self.pattern, text):
            if self.accept(match):
                yield self.begin(match), match.end()


# The three base kinds. A run too short for its kind is dropped after it
# was matched; for access and hex a minimum in the pattern comes to the same, since a
# match there is a whole run.
RULES = (
    Rule("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    # Further kinds of the ledger's own.
    Rule("private_key", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # A scheme starts at the first letter of its run; looking at whole runs keeps the search linear.
    Rule("url_login", 2, r"(?<![a-z0-9+.-])([a-z0-9+.-]++)://[^\s/:@]++:[^\s/:@]++@",
         lambda m: re.search(r"[a-z][a-z0-9+.-]", m[1]) is not None, lambda m: m.start() + re.search("[a-z]", m[1]).start()),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def findings(text: str, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then in the order of the rules."""
    found = [(start, n, end) for n, rule in enumerate(rules) for start, end in rule.spans(text)]
    return [(rules[n].kind, start, end) for start, n, end in sorted(found)]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def address(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan_new(versions: DataFrame, ledger: str, text: str = "text", rules: Sequence[Rule] = RULES) -> None:
    """Scan what the ledger lacks of these texts and append it."""
    spark = versions.sparkSession
    names = [r.name for r in rules]
    blobs = versions.select(address(text).alias("sha256"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blobs = blobs.groupBy("sha256").agg(F.first("text").alias("text"))
    seen = read_ledger(spark, ledger).groupBy("sha256").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
    missing = F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>")))
    todo = blobs.join(seen, "sha256", "left").select("sha256", "text", missing.alias("scanned")).where(F.size("scanned") > 0)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = []
            for content, lacking in zip(batch["text"], batch["scanned"], strict=True):
                wanted = set(lacking)
                found = findings(content, [r for r in rules if r.name in wanted])
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            yield pd.DataFrame({"sha256": batch["sha256"], "scanned": batch["scanned"], "spans": spans})

    todo.mapInPandas(each, LEDGER).write.mode("append").parquet(ledger)


def scanned(
    versions: DataFrame, ledger: str, keep: Sequence[str], text: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """The columns ``keep``, ``sha256`` and ``spans`` of every version, after bringing the ledger up to date.

    A rule whose version is no longer current has its old findings left out. Blobs
    without findings are left out of the join, so the empty text is no hot key.
    """
    scan_new(versions, ledger, text, rules)
    current = F.array(*[F.lit(r.name) for r in rules])
    order = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.kind, n)])
    known = read_ledger(versions.sparkSession, ledger).where(F.size("spans") > 0)
    each = known.where(F.arrays_overlap("scanned", current)).select("sha256", "scanned", F.explode("spans").alias("s"))
    by_rule = F.filter("scanned", lambda name: F.array_contains(current, name))
    live = F.exists(by_rule, lambda name: F.substring_index(name, "@", 1) == F.col("s.kind"))
    each = each.where(live).select("sha256", F.struct("s.start", order[F.col("s.kind")].alias("n"), "s.kind", "s.end").alias("s"))
    blobs = each.groupBy("sha256").agg(F.array_sort(F.collect_set("s")).alias("s"))
    spans = F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    paths = versions.select(*keep, address(text).alias("sha256"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return paths.join(blobs.select("sha256", spans.alias("spans")), "sha256", "left").select(
        *keep, "sha256", F.coalesce("spans", none).alias("spans")
    )
