"""Rule-based triage of pages and documents: links, candidates, signals, labels, retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web
from ..functions.names import folded, folded_space
from ..operators.lookup import looked_up
from ..session import cut_lineage

# The patterns and terms of the default rules, and the labels kept.
DEFAULT_BINS = {
    "5A": r"(?<![A-Z0-9])5\s*A(?![A-Z0-9])",
    "4A1B": r"(?<![A-Z0-9])4\s*A\s*1\s*B(?![A-Z0-9])",
    "3A2B": r"(?<![A-Z0-9])3\s*A\s*2\s*B(?![A-Z0-9])",
    "2A3B": r"(?<![A-Z0-9])2\s*A\s*3\s*B(?![A-Z0-9])",
    "1A4B": r"(?<![A-Z0-9])1\s*A\s*4\s*B(?![A-Z0-9])",
    "5B": r"(?<![A-Z0-9])5\s*B(?![A-Z0-9])",
}
DEFAULT_CONTEXT = (
    r"新生入學情形|新生.{0,20}(?:會考|基測|入學成績)|入學學生.{0,20}(?:會考|基測|成績)|(?:會考|基測).{0,20}新生|"
    r"國中基本學力測驗.{0,20}(?:成績|新生)|入學成績"
)
DEFAULT_REPORT = (
    r"高中優質化.{0,30}(?:成果|成效|考核)|優質高中認證|學校經營計畫|(?:學校|校務).{0,10}中長程|中長程教育發展計畫|"
    r"校務發展計畫|校務評鑑|自我評鑑"
)
DEFAULT_TRAINING = r"研習|工作坊|講座|研討會|教師增能|來函|活動計畫"
DEFAULT_ADMISSION = r"招生簡章|招生辦法|新生報到|錄取名單|轉學考|招生訊息"
DEFAULT_EXAM = r"會考|基測|基本學力測驗|入學成績|成績分[布佈]"
DEFAULT_RANGE = r"(?<!\d)(\d{1,3}(?:\.\d+)?)\s*(?:[-~～－至])\s*(\d{1,3}(?:\.\d+)?)(?!\d)"
DEFAULT_QUANTILE = r"(?i)(?<![A-Z])P\s*(5|10|25|50|75|90|95)(?!\d)"
DEFAULT_VALUE = r"(?i)PR\s*(\d{1,3})(?!\d)"
DEFAULT_STATS = ("最高", "最低", "平均", "中位數", "前25%", "後25%")
KEEP_LABELS = ("entrance_distribution", "possible_entrance_distribution", "entrance_report_no_distribution",
               "needs_ocr_or_conversion")
LEAST_CONTENT = 40
VALUES_SHOWN = 8
READABLE = ("ok", "cached")


@dataclass(frozen=True)
class TriageRules:
    """Patterns of one kind of document; every one may be replaced."""

    bins: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_BINS))
    quantile: str = DEFAULT_QUANTILE
    value: str = DEFAULT_VALUE
    stats: Sequence[str] = DEFAULT_STATS
    number_range: str = DEFAULT_RANGE
    context: str = DEFAULT_CONTEXT
    report: str = DEFAULT_REPORT
    training: str = DEFAULT_TRAINING
    admission: str = DEFAULT_ADMISSION
    exam: str = DEFAULT_EXAM
    readable_name: str = "[一-鿿]"
    compatibility: bool = True

    def clean(self, text: Column) -> Column:
        return folded(text) if self.compatibility else folded_space(text)


def with_signals(df: DataFrame, text: str, rules: TriageRules) -> DataFrame:
    """Everything the rules look for, each pattern run once over the whole text."""
    t = F.col(text)
    none = F.lit(None).cast("string")
    unique = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(1))))
    return df.withColumns({
        "bins": F.array_compact(F.array(*[F.when(t.rlike("(?i)" + p), F.lit(n)).otherwise(none) for n, p in rules.bins.items()])),
        "quantiles": unique(rules.quantile),
        "value_marks": unique(rules.value),
        "stats": F.array_compact(F.array(*[F.when(F.contains(t, F.lit(s)), F.lit(s)).otherwise(none) for s in rules.stats])),
        "ranges": F.size(F.regexp_extract_all(t, F.lit(rules.number_range), F.lit(0))),
        "in_context": t.rlike(rules.context),
        "is_report": t.rlike(rules.report),
        "on_exam": t.rlike(rules.exam),
        "is_training": t.rlike(rules.training),
        "is_admission": t.rlike(rules.admission),
    })


SIGNALS = ("bins", "quantiles", "value_marks", "stats", "ranges", "in_context", "is_report", "on_exam", "is_training", "is_admission")


def evidence(with_exam: bool) -> Column:
    """Readable trace of the signals behind a label."""
    some = lambda c, head, sep: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(c, sep)))
    parts = [
        F.when(F.col("in_context"), "entrance_context"),
        F.when(F.col("is_report"), "school_report"),
        some(F.col("bins"), "cap_bins=", ","),
        some(F.col("quantiles"), "percentiles=P", ",P"),
        some(F.slice("value_marks", 1, VALUES_SHOWN), "pr_values=", ","),
        some(F.col("stats"), "stats=", ","),
        F.when(F.col("ranges") > 0, F.concat(F.lit("score_ranges="), F.col("ranges").cast("string"))),
    ]
    if with_exam:
        parts.append(F.when(F.col("on_exam"), "exam_score_context"))
    return F.concat_ws(";", *parts)


def _decide(rules: Sequence[tuple[Column, str, str]]) -> Column:
    out = F.lit(None)
    for test, label, confidence in reversed(rules):
        pick = F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))
        out = F.when(test, pick) if out is None else F.when(test, pick).otherwise(out)
    return out


def classify(df: DataFrame, content: str, metadata: str | None = None, error: str | None = None,
             rules: TriageRules | None = None) -> DataFrame:
    """Add ``label``, ``confidence``, ``evidence`` and ``text_chars`` from content and metadata."""
    rules = rules or TriageRules()
    body = rules.clean(F.col(content))
    head = rules.clean(F.col(metadata)) if metadata else F.lit("")
    base = df.withColumn("_body", body).withColumn("_all", F.concat_ws(" ", head, F.col("_body")))
    base = with_signals(base, "_all", rules)
    failed = (F.coalesce(F.col(error), F.lit("")) != "") if error else F.lit(False)
    c = F.col
    thin = failed | (F.length("_body") < LEAST_CONTENT)
    structured = (F.size("bins") >= 2) | (F.size("quantiles") >= 2) | (F.size("value_marks") >= 2)
    numeric = c("on_exam") & ((F.size("stats") >= 2) | (c("ranges") >= 2))
    pick = _decide([
        (thin & (c("in_context") | c("is_report")), "needs_ocr_or_conversion", "medium"),
        (thin & ~(c("is_admission") | c("is_training")), "unreadable", "high"),
        (c("in_context") & (structured | numeric), "entrance_distribution", "high"),
        (c("is_report") & structured, "possible_entrance_distribution", "medium"),
        (c("in_context"), "entrance_report_no_distribution", "high"),
        (c("is_report"), "school_plan_or_report", "high"),
        (c("is_admission"), "admissions_notice", "high"),
        (c("is_training"), "training_or_event", "high"),
        (F.lit(True), "other", "medium"),
    ])
    out = base.withColumn("_pick", pick)
    return out.select(*df.columns, c("_pick")["label"].alias("label"), c("_pick")["confidence"].alias("confidence"),
                      evidence(True).alias("evidence"), F.length("_body").alias("text_chars"))


def metadata_labels(df: DataFrame, title: str, name: str, rules: TriageRules | None = None) -> DataFrame:
    """Label what its title and name settle; the rest is marked ``needs_content``."""
    rules = rules or TriageRules()
    base = df.withColumn("_title", rules.clean(F.col(title))).withColumn("_name", rules.clean(F.col(name)))
    base = with_signals(base.withColumn("_all", F.concat_ws(" ", "_title", "_name")), "_all", rules)
    c = F.col
    hint = c("in_context") | c("is_report") | (c("ranges") > 0)
    for found in ("bins", "quantiles", "value_marks", "stats"):
        hint = hint | (F.size(found) > 0)
    stem = F.regexp_replace("_name", r"(.)\.[^.]*$", "$1")
    opaque = (c("_title") == "") & (F.regexp_count(stem, F.lit(rules.readable_name)) < 3)
    pick = _decide([
        (hint, "needs_content", ""),
        (c("is_admission"), "admissions_notice", "high"),
        (c("is_training"), "training_or_event", "high"),
        (opaque, "needs_content", ""),
        (F.lit(True), "other", "medium"),
    ])
    out = base.withColumn("_pick", pick)
    return out.select(*df.columns, c("_pick")["label"].alias("label"), c("_pick")["confidence"].alias("confidence"),
                      evidence(False).alias("evidence"))


def content_of(texts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The texts of the wanted keys. The keys are written and measured; a small plan filters the scan of texts in place."""
    return looked_up(texts, wanted.select(key).distinct(), [key], "left_semi")


def routed(candidates: DataFrame, texts: DataFrame, url: str, title: str, name: str, rules: TriageRules | None = None) -> DataFrame:
    """Label by title and name where they settle it, and by content only where they do not.

    Metadata is scanned for all rows. Content is read, and its patterns run, for the rows of
    the plan alone; a row of the plan without content is classified as unreadable.
    """
    rules = rules or TriageRules()
    plan = cut_lineage(metadata_labels(candidates, title, name, rules))
    settled = plan.where("label <> 'needs_content'").withColumn("method", F.lit("metadata")).withColumn("text_chars", F.lit(0))
    open_ = plan.where("label = 'needs_content'").select(*candidates.columns)
    rows = open_.join(content_of(texts.select(url, F.col("text").alias("_text")), open_, url), url, "left")
    rows = rows.withColumn("_meta", F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(name, F.lit(""))))
    read = classify(rows, "_text", "_meta", None, rules).withColumn("method", F.lit("content"))
    columns = [*candidates.columns, "label", "confidence", "evidence", "method", "text_chars"]
    return settled.select(*columns).unionByName(read.select(*columns))


def merged(candidates: DataFrame, manifest: DataFrame, texts: DataFrame, previous: DataFrame, url: str, title: str,
           name: str, rules: TriageRules | None = None) -> DataFrame:
    """Fresh, failed, missing and pruned documents under one set of labels.

    ``manifest`` has (url, status, bytes, sha256, error), ``texts`` (url, text) for
    what is still at hand, ``previous`` earlier output rows. Without a manifest
    row the metadata decides; a readable document that is gone keeps its earlier row.
    """
    rules = rules or TriageRules()
    meta = metadata_labels(candidates, title, name, rules).select(
        *candidates.columns, F.col("label").alias("_ml"), F.col("confidence").alias("_mc"), F.col("evidence").alias("_me"))
    readable_urls = manifest.where(F.col("status").isin(list(READABLE)))
    texts = content_of(texts, readable_urls, url)
    rows = meta.join(manifest, url, "left").join(texts.withColumn("_here", F.lit(True)), url, "left").join(
        previous.select(url, F.struct("label", "confidence", "evidence", "method").alias("_old")), url, "left")
    readable = F.col("status").isin(list(READABLE))
    fault = F.when(readable & F.col("_here").isNotNull(), F.lit("")).otherwise(
        F.coalesce(F.col("error"), F.lit("document not downloaded")))
    rows = rows.withColumn("_fault", fault).withColumn("_meta", F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(name, F.lit(""))))
    read = classify(rows, "text", "_meta", "_fault", rules)
    c = F.col
    listed = c("status").isNotNull()
    gone = readable & c("_here").isNull() & c("_old").isNotNull()
    fetched = readable | ~listed
    needs = c("_ml") == "needs_content"
    return read.select(
        *candidates.columns,
        F.when(~listed, F.when(needs, "not_downloaded").otherwise(c("_ml"))).when(gone, c("_old")["label"])
        .when(~fetched, "download_failed").otherwise(c("label")).alias("label"),
        F.when(~listed, F.when(needs, "high").otherwise(c("_mc"))).when(gone, c("_old")["confidence"])
        .when(~fetched, "high").otherwise(c("confidence")).alias("confidence"),
        F.when(~listed, "metadata").when(gone, c("_old")["method"]).otherwise("content").alias("method"),
        F.when(~listed, c("_me")).when(gone, c("_old")["evidence"]).otherwise(c("evidence")).alias("evidence"),
        F.when(~listed, "not_needed").when(gone, "pruned").otherwise(c("status")).alias("download_status"),
        F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce("sha256", F.lit("")).alias("sha256"),
    )


def retention(rows: DataFrame, key: str, keep: Sequence[str] = KEEP_LABELS) -> tuple[DataFrame, DataFrame]:
    """Documents to keep and documents that could go; nothing is deleted."""
    kept = rows.where(F.col("label").isin(list(keep)))
    return kept, rows.join(kept.select(key), key, "left_anti")


LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Every link of every page: place, label without tags, absolute URL."""
    pair = F.arrays_zip(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)).alias("h"),
                        F.regexp_extract_all(html, F.lit(LINK), F.lit(2)).alias("t"))
    rows = pages.select(key, url, F.posexplode(pair).alias("place", "_p"))
    label = folded_space(web.unescaped(F.regexp_replace(F.col("_p.t"), "<[^>]*>", "")))
    return rows.select(key, "place", label.alias("link_label"), web.absolute(F.col("_p.h"), F.col(url)).alias("link_url"))


def candidates(found: DataFrame, url: str, order: Column, attributes: Sequence[str], keyword: str,
               most_keywords: int = 10_000) -> DataFrame:
    """One row per URL without fragment: first-seen attributes and the sorted keywords.

    Pairs of URL and keyword are made distinct and numbered first, so that a URL under more
    than ``most_keywords`` different ones is an error before any list is made of them.
    """
    first = F.min(F.struct(order.alias("o"), *attributes)).alias("_first")
    rows = found.withColumn("document_url", web.without_fragment(F.col(url)))
    heads = rows.groupBy("document_url").agg(first)
    words = rows.where(F.col(keyword).isNotNull()).select("document_url", F.col(keyword).alias("_word")).distinct()
    words = words.withColumn("_n", F.row_number().over(Window.partitionBy("document_url").orderBy("_word")))
    word = F.when(F.col("_n") > most_keywords, F.raise_error(F.concat(
        F.lit(f"more than {most_keywords} keywords for "), F.col("document_url")))).otherwise(F.col("_word"))
    lists = words.select("document_url", word.cast("string").alias("_word")).groupBy("document_url").agg(
        F.array_join(F.array_sort(F.collect_list("_word")), ",").alias("keywords"))
    return heads.join(lists, "document_url", "left").select(
        "document_url", *[F.col("_first")[a].alias(a) for a in attributes], F.coalesce("keywords", F.lit("")).alias("keywords"))


def sitemap_urls(sitemaps: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """Distinct sitemap locations whose decoded URL names one of the terms."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)<loc[^>]*>(.*?)</loc>"), F.lit(1))
    rows = sitemaps.select(key, F.explode(found).alias("_l")).select(key, web.unescaped(F.trim("_l")).alias("url"))
    rows = rows.withColumn("decoded", F.coalesce(F.try_url_decode("url"), F.col("url")))
    named = F.lit(False)
    for term in terms:
        named = named | F.contains("decoded", F.lit(term))
    return rows.where(named).distinct()
