"""Sources, sinks, text records, scalar functions and document triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells, names, web
from ..operators import formula
from ..operators.checks import duplicate_keys, required_columns
from ..plans import triage
from ..session import scratch_path
from ..sources import extract, layouts, tables
from ..streaming import incremental
from .registry import query, table


@query("s1_typed_scan", """SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def typed_scan(spark, d):
    path = scratch_path(spark, "nation")
    tables.write_rows(table(spark, d, "nation"), path)
    return tables.read_rows(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("s2_fixed_column_sink", """SELECT c_custkey, c_name, c_acctbal FROM customer""")
def fixed_column_sink(spark, d):
    path = scratch_path(spark, "customer")
    tables.write_rows(table(spark, d, "customer"), path, ["c_custkey", "c_name", "c_acctbal"])
    return tables.read_rows(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("s3_sanitising_sink", r"""SELECT doc_id, nullif(regexp_replace(regexp_replace(text, '[\t\r\n]+', ' ', 'g'), '^ +| +$', '', 'g'), '') AS text FROM documents""")
def sanitising_sink(spark, d):
    path = scratch_path(spark, "documents")
    tables.write_clean_rows(table(spark, d, "documents"), path, ["doc_id", "text"])
    return tables.read_rows(spark, path, "doc_id bigint, text string")


@query("s4_summed_csv", """SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 4) AS a, round(l_discount + l_tax, 4) AS b FROM lineitem
WHERE l_quantity + l_tax <> 0 OR l_discount + l_tax <> 0""")
def summed_csv(spark, d):
    path = scratch_path(spark, "lines")
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
    table(spark, d, "lineitem").select(*columns).write.option("header", True).csv(path)
    out = tables.read_summed_csv(spark, path, "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double",
                                 ["l_orderkey", "l_linenumber"], {"a": ("l_quantity", "l_tax"), "b": ("l_discount", "l_tax")})
    return out.select("l_orderkey", "l_linenumber", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("s5_keys_from_file_names", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderstatus AS st FROM orders""")
def keys_from_file_names(spark, d):
    path = scratch_path(spark, "orders")
    rows = table(spark, d, "orders").select("o_orderkey", F.concat_ws("-", F.year("o_orderdate"), "o_orderstatus").alias("file"))
    rows.write.partitionBy("file").parquet(path)
    back = spark.read.option("recursiveFileLookup", True).schema("o_orderkey bigint").parquet(path)
    out = tables.keyed_by_file(back, r"file=(\d+)-(\w+)", ["yr", "st"])
    return out.select("o_orderkey", F.col("yr").cast("int").alias("yr"), "st")


def order_pages(spark, d):
    """One page per order with a caption and its lines as a two-column table."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(
        F.lit("<tr><td>"), s["l_partkey"].cast("string"), F.lit("</td><td> <b>"), s["l_quantity"].cast("int").cast("string"), F.lit("</b>\n</td></tr>"))), "")
    rows = lines.groupBy("l_orderkey").agg(body.alias("b"))  # an order has a handful of lines
    return rows.select("l_orderkey", F.concat(
        F.lit("<html><table><tr><th>none</th></tr></table><p>x</p><table><caption>lines of the order</caption><tr><th>part &amp; no</th><th>n</th></tr>"),
        F.col("b"), F.lit("</table><table></table></html>")).alias("html"))


PAGE_ROWS = """r AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS INTEGER) AS row_no,
l_partkey || '|' || CAST(l_quantity AS INTEGER) AS cells FROM lineitem), h AS (SELECT DISTINCT l_orderkey, 0 AS row_no, 'part & no|n' AS cells FROM lineitem)"""


@query("s6_html_tables", f"""WITH {PAGE_ROWS} SELECT l_orderkey, 1 AS table_no, row_no, cells FROM r UNION ALL SELECT l_orderkey, 1, row_no, cells FROM h
UNION ALL SELECT l_orderkey, 0, 0, 'none' FROM h""")
def html_tables(spark, d):
    out = extract.html_tables(order_pages(spark, d), "l_orderkey", "html")
    return out.withColumn("cells", F.array_join("cells", "|"))


@query("s7_wanted_table", f"""WITH {PAGE_ROWS} SELECT * FROM r UNION ALL SELECT * FROM h""")
def wanted_table(spark, d):
    rows = extract.html_tables(order_pages(spark, d), "l_orderkey", "html")
    return extract.table_with_cell(rows, "l_orderkey", "n").select("l_orderkey", "row_no", F.array_join("cells", "|").alias("cells"))


@query("s7_captioned_table", f"""WITH {PAGE_ROWS} SELECT * FROM r UNION ALL SELECT * FROM h""")
def captioned_table(spark, d):
    rows = extract.table_at_caption(order_pages(spark, d), "l_orderkey", "html", "lines of the order")
    return rows.select("l_orderkey", "row_no", F.array_join("cells", "|").alias("cells"))


LINES = r"""ln AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS l FROM documents))"""


@query("s8_line_records", rf"""WITH {LINES} SELECT doc_id, line_no, regexp_extract(line, '^(\w+) .*?(\d+)', 1) AS word, TRY_CAST(regexp_extract(line, '^(\w+) .*?(\d+)', 2) AS DOUBLE) AS number
FROM ln WHERE regexp_matches(line, '^(\w+) .*?(\d+)')""")
def line_records(spark, d):
    lines = extract.text_lines(table(spark, d, "documents"), "doc_id", "text")
    return extract.line_records(lines, "line", r"^(\w+) .*?(\d+)", {"word": "string", "number": "double"})[0]


@query("s8_line_rejects", rf"""WITH {LINES} SELECT doc_id, count(*) AS rejected FROM ln WHERE NOT regexp_matches(line, '^(\w+) .*?(\d+)') GROUP BY 1""")
def line_rejects(spark, d):
    lines = extract.text_lines(table(spark, d, "documents"), "doc_id", "text")
    rest = extract.line_records(lines, "line", r"^(\w+) .*?(\d+)", {"word": "string", "number": "double"})[1]
    return rest.groupBy("doc_id").agg(F.count("*").alias("rejected"))


@query("s9_positioned_words", """WITH w AS (SELECT o_orderkey, CAST(round_even(CAST(day(o_orderdate) AS DOUBLE) / 3, 0) AS BIGINT) AS row_no, o_totalprice / 5000 AS c, o_orderpriority AS t, o_custkey FROM orders)
SELECT o_custkey, row_no, arg_min(t, struct_pack(a := abs(c - 20), b := c)) FILTER (abs(c - 20) <= 15) AS "left", arg_min(t, struct_pack(a := abs(c - 70), b := c)) FILTER (abs(c - 70) <= 15) AS "right"
FROM w GROUP BY 1, 2""")
def positioned_words(spark, d):
    words = table(spark, d, "orders").select(
        "o_custkey", extract.row_bucket(F.dayofmonth("o_orderdate").cast("double")).alias("row_no"),
        (F.col("o_totalprice") / 5000).alias("x0"), (F.col("o_totalprice") / 5000).alias("x1"), F.col("o_orderpriority").alias("text"))
    return extract.word_table(words, ["o_custkey", "row_no"], {"left": 20.0, "right": 70.0}, 15.0)


@query("s9_document_words", rf"""WITH {LINES}, s AS (SELECT doc_id, line_no, string_split(line, ' ') AS w FROM ln),
p AS (SELECT doc_id, line_no, unnest(range(len(w))) AS i, unnest(w) AS text FROM s),
q AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT doc_id, line_no, text, CAST(before * 6 AS DOUBLE) AS x0 FROM q WHERE text <> ''""")
def document_words(spark, d):
    lines = extract.text_lines(table(spark, d, "documents"), "doc_id", "text")
    return extract.words_of(lines, ["doc_id", "line_no"], "line").select("doc_id", "line_no", "text", "x0")


@query("s10_wide_histogram", """SELECT l_returnflag AS flag, l_quantity AS score, 'F' AS subject, count(*) FILTER (l_linestatus = 'F') AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_linestatus = 'F') > 0
UNION ALL SELECT l_returnflag, l_quantity, 'O', count(*) FILTER (l_linestatus = 'O') FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_linestatus = 'O') > 0""")
def wide_histogram(spark, d):
    sheet = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_quantity").pivot("l_linestatus", ["F", "O"]).count()
    return extract.long_histogram(sheet, ["flag"], "l_quantity", ["F", "O"])


@query("s10_side_by_side", """SELECT o_custkey, o_orderpriority AS name, o_totalprice AS n FROM orders UNION ALL SELECT o_custkey, o_orderstatus, o_totalprice / 2 FROM orders""")
def side_by_side(spark, d):
    sheet = table(spark, d, "orders").withColumn("half", F.col("o_totalprice") / 2)
    return extract.side_by_side(sheet, ["o_custkey"], [{"name": "o_orderpriority", "n": "o_totalprice"}, {"name": "o_orderstatus", "n": "half"}])


def sheet_layouts():
    return {
        "totals": layouts.totals("^total-", "all", 60.0),
        "grades": layouts.grades("score", "^grade-"),
        "marks": layouts.marks("^mark-", (0, 3)),
        "categories": layouts.categories("^category-", "^[0-9]A[0-9]B$"),
        "levels": layouts.levels("^writing-", "^[0-9]A[0-9]B$", ["six", "five"]),
    }


def written_sheets(spark, d):
    """Seven small sheets in six kinds, one of them unknown, as delimited text under their names."""
    lines = table(spark, d, "lineitem")
    path = scratch_path(spark, "sheets")
    text = lambda c: F.col(c).cast("string")
    whole = lambda c: F.format_string("%d", F.col(c).cast("bigint"))

    def sheet(name, rows, cells, head=()):
        """Rows of cells in the order of ``_at``, below head rows."""
        out = rows.select((F.col("_at") * 10 + 100).cast("bigint").alias("row"), F.concat_ws("\t", *cells).alias("line"))
        for row, line in head:
            out = out.unionByName(spark.range(1).select(F.lit(row).cast("bigint").alias("row"), F.lit(line).alias("line")))
        out.select(F.concat_ws("\t", text("row"), "line").alias("value")).write.text(f"{path}/{name}")

    q = lines.groupBy(F.col("l_quantity").cast("int").alias("_at")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"))
    sheet("total-99", q, [text("_at"), F.format_number("n", 0), F.lit("0")], [(1, "total\tnumber")])
    sheet("grade-1", q, [text("_at"), text("f"), F.lit("-"), text("o")], [(1, "note"), (2, "score\tF\t\tO")])
    sheet("grade-2", q, [text("_at"), F.lit("--"), text("n")], [(2, "score\tnone\tall")])
    band = F.format_string("%d.00 - %d.99", "_at", "_at")
    sheet("mark-7", q, [band, text("f"), F.lit(""), text("_at"), text("o")], [(1, "Reading"), (305, "Writing")])
    k = lines.groupBy((F.pmod("l_suppkey", F.lit(6))).alias("_at")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("f"), F.count_if(F.col("l_returnflag") == "R").alias("o"))
    name = F.concat(text("_at"), F.lit("A"), (5 - F.col("_at")).cast("string"), F.lit("B"))
    sheet("category-3", k, [name, F.format_number("n", 0), F.concat((F.col("n") % 97).cast("string"), F.lit("%"))], [(1, "category\tn\tshare")])
    sheet("writing-3", k, [name, whole("n"), F.lit("x"), whole("f"), whole("f"), F.lit("12.5%"), whole("o"), whole("n"), F.lit("7%")], [(1, "category")])
    sheet("readme", k, [name])
    return layouts.sheet_rows(spark, f"{path}/*")


@query("s10_layouts_by_name", """WITH q AS (SELECT CAST(l_quantity AS INTEGER) AS s, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1),
k AS (SELECT l_suppkey % 6 AS s, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS f, count(*) FILTER (l_returnflag = 'R') AS o FROM lineitem GROUP BY 1),
u AS (SELECT 'total-99' AS name, 'totals' AS layout, 'all' AS subject, NULL AS label, s AS score, n AS count, NULL::DOUBLE AS share FROM q
UNION ALL SELECT 'grade-1', 'grades', 'F', NULL, s, f, NULL FROM q UNION ALL SELECT 'grade-1', 'grades', 'O', NULL, s, o, NULL FROM q
UNION ALL SELECT 'grade-2', 'grades', 'all', NULL, s, n, NULL FROM q
UNION ALL SELECT 'mark-7', 'marks', CASE WHEN s * 10 + 100 < 305 THEN 'Reading' ELSE 'Writing' END, NULL, s + 0.495, f, NULL FROM q
UNION ALL SELECT 'mark-7', 'marks', CASE WHEN s * 10 + 100 < 305 THEN 'Reading' ELSE 'Writing' END, NULL, s, o, NULL FROM q
UNION ALL SELECT 'category-3', 'categories', NULL, s || 'A' || (5 - s) || 'B', NULL, n, n % 97 FROM k
UNION ALL SELECT 'writing-3', 'levels', 'six', s || 'A' || (5 - s) || 'B', NULL, f, 12.5 FROM k UNION ALL SELECT 'writing-3', 'levels', 'five', s || 'A' || (5 - s) || 'B', NULL, o, 7 FROM k)
SELECT name, layout, subject, label, round(CAST(score AS DOUBLE), 6) AS score, CAST(count AS DOUBLE) AS count, CAST(share AS DOUBLE) AS share FROM u""")
def layouts_by_name(spark, d):
    """Five layouts, told by the names of their sheets, in one scan."""
    return layouts.read_sheets(written_sheets(spark, d), sheet_layouts()).withColumn("score", F.round("score", 6))


@query("s10_unknown_names", """SELECT 'readme' AS name, count(DISTINCT l_suppkey % 6) AS rows FROM lineitem""")
def unknown_names(spark, d):
    return layouts.unknown_sheets(written_sheets(spark, d), sheet_layouts())


@query("s11_header_aliases", """SELECT s_suppkey AS code, s_name AS school, s_acctbal AS seats FROM supplier""")
def header_aliases(spark, d):
    sheet = table(spark, d, "supplier").withColumnRenamed("s_suppkey", " Code No ").withColumnRenamed("s_acctbal", "Places")
    return required_columns(sheet, {"code": ["Code", "Code No"], "school": ["s_name", "School"], "seats": ["Seats", "Places"]})


@query("s12_replace_by_key", """SELECT o_orderkey, o_orderstatus AS st, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders""")
def replace_by_key(spark, d):
    """Everything but P is written, F is replaced, and only P is still pending."""
    path = scratch_path(spark, "by-status")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("st"), F.col("o_totalprice").alias("price"))
    incremental.replace_by_key(rows.where("st <> 'P'"), path, "st")
    incremental.replace_by_key(rows.where("st = 'F'").withColumn("price", F.col("price") * 2), path, "st")
    incremental.replace_by_key(incremental.pending(rows, spark, path, "st"), path, "st")
    return incremental.current(spark, path).select("o_orderkey", "st", "price")


@query("s13_union_sources", """SELECT 'customer' AS system, c_name AS name, c_acctbal AS seats, c_mktsegment AS grp FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier""")
def union_sources(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return tables.union_sources([
        (c, {"system": F.lit("customer"), "name": F.col("c_name"), "seats": F.col("c_acctbal"), "grp": F.col("c_mktsegment")}),
        (s, {"system": F.lit("supplier"), "name": F.col("s_name"), "seats": F.col("s_acctbal")})], ["system", "name", "seats", "grp"])


@query("s14_content_manifest", """SELECT url, substr(sha256(url), 1, 24) AS filename, 'ok' AS status, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages""")
def content_manifest(spark, d):
    return tables.content_manifest(table(spark, d, "pages"), "url", "html")


@query("s15_star_export", """WITH h AS (SELECT l_returnflag AS subject, l_quantity AS score, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2)
SELECT 'subjects' AS part, subject, score, n FROM h UNION ALL SELECT 'totals', subject, NULL, sum(n) FROM h GROUP BY 2
UNION ALL SELECT f, s, NULL, NULL FROM (VALUES ('AN', 'A'), ('AN', 'N'), ('R', 'R')) t(f, s)""")
def star_export(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("subject"), F.col("l_quantity").alias("score"), F.lit(1.0).alias("n"))
    subjects, members, totals = tables.star_export(lines, "subject", "score", "n", {"AN": ("A", "N"), "R": ("R",)})
    none = F.lit(None).cast("double")
    return subjects.select(F.lit("subjects").alias("part"), "subject", "score", "n").unionByName(
        totals.select(F.lit("totals").alias("part"), "subject", none.alias("score"), F.col("total").alias("n"))).unionByName(
        members.select(F.col("formula").alias("part"), "subject", none.alias("score"), none.alias("n")))


@query("s16_report_payload", """SELECT '{"lines":' || (SELECT count(*) FROM lineitem) || ',"flags":[' || (SELECT string_agg('{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '","n":' || n || ',"mean":' || mean || '}', ',' ORDER BY l_returnflag, l_linestatus)
FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1, 2)) || '],"years":[' ||
(SELECT string_agg('{"year":' || year || ',"n":' || n || '}', ',' ORDER BY year) FROM (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1)) || ']}' AS payload""")
def report_payload(spark, d):
    """Aggregated tables of fixed size as one JSON document."""
    lines = table(spark, d, "lineitem")
    flags = lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"))
    years = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    packed = lambda df: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))))
    total = lines.agg(F.count("*").alias("lines"))
    return total.select(F.to_json(F.struct("lines", packed(flags).scalar().alias("flags"), packed(years).scalar().alias("years"))).alias("payload"))


BLOCKS = LINES + r""", mk AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z]\S* (is|en|de|un|the|la|el|le) ') THEN 1 ELSE 0 END AS m FROM ln),
bk AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM mk)"""


@query("s17_block_records", f"""WITH {BLOCKS} SELECT doc_id, CAST(block AS BIGINT) AS block, max(CASE WHEN m = 1 THEN split_part(line, ' ', 1) END) AS head,
coalesce(string_agg(CASE WHEN m = 0 THEN split_part(line, ' ', 1) END, ';' ORDER BY line_no), '') AS items FROM bk WHERE block > 0 GROUP BY 1, 2""")
def block_records(spark, d):
    lines = extract.text_lines(table(spark, d, "documents"), "doc_id", "text")
    marker = F.col("line").rlike(r"^[A-Z]\S* (is|en|de|un|the|la|el|le) ")
    rows = extract.blocks(lines, ["doc_id"], ["line_no"], marker)
    word = F.substring_index("line", " ", 1)
    return extract.block_records(rows, ["doc_id"], F.col("line_no"), {"head": (marker, word)}, {"items": (~marker, word)})


@query("p1_normalised_score", """SELECT o_orderkey, round(o_totalprice / ((2.0 + 1.5) * CASE WHEN year(o_orderdate) <= 1998 THEN 100 ELSE 60 END + 0.5 * 100), 8) AS norm FROM orders""")
def normalised_score(spark, d):
    text = F.lit("國x2.00 英x1.50 術x0.50")
    most = formula.largest_score(text, {"術": 100.0}, F.when(F.year("o_orderdate") <= 1998, 100.0).otherwise(60.0))
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / most, 8).alias("norm"))


@query("f1_base_name", """SELECT p_partkey, trim(split_part(n, '(', 1)) AS base, replace(trim(split_part(n, '(', 1)), 'hot ', 'warm ') AS grouping FROM
(SELECT p_partkey, p_name || CASE WHEN p_size > 20 THEN ' (' || p_type || ')' ELSE '' END AS n FROM part)""")
def base_name(spark, d):
    name = F.concat("p_name", F.when(F.col("p_size") > 20, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise(""))
    return table(spark, d, "part").select("p_partkey", names.base_name(name).alias("base"), names.grouping_key(name, ("hot ", "warm ")).alias("grouping"))


@query("f2_successor_names", """SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'UNION_X' WHEN 'NATION_2' THEN 'UNION_X' ELSE n_name END AS current,
regexp_replace(n_name, '(_10|_20)$', '') AS bare, CASE WHEN n_name = 'NATION_9' THEN 'NATION_7 | NATION_8' ELSE '' END AS former FROM nation""")
def successor_names(spark, d):
    n = F.col("n_name")
    return table(spark, d, "nation").select(
        "n_nationkey", names.renamed(n, {"NATION_1": "UNION_X", "NATION_2": "UNION_X"}).alias("current"),
        names.without_suffix(n, ["_10", "_20"]).alias("bare"), names.predecessors(n, {"NATION_8": "NATION_9", "NATION_7": "NATION_9"}).alias("former"))


@query("f3_tokenise_labels", """SELECT p_partkey, CASE WHEN regexp_full_match(p_type, '(ECONOMY|ECO|NOM|SMALL|S|MALL|PRO|MO)+') THEN
array_to_string(regexp_extract_all(p_type, '(ECONOMY|SMALL|MALL|ECO|NOM|PRO|MO|S)', 1), '+') END AS tokens FROM part""")
def tokenise_labels(spark, d):
    got = names.tokens(F.col("p_type"), ["ECO", "ECONOMY", "NOM", "SMALL", "S", "MALL", "PRO", "MO"], {})
    return table(spark, d, "part").select("p_partkey", F.array_join(got, "+").alias("tokens"))


@query("f4_formula_parts", """SELECT p_partkey, unnest(['w', 'size']) AS subject, unnest([CAST(p_size AS DOUBLE), p_size + 0.5]) AS weight FROM part""")
def formula_parts(spark, d):
    text = F.concat(F.lit("wx"), F.col("p_size").cast("string"), F.lit("  sizex"), F.col("p_size").cast("string"), F.lit(".5"))
    return table(spark, d, "part").select("p_partkey", F.inline(formula.parts(text)))


@query("f5_binding_gates", """WITH h AS (SELECT l_returnflag AS s, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
g AS (SELECT p_partkey, unnest(['A', 'R', 'Z']) AS s, unnest([p_size, 50 - p_size, 9]) AS level FROM part),
t AS (SELECT p_partkey, g.s, level, sum(CASE WHEN v > level THEN n WHEN v = level THEN n / 2 ELSE 0 END) / sum(n) AS top FROM g JOIN h ON h.s = g.s GROUP BY 1, 2, 3)
SELECT p.p_partkey, round(coalesce(1 - min(top), 0), 9) AS strictest FROM part p LEFT JOIN t ON t.p_partkey = p.p_partkey AND top < 0.95 GROUP BY 1""")
def binding_gates(spark, d):
    from ..operators import hist

    h = hist.histogram(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "subject"), ["subject"], "l_quantity")
    h = h.select("subject", F.col("l_quantity").alias("score"), "n")
    text = F.concat(F.lit("Atop"), F.col("p_size").cast("string"), F.lit(" Rfront"), (50 - F.col("p_size")).cast("string"), F.lit(" Ztop9"))
    rows = table(spark, d, "part").select("p_partkey", text.alias("g"))
    binding = formula.binding_gates(rows, h, [], "p_partkey", "g", "top|front")
    return formula.strictest(rows, binding, "p_partkey").select("p_partkey", F.round("strictest", 9).alias("strictest"))


@query("f6_text_projection", r"""SELECT doc_id, md5(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[ \t\n\f\r]+', ' ', 'g')), '[^a-z ]', '', 'g')) AS plain,
md5(regexp_replace(text, '[ \t\n\f\r]*\n[ \t\n\f\r]*', '', 'g')) AS rejoined FROM documents""")
def text_projection(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.md5(F.regexp_replace(names.folded_space(F.col("text")), "[^a-z ]", "")).alias("plain"), F.md5(names.rejoined(F.col("text"))).alias("rejoined"))


@query("f7_ranges_and_numbers", """SELECT l_orderkey, l_linenumber, (l_quantity + l_quantity + 1) / 2 AS mid, round(l_extendedprice, 2) AS price FROM lineitem""")
def ranges_and_numbers(spark, d):
    q = F.col("l_quantity").cast("string")
    band = F.concat(q, F.lit(" - "), (F.col("l_quantity") + 1).cast("string"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", cells.range_midpoint(band).alias("mid"),
        F.round(cells.number(F.concat(F.format_number("l_extendedprice", 2), F.lit("%"))), 2).alias("price"))


@query("f8_bar_cells", """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'ab' ELSE 'xyz' END AS label, CAST(p_size AS DOUBLE) AS level,
CAST(CASE WHEN p_size > 25 THEN 2 ELSE 3 END AS INTEGER) AS n, round(p_size / (15.0 * CASE WHEN p_size > 25 THEN 2 ELSE 3 END), 4) AS norm,
CAST(CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS INTEGER) AS fired FROM part""")
def bar_cells(spark, d):
    size = F.col("p_size").cast("string")
    first, second = F.concat(F.lit("xyz"), size), F.when(F.col("p_size") > 25, F.concat(F.lit("(a+b)"), size)).otherwise("--")
    read = [cells.bar_cell(c, "xyzab", "[ab](?=[+)])") for c in (first, second)]
    return table(spark, d, "part").select("p_partkey", F.inline(F.array(cells.binding_bar(read, 15.0))))


@query("f9_codes", """SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS code FROM supplier""")
def codes(spark, d):
    text = F.concat(F.col("s_suppkey").cast("string"), F.when(F.col("s_acctbal") > 0, ".0").otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", cells.code(text, 5).alias("code"))


@query("f10_categories", """WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, a || 'A' || b || 'B' || (12 - a - b) || 'C' AS category, CAST(6 * a + 4 * b + 2 * (12 - a - b) AS INTEGER) AS points FROM c""")
def categories(spark, d):
    from ..operators.latent import category_text

    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "N").alias("b"))
    rows = counts.withColumn("category", category_text([F.col("a"), F.col("b")], "ABC", 12))
    return rows.select("l_orderkey", "category", cells.category_points(F.col("category"), {"A": 6, "B": 4, "C": 2}).alias("points"))


@query("f11_urls", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['s', 'h', 'p', 'q']) AS m FROM pages)
SELECT page_id, lower(m.s) || '://' || m.h || CASE WHEN m.p = '' THEN '/' ELSE m.p END || m.q AS normalized, m.s || '://' || m.h AS origin,
CASE WHEN url LIKE 'http://%' THEN 'https' || substr(url, 5) || ' ' || url ELSE url END AS variants, regexp_matches(lower(m.p), '\.html$') AS document FROM p""")
def urls(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", web.normalized(u).alias("normalized"), web.origin(u).alias("origin"), F.array_join(web.variants(u), " ").alias("variants"),
        web.is_document(u, F.lit(""), (".html",)).alias("document"))


@query("f13_clip_and_product", """SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, l_tax * 20)) AS clipped, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 8) AS ratio,
round(greatest(l_discount, 1e-300) * greatest(l_tax, 1e-300) * 0.5, 10) AS product FROM lineitem""")
def clip_and_product(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", cells.clipped(F.col("l_tax") * 20).alias("clipped"), F.round(cells.safe_divide(F.col("l_tax"), F.col("l_discount")), 8).alias("ratio"),
        F.round(cells.product(F.array("l_discount", "l_tax", F.lit(0.5))), 10).alias("product"))


@query("f14_array_steps", """SELECT l_orderkey, l_linenumber, round(l_tax - l_discount, 8) AS diff, round(l_discount + l_tax + l_quantity, 8) AS total,
round((l_discount + 2 * l_tax + l_quantity) / 4, 8) AS mean, round(pow(l_quantity - 2 * l_tax + l_discount, 2), 6) AS bend,
round(exp(l_discount) / (exp(l_discount) + exp(l_tax) + exp(l_quantity / 50)), 8) AS share FROM lineitem""")
def array_steps(spark, d):
    from ..operators import models

    v = F.array("l_discount", "l_tax", "l_quantity")
    weights = cells.trapezoid_weights(3)
    mean = F.aggregate(F.zip_with(v, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x) / 2
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.get(cells.differences(v), F.lit(0)), 8).alias("diff"), F.round(F.get(cells.cumulative(v), F.lit(2)), 8).alias("total"),
        F.round(mean, 8).alias("mean"), F.round(models.bend_penalty(v), 6).alias("bend"),
        F.round(F.get(models.softmax(F.array("l_discount", "l_tax", F.col("l_quantity") / 50)), F.lit(0)), 8).alias("share"))


@query("f15_known_readings", """WITH p AS (SELECT l_partkey, max(l_discount) FILTER (l_returnflag = 'A' AND l_tax > 0.06) AS a, max(l_discount) FILTER (l_returnflag = 'R' AND l_tax > 0.07) AS r FROM lineitem GROUP BY 1)
SELECT l_partkey, CAST((a IS NOT NULL)::INT + (r IS NOT NULL)::INT AS INTEGER) AS n, CASE WHEN a IS NOT NULL THEN 'first' WHEN r IS NOT NULL THEN 'second' ELSE 'none' END AS system FROM p""")
def known_readings(spark, d):
    flag, tax = F.col("l_returnflag"), F.col("l_tax")
    got = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max(F.when((flag == "A") & (tax > 0.06), F.col("l_discount"))).alias("a"),
                                                               F.max(F.when((flag == "R") & (tax > 0.07), F.col("l_discount"))).alias("r"))
    m = cells.known_readings(["a", "r"])
    return got.select("l_partkey", F.size(m).alias("n"), cells.system_of(m, {"first": ["a"], "second": ["r"]}, "none").alias("system"))


@query("f16_json_flatten", """SELECT event_id, unnest(CASE WHEN event_type = 'click' THEN [event_type, CAST(json_extract(props, '$.k') AS VARCHAR)] ELSE [event_type] END) AS name FROM events""")
def json_flatten(spark, d):
    k = F.get_json_object("props", "$.k")
    many = F.concat(F.lit('["'), "event_type", F.lit('", "'), k, F.lit('"]'))
    one = F.concat(F.lit('"'), "event_type", F.lit('"'))
    json = F.concat(F.lit('{"data": {"name": '), F.when(F.col("event_type") == "click", many).otherwise(one), F.lit("}}"))
    return table(spark, d, "events").select("event_id", F.explode(cells.listed(json, "$.data.name")).alias("name"))


@query("f17_era_year", """SELECT p_partkey, p_size + 1911 AS western FROM part""")
def era_year(spark, d):
    """Part sizes stand for years of the era that begins after 1911."""
    return table(spark, d, "part").select("p_partkey", cells.western_year(F.col("p_size")).alias("western"))


@query("f18_split_at_head", """SELECT p_partkey, CASE WHEN p_size > 10 THEN p_brand || 'UNIV' ELSE 'carried' END AS head, CASE WHEN p_size > 10 THEN p_name ELSE p_brand || ' ' || p_name END AS tail FROM part""")
def split_at_head(spark, d):
    text = F.when(F.col("p_size") > 10, F.concat("p_brand", F.lit("UNIV "), "p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    head, tail = names.split_at_head(text, ["UNIV", "COLLEGE"], F.lit("carried"))
    return table(spark, d, "part").select("p_partkey", head.alias("head"), tail.alias("tail"))


@query("f18_wrapped_names", """WITH l AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN p_type || ' FOUNDATION' ELSE p_type END AS name,
  CASE p_size % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'School' || (p_partkey % 10) ELSE p_name || ' ' || p_brand END AS line FROM part),
n AS (SELECT *, first_value(nullif(trim(line), '') IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM l)
SELECT p_partkey, CASE WHEN name LIKE '%FOUNDATION' AND nxt IS NOT NULL AND NOT contains(nxt, ' ') AND (nxt LIKE '%1' OR nxt LIKE '%2') THEN nxt ELSE name END AS name FROM n""")
def wrapped_names(spark, d):
    school = F.concat(F.lit("School"), (F.col("p_partkey") % 10).cast("string"))
    line = F.when(F.col("p_size") % 3 == 0, "  ").when(F.col("p_size") % 3 == 1, school).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    name = F.when(F.col("p_size") > 25, F.concat("p_type", F.lit(" FOUNDATION"))).otherwise(F.col("p_type"))
    rows = table(spark, d, "part").select("p_partkey", "p_brand", name.alias("name"), line.alias("line"))
    return names.unwrapped(rows, ["p_brand"], ["p_partkey"], "name", "line", ["FOUNDATION"], ["1", "2"]).select("p_partkey", "name")


@query("f18_part_labels", """SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN p_type ELSE replace(p_brand, 'Brand', '') || '-' || p_type END AS label FROM part""")
def part_labels(spark, d):
    part = F.when(F.col("p_brand").endswith("1"), "all").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", names.part_label(part, F.col("p_type"), "all", "Brand").alias("label"))


@query("f2_without_prefix", """SELECT p_partkey, trim(regexp_replace(p_brand, '^(Brand#|Maker )', '')) AS maker FROM part""")
def without_prefix(spark, d):
    return table(spark, d, "part").select("p_partkey", names.without_prefix(F.col("p_brand"), ["Brand#", "Maker "]).alias("maker"))


@query("f6_han_only", """SELECT doc_id, regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g') AS han FROM documents""")
def han_only(spark, d):
    return table(spark, d, "documents").select("doc_id", names.cjk_only(F.coalesce("text", F.lit(""))).alias("han"))


@query("f7_whole_numbers", """SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS n, NULL::BIGINT AS none FROM orders""")
def whole_numbers(spark, d):
    text = F.format_number("o_custkey", 0)
    return table(spark, d, "orders").select("o_orderkey", cells.whole_number(text).alias("n"), cells.whole_number(F.concat(text, F.lit("x"))).alias("none"))


@query("p8_duplicate_keys", """SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicates(spark, d):
    return duplicate_keys(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("s9_nearest_anchor", """SELECT s_suppkey, CASE WHEN abs(s_acctbal - 1000) <= 900 AND abs(s_acctbal - 1000) <= abs(s_acctbal - 2500) THEN 'low' WHEN abs(s_acctbal - 2500) <= 900 THEN 'high' END AS anchor FROM supplier""")
def nearest_anchor(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", extract.nearest_anchor(F.col("s_acctbal"), {"low": 1000.0, "high": 2500.0}, 900.0).alias("anchor"))


RULES = triage.TriageRules(
    bins={"address": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "phone": r"\+1 \(\d{3}\)", "mail": r"@mail\d", "token": "token = "},
    quantile=r"mail(\d)", value=r"\((\d{3})\)", stats=("License", "Copyright", "token", "Lorem"), number_range=r"(\d{1,3})-(\d{2,4})",
    context=r"[Ll]icense|[Cc]opyright|token", report=r" \| ", training=r"Wh|Qu", admission=r"%%%|###|!!", exam=r"\d{3}",
    readable_name="[a-z]", compatibility=False)


def _signals(t: str, by: str = "") -> str:
    bins = ", ".join(f"CASE WHEN regexp_matches({t}, '(?i){p}') THEN '{n}' END" for n, p in RULES.bins.items())
    stats = ", ".join(f"CASE WHEN contains({t}, '{s}') THEN '{s}' END" for s in RULES.stats)
    uniq = lambda p: f"list_sort(list_distinct(regexp_extract_all({t}, '{p}', 1)))"
    return f"""list_filter([{bins}], lambda x: x IS NOT NULL) AS bins, {uniq(RULES.quantile)} AS qs, {uniq(RULES.value)} AS vs,
  list_filter([{stats}], lambda x: x IS NOT NULL) AS st, len(regexp_extract_all({t}, '{RULES.number_range}')) AS rg, regexp_matches({t}, '{RULES.context}') AS ctx,
  regexp_matches({t}, '{RULES.report}') AS rep, regexp_matches({t}, '{RULES.exam}') AS ex, regexp_matches({t}, '{RULES.training}') AS trn, regexp_matches({t}, '{RULES.admission}') AS adm"""


EVIDENCE = """concat_ws(';', CASE WHEN ctx THEN 'entrance_context' END, CASE WHEN rep THEN 'school_report' END, CASE WHEN len(bins) > 0 THEN 'cap_bins=' || array_to_string(bins, ',') END,
  CASE WHEN len(qs) > 0 THEN 'percentiles=P' || array_to_string(qs, ',P') END, CASE WHEN len(vs) > 0 THEN 'pr_values=' || array_to_string(vs[1:8], ',') END,
  CASE WHEN len(st) > 0 THEN 'stats=' || array_to_string(st, ',') END, CASE WHEN rg > 0 THEN 'score_ranges=' || rg END{})"""
EXAM = EVIDENCE.format(", CASE WHEN ex THEN 'exam_score_context' END")
BODY = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\f\r]+', ' ', 'g'))"
DECIDE = """CASE WHEN thin AND (ctx OR rep) THEN 'needs_ocr_or_conversion' WHEN thin AND NOT (adm OR trn) THEN 'unreadable'
  WHEN ctx AND (strc OR ex AND (len(st) >= 2 OR rg >= 2)) THEN 'entrance_distribution' WHEN rep AND strc THEN 'possible_entrance_distribution'
  WHEN ctx THEN 'entrance_report_no_distribution' WHEN rep THEN 'school_plan_or_report' WHEN adm THEN 'admissions_notice' WHEN trn THEN 'training_or_event' ELSE 'other' END"""
CONFIDENCE = "CASE WHEN thin AND (ctx OR rep) OR label IN ('possible_entrance_distribution', 'other') THEN 'medium' ELSE 'high' END"
CLASSIFIED = f"""b AS (SELECT doc_id, lang, source, {BODY} AS body, ' ' || {BODY} AS al FROM documents), s AS (SELECT *, {_signals('al')} FROM b),
k AS (SELECT *, length(body) < 40 AS thin, len(bins) >= 2 OR len(qs) >= 2 OR len(vs) >= 2 AS strc FROM s), l AS (SELECT *, {DECIDE} AS label FROM k)"""


@query("d1_link_extraction", r"""WITH h AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS o,
regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS hs, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS ts FROM pages),
u AS (SELECT page_id, o, CAST(unnest(range(len(hs))) AS INTEGER) AS place, unnest(hs) AS h, unnest(ts) AS t FROM h),
c AS (SELECT *, replace(replace(trim(h), '&amp;', '&'), '&#39;', '''') AS l FROM u)
SELECT page_id, place, trim(regexp_replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&amp;', '&'), '[ \t\n\f\r]+', ' ', 'g')) AS link_label,
CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN l WHEN l LIKE '//%' THEN split_part(o, ':', 1) || ':' || l WHEN l LIKE '/%' THEN o || l ELSE o || '/' || l END AS link_url FROM c""")
def link_extraction(spark, d):
    return triage.links(table(spark, d, "pages"), "page_id", "url", "html")


@query("d2_candidates", r"""WITH h AS (SELECT page_id, regexp_extract(html, 'lang="(\w+)"', 1) AS lang, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS o, regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 1) AS hs FROM pages),
u AS (SELECT page_id, lang, unnest(range(len(hs))) AS place, split_part(o || unnest(hs), '#', 1) AS document_url FROM h)
SELECT document_url, min(page_id) AS page_id, array_to_string(list_sort(list_distinct(list(lang))), ',') AS keywords FROM u GROUP BY 1""")
def document_candidates(spark, d):
    pages = table(spark, d, "pages")
    found = triage.links(pages, "page_id", "url", "html").join(pages.select("page_id", F.regexp_extract("html", r'lang="(\w+)"', 1).alias("lang")), "page_id")
    return triage.candidates(found, "link_url", F.struct("page_id", "place"), ["page_id"], "lang")


@query("d3_sitemap_locations", """SELECT DISTINCT page_id, url || '&t=%C3%A9t%C3%A9' AS url FROM pages WHERE url LIKE '%/fr/%' OR url LIKE '%/de/%'""")
def sitemap_locations(spark, d):
    text = F.concat(F.lit("<urlset><url><loc> "), F.col("url"), F.lit("&amp;t=%C3%A9t%C3%A9</loc></url><url><LOC>"), F.lit("http://x.example.org/none</LOC></url></urlset>"))
    maps = table(spark, d, "pages").select("page_id", text.alias("body"))
    return triage.sitemap_urls(maps, "page_id", "body", ["/fr/", "/de/"]).select("page_id", "url")


@query("d4_signals", f"""WITH {CLASSIFIED} SELECT doc_id, array_to_string(bins, ',') AS bins, array_to_string(qs, ',') AS quantiles, array_to_string(vs, ',') AS value_marks,
array_to_string(st, ',') AS stats, CAST(rg AS INTEGER) AS ranges, {EXAM} AS evidence FROM k""")
def signals(spark, d):
    body = table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), names.folded_space(F.col("text"))).alias("al"))
    out = triage.with_signals(body, "al", RULES)
    return out.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("bins", "quantiles", "value_marks", "stats")], "ranges", triage.evidence(True).alias("evidence"))


@query("d5_content_labels", f"WITH {CLASSIFIED} SELECT doc_id, label, {CONFIDENCE} AS confidence, {EXAM} AS evidence, length(body) AS text_chars FROM l")
def content_labels(spark, d):
    out = triage.classify(tables.spread(table(spark, d, "documents").select("doc_id", "text")), "text", rules=RULES)
    return out.select("doc_id", "label", "confidence", "evidence", F.col("text_chars").cast("bigint").alias("text_chars"))


@query("d6_metadata_plan", f"""WITH p AS (SELECT page_id, CASE WHEN url LIKE '%?%' THEN '' ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS title, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages),
b AS (SELECT page_id, trim(regexp_replace(title, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS t, trim(regexp_replace(name, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS nm FROM p), s AS (SELECT *, {_signals("(t || ' ' || nm)")} FROM b)
SELECT page_id, CASE WHEN ctx OR rep OR rg > 0 OR len(bins) > 0 OR len(qs) > 0 OR len(vs) > 0 OR len(st) > 0 THEN 'needs_content' WHEN adm THEN 'admissions_notice' WHEN trn THEN 'training_or_event'
WHEN t = '' AND len(regexp_extract_all(regexp_replace(nm, '(.)\\.[^.]*$', '\\1'), '[a-z]')) < 3 THEN 'needs_content' ELSE 'other' END AS label FROM s""")
def metadata_plan(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.when(F.contains("url", F.lit("?")), "").otherwise(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"),
                                            F.regexp_extract("url", "([^/]*)$", 1).alias("name"))
    return triage.metadata_labels(pages, "title", "name", RULES).select("page_id", "label")


def merged_documents(spark, d):
    """Labelled documents are listed; toxic ones failed to load and low-quality English ones are gone but known."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("url"), "text", "lang", F.lit("").alias("title"), F.lit("file").alias("name"))
    marks = table(spark, d, "labels").withColumnRenamed("doc_id", "url")
    listed = docs.join(marks, "url")
    gone = (F.col("quality") == 0) & (F.col("toxic") == 0) & (F.col("lang") == "en")
    manifest = listed.select("url", F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"), F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"), F.lit(None).cast("string").alias("error"))
    previous = listed.where(gone).select("url", F.lit("other").alias("label"), F.lit("medium").alias("confidence"), F.lit("").alias("evidence"), F.lit("content").alias("method"))
    texts = listed.where(~gone & (F.col("toxic") == 0)).select("url", "text")
    return triage.merged(docs.select("url", "title", "name"), manifest, texts, previous, "url", "title", "name", RULES)


PAGE_META = """p AS (SELECT page_id, html, CASE WHEN url LIKE '%?%' THEN '' ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS title, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages),
b AS (SELECT page_id, html, title, name, trim(regexp_replace(title, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS t, trim(regexp_replace(name, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS nm FROM p)"""
META_LABEL = """CASE WHEN ctx OR rep OR rg > 0 OR len(bins) > 0 OR len(qs) > 0 OR len(vs) > 0 OR len(st) > 0 THEN 'needs_content' WHEN adm THEN 'admissions_notice' WHEN trn THEN 'training_or_event'
WHEN t = '' AND len(regexp_extract_all(regexp_replace(nm, '(.)\\.[^.]*$', '\\1'), '[a-z]')) < 3 THEN 'needs_content' ELSE 'other' END"""


def page_meta(spark, d):
    return table(spark, d, "pages").select("page_id", F.when(F.contains("url", F.lit("?")), "").otherwise(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"),
                                           F.regexp_extract("url", "([^/]*)$", 1).alias("name"))


@query("d6_metadata_rows", f"""WITH {PAGE_META}, s AS (SELECT *, {_signals("(t || ' ' || nm)")} FROM b), m AS (SELECT *, {META_LABEL} AS label FROM s)
SELECT page_id, label, CASE label WHEN 'needs_content' THEN '' WHEN 'other' THEN 'medium' ELSE 'high' END AS confidence, {EVIDENCE.format('')} AS evidence FROM m""")
def metadata_rows(spark, d):
    return triage.metadata_labels(page_meta(spark, d), "title", "name", RULES).select("page_id", "label", "confidence", "evidence")


@query("d6_content_of_open_rows", f"""WITH {PAGE_META}, s AS (SELECT *, {_signals("(t || ' ' || nm)")} FROM b), m AS (SELECT *, {META_LABEL} AS ml, {EVIDENCE.format('')} AS me FROM s),
o AS (SELECT page_id, trim(regexp_replace(html, '[ \t\n\f\r]+', ' ', 'g')) AS body, trim(regexp_replace(title || ' ' || name, '[ \t\n\f\r]+', ' ', 'g')) AS head FROM m WHERE ml = 'needs_content'),
s2 AS (SELECT *, {_signals("(head || ' ' || body)")} FROM o), k AS (SELECT *, length(body) < 40 AS thin, len(bins) >= 2 OR len(qs) >= 2 OR len(vs) >= 2 AS strc FROM s2), l AS (SELECT *, {DECIDE} AS label FROM k)
SELECT page_id, ml AS label, CASE ml WHEN 'other' THEN 'medium' ELSE 'high' END AS confidence, me AS evidence, 'metadata' AS method, 0 AS text_chars FROM m WHERE ml <> 'needs_content'
UNION ALL SELECT page_id, label, {CONFIDENCE}, {EXAM}, 'content', CAST(length(body) AS INTEGER) FROM l""")
def content_of_open_rows(spark, d):
    """Titles and names of all pages; the page itself only where they leave it open."""
    texts = table(spark, d, "pages").select("page_id", F.col("html").alias("text"))
    return triage.routed(page_meta(spark, d), texts, "page_id", "title", "name", RULES).drop("title", "name")


@query("d7_manifest_rows", f"""WITH {CLASSIFIED}, y AS (SELECT l.*, d.text, q.quality AS q, q.toxic AS tx FROM l JOIN documents d USING (doc_id) LEFT JOIN labels q USING (doc_id)),
z AS (SELECT *, CASE WHEN q IS NULL THEN 'new' WHEN q = 0 AND tx = 0 AND lang = 'en' THEN 'gone' WHEN tx = 1 THEN 'failed' ELSE 'read' END AS kind FROM y)
SELECT doc_id, CASE kind WHEN 'read' THEN label WHEN 'failed' THEN 'download_failed' ELSE 'other' END AS label,
  CASE kind WHEN 'read' THEN {CONFIDENCE} WHEN 'failed' THEN 'high' ELSE 'medium' END AS confidence, CASE kind WHEN 'new' THEN 'metadata' ELSE 'content' END AS method,
  CASE kind WHEN 'read' THEN {EXAM} ELSE '' END AS evidence, CASE kind WHEN 'new' THEN 'not_needed' WHEN 'gone' THEN 'pruned' WHEN 'failed' THEN 'error' ELSE 'ok' END AS download_status,
  CASE kind WHEN 'new' THEN 0 ELSE octet_length(encode(text)) END::BIGINT AS bytes, CASE kind WHEN 'new' THEN '' ELSE sha256(text) END AS sha256 FROM z""")
def manifest_rows(spark, d):
    """Every column of the merge."""
    return merged_documents(spark, d).select(F.col("url").alias("doc_id"), "label", "confidence", "method", "evidence", "download_status", "bytes", "sha256")


@query("d7_manifest_merge", f"""WITH {CLASSIFIED}, y AS (SELECT l.*, q.quality AS q, q.toxic AS tx FROM l LEFT JOIN labels q USING (doc_id))
SELECT doc_id, CASE WHEN q IS NULL THEN 'needs_content_or_not' WHEN q = 0 AND tx = 0 AND lang = 'en' THEN 'old' WHEN tx = 1 THEN 'download_failed' ELSE 'read' END AS state FROM y""")
def manifest_merge(spark, d):
    out = merged_documents(spark, d)
    state = (F.when(F.col("download_status") == "not_needed", "needs_content_or_not").when(F.col("download_status") == "pruned", "old")
             .when(F.col("label") == "download_failed", "download_failed").otherwise("read"))
    return out.select(F.col("url").alias("doc_id"), state.alias("state"))


@query("d8_retention_split", f"""WITH {CLASSIFIED} SELECT doc_id, label IN ('entrance_distribution', 'possible_entrance_distribution', 'entrance_report_no_distribution', 'needs_ocr_or_conversion') AS kept FROM l""")
def retention_split(spark, d):
    rows = triage.classify(table(spark, d, "documents"), "text", rules=RULES).select("doc_id", "label")
    kept, spare = triage.retention(rows, "doc_id")
    return kept.select("doc_id", F.lit(True).alias("kept")).unionByName(spare.select("doc_id", F.lit(False).alias("kept")))
