"""Registered queries over catalogue edits, term sets, file handling, recognition passes and the request log, with their SQL.

The expressions that make inputs from tables are plain enough to be the same in both dialects; what is compared is the
operator.
"""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import stem as file_stem
from .operators import boxes, images, logs
from .plans import catalog
from .plans.catalog import Field, Pattern
from .plans.redact import as_json, redact
from .queries import FIELDS_SQL, NUMBERS, ORACLES, PATTERNS_SQL, WORD_BOXES, common_fields, fields_of, patterns_of, query, table, word_boxes
from .sources import batch, readers, terms, writers
from .sources.scratch import shared_dir
from .sources.store import Store, catalogue_migrations
from .streaming.quota import count_requests
from .streaming.redact import read_folder, redact_stream

# ---- catalogue edits -----------------------------------------------------------------------------------------------

@query("field_created", f"SELECT * FROM {FIELDS_SQL} UNION ALL SELECT max(id) + 1, 3, 'New', '{catalog.MASK}', true, false, 500 FROM {FIELDS_SQL}")
def field_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new field with a blank replacement has the mask, and a priority of 500."""
    return catalog.add_field(fields_of(spark, sf_dir), "New", "  ", client_id=3)


@query("field_updated", f"SELECT * REPLACE (is_active AND id <> 4 AS is_active, is_preserve OR id = 4 AS is_preserve, CASE WHEN id = 4 THEN 'x' ELSE replace_with END AS replace_with, CASE WHEN id = 4 THEN 7 ELSE priority END AS priority) FROM {FIELDS_SQL}")
def field_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.updated(fields_of(spark, sf_dir), 4, is_active=False, is_preserve=True, replace_with="x", priority=7)


@query("field_deleted", f"SELECT 'field' AS kind, id FROM {FIELDS_SQL} WHERE id <> 3 UNION ALL SELECT 'pattern', id FROM {PATTERNS_SQL} WHERE field_id <> 3")
def field_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field goes with its patterns."""
    fields, patterns = catalog.without_field(fields_of(spark, sf_dir), patterns_of(spark, sf_dir), 3)
    return fields.select(F.lit("field").alias("kind"), "id").union(patterns.select(F.lit("pattern"), "id"))


@query(
    "pattern_edits",
    f"""
    SELECT id, field_id, pattern_type, CASE WHEN id = 6 THEN 'New' ELSE pattern END AS pattern, CASE WHEN id = 6 THEN 1 ELSE priority END AS priority FROM {PATTERNS_SQL} WHERE id <> 5
    UNION ALL SELECT max(id) + 1, 2, 'WholeWord', 'Ward', 100 FROM {PATTERNS_SQL}
    """,
)
def pattern_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pattern deleted, one changed, one added."""
    patterns = catalog.updated(catalog.without_pattern(patterns_of(spark, sf_dir), 5), 6, pattern="New", priority=1)
    return catalog.add_pattern(patterns, 2, "whole_word", "Ward")


@query("preserve_created", f"SELECT max(id) + 1 AS id, 'Keep' AS field_name, '—' AS replace_with, true AS is_preserve, 999 AS priority, 'ConstList' AS pattern_type, 'a b|c' AS pattern FROM {FIELDS_SQL}")
def preserve_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A protected field made of terms."""
    fields, patterns = catalog.add_preserve(fields_of(spark, sf_dir), patterns_of(spark, sf_dir), "Keep", ["a b", "c"])
    own = patterns.select(F.col("field_id").alias("id"), "pattern_type", "pattern")
    return fields.filter("field_name = 'Keep'").join(own, "id").select("id", "field_name", "replace_with", "is_preserve", "priority", "pattern_type", "pattern")


@query("list_extended", f"SELECT id, CASE id WHEN 8 THEN 'ConstList' ELSE pattern_type END AS pattern_type, CASE id WHEN 8 THEN pattern || '|Ward' ELSE pattern END AS pattern, CASE id WHEN 8 THEN 0 ELSE priority END AS priority FROM {PATTERNS_SQL}")
def list_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that ends in bars, and one more term."""
    bars = F.when(F.col("id") == 8, F.concat("pattern", F.lit("||"))).otherwise(F.col("pattern"))
    return catalog.extend_list(patterns_of(spark, sf_dir).withColumn("pattern", bars), 8, " Ward ").drop("field_id")


@query(
    "rule_created",
    f"""
    SELECT max(id) + 1 AS id, 'Code' AS field_name, '{catalog.MASK}' AS replace_with, 'NumberSequence' AS pattern_type, '6' AS pattern, 100 AS pattern_priority FROM {FIELDS_SQL}
    UNION ALL SELECT max(id) + 2, 'Keep', '—', 'WholeWord', 'Ward', 999 FROM {FIELDS_SQL}
    """,
)
def rule_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with their first patterns, one that redacts and a protected one."""
    fields, patterns = catalog.add_rule(fields_of(spark, sf_dir), patterns_of(spark, sf_dir), " Code ", "number_sequence", " 6 ")
    fields, patterns = catalog.add_rule(fields, patterns, "Keep", "WholeWord", "Ward", is_preserve=True)
    own = patterns.select(F.col("field_id").alias("id"), "pattern_type", "pattern", F.col("priority").alias("pattern_priority"))
    return fields.filter("field_name IN ('Code', 'Keep')").select("id", "field_name", "replace_with").join(own, "id")


@query("blank_replacement", f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{catalog.MASK}' WHEN 1 THEN '{catalog.MASK}' ELSE c_name END AS replace_with FROM customer")
def blank_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 3 == 2, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", catalog.replacement(given).alias("replace_with"))


@query(
    "settings_upsert",
    "SELECT r_name AS key, CASE WHEN r_regionkey = 2 THEN 'new' ELSE CAST(r_regionkey AS VARCHAR) END AS value, 'about ' || r_name AS description FROM region UNION ALL SELECT 'zone', 'z', NULL",
)
def settings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value changed, whose description stays, and one added."""
    region = table(spark, sf_dir, "region")
    settings = region.select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"), F.concat(F.lit("about "), "r_name").alias("description"))
    name = region.filter("r_regionkey = 2").first()["r_name"]
    return catalog.upserted(catalog.upserted(settings, name, "new"), "zone", "z")


@query("seeding", "SELECT n_name, CASE WHEN n_regionkey = 1 THEN -1 ELSE n_nationkey END AS n_nationkey FROM nation")
def seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults that are there already are left as they are, however often they are seeded."""
    nation = table(spark, sf_dir, "nation")
    own = nation.filter("n_regionkey = 1").select("n_name", F.lit(-1).alias("n_nationkey"))
    defaults = nation.select("n_name", "n_nationkey")
    return catalog.seeded(catalog.seeded(own, defaults, "n_name"), defaults, "n_name")


@query("client_rekey", "SELECT c_custkey AS id, CASE WHEN c_custkey = 5 THEN sha256('another key') ELSE sha256(c_name) END AS api_key_hash FROM customer")
def client_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("api_key_hash"))
    return catalog.with_new_key(clients, 5, "another key")


# ---- term sets -----------------------------------------------------------------------------------------------------


@query(
    "terms_imported",
    f"""
    SELECT id, pattern FROM {PATTERNS_SQL} UNION ALL
    SELECT (SELECT max(id) + 1 FROM {PATTERNS_SQL}), string_agg(term, chr(10) ORDER BY upper(term))
    FROM (SELECT min(term) AS term FROM (SELECT unnest(['building', 'zeta']) AS term UNION ALL SELECT c_mktsegment FROM customer) GROUP BY lower(term))
    """,
)
def terms_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term file's terms beside those that a field's list has, each once whatever its case."""
    patterns = catalog.add_pattern(patterns_of(spark, sf_dir), 2, "FileList", "building\nzeta")
    new = terms.parse(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")))
    return catalog.import_terms(patterns, 2, new, append=True).select("id", "pattern")


@query("term_search", "SELECT c_name AS term FROM customer WHERE contains(lower(c_name), 'r#00000001') ORDER BY upper(c_name), c_name LIMIT 1000")
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand, which is what the search shows."""
    return terms.search(table(spark, sf_dir, "customer").select(F.col("c_name").alias("term")), "R#00000001")


@query("term_removed", "SELECT c_name AS term FROM customer WHERE lower(c_name) <> (SELECT lower(c_name) FROM customer WHERE c_custkey = 7)")
def term_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return catalog.without_term(customer.select(F.col("c_name").alias("term")), customer.filter("c_custkey = 7").first()["c_name"].upper())


@query("terms_serialised", "SELECT string_agg(term, chr(10) ORDER BY upper(term), term) AS pattern FROM (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS term FROM customer)")
def terms_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(segment.alias("term")).distinct()
    return terms.serialised(rows.unionByName(spark.createDataFrame([("  ",)], "term string")))


# ---- files and recognition -----------------------------------------------------------------------------------------

#: Pages stand for files: names with an extension by turns, contents as long as the page.
EXTENSIONS = (".pdf", ".PNG", ".jpg", ".Jpeg", ".tif", ".tiff", ".bmp", ".txt", ".TXT", ".docx", "")
FILES_SQL = f"(SELECT page_id, 'd.x/f' || page_id || [{', '.join(repr(e) for e in EXTENSIONS)}][page_id % {len(EXTENSIONS)} + 1] AS path, octet_length(encode(html)) AS length FROM pages)"


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*(F.lit(e) for e in EXTENSIONS))
    path = F.concat(F.lit("d.x/f"), F.col("page_id").cast("string"), F.get(endings, (F.col("page_id") % len(EXTENSIONS)).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("length"))


@query(
    "mime_types",
    rf"""
    SELECT page_id, CASE lower(regexp_extract(path, '(\.[^./]+)$', 1)) WHEN '.pdf' THEN 'application/pdf' WHEN '.png' THEN 'image/png' WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg'
    WHEN '.tif' THEN 'image/tiff' WHEN '.tiff' THEN 'image/tiff' WHEN '.bmp' THEN 'image/bmp' WHEN '.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM {FILES_SQL}
    """,
)
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(spark, sf_dir).select("page_id", readers.mime_type(F.col("path")).alias("mime"))


@query("batch_files", f"SELECT path, length FROM {FILES_SQL} WHERE NOT ends_with(lower(path), '.txt') ORDER BY path")
def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a batch, by path; its own results are not among them."""
    files = readers.without_texts(files_of(spark, sf_dir)).withColumn("mime", readers.mime_type(F.col("path")))
    return readers.listing(files).select("path", "length")


@query("embedded_images", f"SELECT path, length FROM {FILES_SQL} WHERE length >= 1024")
def embedded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.worth_recognising(files_of(spark, sf_dir)).select("path", "length")


#: Turns of conversations stand for what recognition passes read, cut to some length by turn.
PASSES = ("conv_id AS doc_id", "turn AS pass", "'  ' || substr(text, 1, CAST(3 + (conv_id * 5 + turn * 11) % 29 AS INTEGER)) AS text")
PASSES_SQL = f"(SELECT {', '.join(PASSES)} FROM conversations)"


def passes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*PASSES)


@query(
    "best_pass",
    f"""
    SELECT doc_id, text FROM (
        SELECT doc_id, trim(text) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY length(trim(text)) > 20 DESC, CASE WHEN length(trim(text)) > 20 THEN -pass ELSE length(trim(text)) END DESC, pass) AS k
        FROM {PASSES_SQL}) WHERE k = 1
    """,
)
def best_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.best_pass(passes_of(spark, sf_dir))


@query("scanned_pages", f"SELECT doc_id, pass AS page, length(trim(text)) < 20 AS is_scan FROM {PASSES_SQL}")
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes_of(spark, sf_dir).select("doc_id", F.col("pass").alias("page"), readers.is_scan(F.col("text")).alias("is_scan"))


@query("engine_chain", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN trim(text) WHEN turn % 3 = 1 THEN trim(role) END AS text FROM conversations")
def engine_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first engine's text that isn't blank: here one that fails, one that reads nothing, or both."""
    first = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, "   ")
    second = F.when(F.col("turn") % 3 == 1, F.col("role")).otherwise("")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", first.alias("first"), second.alias("second"))
    return rows.select("conv_id", "turn", readers.first_text("first", "second").alias("text"))


@query("paged_text", "SELECT conv_id, string_agg('[Page ' || turn || ']' || chr(10) || text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def paged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.paged(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text"), "conv_id")


@query("all_pass_boxes", f"SELECT doc_id, text, x / s AS x, y / s AS y, width / s AS width, height / s AS height FROM (SELECT *, CASE WHEN line % 2 = 1 THEN CAST(2.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS s FROM ({WORD_BOXES}))")
def all_pass_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all passes, those of enlarged images back in the image's own size."""
    scale = F.when(F.col("line") % 2 == 1, 2.5).otherwise(1.0).alias("scale")
    words = F.collect_list(F.struct("text", "x", "y", "width", "height")).alias("words")
    return boxes.all_passes(word_boxes(spark, sf_dir).groupBy("doc_id", "line").agg(words).select("doc_id", scale, "words"))


PIXELS = ("l_orderkey", "CAST(l_partkey * 7 % 256 AS INTEGER) AS r", "CAST(l_suppkey * 11 % 256 AS INTEGER) AS g", "CAST(l_linenumber * 37 % 256 AS INTEGER) AS b")


def dark_sql(r: str, g: str, b: str) -> str:
    low = f"CAST(0.299 AS DOUBLE) * {r} + CAST(0.587 AS DOUBLE) * {g} + CAST(0.114 AS DOUBLE) * {b} < 128"
    return f"SELECT l_orderkey, avg(CASE WHEN {low} THEN 1.0 ELSE 0.0 END) > 0.55 AS dark FROM (SELECT {', '.join(PIXELS)} FROM lineitem) GROUP BY l_orderkey"


@query("dark_images", dark_sql("r", "g", "b"))
def dark_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.is_dark(table(spark, sf_dir, "lineitem").selectExpr(*PIXELS), "l_orderkey")


@query("inverted_images", dark_sql("(255 - r)", "(255 - g)", "(255 - b)"))
def inverted_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.is_dark(boxes.inverted(table(spark, sf_dir, "lineitem").selectExpr(*PIXELS)), "l_orderkey")


# ---- results and the request log -----------------------------------------------------------------------------------

#: One rule that is used, and one that is switched off.
RULES = [Field("number", (Pattern("Regex", NUMBERS),), "<#>"), Field("word", (Pattern("Regex", "[a-z]+"),), "<w>", is_active=False)]
REDACTED_SQL = f"(SELECT doc_id, text, regexp_replace(text, '{NUMBERS}', '<#>', 'g') AS redacted_text, len(regexp_extract_all(text, '{NUMBERS}')) AS n FROM documents)"


@query("redaction_json", f"SELECT doc_id, redacted_text, CAST(n AS BIGINT) AS match_count, CASE WHEN n > 0 THEN 'number' ELSE '' END AS fields FROM {REDACTED_SQL}")
def redaction_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response as JSON, read again; a rule that is switched off has no part in it."""
    body = F.from_json("json", "redactedText string, matchCount long, fieldsHit array<string>")
    rows = as_json(redact(table(spark, sf_dir, "documents").select("doc_id", "text"), RULES)).select("doc_id", body.alias("b"))
    return rows.select("doc_id", F.col("b.redactedText").alias("redacted_text"), F.col("b.matchCount").alias("match_count"), F.array_join("b.fieldsHit", ",").alias("fields"))


def cut_sql(c: str) -> str:
    return f"CASE WHEN length({c}) > 100 THEN substr({c}, 1, 100) || '...' ELSE {c} END"


@query("event_log", f"SELECT doc_id, CAST(n AS BIGINT) AS match_count, CASE WHEN n > 0 THEN 'number' ELSE '' END AS fields, {cut_sql('text')} AS text, {cut_sql('redacted_text')} AS redacted_text FROM {REDACTED_SQL}")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = writers.event(redact(table(spark, sf_dir, "documents").select("doc_id", "text"), RULES), True, 100)
    return rows.withColumn("match_count", F.col("match_count").cast("long"))


@query(
    "request_log",
    """
    SELECT 3 AS client_id, 'f' || o_orderkey || '.txt' AS file_name, CAST(o_custkey * 977 // 1024 AS INTEGER) AS file_size_kb,
           CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '["' || o_orderstatus || '"]' ELSE '["' || o_orderstatus || '","' || o_orderpriority || '"]' END AS fields_hit, CAST(NULL AS VARCHAR) AS error_msg
    FROM orders
    """,
)
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of results: whole kilobytes, the fields hit as JSON, or null where there are none."""
    hit = F.slice(F.array("o_orderstatus", "o_orderpriority"), 1, (F.col("o_orderkey") % 3).cast("int"))
    results = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".txt")).alias("file_name"), (F.col("o_custkey") * 977).alias("length"), hit.alias("fields_hit"))
    return logs.entries(results, 3, F.to_timestamp(F.lit("2024-06-01"))).drop("requested_at")


@query("fields_parsed", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 1 THEN o_orderstatus || ';b' ELSE '' END AS fields FROM orders""")
def fields_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields from their JSON; broken JSON and null give none."""
    text = F.when(F.col("o_orderkey") % 3 == 1, F.to_json(F.array("o_orderstatus", F.lit("b")))).when(F.col("o_orderkey") % 3 == 2, "[broken")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(logs.parsed_fields(text), ";").alias("fields"))


@query("license_admits", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS expiry_date FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT CAST(o_orderdate AS DATE) FROM orders ORDER BY o_orderkey LIMIT 1)")
def license_admits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that still hold, on their last day, too."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("expiry_date"))
    today = rows.orderBy("o_orderkey").first()["expiry_date"]
    return logs.admits(rows, F.lit(today))


@query("license_envelope", "SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS org_name, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 10 END AS quota, CASE WHEN c_custkey % 4 > 0 THEN DATE '2024-06-01' + CAST(c_custkey % 50 AS INTEGER) END AS expiry_date FROM customer")
def license_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences read from their envelopes; from what is no envelope nothing is read."""
    day = F.date_add(F.lit("2024-06-01").cast("date"), (F.col("c_custkey") % 50).cast("int"))
    body = F.to_json(F.struct(F.col("c_name").alias("OrgName"), (F.col("c_custkey") * 10).alias("RequestQuota"), day.cast("string").alias("ExpiryDate")))
    sealed = F.when(F.col("c_custkey") % 4 > 0, F.concat(F.base64(body.cast("binary")), F.lit("."), F.base64(F.lit("seal").cast("binary")))).otherwise(F.lit("no envelope."))
    rows = table(spark, sf_dir, "customer").select("c_custkey", logs.license_of(sealed).alias("l"))
    return rows.select("c_custkey", F.col("l.OrgName").alias("org_name"), F.col("l.RequestQuota").alias("quota"), F.col("l.ExpiryDate").alias("expiry_date"))


# ---- sources and streams ---------------------------------------------------------------------------------------------


@query(
    "extracted_files",
    "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN text END AS text, CASE WHEN doc_id % 3 = 0 THEN 'unsupported type application/octet-stream' END AS error FROM documents",
)
def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files through the extractors of their types; for some there is none."""
    path = F.concat(F.lit("/in/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".zip").otherwise(".TXT"))
    content = F.encode("text", "UTF-8")
    files = table(spark, sf_dir, "documents").select(path.alias("path"), readers.mime_type(path).alias("mime"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return readers.extracted(files).select(file_stem(F.col("path")).cast("long").alias("doc_id"), "text", "error")


@query("term_bytes", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' é' ELSE chr(CAST(1488 + n_nationkey AS INTEGER)) || 'x' END AS term FROM nation")
def term_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in UTF-8 and in windows-1255, told apart by what they hold."""
    hebrew = F.unhex(F.concat(F.hex(F.col("n_nationkey") + 0xE0), F.lit("78")))
    content = F.when(F.col("n_nationkey") % 2 == 0, F.encode(F.concat("n_name", F.lit(" é")), "UTF-8")).otherwise(hebrew)
    return table(spark, sf_dir, "nation").select("n_nationkey", terms.decoded(content).alias("term"))


@query(
    "catalog_loaded",
    f"""
    SELECT field_name, coalesce(string_agg(pattern, ';' ORDER BY p.priority DESC, p.id) FILTER (p.id % 3 > 0), '') AS patterns, count(p.id) FILTER (p.id % 3 > 0) AS n
    FROM {FIELDS_SQL} f LEFT JOIN {PATTERNS_SQL} p ON p.field_id = f.id WHERE is_active AND (client_id IS NULL OR client_id = 2) GROUP BY f.id, field_name
    """,
)
def catalog_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's catalogue as redact() takes it: patterns by priority, those of unknown types left out."""
    patterns = patterns_of(spark, sf_dir).withColumn("pattern_type", F.when(F.col("id") % 3 == 0, "Telepathy").otherwise(F.col("pattern_type")))
    loaded = catalog.load(fields_of(spark, sf_dir), patterns, client_id=2)
    rows = [(f.name, ";".join(p.pattern for p in catalog.ordered_patterns(f.patterns)), len(f.patterns)) for f in loaded]
    return spark.createDataFrame(rows, "field_name string, patterns string, n long")


@query("stream_redacted", ORACLES["redact_text"])
def stream_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents redacted as a stream."""
    out, path = scratch(spark, "redacted"), f"{sf_dir}/documents.parquet"
    # As a pattern: the table may be a file or a folder.
    docs = read_folder(spark, f"{sf_dir}/documents.parque[t]", spark.read.parquet(path).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    rows = redact_stream(docs, common_fields()).select("doc_id", "redacted_text", F.col("match_count").cast("long").alias("match_count"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "redacting")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, redacted_text string, match_count long").parquet(out)


# ---- folders, pictures, versions -------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


@query(
    "batch_results",
    """
    SELECT 'doc-' || doc_id AS stem, CASE WHEN doc_id % 50 > 0 THEN sha256(text) END AS text_sha256, CASE WHEN doc_id % 50 = 0 THEN 'failed' END AS error,
           count(*) FILTER (doc_id % 50 > 0) OVER () AS done, count(*) FILTER (doc_id % 50 = 0) OVER () AS failed
    FROM documents
    """,
)
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's text files, read again, beside what became of each document and the batch's counts."""
    out = scratch(spark, "batch")
    source = F.concat(F.lit("in/doc-"), "doc_id", F.lit(".pdf"))
    rows = table(spark, sf_dir, "documents").select(source.alias("path"), F.col("text").alias("redacted_text"), F.when(F.col("doc_id") % 50 == 0, "failed").alias("error"))
    counted = batch.write_texts(rows, out)
    found = batch.outcomes(spark, out, counted["batch"]).select(file_stem(F.col("path")).alias("stem"), "error")
    return batch.with_texts(found, out).select("stem", F.sha2("text", 256).alias("text_sha256"), "error", F.lit(counted["done"]).cast("long").alias("done"), F.lit(counted["failed"]).cast("long").alias("failed"))


PIXEL = "CAST(l_quantity AS INT) * 5"


@query(
    "masked_images",
    f"""
    WITH p AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) // 16 AS h, {PIXEL} AS v FROM lineitem),
        q AS (SELECT l_suppkey, h, i % 16 AS x, i // 16 AS y, v FROM p WHERE i < h * 16),
        b AS (SELECT DISTINCT l_suppkey, l_orderkey % 14 - 1 AS x0, l_partkey % 40 - 2 AS y0 FROM lineitem WHERE l_linenumber = 6),
        c AS (SELECT DISTINCT l_suppkey, x, y FROM q JOIN b USING (l_suppkey) WHERE x >= x0 AND x < x0 + 4 AND y >= y0 AND y < y0 + 3)
    SELECT l_suppkey, CAST(16 AS BIGINT) AS width, max(h) AS height, CAST(sum(3 * v) AS BIGINT) AS total, CAST(coalesce(sum(3 * v) FILTER (c.x IS NULL), 0) AS BIGINT) AS masked_total,
           CAST(sum(3 * (255 - v)) AS BIGINT) AS inverted_total, avg(CASE WHEN v < 128 THEN 1.0 ELSE 0.0 END) > 0.55 AS dark
    FROM q LEFT JOIN c USING (l_suppkey, x, y) GROUP BY l_suppkey
    """,
)
def masked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of a supplier's quantities as PNG: boxes painted, darkness measured, colours inverted, all decoded again."""
    lines = table(spark, sf_dir, "lineitem")
    pixels = F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity", F.expr(PIXEL).alias("v")))), lambda p: p["v"])
    pictures = lines.groupBy("l_suppkey").agg(images.from_pixels(pixels, F.lit(16)).alias("content"))
    left, top = F.col("l_orderkey") % 14 - 1, F.col("l_partkey") % 40 - 2
    boxes = lines.filter("l_linenumber = 6").select("l_suppkey", left.alias("left"), top.alias("top"), (left + 3.5).alias("right"), (top + 3).alias("bottom"))
    whole = pictures.select("l_suppkey", images.measured("content").alias("m"), images.is_dark(F.col("content")).alias("dark"), images.measured(images.inverted("content")).alias("i"))
    masked = images.painted(pictures, boxes, "l_suppkey").select("l_suppkey", images.measured("content").alias("k"))
    return whole.join(masked, "l_suppkey").select("l_suppkey", "m.width", "m.height", "m.total", F.col("k.total").alias("masked_total"), F.col("i.total").alias("inverted_total"), "dark")


@query(
    "catalog_versions",
    """
    SELECT version, fields, patterns, protected, priorities FROM (VALUES (1, 0, 0, NULL, NULL), (2, 0, 0, 0, NULL), (3, 0, 0, 0, 0)) AS v(version, fields, patterns, protected, priorities)
    UNION ALL SELECT 4, (SELECT count(*) FROM nation), 0, (SELECT count(*) FILTER (n_nationkey % 5 = 0) FROM nation), (SELECT CAST(sum(n_nationkey * 7 % 30) AS BIGINT) FROM nation)
    UNION ALL SELECT 5, (SELECT count(*) FROM nation), (SELECT count(*) FROM supplier), (SELECT count(*) FILTER (n_nationkey % 5 = 0) FROM nation), (SELECT CAST(sum(n_nationkey * 7 % 30) AS BIGINT) FROM nation)
    UNION ALL SELECT 6, (SELECT count(*) - 1 FROM nation), (SELECT count(*) FROM supplier WHERE s_nationkey <> 2), (SELECT count(*) FILTER (n_nationkey % 5 = 0 AND n_nationkey <> 2) FROM nation), (SELECT CAST(sum(n_nationkey * 7 % 30) AS BIGINT) FROM nation WHERE n_nationkey <> 2)
    """,
)
def catalog_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored catalogue's versions: three migrations, fields, patterns, and a field deleted with its patterns."""
    store = Store(spark, scratch(spark, "catalogue"))
    store.migrate(catalogue_migrations(spark))
    store.migrate(catalogue_migrations(spark))  # has nothing left to do
    store.update(lambda tables: {"fields": fields_of(spark, sf_dir)})
    store.update(lambda tables: {"patterns": patterns_of(spark, sf_dir)})
    store.update(lambda tables: dict(zip(("fields", "patterns"), catalog.without_field(tables["fields"], tables["patterns"], 3))))
    rows = []
    for version in range(1, store.version() + 1):
        tables = store.read(version)
        fields, columns = tables["fields"], tables["fields"].columns
        counted = fields.agg(
            F.count("*").alias("fields"),
            F.count_if("is_preserve").alias("protected") if "is_preserve" in columns else F.lit(None).cast("long").alias("protected"),
            F.coalesce(F.sum("priority"), F.lit(0)).alias("priorities") if "priority" in columns else F.lit(None).cast("long").alias("priorities"),
        )
        rows.append(counted.crossJoin(tables["patterns"].agg(F.count("*").alias("patterns"))).select(F.lit(version).alias("version"), "fields", "patterns", "protected", "priorities"))  # one row each
    return reduce(DataFrame.unionByName, rows)


@query("log_days", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def log_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log kept by day after its retention: old days' folders are gone, the others as they were written."""
    events, path = table(spark, sf_dir, "events"), scratch(spark, "log")
    writers.append_log(events, path, "ts")
    last = events.agg(F.max("ts").cast("date").alias("d")).first()["d"]
    writers.drop_days(spark, path, last - timedelta(days=7))
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"))


@query("quota_stream", "SELECT user_id AS client, count(*) AS used FROM events GROUP BY user_id")
def quota_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests counted as they are logged, in two sittings of one stream."""
    events, log, checkpoint = table(spark, sf_dir, "events"), scratch(spark, "log"), scratch(spark, "counts")
    store = Store(spark, scratch(spark, "quota"))
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(log)
        stream = spark.readStream.schema(events.schema).parquet(log)
        count_requests(stream, store, checkpoint, "user_id").awaitTermination()
    return store.read()["quota"]
