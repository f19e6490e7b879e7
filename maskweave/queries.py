"""The registered queries over the reference's own operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import table_functions
from .functions.kernels import hits
from .functions.text import direction, escape_html, extension, file_size, hash_key, normalise, size_kb, stem, truncate
from .operators import boxes, logs
from .operators.patterns import find, occurrences
from .operators.spans import candidates_outside, fields_hit, ordered, outside, splice, stamped, without_overlaps
from .operators.term_file import build
from .operators.term_list import MOST_WORDS, dictionary, term_hits
from .plans import catalog
from .plans.builtin import builtin, named
from .plans.catalog import Field, Pattern, ordered_patterns
from .plans.redact import highlighted, redact, with_matches
from .sources.readers import response
from .sources.tables import spread
from .sources.terms import parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those of texts, whose queries cost far more than a small shuffle, by way of spread()."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages", "conversations") else rows


# ---- pattern types -------------------------------------------------------------------------------------------------

EMAIL, IP, VISA, BIC = (named(name)[0].patterns[k].pattern for name, k in (("Email", 0), ("IP", 0), ("Credit Card", 0), ("IBAN", 2)))
#: SQL's regular expressions know neither look-around nor a Unicode \b: words are listed, or what parts them is matched, too.
WORDS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}_]+')"
EDGE = r"(?:^|[^\p{L}\p{M}\p{Nd}_])"


def listed(hits_sql: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, len(v) AS n, array_to_string(v, '|') AS found FROM (SELECT {key}, {hits_sql} AS v FROM {source})"


def pattern_query(name: str, pattern_type: str, pattern: str, sql: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    """One row per row of the table: how many hits the pattern has, and the hits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = F.transform(find(text, pattern_type, pattern), lambda h: h["value"])
        rows = table(spark, sf_dir, source).select(key, found.alias("v"))
        return rows.select(key, F.size("v").cast("long").alias("n"), F.array_join("v", "|").alias("found"))

    query(name, listed(sql, source, key))(run)


pattern_query("regex_email", "Regex", EMAIL, f"regexp_extract_all(text, '{EMAIL}', 0, 'i')")
pattern_query("regex_ip", "Regex", IP, f"regexp_extract_all(text, '{IP}', 0, 'i')")
pattern_query("regex_card", "Regex", VISA, f"regexp_extract_all(text, '{VISA}', 0, 'i')")
pattern_query("regex_bic", "Regex", BIC, rf"list_filter({WORDS}, lambda w: regexp_full_match(w, '(?i)[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?'))")
pattern_query("whole_word", "WholeWord", " the ", f"list_filter({WORDS}, lambda w: lower(w) = 'the')")
pattern_query("like_prefix", "Like", "tion*", rf"regexp_extract_all(text, '(?i){EDGE}(tion[^\n]*)', 1)")
pattern_query("like_any", "Like", "*@mail?.example.com", rf"regexp_extract_all(text, '(?i)([^\n]*@mail[^\n]\.example\.com)(?:$|[^\p{{L}}\p{{M}}\p{{Nd}}_])', 1)")
pattern_query("begins_with", "BeginsWith", "wh", rf"regexp_extract_all(text, '(?i){EDGE}(wh\S*)', 1)")
pattern_query("ends_with", "EndsWith", "tion", r"regexp_extract_all(text, '(?i)(\S*tion)(?:$|[^\p{L}\p{M}\p{Nd}_])', 1)")
pattern_query("after_label", "AfterLabel", "Licensed under the", r"regexp_extract_all(text, '(?i)Licensed under the[ \t]*([^\r\n]+)', 1)")
pattern_query("after_label_words", "AfterLabel", "Licensed under|3", r"regexp_extract_all(text, '(?i)Licensed under[ \t]*(\S+(?:[ \t]+\S+){0,2})', 1)")
pattern_query("between_markers", "BetweenMarkers", 'token = " | "', """regexp_extract_all(text, '(?i)token = "(.+?)"', 1)""")
pattern_query("between_tags", "BetweenMarkers", "<title> | </title>", "regexp_extract_all(html, '(?i)<title>(.+?)</title>', 1)", "pages", "page_id", "html")
pattern_query("number_sequence", "NumberSequence", "16", r"list_filter(regexp_extract_all(text, '\p{Nd}+'), lambda d: length(d) = 16)")
pattern_query("number_range", "NumberSequence", "7,10", r"list_filter(regexp_extract_all(text, '\p{Nd}+'), lambda d: length(d) BETWEEN 7 AND 10)")
pattern_query("llm_prompt", "LlmPrompt", "find names", "CAST([] AS VARCHAR[])")


@query(
    "const_list",
    r"""
    SELECT doc_id, len(w) AS n,
           len(list_filter(w, lambda x: x = 'the')) AS n_the, len(list_filter(w, lambda x: x = 'of')) AS n_of, len(list_filter(w, lambda x: x = 'and')) AS n_and
    FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda x: lower(x)), lambda x: x IN ('the', 'of', 'and')) AS w FROM documents)
    """,
)
def const_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(find("text", "ConstList", "the| of |and|"), lambda h: F.lower(h["value"]))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("w"))

    def n(word: str) -> Column:
        return F.size(F.filter("w", lambda x: x == word)).cast("long").alias(f"n_{word}")

    return rows.select("doc_id", F.size("w").cast("long").alias("n"), *map(n, ("the", "of", "and")))


@query(
    "whole_line",
    """
    SELECT doc_id, len(v) AS n, array_to_string(v, '|') AS found
    FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'license')) AS v FROM documents)
    """,
)
def whole_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(find("text", "WholeLine", "license"), lambda h: F.regexp_replace(h["value"], "\\n$", ""))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("n"), F.array_join("v", "|").alias("found"))


@query(
    "file_list",
    r"""
    WITH d AS (SELECT DISTINCT lower(w) AS norm FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{Nd}]+')) AS w FROM benchmark) WHERE length(w) > 6),
         t AS (SELECT doc_id, trim(lower(regexp_replace(w, '[^\p{L}\p{N}]+', ' ', 'g'))) AS norm
               FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{Nd}-]+')) AS w FROM documents))
    SELECT doc_id, coalesce(n, 0) AS n, coalesce(n_terms, 0) AS n_terms
    FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT norm) AS n_terms FROM t SEMI JOIN d USING (norm) GROUP BY doc_id) USING (doc_id)
    """,
)
def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    terms = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("term")).filter(F.length("term") > 6)
    docs = table(spark, sf_dir, "documents")
    found = term_hits(docs, dictionary(terms))
    distinct = F.array_distinct(F.transform("hits", lambda h: normalise(h["value"])))
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.size(distinct), F.lit(0)).cast("long").alias("n_terms"))


@query(
    "file_list_words",
    r"""
    WITH RECURSIVE b AS (SELECT list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) AS w FROM benchmark),
        d AS (SELECT DISTINCT array_to_string(w[i:i + 1 + i % 5], ' ') AS norm FROM (SELECT w, unnest(range(1, len(w) - 4)) AS i FROM b)),
        t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{Nd}-]+'), lambda x: trim(lower(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g')))) AS w FROM documents),
        g AS (SELECT doc_id, i, width, array_to_string(list_filter(w[i:i + width - 1], lambda x: x <> ''), ' ') AS norm
              FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), range(1, 7) r(width) WHERE i + width - 1 <= len(w)),
        c AS (SELECT doc_id, i, width FROM g SEMI JOIN d USING (norm)),
        o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, width DESC) AS k FROM c),
        r AS (SELECT doc_id, k, width, i + width AS free, true AS taken FROM o WHERE k = 1
              UNION ALL
              SELECT o.doc_id, o.k, o.width, CASE WHEN o.i >= r.free THEN o.i + o.width ELSE r.free END, o.i >= r.free FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
    SELECT doc_id, count(*) AS n, CAST(sum(width) AS BIGINT) AS n_words, CAST(max(width) AS BIGINT) AS widest FROM r WHERE taken GROUP BY doc_id
    """,
)
def file_list_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of two to six words, from blocks in files, as dictionaries of any size have them."""
    words = F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), F.lower)
    runs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 5, F.lit(0))), lambda _, i: F.array_join(F.slice("w", i + 1, 2 + (i + 1) % 5), " "))
    terms = table(spark, sf_dir, "benchmark").select(words.alias("w")).select(F.explode(runs).alias("term"))
    found = term_hits(table(spark, sf_dir, "documents"), build(dictionary(terms), MOST_WORDS, broadcast_bytes=0))
    sizes = F.transform("hits", lambda h: F.size(F.split(h["value"], " ")))
    return found.select("doc_id", F.size("hits").cast("long").alias("n"), F.aggregate(sizes, F.lit(0), lambda a, x: a + x).cast("long").alias("n_words"), F.array_max(sizes).cast("long").alias("widest"))


# ---- spans ---------------------------------------------------------------------------------------------------------


def span_sql(pattern: str, source: str = "documents") -> str:
    """(doc_id, start, length, value) of a pattern's matches: lengths of the pieces between and before them, summed."""
    return rf"""
        SELECT doc_id, v[i] AS value, length(v[i]) AS length,
               CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
        FROM (SELECT doc_id, v, g, unnest(range(1, len(v) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS v, string_split_regex(text, '{pattern}') AS g FROM {source}))
    """


def span_rows(docs: DataFrame, found: Column) -> DataFrame:
    rows = docs.select("doc_id", F.inline(found))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "value")


@query("spans_positions", f"SELECT doc_id, start, length, value FROM ({span_sql('(?i)' + EMAIL)})")
def spans_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_rows(table(spark, sf_dir, "documents"), find("text", "Regex", EMAIL))


@query("spans_lateral", f"SELECT doc_id, start, length, value FROM ({span_sql('(?i)' + EMAIL)})")
def spans_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in SQL, by the table function."""
    table_functions.register(spark)
    pattern = EMAIL.replace("{", "{{").replace("}", "}}")
    return spark.sql(f"SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, value FROM {{docs}}, LATERAL find_spans(text, 'Regex', r'{pattern}')", docs=table(spark, sf_dir, "documents"))


NUMBERS, TOKENS = "[0-9]{3,}", "[0-9A-Za-z]*[0-9][0-9A-Za-z]*"
ZONE = 'token = "[0-9a-f]+"'


@query(
    "preserve_antijoin",
    f"""
    WITH c AS ({span_sql(NUMBERS)}), z AS ({span_sql("(?i)" + ZONE)})
    SELECT doc_id, start, length, value FROM c
    WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = c.doc_id AND c.start < z.start + z.length AND c.start + c.length > z.start)
    """,
)
def preserve_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return candidates_outside(span_rows(docs, find("text", "Regex", NUMBERS)), span_rows(docs, find("text", "Regex", ZONE)))


@query(
    "preserve_zones",
    f"""
    WITH c AS ({span_sql(NUMBERS)}), z AS ({span_sql("(?i)" + ZONE)})
    SELECT doc_id, count(c.start) AS n, CAST(coalesce(sum(c.length), 0) AS BIGINT) AS covered
    FROM documents LEFT JOIN (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.doc_id = c.doc_id AND c.start < z.start + z.length AND c.start + c.length > z.start)) c USING (doc_id)
    GROUP BY doc_id
    """,
)
def preserve_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = outside(find("text", "Regex", NUMBERS), find("text", "Regex", ZONE))
    rows = table(spark, sf_dir, "documents").select("doc_id", kept.alias("m"))
    covered = F.aggregate("m", F.lit(0).cast("long"), lambda acc, m: acc + m["length"])
    return rows.select("doc_id", F.size("m").cast("long").alias("n"), covered.alias("covered"))


@query(
    "dedupe_overlaps",
    f"""
    WITH RECURSIVE c AS (SELECT doc_id, start, length, 0 AS ord FROM ({span_sql(NUMBERS)}) UNION ALL SELECT doc_id, start, length, 1 FROM ({span_sql("(?i)" + TOKENS)})),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, length DESC, ord) AS k FROM c),
        r AS (SELECT doc_id, k, ord, start, length, start + length AS last, true AS taken FROM o WHERE k = 1
              UNION ALL
              SELECT o.doc_id, o.k, o.ord, o.start, o.length, CASE WHEN o.start >= r.last THEN o.start + o.length ELSE r.last END, o.start >= r.last
              FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
    SELECT doc_id, start, length, CAST(ord AS BIGINT) AS ord FROM r WHERE taken
    """,
)
def dedupe_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(stamped(find("text", "Regex", NUMBERS), "number", "#", 0), stamped(find("text", "Regex", TOKENS), "token", "#", 1))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(without_overlaps(ordered(both))))
    return rows.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("start", "length", "ord")))


def common_fields() -> list[Field]:
    return [*named("Email"), Field("Card", (Pattern("Regex", VISA),), "[CARD]"), *named("IP")]


REDACTED = rf"regexp_replace(regexp_replace(regexp_replace(text, '(?i){EMAIL}', '[email]', 'g'), '{VISA}', '[CARD]', 'g'), '{IP}', '[IP]', 'g')"


@query("redact_text", rf"SELECT doc_id, {REDACTED} AS redacted_text, len(regexp_extract_all(text, '(?i){EMAIL}')) + len(regexp_extract_all(text, '{VISA}')) + len(regexp_extract_all(text, '{IP}')) AS match_count FROM documents")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact(table(spark, sf_dir, "documents"), common_fields())
    return out.select("doc_id", "redacted_text", F.col("match_count").cast("long").alias("match_count"))


@query(
    "fields_hit",
    rf"""
    SELECT doc_id, array_to_string(list_filter([
        CASE WHEN regexp_matches(text, '{VISA}') THEN 'Card' END, CASE WHEN regexp_matches(text, '(?i){EMAIL}') THEN 'Email Address' END,
        CASE WHEN regexp_matches(text, '{IP}') THEN 'IP Address' END], lambda x: x IS NOT NULL), '|') AS fields
    FROM documents
    """,
)
def fields_hit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_matches(table(spark, sf_dir, "documents"), common_fields())
    return out.select("doc_id", F.array_join(F.sort_array(fields_hit(F.col("matches"))), "|").alias("fields"))


def builtin_sql() -> str:
    """The built-in catalogue as SQL: candidates of all patterns, from the left the longest that are free, and the text put together again.

    SQL's \\b knows ASCII only, so patterns are sought in a copy whose other letters are underscores: word characters, too, that no pattern names.
    """
    found, place = [], 0
    for f in builtin():
        for p in ordered_patterns(f.patterns):
            spans = span_sql("(?i)" + p.pattern, "a") if p.pattern_type == "Regex" else span_sql(r"[\p{L}\p{Nd}]+") + f" WHERE v[i] IN ({', '.join(repr(t) for t in p.pattern.split('|') if ' ' not in t)})"
            found.append(f"SELECT doc_id, start, length, {place} AS ord, '{f.name}' AS field, '{f.replace_with}' AS repl FROM ({spans})")
            place += 1
    return rf"""
        WITH RECURSIVE a AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', '_', 'g') AS text FROM documents),
            c AS MATERIALIZED ({" UNION ALL ".join(found)}),
            o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, length DESC, ord) AS k FROM c),
            r AS (SELECT doc_id, k, start, length, field, repl, start + length AS last, true AS taken FROM o WHERE k = 1
                  UNION ALL
                  SELECT o.doc_id, o.k, o.start, o.length, o.field, o.repl, CASE WHEN o.start >= r.last THEN o.start + o.length ELSE r.last END, o.start >= r.last
                  FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1),
            m AS (SELECT *, lag(start + length, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM r WHERE taken),
            t AS (SELECT doc_id, string_agg(substring(text, before + 1, start - before) || repl, '' ORDER BY start) AS head, max(start + length) AS last, count(*) AS n FROM m JOIN documents USING (doc_id) GROUP BY doc_id),
            h AS (SELECT doc_id, string_agg(field, '|' ORDER BY first) AS fields FROM (SELECT doc_id, field, min(start) AS first FROM m GROUP BY ALL) GROUP BY doc_id)
        SELECT doc_id, coalesce(head || substring(text, last + 1), text) AS redacted_text, coalesce(n, 0) AS match_count, coalesce(fields, '') AS fields
        FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN h USING (doc_id)
    """


@query("redact_builtin", builtin_sql())
def redact_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole built-in catalogue."""
    out = redact(table(spark, sf_dir, "documents"), builtin())
    return out.select("doc_id", "redacted_text", F.col("match_count").cast("long").alias("match_count"), F.array_join("fields_hit", "|").alias("fields"))


@query("html_highlight", rf"SELECT doc_id, regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '((?i){EMAIL})', '<mark>\1</mark>', 'g') AS marked FROM documents".replace('\\"', '"'))
def html_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_matches(table(spark, sf_dir, "documents"), named("Email"))
    return out.select("doc_id", highlighted(F.col("text"), F.col("matches")).alias("marked"))


# ---- catalogue -----------------------------------------------------------------------------------------------------

# Catalogues are made from tables: fields from nation, patterns from supplier, by expressions that are the same in both dialects.

FIELD_COLUMNS = (
    "CAST(n_nationkey + 1 AS INTEGER) AS id", "CASE WHEN n_regionkey > 0 THEN n_regionkey END AS client_id", "n_name AS field_name", "'[' || n_name || ']' AS replace_with",
    "n_nationkey % 4 <> 0 AS is_active", "n_nationkey % 5 = 0 AS is_preserve", "CAST(n_nationkey * 7 % 30 AS INTEGER) AS priority",
)
PATTERN_COLUMNS = (
    "CAST(s_suppkey AS INTEGER) AS id", "CAST(s_nationkey + 1 AS INTEGER) AS field_id", "CASE WHEN s_suppkey % 2 = 0 THEN 'WholeWord' ELSE 'ConstList' END AS pattern_type",
    "s_name AS pattern", "CAST(s_suppkey % 100 AS INTEGER) AS priority",
)
FIELDS_SQL = f"(SELECT {', '.join(FIELD_COLUMNS)} FROM nation)"
PATTERNS_SQL = f"(SELECT {', '.join(PATTERN_COLUMNS)} FROM supplier)"


def fields_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(*FIELD_COLUMNS)


def patterns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*PATTERN_COLUMNS)


def catalogue_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fields_of(spark, sf_dir), patterns_of(spark, sf_dir)


@query("catalog_join", f"SELECT f.id, f.field_name, count(p.id) AS n_patterns, coalesce(string_agg(p.pattern, ';' ORDER BY p.id), '') AS patterns FROM {FIELDS_SQL} f LEFT JOIN {PATTERNS_SQL} p ON p.field_id = f.id GROUP BY ALL")
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.with_patterns(*catalogue_of(spark, sf_dir))
    return rows.select("id", "field_name", F.size("patterns").cast("long").alias("n_patterns"), F.array_join(F.transform("patterns", lambda p: p["pattern"]), ";").alias("patterns"))


@query(
    "effective_priority",
    f"""
    SELECT id, field_name, effective_priority, row_number() OVER (ORDER BY effective_priority DESC, priority DESC, field_name) AS place
    FROM (SELECT f.id, f.field_name, f.priority, greatest(f.priority, coalesce(max(p.priority), 0)) AS effective_priority FROM {FIELDS_SQL} f LEFT JOIN {PATTERNS_SQL} p ON p.field_id = f.id GROUP BY f.id, f.field_name, f.priority)
    """,
)
def effective_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.effective_priority(*catalogue_of(spark, sf_dir)).select("id", "field_name", "effective_priority", "place")


@query("tenant_filter", f"SELECT c.client, f.id, f.field_name FROM {FIELDS_SQL} f, (VALUES (0), (1), (3), (9)) AS c(client) WHERE is_active AND (client_id IS NULL OR client_id = client)")
def tenant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients see: 0 stands for none, 9 has no fields of its own."""
    fields = fields_of(spark, sf_dir)
    return reduce(DataFrame.union, [catalog.for_client(fields, c or None).select(F.lit(c).alias("client"), "id", "field_name") for c in (0, 1, 3, 9)])


@query(
    "term_merge",
    "SELECT min(term) AS term FROM (SELECT unnest(string_split(text, ' ')) AS term FROM benchmark UNION ALL SELECT c_name FROM customer) WHERE trim(term) <> '' GROUP BY lower(term)",
)
def term_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("term"))
    return catalog.merged_terms(words, table(spark, sf_dir, "customer").select(F.col("c_name").alias("term")))


#: Lists of terms that repeat in other cases, with blank ones among them.
LISTED = "pattern || '| Ward ' || priority % 3 || '||WARD ' || priority % 3"


@query(
    "group_all",
    f"""
    SELECT field_id, string_agg(term, '|' ORDER BY k) AS pattern, 999 AS priority
    FROM (SELECT field_id, lower(term) AS k, min(term) AS term FROM (SELECT field_id, trim(unnest(string_split({LISTED}, '|'))) AS term FROM {PATTERNS_SQL}) WHERE term <> '' GROUP BY ALL)
    GROUP BY field_id
    """,
)
def group_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = patterns_of(spark, sf_dir).withColumn("pattern", F.expr(LISTED))
    return catalog.consolidated(patterns).select("field_id", "pattern", "priority")


@query("pattern_by_id", f"SELECT p.id, f.field_name, p.pattern FROM {PATTERNS_SQL} p JOIN {FIELDS_SQL} f ON f.id = p.field_id WHERE p.id = 4")
def pattern_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.pattern_by_id(*catalogue_of(spark, sf_dir), 4).select("id", "field_name", "pattern")


@query("fields_by_kind", "SELECT count(*) AS n_all, count(*) FILTER (o_orderstatus = 'F') AS n_preserve, count(*) FILTER (o_orderstatus <> 'F') AS n_redact FROM orders")
def fields_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.by_kind(table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("is_preserve")))


@query(
    "append_value",
    f"""
    WITH p AS {PATTERNS_SQL},
        own AS (SELECT *, row_number() OVER (ORDER BY priority DESC, id) = 1 AS here FROM p WHERE pattern_type = 'ConstList' AND field_id = (SELECT max(field_id) FROM p WHERE pattern_type = 'ConstList'))
    SELECT id, pattern, priority FROM p WHERE id NOT IN (SELECT id FROM own WHERE here)
    UNION ALL SELECT id, pattern || '|Ward D', priority FROM own WHERE here
    UNION ALL SELECT max(id) + 1, 'y', 999 FROM p
    """,
)
def append_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term for a field's list, the same in another case, and one for a field without a list."""
    patterns = patterns_of(spark, sf_dir)
    field = patterns.filter("pattern_type = 'ConstList'").agg(F.max("field_id")).first()[0]
    longer = catalog.append_value(catalog.append_value(patterns, field, " Ward D "), field, "WARD D")
    return catalog.append_value(longer, 99, "y").select("id", "pattern", "priority")


@query("clients_latest", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC")
def clients_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.clients_latest(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_name")


@query("settings_by_key", "SELECT n_name AS key, n_nationkey AS value FROM nation ORDER BY key")
def settings_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.settings_by_key(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("value")))


@query("batch_outcomes", "SELECT count(*) FILTER (o_orderstatus <> 'F') AS done, count(*) FILTER (o_orderstatus = 'F') AS failed, CASE WHEN bool_or(o_orderstatus = 'F') THEN 2 ELSE 0 END AS exit_code FROM orders")
def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.outcomes(table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "failed").alias("error")))


@query("extraction_response", r"SELECT doc_id, text, length(text) AS char_count, 'text' AS extractor_used FROM documents WHERE regexp_matches(text, '\S')")
def extraction_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query("text_search", listed("regexp_extract_all(text, 'the', 0, 'i')"))
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of a text that is searched for, whatever its case."""
    found = F.transform(occurrences(F.col("text"), "the"), lambda h: h["value"])
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("n"), F.array_join("v", "|").alias("found"))


#: Lines of a term file, of every form, from names.
LINES = (
    "CASE c_custkey % 9 WHEN 0 THEN '# ' || c_name WHEN 1 THEN '(' || c_name || ')' WHEN 2 THEN '[O`' || c_name || ' x]' WHEN 3 THEN c_name || '|' || c_mktsegment || ' | q'"
    " WHEN 4 THEN c_name || '   ' || c_mktsegment WHEN 5 THEN '  ' WHEN 6 THEN upper(c_name) || '  a  b' WHEN 7 THEN lower(c_mktsegment) ELSE 'z' END"
)


@query(
    "term_parse",
    r"""
    WITH l AS (SELECT trim(line) AS line FROM (SELECT LINES AS line FROM customer)),
        p AS (SELECT unnest(CASE WHEN regexp_matches(line, '\S\s{2,}\S') THEN regexp_split_to_array(line, '\s{2,}') WHEN contains(line, '|') THEN string_split(line, '|') ELSE [line] END) AS part FROM l WHERE line <> '' AND NOT starts_with(line, '#')),
        c AS (SELECT trim(regexp_replace(regexp_replace(trim(part), '^[(\[](.*)[)\]]$', '\1'), '`', '', 'g')) AS term FROM p)
    SELECT min(term) AS term FROM c WHERE length(term) > 1 GROUP BY lower(term)
    """.replace("LINES", LINES),
)
def term_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(table(spark, sf_dir, "customer").select(F.expr(LINES).alias("value")))


# ---- request log ---------------------------------------------------------------------------------------------------


@query("log_recent_page", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def log_recent_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.page(table(spark, sf_dir, "events"), 3, "event_id").select("event_id", "user_id", "event_type")


@query("log_retention", "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts)::DATE FROM events) - INTERVAL 1 MONTH")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").cast("date").alias("d")).first()["d"]
    return logs.within_retention(events, F.lit(last), 1, "ts").select("event_id", "user_id")


@query("log_count", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def log_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("page_count", "SELECT greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM events")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.page_count(table(spark, sf_dir, "events"))


@query("quota_used", "SELECT user_id, count(*) AS used, count(*) >= 25 AS refused FROM events GROUP BY user_id")
def quota_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.quota_state(logs.quota_used(table(spark, sf_dir, "events"), "user_id"), 25)


@query("size_kb", "SELECT doc_id, n_chars // 1024 AS kb, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{:.1f} KB', round(n_chars / 1024.0, 1)) ELSE format('{:.1f} MB', round(n_chars / 1048576.0, 1)) END AS shown FROM documents")
def size_kb_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", size_kb(n).alias("kb"), file_size(n).alias("shown"))


@query("hash_sha256", "SELECT c_custkey, sha256(c_name) AS key_hash FROM customer")
def hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hash_key(F.col("c_name")).alias("key_hash"))


@query("key_lookup", "SELECT o_orderkey, c_custkey AS client_id, c_name AS name FROM orders JOIN customer ON sha256(CAST(o_custkey AS VARCHAR)) = sha256(CAST(c_custkey AS VARCHAR)) WHERE c_acctbal >= 0")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("api_key_hash"), (F.col("c_acctbal") >= 0).alias("is_active"))
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("api_key"))
    return logs.by_key(requests, clients)


#: Licences that end on days around this one, or on none.
TODAY = "1996-06-01"
EXPIRY = "CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END"


@query(
    "license_health",
    f"""
    SELECT org_name, CASE WHEN d IS NULL THEN 'missing' WHEN d <= 0 THEN 'expired' WHEN d <= 30 THEN 'expiring_soon' ELSE 'ok' END AS status, d AS days_left
    FROM (SELECT o_orderkey AS org_name, CAST(date_diff('day', DATE '{TODAY}', {EXPIRY}) AS INTEGER) AS d FROM orders)
    """,
)
def license_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    licenses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("org_name"), F.expr(EXPIRY).alias("expiry_date"))
    return logs.license_health(licenses, F.to_date(F.lit(TODAY))).select("org_name", "status", "days_left")


@query("dashboard_totals", "SELECT (SELECT count(*) FROM events) AS requests, (SELECT count(*) FROM nation) AS fields, (SELECT count(*) FROM supplier) AS patterns, (SELECT count(*) FROM customer) AS clients")
def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.totals(table(spark, sf_dir, "events"), *catalogue_of(spark, sf_dir), table(spark, sf_dir, "customer"))


# ---- text functions ------------------------------------------------------------------------------------------------


@query("dir_detect", r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\x{0590}-\x{05FF}]', '', 'g')) > 0.12 * greatest(length(text), 1) THEN 'rtl' ELSE 'ltr' END AS direction FROM documents")
def dir_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", direction(F.col("text")).alias("direction"))


@query("term_normalise", r"SELECT doc_id, trim(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g'))) AS norm FROM documents")
def term_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", normalise(F.col("text")).alias("norm"))


@query("truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS short FROM documents")
def truncate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", truncate(F.col("text"), 200).alias("short"))


@query("file_names", r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem, lower(regexp_extract(url, '(\.[^./\\]+)$', 1)) AS extension FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", stem(F.col("url")).alias("stem"), extension(F.col("url")).alias("extension"))


@query("escape_html", """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def escape_html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", escape_html(F.col("html")).alias("escaped"))


# ---- boxes ---------------------------------------------------------------------------------------------------------

#: Words of conversations stand for recognised words: a turn is a line, 10 units high; a character is 6 wide.
WORD_BOXES = """
    SELECT conv_id AS doc_id, turn AS line, i AS word, w[i] AS text, i * 50.0 AS x, turn * 12.0 AS y, length(w[i]) * 6.0 AS width, 10.0 AS height
    FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))
"""
OFFSETS = f"""
    SELECT *, start AS char_start, start + length(text) AS char_end
    FROM (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({WORD_BOXES}))
"""


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), F.posexplode(F.split("text", " ")).alias("i", "text"))
    word = (F.col("i") + 1).cast("long")
    return rows.select("doc_id", "line", word.alias("word"), "text", (word * 50.0).alias("x"), (F.col("line") * 12.0).alias("y"), (F.length("text") * 6.0).alias("width"), F.lit(10.0).alias("height"))


@query("ocr_offsets", f"SELECT doc_id, line, word, char_start, char_end FROM ({OFFSETS})")
def ocr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes.word_offsets(word_boxes(spark, sf_dir))
    return rows.select("doc_id", "line", "word", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query("all_text_boxes", f"SELECT doc_id, line, word, greatest(x - 5, 0) AS l, greatest(y - 5, 0) AS t, least(x + width + 5, 640) AS r, least(y + height + 5, 480) AS b FROM ({WORD_BOXES}) WHERE least(x + width + 5, 640) > greatest(x - 5, 0) AND least(y + height + 5, 480) > greatest(y - 5, 0)")
def all_text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes.clamped(boxes.masks(word_boxes(spark, sf_dir)), 640, 480)
    return rows.select("doc_id", "line", "word", F.col("left").alias("l"), F.col("top").alias("t"), F.col("right").alias("r"), F.col("bottom").alias("b"))


@query(
    "box_union",
    f"""
    WITH w AS ({OFFSETS}), s AS (SELECT doc_id, min(char_start) + 3 AS start, max(char_end) - min(char_start) - 10 AS length FROM w GROUP BY doc_id, line HAVING max(char_end) - min(char_start) > 10)
    SELECT s.doc_id, s.start, s.length, min(x) - 5 AS l, min(y) - 5 AS t, max(x + width) + 5 AS r, max(y + height) + 5 AS b
    FROM s JOIN w ON s.doc_id = w.doc_id AND w.char_start < s.start + s.length AND w.char_end > s.start GROUP BY ALL
    """,
)
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = boxes.word_offsets(word_boxes(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("char_start", "char_end")})
    lines = words.groupBy("doc_id", "line").agg((F.min("char_start") + 3).alias("start"), (F.max("char_end") - F.min("char_start") - 10).alias("length")).filter("length > 0")
    out = boxes.match_boxes(lines.select("doc_id", "start", "length"), words)
    return out.select("doc_id", "start", "length", F.col("left").alias("l"), F.col("top").alias("t"), F.col("right").alias("r"), F.col("bottom").alias("b"))


@query("page_text", f"SELECT doc_id, string_agg(text, chr(10) ORDER BY line) AS text FROM (SELECT doc_id, line, string_agg(text, ' ' ORDER BY word) AS text FROM ({WORD_BOXES}) GROUP BY ALL) GROUP BY doc_id")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.page_text(word_boxes(spark, sf_dir))


@query("splice_runs", r"SELECT doc_id, regexp_replace(text, '[0-9]{3,}', '<#>', 'g') AS text FROM documents")
def splice_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stamped(hits(F.col("text"), NUMBERS), "number", "<#>", 0)
    return table(spark, sf_dir, "documents").select("doc_id", "text", found.alias("m")).select("doc_id", splice(F.col("text"), F.col("m")).alias("text"))
