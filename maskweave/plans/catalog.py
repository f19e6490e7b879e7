"""The rule catalogue: fields with typed patterns, as plain values and as tables, with its edits."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.patterns import known, type_name
from ..sources.terms import parse, serialised

MASK = "████"
FIELD_SCHEMA = "id int, client_id int, field_name string, replace_with string, is_active boolean, is_preserve boolean, priority int"
PATTERN_SCHEMA = "id int, field_id int, pattern_type string, pattern string, priority int"


@dataclass(frozen=True)
class Pattern:
    pattern_type: str
    pattern: str
    priority: int = 100


@dataclass(frozen=True)
class Field:
    name: str
    patterns: tuple[Pattern, ...] = ()
    replace_with: str = MASK
    is_active: bool = True
    is_preserve: bool = False
    priority: int = 0
    client_id: int | None = None


def tables(spark: SparkSession, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """The catalogue as (fields, patterns) tables, ids in order."""
    rows = [(i, f.client_id, f.name, f.replace_with, f.is_active, f.is_preserve, f.priority) for i, f in enumerate(fields, 1)]
    patterns, n = [], 0
    for i, f in enumerate(fields, 1):
        for p in f.patterns:
            n += 1
            patterns.append((n, i, p.pattern_type, p.pattern, p.priority))
    return spark.createDataFrame(rows, FIELD_SCHEMA), spark.createDataFrame(patterns, PATTERN_SCHEMA)


def with_patterns(fields: DataFrame, patterns: DataFrame) -> DataFrame:
    """fields with an array of their patterns in order of id; a field without any keeps an empty one."""
    own = patterns.groupBy("field_id").agg(F.sort_array(F.collect_list(F.struct("id", "pattern_type", "pattern", "priority"))).alias("patterns"))
    joined = fields.join(own, fields.id == own.field_id, "left").drop("field_id")
    return joined.withColumn("patterns", F.coalesce("patterns", F.array().cast("array<struct<id:int,pattern_type:string,pattern:string,priority:int>>")))


def for_client(fields: DataFrame, client_id: int | None) -> DataFrame:
    """Active fields that are everyone's or the client's; without a client, everyone's only."""
    mine = F.col("client_id").isNull()
    if client_id is not None:
        mine = mine | (F.col("client_id") == client_id)
    return fields.filter(F.col("is_active") & mine)


def load(fields: DataFrame, patterns: DataFrame, client_id: int | None = None) -> list[Field]:
    """A client's catalogue, brought to the driver: rules are few, and are compiled into the plan. Patterns of unknown types are skipped."""
    rows = with_patterns(for_client(fields, client_id), patterns).orderBy("id").collect()
    return [Field(r.field_name, tuple(Pattern(type_name(p.pattern_type), p.pattern, p.priority) for p in r.patterns if known(p.pattern_type)), r.replace_with, r.is_active, r.is_preserve, r.priority, r.client_id) for r in rows]


def effective_priority(fields: DataFrame, patterns: DataFrame) -> DataFrame:
    """fields with the greater of their own and their patterns' priorities, and their ``place`` in listings: the highest first, then by own priority and name.

    A catalogue is small, so one task numbers its fields.
    """
    top = patterns.groupBy(F.col("field_id").alias("id")).agg(F.max("priority").alias("top"))
    joined = fields.join(top, "id", "left").withColumn("effective_priority", F.greatest("priority", F.coalesce("top", F.lit(0)))).drop("top")
    order = Window.orderBy(F.desc("effective_priority"), F.desc("priority"), "field_name")
    return joined.withColumn("place", F.row_number().over(order).cast("long")).orderBy("place")


def by_kind(fields: DataFrame) -> DataFrame:
    """One row: how many fields there are, protected ones and ones that redact."""
    return fields.agg(F.count("*").alias("n_all"), F.count_if("is_preserve").alias("n_preserve"), F.count_if(~F.col("is_preserve")).alias("n_redact"))


def of_kind(fields: DataFrame, preserve: bool | None = None) -> DataFrame:
    """The protected fields, those that redact, or (None) all."""
    return fields if preserve is None else fields.filter(F.col("is_preserve") == preserve)


def pattern_by_id(fields: DataFrame, patterns: DataFrame, pattern_id: int) -> DataFrame:
    """The pattern of an id with its field's name; no row where there is none."""
    own = patterns.filter(F.col("id") == pattern_id)
    return own.join(fields.select(F.col("id").alias("field_id"), "field_name"), "field_id")


def clients_latest(clients: DataFrame, key: str = "id") -> DataFrame:
    return clients.orderBy(F.desc(key))


def settings_by_key(settings: DataFrame, key: str = "key") -> DataFrame:
    return settings.orderBy(key)


# ---- edits: each returns the tables anew --------------------------------------------------------------------------


def replacement(c: Column) -> Column:
    """A blank replacement becomes the mask."""
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(MASK)).otherwise(c)


def added(table: DataFrame, values: dict) -> DataFrame:
    """table with one more row, its id the next."""
    next_id = (table.agg(F.max("id")).first()[0] or 0) + 1
    row = table.sparkSession.createDataFrame([tuple(values.get(c) if c != "id" else next_id for c in table.columns)], table.schema)
    return table.unionByName(row)


def add_field(fields: DataFrame, name: str, replace_with: str = "", client_id: int | None = None, is_preserve: bool = False, priority: int = 500) -> DataFrame:
    return added(fields, {"client_id": client_id, "field_name": name, "replace_with": replace_with.strip() and replace_with or MASK, "is_active": True, "is_preserve": is_preserve, "priority": priority})


def add_pattern(patterns: DataFrame, field_id: int, pattern_type: str, pattern: str, priority: int = 100) -> DataFrame:
    return added(patterns, {"field_id": field_id, "pattern_type": type_name(pattern_type), "pattern": pattern, "priority": priority})


def first_of(patterns: DataFrame, field_id: int, pattern_type: str) -> Row | None:
    """A field's first pattern of a type, in the order in which patterns are listed: by priority, the highest first."""
    return patterns.filter((F.col("field_id") == field_id) & (F.col("pattern_type") == pattern_type)).orderBy(F.desc("priority"), "id").first()


def without_pattern(patterns: DataFrame, pattern_id: int) -> DataFrame:
    return patterns.filter(F.col("id") != pattern_id)


def append_value(patterns: DataFrame, field_id: int, value: str) -> DataFrame:
    """One more term in the field's first ConstList, its terms sorted whatever their case; without one, a new list.

    A term that is there already, in whatever case, changes nothing; a blank value is refused.
    """
    value = value.strip()
    if not value:
        raise ValueError("a term cannot be blank")
    own = first_of(patterns, field_id, "ConstList")
    if own is None:
        return add_pattern(patterns, field_id, "ConstList", value, 999)
    terms = {t.strip().lower(): t.strip() for t in reversed(own.pattern.split("|")) if t.strip()}
    if value.lower() in terms:
        return patterns
    return updated(patterns, own.id, pattern="|".join(sorted([*terms.values(), value], key=str.upper)))


def extend_list(patterns: DataFrame, pattern_id: int, value: str) -> DataFrame:
    """One more term at the end of a list, whatever it holds; its priority becomes 0. A blank value is refused."""
    value = value.strip()
    if not value:
        raise ValueError("a term cannot be blank")
    here, old = F.col("id") == pattern_id, F.coalesce(F.regexp_replace("pattern", "\\|+$", ""), F.lit(""))
    longer = F.when(F.trim(F.coalesce("pattern", F.lit(""))) == "", F.lit(value)).otherwise(F.concat(old, F.lit(f"|{value}")))
    changed = {"pattern_type": F.lit("ConstList"), "pattern": longer, "priority": F.lit(0)}
    return patterns.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in changed.items()})


def add_rule(fields: DataFrame, patterns: DataFrame, name: str, pattern_type: str, pattern: str, replace_with: str = "", is_preserve: bool = False) -> tuple[DataFrame, DataFrame]:
    """A field for all clients with its first pattern, of priority 100, or 999 in a protected field. A blank name or pattern is refused."""
    if not name.strip() or not pattern.strip():
        raise ValueError("a rule needs a name and a pattern")
    fields = add_field(fields, name.strip(), replace_with.strip() or ("—" if is_preserve else MASK), is_preserve=is_preserve)
    return fields, add_pattern(patterns, fields.agg(F.max("id")).first()[0], pattern_type, pattern.strip(), 999 if is_preserve else 100)


def import_terms(patterns: DataFrame, field_id: int, terms: DataFrame, append: bool = False) -> DataFrame:
    """The terms of a file as the field's FileList: in place of what it holds, or besides; without one, a new list.

    No terms at all are refused. The list is part of the catalogue, so it comes to the driver as one string.
    """
    own = first_of(patterns, field_id, "FileList")
    if append and own is not None:
        old = parse(terms.sparkSession.createDataFrame([(line,) for line in own.pattern.split("\n")], "value string"))
        terms = merged_terms(old, terms)
    pattern = serialised(terms).first().pattern
    if not pattern:
        raise ValueError("no terms in the file")
    return add_pattern(patterns, field_id, "FileList", pattern, 100) if own is None else updated(patterns, own.id, pattern=pattern)


def with_new_key(clients: DataFrame, client_id: int, api_key: str) -> DataFrame:
    """clients with the hash of another key on one of them; the key itself is kept nowhere."""
    return updated(clients, client_id, api_key_hash=hashlib.sha256(api_key.encode()).hexdigest())


def add_preserve(fields: DataFrame, patterns: DataFrame, name: str, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """A protected field from a list of terms."""
    fields = added(fields, {"field_name": name, "replace_with": "—", "is_active": True, "is_preserve": True, "priority": 999})
    return fields, add_pattern(patterns, fields.agg(F.max("id")).first()[0], "ConstList", "|".join(terms), 999)


def updated(table: DataFrame, row_id: int, **values) -> DataFrame:
    """table with values set on one row."""
    return table.withColumns({c: F.when(F.col("id") == row_id, F.lit(v).cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def without_field(fields: DataFrame, patterns: DataFrame, field_id: int) -> tuple[DataFrame, DataFrame]:
    return fields.filter(F.col("id") != field_id), patterns.filter(F.col("field_id") != field_id)


def upserted(settings: DataFrame, key: str, value: str) -> DataFrame:
    """settings(key, value, description) with one value; its description stays."""
    new = settings.sparkSession.createDataFrame([(key, value)], "key string, value string")
    kept = new.join(settings.select("key", "description"), "key", "left")
    return settings.join(new, "key", "left_anti").unionByName(kept)


def seeded(table: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """table with the defaults whose key it lacks."""
    return table.unionByName(defaults.join(table, key, "left_anti"), allowMissingColumns=True)


# ---- term sets ----------------------------------------------------------------------------------------------------


def merged_terms(old: DataFrame, new: DataFrame) -> DataFrame:
    """(term): the distinct terms of both whatever their case, the least spelling, by their upper case."""
    rows = old.select("term").union(new.select("term")).filter("trim(term) != ''")
    return rows.groupBy(F.lower("term").alias("k")).agg(F.min("term").alias("term")).orderBy(F.upper("term"), "term").select("term")


def without_term(terms: DataFrame, term: str) -> DataFrame:
    return terms.filter(F.lower("term") != term.lower())


def consolidated(patterns: DataFrame) -> DataFrame:
    """Per field: its WholeWord and ConstList patterns as one ConstList, terms distinct and sorted, priority 999."""
    lists = patterns.filter(F.col("pattern_type").isin("WholeWord", "ConstList"))
    terms = lists.select("field_id", F.explode(F.split("pattern", "\\|")).alias("term")).withColumn("term", F.trim("term")).filter("term != ''")
    once = terms.groupBy("field_id", F.lower("term").alias("k")).agg(F.min("term").alias("term"))
    joined = once.groupBy("field_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "term"))), lambda s: s["term"]), "|").alias("pattern"))
    return joined.select("field_id", F.lit("ConstList").alias("pattern_type"), "pattern", F.lit(999).alias("priority"))


def ordered_patterns(patterns: tuple[Pattern, ...]) -> list[Pattern]:
    """By priority, the highest first; equal ones stay in order."""
    return sorted(patterns, key=lambda p: -p.priority)
