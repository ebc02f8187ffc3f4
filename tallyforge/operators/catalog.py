"""Catalog metadata: personal data flags, name matching, foreign-key neighbourhoods, schema text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.metrics import Metric

#: Names of columns that hold personal data, by kind.
PERSONAL = {
    "phone": "phone|mobile|tel|telephone|contact_no|contact_number|cell_phone|cellphone|handset|msisdn",
    "email": "email|e_mail|user_email|mail_addr|email_address|contact_email",
    "id_card": "id_card|idcard|identity_card|identity_no|identity_number|national_id|citizen_id|ssn|social_security|passport_no|passport_number|resident_id|shenfenzheng|身份证",
    "name": "full_name|fullname|real_name|realname|first_name|last_name|family_name|given_name|customer_name|user_name|username|nickname|display_name",
    "address": "address|home_addr|home_address|residence_addr|residence_address|street_addr|street_address|mailing_addr|mailing_address|postal_addr|postal_address",
    "bank_card": "bank_card|bankcard|card_no|card_number|credit_card|credit_card_no|credit_card_number|debit_card|cvv|card_cvc|pan",
    "dob": "dob|date_of_birth|birthdate|birth_date|birthday",
}
#: Columns of bookkeeping, never personal.
SYSTEM = (
    "id pk version created_at updated_at deleted_at created_by updated_by is_active is_deleted status tenant_id org_id company_id "
    "department_id id_str uid guid"
).split()


def personal_kind(name: Column) -> Column:
    """The kind of personal data that a column of this name holds; empty for none."""
    low = F.lower(name)
    out = F.when(F.trim(low).isin(SYSTEM), "")
    for kind, words in PERSONAL.items():
        out = out.when(low.rlike(rf"(?U)\b({words})\b"), kind)
    out = out.when(low.contains("id_no") | low.contains("idno") | low.contains("cert_no"), "id_card")
    return out.when(low.contains("no") & (low.contains("phone") | low.contains("mobile")), "phone").otherwise("")


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type, position) of tables."""
    rows = [(t, f.name, f.dataType.simpleString(), i) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, position int")


def name_score(name: Column, comment: Column, asked: Column, of_table: bool = False) -> Column:
    """How well a name matches what is asked: 1 exact, 0.95 in another case, 0.75 (tables 0.7) if its comment holds it.

    0.65 if the name holds what is asked; the other way round 0.6 for columns, 0.65 for tables.
    """
    low, want, note = F.lower(name), F.lower(F.trim(asked)), F.lower(F.coalesce(comment, F.lit("")))
    return (
        F.when(name == asked, 1.0).when(low == want, 0.95).when((note != "") & note.contains(want), 0.7 if of_table else 0.75)
        .when(low.contains(want), 0.65).when(want.contains(low), 0.65 if of_table else 0.6).otherwise(0.0)
    )


def neighbours(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(table_name, is_seed): seeds and the tables one foreign key away, in either direction."""
    ahead = links.join(seeds, links["from_table"] == seeds["table_name"], "left_semi").select(F.col("to_table").alias("table_name"))
    back = links.join(seeds, links["to_table"] == seeds["table_name"], "left_semi").select(F.col("from_table").alias("table_name"))
    found = seeds.select("table_name", F.lit(True).alias("is_seed")).unionByName(ahead.union(back).select("table_name", F.lit(False).alias("is_seed")))
    return found.groupBy("table_name").agg(F.max("is_seed").alias("is_seed"))


def schema_documents(columns: DataFrame) -> DataFrame:
    """(table_name, text): one searchable line per table."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("position", "column_name", "data_type"))), lambda c: F.concat_ws(" ", c["column_name"], c["data_type"]))
    return columns.groupBy("table_name").agg(parts.alias("p")).select("table_name", F.concat_ws(": ", "table_name", F.array_join("p", ", ")).alias("text"))


def keyword_scan(columns: DataFrame, tokens: list[str]) -> DataFrame:
    """(column_name, tables) of the columns that hold a token; none if no token touches a table's name.

    Tokens of two characters must equal the column's name, shorter ones are left out.
    """
    asked = list(dict.fromkeys(t.lower().strip() for t in tokens if len(t.strip()) >= 2))
    t, c = F.lower("table_name"), F.lower("column_name")
    touch, hold = F.lit(False), F.lit(False)
    for x in asked:
        inside = (F.length(t) >= 3) & F.lit(x).contains(t)
        touch = touch | (t == x) | (t.contains(x) | inside if len(x) >= 3 else F.lit(False))
        hold = hold | (c.contains(x) if len(x) >= 3 else c == x)
    touched = columns.agg(F.bool_or(touch)).first()[0]
    found = columns.where(hold if touched else F.lit(False))
    return found.groupBy("column_name").agg(F.sort_array(F.collect_set("table_name")).alias("tables"))


def search(columns: DataFrame, asked: str, most: int = 20) -> DataFrame:
    """(table_name, table_match, matched): the first ``most`` tables whose name or columns hold a keyword."""
    low = asked.strip().lower()
    x = columns.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.when(F.lower("column_name").contains(low), F.col("column_name")))).alias("matched")
    ).withColumn("table_match", F.lower("table_name").contains(low))
    return x.where(F.col("table_match") | (F.size("matched") > 0)).orderBy("table_name").limit(most).select("table_name", "table_match", "matched")


def filtered(columns: DataFrame, wanted: DataFrame) -> DataFrame:
    """(table_name, columns): all columns of the wanted tables, of the others the name alone."""
    full = wanted.select(F.col("table_name").alias("want")).distinct()
    x = columns.join(full, F.col("table_name") == F.col("want"), "left").groupBy("table_name")
    return x.agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("want").isNotNull(), F.struct("position", "column_name")))), lambda c: c["column_name"]).alias("columns"))


def live_hits(hits: DataFrame, columns: DataFrame) -> DataFrame:
    """The hits whose table still exists."""
    return hits.join(columns.select("table_name").distinct(), "table_name", "left_semi")


def schema_text(columns: DataFrame, personal: str = "mask") -> DataFrame:
    """(table_name, text): a line of name and type per column, personal ones masked, left out ("exclude") or as they are ("off")."""
    if personal not in ("mask", "exclude", "off"):
        raise ValueError(personal)
    x = columns.withColumn("kind", personal_kind(F.col("column_name")))
    line = F.concat_ws(": ", "column_name", "data_type")
    if personal == "mask":
        line = F.when(F.col("kind") != "", F.concat(F.lit("<pii:"), "kind", F.lit(">: "), "data_type")).otherwise(line)
    if personal == "exclude":
        line = F.when(F.col("kind") == "", line)
    lines = F.transform(F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("position", line.alias("line"))))), lambda c: c["line"])
    return x.groupBy("table_name").agg(lines.alias("lines")).select("table_name", F.array_join("lines", "\n").alias("text"))


def join_evidence(joins: DataFrame, keys: DataFrame) -> DataFrame:
    """Joins (left_table, left_column, right_table, right_column) and whether a foreign key of one column backs them, either way.

    ``keys`` are (key_name, from_table, from_column, to_table, to_column), a row per column of a key.
    """
    alone = keys.groupBy("key_name", "from_table", "to_table").agg(
        F.count("*").alias("width"), F.first("from_column").alias("from_column"), F.first("to_column").alias("to_column")
    ).where("width = 1")
    a, b = ["from_table", "from_column"], ["to_table", "to_column"]
    ends = alone.select(F.explode(F.array(F.concat_ws("\u0001", *a, *b), F.concat_ws("\u0001", *b, *a))).alias("ends")).distinct()
    names = ["left_table", "left_column", "right_table", "right_column"]
    x = joins.withColumn("ends", F.concat_ws("\u0001", *names)).join(ends.withColumn("backed", F.lit(True)), "ends", "left")
    return x.select(*names, F.coalesce("backed", F.lit(False)).alias("backed"))


def sharing_parts(tables: DataFrame, asked: str, tokens: list[str]) -> DataFrame:
    """Tables with a part of their name, between underscores, of four letters in the question or of three in a token.

    A token of four letters within a part counts as well.
    """
    low, words = asked.lower(), [t.lower() for t in tokens if len(t) >= 4]
    part = F.explode(F.split(F.lower("table_name"), "_")).alias("part")
    p = F.col("part")
    hit = (F.length(p) >= 4) & F.lit(low).contains(p)
    for w in words:
        hit = hit | p.contains(w) | ((F.length(p) >= 3) & F.lit(w).contains(p))
    return tables.select("table_name", part).where(hit).select("table_name").distinct()


def column_documents(columns: DataFrame) -> DataFrame:
    """(id, table_name, text): one searchable line per column, underscores as spaces."""
    words = F.translate(F.concat_ws(" ", "table_name", "column_name"), "_", " ")
    return columns.select(F.concat_ws(".", "table_name", "column_name").alias("id"), "table_name", F.concat_ws(" ", words, "data_type").alias("text"))


#: A dimension's values are told if it has so many at most.
MOST_VALUES = 50


def metric_documents(metrics: list[Metric], tables: dict[str, DataFrame], most: int = MOST_VALUES) -> DataFrame:
    """(id, fact, dimensions, text): one searchable line per metric: its name, what it computes, its dimensions and their values.

    Values are read from the tables; a dimension of more than ``most`` distinct ones is told by its name alone.
    """
    spark = next(iter(tables.values())).sparkSession
    places = {(m.table, d): (m.table, d) for m in metrics for d in m.dimensions}
    places |= {(m.lookup.table, a): (m.lookup.table, c) for m in metrics if m.lookup for a, c in m.lookup.dimensions}
    told = []
    for (t, alias), (_, column) in places.items():
        some = tables[t].select(F.col(column).cast("string").alias("v")).where("v is not null").distinct().limit(most + 1)
        said = F.when(F.count("*") <= most, F.array_join(F.sort_array(F.collect_list("v")), " ")).otherwise("")  # most + 1 rows
        told.append(some.agg(said.alias("values")).select(F.lit(t).alias("of"), F.lit(alias).alias("dimension"), "values"))
    values = reduce(DataFrame.unionByName, told, spark.createDataFrame([], "of string, dimension string, values string"))
    rows = []
    for m in metrics:
        held = [(m.table, d) for d in m.dimensions] + [(m.lookup.table, a) for a, _ in (m.lookup.dimensions if m.lookup else ())]
        head = f"{m.name.replace('_', ' ')} {m.aggregation} of {m.column} in {m.table}"
        rows += [(m.name, m.table, list(m.dimension_names()), head, place, of, d) for place, (of, d) in enumerate(held or [(None, None)])]
    x = spark.createDataFrame(rows, "id string, fact string, dimensions array<string>, head string, place int, of string, dimension string")
    line = F.when(F.col("dimension").isNotNull(), F.rtrim(F.concat_ws(" ", F.lit("by"), F.translate("dimension", "_", " "), "values")))
    lines = F.sort_array(F.collect_list(F.when(F.col("dimension").isNotNull(), F.struct("place", line.alias("line")))))
    out = x.join(F.broadcast(values), ["of", "dimension"], "left").groupBy("id").agg(F.first("fact").alias("fact"), F.first("dimensions").alias("dimensions"), F.first("head").alias("head"), lines.alias("lines"))
    return out.select("id", "fact", "dimensions", F.array_join(F.concat(F.array("head"), F.col("lines.line")), " ").alias("text"))


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(column_name, data_type, change): columns added and removed between two lists of (column_name, data_type)."""
    side = lambda x, y, what: x.exceptAll(y).withColumn("change", F.lit(what))
    return side(new, old, "added").unionByName(side(old, new, "removed"))


#: Most columns that a scan of a database's metadata brings in.
MOST_COLUMNS = 20_000


def scanned_columns(read: Callable[[str], DataFrame], schema: str, most: int = MOST_COLUMNS) -> DataFrame:
    """(table_name, column_name, data_type, position) from a database's information_schema, through ``read`` (a query to a DataFrame).

    A schema of more columns is refused as a whole: a part of it would pass for all.
    """
    if not re.fullmatch(r"\w{1,128}", schema):
        raise ValueError("a plain schema name")
    ask = f"SELECT table_name, column_name, data_type, ordinal_position FROM information_schema.columns WHERE table_schema = '{schema}'"
    found = read(ask).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} columns")
    spark = SparkSession.active()
    return spark.createDataFrame([(r[0], r[1], str(r[2]).lower(), int(r[3]) - 1) for r in found], "table_name string, column_name string, data_type string, position int")
