"""Reading and writing inventory documents.

A document stays one row. Its service blocks are ``map<string, variant>``: the key set is
open, and a variant keeps the JSON type, so a rewritten document still has its numbers,
nulls and booleans. ``_document`` is the text it came from; writing puts the blocks back
into that text, so fields that no schema names stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERVER_TYPE = "struct<hostname: string, server_type: string, services: array<map<string, variant>>>"
NAME_FIELD = "_inventory"
DOCUMENT_SCHEMA = f"_notes string, servers array<{SERVER_TYPE}>, _corrupt_record string"


def last_key_wins(block: Column) -> Column:
    """A block in which a repeated key keeps only its last value, at its first place."""
    keys = F.map_keys(block)
    entries = F.map_entries(block)
    rebuilt = F.map_from_entries(
        F.transform(
            F.array_distinct(keys),
            lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1),
        )
    )
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), block).otherwise(rebuilt)


def _normalise(documents: DataFrame) -> DataFrame:
    servers = F.transform(
        "servers",
        lambda s: s.withField("services", F.transform(s["services"], last_key_wins)),
    )
    return documents.withColumn("servers", servers)


def read_inventory(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """One row per document: ``inventory``, ``_notes``, ``servers``, ``_corrupt_record``, ``_document``.

    ``multiline`` reads one document per file (one task per file), named by its path. JSON
    Lines input (``multiline=False``) is splittable; a document is then named by its field
    ``_inventory``, which ``write_inventory`` sets, or else by path and a hash of its text.
    So a name is data: it does not depend on how files are cut.
    """
    texts = spark.read.text(path, wholetext=multiline).select(F.col("value").alias("text"), "_metadata.file_path")
    name = F.col("file_path")
    if not multiline:
        name = F.concat(name, F.lit("#"), F.sha2("text", 256))
    return parse_inventory(texts.where("trim(text) != ''").select("text", name.alias("inventory")))


def parse_inventory(texts: DataFrame, text: str = "text", inventory: str = "inventory") -> DataFrame:
    """The same rows from documents held as text in a column."""
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}
    schema = f"{NAME_FIELD} string, {DOCUMENT_SCHEMA}"
    parsed = texts.select(inventory, F.col(text).alias("_document"), F.from_json(text, schema, options).alias("d"))
    name = F.coalesce(F.col(f"d.{NAME_FIELD}"), F.col(inventory).cast("string"))
    return _normalise(parsed.select(name.alias("inventory"), "d._notes", "d.servers", "d._corrupt_record", "_document"))


def _compact(text: Column) -> Column:
    """A JSON text as Spark prints it, all fields and their types kept."""
    return F.from_json(F.concat(F.lit('{"d":'), text, F.lit("}")), "d string")["d"]


def _replaced(text: Column, field: str, old: Column, new: Column) -> Column:
    """``text`` with the value of ``field``, printed as ``old``, replaced; an error if it can't be told where."""
    parts = F.split(text, F.concat(F.lit(f'\\Q"{field}":'), F.replace(old, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    unclear = F.raise_error(F.concat(F.lit(f"the field {field} is not in one place in "), F.left(text, F.lit(80))))
    return F.when(F.size(parts) == 2, F.concat(parts[0], F.lit(f'"{field}":'), new, parts[1])).otherwise(unclear)


def document_text(inventory, document, servers) -> Column:
    """The text of a document with the service blocks of ``servers`` and its name put in."""
    inventory, document, servers = (F.col(c) if isinstance(c, str) else c for c in (inventory, document, servers))
    compact = _compact(document)
    old = F.from_json(document, "servers array<string>")["servers"]

    def server(text: Column, now: Column) -> Column:
        before = F.get_json_object(text, "$.services")
        return F.when(before.isNull() | now["services"].isNull(), text).otherwise(
            _replaced(text, "services", before, F.to_json(now["services"]))
        )

    lost = F.raise_error(F.concat(F.lit("servers were added or taken away in "), inventory))
    rewritten = F.when(F.size(old) != F.size(servers), lost).otherwise(
        F.concat(F.lit("["), F.array_join(F.zip_with(old, servers, server), ","), F.lit("]"))
    )
    before = F.get_json_object(compact, "$.servers")
    full = F.when(before.isNull() | servers.isNull(), compact).otherwise(_replaced(compact, "servers", before, rewritten))
    named = F.get_json_object(compact, f"$.{NAME_FIELD}").isNotNull()
    head = F.concat(F.lit(f'{{"{NAME_FIELD}":'), F.regexp_extract(F.to_json(F.struct(inventory.alias("n"))), r'^\{"n":(.*)\}$', 1))
    rest = F.when(full == "{}", "}").otherwise(F.concat(F.lit(","), F.substr(full, F.lit(2))))
    return F.when(named, full).otherwise(F.concat(head, rest))


def write_inventory(documents: DataFrame, path: str) -> None:
    """Write documents as JSON Lines to a new path; an existing path is an error.

    Fields that no schema names, JSON types and the document's name survive. A document
    that could not be read, or whose servers no longer match its text, fails the write.
    """
    broken = F.raise_error(F.concat(F.lit("unreadable document "), F.col("inventory")))
    text = F.when(F.col("_corrupt_record").isNotNull(), broken).otherwise(document_text("inventory", "_document", "servers"))
    documents.select(text.alias("value")).write.mode("errorifexists").text(path)


def land_inventory(documents: DataFrame, path: str) -> DataFrame:
    """Parquet copy of the documents, parsed once, with fixed names."""
    documents.write.mode("errorifexists").parquet(path)
    return documents.sparkSession.read.parquet(path)


def land_services(services: DataFrame, path: str) -> DataFrame:
    """Parquet copy of the service rows by service. ``resolve`` then reads its own folder only."""
    services.write.mode("errorifexists").partitionBy("service").parquet(path)
    return services.sparkSession.read.schema(services.schema).parquet(path)


def land_config_entries(entries: DataFrame, path: str) -> DataFrame:
    """Parquet copy of the flat entries. Lookups by service read that folder only."""
    entries.write.mode("errorifexists").partitionBy("service").parquet(path)
    return entries.sparkSession.read.schema(entries.schema).parquet(path)
