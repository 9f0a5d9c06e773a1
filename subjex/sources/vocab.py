"""Authority vocabulary, class lists and code maps.

An authority dump is one JSON array, read with ``multiLine`` (one task per file,
as the format requires); everything after the read is row-local, and the
last-wins de-duplication is an aggregate by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subjex.functions.text import passage_prefix, py_strip
from subjex.session import spread

VOCAB_SCHEMA = ("Code STRING, Name STRING, `Alternate Name` ARRAY<STRING>, "
                "`Classification Name` STRING, Definition STRING")
# Separators and the definition label of the enriched label text.
PART_SEP = ". "
ALT_SEP = " | "
DEFINITION_LABEL = "Definition: "


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """S7 (read): entries of an authority dump with their position, by file name and then
    place in the file (``pos`` is an ordered struct)."""
    raw = spark.read.option("multiLine", True).schema(VOCAB_SCHEMA).json(path)
    # positions are taken where the file is read, then the entries are spread: one JSON
    # array is one read task
    return spread(raw.withColumn("pos", F.struct(F.col("_metadata.file_name").alias("file"),
                                                 F.monotonically_increasing_id().alias("place"))))


def authority_id(code) -> F.Column:
    """The part after the last ``:`` of a code."""
    return F.substring_index(code, ":", -1)


def label_text(name, alt, cls, definition) -> F.Column:
    """``name. alt1 | alt2. class. Definition: d``; empty optional parts are
    skipped, the name is always kept (so an empty name leaves a leading ``. ``)."""
    alt_s = F.nullif(F.coalesce(F.array_join(alt, ALT_SEP), F.lit("")), F.lit(""))
    cls_s = F.nullif(F.coalesce(cls, F.lit("")), F.lit(""))
    def_s = F.when(F.coalesce(definition, F.lit("")) != "",
                   F.concat(F.lit(DEFINITION_LABEL), definition))
    return py_strip(F.concat_ws(PART_SEP, F.coalesce(name, F.lit("")), alt_s, cls_s, def_s))


def vocabulary_entries(raw: DataFrame) -> DataFrame:
    """S7 + P8 + P9 + F5: ``(pos, gnd_id, emb_text, label_text)``; entries without a
    code or without text are dropped."""
    text = label_text(F.col("Name"), F.col("`Alternate Name`"), F.col("`Classification Name`"),
                      F.col("Definition"))
    return (raw.where(F.coalesce(F.col("Code"), F.lit("")) != "")
               .select("pos", authority_id(F.col("Code")).alias("gnd_id"), text.alias("label_text"))
               .where(F.col("label_text") != "")
               .select("pos", "gnd_id", passage_prefix("label_text").alias("emb_text"),
                       "label_text"))


def dedupe_last(entries: DataFrame, key: str = "gnd_id", order: str = "pos") -> DataFrame:
    """A10: the last entry per id wins (an aggregate, combined map-side)."""
    return (entries.groupBy(key)
                   .agg(F.max_by(F.struct("label_text", "emb_text"), order).alias("_e"))
                   .select(key, "_e.label_text", "_e.emb_text"))


def label_index(raw: DataFrame) -> DataFrame:
    """The vocabulary table ``(gnd_id, label_text, emb_text)``, one row per id."""
    return dedupe_last(vocabulary_entries(raw))


def class_list_from_text(text_df: DataFrame, col: str = "value",
                         keep_blank: bool = False) -> DataFrame:
    """``(class_idx, class)`` - stripped lines in file order, blank lines dropped
    (kept as classes with ``keep_blank``).  Numbering happens inside the row."""
    lines = F.transform(F.split(F.col(col), "\r?\n"), lambda s: py_strip(s))
    if not keep_blank:
        lines = F.filter(lines, lambda s: s != F.lit(""))
    return text_df.select(F.posexplode(lines).alias("class_idx", "class")) \
        .select(F.col("class_idx").cast("int"), "class")


def read_class_list(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """S8 (read): one class per line of a text file."""
    return class_list_from_text(spark.read.text(path, wholetext=True),
                                keep_blank=keep_blank)


def code_map_from_json(text_df: DataFrame, col: str = "value") -> DataFrame:
    """``(class, class_idx)`` from a JSON object ``code -> index``."""
    return text_df.select(F.explode(F.from_json(F.col(col), "map<string,int>"))
                          .alias("class", "class_idx"))


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """S9 (read)."""
    return code_map_from_json(spark.read.text(path, wholetext=True))
