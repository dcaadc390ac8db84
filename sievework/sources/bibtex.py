"""BibTeX files in columns: brace depth is a running sum, so entries and fields of any nesting split without a parser.

A file is cut into pieces, the characters ``{ } @ " ,`` and what lies between. Braces count +1 and -1 in
order; a closing brace too many counts nothing (the walk is kept from falling below zero by its running minimum).
An ``@`` at depth 0 begins an entry, which ends where the depth is 0 again. Inside it a quote at depth 1
opens or closes a quoted value, and a comma at depth 1 outside quotes ends a field.

All windows and groups are by file, so there is one shuffle; a file's pieces are sorted, never held.

Defined results: a null text has no entries; entries that never close are left out; an opening brace outside
entries hides what follows until it is closed; comments and preambles are no entries; fields without a name or
``=`` are left out; of equal names all rows stay; an empty table gives no rows. File keys must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = r'[{}@",]|[^{}@",]+'
#: A field: its name and what follows the first sign of equality.
FIELD = r"(?s)^\s*([\w\-:.]+)\s*=\s*(.*?)\s*$"


def bibtex_fields(files: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each field of each entry: key, entry (from 1), type and name (lower case), cite_key and value.

    Values come without their braces and quotes, white space folded; a bare word that a @string of the same file
    defines is replaced by its text.
    """
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0))
    rows = files.select(F.col(key).alias("_key"), F.posexplode(pieces).alias("_at", "_piece"))
    file = Window.partitionBy("_key").orderBy("_at")
    so_far = file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("_piece") == "{", 1).when(F.col("_piece") == "}", -1).otherwise(0)
    walked = rows.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(so_far))
    deep = walked.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far)))
    before = F.coalesce(F.lag("_depth").over(file), F.lit(0))
    told = deep.withColumn("_before", before).withColumn("_begins", ((F.col("_piece") == "@") & (F.col("_before") == 0)).cast("int"))
    told = told.withColumn("entry", F.sum("_begins").over(so_far)).where("entry > 0")
    entry = Window.partitionBy("_key", "entry").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # An entry is over once its depth has come back to 0.
    closes = ((F.col("_piece") == "}") & (F.col("_before") == 1) & (F.col("_depth") == 0)).cast("int")
    told = told.withColumn("_closes", closes).withColumn("_closed", F.sum("_closes").over(entry)).where("_closed = 0 OR (_closed = 1 AND _closes = 1)")
    quotes = F.sum(((F.col("_piece") == '"') & (F.col("_before") == 1)).cast("int")).over(entry)
    told = told.withColumn("_quoted", quotes % 2 == 1)
    comma = (F.col("_piece") == ",") & (F.col("_before") == 1) & ~F.col("_quoted")
    told = told.withColumn("_comma", comma).withColumn("_field", F.when(F.col("_before") == 0, F.when(F.col("_depth") == 0, -1).otherwise(0)).otherwise(F.sum(comma.cast("int")).over(entry)))
    said = told.where("NOT _comma AND NOT (_before = 0 AND _depth = 1) AND NOT (_closes = 1)")
    parts = said.groupBy("_key", "entry", "_field").agg(F.array_sort(F.collect_list(F.struct("_at", "_piece"))).alias("_p"))
    joined = parts.select("_key", "entry", "_field", F.array_join(F.transform("_p", lambda x: x["_piece"]), "").alias("_text"))
    ended = told.groupBy("_key", "entry").agg(F.max("_closes").alias("_ended")).where("_ended = 1").select("_key", "entry")
    whole = joined.join(ended, ["_key", "entry"])
    every = Window.partitionBy("_key", "entry")
    of = lambda n: F.max(F.when(F.col("_field") == n, F.col("_text"))).over(every)
    typed = whole.withColumns({"type": F.lower(F.regexp_extract(of(-1), r"^@\s*(\w+)\s*$", 1)), "_head": F.trim(F.regexp_replace(F.coalesce(of(0), F.lit("")), r"\s+", " "))})
    # The first part of an entry is its key; of a @string it is the definition.
    macro = F.col("type") == "string"
    named = typed.where((F.col("type") != "") & ~F.col("type").isin("comment", "preamble") & ((F.col("_field") > 0) | (macro & (F.col("_field") == 0))))
    split = named.withColumns({"name": F.lower(F.regexp_extract("_text", FIELD, 1)), "_value": F.regexp_extract("_text", FIELD, 2)}).where("name != ''")
    fields = split.where("type != 'string'").withColumn("_bare", F.when(~F.col("_value").rlike(r'[{}"]'), F.lower("_value")))
    macros = split.where("type = 'string'").groupBy(F.col("_key").alias("_k"), F.col("name").alias("_name")).agg(F.max_by("_value", "entry").alias("_defined"))
    known = fields.join(macros, (F.col("_key") == F.col("_k")) & (F.col("_bare") == F.col("_name")), "left")
    return known.select(F.col("_key").alias(key), F.col("entry").cast("int").alias("entry"), "type", F.col("_head").alias("cite_key"), "name", plain(F.coalesce("_defined", "_value")).alias("value"))


def plain(value: Column) -> Column:
    """Without a pair of quotes around it and without braces, white space folded."""
    inner = F.regexp_replace(value, r'(?s)^"(.*)"$', "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(inner, "[{}]", ""), r"\s+", " "))
