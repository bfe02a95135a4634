"""CSV extracts with a header, quoted line feeds and doubled quotes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts read as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Headers of the known extracts and their canonical names.
NUMBERED_THEMES = {"Groupe": "grp", "Entity": "entity", "ODD number": "category", "ODD count": "mentions", "Summary": "summary"}
NAMED_THEMES = {"Groupe": "grp", "Entity": "entity", "Action Area": "category", "Mention count": "mentions", "Summary": "summary"}
NAME_LISTS = {"Groupe": "grp", "Entity": "entity", "BPD Names": "names", "Role Summary": "role_summary"}
NAMES = {"Groupe": "grp", "Entity": "entity", "BPD Names": "name"}
PAGE_METADATA = {"Groupe": "grp", "Entity": "entity"}
PAGES = {"Groupe": "grp", "Entity": "entity", "Page_Number": "page_number", "Link": "link", "page_content": "text"}


def load_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """Columns of ``schema`` out of CSV files, matched by header name.

    Files of one path share one order of columns, as one writer gives them; extracts with other orders are other paths.

    Cells are read as text, the tokens for a missing value become NULL, and only
    then is each column cast; a cell that does not fit its type becomes NULL.
    With ``multi_line`` a file is one task, so large extracts should come as many
    files; without quoted line feeds ``multi_line=False`` lets Spark split them.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not isinstance(path, str):
        return reduce(DataFrame.unionByName, [load_csv(spark, p, schema, multi_line) for p in path])
    raw = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', enforceSchema=False)
    cells = []
    for field in schema:
        cell = F.col(f"`{field.name}`")
        text = F.when(~cell.isin(NULL_TOKENS), cell)
        whole = isinstance(field.dataType, (T.IntegerType, T.LongType))
        value = text.try_cast(field.dataType)
        if whole:  # digits as they are; anything else that is a number by way of a double
            value = F.coalesce(F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), value), text.try_cast("double").try_cast(field.dataType))
        cells.append(value.alias(field.name))
    return raw.select(*cells)


def canonical(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Source headers renamed to the canonical ones; other columns stay."""
    return df.withColumnsRenamed(dict(mapping))


def whole_numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as whole numbers, fractions cut off; NULL and NaN become NULL."""
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in columns})
