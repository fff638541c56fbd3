"""Normalised instruction text: mnemonic and classes or words of operands, with addresses looked up in symbol tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: A run of characters of names and numbers, or of others.
SYMBOLS = "[0-9A-Za-z_$]+|[^0-9A-Za-z_$]+"
SHORT = 5


def operands(line: Column) -> Column:
    """Mnemonic and operands: what stands before a semicolon, parted after the first word and at commas with a blank."""
    return F.split(F.regexp_replace(F.regexp_replace(F.split_part(line, F.lit(";"), F.lit(1)), r"^(\S*)\s+", "$1, "), r"^\s+", ""), ", ")


def resolved(found: DataFrame, symbols: DataFrame | None, strings: DataFrame | None, by: list[str]) -> DataFrame:
    """found (by, addr) with name: of the symbol at an address, else of the string there. Tables: by, addr, text."""
    out = found
    for table, name in ((symbols, "_symbol"), (strings, "_string")):
        if table is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
        else:
            out = out.join(table.select(*by, "addr", F.col("text").alias(name)), [*by, "addr"], "left")
    return out.withColumn("name", F.coalesce("_symbol", "_string")).drop("_symbol", "_string")


def _name_words(name: Column, demangle) -> Column:
    parts = F.split(name, ":")
    if demangle is not None:
        parts = F.transform(parts, demangle)
    return F.flatten(F.transform(parts, T.format_words))


def parsed(lines: DataFrame, keys: list[str], symbols: DataFrame | None = None, strings: DataFrame | None = None, by: tuple[str, ...] = (), demangle=None) -> DataFrame:
    """keys, tokens: instructions (keys, text) as normalised text.

    A call's target is internal or external, with its words; jump targets are classes. Of other operands each run of
    characters is a number's class, the words of the symbol or string at its address, a local variable, itself if it is
    short, or its words. A minus is a plus before numbers, whose class tells the sign, and before another minus.
    symbols, strings: by, addr, text. by: keys that the tables are told apart by. demangle: a column function for names.
    """
    rows = lines.select(*keys, operands(F.col("text")).alias("_parts"))
    each = rows.select(*keys, F.get("_parts", 0).alias("_mnemonic"), F.posexplode_outer(F.slice("_parts", 2, 1 << 30)).alias("_op", "_operand"))
    each = each.withColumn("_jump", T.jump_classes(F.col("_operand")))
    call = F.col("_mnemonic") == "call"
    # whole operands
    words = lambda x: _name_words(x, demangle)
    whole = F.when(F.col("_operand").isNull(), F.array().cast("array<string>")).when(call, T.call_classes(F.col("_operand"), words)).when(F.size("_jump") > 0, F.col("_jump"))
    each = each.withColumn("_whole", whole)
    done = each.where("_whole IS NOT NULL").select(*keys, "_op", F.lit(0).alias("_at"), F.col("_whole").alias("_tokens"))
    # runs of characters
    runs = F.transform(F.regexp_extract_all("_operand", F.lit(SYMBOLS), 0), T.trimmed)
    runs = each.where("_whole IS NULL").select(*keys, "_op", F.posexplode(runs).alias("_at", "_run"))
    here = Window.partitionBy(*keys, "_op").orderBy("_at")
    runs = runs.withColumn("_negative", F.coalesce(F.lag("_run").over(here) == "-", F.lit(False))).withColumn("addr", T.address_of(F.col("_run")))
    runs = resolved(runs, symbols, strings, list(by))
    number = T.number_class(F.col("_run"), F.col("_negative"))
    named = F.when(F.col("name").isNotNull(), words(F.col("name")))
    # a name without words leaves its number a run like others
    number = F.when(F.col("name").isNotNull(), named).when(number.isNotNull(), F.array(number))
    runs = runs.withColumn("_number", F.when(F.size(number) > 0, number))
    runs = runs.withColumn("_follows", F.lead("_run").over(here)).withColumn("_number_follows", F.lead(F.col("_number").isNotNull()).over(here))
    own = F.col("_run")
    minus = F.when(F.col("_follows").isNull() | F.col("_number_follows") | (F.col("_follows") == "-"), F.lit("+")).otherwise(F.lit("-"))
    tokens = (
        F.when(F.col("_number").isNotNull(), F.col("_number"))
        .when(own.contains("var_"), F.array(F.lit(T.VARIABLE)))
        .when(own == "-", F.array(minus))
        .when(F.length(own) < SHORT, F.array(own))
        .otherwise(words(own))
    )
    every = done.unionByName(runs.select(*keys, "_op", "_at", tokens.alias("_tokens")))
    sorted_tokens = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_op", F.lit(-1)).alias("op"), "_at", "_tokens"))), lambda x: x["_tokens"]))
    out = every.groupBy(*keys).agg(F.filter(sorted_tokens, lambda x: x != "").alias("_tokens"))
    return rows.join(out, keys).select(*keys, F.array_join(F.concat(F.array(F.get("_parts", 0)), "_tokens"), " ").alias("tokens"))
