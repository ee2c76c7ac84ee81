"""Python by tokens and indentation: ranges of functions and classes, calls with their text, and the data that calls bring to their callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.session import checkpoint
from graphloom.operators import extract as E
from graphloom.operators.lexing import scoped
from graphloom.operators.scripts import owners, texts

# Words that begin a statement with a body, words before a bracket that call nothing, how ids begin.
COMPOUND = "if elif else for while with try except finally def class async match case".split()
NO_CALL = "if elif while for in not and or is return yield assert del lambda def class except with await import from raise print_".split()
PREFIX = {"Class": "py-class", "Method": "py-method", "Function": "py-fn"}
#: Signs that, right before '=', make it no assignment.
OTHER_EQUALS = "= ! < > + - * / % & | ^ : @".split()


def python_tokens(lexed: DataFrame) -> DataFrame:
    """Scoped tokens of Python files with `begins`: whether a statement begins there (a line outside brackets, after ';', or after the ':' of a compound statement on its line)."""
    t = scoped(lexed.where("language = 'python'"))
    order = Window.partitionBy("path").orderBy("idx")
    line = F.col("head") & ~F.col("inside") & (F.col("scope") == 0) & ~F.col("closes")
    t = t.withColumn("line_head", line).withColumn("first", F.last(F.when(line, F.col("text")), ignorenulls=True).over(order))
    outside = F.col("scope") == 0
    body = (F.lag("text").over(order) == ":") & F.col("first").isin(COMPOUND)
    return t.withColumn("begins", F.coalesce(line | (outside & ((F.lag("text").over(order) == ";") | body)), F.lit(False)))


def python_symbols(lexed: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(path, name, type, line_no, id, RANGE): functions, methods and classes, each up to the next line that is indented no deeper, strings and comments aside.

    For every indentation that some symbol of the file has, lines no deeper are put in order and a symbol takes the next of its own: rows are lines times such
    indentations.
    """
    tokens = python_tokens(lexed) if tokens is None else tokens
    code = lexed.where("language = 'python'").select("path", "language", "line_no", F.col("code").alias("line"))
    own = E.python_symbols(code)
    heads = tokens.where("line_head").select("path", "line_no", "col").distinct()
    own = own.join(heads, ["path", "line_no"])
    levels = own.select("path", F.col("col").alias("level")).distinct()
    lined = heads.join(levels, "path").where("col <= level")
    after = F.lead("line_no").over(Window.partitionBy("path", "level").orderBy("line_no"))
    ends = lined.withColumn("after", after).where("col = level").select("path", "line_no", F.col("level").alias("col"), "after")
    last = lexed.groupBy("path").agg(F.max("line_no").alias("last"))
    ranged = own.join(ends, ["path", "line_no", "col"]).join(last, "path")
    kinds = F.coalesce(*(F.when(F.col("type") == k, v) for k, v in PREFIX.items()), F.lit("py-symbol"))
    name = F.concat(kinds, F.lit(":"), "path", F.lit("::"), "name", F.lit("@"), F.col("line_no").cast("string"))
    return ranged.select("path", "name", "type", "line_no", name.alias("id"), F.col("line_no").alias("start_line"), F.col("col").alias("start_char"), F.coalesce(F.col("after") - 1, F.col("last")).alias("end_line"), F.lit(1 << 20).alias("end_char"))


def python_calls(lexed: DataFrame, tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, idx, source, callee, dotted, assigned, text): calls with their owner, whether they are called on something, and whether their statement assigns."""
    c = F.col
    order = Window.partitionBy("path").orderBy("idx")
    inside = Window.partitionBy("path", "scope").orderBy("idx")
    ahead = Window.partitionBy("path", "scope").orderBy(c("idx").desc()).rowsBetween(Window.unboundedPreceding, -1)
    assigns = (c("text") == "=") & (c("scope") == 0) & ~c("quoted") & ~F.coalesce((c("glued") & c("prev").isin(OTHER_EQUALS)) | ((c("next") == "=") & F.lead("glued").over(order)), F.lit(False))
    t = tokens.withColumn("statement", F.sum(c("begins").cast("int")).over(order)).withColumn("assigns", assigns)
    t = t.withColumn("assigned", F.max("assigns").over(Window.partitionBy("path", "statement")))
    value = c("p_in").rlike(r"""^[A-Za-z0-9_"']""") | c("p_in").isin(")", "]")
    on = c("text").isin(".", ")", "]", "}") | (c("p_in") == ".") | (c("text").isin("(", "[") & value)
    t = t.withColumn("chain", F.last(F.when(~F.coalesce(on, F.lit(False)), F.struct("line_no", "col")), ignorenulls=True).over(inside))
    t = t.withColumn("paren", F.last(F.when((c("text") == "(") & ~c("quoted"), F.struct("idx", "mate")), ignorenulls=True).over(ahead))
    called = t.where("call AND NOT quoted AND paren IS NOT NULL").where(~c("text").isin(NO_CALL) & ~F.coalesce(c("prev").isin("def", "class"), F.lit(False)))
    called = called.select("path", "idx", c("text").alias("callee"), F.coalesce(c("p_in") == ".", F.lit(False)).alias("dotted"), F.coalesce("assigned", F.lit(False)).alias("assigned"), c("chain.line_no").alias("l1"), c("chain.col").alias("c1"), c("paren.mate").alias("to"))
    ends = tokens.where("closes").select("path", c("idx").alias("to"), c("line_no").alias("l2"), (c("col") + 1).alias("c2"))
    called = checkpoint(called.join(ends, ["path", "to"]).drop("to"))
    held = owners(called.select("path", "idx", c("l1").alias("line"), c("c1").alias("char")), symbols)
    read = texts(lexed, called.select("path", "idx", "l1", "c1", "l2", "c2"))
    return called.select("path", "idx", "callee", "dotted", "assigned").join(held, ["path", "idx"]).join(read, ["path", "idx"])


def python_relations(lexed: DataFrame, symbols: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(source, target, type, confidence, kind, label, evidence): Calls of the last symbol of a call's last name, and what the call brings: a DataFlow from it to the caller.

    A symbol answers to its name and to the last part of it; of several the last by file, line and id. The flow is an Assignment where the call's statement assigns, else a
    ReturnValue. Calls on something are Semantic, bare ones Heuristic. A symbol's calls of itself don't count.
    """
    tokens = python_tokens(lexed) if tokens is None else tokens
    each = symbols.select("id", "path", "line_no", F.explode(F.array_distinct(F.array("name", F.substring_index("name", "::", -1)))).alias("callee"))
    known = each.groupBy("callee").agg(F.max_by("id", F.struct("path", "line_no", "id")).alias("to"))
    met = checkpoint(python_calls(lexed, tokens, symbols).join(known, "callee").where("source <> to"))
    sure: Column = F.when(F.col("dotted"), "Semantic").otherwise("Heuristic")
    none = F.lit(None).cast("string")
    rank = F.max(F.when(F.col("dotted"), 1).otherwise(0))
    calls = met.groupBy("source", F.col("to").alias("target")).agg(rank.alias("r")).select("source", "target", F.lit("Calls").alias("type"), F.when(F.col("r") == 1, "Semantic").otherwise("Heuristic").alias("confidence"), none.alias("kind"), none.alias("label"), none.alias("evidence"))
    flows = met.select(F.col("to").alias("source"), F.col("source").alias("target"), F.lit("DataFlow").alias("type"), sure.alias("confidence"), F.when(F.col("assigned"), "Assignment").otherwise("ReturnValue").alias("kind"), F.col("callee").alias("label"), F.col("text").alias("evidence"))
    return calls.union(flows.distinct())
