"""Symbols and edges from source lines."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import indent, split_lines, strip
from ..sources.files import language, suffix

# The patterns that name a line's kind, as whole-line prefixes with Unicode words.
PY_CLASS = r"(?U)^(\s*)class\s+(\w+)"
PY_DEF = r"(?U)^(\s*)def\s+(\w+)\s*\("
PY_IMPORT = r"(?U)^\s*(?:from\s+[\w.]+\s+import\s+.+|import\s+.+)$"
PY_CALL = r"(?U)(\w+)\s*\("
PY_VARIABLE = r"(?U)^(\w+)\s*[:=]"
OTHER_CLASS = r"(?U)^\s*(?:export\s+)?class\s+(\w+)"
OTHER_FUNCTION = r"(?U)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\("
OTHER_CONSTANT = r"(?U)^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\("
OTHER_IMPORT = r"(?U)^\s*import\s+.+"
NOT_CALLS = ["if", "for", "while", "print", "len", "range"]
MODULE = "<module>"


def lines(files: DataFrame, bodies: bool = False) -> DataFrame:
    """file, n (from 1), line, indent, python, kind, name, owner, end_line of each line of files (path, text); with bodies the named lines' `body`.

    end_line is that of the block of a Python class, function or method, else null. A file's lines are passed within its row: nothing is
    shuffled, and a task's memory hangs on its largest file.
    """
    each = files.select(F.col("path").alias("file"), (suffix(F.col("path")) == ".py").alias("python"), F.transform(split_lines(F.col("text")), lambda x: F.struct(x.alias("line"), indent(x).alias("indent"))).alias("rows"))
    each = each.withColumn("rows", F.transform("rows", lambda x: x.withField("kind", _kind(x["line"], x["indent"]))))
    each = each.withColumn("rows", F.transform("rows", lambda x: x.withField("name", _name(x["line"], x["kind"]))))
    mark = F.when(F.col("python"), F.lit(1)).otherwise(F.lit(0))
    code = lambda x: F.when(x["indent"] == F.length(x["line"]), -1).otherwise(4 * x["indent"] + mark * F.when(x["kind"] == "class", 1).when(x["kind"].isin("function", "method"), 2).otherwise(0))
    each = each.withColumn("seen", F.arrow_udf(_passed, "array<struct<owner:int,end_line:int>>")(F.transform("rows", code)))
    whole = lambda x, i: F.struct(
        x["line"].alias("line"), x["indent"].alias("indent"), x["kind"].alias("kind"), x["name"].alias("name"),
        F.coalesce(F.get("rows", F.get("seen", i)["owner"] - 1)["name"], F.lit(MODULE)).alias("owner"), F.get("seen", i)["end_line"].alias("end_line"),
        *([F.when(x["name"].isNotNull(), F.array_join(F.transform(F.slice("rows", i + 1, F.coalesce(F.get("seen", i)["end_line"], i + 1) - i), lambda y: y["line"]), "\n")).alias("body")] if bodies else []),
    )
    each = each.select("file", "python", F.posexplode(F.transform("rows", whole)).alias("p", "e"))
    return each.select("file", (F.col("p") + 1).alias("n"), "e.line", "e.indent", "python", "e.kind", "e.name", "e.owner", "e.end_line", *(["e.body"] if bodies else []))


def _kind(line: Column, depth: Column) -> Column:
    variable = (depth == 0) & line.rlike(PY_VARIABLE) & ~line.startswith("def") & ~line.startswith("class")
    python = F.when(line.rlike(PY_CLASS), "class").when(line.rlike(PY_DEF), F.when(depth > 0, "method").otherwise("function")).when(line.rlike(PY_IMPORT), "import").when(variable, "variable")
    other = F.when(line.rlike(OTHER_CLASS), "class").when(line.rlike(OTHER_FUNCTION) | line.rlike(OTHER_CONSTANT), "function").when(line.rlike(OTHER_IMPORT), "import")
    return F.when(F.col("python"), python).otherwise(other)


def _name(line: Column, kind: Column) -> Column:
    first = lambda p, g: F.regexp_extract(line, p, g)
    python = F.when(kind == "class", first(PY_CLASS, 2)).when(kind.isin("method", "function"), first(PY_DEF, 2)).when(kind == "variable", first(PY_VARIABLE, 1))
    function = F.when(line.rlike(OTHER_FUNCTION), first(OTHER_FUNCTION, 1)).otherwise(first(OTHER_CONSTANT, 1))
    return F.when(F.col("python"), python).otherwise(F.when(kind == "class", first(OTHER_CLASS, 1)).when(kind == "function", function))


def _passed(files: pa.Array) -> pa.Array:
    """For each file's lines in order (-1 where blank, else four times the depth, and 1 for a class, 2 for a def): the line of the owning class, 0 without
    one, and the last line of each head's block. The owner is the last class, until a def no deeper than that class comes. One pass with a stack of open heads, whose depths grow.
    """
    owners, ends = [], []
    for rows in files:
        owner, class_depth, open_, end = 0, -1, [], [None] * len(rows)
        for n, x in enumerate(rows.values.to_pylist(), 1):
            if x >= 0:
                depth, kind = x >> 2, x & 3
                while open_ and open_[-1][0] >= depth:
                    end[open_.pop()[1] - 1] = n - 1
                if kind:
                    open_.append((depth, n))
                if kind == 1:
                    owner, class_depth = n, depth
                elif kind == 2 and depth <= class_depth:
                    owner = 0
            owners.append(owner)
        for _, n in open_:
            end[n - 1] = len(end)
        ends += end
    sizes = pc.fill_null(pc.list_value_length(files), 0).to_numpy(zero_copy_only=False)
    places = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(places, pa.StructArray.from_arrays([pa.array(owners, pa.int32()), pa.array(ends, pa.int32())], ["owner", "end_line"]))


def block_ends(numbered: DataFrame) -> DataFrame:
    """file, n, end_line of Python classes, functions and methods: the line before the first later one, not blank, that is no deeper."""
    return numbered.filter("end_line IS NOT NULL").select("file", "n", "end_line")


def parse(files: DataFrame, parsers: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges of files (path, text). parsers: for a language, what makes its files' symbols and edges instead of the patterns."""
    kinds = language(F.col("path"))
    plain = files.filter(~kinds.isin(list(parsers)) | kinds.isNull()) if parsers else files
    numbered = lines(plain)
    out = symbols(numbered), edges(numbered)
    for name, parser in (parsers or {}).items():
        own = parser(files.filter(kinds == name))
        out = tuple(a.unionByName(b.select(*a.columns)) for a, b in zip(out, own, strict=True))
    return out


def symbols(numbered: DataFrame) -> DataFrame:
    """file, name, kind, start_line, end_line, signature, and body if the lines have it."""
    found = numbered.filter(F.col("name").isNotNull())
    signature = F.when(F.col("kind") == "variable", F.substring(strip(F.col("line")), 1, 80)).otherwise(strip(F.col("line")))
    return found.select("file", "name", "kind", F.col("n").alias("start_line"), F.coalesce("end_line", "n").alias("end_line"), signature.alias("signature"), *(["body"] if "body" in numbered.columns else []))


def edges(numbered: DataFrame) -> DataFrame:
    """src, dst, kind, file, n, pos: imports of modules and calls by owners."""
    imports = numbered.filter("kind = 'import'").select(F.lit(MODULE).alias("src"), F.substring(strip(F.col("line")), 1, 80).alias("dst"), F.lit("imports").alias("kind"), "file", "n", F.lit(0).alias("pos"))
    body = numbered.filter(F.col("python") & (F.col("kind").isNull() | (F.col("kind") == "variable")))
    calls = body.select("owner", "file", "n", F.posexplode(F.regexp_extract_all("line", F.lit(PY_CALL), F.lit(1))).alias("pos", "dst")).filter(~F.col("dst").isin(NOT_CALLS))
    return imports.unionByName(calls.select(F.col("owner").alias("src"), "dst", F.lit("calls").alias("kind"), "file", "n", "pos"))


def find_symbol(table: DataFrame, name: str) -> DataFrame:
    return table.filter(F.col("name") == name).orderBy("kind", "file", "start_line")


def explain(found: DataFrame, files: DataFrame) -> DataFrame:
    """Stored symbols with `body`: their lines, or the signature where the file is missing. Where the files are parsed anyway, lines(files, bodies=True) gives it without a join."""
    from ..functions.text import slice_lines

    body: Column = slice_lines(F.col("text"), F.col("start_line"), F.col("end_line"))
    return found.join(files.select(F.col("path").alias("file"), "text").hint("merge"), "file", "left").withColumn("body", F.coalesce(body, F.col("signature"))).drop("text")
