"""Finding source files, reading them, and turning Python files into records."""

from __future__ import annotations

import ast
import fnmatch
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faktum.functions.text import language_of
from faktum.schema import RECORD, RECORD_KIND

# Folders that are never sources, their prefixes, file endings and names, and folders skipped near the root.
SKIP = ("node_modules", "vendor", "target", "build", "dist", "out", "bin", "obj", "venv", ".venv", "__pycache__", ".git", ".svn", ".hg", ".idea", ".vscode", "third_party", "external", "coverage", "site-packages", "Pods", "bower_components")
SKIP_PREFIXES = ("build_", "cmake-build-", "_build", "tools-", "tools_")
SKIP_SUFFIXES = (".min.js", ".pb.go", ".pb.cc", "_pb2.py", ".generated.cs", ".d.ts", ".map")
SKIP_FILES = ("package-lock.json", "yarn.lock", "Cargo.lock", "go.sum")
SKIP_TOP = ("docs", "doc", "examples", "samples", "scripts")
MOST_BYTES = 5_000_000


def glob_pattern(glob: str) -> str:
    """A regular expression for an ignore pattern: anchored at the root if it has a slash before its end."""
    body = glob.strip("/")
    rooted = "/" in body
    rx = fnmatch.translate(body.replace("**/", "\0")).replace("\0", "(?:.*/)?").removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z")
    return f"^{'' if rooted else '(?:.*/)?'}{rx}(?:/.*)?$"


def indexable(path: Column, ignore: tuple[str, ...] = ()) -> Column:
    """Whether a path relative to the root is a source file to read. Lines of an ignore file that begin with '!' or '#' have no effect."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    bad = F.exists(folders, lambda c: c.isin(*SKIP)) | F.exists(folders, lambda c: c.rlike("^(" + "|".join(p.replace("-", r"\-") for p in SKIP_PREFIXES) + ")"))
    bad = bad | F.exists(F.slice(folders, 1, 3), lambda c: c.isin(*SKIP_TOP)) | name.isin(*SKIP_FILES)
    for s in SKIP_SUFFIXES:
        bad = bad | name.endswith(s)
    for g in ignore:
        if g and g[0] not in "#!":
            bad = bad | path.rlike(glob_pattern(g))
    return ~bad


def discover(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), most: int = MOST_BYTES) -> DataFrame:
    """(path, language, content) of the sources under root; path is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    rel = F.replace(full, F.lit(base), F.lit(""))
    text = F.col("content").cast("string")
    x = files.filter(F.col("length") < most).select(rel.alias("path"), text.alias("content"))
    x = x.filter(indexable(F.col("path"), ignore)).withColumn("language", language_of(F.col("path"), F.substring_index("content", "\n", 1)))
    return x.filter("language <> ''").select("path", "language", "content")


def documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(file_path, content, type) of documentation files."""
    return spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("content"), F.lit(0).alias("type"))


class _Reader(ast.NodeVisitor):
    """The records of one Python file, in order of place."""

    def __init__(self, path: str) -> None:
        self.path, self.rows, self.stack, self.names = path, [], [-1], []

    def add(self, kind: str, name: str, node: ast.AST, arity: int = 0, receiver: str = "", call_kind: int = 0) -> int:
        me = len(self.rows)
        qualified = ".".join([*self.names, name]) if kind in ("function", "method", "class", "variable") else name
        self.rows.append((me, RECORD_KIND[kind], name, qualified, self.stack[-1], "python", self.path, node.lineno - 1, node.col_offset, (node.end_lineno or node.lineno) - 1, node.end_col_offset or 0, arity, receiver, call_kind, ""))
        return me

    def _inside(self, me: int, name: str, node: ast.AST) -> None:
        self.stack.append(me)
        self.names.append(name)
        self.generic_visit(node)
        self.names.pop()
        self.stack.pop()

    def _function(self, node) -> None:
        own = self.stack[-1] >= 0 and self.rows[self.stack[-1]][1] == RECORD_KIND["class"]
        a = node.args
        count = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) - own
        self._inside(self.add("method" if own else "function", node.name, node, max(0, count)), node.name, node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node) -> None:
        self._inside(self.add("class", node.name, node), node.name, node)

    def visit_Call(self, node) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self.add("call", f.id, node, len(node.args) + len(node.keywords))
        elif isinstance(f, ast.Attribute):
            self.add("call", f.attr, node, len(node.args) + len(node.keywords), ast.unparse(f.value), 1)
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.add("import", a.name, node)

    def visit_ImportFrom(self, node) -> None:
        for a in node.names:
            self.add("import_binding", f"{'.' * node.level}{node.module or ''}.{a.name}", node)

    def visit_ExceptHandler(self, node) -> None:
        if node.type is None:
            self.add("unit", "except", node)
            last = list(self.rows[-1])
            last[3] = ""
            self.rows[-1] = tuple(last)
        self.generic_visit(node)


def parse_python(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of the Python files among (path, language, content). A file that can't be read fails alone."""
    schema = RECORD.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*RECORD.names, "error"]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    reader = _Reader(path)
                    reader.visit(ast.parse(content))
                    rows += [(*r, None) for r in reader.rows]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((*[None] * 6, path, *[None] * 8, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    out = files.filter("language = 'python'").select("path", "content").mapInPandas(run, schema)
    return out.filter("error IS NULL").drop("error"), out.filter("error IS NOT NULL").select("file_path", "error")


def entities(records: DataFrame) -> DataFrame:
    """Entities from records, with ids from a hash of their place, so that no global numbering is needed."""
    kinds = [RECORD_KIND[k] for k in ("function", "method", "class", "interface", "enum", "type_alias")]
    kind = F.element_at(F.array(*map(F.lit, (0, 1, 2, 4, 3, 3))), F.col("kind") + 1)
    e = records.filter(F.col("kind").isin(kinds)).withColumn("id", F.xxhash64("file_path", "start_row", "start_col", "kind"))
    public = F.when(F.col("name").startswith("_"), 0).otherwise(1)
    return e.select("id", kind.alias("kind"), "name", "qualified_name", "file_path", F.regexp_extract("file_path", "^(.*/)", 1).alias("module_path"), "language", "start_row", "end_row", public.alias("visibility"), "arity", "original_id")


def call_sites(records: DataFrame, entity: DataFrame) -> DataFrame:
    """References: each call with the entity around it (the nearest function, through the records' parents by place)."""
    calls = records.filter(F.col("kind") == RECORD_KIND["call"])
    owner = entity.select(F.col("id").alias("caller_id"), "file_path", F.col("original_id").alias("parent_id"))
    x = calls.join(owner, ["file_path", "parent_id"])
    return x.select(F.xxhash64("file_path", "start_row", "start_col", "original_id").alias("ref_id"), "caller_id", "name", "arity", "call_kind", F.lit("").alias("qualified_target"), F.col("receiver").alias("receiver_type"))


def export(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as Parquet in its own folder."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")
