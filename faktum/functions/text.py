"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each language, and the families that languages are compatible in.
EXTENSIONS = {"c": "c h", "cpp": "cc cpp cxx hpp hh hxx", "go": "go", "java": "java", "javascript": "js jsx mjs cjs", "python": "py pyi", "rust": "rs", "typescript": "ts tsx"}
FAMILIES = {"c": ("c", "cpp", "c++"), "js": ("javascript", "typescript", "tsx", "jsx")}


def module_of(path: Column) -> Column:
    """The path up to its last slash, with it; '' without one."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9+]+)$", 1))


def language_of(path: Column, first_line: Column | None = None) -> Column:
    """By extension, else by the interpreter that a first line names; '' if neither tells."""
    out = F.lit("")
    if first_line is not None:
        out = F.when(first_line.rlike(r"^#!.*\bpython"), "python").when(first_line.rlike(r"^#!.*\bnode"), "javascript").otherwise("")
    for name, endings in EXTENSIONS.items():
        out = F.when(extension(path).isin(endings.split()), name).otherwise(out)
    return out


def family(language: Column) -> Column:
    out = language
    for name, members in FAMILIES.items():
        out = F.when(language.isin(*members), name).otherwise(out)
    return out


def identifier_words(name: Column) -> Column:
    """Lower-case words of a camel, snake, kebab or dotted identifier; runs of capitals are one word."""
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[_\-./:()]+", " ")), " +"), lambda x: x != "")


def canonical_type(name: Column) -> Column:
    """A type's last segment without pointer and reference marks; '' for what isn't an identifier path."""
    bare = F.regexp_replace(name, r"[*&\s]", "")
    return F.when(bare.rlike(r"^[A-Za-z_][\w.:]*$"), F.regexp_extract(bare, r"([A-Za-z_]\w*)$", 1)).otherwise("")


def trigrams(text: Column) -> Column:
    """Distinct lower-case runs of three characters."""
    low = F.lower(text)
    n = F.length(low)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def token_estimate(text: Column) -> Column:
    """0.3 a character in ASCII and 0.6 for others, rounded up (in tenths, so that no fraction is lost)."""
    plain = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil((3 * plain + 6 * (F.length(text) - plain)) / 10).cast("long")


def route_parts(label: Column) -> tuple[Column, Column]:
    """Method and path of 'METHOD /path'."""
    return F.substring_index(label, " ", 1), F.when(F.instr(label, " ") > 0, F.substring(label, F.instr(label, " ") + 1, F.length(label))).otherwise("")


def idf(documents: Column, holding: Column) -> Column:
    return F.least(F.lit(3.0), F.log(1 + documents / (1 + holding)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def import_paths(text: Column) -> Column:
    """What an import's text refers to: quoted names, Rust 'use' paths, Python 'from' modules."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), 1), F.regexp_extract_all(text, F.lit(r"\buse\s+([\w:]+)"), 1), F.regexp_extract_all(text, F.lit(r"\bfrom\s+([\w.]+)\s+import"), 1)))


def relative_path(base: Column, spec: Column) -> Column:
    """A relative import's path from its file's folder, with '.' and '..' taken out."""
    parts = F.filter(F.split(F.concat(module_of(base), spec), "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))))
    return F.array_join(kept, "/")


def pascal(text: Column) -> Column:
    """Words joined, each with its first letter in upper case and the rest as it is."""
    words = F.filter(F.split(text, r"[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def contract_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[- \t]", "")


def filled(template: Column, **values: Column) -> Column:
    """{key} replaced by the value of each key; unknown keys stay."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def file_in_snippet(snippet: Column) -> Column:
    return F.regexp_extract(snippet, r"\(([^()]*)\)[^)]*$", 1)


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("_test.") | low.contains("/tests/") | low.contains("_spec.") | low.contains("/benches/") | low.contains("__test__")
