"""Imports of Python, Go, Java, Rust and C#.

Statements are found in a copy of the text in which comments and strings are blanked, so one
Arrow pass sees each file once; targets stay in the language's spelling, and Python's
relative ones become paths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import Once, Source

_PY_FROM = re.compile(r"from\s+(\.{0,3}[\w.]*)\s+import\s+(.+)\Z", re.A)
_PY_IMPORT = re.compile(r"import\s+([\w.]+)(?:\s+as\s+\w+)?\Z", re.A)
_GO_ONE = re.compile(r"\bimport\s+(?:(\w+|\.)\s+)?\"([^\"]+)\"", re.A)
_GO_GROUP = re.compile(r"\bimport\s*\((.*?)\)", re.S)
_GO_LINE = re.compile(r"(?:(\w+|\.)\s+)?\"([^\"]+)\"", re.A)
_JAVA = re.compile(r"\bimport\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;", re.A)
_RUST_USE = re.compile(r"\buse\s+([\w:]+(?:<[^>]*>)?)\s*(?:::\s*\{([^}]+)\}|::\s*(\*))?\s*;", re.A)
_RUST_MOD = re.compile(r"\b(mod|extern\s+crate)\s+(\w+)\s*;", re.A)
_CSHARP = re.compile(r"(?:\A|\n)\s*(?:global\s+)?using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([A-Z][\w.]*)\s*;", re.A)

#: target, type and imported names
Import = tuple[str, str, list[str]]


def python_target(target: str, path: str) -> str:
    """A relative target as a path: one dot is the file's folder, each further one the folder above."""
    name = target.lstrip(".")
    dots = len(target) - len(name)
    if not dots:
        return target
    folders = path.split("/")[:-1]
    return "/".join([*folders[: max(0, len(folders) - dots + 1)], *filter(None, name.split("."))])


def python_imports(s: Source, path: str) -> Iterator[Import]:
    for line in map(str.strip, s.text.split("\n")):
        if m := _PY_FROM.match(line):
            target, names = m[1], [x for x in (re.split(r"\s+as\s+", n.strip())[0].strip() for n in m[2].split(",")) if x]
            if target == "__future__":
                continue
            if m[2].strip() == "*":
                yield python_target(target, path), "NAMESPACE", []
            elif not target.strip("."):
                # From a package itself: each name is a module.
                yield from ((python_target(target + n, path), "NAMED", [n]) for n in names)
            else:
                yield python_target(target, path), "NAMED", names
        elif m := _PY_IMPORT.match(line):
            yield m[1], "NAMED", []


def go_imports(s: Source, path: str) -> Iterator[Import]:
    first = Once()
    groups = [m for m in _GO_GROUP.finditer(s.text) if s.code.startswith("import", m.start())]
    single = [m for m in _GO_ONE.finditer(s.text) if s.code.startswith("import", m.start()) and not any(g.start(1) <= m.start() < g.end(1) for g in groups)]
    for m in [*single, *(x for g in groups for x in _GO_LINE.finditer(g[1]))]:
        if first(m[2]):
            yield m[2], "PACKAGE", [m[1]] if m[1] else []


def java_imports(s: Source, path: str) -> Iterator[Import]:
    first = Once()
    for m in _JAVA.finditer(s.code):
        package, _, name = m[2].rpartition(".")
        if name == "*":
            found = (package, "WILDCARD", ["*"])
        else:
            found = (package if m[1] else m[2], "PACKAGE", [name])
        if first(found[0], *found[2]):
            yield found


def rust_imports(s: Source, path: str) -> Iterator[Import]:
    first = Once()
    for m in _RUST_USE.finditer(s.code):
        base = m[1]
        names = sorted(x for x in map(str.strip, (m[2] or "").split(",")) if x)
        if m[3]:
            found = (base, "WILDCARD", ["*"])
        elif m[2]:
            found = (base, "NAMED", names)
        else:
            above, _, name = base.rpartition("::")
            found = (above or base, "NAMED", [name])
        if first(base, m[3], *names):
            yield found
    for words in ("mod", "extern"):
        for m in _RUST_MOD.finditer(s.code):
            if m[1].startswith(words) and first(words, m[2]):
                yield m[2], "MODULE", [m[2]]


def csharp_imports(s: Source, path: str) -> Iterator[Import]:
    first = Once()
    for m in _CSHARP.finditer(s.code):
        before = s.text[: m.start()]
        # Inside a method it is a resource, not an import.
        if before.count("{") - before.count("}") < 2 and first(m[2]):
            yield m[2], "MODULE", [m[1]] if m[1] else []


#: The plug-in point: a language's imports.
IMPORTS: dict[str, Callable[[Source, str], Iterator[Import]]] = {"python": python_imports, "go": go_imports, "java": java_imports, "rust": rust_imports, "csharp": csharp_imports}


def _imports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64()]
    for batch in batches:
        rows = []
        for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows += [(path, *x, i) for i, x in enumerate(IMPORTS[language](Source(text or "", language), path or "")) if x[0]]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["source_file", "target_file", "import_type", "imported_names", "seq"])


def other_imports(files: DataFrame) -> DataFrame:
    """(source_file, target_file, import_type, imported_names, seq) of files in the five languages, in the order of the text."""
    own = files.where(F.col("language").isin(*IMPORTS)).select("file_path", "language", "content")
    return own.mapInArrow(_imports, "source_file string, target_file string, import_type string, imported_names array<string>, seq long")
