"""Code units, nested blocks and data models: extractors that need brace matching.

Files go through one Arrow pass. A copy of the text in which comments and strings are
blanked, of the same length, is what patterns and the brace matcher see; names and
signatures are cut from the original.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import stable_id
from .lines import complexity, complexity_score

#: Lines a block gets whose end can't be found.
FALLBACK_LINES = 10
JS_FILES = ("javascript", "typescript")

# fixed values: words that name no unit of JavaScript or TypeScript
JS_RESERVED = frozenset(
    "if for while switch catch function class new return throw try typeof void delete instanceof in do else case break continue default finally with "
    "debugger yield await super this null true false undefined NaN Infinity import export extends implements interface type enum namespace module "
    "declare abstract as from get set".split()
)

_SLASH = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_RUST = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)
_HASH = re.compile(r"#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)


class Source:
    """A file's text, its blanked copy, line starts and matching braces."""

    def __init__(self, text: str, language: str):
        self.text = text
        noise = _HASH if language == "python" else _RUST if language == "rust" else _SLASH
        self.code = noise.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[{}]", self.code):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def block_end(self, brace: int) -> int:
        """The line where the block that opens at ``brace`` ends; beyond the file's end where it doesn't."""
        at = self.close.get(brace)
        return self.line(at) if at is not None else len(self.starts) + FALLBACK_LINES

    def block_from(self, at: int) -> int:
        """The same for the first brace from ``at`` on."""
        return self.block_end(self.code.find("{", at))

    def indented_end(self, line: int) -> int:
        """The last line, but for blank ones, before the next that is indented no more than ``line``.

        Comments don't end a block. A block without a line takes the one that ends it.
        """
        depth = lambda x: len(x) - len(x.lstrip())
        lines = self.text.split("\n")
        told = range(line, len(lines))
        last = next((i for i in told if lines[i].strip() and not lines[i].lstrip().startswith("#") and depth(lines[i]) <= depth(lines[line - 1])), None)
        inside = [i + 1 for i in (told if last is None else range(line, last)) if lines[i].strip()]
        return inside[-1] if inside else len(lines) if last is None else line + 1

    def cut(self, m: re.Match, group: int) -> str:
        return self.text[m.start(group) : m.end(group)].strip() if m.start(group) >= 0 else ""


def _signature(parameters: str, returns: str) -> str:
    return f"({parameters}): {returns}" if returns else f"({parameters})"


_JS_FUNCTION = re.compile(r"(export\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)(?:\s*:\s*([^{]+))?\s*\{", re.A)
_JS_ARROW = re.compile(r"(export\s+)?(?:const|let)\s+(\w+)\s*(?::\s*[^=]+)?\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?::\s*([^=]+))?\s*=>", re.A)
_JS_CLASS = re.compile(r"(export\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+([\w.<>]+))?(?:\s+implements\s+([^{]+))?\s*\{", re.A)
_JS_METHOD = re.compile(r"(?:(?:public|private|protected|static|async|readonly|override)\s+)*(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)\s*(?::\s*([^{]+))?\s*\{", re.A)
_JS_INTERFACE = re.compile(r"(export\s+)?interface\s+(\w+)(?:\s+extends\s+([^{]+))?\s*\{", re.A)
_JS_ENUM = re.compile(r"(export\s+)?(?:const\s+)?enum\s+(\w+)\s*\{", re.A)
_JS_ALIAS = re.compile(r"(export\s+)?type\s+(\w+)\s*(?:<[^>]*>)?\s*=", re.A)
#: Lines that an arrow function without a block takes after its first, if there are so many.
EXPRESSION_LINES = 5
ALIAS_CHARS = 100


def _alias_end(s: Source, at: int) -> int | None:
    """The semicolon outside braces and parentheses that ends an alias."""
    depth = 0
    for m in re.compile(r"[{}();]").finditer(s.code, at):
        if m[0] == ";" and depth == 0:
            return m.start()
        depth += (m[0] in "{(") - (m[0] in "})")
    return None


def javascript_units(s: Source) -> Iterator[tuple]:
    """(name, type, first line, last line, signature, async, exported, parent name)."""
    for m in _JS_FUNCTION.finditer(s.code):
        yield m[2], "FUNCTION", s.line(m.start()), s.block_end(m.end() - 1), _signature(s.cut(m, 3), s.cut(m, 4)), "async" in m[0], bool(m[1]), None
    for m in _JS_ARROW.finditer(s.code):
        first, brace, stop = s.line(m.start()), s.code.find("{", m.end()), s.code.find(";", m.end())
        if brace >= 0 and (stop < 0 or brace < stop):
            last = s.block_end(brace)
        else:
            last = first + min(EXPRESSION_LINES, s.code.count("\n", m.end()))
        yield m[2], "ARROW_FUNCTION", first, last, _signature(s.cut(m, 3), s.cut(m, 4)), "async" in m[0], bool(m[1]), None
    for m in _JS_CLASS.finditer(s.code):
        brace = m.end() - 1
        first, last = s.line(m.start()), s.block_end(brace)
        above = [f"{word} {s.cut(m, i)}" for word, i in (("extends", 3), ("implements", 4)) if s.cut(m, i)]
        yield m[2], "CLASS", first, last, " ".join(above) or None, False, bool(m[1]), None
        for k in _JS_METHOD.finditer(s.code, m.start(), s.close.get(brace, len(s.code)) + 1):
            if k[1] != "constructor":
                start = s.line(k.start())
                yield k[1], "METHOD", start, min(last, max(start, s.block_end(k.end() - 1))), _signature(s.cut(k, 2), s.cut(k, 3)), "async" in k[0], False, m[2]
    for m in _JS_INTERFACE.finditer(s.code):
        parents = s.cut(m, 3)
        yield m[2], "INTERFACE", s.line(m.start()), s.block_end(m.end() - 1), f"extends {parents}" if parents else None, False, bool(m[1]), None
    for m in _JS_ENUM.finditer(s.code):
        end = s.close.get(m.end() - 1)
        inside = [] if end is None else [x.strip() for x in re.split(r"[,\n]", s.text[m.end() : end])]
        members = [y for x in inside if x and (y := re.split(r"[\s=]", x)[0])]
        yield m[2], "ENUM", s.line(m.start()), s.block_end(m.end() - 1), f"{{ {', '.join(members)} }}" if members else None, False, bool(m[1]), None
    for m in _JS_ALIAS.finditer(s.code):
        end = _alias_end(s, m.end())
        value = (s.text[m.end() : end] if end is not None else s.text[m.end() :].split("\n")[0]).strip()
        first = s.line(m.start())
        yield m[2], "TYPE_ALIAS", first, first if end is None else s.line(end), value[:ALIAS_CHARS] or None, False, bool(m[1]), None


_PY_DEF = re.compile(r"^([ \t]*)(async[ \t]+)?def[ \t]+(\w+)[ \t]*\(([^)]*)\)(?:[ \t]*->[ \t]*([^:\n]+))?[ \t]*:", re.M | re.A)
_PY_CLASS = re.compile(r"^([ \t]*)class[ \t]+(\w+)(?:\(([^)\n]*)\))?[ \t]*:", re.M | re.A)
_PY_LAMBDA = re.compile(r"^([ \t]*)(\w+)[ \t]*=[ \t]*lambda[ \t]+([^:\n]*):", re.M | re.A)
_PY_ALL = re.compile(r"__all__\s*=\s*\[([^\]]*)\]")


def python_units(s: Source) -> Iterator[tuple]:
    """E02."""
    listed = _PY_ALL.search(s.text)
    names = {x.strip().replace("'", "").replace('"', "") for x in listed[1].split(",")} if listed else None
    exported = lambda name, indent: name in names if names is not None else not (indent or name.startswith("_"))
    classes = []
    for m in _PY_CLASS.finditer(s.code):
        first = s.line(m.start(2))
        last, bases = s.indented_end(first), s.cut(m, 3)
        classes.append((first, last, len(m[1])))
        yield m[2], "CLASS", first, last, f"({bases})" if bases else None, False, exported(m[2], m[1]), None
    for m in _PY_DEF.finditer(s.code):
        first = s.line(m.start(3))
        inside = any(a < first <= b and len(m[1]) > i for a, b, i in classes)
        top, *more = s.text[m.start(4) : m.end(4)].split("\n")
        parameters = " ".join([top, *(x.strip() for x in more)]).strip()
        if inside:
            parameters = ", ".join(x for x in map(str.strip, parameters.split(",")) if x not in ("self", "cls"))
        returns = s.cut(m, 5)
        signature = f"({parameters}) -> {returns}" if returns else f"({parameters})"
        yield m[3], "METHOD" if inside else "FUNCTION", first, s.indented_end(first), signature, bool(m[2]), exported(m[3], m[1]) and not inside, None
    for m in _PY_LAMBDA.finditer(s.code):
        line = s.line(m.start(2))
        yield m[2], "ARROW_FUNCTION", line, line, f"({s.cut(m, 3)})", False, exported(m[2], m[1]), None


# fixed values: words that name no unit
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int "
    "interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var "
    "sealed permits yield".split()
)
RUST_WORDS = frozenset(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where "
    "while async await dyn abstract become box do final macro override priv try typeof unsized virtual yield".split()
)
CSHARP_WORDS = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for "
    "foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed "
    "short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while var record async await dynamic "
    "nameof when yield".split()
)
CSHARP_ACCESSORS = frozenset("get set init add remove".split())


class Once:
    """Whether a key comes for the first time."""

    def __init__(self):
        self.seen: set[tuple] = set()

    def __call__(self, *key) -> bool:
        new = key not in self.seen
        self.seen.add(key)
        return new


_GO_FUNC = re.compile(r"func\s+(?:\(\w+\s+\*?(\w+)\)\s+)?(\w+)\s*\(([^)]*)\)\s*(\([^)]*\)|[^{\n]*)?\s*\{", re.A)
_GO_TYPE = re.compile(r"\btype\s+(\w+)\s+(struct|interface)\s*\{", re.A)


def go_units(s: Source) -> Iterator[tuple]:
    """E03."""
    first = Once()
    for m in _GO_FUNC.finditer(s.code):
        if m[2] not in GO_WORDS and first("func", m[1], m[2]):
            returns = s.cut(m, 4)
            signature = f"({s.cut(m, 3)}) {returns}" if returns else f"({s.cut(m, 3)})"
            yield m[2], "METHOD" if m[1] else "FUNCTION", s.line(m.start()), s.block_from(m.start()), signature, False, m[2][0].isupper(), None
    for m in _GO_TYPE.finditer(s.code):
        if first(m[2], m[1]):
            yield m[1], m[2].upper(), s.line(m.start()), s.block_from(m.start()), None, False, m[1][0].isupper(), None


# fixed values: by keyword, the unit's type, the words that may stand before it, and what may follow its name
JAVA_TYPES = (
    ("class", "CLASS", "public private protected abstract final static sealed strictfp", r"(?:<[^>]*>)?(?:\s+extends\s+[\w.<>,\s]+)?(?:\s+implements\s+[^{]+)?\s*\{"),
    ("interface", "INTERFACE", "public private protected abstract static sealed strictfp", r"(?:<[^>]*>)?(?:\s+extends\s+[^{]+)?\s*\{"),
    ("enum", "ENUM", "public private protected static strictfp", r"(?:\s+implements\s+[^{]+)?\s*\{"),
    ("record", "CLASS", "public private protected static final sealed", r"\s*\([^)]*\)(?:\s+implements\s+[^{]+)?\s*\{"),
)
CSHARP_TYPES = (
    ("class", "CLASS", "public private protected internal static abstract sealed partial new", r"(?:<[^>]*>)?(?:\s*:\s*[^{]+)?\s*\{"),
    ("record", "CLASS", "public private protected internal static abstract sealed partial", r"(?:<[^>]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*[^{;]+)?\s*[{;]"),
    ("struct", "STRUCT", "public private protected internal readonly partial ref", r"(?:<[^>]*>)?(?:\s*:\s*[^{]+)?\s*\{"),
    ("interface", "INTERFACE", "public private protected internal partial", r"(?:<[^>]*>)?(?:\s*:\s*[^{]+)?\s*\{"),
    ("enum", "ENUM", "public private protected internal", r"(?:\s*:\s*\w+)?\s*\{"),
)
JAVA_MODIFIERS = "public private protected static final abstract synchronized native default strictfp"
CSHARP_MODIFIERS = "public private protected internal static abstract virtual override sealed async extern new readonly unsafe volatile partial"


def _before(words: str) -> str:
    return rf"(?:(?:{'|'.join(words.split())})\s+)*"


def _declarations(table: tuple) -> tuple:
    kinds = {"record": r"record\s+(?:class\s+|struct\s+)?"} if table is CSHARP_TYPES else {}
    return tuple((word, kind, re.compile(_before(words) + kinds.get(word, word + r"\s+") + r"(\w+)" + rest, re.A)) for word, kind, words, rest in table)


_JAVA_TYPES, _CSHARP_TYPES = _declarations(JAVA_TYPES), _declarations(CSHARP_TYPES)
_JAVA_METHOD = re.compile(
    rf"(?:@\w+(?:\([^)]*\))?\s*)*{_before(JAVA_MODIFIERS)}(?:<[^>]+>\s+)?(?:([\w.<>,\[\]]+)\s+)?(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w.,\s]+)?\s*\{{", re.A
)
_CSHARP_METHOD = re.compile(
    rf"(?:\A|\n)\s*({_before(CSHARP_MODIFIERS)})(?:(\w[\w<>\[\],\s?]*?)\s+)?(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)\s*(?:where\s+\w+\s*:[^{{]*?)?\s*\{{", re.A
)


def _type_units(s: Source, table: tuple, first: Once) -> Iterator[tuple]:
    for word, kind, pattern in table:
        for m in pattern.finditer(s.code):
            if first(word, m[1]):
                line = s.line(m.start())
                yield m[1], kind, line, s.block_from(m.start()) if m[0].endswith("{") else line, None, False, "public" in m[0], None


def java_units(s: Source) -> Iterator[tuple]:
    """Methods belong to the last declared class, interface or record around them; the first of a name counts."""
    first, owners = Once(), []
    for u in _type_units(s, _JAVA_TYPES, first):
        if u[1] != "ENUM":
            owners.append(u)
        yield u
    for m in _JAVA_METHOD.finditer(s.code):
        line, returns = s.line(m.start()), s.cut(m, 1)
        around = [u[0] for u in owners if u[2] < line <= u[3]]
        if m[2] in JAVA_WORDS or not around:
            continue
        key = ("constructor", around[-1]) if m[2] == around[-1] and not returns else ("method", around[-1], m[2])
        if first(*key):
            yield m[2], "METHOD", line, s.block_from(m.start()), _signature(s.cut(m, 3), returns), False, "public" in m[0], None


def csharp_units(s: Source) -> Iterator[tuple]:
    """Methods belong to the innermost type around them; the first of a name counts."""
    first, owners = Once(), []
    for u in _type_units(s, _CSHARP_TYPES, first):
        if u[1] != "ENUM":
            owners.append(u)
        yield u
    names = {u[0] for u in owners}
    for m in _CSHARP_METHOD.finditer(s.code):
        modifiers, returns, name = m[1].strip(), s.cut(m, 2), m[3]
        # Without modifiers or a type only a constructor is told from a statement.
        if name in CSHARP_ACCESSORS or name not in names and (name in CSHARP_WORDS or not (modifiers or returns)):
            continue
        line = s.line(m.start() + (s.code[m.start()] == "\n"))
        around = max(((u[2], u[0]) for u in owners if u[2] < line <= u[3]), default=(0, None))[1]
        if first("method", around, name):
            yield name, "METHOD", line, s.block_from(m.start()), _signature(s.cut(m, 4), returns), "async" in modifiers, "public" in modifiers, None


_RS_IMPL = re.compile(r"\bimpl\s*(?:<[^>]*>\s*)?(\w+)(?:\s+for\s+(\w+))?\s*\{", re.A)
_RS_FN = re.compile(r"\bfn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)\s*(?:->\s*([^{]+?))?\s*\{", re.A)
_RS_TYPES = (
    ("STRUCT", re.compile(r"\bstruct\s+(\w+)(?:<[^>]*>)?\s*[({;]", re.A)),
    ("ENUM", re.compile(r"\benum\s+(\w+)(?:<[^>]*>)?\s*\{", re.A)),
    ("INTERFACE", re.compile(r"\btrait\s+(\w+)(?:<[^>]*>)?\s*(?::[^{]*)?\{", re.A)),
)


def rust_units(s: Source) -> Iterator[tuple]:
    """Functions within the lines of an impl block are methods of its type; what stands before on the line tells pub and async."""
    first = Once()
    has = lambda m, word: bool(re.search(rf"\b{word}\b", s.code[s.starts[s.line(m.start()) - 1] : m.start()]))
    blocks = [(m[2] or m[1], f"impl {m[1]} for {m[2]}" if m[2] else f"impl {m[1]}", s.line(m.start()), s.block_from(m.start())) for m in _RS_IMPL.finditer(s.code)]
    # Blocks for traits come first.
    blocks.sort(key=lambda x: " for " not in x[1])
    for _, name, start, end in blocks:
        yield name, "IMPL_BLOCK", start, end, None, False, False, None
    for m in _RS_FN.finditer(s.code):
        start, end, returns = s.line(m.start()), s.block_from(m.start()), s.cut(m, 3)
        owner = next((t for t, _, a, b in blocks if a <= start and end <= b), None)
        if m[1] not in RUST_WORDS and first("fn", owner, m[1]):
            signature = f"({s.cut(m, 2)}) -> {returns}" if returns else f"({s.cut(m, 2)})"
            yield m[1], "METHOD" if owner else "FUNCTION", start, end, signature, has(m, "async"), has(m, "pub"), None
    for kind, pattern in _RS_TYPES:
        for m in pattern.finditer(s.code):
            if m[1] not in RUST_WORDS and first(kind, m[1]):
                start = s.line(m.start())
                yield m[1], kind, start, s.block_from(m.start()) if m[0].endswith("{") else start, None, False, has(m, "pub"), None


#: The plug-in point: a language's extractor of units.
EXTRACTORS: dict[str, Callable[[Source], Iterator[tuple]]] = {
    "javascript": javascript_units, "typescript": javascript_units, "python": python_units, "go": go_units, "java": java_units, "rust": rust_units, "csharp": csharp_units,
}

UNIT_ROW = "file_path string, language string, name string, unit_type string, line_start int, line_end int, signature string, is_async boolean, is_exported boolean, parent string, ord int, parent_line int, body string"


def units_in(text: str, language: str) -> list[tuple]:
    """Units of one file in order of lines; in JavaScript and TypeScript the first of a type, name and parent counts."""
    found = EXTRACTORS[language](Source(text, language)) if language in EXTRACTORS else ()
    first = Once()
    if language in JS_FILES:
        found = (u for u in found if u[0] not in JS_RESERVED and first(u[1], u[0], u[7]))
    return sorted(((*u[:3], max(u[2], u[3]), *u[4:]) for u in found), key=lambda u: u[2])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of files with their bodies, and for a method the line of its class: the last of that name above it."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows = []
        for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            lines, classes = (text or "").split("\n"), {}
            for i, u in enumerate(units_in(text or "", language)):
                rows.append((path, language, *u, i, classes.get(u[7]), "\n".join(lines[max(u[2], 1) - 1 : u[3]])))
                if u[1] == "CLASS":
                    classes[u[0]] = u[2]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in UNIT_ROW.split(", ")])


def units_with_bodies(files: DataFrame) -> DataFrame:
    """The code_units table of files (file_path, content, language) and each unit's ``body``, in one pass without a shuffle."""
    rows = files.where("language IS NOT NULL AND content IS NOT NULL").select("file_path", "language", "content").mapInArrow(_units, UNIT_ROW)
    parent = stable_id("file_path", F.lit("CLASS"), "parent", "parent_line", F.lit(None))
    scored = rows.withColumn("complexity", complexity(F.col("body"), F.col("language"), F.col("signature")))
    return scored.select(
        stable_id("file_path", "unit_type", "name", "line_start", "parent").alias("id"), "file_path", "name", "unit_type", "line_start", "line_end",
        F.when(F.col("parent_line").isNotNull(), parent).alias("parent_unit_id"), "signature", "is_async", "is_exported", "language", "complexity",
        complexity_score(F.col("complexity")).alias("complexity_score"), (F.xxhash64("file_path").bitwiseAND(F.lit(0x7FFFFFFFFFFF)) * 65536 + F.col("ord")).alias("seq"), "body",
    )


def code_units(files: DataFrame) -> DataFrame:
    """The code_units table of files (file_path, content, language), with complexity."""
    return units_with_bodies(files).drop("body")


def bodies_of(units: DataFrame) -> DataFrame:
    """(unit_id, unit_type, language, body) of units that were extracted with their bodies."""
    return units.select(F.col("id").alias("unit_id"), "unit_type", "language", "body")


def _braced(text: str, at: int) -> str | None:
    depth = 0
    for m in re.finditer(r"[{}]", text[at:]):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return text[at + 1 : at + m.start()]
    return None


def prisma_models(text: str, path: str) -> Iterator[tuple]:
    """(name, framework, table, fields); a field is (name, type, key, required, unique, default, target)."""
    if not path.endswith(".prisma"):
        return
    for m in re.finditer(r"^model\s+(\w+)\s*\{", text, re.M):
        block = _braced(text, m.end() - 1)
        if block is None:
            continue
        fields = []
        for line in map(str.strip, block.split("\n")):
            f = re.match(r"(\w+)\s+(\w+)(\?|\[\])?\s*(.*)\Z", line) if line and not line.startswith(("//", "@@")) else None
            if f:
                listed, rest = f[3] == "[]", f[4]
                fields.append((f[1], f[2] + ("[]" if listed else ""), bool(re.search(r"@id\b", rest)), f[3] != "?", "@unique" in rest, "@default" in rest, f[2] if "@relation" in rest else None))
        table = re.search(r"@@map\s*\(\s*\"([^\"]+)\"", block)
        yield m[1], "prisma", table[1] if table else None, fields


_ENTITY = re.compile(r"@Entity\s*\(\s*(?:'([^']*)'|\"([^\"]*)\")?\s*\)\s*\n\s*class\s+(\w+)", re.A)
_ENTITY_FIELD = re.compile(r"(\w+)\s*[:!?]\s*(\w+[\[\]]*)", re.A)
_ENTITY_LINK = re.compile(r"@(?:One|Many)To(?:One|Many)\s*\(\s*\(\)\s*=>\s*(\w+)", re.A)


def typeorm_models(text: str, path: str) -> Iterator[tuple]:
    """Entities whose decorator, bare or with a table name, is directly followed by the line of the class.

    A field is the line after its decorators, as ``name: Type``; no other line keeps them.
    """
    for m in _ENTITY.finditer(text):
        block = _braced(text, at) if (at := text.find("{", m.end())) >= 0 else None
        if block is None:
            continue
        fields, held = [], []
        for line in filter(None, map(str.strip, block.split("\n"))):
            if line.startswith("@"):
                held.append(line)
                continue
            if held and (f := _ENTITY_FIELD.match(line)):
                said = "\n".join(held)
                generated, target = "@PrimaryGeneratedColumn" in said, _ENTITY_LINK.findall(said)
                fields.append((
                    f[1], f[2], generated or "@PrimaryColumn" in said, not re.search("nullable: ?true", said), bool(re.search("unique: ?true", said)),
                    generated or bool(re.search(r"default\s*:", said)), target[-1] if target else None,
                ))
            held = []
        yield m[3], "typeorm", m[1] or m[2] or None, fields


# fixed values: options of a field, which are no fields
MONGOOSE_OPTIONS = frozenset("type required unique default ref enum index".split())
_MONGOOSE = re.compile(r"(?:const|let|var)\s+(\w+)\s*=\s*new\s+(?:mongoose\.)?Schema\s*\(\s*\{", re.A)


def mongoose_models(text: str, path: str) -> Iterator[tuple]:
    """Fields given by a type or by an object of options."""
    for m in _MONGOOSE.finditer(text):
        block = _braced(text, m.end() - 1)
        if block is None:
            continue
        fields = []
        for name, value in re.findall(r"(\w+)\s*:\s*(\{[^}]*\}|[A-Z]\w*)", block, re.A):
            if name in MONGOOSE_OPTIONS:
                continue
            kind, target = value, None
            if value.startswith("{"):
                said = re.search(r"type\s*:\s*([\w.]+)", value, re.A)
                kind = said[1].replace("Schema.Types.", "", 1) if said else "Mixed"
                target = re.search(r"ref\s*:\s*['\"](\w+)['\"]", value, re.A)
            on = lambda option, v=value: v.startswith("{") and bool(re.search(rf"{option}\s*:\s*true", v))
            fields.append((name, kind, name == "_id", on("required"), on("unique"), value.startswith("{") and bool(re.search(r"default\s*:", value)), target[1] if target else None))
        yield m[1].removesuffix("Schema"), "mongoose", None, fields


_DRIZZLE = re.compile(r"(?:const|let)\s+(\w+)\s*=\s*(?:pg|mysql|sqlite)Table\s*\(\s*['\"](\w+)['\"]\s*,\s*\{", re.A)
_DRIZZLE_FIELD = re.compile(r"(\w+)\s*:\s*(\w+)\s*\([^)]*\).*?(?=,\s*\n|\n\s*\})", re.A | re.S)


def drizzle_models(text: str, path: str) -> Iterator[tuple]:
    """Fields that end in a comma at the line's end, with the calls chained to their type."""
    for m in _DRIZZLE.finditer(text):
        block = _braced(text, m.end() - 1)
        if block is None:
            continue
        fields = []
        for f in _DRIZZLE_FIELD.finditer(block):
            calls = lambda name, chain=f[0]: bool(re.search(rf"\.{name}\s*\(", chain))
            target = re.search(r"\.references\s*\(\s*\(\)\s*=>\s*(\w+)\.", f[0], re.A)
            fields.append((f[1], f[2], calls("primaryKey"), calls("notNull"), calls("unique"), calls("default"), target[1] if target else None))
        yield m[1], "drizzle", m[2], fields


#: Every parser gets every file.
PARSERS = (prisma_models, typeorm_models, mongoose_models, drizzle_models)
FIELD = "struct<name:string,field_type:string,is_primary_key:boolean,is_required:boolean,is_unique:boolean,has_default:boolean,relation_target:string>"


def _models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("name", "field_type", "is_primary_key", "is_required", "is_unique", "has_default", "relation_target")
    field = pa.struct([(n, pa.bool_() if n[:3] in ("is_", "has") else pa.string()) for n in names])
    for batch in batches:
        rows = [(path, name, framework, tab, [dict(zip(names, f, strict=True)) for f in fields])
                for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for parse in PARSERS for name, framework, tab, fields in parse(text or "", path or "")]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string()] * 4 + [pa.list_(field)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_path", "name", "framework", "table_name", "fields"])


def schema_models(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """schema_models and schema_model_fields."""
    found = files.select("file_path", "content").mapInArrow(_models, f"file_path string, name string, framework string, table_name string, fields array<{FIELD}>")
    found = found.withColumn("id", stable_id("file_path", "framework", "name"))
    models = found.select("id", "name", "file_path", "framework", "table_name")
    fields = found.select(F.col("id").alias("model_id"), F.posexplode("fields").alias("i", "f")).select(stable_id("model_id", "i", "f.name").alias("id"), "model_id", "f.*")
    return models, fields


def test_structure(files: DataFrame) -> DataFrame:
    """(file_path, imports, test_count, setup) of test files."""
    imports = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^(import\s[^\n]+)"), F.lit(1)))
    tests = F.regexp_count("content", F.lit(r"(?<![A-Za-z0-9_.])it\s*\("))
    setup = F.nullif(F.regexp_extract("content", r"(?<![A-Za-z0-9_.])((?:beforeEach|beforeAll)\s*\([^\n]*)", 1), F.lit(""))
    return files.select("file_path", imports.alias("imports"), tests.cast("long").alias("test_count"), setup.alias("setup"))
