"""Symbols, imports and references of languages that have no parser here, read from their tokens.

Comments and strings are blanked out first (places stay), brackets are matched, and declarations are recognised by their
keywords or, for functions of C-like languages, by their shape: a name, a parameter list and a body, standing where
declarations can stand. What is declared inside of a function is local and left out. This is scanning, not parsing:
macros that hide brackets and generated code can mislead it, and it says nothing about syntax errors.

Items are (kind, name, parent, begin line, end line, begin byte, end byte); an item runs to the end of its body.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

Item = tuple[str, str, str | None, int, int, int, int]

SLASHES = r"//[^\n]*|/\*.*?\*/"
QUOTED = r'"(?:\\.|[^"\\\n])*"'
SINGLE = r"'(?:\\.|[^'\\\n])*'"
TYPES = {"class", "struct", "interface", "enum", "record", "union", "trait", "impl", "protocol", "annotation",
         "class_interface", "class_implementation", "category", "namespace", "mod", "component"}
#: Containers that hold declarations without being their parent.
CLEAR = {"namespace", "mod"}
#: Words before a parenthesis that are no function's name.
NO_NAME = set(
    "if for while switch catch return else do sizeof typeof new throw when match using lock synchronized function fn func "
    "fun defer guard alignof decltype elif unless until super this assert and or not in is await yield".split()
)


@dataclass(frozen=True)
class Language:
    skip: str  # comments and strings
    declarations: list[tuple[str, str]]  # kind, and an expression with a group `name` and perhaps `parent`
    imports: list[tuple[str, str | None]]  # an expression with one group, and one that finds the specs in it
    shape: str = ""  # functions by shape: what may stand between parameters and body
    bases: str = ""  # supertypes behind a type's name
    newline: bool = False  # a declaration without a body ends with its line
    bodies: str = "brace"
    flags: int = 0
    keep_strings: bool = False
    heads: dict[str, str] = field(default_factory=dict)


def _named(kinds: str, before: str = r"\b") -> list[tuple[str, str]]:
    """Declarations of the form `keyword Name`."""
    pairs = (k.split("=") if "=" in k else (k, k) for k in kinds.split())
    return [(kind, rf"{before}{word}\s+(?P<name>[A-Za-z_$][\w$]*)") for word, kind in pairs]


_SCRIPT = Language(
    skip=rf"{SLASHES}|{QUOTED}|{SINGLE}|`(?:\\.|[^`\\])*`",
    declarations=[
        *_named("class interface enum"),
        ("type", r"\btype\s+(?P<name>[\w$]+)\s*(?:<[^=;{}]*>)?\s*="),
        ("function", r"\bfunction\b\s*\*?\s*(?P<name>[\w$]+)"),
        ("function", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;\n]*)?=\s*(?:async\s*)?"
                     r"(?:function\b|\([^()\n]*\)\s*(?::[^=;{}\n]*)?=>|[\w$]+\s*=>)"),
    ],
    imports=[
        (r"\b(?:import|export)\s+(?:[\w*\s{},$]+?\s+from\s+)?[\"']([^\"'\n]+)[\"']", None),
        (r"\b(?:require|import)\s*\(\s*[\"']([^\"'\n]+)", None),
    ],
    shape=r"\s*(?::[^;{}()=]*)?\{",
    bases=r"(?:extends|implements)\s+([\w$.,\s]+)",
    newline=True,
)
_C_ITEMS = [
    ("macro", r"(?m)^[ \t]*#[ \t]*define[ \t]+(?P<name>\w+)"),
    *((k, rf"\b{k}\s+(?:class\s+)?(?P<name>\w+)[^;(){{}}=]*(?=\{{)") for k in ("struct", "union", "enum")),
    ("typedef", r"(?m)^typedef\b[^;{}()]*\b(?P<name>\w+)\s*;"),
]
_INCLUDES = [(r"(?m)^[ \t]*#[ \t]*(?:include|import)[ \t]*[<\"]([^>\"\n]+)", None)]
_C = Language(
    skip=rf"{SLASHES}|(?<!#include ){QUOTED}|{SINGLE}", declarations=_C_ITEMS, imports=_INCLUDES, shape=r"\s*(?:__\w+(?:\([^()]*\))?\s*)*\{"
)
LANGUAGES: dict[str, Language] = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "rust": Language(
        skip=rf"{SLASHES}|r(#+)\".*?\"\1|{QUOTED}|'(?:\\[^']*|[^'\\])'",
        declarations=[
            *_named("fn=function struct enum trait mod type=type_alias union"),
            ("const", r"\bconst\s+(?P<name>\w+)\s*:"),
            ("static", r"\bstatic\s+(?:mut\s+)?(?P<name>\w+)\s*:"),
            ("impl", r"\bimpl\b\s*(?:<[^{};]*?>\s*)?(?:[\w:<>, &']+?\s+for\s+)?&?(?:dyn\s+)?(?:\w+::)*(?P<name>\w+)(?=[^;{}]*\{)"),
        ],
        imports=[(r"\buse\s+([^;]+);", None)],
    ),
    "go": Language(
        skip=rf"{SLASHES}|`[^`]*`|{QUOTED}|'(?:\\[^']*|[^'\\])'",
        declarations=[
            ("function", r"(?m)^func\s+(?P<name>\w+)\s*[\[(]"),
            ("method", r"(?m)^func\s*\(\s*(?:\w+\s+)?\*?(?P<parent>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)"),
            ("struct", r"(?m)^(?:type\s+|\s+)(?P<name>\w+)(?:\[[^\]\n]*\])?\s+struct\b"),
            ("interface", r"(?m)^(?:type\s+|\s+)(?P<name>\w+)(?:\[[^\]\n]*\])?\s+interface\b"),
            ("type", r"(?m)^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)=?\s*[\w.*\[\]]"),
        ],
        imports=[(r"(?m)^import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"", None), (r"(?m)^import\s*\(([^)]*)\)", r"\"([^\"\n]+)\"")],
        newline=True,
    ),
    "java": Language(
        skip=rf'{SLASHES}|""".*?"""|{QUOTED}|{SINGLE}',
        declarations=[("annotation", r"@interface\s+(?P<name>\w+)"), *_named("class interface enum", r"(?<!@)\b"),
                      ("record", r"\brecord\s+(?P<name>\w+)\s*(?:<[^(){};]*>)?\s*(?=\()")],
        imports=[(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", None)],
        shape=r"\s*(?:throws\s+[\w.,\s]+)?[{;]",
        bases=r"(?:extends|implements)\s+([\w.,\s]+)",
    ),
    "kotlin": Language(
        skip=rf'{SLASHES}|""".*?"""|{QUOTED}|{SINGLE}',
        declarations=[("class", r"\b(?:class|interface|object)\s+(?P<name>\w+)"),
                      ("function", r"\bfun\s+(?:<[^>(]*>\s*)?(?:[\w<>?]+\.)*(?P<name>\w+)\s*(?=\()")],
        imports=[(r"(?m)^\s*import\s+([\w.*]+)", None)],
        bases=r":\s*([\w.,()\s]+)",
        newline=True,
    ),
    "swift": Language(
        skip=rf'{SLASHES}|""".*?"""|{QUOTED}',
        declarations=[("class", r"(?<!import )\b(?:class|struct|enum|protocol|extension|actor)\s+(?!func\b|var\b|let\b)(?P<name>\w+)"),
                      ("function", r"\bfunc\s+(?P<name>\w+|[^\s\w(]+)")],
        imports=[(r"(?m)^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var|let|typealias)\s+)?([\w.]+)", None)],
        bases=r":\s*([\w.,\s]+)",
        newline=True,
    ),
    "ruby": Language(
        skip=rf"(?m:^=begin\b.*?^=end\b[^\n]*)|#[^\n]*|{QUOTED}|{SINGLE}",
        declarations=[("class", r"(?m)^\s*(?:class|module)\s+(?P<name>[A-Z][\w:]*)"),
                      ("method", r"(?m)^\s*(?:private\s+|protected\s+)?def\s+(?:self\.)?(?P<name>\w+[?!=]?|[^\s\w(]+)")],
        imports=[(r"\b(?:require_relative|require|load)\b\s*\(?\s*[\"']([^\"'\n]+)", None)],
        bases=r"<\s*([\w:]+)",
        bodies="end",
    ),
    "c": _C,
    "cpp": Language(
        skip=rf"{SLASHES}|R\"\(.*?\)\"|(?<!#include ){QUOTED}|{SINGLE}",
        declarations=[*_C_ITEMS, ("class", r"\bclass\s+(?:\w+\s+)?(?P<name>\w+)[^;(){}=]*(?=\{)"),
                      ("namespace", r"\b(?:inline\s+)?namespace\s+(?P<name>[\w:]+)\s*(?=\{)")],
        imports=_INCLUDES,
        shape=r"\s*(?:const|noexcept|override|final|mutable|&{1,2}|\s)*(?:->[^;{}]*)?(?::(?!:)[^;{}]*)?\{",
        bases=r":\s*([\w:,\s]+)",
    ),
    "objective-c": Language(
        skip=rf"{SLASHES}|(?<!#import )@?{QUOTED}|{SINGLE}",
        declarations=[
            *_C_ITEMS,
            ("category", r"@interface\s+(?P<parent>\w+)\s*\(\s*(?P<name>\w+)\s*\)"),
            ("class_interface", r"@interface\s+(?P<name>\w+)(?!\w|\s*\()"),
            ("class_implementation", r"@implementation\s+(?P<name>\w+)"),
            ("protocol", r"@protocol\s+(?P<name>\w+)(?!\w|\s*[,;])"),
            ("method", r"(?m)^\s*[-+]\s*\([^)]*\)\s*(?P<name>\w+)"),
        ],
        imports=[*_INCLUDES, (r"@import\s+([\w.]+)\s*;", None)],
        shape=r"\s*\{",
        bases=r":\s*(\w+)",
        heads={"class_interface": "@end", "class_implementation": "@end", "protocol": "@end", "category": "@end"},
    ),
    "cfml": Language(
        skip=rf"<!---.*?--->|{SLASHES}",
        declarations=[
            ("component", r"<cfcomponent\b[^>]*?\b(?:name|displayname)\s*=\s*[\"'](?P<name>[\w. ]+)"),
            ("function", r"<cffunction\b[^>]*?\bname\s*=\s*[\"'](?P<name>\w+)"),
            ("function", r"\bfunction\s+(?P<name>\w+)\s*(?=\()"),
        ],
        imports=[
            (r"<cf(?:include|module)\b[^>]*?\btemplate\s*=\s*[\"']([^\"'#]+)", None),
            (r"<cfimport\b[^>]*?\b(?:taglib|path)\s*=\s*[\"']([^\"'#]+)", None),
            (r"(?m)^\s*include\s+[\"']([^\"'#]+)", None),
            (r"\bextends\s*=\s*[\"']([\w.]+)", None),
            (r"createobject\s*\(\s*[\"']component[\"']\s*,\s*[\"']([\w.]+)", None),
        ],
        heads={"component": "</cfcomponent>", "tag": "</cffunction>"},
        flags=re.IGNORECASE,
        keep_strings=True,
    ),
}
LANGUAGES["c++"] = LANGUAGES["cpp"]
LANGUAGES["objc"] = LANGUAGES["objective-c"]


class Source:
    """A text with its blanked form and its matched brackets."""

    def __init__(self, language: Language, text: str):
        self.language, self.text = language, text
        self.code = re.sub(language.skip, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S | language.flags)
        self.close: dict[int, int] = {}
        self.opens: list[int] = []  # braces in order, with the one around each
        self.around: list[int] = []
        stack: list[tuple[str, int, int]] = []
        for m in re.finditer(r"[(){}\[\]]", self.code):
            at, c = m.start(), m[0]
            if c in "({[":
                stack.append((c, at, len(self.opens)))
                if c == "{":
                    self.opens.append(at)
                    self.around.append(next((n for b, _, n in reversed(stack[:-1]) if b == "{"), -1))
            else:
                want = "({["[")}]".index(c)]
                if any(b == want for b, _, _ in stack[-64:]):
                    while stack[-1][0] != want:  # brackets left open
                        stack.pop()
                    self.close[stack.pop()[1]] = at
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.ascii = text.isascii()

    def bytes_at(self, places: set[int]) -> dict[int, int]:
        """The number of UTF-8 bytes before each place."""
        out, last, n = {}, 0, 0
        for at in sorted(places):
            n += at - last if self.ascii else len(self.text[last:at].encode("utf-8", "surrogatepass"))
            out[at] = n
            last = at
        return out

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at - 1) + 1

    def enclosing(self, at: int) -> int | None:
        """The brace around a place."""
        n = bisect_right(self.opens, at - 1) - 1
        while n >= 0 and self.close.get(self.opens[n], len(self.code)) < at:
            n = self.around[n]
        return self.opens[n] if n >= 0 else None

    def body(self, at: int) -> tuple[int | None, int]:
        """The brace that opens a declaration's body, if it has one, and where the declaration ends."""
        for m in iter(lambda p=[at]: self._next(p), None):
            c, i = m
            if c == "{":
                return i, self.close.get(i, len(self.code) - 1) + 1
            if c in ";}" or (c == "\n" and self.language.newline and not re.match(r"\s*[{=:,.]", self.code[i : i + 80])):
                return None, i + (c == ";")
        return None, len(self.code)

    def _next(self, place: list[int]) -> tuple[str, int] | None:
        m = re.compile(r"[({\[;}\n]").search(self.code, place[0])
        if not m:
            return None
        i = m.start()
        place[0] = self.close.get(i, i) + 1 if m[0] in "([" else i + 1
        return m[0], i

    def ruby_end(self, at: int) -> int:
        """Behind the `end` that closes the block opened at a place."""
        depth = 0
        opening = r"(?m)(?P<o>\b(?:class|module|def|begin|case)\b|(?:^|[=(;])[ \t]*(?:if|unless|while|until|for)\b|\bdo\b)|\bend\b"
        for m in re.compile(opening).finditer(self.code, at):
            loop = m[0] == "do" and re.match(r"\s*(?:while|until|for)\b", self.code[self.code.rfind("\n", 0, m.start()) + 1 :])
            depth += 0 if loop else 1 if m["o"] else -1
            if depth <= 0 and not m["o"]:
                return m.end()
        return len(self.code)

    def declarations(self) -> list[tuple[int, int, int | None, str, str, str | None]]:
        """(begin, end, brace, kind, name, parent) as written, before locals are left out."""
        lang, out = self.language, {}
        for kind, expression in lang.declarations:
            for m in re.finditer(expression, self.code, lang.flags):
                begin = m.start() + len(m[0]) - len(m[0].lstrip())
                brace, head = None, lang.heads.get("tag" if m[0].lower().startswith("<cffunction") else kind)
                if kind == "macro":
                    end = next((i for i in self.lines[bisect_right(self.lines, begin) :] if self.text[i - 1] != "\\"), len(self.text))
                elif head:
                    found = self.code.lower().find(head, m.end())
                    end = found + len(head) if found >= 0 else len(self.code)
                elif lang.bodies == "end":
                    end = self.ruby_end(begin)
                elif kind == "typedef":
                    end = m.end()
                else:
                    brace, end = self.body(m.end())
                out.setdefault(m.start("name"), (begin, end, brace, kind, m["name"], m.groupdict().get("parent")))
        if lang.shape:
            after, header = re.compile(lang.shape), -1
            for m in re.finditer(r"(?P<q>(?:\w+::)*)(?P<name>~?[A-Za-z_$][\w$]*)\s*(?=\()", self.code):
                stop = self.close.get(m.end())
                if stop is None or m.start() < header or m["name"] in NO_NAME or m.start("name") in out:
                    continue
                a = after.match(self.code, stop + 1)
                before = self.code[: m.start()].rstrip()[-1:] if m.start() else ""
                if not a or before in (".", "=", "@", ",", "(", "?", "&" if lang.bases else "."):
                    continue
                if a[0].endswith(";") and not re.search(r"[\w>\]]\s+$", self.code[max(0, m.start() - 40) : m.start()]):
                    continue
                brace = a.end() - 1 if a[0].endswith("{") else None
                header = a.end()
                begin = self.code.rfind("\n", 0, m.start()) + 1
                begin = max(begin, max(self.code.rfind(c, begin, m.start()) for c in ";{}") + 1)
                begin += len(self.code[begin : m.start()]) - len(self.code[begin : m.start()].lstrip())
                end = self.close.get(brace, len(self.code) - 1) + 1 if brace is not None else a.end()
                parent = m["q"].rstrip(":").split("::")[-1] or None
                out[m.start("name")] = (begin, end, brace, "function", m["name"], parent)
        return sorted(out.values(), key=lambda x: (x[0], -x[1], x[3]))

    def items(self) -> list[tuple[int, int, str, str, str | None]]:
        """(begin, end, kind, name, parent) of what isn't local."""
        found = self.declarations()
        owner = {brace: (kind, name) for _, _, brace, kind, name, _ in found if brace is not None}
        spans = [(b, e, kind, name) for b, e, brace, kind, name, _ in found if brace is None and kind in TYPES]
        out = []
        for begin, end, brace, kind, name, parent in found:
            around = self.enclosing(begin)
            over, local = None, False
            while around is not None and over is None and not local:
                known = owner.get(around)
                if known is None:  # a block that declares nothing: of a linkage, a statement or a list
                    local = not re.search(r'extern\s+"?[^"{};]*"?\s*$', self.code[max(0, around - 40) : around])
                elif known[0] not in TYPES:
                    local = True
                elif known[0] not in CLEAR:
                    over = known[1]
                around = self.enclosing(around)
            for b, e, _, n in spans:  # containers without braces
                if b < begin and end <= e:
                    over = n
            if local and kind != "macro":
                continue
            parent = parent or over
            if kind == "function" and parent:
                kind = "constructor" if name == parent else "method"
            out.append((begin, end, kind, name, parent))
        return out

    def imports(self) -> Iterator[tuple[int, str]]:
        for outer, inner in self.language.imports:
            for m in re.finditer(outer, self.text, self.language.flags):
                first = m.start() + len(m[0]) - len(m[0].lstrip())
                if self.code[first] != self.text[first]:
                    continue  # in a comment or a string
                for s in re.findall(inner, m[1]) if inner else [m[1]]:
                    yield from ((first, x) for x in flat(s.strip()))


def flat(spec: str) -> Iterator[str]:
    """a::{b, c::{d}} as a::b and a::c::d; `as` names go."""
    open_at = spec.find("{")
    if open_at < 0:
        if name := re.sub(r"\s+as\s+\w+$", "", re.sub(r"\s+", " ", spec)).strip():
            yield name
        return
    head, depth, part = spec[:open_at].strip(), 0, ""
    for c in spec[open_at + 1 : spec.rfind("}")] + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            yield from (head + x for x in (flat(part) if part.strip() else ()))
            part = ""
        else:
            part += c


def items(language: str, text: str) -> Iterator[Item]:
    """The items of a text; imports have the kind `import` and no bytes."""
    s = Source(LANGUAGES[language], text)
    found = s.items()
    byte = s.bytes_at({x for item in found for x in item[:2]})
    for at, spec in sorted(set(s.imports())):
        yield "import", spec, None, s.line(at), s.line(at), 0, 0
    for begin, end, kind, name, parent in found:
        yield kind, name, parent, s.line(begin), s.line(max(begin, end - 1)), byte[begin], byte[end]


#: Languages whose declarations are found elsewhere, by patterns: their comments and strings, and how bodies end.
BODIES: dict[str, Language] = {
    "php": Language(rf"{SLASHES}|#(?!\[)[^\n]*|{QUOTED}|{SINGLE}", [], []),
    "dart": Language(rf"{SLASHES}|{QUOTED}|{SINGLE}", [], []),
    "shell": Language(rf"(?<!\S)#[^\n]*|{QUOTED}|'[^']*'", [], []),
    "css": Language(r"/\*.*?\*/", [], []),
    "devicetree": Language(rf"{SLASHES}|{QUOTED}", [], []),
    "sql": Language(rf"--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'|\$(\w*)\$.*?\$\1\$", [], []),
    "clojure": Language(rf";[^\n]*|{QUOTED}", [], [], bodies="list"),
}
BODIES["scss"] = BODIES["css"]


def extents(language: str, text: str, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where declarations end that are written from one place to another, as (begin, end)."""
    s = Source(BODIES[language], text)
    out = []
    for begin, end in places:
        begin += len(text[begin:end]) - len(text[begin:end].lstrip())
        if s.language.bodies == "list":
            out.append((begin, s.close.get(begin, end - 1) + 1))
        else:
            out.append((begin, s.body(s.code.find("{", begin, end) if "{" in s.code[begin:end] else end)[1]))
    return out


def references(language: str, text: str) -> Iterator[tuple[str, str, str | None, int]]:
    """(kind, from, to, line): `calls` of the names that a function's body calls, `subclassOf` for named supertypes."""
    if language == "python":
        yield from _python_references(text)
        return
    s = Source(LANGUAGES[language], text)
    call = re.compile(r"(?<![\w$])(?P<name>[A-Za-z_$][\w$]*[?!]?)\s*\(")
    for begin, end, kind, name, _ in s.items():
        if kind in TYPES:
            at = -1 if kind in s.language.heads else s.code.find("{", begin, end)
            line_end = s.code.find("\n", begin)
            head = s.code[begin : at if at >= 0 else line_end if line_end >= 0 else end]
            for _ in range(3):
                head = re.sub(r"\([^()]*\)", "", head)
            if kind == "impl" and (m := re.search(r"(\w+)(?:<[^{}]*?>)?\s+for\s", head)):
                yield "subclassOf", name, m[1], s.line(begin)
            for m in re.finditer(s.language.bases, head) if s.language.bases else ():
                for base in re.split(r"[,\s]+(?:public|private|protected|virtual|implements|extends)?\s*", m[1]):
                    if base and base not in ("public", "private", "protected", "virtual", "implements", "extends"):
                        yield "subclassOf", name, re.split(r"::|\.", base)[-1], s.line(begin)
        elif kind in ("function", "method", "constructor"):
            seen = set()
            at = max(s.code.find("{", begin, end), s.code.find("\n", begin, end) if s.language.bodies == "end" else -1)
            for m in call.finditer(s.code, at + 1, end) if at >= 0 else ():
                if m["name"] not in NO_NAME and m["name"] not in seen:
                    seen.add(m["name"])
                    yield "calls", name, m["name"], s.line(m.start())


def _python_references(text: str) -> Iterator[tuple[str, str, str | None, int]]:
    def last(x: ast.expr) -> str | None:
        return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None

    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.ClassDef):
            yield from (("subclassOf", node.name, last(b), node.lineno) for b in node.bases if last(b))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            called = {}
            for x in ast.walk(node):
                if isinstance(x, ast.Call) and (n := last(x.func)):
                    called.setdefault(n, x.lineno)
            yield from (("calls", node.name, n, line) for n, line in called.items())
