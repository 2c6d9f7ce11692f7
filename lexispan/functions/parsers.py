"""Symbols of source files, by rules over declarations.

A language is a comment style and a list of rules (pattern, kind, how parents are read). Patterns name their groups `name` and
`parents`. A declaration that goes on over lines (parameters, parents, a brace on a line of its own) is joined up to its body before the
rules see it, and counts at its first line. What needs state (blocks of Go, packages of Perl, nesting of messages, Ruby's verbs) is a
function. New languages are added with register()."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PARSED
from ..sources.tree import MAX_BYTES, language

Symbol = tuple[str, str, int, str, list[tuple[str, str]]]


# --- comments: blanked, so that lines keep their numbers ---


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def strip_c(text: str, nested: bool = False) -> str:
    text = re.sub(r'"(?:\\.|[^"\\\n])*"|//[^\n]*', lambda m: m[0] if m[0][0] == '"' else _blank(m), text)
    if not nested:
        return re.sub(r"/\*.*?\*/", _blank, text, flags=re.S)
    out, depth, at = [], 0, 0
    for m in re.finditer(r"/\*|\*/", text):
        piece = text[at : m.start()]
        out.append(re.sub(r"[^\n]", " ", piece) if depth else piece)
        depth, at = (depth + 1, m.end()) if m[0] == "/*" else (max(0, depth - 1), m.end())
        out.append("  ")
    return "".join([*out, re.sub(r"[^\n]", " ", text[at:]) if depth else text[at:]])


def strip_hash(text: str) -> str:
    return re.sub(r"(?m)(^|\s)#[^\n]*", lambda m: m[1] + " " * (len(m[0]) - len(m[1])), text)


def strip_python(text: str) -> str:
    return strip_hash(re.sub(r'"""(?s:.*?)"""|\'\'\'(?s:.*?)\'\'\'', _blank, text))


def strip_ruby(text: str) -> str:
    return strip_hash(re.sub(r"(?ms)^=begin\b.*?^=end\b[^\n]*", _blank, text))


def strip_perl(text: str) -> str:
    return strip_hash(re.sub(r"(?ms)^=[a-z]\w*.*?(?:^=cut\b[^\n]*|\Z)", _blank, text))


def strip_xml(text: str) -> str:
    return re.sub(r"(?s)<!--.*?-->|\[%.*?%\]", _blank, text)


# --- parents ---


def _names(text: str | None) -> list[str]:
    """Names of a list of parents: type arguments and calls are taken off."""
    flat, depth = "", 0
    for c in text or "":
        depth += c in "<([" and 1 or 0
        if not depth:
            flat += c
        depth -= c in ">)]" and 1 or 0
    return [m[0] for p in re.split(r",|\bwith\b", flat) if (m := re.search(r"[A-Za-z_][\w.:]*", re.sub(r"\b(?:public|private|protected|virtual|by)\b.*?(?=\s[A-Z]|$)", "", p) or p))]


def all_extend(text: str | None) -> list[tuple[str, str]]:
    return [(n, "extends") for n in _names(text)]


def first_extends(text: str | None) -> list[tuple[str, str]]:
    return [(n, "implements" if k else "extends") for k, n in enumerate(_names(text))]


def kotlin_parents(text: str | None) -> list[tuple[str, str]]:
    """A parent that is called is a class, others are interfaces."""
    parts, depth, at = [], 0, 0
    t = (text or "") + ","
    for k, c in enumerate(t):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth <= 0:
            parts.append(t[at:k])
            at = k + 1
    return [(m[0], "extends" if "(" in p else "implements") for p in parts if (m := re.search(r"[A-Za-z_][\w.]*", p))]


def objc_parents(text: str | None) -> list[tuple[str, str]]:
    """A superclass, then protocols in angle brackets."""
    above, _, protocols = (text or "").partition("<")
    return [(n, "extends") for n in re.findall(r"\w+", above)] + [(n, "implements") for n in re.findall(r"\w+", protocols)]


def csharp_parents(text: str | None) -> list[tuple[str, str]]:
    return [(n, "implements" if re.match(r"I[A-Z]", n) else "extends") for n in _names(text)]


def cpp_parents(text: str | None) -> list[tuple[str, str]]:
    """Bases without access words and template arguments."""
    return [(m[0], "extends") for p in re.sub(r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "", text or "").split(",") if (m := re.search(r"[A-Za-z_][\w:]*\s*$", p.strip()))]


def keyword_parents(text: str | None) -> list[tuple[str, str]]:
    """Parents after extends, implements and with."""
    out = []
    for m in re.finditer(r"\b(extends|implements|with|on)\s+(.+?)(?=\b(?:extends|implements|with|on)\b|$)", text or ""):
        out += [(n, {"extends": "extends", "implements": "implements", "with": "with", "on": "extends"}[m[1]]) for n in _names(m[2])]
    return out


# --- declarations over several lines ---

MAX_HEADER = 40
_TYPE = re.compile(r"\b(?:class|interface|struct|enum|record|trait|impl|protocol|extension|mixin|actor)\b")
_CARRIED = re.compile(r"\s*(?:[:,.=]|extends\b|implements\b|with\b|where\b|by\b)")
_CARRIES = re.compile(r"(?:[,:(=]|\b(?:extends|implements|with|where|by|constructor))\s*$")
#: Languages whose types always have a body in braces, and those where the line's end can be the declaration's.
BRACED, OPEN = ("java", "csharp", "cpp", "rust", "dart", "typescript", "swift"), ("kotlin", "scala")


def declaration(lines: list[str], at: int, braced: bool, ends: bool) -> tuple[str, int]:
    """The declaration that begins at a line, in one line up to its body or end, and the lines that it takes; the line alone if no end is found.

    braced: it goes on to a brace or semicolon. ends: it ends with a line that neither carries on nor is carried on by the next; without
    both it ends with its parentheses."""
    text, depth = "", 0
    for n, line in enumerate(lines[at : at + MAX_HEADER], 1):
        for k, c in enumerate(line):
            depth += (c in "([") - (c in ")]")
            if depth <= 0 and c in "{;":
                return text + line[: k + 1], n
        text += line.rstrip() + " "
        if depth > 0 or braced:
            continue
        following = lines[at + n] if at + n < len(lines) else ""
        if not ends or not (_CARRIES.search(line) or _CARRIED.match(following)):
            return text.rstrip(), n
    return lines[at], 1


def joined(lang: str, lines: list[str], at: int) -> tuple[str, int]:
    line = lines[at]
    typed = _TYPE.search(line) and not line.lstrip().startswith(("import", "using", "typedef", "friend", "#", "@interface", "@protocol"))
    if typed and lang in BRACED:
        return declaration(lines, at, True, False)
    if lang in OPEN and (typed or re.search(r"\bobject\b", line)):
        return declaration(lines, at, False, True)
    if "(" in line and lang in (*BRACED, *OPEN, "objc", "go") or line.count("(") > line.count(")"):
        return declaration(lines, at, False, False)
    return line, 1


# --- rules ---

#: What is recorded of annotations, attributes and decorators; fixed values.
JAVA_ANNOTATIONS = ("RestController", "Controller", "Service", "Repository", "Component", "Entity", "Table", "Configuration", "Bean", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping", "Autowired", "Override", "Transactional", "SpringBootApplication", "EnableAutoConfiguration", "Test", "BeforeEach", "AfterEach", "BeforeAll", "AfterAll", "Inject", "Singleton", "Provides", "Binds", "Module", "Data", "Value", "Builder", "AllArgsConstructor", "NoArgsConstructor", "Getter", "Setter", "Slf4j", "Log4j2")
CSHARP_ATTRIBUTES = ("Serializable", "DataContract", "DataMember", "JsonProperty", "JsonIgnore", "Required", "Authorize", "AllowAnonymous", "HttpGet", "HttpPost", "HttpPut", "HttpDelete", "Route", "ApiController", "Controller", "Test", "TestMethod", "Fact", "Theory", "SerializeField", "Header", "Tooltip", "Range", "DllImport", "StructLayout", "MarshalAs", "Obsolete", "Conditional", "DebuggerDisplay")
RUST_ATTRIBUTES = ("test", "bench", "cfg", "allow", "warn", "deny", "macro_export", "inline", "cold", "must_use", "tokio", "async_trait", "proc_macro", "proc_macro_derive", "serde", "rocket", "actix", "axum")
TYPESCRIPT_DECORATORS = ("Controller", "Get", "Post", "Put", "Delete", "Patch", "Injectable", "Module", "Component", "Service", "Entity", "Column")
SCRIPT_DECORATORS = (*TYPESCRIPT_DECORATORS[:10], "Pipe", "Guard", "Interceptor", "Middleware", "Entity", "Column", "PrimaryColumn", "PrimaryGeneratedColumn", "ManyToOne", "OneToMany", "ManyToMany", "OneToOne", "JoinColumn", "ViewChild", "ViewChildren", "Input", "Output", "Inject")
RUBY_CALLBACKS = ("before_action", "after_action", "around_action", "before_create", "after_create", "before_save", "after_save", "before_destroy", "after_destroy", "before_validation", "after_validation")

Rule = tuple[str, str, Callable[[str | None], list[tuple[str, str]]] | None]
_MOD = r"(?:[a-z@]\w*(?:\([^)]*\))?\s+)*?"
RULES: dict[str, tuple[Callable[[str], str], list[Rule]]] = {
    "kotlin": (lambda t: strip_c(t, True), [
        (rf"^\s*{_MOD}(?:enum\s+)?class\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s*(?:private\s+|internal\s+)?(?:constructor\s*)?\((?:[^()]|\([^()]*\))*\))?(?:\s*:\s*(?P<parents>[^{{]+))?", "class", kotlin_parents),
        (rf"^\s*{_MOD}interface\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s*:\s*(?P<parents>[^{{]+))?", "interface", all_extend),
        (rf"^\s*{_MOD}object\s+(?P<name>\w+)(?:\s*:\s*(?P<parents>[^{{]+))?", "object", kotlin_parents),
        (rf"^\s*{_MOD}fun\s+(?:<[^>]+>\s*)?(?:[\w<>?,\s]+?\.)?(?P<name>\w+)\s*\(", "function", None),
        (rf"^\s*{_MOD}(?:val|var)\s+(?:<[^>]+>\s*)?(?:\w+\.)?(?P<name>\w+)", "property", None),
        (rf"^\s*{_MOD}typealias\s+(?P<name>\w+)", "typealias", None),
        (r"^\s*import\s+(?P<name>[\w.*]+)", "import", None), (r"^\s*package\s+(?P<name>[\w.]+)", "package", None),
    ]),
    "java": (strip_c, [
        (rf"^\s*{_MOD}class\s+(?P<name>\w+)(?:<[^{{]*?>)?\s*(?P<parents>(?:extends|implements)\b[^{{]*)?", "class", keyword_parents),
        (rf"^\s*{_MOD}interface\s+(?P<name>\w+)(?:<[^{{]*?>)?\s*(?P<parents>extends\b[^{{]*)?", "interface", keyword_parents),
        (rf"^\s*{_MOD}(?:enum|record)\s+(?P<name>\w+)[^{{]*?(?P<parents>implements\b[^{{]*)?\{{", "enum", keyword_parents),
        (r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\([^;]*(?:\{|;)?\s*$", "function", None),
        (r"^\s+(?:(?:public|private|protected|static|final|volatile|transient)\s+)+[\w<>\[\],.?]+\s+(?P<name>\w+)\s*(?:=|;)", "property", None),
        (r"^\s*import\s+(?:static\s+)?(?P<name>[\w.*]+)", "import", None), (r"^\s*package\s+(?P<name>[\w.]+)", "package", None),
        (rf"^\s*(?P<name>@(?:{'|'.join(JAVA_ANNOTATIONS)}))\b", "annotation", None),
        (r"^\s+(?:public|private|protected)\s+(?P<name>[A-Z]\w*)\s*\([^;]*(?:\{|;)?\s*$", "function", None),
    ]),
    "swift": (lambda t: strip_c(t, True), [
        (rf"^\s*{_MOD}(?:class|struct|actor)\s+(?!func\b|var\b|let\b)(?P<name>\w+)(?:<[^>]*>)?(?:\s*:\s*(?P<parents>[^{{]+))?", "class", first_extends),
        (rf"^\s*{_MOD}enum\s+(?P<name>\w+)(?:\s*:\s*(?P<parents>[^{{]+))?", "enum", first_extends),
        (rf"^\s*{_MOD}protocol\s+(?P<name>\w+)(?:\s*:\s*(?P<parents>[^{{]+))?", "interface", all_extend),
        (rf"^\s*{_MOD}func\s+(?P<name>\w+)", "function", None), (rf"^\s*{_MOD}(?P<name>init)\s*[?(<]", "function", None),
        (rf"^\s*{_MOD}(?:var|let)\s+(?P<name>\w+)", "property", None), (rf"^\s*{_MOD}typealias\s+(?P<name>\w+)", "typealias", None),
        (r"^\s*import\s+(?P<name>\w+)", "import", None),
    ]),
    "objc": (strip_c, [
        (r"^\s*@interface\s+(?P<name>\w+)\s*(?!\s*\()(?P<parents>(?::\s*\w+)?(?:\s*<[^>]*>)*)\s*\{?\s*$", "class", objc_parents),
        (r"^\s*@protocol\s+(?P<name>\w+)\s*(?:<(?P<parents>[^>]*)>)?[^;]*$", "interface", all_extend),
        (r"^\s*[-+]\s*\([^)]*\)\s*(?P<name>\w+)", "function", None), (r"^\s*@property\b.*?\*?\b(?P<name>\w+)\s*;", "property", None),
        (r"^\s*typedef\b(?!.*\{[^}]*$).*?\b(?P<name>\w+)\s*;", "typealias", None), (r'^\s*#import\s+[<"](?P<name>[^>"]+)', "import", None),
    ]),
    "python": (strip_python, [
        (r"^\s*class\s+(?P<name>\w+)(?:\s*\((?P<parents>[^)]*)\))?", "class", all_extend),
        (r"^(?:    |\t)?(?:async\s+)?def\s+(?P<name>__init__|__call__|[A-Za-z]\w*)", "function", None),
        (r"^(?P<name>[A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=(?!=)", "constant", None),
        (r"^(?P<name>[A-Z][a-z]\w*)\s*(?::[^=]+)?=\s*(?:Union|Optional|List|Dict|Tuple|Callable|Type)\b", "typealias", None),
        (r"^\s*(?P<name>@[\w.]*(?:route|handler|pytest|fixture|dataclass|property)[\w.]*)", "annotation", None),
    ]),
    "go": (strip_c, [
        (r"^package\s+(?P<name>\w+)", "package", None), (r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b", "class", None),
        (r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b", "interface", None), (r"^type\s+(?P<name>\w+)\s+=?\s*(?P<parents>\w+)\s*$", "typealias", lambda t: [(t or "", "alias")]),
        (r"^func\s+\(\s*\w*\s*(?P<parents>\*?\w+)[^)]*\)\s*(?P<name>\w+)", "function", lambda t: [((t or "").lstrip("*"), "receiver")]),
        (r"^func\s+(?P<name>\w+)", "function", None), (r"^const\s+(?P<name>\w+)", "constant", None), (r"^var\s+(?P<name>\w+)", "property", None),
    ]),
    "rust": (lambda t: strip_c(t, True), [
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)", "class", None), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)", "enum", None),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)", "interface", None),
        (r"^\s*(?:unsafe\s+)?(?P<name>impl\b[^{;]*)", "class", lambda t: []),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"C\"\s+)*fn\s+(?P<name>\w+)", "function", None),
        (r"^\s*macro_rules!\s*(?P<name>\w+)", "macro", None), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)", "typealias", None),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z][A-Z0-9_]*)\s*:", "constant", None),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)", "package", None), (r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<name>\w+(?:::\w+)+)\s*(?:;|as\b)", "import", None),
    ]),
    "csharp": (strip_c, [
        (r"^\s*namespace\s+(?P<name>[\w.]+)", "package", None), (r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?P<name>[\w.]+)\s*;", "import", None),
        (rf"^\s*{_MOD}(?:class|struct|record(?:\s+(?:class|struct))?)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\([^)]*\))?(?:\s*:\s*(?P<parents>[^{{;]+))?", "class", csharp_parents),
        (rf"^\s*{_MOD}interface\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s*:\s*(?P<parents>[^{{]+))?", "interface", csharp_parents), (rf"^\s*{_MOD}enum\s+(?P<name>\w+)", "enum", None),
        (rf"^\s*{_MOD}delegate\s+[\w<>\[\],.?]+\s+(?P<name>\w+)", "typealias", None), (rf"^\s*{_MOD}event\s+[\w<>.?]+\s+(?P<name>\w+)", "property", None),
        (r"^\s+(?:(?:public|private|protected|internal)\s+)?const\s+\w+\s+(?P<name>\w+)", "constant", None),
        (r"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract|readonly|partial|extern)\s+)+(?:[\w<>\[\],.?]+\s+)?(?P<name>\w+)\s*(?:<[^>]*>)?\(", "function", None),
        (r"^\s+(?!return\b|new\b|await\b|throw\b|else\b|using\b|var\b)[\w<>\[\],.?]+\s+(?P<name>[A-Z]\w*)\s*(?:<[^>]*>)?\([^)]*\)\s*;\s*$", "function", None),
        (r"^\s+(?:(?:public|private|protected|internal|static|virtual|override|readonly|required)\s+)+[\w<>\[\],.?]+\s+(?P<name>\w+)\s*(?:\{|=|;|$)", "property", None),
    ]),
    "cpp": (strip_c, [
        (r"^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(?:\w+\s+)?(?P<name>(?!final\b)\w+)\s*(?:<[^>]*>\s*)?(?:final\s*)?(?::(?!:)\s*(?P<parents>[^{;]+))?(?:\{|$)", "class", cpp_parents),
        (r"^\s*(?:inline\s+)?namespace\s+(?P<name>[\w:]+)", "package", None), (r"^\s*enum\s+(?:class\s+|struct\s+)?(?P<name>\w+)", "enum", None),
        (r"^\s*typedef\b.*?\(\s*\*\s*(?P<name>\w+)\s*\)", "typealias", None), (r"^\s*typedef\b(?!.*\{).*?\b(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?;", "typealias", None),
        (r"^\s*using\s+(?P<name>\w+)\s*=", "typealias", None), (r"^\s*#\s*define\s+(?P<name>\w+)\(", "constant", None),
        (r"^\s*(?:[\w:<>,*&~]+\s+)*[*&]*(?P<parents>\w+(?:<[^>]*>)?(?:::\w+)*)::(?P<name>~?\w+)\s*\([^;{]*\)[\w\s]*(?:->[^{;]*)?(?::[^{;]*)?(?:\{|$)", "function", lambda t: [(t or "", "member")]),
        (r"^\s*(?:template\s*<[^>]*>\s*)?(?!return\b|else\b|new\b|delete\b|throw\b|case\b|goto\b|using\b)(?:[\w:<>,*&~]+\s+)+[*&]*(?P<name>~?\w+)\s*\([^;{]*\)[\w\s]*(?:->[^{;]*)?(?:\{|;|$)", "function", None),
    ]),
    "dart": (strip_c, [
        (r"^\s*(?:abstract\s+|base\s+|final\s+|sealed\s+)*interface\s+class\s+(?P<name>\w+)(?:<[^{]*?>)?\s*(?P<parents>[^{]*)", "interface", keyword_parents),
        (r"^\s*(?:abstract\s+|base\s+|final\s+|sealed\s+|mixin\s+)*class\s+(?P<name>\w+)(?:<[^{]*?>)?\s*(?P<parents>[^{]*)", "class", keyword_parents),
        (r"^\s*(?:base\s+)?mixin\s+(?!class\b)(?P<name>\w+)(?:<[^{]*?>)?\s*(?P<parents>[^{]*)", "interface", keyword_parents),
        (r"^\s*extension\s+type\s+(?:const\s+)?(?P<name>\w+)(?:<[^>]*>)?\s*(?:\([^)]*\))?\s*(?P<parents>[^{]*)", "class", keyword_parents),
        (r"^\s*extension\s+(?P<name>\w+)(?:<[^>]*>)?\s*(?P<parents>on\s+[^{]*)", "object", keyword_parents), (r"^\s*enum\s+(?P<name>\w+)\s*(?P<parents>[^{]*)", "enum", keyword_parents),
        (r"^\s*typedef\s+(?P<name>\w+)\s*(?:<[^=]*>)?\s*=", "typealias", None),
        (r"^\s*(?:import|export)\s+['\"](?P<name>[^'\"]+)['\"]", "import", None), (r"^\s*(?:static\s+|external\s+)*(?:[\w<>?,\s]+\s)?(?:get|set)\s+(?P<name>\w+)\s*(?:=>|\{|\(|;|async\b)", "property", None),
        (r"^\s*(?:static\s+|external\s+)*(?!return\b|await\b|throw\b|new\b|else\b|case\b|yield\b|const\b|final\b|var\b|assert\b)[\w<>?,\[\].]+(?:\s*<[^(]*>)?\??\s+(?P<name>\w+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?:async\*?|sync\*)?\s*(?:\{|=>|;|$)", "function", None),
        (r"^\s*(?:const\s+|factory\s+|external\s+)*(?P<name>_?[A-Z]\w*(?:\.\w+)?)\s*\([^;]*\)\s*(?:\{|=>|;|:|$)", "constructor", None),
        (r"^(?:final|const|late|var)\s+(?:[\w<>?,]+\s+)?(?P<name>\w+)\s*=", "property", None),
    ]),
    "scala": (lambda t: strip_c(t, True), [
        (rf"^\s*{_MOD}class\s+(?P<name>\w+)(?:\[[^\]]*\])?(?:\s*\([^)]*\))*\s*(?:extends\s+(?P<parents>[^{{]+))?", "class", first_extends), (rf"^\s*{_MOD}object\s+(?P<name>\w+)\s*(?:extends\s+(?P<parents>[^{{]+))?", "object", first_extends),
        (rf"^\s*{_MOD}trait\s+(?P<name>\w+)(?:\[[^\]]*\])?\s*(?:extends\s+(?P<parents>[^{{]+))?", "interface", first_extends), (rf"^\s*{_MOD}enum\s+(?P<name>\w+)", "enum", None),
        (rf"^\s*{_MOD}def\s+(?P<name>\w+)", "function", None), (rf"^\s*{_MOD}(?:val|var)\s+(?P<name>\w+)", "property", None), (rf"^\s*{_MOD}type\s+(?P<name>\w+)", "typealias", None), (rf"^\s*{_MOD}given\s+(?P<name>\w+)", "object", None),
    ]),
    "typescript": (strip_c, [
        (r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)(?:<[^{]*?>)?\s*(?P<parents>(?:extends|implements)\b[^{]*)?", "class", keyword_parents),
        (r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>\w+)(?:<[^{]*?>)?\s*(?P<parents>extends\b[^{]*)?", "interface", keyword_parents),
        (r"^\s*(?:export\s+)?(?:declare\s+)?type\s+(?P<name>\w+)(?:<[^=]*>)?\s*=", "typealias", None), (r"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>\w+)", "enum", None),
        (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)", "function", None),
        (r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", "function", None),
        (r"^(?:export\s+)?const\s+(?P<name>[A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=", "constant", None), (r"^\s*(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+(?P<name>[\w.]+)", "package", None),
        (r"^\s*import\b.*?['\"](?P<name>(?:\.|@/|~)[^'\"]*)['\"]", "import", None), (rf"^\s*(?P<name>@\w*(?:{'|'.join(TYPESCRIPT_DECORATORS)})\w*)", "annotation", None),
    ]),
}
_COMPILED = {k: (s, [(re.compile(p), kind, f) for p, kind, f in rules]) for k, (s, rules) in RULES.items()}


def by_rules(lang: str, text: str, clean: list[str] | None = None) -> list[Symbol]:
    """For each declaration the first rule that fits. clean: the lines to read, if they aren't those of the text without comments."""
    strip, rules = _COMPILED[lang]
    lines, clean = text.split("\n"), clean or strip(text).split("\n")
    out: list[Symbol] = []
    done = 0
    for n, line in enumerate(clean, 1):
        if n <= done or not line.strip():
            continue
        whole, used = joined(lang, clean, n - 1)
        for pattern, kind, parents in rules:
            if m := pattern.match(whole):
                found = [p for p in parents(m.groupdict().get("parents")) if p[0]] if parents else []
                out.append((m["name"], kind, n, lines[n - 1].strip(), found))
                done = n + used - 1
                break
    return out


def parse_swift(text: str) -> list[Symbol]:
    out, clean = by_rules("swift", text), strip_c(text, True).split("\n")
    for n, line in enumerate(clean, 1):
        if re.match(r"^\s*(?:\w+\s+)*?extension\s+\w", line) and (m := re.match(r"^\s*(?:\w+\s+)*?extension\s+([\w.]+)(?:\s*:\s*([^{]+))?", joined("swift", clean, n - 1)[0])):
            out.append((f"{m[1]}+Extension", "object", n, line.strip(), [(m[1], "extends"), *[(x, "implements") for x in _names(m[2])]]))
    return sorted(out, key=lambda x: x[2])


def typedefs(clean: str, lines: list[str]) -> list[Symbol]:
    """Names given to a structure, union or enumeration that is defined in the typedef itself."""
    found = re.finditer(r"(?m)^[ \t]*typedef\s+(?:struct|union|enum)\b[^{;]*\{(?:[^{}]|\{[^{}]*\})*\}\s*(\w+)\s*;", clean)
    return [(m[1], "typealias", n, lines[n - 1].strip(), []) for m in found for n in [clean.count("\n", 0, m.start()) + 1]]


def parse_objc(text: str) -> list[Symbol]:
    out, clean, lines = by_rules("objc", text), strip_c(text), text.split("\n")
    whole = any(k == "class" for _, k, *_ in out)
    extra = [x for x in typedefs(clean, lines) if x[:3] not in {y[:3] for y in out}]
    for n, line in enumerate(clean.split("\n"), 1):
        if m := re.match(r"^\s*@interface\s+(\w+)\s*\(\w*\)", line):
            out = [s for s in out if s[2] != n]
            extra.append((f"{m[1]}+Category", "object", n, lines[n - 1].strip(), [(m[1], "extends")]))
        elif not whole and (m := re.match(r"^\s*@implementation\s+(\w+)", line)):
            extra.append((m[1], "class", n, lines[n - 1].strip(), []))
    return sorted([*out, *extra], key=lambda x: x[2])


def parse_python(text: str) -> list[Symbol]:
    out, clean, lines = by_rules("python", text), strip_python(text).split("\n"), text.split("\n")
    for n, line in enumerate(clean, 1):
        if re.match(r"^\s*from\s", line) and (m := re.match(r"^\s*from\s+([\w.]+)\s+import\s+(.+)", joined("python", clean, n - 1)[0])):
            names = [x.split(" as ")[0].strip(" ()\\") for x in m[2].split(",")]
            out += [(x, "import", n, lines[n - 1].strip(), []) for x in [m[1], *names] if x and x != "*"]
        elif m := re.match(r"^\s*import\s+(.+)", line):
            out += [(x.split(" as ")[0].strip(), "import", n, lines[n - 1].strip(), []) for x in m[1].split(",")]
    return sorted(out, key=lambda x: x[2])


def parse_go(text: str) -> list[Symbol]:
    """The lines of a block in parentheses are read as if each had the block's word before it."""
    clean, word, depth = strip_c(text).split("\n"), "", 0
    imports: list[Symbol] = []
    for n, line in enumerate(clean):
        if word and depth == 0 and re.match(r"^\)", line):
            word = ""
        elif word:
            if depth == 0 and line.strip():
                clean[n] = f"{word} {line.strip()}"
            depth += line.count("{") - line.count("}")
        elif m := re.match(r"^(import|const|var|type)\s*\(\s*$", line):
            word, depth = m[1], 0
        if m := re.match(r'^import\s+(?:([\w.]+)\s+)?"([^"]+)"', clean[n]):
            name = m[1] or m[2].rsplit("/", 1)[-1]
            imports.append((name, "import", n + 1, f'import {m[1]} "{m[2]}"' if m[1] else f'import "{m[2]}"', [(m[2], "from")]))
    return sorted([*by_rules("go", text, clean), *imports], key=lambda x: x[2])


def parse_rust(text: str) -> list[Symbol]:
    """An impl is named as it reads, without its type parameters: for a trait it has the trait as its parent."""
    out: list[Symbol] = []
    for name, kind, n, sig, parents in by_rules("rust", text):
        if kind == "macro":
            name, kind = f"{name}!", "function"
        elif name.startswith("impl"):
            head = re.sub(r"\s+", " ", re.split(r"\bwhere\b", re.sub(r"^impl\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>", "impl ", name))[0]).strip()
            trait, _, owner = head.removeprefix("impl").strip().partition(" for ")
            name, parents = (f"impl {trait} for {owner}", [(trait, "implements")]) if owner else (f"impl {trait}", [])
        out.append((name, kind, n, sig, parents))
    clean = strip_c(text, True).split("\n")
    for n, line in enumerate(clean, 1):
        if re.match(r"^\s*#!?\[", line) and (m := re.match(r"^\s*#!?\[\s*([\w:]+)\s*(?:\((.*)\))?", joined("rust", clean, n - 1)[0])):
            if m[1] == "derive":
                out += [(f"#[derive({x.strip()})]", "annotation", n, line.strip(), []) for x in (m[2] or "").split(",") if x.strip()]
            elif m[1] in RUST_ATTRIBUTES:
                out.append((f"#[{m[1]}]", "annotation", n, line.strip(), []))
    return sorted(out, key=lambda x: x[2])


_RUBY = [
    (r"^\s*class\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<p>[\w:]+))?", "class"), (r"^\s*module\s+(?P<name>[\w:]+)", "package"), (r"^\s*def\s+(?P<name>(?:\w+\.)?[\w?!=]+)", "function"), (r"^\s*(?P<name>[A-Z][A-Z0-9_]*)\s*=(?![=~])", "constant"),
    (r"""^\s*(?:require|require_relative)\s*\(?\s*['"](?P<name>[^'"]+)""", "import"), (r"^\s*(?P<name>(?:include|extend|prepend)\s+[\w:]+)", "import"), (r"^\s*attr_(?:reader|writer|accessor)\s+(?P<name>:\w+)", "property"),
    (r"^\s*(?P<name>(?:has_many|has_one|belongs_to|has_and_belongs_to_many)\s+:\w+)", "property"), (rf"^\s*(?P<name>(?:validates|{'|'.join(RUBY_CALLBACKS)})\s+:\w+)", "annotation"), (r"^\s*(?P<name>scope\s+:\w+)", "function"),
    (r"""^\s*(?P<name>(?:describe|context)\s+(?:"[^"]*"|'[^']*'|[\w:]+))""", "class"), (r"""^\s*(?P<name>(?:it|specify)\s+(?:"[^"]*"|'[^']*'))""", "function"), (r"^\s*(?P<name>(?:let!?|subject)\s*\(:\w+\))", "property"),
]


def parse_ruby(text: str) -> list[Symbol]:
    """The verbs of Rails and RSpec keep their word, with one blank; descriptions stand in double quotes."""
    out = []
    for n, line in enumerate(strip_ruby(text).split("\n"), 1):
        for p, kind in _RUBY:
            if m := re.match(p, line):
                parent, name = m.groupdict().get("p"), m["name"]
                if verb := re.match(r"(describe|context|it|specify)\s+['\"]?([^'\"]*)", name):
                    name = f'{verb[1]} "{verb[2]}"'
                elif not name.startswith(("let", "subject")):
                    name = re.sub(r"\s+", " ", name)
                out.append((name, kind, n, line.strip(), [(parent, "extends")] if parent else []))
                break
    return out


def parse_csharp(text: str) -> list[Symbol]:
    out, lines = by_rules("csharp", text), text.split("\n")
    for n, line in enumerate(strip_c(text).split("\n"), 1):
        if m := re.match(r"^\s*((?:\[[^\]]*(?:\[[^\]]*\][^\]]*)*\]\s*)+)", line):
            found = re.findall(r"[\[,]\s*(?:\w+:\s*)?(?:\w+\.)*(\w+)", re.sub(r"\((?:[^()]|\([^()]*\))*\)", "", re.sub(r'"(?:\\.|[^"\\])*"', '""', m[1])))
            out += [(f"[{x}]", "annotation", n, lines[n - 1].strip(), []) for x in found if x in CSHARP_ATTRIBUTES]
    return sorted(out, key=lambda x: x[2])


_CPP_RESERVED = ("if", "for", "while", "switch", "return", "else", "catch", "sizeof", "case", "do", "new", "delete", "throw", "class", "struct", "operator", "defined", "decltype", "alignof", "static_assert")


def parse_cpp(text: str) -> list[Symbol]:
    """A function's type may stand on the line before its name; native methods are named by their last part."""
    clean, lines = strip_c(text).split("\n"), text.split("\n")
    typed = [*clean]
    for n in range(1, len(clean)):
        if re.match(r"^\s*(?!return\b|else\b|do\b)[\w:<>,*& ]*[\w>*&]\s*$", clean[n - 1]) and not _TYPE.search(clean[n - 1]) and re.match(r"^[*&]*(?:\w+::)*~?\w+\s*\(", clean[n]):
            typed[n] = f"{clean[n - 1].strip()} {clean[n]}"
    typed = ["" if re.match(r"^\s*template\s*<.*>\s*$", x) else x for x in typed]
    out = []
    for name, kind, n, sig, parents in by_rules("cpp", text, typed):
        if name.startswith("Java_"):  # a native method's name: package and class, then the method
            name = name.rsplit("_", 1)[-1]
        if name not in _CPP_RESERVED and not (parents and parents[0][1] == "member" and parents[0][0] in _CPP_RESERVED):
            out.append((name, kind, n, sig, parents))
    out += [x for x in typedefs("\n".join(clean), lines) if x[:3] not in {y[:3] for y in out}]
    for n, line in enumerate(clean, 1):
        if m := re.match(r'^\s*#\s*include\s+[<"]([^>"]+)', line):
            out.append((m[1].rsplit("/", 1)[-1], "import", n, lines[n - 1].strip(), [(m[1], "from")]))
    return sorted(out, key=lambda x: x[2])


def parse_dart(text: str) -> list[Symbol]:
    """Constructors are calls of a class that the file declares; files are imported by their stem, core libraries by their whole name."""
    found = by_rules("dart", text)
    types = {n for n, k, *_ in found if k in ("class", "enum", "interface")}
    out = []
    for name, kind, n, sig, parents in found:
        if kind == "import" and not name.startswith("dart:"):
            name = name.rsplit("/", 1)[-1].removesuffix(".dart")
        if kind != "constructor" or name.split(".")[0] in types:
            out.append((name, "function" if kind == "constructor" else kind, n, sig, parents))
    return out


def parse_proto(text: str) -> list[Symbol]:
    """Messages and enums carry the names of those that they stand in, which are their parents."""
    out: list[Symbol] = []
    stack: list[tuple[str, int]] = []
    depth = 0
    clean = strip_c(text).split("\n")
    for n, line in enumerate(clean, 1):
        s = line.strip()
        if s.startswith("rpc"):
            s = re.sub(r"\s+", " ", declaration(clean, n - 1, True, False)[0]).strip()
        if m := re.match(r"package\s+([\w.]+)", s):
            out.append((m[1], "package", n, s, []))
        elif m := re.match(r'option\s+\(?([\w.]+)\)?\s*=\s*"?([^";]+)', s):
            out.append((f"{m[1]}:{m[2].strip()}", "property", n, s, []))
        elif m := re.match(r'import\s+(?:public\s+|weak\s+)?"([^"]+)"', s):
            out.append((m[1], "import", n, s, []))
        elif m := re.match(r"service\s+(\w+)", s):
            out.append((m[1], "interface", n, s, []))
        elif m := re.match(r"rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)", s):
            out.append((m[1], "function", n, f"rpc {m[1]}({m[2]}) returns ({m[3]})", []))
        elif m := re.match(r"(message|enum)\s+(\w+)", s):
            above = ".".join(x for x, _ in stack)
            out.append((f"{above}.{m[2]}" if above else m[2], "class" if m[1] == "message" else "enum", n, s, [(above, "nested_in")] if above else []))
            if line.count("{") > line.count("}"):
                stack.append((m[2], depth))
        depth += line.count("{") - line.count("}")
        while stack and depth <= stack[-1][1]:
            stack.pop()
    return out


def with_imports(clean: list[str]) -> list[str]:
    """Lines with each import that goes on over lines on its first one."""
    out = [*clean]
    for n, line in enumerate(clean):
        if re.match(r"^\s*import\b[^'\";(]*$", line):
            for k in range(n + 1, min(n + MAX_HEADER, len(clean))):
                out[n] += " " + clean[k].strip()
                if re.search(r"['\"]", clean[k]):
                    out[n + 1 : k + 1] = [""] * (k - n)
                    break
    return out


def parse_typescript(text: str) -> list[Symbol]:
    """Functions in Pascal case are components; class members stand directly in a class."""
    clean = with_imports(strip_c(text).split("\n"))
    out = [(n, "class" if k == "function" and n[:1].isupper() and not n.isupper() else k, line, s, p) for n, k, line, s, p in by_rules("typescript", text, clean)]
    depth, inside = 0, -1
    for n, line in enumerate(strip_c(text).split("\n"), 1):
        if re.match(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\b", line):
            inside = depth + 1
        elif depth == inside and (m := re.match(r"^\s*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|return\b|extends\b|implements\b)\*?\s*([#\w]+)\s*(?:<[^>]*>)?\(", line)):
            out.append((m[1], "function", n, line.strip(), []))
        elif depth == inside and (m := re.match(r"^\s*(?:(?:public|private|protected|static|readonly|declare|override|abstract|accessor)\s+)*([#\w]+)\s*[?!]?\s*[:=;]", line)):
            out.append((m[1], "property", n, line.strip(), []))
        depth += line.count("{") - line.count("}")
        if depth < inside - 1 or depth < inside and "}" in line:
            inside = -1
    return sorted(out, key=lambda x: x[2])


_UPPER = "[A-Z][A-Za-z0-9_]*"
#: The plain rules for scripts inside components: types have capitals, members and object methods are not read.
_SCRIPT = [
    (rf"(?:export\s+)?(?:abstract\s+)?class\s+(?P<name>{_UPPER})\s*(?:<[^>]*>)?\s*(?P<parents>(?:extends|implements)\b[^{{]*)?", "class"),
    (rf"(?:export\s+)?interface\s+(?P<name>{_UPPER})\s*(?:<[^>]*>)?\s*(?P<parents>extends\b[^{{]*)?", "interface"),
    (rf"(?:export\s+)?type\s+(?P<name>{_UPPER})\s*(?:<[^>]*>)?\s*=", "typealias"), (rf"(?:export\s+)?(?:const\s+)?enum\s+(?P<name>{_UPPER})", "enum"),
    (r"(?:export\s+)?(?:async\s+)?function\s+(?P<name>[a-zA-Z_]\w*)\s*(?:<[^>]*>)?\s*\(", "function"),
    (r"(?:export\s+)?(?:const|let)\s+(?P<name>[a-zA-Z_]\w*)\s*(?::\s*[^=]+)?\s*=\s*(?:async\s+)?(?:\([^)]*\)\s*(?::\s*[^=]+)?|[a-zA-Z_]\w*)\s*=>", "function"),
    (r"(?:export\s+)?(?:const|function)\s+(?P<name>use[A-Z]\w*)", "function"), (rf"(?P<name>@\w*(?:{'|'.join(SCRIPT_DECORATORS)})\w*)", "annotation"),
    (r"import\s+(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)\s+from\s+['\"](?P<name>(?:\.|@/|~)[^'\"]*)['\"]", "import"), (r"(?:export\s+)?const\s+(?P<name>[A-Z][A-Z0-9_]+)\s*(?::\s*[^=]+)?\s*=", "constant"),
    (rf"(?:export\s+)?(?:declare\s+)?namespace\s+(?P<name>{_UPPER})", "package"), (r"export\s+let\s+(?P<name>[a-zA-Z_]\w*)", "property"),
]


def parse_script(text: str) -> list[Symbol]:
    """The scripts of a component file by plain rules; a component may name itself."""
    clean, lines = with_imports(strip_c(text).split("\n")), text.split("\n")
    out: list[Symbol] = []
    for n, line in enumerate(clean, 1):
        whole = joined("typescript", clean, n - 1)[0]
        for p, kind in _SCRIPT:
            if (m := re.match(r"[ \t]*" + p, whole)) and not (kind == "constant" and len(line) - len(line.lstrip()) > 2):
                kind = "class" if kind == "function" and m["name"][0].isupper() else kind
                out.append((m["name"], kind, n, lines[n - 1].strip(), keyword_parents(m.groupdict().get("parents"))))
                break
    for m in re.finditer(rf"defineComponent\s*\(\s*\{{[^}}]*name\s*:\s*['\"]({_UPPER})['\"]", "\n".join(clean)):
        n = "\n".join(clean).count("\n", 0, m.start()) + 1
        out.append((m[1], "class", n, lines[n - 1].strip(), []))
    return sorted(out, key=lambda x: x[2])


def parse_perl(text: str) -> list[Symbol]:
    """Parents belong to the package that they stand in, or wait for the first one."""
    out: list[Symbol] = []
    waiting: list[tuple[str, str]] = []
    package: Symbol | None = None
    for n, line in enumerate(strip_perl(text).split("\n"), 1):
        s, found = line.strip(), []
        if m := re.match(r"\s*package\s+([\w:]+)", line):
            package = (m[1], "package", n, s, list(waiting))
            waiting.clear()
            out.append(package)
        elif m := re.match(r"\s*sub\s+(\w+)", line):
            out.append((m[1], "function", n, s, []))
        elif m := re.match(r"\s*use\s+constant\s+([A-Z_][A-Z0-9_]*)\s*=>", line):
            out.append((m[1], "constant", n, s, []))
        elif m := re.match(r"\s*use\s+(?:base|parent)\s+(.+?);", line):
            found = [x for x in re.findall(r"[\w:]+", re.sub(r"-norequire|\bqw\b", "", m[1])) if x]
        elif m := re.match(r"\s*(?:our\s+)?@ISA\s*=\s*(.+?);", line):
            found = [x for x in re.findall(r"[\w:]+", re.sub(r"\bqw\b", "", m[1])) if x]
        elif (m := re.match(r"\s*our\s+([$@%][A-Za-z_]\w*)", line)) and m[1] != "@ISA":
            out.append((m[1], "property", n, s, []))
        (package[4] if package else waiting).extend((x, "extends") for x in found)
    return out


def parse_wsdl(text: str) -> list[Symbol]:
    lines, out = strip_xml(text).split("\n"), []
    kinds = {"portType": "interface", "operation": "function", "service": "class", "complexType": "class"}
    for n, line in enumerate(lines, 1):
        if m := re.search(r'targetNamespace="([^"]+)"', line):
            out.append((m[1], "package", n, line.strip(), []))
        if not (m := re.search(r'<(?:\w+:)?(complexType|simpleType|element|portType|operation|service)\b[^>]*?\bname="([^"]+)"', line)):
            continue
        tag, kind = m[1], kinds.get(m[1])
        if tag == "simpleType":
            kind = "enum" if any("<xsd:enumeration" in x or "<xs:enumeration" in x for x in lines[n - 1 : n + 20]) else "typealias"
        elif tag == "element":
            kind = "class" if not re.search(r'\btype="', line) and any(re.search(r"<(?:\w+:)?(?:complexType|simpleType)\b(?![^>]*name=)", x) for x in lines[n - 1 : n + 5]) else None
        if kind:
            out.append((m[2], kind, n, line.strip(), []))
    return out


def parse_component(text: str) -> list[Symbol]:
    """The scripts of a component file, one after another; lines count within them."""
    return parse_script("\n".join(re.findall(r"(?s)<script\b[^>]*>(.*?)</script>", text)))


PARSERS: dict[str, Callable[[str], list[Symbol]]] = {
    **{k: (lambda text, k=k: by_rules(k, text)) for k in RULES},
    "swift": parse_swift, "csharp": parse_csharp, "dart": parse_dart, "objc": parse_objc, "python": parse_python, "go": parse_go, "rust": parse_rust, "ruby": parse_ruby, "cpp": parse_cpp, "proto": parse_proto,
    "typescript": parse_typescript, "perl": parse_perl, "wsdl": parse_wsdl, "vue": parse_component, "svelte": parse_component,
}


def register(lang: str, parser: Callable[[str], list[Symbol]]) -> None:
    PARSERS[lang] = parser


def parse_text(lang: str, text: str, parsers: dict[str, Callable[[str], list[Symbol]]] = PARSERS) -> list[Symbol]:
    if lang not in parsers or len(text.encode("utf-8", "replace")) > MAX_BYTES:
        return []
    seen, out = set(), []
    for s in parsers[lang](text):
        if s[:3] not in seen:
            seen.add(s[:3])
            out.append(s)
    return out


def parse(contents: DataFrame) -> DataFrame:
    """path and the symbols of contents(path, content), a row each. Files that a parser fails on yield none."""
    parsers = dict(PARSERS)  # those registered here, for the workers

    def run(batches):
        for pdf in batches:
            rows = []
            for path, lang, text in zip(pdf["path"], pdf["lang"], pdf["content"], strict=True):
                try:
                    found = parse_text(lang, text or "", parsers)
                except Exception:  # one file must not end the job
                    found = []
                rows += [(path, n, k, line, s, [{"name": a, "kind": b} for a, b in p]) for n, k, line, s, p in found]
            import pandas as pd

            yield pd.DataFrame(rows, columns=["path", "name", "kind", "line", "signature", "parents"])

    source = contents.select("path", language(F.col("path")).alias("lang"), "content").filter("lang IS NOT NULL")
    return source.mapInPandas(run, f"path STRING, {PARSED}")
