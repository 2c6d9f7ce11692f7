"""Snippets of each language: (name, kind) pairs and parents that must be found."""

import pytest

from lexispan.functions.parsers import parse_text, strip_c, strip_python

CASES = {
    "kotlin": ("enum class E { A }\nclass Foo<T>(val a: Int) : Base(a), Iface<T> {\n  override fun bar(x: Int) = 1\n}\n/* class No /* x */ */\ntypealias S = String", {("E", "class"), ("Foo", "class"), ("bar", "function"), ("S", "typealias")}, {"Foo": [("Base", "extends"), ("Iface", "implements")]}),
    "java": ("@Service\npublic class Foo extends Bar implements X, Y {\n  private final int a = 1;\n  public void run() {\n}", {("Foo", "class"), ("a", "property"), ("run", "function"), ("@Service", "annotation")}, {"Foo": [("Bar", "extends"), ("X", "implements"), ("Y", "implements")]}),
    "swift": ("struct A: B, C {\n init() {}\n func f() {}\n}\nextension A: P {}\nprotocol P: Q {}", {("A", "class"), ("A+Extension", "object"), ("P", "interface"), ("init", "function")}, {"A": [("B", "extends"), ("C", "implements")]}),
    "objc": ("@interface A : B\n- (void)run:(int)x;\n@end\n@interface A (Cat)\n", {("A", "class"), ("run", "function"), ("A+Category", "object")}, {"A": [("B", "extends")]}),
    "python": ("from a.b import c\nMAX = 1\nclass A(B, C):\n    def __init__(self): pass\n    def _p(self): pass\n", {("a.b", "import"), ("c", "import"), ("MAX", "constant"), ("A", "class"), ("__init__", "function")}, {"A": [("B", "extends"), ("C", "extends")]}),
    "go": ("package main\nimport (\n  x \"a/b\"\n)\ntype S struct {\n}\nfunc (s *S) M() {}\n", {("main", "package"), ("x", "import"), ("S", "class"), ("M", "function")}, {"M": [("S", "receiver")], "x": [("a/b", "from")]}),
    "rust": ("#[derive(Debug, Clone)]\npub struct S;\ntrait T: U {}\nimpl T for S {}\nconst MAX: u8 = 1;\nuse a::b;", {("#[derive(Debug)]", "annotation"), ("S", "class"), ("T", "interface"), ("MAX", "constant"), ("a::b", "import"), ("impl T for S", "class")}, {"impl T for S": [("T", "implements")]}),
    "ruby": ("module M\nclass A < B\n  has_many :xs\n  def self.f\n  include C\n", {("M", "package"), ("A", "class"), ("has_many :xs", "property"), ("self.f", "function"), ("include C", "import")}, {"A": [("B", "extends")]}),
    "csharp": ("namespace A.B\npublic class Foo : Bar, IBaz {\n  public int X { get; set; }\n  private const int M = 1;\n}", {("A.B", "package"), ("Foo", "class"), ("X", "property"), ("M", "constant")}, {"Foo": [("Bar", "extends"), ("IBaz", "implements")]}),
    "cpp": ("#include <a/b.h>\nclass A : public B {\n};\n#define M(x) x\nvoid Java_com_x_Foo_run() {", {("b.h", "import"), ("A", "class"), ("M", "constant"), ("run", "function")}, {"A": [("B", "extends")]}),
    "dart": ("abstract class A extends B with M implements I {\n  int get q => 1;\n}\nmixin M on B {}\nextension X on String {}", {("A", "class"), ("q", "property"), ("M", "interface"), ("X", "object")}, {"A": [("B", "extends"), ("M", "with"), ("I", "implements")]}),
    "proto": ("package p;\nmessage A {\n message B { int32 x = 1; }\n}\nservice S {\n rpc Get(A) returns (stream B);\n}", {("p", "package"), ("A", "class"), ("A.B", "class"), ("S", "interface"), ("Get", "function")}, {}),
    "scala": ("class A(x: Int) extends B with C {\n def f = 1\n}\ngiven g: X = 1", {("A", "class"), ("f", "function"), ("g", "object")}, {"A": [("B", "extends"), ("C", "implements")]}),
    "typescript": ("import a from './x';\nimport r from 'react';\nexport class A extends B implements C {\n  private x: number = 1;\n}\nexport function Comp() {}\nfunction useX() {}\nconst MAX = 3", {("./x", "import"), ("A", "class"), ("x", "property"), ("Comp", "class"), ("useX", "function"), ("MAX", "constant")}, {"A": [("B", "extends"), ("C", "implements")]}),
    "perl": ("use base qw(X Y);\npackage A::B;\nour $v = 1;\nsub run {\n=pod\nsub no\n=cut\n", {("A::B", "package"), ("$v", "property"), ("run", "function")}, {"A::B": [("X", "extends"), ("Y", "extends")]}),
    "wsdl": ("<d targetNamespace=\"urn:x\">\n<xsd:complexType name=\"A\">\n<xsd:simpleType name=\"E\">\n<xsd:enumeration value=\"1\"/>\n<wsdl:portType name=\"P\">", {("urn:x", "package"), ("A", "class"), ("E", "enum"), ("P", "interface")}, {}),
    "vue": ("<template/>\n<script>\nexport class A {}\n</script>", {("A", "class")}, {}),
}


@pytest.mark.parametrize("lang", CASES)
def test_snippet(lang):
    text, want, parents = CASES[lang]
    found = parse_text(lang, text)
    assert want <= {(n, k) for n, k, *_ in found}
    assert not {"No", "no", "_p", "react"} & {n for n, *_ in found}
    for name, p in parents.items():
        assert next(x[4] for x in found if x[0] == name and x[4]) == p


def test_strippers_keep_lines():
    for strip, text in ((strip_c, 'a // x\n"// no" /* y\nz */ b\n'), (strip_python, '"""a\nb"""\nc # d\n')):
        assert strip(text).count("\n") == text.count("\n")
    assert '"// no"' in strip_c('"// no"')


def test_size_guard():
    assert parse_text("kotlin", "class A\n" + "x" * 1_100_000) == []


#: Headers over several lines, and what one-line rules got wrong.
LINES = [
    ("cpp", "class A final\n : public B\n{\n", {("A", "class", 1): [("B", "extends")]}),
    ("cpp", "void\nf(int a)\n{\n", {("f", "function", 2): []}),
    ("cpp", "class Foo;\nstruct Bar;\nint x = g(1);\n", {}),
    ("cpp", "namespace {\n  void inner() {}\n}\n", {("inner", "function", 2): []}),
    ("cpp", "typedef unsigned long ulong;\ntypedef struct { int x; } Point;\n", {("ulong", "typealias", 1): [], ("Point", "typealias", 2): []}),
    ("cpp", "JNIEXPORT jobject JNICALL\nJava_com_x_Text_analyze(JNIEnv* env) {\n", {("analyze", "function", 2): []}),
    ("python", "from x import (\n  a,\n  b)\nclass A(\n  B,\n  metaclass=M):\n", {("x", "import", 1): [], ("a", "import", 1): [], ("b", "import", 1): [], ("A", "class", 4): [("B", "extends"), ("metaclass", "extends")]}),
    ("rust", "impl<T>\n  Trait for S<T>\n{\n", {("impl Trait for S<T>", "class", 1): [("Trait", "implements")]}),
    ("kotlin", "class Foo(\n val a: Int\n) : Base(a), Iface\nclass Next\n", {("Foo", "class", 1): [("Base", "extends"), ("Iface", "implements")], ("Next", "class", 4): []}),
    ("kotlin", "data class User(val name: String, val age: Int)\nval x = 1\n", {("User", "class", 1): [], ("x", "property", 2): []}),
    ("dart", "class Scope extends Base\n    with One, Two {\n}\n", {("Scope", "class", 1): [("Base", "extends"), ("One", "with"), ("Two", "with")]}),
    ("dart", "void run() {\n  Text('x');\n  other(1);\n  return make(2);\n}\n", {("run", "function", 1): []}),
    ("typescript", "import {\n a } from '@/x';\nimport './y';\nconst obj = {\n  method() { return 1; },\n};\n", {("@/x", "import", 1): [], ("./y", "import", 3): []}),
    ("typescript", "abstract class A {\n  abstract go(x: string): void;\n  #hidden = 1;\n}\n", {("A", "class", 1): [], ("go", "function", 2): [], ("#hidden", "property", 3): []}),
    ("java", "public class A extends Crud<User, Long> implements Repo {\n  protected List<String> items;\n}\n", {("A", "class", 1): [("Crud", "extends"), ("Repo", "implements")], ("items", "property", 2): []}),
    ("csharp", "public class Repo<T> : IRepo<T> where T : class\n{\n  T Get(int id);\n}\n", {("Repo", "class", 1): [("IRepo", "implements")], ("Get", "function", 3): []}),
    ("objc", "@implementation Foo\n- (void)go {\n}\n@end\n", {("Foo", "class", 1): [], ("go", "function", 2): []}),
    ("go", "type (\n  A struct {\n    x int\n  }\n  B interface{}\n)\nvar (\n  C = 1\n)\n", {("A", "class", 2): [], ("B", "interface", 5): [], ("C", "property", 8): []}),
    ("vue", "<script>\nexport default defineComponent({\n  name: 'Card',\n});\n</script>", {("Card", "class", 2): []}),
]


@pytest.mark.parametrize("case", range(len(LINES)))
def test_declarations_over_lines(case):
    lang, text, want = LINES[case]
    assert {s[:3]: s[4] for s in parse_text(lang, text)} == want


@pytest.mark.parametrize("lang", sorted(CASES))
def test_odd_texts_do_not_fail(lang):
    for text in ("", "\n", "(" * 500, "{" * 300 + "\n" * 100, "class", "class A(\n" * 60, "\x00\u2028é" * 50, "import (\n", "typedef struct {\n", "/* never closed\nclass A {}"):
        assert isinstance(parse_text(lang, text), list)


def test_one_bad_file_does_not_end_the_job(spark):
    from lexispan.functions import parsers

    def fails(text):
        raise KeyError(text)

    parsers.register("scala", fails)
    try:
        df = spark.createDataFrame([("a.scala", "class A"), ("b.kt", "class B")], "path string, content string")
        assert [r.name for r in parsers.parse(df).collect()] == ["B"]
    finally:
        parsers.register("scala", lambda text: parsers.by_rules("scala", text))
