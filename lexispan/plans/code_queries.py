"""Queries over source files made from templates: parsers, scans, extraction of modules and resources, reports.

Each has its files, what it runs, and the rows that must come out for each part; those rows are written down, not derived from the code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers
from ..operators import extract, graph, insight, resources, scan
from ..shared import shuffled, written
from ..sources import tree
from ..sources.code import Code, expected
from . import build

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, files: dict[str, str], run: Callable[[Code], DataFrame], columns: str, rows: list[tuple] | str) -> None:
    """rows: what comes out for each part; or a whole statement, where it isn't one row after another."""
    QUERIES[name] = lambda spark, sf_dir: run(Code(spark, sf_dir, files))
    ORACLE[name] = rows if isinstance(rows, str) else expected(columns, rows)


def _parsed(c: Code) -> DataFrame:
    parents = F.array_join(F.transform("parents", lambda p: F.concat_ws(":", p["name"], p["kind"])), ",")
    return parsers.parse(c.contents).select("path", "name", "kind", "line", parents.alias("parents"))


def parser(lang: str, ext: str, text: str, rows: list[tuple]) -> None:
    path = f"m{{i}}/src/a.{ext}"
    add(f"parse_{lang}", {path: text}, _parsed, "path VARCHAR, name VARCHAR, kind VARCHAR, line INTEGER, parents VARCHAR", [(path, n, k, line, p[0] if p else "") for n, k, line, *p in rows])


# --- parsers ---
parser("kotlin", "kt", """package p{i}
import a.b.Thing{i}

/* class Hidden /* nested */ class Too */
enum class Colour { RED }
class Account{i}<T>(
    val id: Int,
    private val name: String = "x",
) : Base{i}(id),
    Readable,
    Comparable<Account{i}<T>> {
    val size: Int = 0
    override suspend fun load(
        key: String,
    ): Int = 1
}
sealed interface Shape : Drawable
object Registry : Service()
typealias Names = List<String>
fun <T> List<T>.second(): T = this[1]
""", [("p{i}", "package", 1), ("a.b.Thing{i}", "import", 2), ("Colour", "class", 5), ("Account{i}", "class", 6, "Base{i}:extends,Readable:implements,Comparable:implements"), ("size", "property", 12), ("load", "function", 13), ("Shape", "interface", 17, "Drawable:extends"), ("Registry", "object", 18, "Service:extends"), ("Names", "typealias", 19), ("second", "function", 20)])
parser("java", "java", """package p{i};
import java.util.List;
@Service
@Deprecated
public final class Ledger{i}
        extends Base<String>
        implements Closeable,
                   Comparable<Ledger{i}>
{
    private static final int MAX = 3;
    public Ledger{i}(int a,
            int b) {
        return;
    }
    @Override
    public List<String> names() { return null; }
}
interface Reader extends AutoCloseable {
    String read(String key);
}
enum Level { LOW }
""", [("p{i}", "package", 1), ("java.util.List", "import", 2), ("@Service", "annotation", 3), ("Ledger{i}", "class", 5, "Base:extends,Closeable:implements,Comparable:implements"), ("MAX", "property", 10), ("Ledger{i}", "function", 11), ("@Override", "annotation", 15), ("names", "function", 16), ("Reader", "interface", 18, "AutoCloseable:extends"), ("read", "function", 19), ("Level", "enum", 21)])
parser("swift", "swift", """import Foundation
public final class Loader{i}: NSObject,
    Sendable
{
    @Published var state = 0
    init(id: Int) {}
    func fetch(
        key: String
    ) async -> Int { 1 }
}
struct Point: Codable {}
enum Side: String { case left }
protocol Drawable: AnyObject {}
extension Loader{i}: Drawable {}
typealias Done = () -> Void
""", [("Foundation", "import", 1), ("Loader{i}", "class", 2, "NSObject:extends,Sendable:implements"), ("state", "property", 5), ("init", "function", 6), ("fetch", "function", 7), ("Point", "class", 11, "Codable:extends"), ("Side", "enum", 12, "String:extends"), ("Drawable", "interface", 13, "AnyObject:extends"), ("Loader{i}+Extension", "object", 14, "Loader{i}:extends,Drawable:implements"), ("Done", "typealias", 15)])
parser("objc", "m", """#import <Foundation/Foundation.h>
typedef struct {
    int x;
} Place{i};
@protocol Fetching <NSObject, NSCopying>
- (void)fetch;
@end
@interface View{i} : UIView <Fetching, NSCoding>
@property (nonatomic, strong) NSString *title;
+ (instancetype)shared;
@end
@interface NSString (Extra)
@end
@implementation View{i}
@end
""", [("Foundation/Foundation.h", "import", 1), ("Place{i}", "typealias", 2), ("Fetching", "interface", 5, "NSObject:extends,NSCopying:extends"), ("fetch", "function", 6), ("View{i}", "class", 8, "UIView:extends,Fetching:implements,NSCoding:implements"), ("title", "property", 9), ("shared", "function", 10), ("NSString+Category", "object", 12, "NSString:extends")])
parser("python", "py", '''"""Doc class No."""
import os, sys as system
from a.b import (
    c{i},
    d as e,
)
LIMIT = 5
Names = List[str]
@dataclass
class Box{i}(
    Base,
    Mixin,
):
    def __init__(self): pass
    def _hidden(self): pass
    async def load(
        self, key,
    ): pass
# class Gone: pass
''', [("os", "import", 2), ("sys", "import", 2), ("a.b", "import", 3), ("c{i}", "import", 3), ("d", "import", 3), ("LIMIT", "constant", 7), ("Names", "typealias", 8), ("@dataclass", "annotation", 9), ("Box{i}", "class", 10, "Base:extends,Mixin:extends"), ("__init__", "function", 14), ("load", "function", 16)])
parser("go", "go", """package main
import (
    "fmt"
    log "github.com/x/logrus"
)
const (
    First{i} = iota
    Second
)
var Shared int
type ID int64
type Store struct {
    name string
}
type Reader interface {
    Read() error
}
func (s *Store) Save(
    key string,
) error {
    return nil
}
func New() *Store { return nil }
""", [("main", "package", 1), ("fmt", "import", 3, "fmt:from"), ("log", "import", 4, "github.com/x/logrus:from"), ("First{i}", "constant", 7), ("Second", "constant", 8), ("Shared", "property", 10), ("ID", "typealias", 11, "int64:alias"), ("Store", "class", 12), ("Reader", "interface", 15), ("Save", "function", 18, "Store:receiver"), ("New", "function", 23)])
parser("rust", "rs", """use std::fmt::Debug;
#[derive(Debug, Clone)]
pub struct Key{i}(u8);
pub trait Store: Send {
    fn get(&self) -> u8;
}
impl<T: Clone>
    Store for Map<T>
where
    T: Debug,
{
    fn get(&self) -> u8 { 1 }
}
impl Key{i} {
    pub async fn load(
        &self,
    ) -> u8 { 2 }
}
#[test]
fn checks() {}
const LIMIT: u8 = 3;
macro_rules! twice { () => {} }
mod inner;
type Id = u64;
enum Side { Left }
""", [("std::fmt::Debug", "import", 1), ("#[derive(Debug)]", "annotation", 2), ("#[derive(Clone)]", "annotation", 2), ("Key{i}", "class", 3), ("Store", "interface", 4), ("get", "function", 5), ("impl Store for Map<T>", "class", 7, "Store:implements"), ("get", "function", 12), ("impl Key{i}", "class", 14), ("load", "function", 15), ("#[test]", "annotation", 19), ("checks", "function", 20), ("LIMIT", "constant", 21), ("twice!", "function", 22), ("inner", "package", 23), ("Id", "typealias", 24), ("Side", "enum", 25)])
parser("ruby", "rb", """require 'json'
module Admin
  class Post{i} < ApplicationRecord
    include Publishable
    attr_accessor :title
    LIMIT = 3
    has_many :comments
    validates :title
    before_save :tidy
    scope :recent, -> { order(:id) }
    def self.find_it(slug)
    end
    def publish!
    end
  end
end
describe "Post" do
  let(:user) { 1 }
  it "works" do
  end
end
""", [("json", "import", 1), ("Admin", "package", 2), ("Post{i}", "class", 3, "ApplicationRecord:extends"), ("include Publishable", "import", 4), (":title", "property", 5), ("LIMIT", "constant", 6), ("has_many :comments", "property", 7), ("validates :title", "annotation", 8), ("before_save :tidy", "annotation", 9), ("scope :recent", "function", 10), ("self.find_it", "function", 11), ("publish!", "function", 13), ('describe "Post"', "class", 17), ("let(:user)", "property", 18), ('it "works"', "function", 19)])
parser("csharp", "cs", """using System.Text;
namespace App.Models{i}
{
    [ApiController]
    [Route("api/[controller]")]
    public class Users{i}
        : ControllerBase,
          IDisposable
    {
        private readonly ILogger _log;
        public const int MAX = 5;
        public string Name { get; set; }
        public event EventHandler Changed;
        public Users{i}(ILogger log)
        {
        }
        [HttpGet, Authorize]
        public async Task<int> GetAsync(
            int id)
        {
            return Go(id);
        }
    }
    public interface IStore : IBasic
    {
        int Load(int id);
    }
    public record Pair(string A, string B) : Base(A);
    public enum Side { Left }
    public delegate void Handler(int x);
}
""", [("System.Text", "import", 1), ("App.Models{i}", "package", 2), ("[ApiController]", "annotation", 4), ("[Route]", "annotation", 5), ("Users{i}", "class", 6, "ControllerBase:extends,IDisposable:implements"), ("_log", "property", 10), ("MAX", "constant", 11), ("Name", "property", 12), ("Changed", "property", 13), ("Users{i}", "function", 14), ("[HttpGet]", "annotation", 17), ("[Authorize]", "annotation", 17), ("GetAsync", "function", 18), ("IStore", "interface", 24, "IBasic:implements"), ("Load", "function", 26), ("Pair", "class", 28, "Base:extends"), ("Side", "enum", 29), ("Handler", "typealias", 30)])
parser("cpp", "cpp", """#include <util/generic/string.h>
#define MAX(a, b) ((a) > (b) ? (a) : (b))
namespace ns{i} {
template <typename T>
class Box{i} final
    : public Base<T>,
      private Other
{
public:
    int size() const;
};
class Forward;
void
run(int a)
{
    if (a) return;
}
void Box{i}::draw(
    int x) {
}
Box{i}::~Box{i}() {
}
enum class Side : int { Left };
typedef void (*Callback)(int);
using Name = std::string;
}
""", [("string.h", "import", 1, "util/generic/string.h:from"), ("MAX", "constant", 2), ("ns{i}", "package", 3), ("Box{i}", "class", 5, "Base:extends,Other:extends"), ("size", "function", 10), ("run", "function", 14), ("draw", "function", 18, "Box{i}:member"), ("~Box{i}", "function", 21, "Box{i}:member"), ("Side", "enum", 23), ("Callback", "typealias", 24), ("Name", "typealias", 25)])
parser("dart", "dart", """import 'package:flutter/material.dart';
import 'dart:async';
typedef Json = Map<String, dynamic>;
class Shop{i}<T extends Model>
    extends Base<T>
    with Logging, Caching
    implements Disposable {
  Shop{i}(this.a);
  Shop{i}.empty() : a = 1;
  factory Shop{i}.of() => Shop{i}(2);
  int get count => 1;
  Future<void> load(
    String key,
  ) async {
    print(key);
  }
}
mixin Logging on Object {}
extension ShopX on Shop{i} {}
extension type UserId(int id) implements int {}
enum Side with Mixed { left }
abstract interface class Scope {}
const String version = '1';
""", [("material", "import", 1), ("dart:async", "import", 2), ("Json", "typealias", 3), ("Shop{i}", "class", 4, "Base:extends,Logging:with,Caching:with,Disposable:implements"), ("Shop{i}", "function", 8), ("Shop{i}.empty", "function", 9), ("Shop{i}.of", "function", 10), ("count", "property", 11), ("load", "function", 12), ("Logging", "interface", 18, "Object:extends"), ("ShopX", "object", 19, "Shop{i}:extends"), ("UserId", "class", 20, "int:implements"), ("Side", "enum", 21, "Mixed:with"), ("Scope", "interface", 22), ("version", "property", 23)])
parser("proto", "proto", """syntax = "proto3";
package api.v{i};
option java_package = "com.x";
import "a/b.proto";
message Outer{i} {
  message Inner { string a = 1; }
  enum Kind { A = 0; }
}
service Shop {
  rpc Get(Req) returns (stream Res);
  rpc Put(
    Req
  ) returns (Res) {}
}
""", [("api.v{i}", "package", 2), ("java_package:com.x", "property", 3), ("a/b.proto", "import", 4), ("Outer{i}", "class", 5), ("Outer{i}.Inner", "class", 6, "Outer{i}:nested_in"), ("Outer{i}.Kind", "enum", 7, "Outer{i}:nested_in"), ("Shop", "interface", 9), ("Get", "function", 10), ("Put", "function", 11)])
parser("scala", "scala", """package x
case class Dog{i}(
  name: String
) extends Animal
  with Serializable {
  def speak(): String = ""
  val age = 1
}
trait Repo[T] extends Closeable
object Main extends App
type Ids = List[Int]
enum Side { case Left }
given ord: Ordering[Int] = null
""", [("Dog{i}", "class", 2, "Animal:extends,Serializable:implements"), ("speak", "function", 6), ("age", "property", 7), ("Repo", "interface", 9, "Closeable:extends"), ("Main", "object", 10, "App:extends"), ("Ids", "typealias", 11), ("Side", "enum", 12), ("ord", "object", 13)])
parser("typescript", "ts", """import {
  a,
  b,
} from './x{i}';
import React from 'react';
@Injectable()
export class Users{i}
  extends Base
  implements Store, Other {
  private name: string = 'a';
  constructor(private http: Http) {}
  getAll(id: string): string {
    return this.http.get(id);
  }
}
export interface Shape extends Drawable {}
export type Id = string;
enum Side { Left }
export function useThing() {}
export const Card = ({ user }: Props) => {
};
const LIMIT = 3;
namespace Utils {}
""", [("./x{i}", "import", 1), ("@Injectable", "annotation", 6), ("Users{i}", "class", 7, "Base:extends,Store:implements,Other:implements"), ("name", "property", 10), ("constructor", "function", 11), ("getAll", "function", 12), ("Shape", "interface", 16, "Drawable:extends"), ("Id", "typealias", 17), ("Side", "enum", 18), ("useThing", "function", 19), ("Card", "class", 20), ("LIMIT", "constant", 22), ("Utils", "package", 23)])
parser("perl", "pm", """use base qw(X{i} Y);
package A::B{i};
use parent 'Base::C';
our $VERSION = '1';
our @ISA = qw(D);
use constant LIMIT => 3;
sub run {
}
=pod
sub hidden
=cut
""", [("A::B{i}", "package", 2, "X{i}:extends,Y:extends,Base::C:extends,D:extends"), ("$VERSION", "property", 4), ("LIMIT", "constant", 6), ("run", "function", 7)])
parser("wsdl", "wsdl", """<definitions targetNamespace="urn:x{i}">
<xsd:complexType name="A">
<xsd:simpleType name="E">
<xsd:enumeration value="1"/>
</xsd:simpleType>
<xsd:element name="El">
<xsd:complexType>
<wsdl:portType name="P">
<wsdl:operation name="Op">
<wsdl:service name="S">
<!-- <xsd:complexType name="No"> -->
""", [("urn:x{i}", "package", 1), ("A", "class", 2), ("E", "enum", 3), ("El", "class", 6), ("P", "interface", 8), ("Op", "function", 9), ("S", "class", 10)])
parser("vue", "vue", """<template><div/></template>
<script setup lang="ts">
import { x } from './x{i}';
const LIMIT = 1;
function load() {}
</script>
""", [("./x{i}", "import", 2), ("LIMIT", "constant", 3), ("load", "function", 4)])
parser("svelte", "svelte", """<script>
  export let title{i};
  const go = () => {};
</script>
""", [("title{i}", "property", 2), ("go", "function", 3)])

# --- scans ---
KT, SWIFT, PM, TEST, GO, PY, CPP = "app{i}/src/Main.kt", "app{i}/src/View.swift", "lib{i}/A.pm", "lib{i}/a.t", "srv{i}/main.go", "srv{i}/a.py", "srv{i}/x.cpp"
SOURCES = {
    KT: """package app
import dagger.Module
@Module
class Main{i} {
  // TODO fix {i}
  private val flow = MutableStateFlow<Int>(0)
  @Inject lateinit var repo: Repo
  @Composable
  @Preview
  fun Screen(x: Int) {
    repo.load(x)
  }
  suspend fun fetch{i}() {
    load(1)
    return load(2)
  }
  @Suppress("x")
  fun String.shout() = 1
  @Provides
  fun repo(): Repo = Real()
  internal fun hidden() {}
  fun load(a: Int): Int = 1
  val link = "deepLink://x"
  @Deprecated("old") fun old() {}
}
""",
    SWIFT: """import Combine
@MainActor
class Model{i}: ObservableObject {
  @Published private var count = 0
  @State var name = ""
  let subject = PassthroughSubject<Int, Never>()
  func load(id: Int) async -> Int { 1 }
}
extension String { }
""",
    PM: """package A{i};
use strict;
use List::Util;
our @EXPORT = qw(run);
sub run {
  my $x = $self->load(1);
}
=head1 NAME
=cut
# DEPRECATED thing
""",
    TEST: """ok(1);
is(1, 1);
done_testing();
my $ok = nothing(2);
""",
    GO: """package main
import "fmt"
import (
  "net/http"
  log "x/y"
)
func main() {}
""",
    PY: """import os
from a.b import c, d
class Job{i}:
async def run():
def stop():
""",
    CPP: """#include <map>
namespace ns {
class Box {
void Box::draw(int a) {
int main() {
""",
}


def scanned(name: str, run: Callable[[DataFrame], DataFrame], columns: str, rows: list[tuple]) -> None:
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    add(name, SOURCES, lambda c: run(c.lines).select(*names), columns, rows)


_AT = "path VARCHAR, line INTEGER"
scanned("scan_todo", lambda x: scan.todo(x, per_category=10**9), f"category VARCHAR, {_AT}", [("TODO", KT, 5)])
scanned("scan_callers", lambda x: scan.callers(x, "load", limit=None), _AT, [(KT, 11), (KT, 14), (PM, 6)])
scanned("scan_provides", lambda x: scan.provides(x, "Repo", None), f"{_AT}, content VARCHAR", [(KT, 19, "fun repo(): Repo = Real()")])
scanned("scan_suspend", lambda x: scan.run("suspend", x, "FETCH", None), f"{_AT}, name VARCHAR", [(KT, 13, "fetch{i}")])
scanned("scan_composables", lambda x: scan.annotated_functions(x, "@Composable"), f"{_AT}, name VARCHAR", [(KT, 10, "Screen")])
scanned("scan_previews", lambda x: scan.annotated_functions(x, "@Preview", "scr"), f"{_AT}, name VARCHAR", [(KT, 10, "Screen")])
scanned("scan_deprecated", lambda x: scan.run("deprecated", x, None, None), _AT, [(KT, 24), (PM, 10)])
scanned("scan_suppress", lambda x: scan.run("suppress", x, None, None), _AT, [(KT, 17)])
scanned("scan_inject", lambda x: scan.inject(x, "Repo", None), f"{_AT}, content VARCHAR", [(KT, 7, "@Inject lateinit var repo: Repo")])
scanned("scan_annotations", lambda x: scan.annotations(x, "Module", limit=None), _AT, [(KT, 3)])
scanned("scan_deeplinks", lambda x: scan.run("deeplinks", x, None, None), _AT, [(KT, 23)])
scanned("scan_extensions", lambda x: scan.extension_functions(x, "String", None), f"{_AT}, name VARCHAR, lang VARCHAR", [(KT, 18, "shout", "kt"), (SWIFT, 9, "extension String { }", "swift")])
scanned("scan_flows", lambda x: scan.run("flows", x, "private", None), f"{_AT}, name VARCHAR", [(KT, 6, "MutableStateFlow")])
scanned("scan_usages", lambda x: scan.usages(x, "Repo", limit=None), _AT, [(KT, 7), (KT, 20)])
scanned("scan_public_api", lambda x: scan.public_api(x, "app", None), f"{_AT}, kind VARCHAR, name VARCHAR", [(KT, 4, "class", "Main{i}"), (KT, 10, "fun", "Screen"), (KT, 13, "fun", "fetch{i}"), (KT, 18, "fun", "String"), (KT, 20, "fun", "repo"), (KT, 22, "fun", "load"), (KT, 24, "fun", "old")])
scanned("scan_swiftui", scan.swiftui, f"{_AT}, type VARCHAR, name VARCHAR", [(SWIFT, 4, "Published", "count"), (SWIFT, 5, "State", "name")])
scanned("scan_async_functions", lambda x: scan.run("async-funcs", x, None, None), f"{_AT}, name VARCHAR", [(SWIFT, 7, "load")])
scanned("scan_publishers", scan.publishers, f"{_AT}, type VARCHAR, name VARCHAR", [(SWIFT, 6, "PassthroughSubject", "")])
scanned("scan_main_actor", lambda x: scan.run("main-actor", x, None, None), _AT, [(SWIFT, 2)])
scanned("scan_perl_exports", lambda x: scan.run("perl-exports", x, None, None), _AT, [(PM, 4)])
scanned("scan_perl_subs", lambda x: scan.run("perl-subs", x, None, None), f"{_AT}, name VARCHAR", [(PM, 5, "run")])
scanned("scan_perl_pod", lambda x: scan.run("perl-pod", x, None, None), f"{_AT}, name VARCHAR", [(PM, 8, "head1"), (PM, 9, "cut")])
scanned("scan_perl_tests", lambda x: scan.run("perl-tests", x, None, None), f"{_AT}, name VARCHAR", [(TEST, 1, "ok"), (TEST, 2, "is"), (TEST, 3, "done_testing")])
scanned("scan_perl_imports", lambda x: scan.perl_imports(x, None, None), f"{_AT}, content VARCHAR", [(PM, 3, "use List::Util;")])
scanned("changed_declarations", extract.changed_declarations, f"{_AT}, kind VARCHAR, name VARCHAR", [(KT, 4, "class", "Main{i}"), (KT, 10, "fun", "Screen"), (KT, 13, "fun", "fetch{i}"), (KT, 18, "fun", "String"), (KT, 20, "fun", "repo"), (KT, 22, "fun", "load"), (SWIFT, 3, "class", "Model{i}")])
scanned("imports_by_language", extract.imports, f"{_AT}, name VARCHAR", [(KT, 2, "dagger.Module"), (SWIFT, 1, "Combine"), (PM, 3, "use List::Util"), (GO, 2, "fmt"), (GO, 4, "net/http"), (GO, 5, "x/y"), (PY, 1, "import os"), (PY, 2, "from a.b import c, d"), (CPP, 1, "map")])
scanned("call_edges", graph.call_edges, "caller VARCHAR, callee VARCHAR, path VARCHAR", [("Screen", "load", KT), ("fetch{i}", "load", KT), ("load", "shout", KT)])  # what has a word and a blank before it defines; a receiver's name does not
add("outline_by_language", SOURCES, lambda c: extract.outline_of(c.contents).select("path", "line", "kind", "name"), f"{_AT}, kind VARCHAR, name VARCHAR", [
    (KT, 4, "class", "Main{i}"), (KT, 6, "val", "flow"), (KT, 10, "fun", "Screen"), (KT, 13, "fun", "fetch{i}"), (KT, 18, "fun", "String"), (KT, 20, "fun", "repo"), (KT, 21, "fun", "hidden"), (KT, 22, "fun", "load"), (KT, 23, "val", "link"),
    (SWIFT, 3, "class", "Model{i}"), (SWIFT, 4, "property", "count"), (SWIFT, 5, "property", "name"), (SWIFT, 6, "property", "subject"), (SWIFT, 7, "function", "load"), (SWIFT, 9, "object", "String+Extension"),
    (PM, 1, "package", "A{i}"), (PM, 4, "our", "@EXPORT"), (PM, 5, "sub", "run"), (GO, 1, "package", "main"), (GO, 7, "func", "main"), (PY, 3, "class", "Job{i}"), (PY, 4, "async function", "run"), (PY, 5, "function", "stop"),
    (CPP, 2, "namespace", "ns"), (CPP, 3, "class", "Box"), (CPP, 4, "function", "Box::draw"), (CPP, 5, "function", "main"),
])

# --- references ---
add("stop_words", {"m{i}/a.kt": "val repo = Repo{i}(String(hashCode(Nothing(crossinline(println(\n// Comment(\nimport Foo\nis(when(by(\n"}, lambda c: extract.references(c.lines).select("path", "name", "line"), "path VARCHAR, name VARCHAR, line INTEGER", [("m{i}/a.kt", "Repo{i}", 1), ("m{i}/a.kt", "hashCode", 1), ("m{i}/a.kt", "println", 1)])

# --- trees ---
_GONE = ("node_modules", "__pycache__", ".build", "build", "dist", "target", "vendor", ".gradle", ".idea", "Pods", "DerivedData", ".next", ".nuxt", ".venv", "venv", ".tox", "coverage", ".cache", "out", "bazel-out", "bazel-bin", "bazel-genfiles", "bazel-testlogs", "buck-out", "_build", ".metals", ".bsp", ".dart_tool", "tmp", "temp", ".mypy_cache", ".pytest_cache", ".ruff_cache", "_site", ".turbo", ".parcel-cache", ".hidden")
_KEPT = ("src", "obj", "bin", "env", "builds")
add("excluded_dirs", {f"m{{i}}/{d}/a.kt": "" for d in (*_GONE, *_KEPT)}, lambda c: c.files.filter(~tree.pruned(F.col("path"))).select("path"), "path VARCHAR", [(f"m{{i}}/{d}/a.kt",) for d in _KEPT])
_EXT = {"kt": "kotlin", "java": "java", "swift": "swift", "m": "objc", "h": "cpp", "pm": "perl", "pl": "perl", "t": "perl", "proto": "proto", "wsdl": "wsdl", "xsd": "wsdl", "cpp": "cpp", "cc": "cpp", "c": "cpp", "hpp": "cpp", "py": "python", "go": "go", "rs": "rust", "rb": "ruby", "cs": "csharp", "dart": "dart", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "vue": "vue", "svelte": "svelte", "scala": "scala", "sc": "scala", "cxx": None, "xml": None, "md": None}
add("languages", {f"m{{i}}/a.{e}": "" for e in _EXT}, lambda c: c.files.select("path", tree.language(F.col("path")).alias("lang")), "path VARCHAR, lang VARCHAR", [(f"m{{i}}/a.{e}", lang) for e, lang in _EXT.items()])
add("sub_projects", {"m{i}/Cargo.toml": "", "m{i}/src/a.rs": "", "n{i}/notes.txt": "", "o{i}/Makefile": "", "build/go.mod": ""}, lambda c: tree.sub_projects(c.files), "dir VARCHAR, marked BOOLEAN", [("m{i}", True), ("n{i}", False), ("o{i}", True)])
_RULES = tree.ignore_rules("*.log\n!keep.log\n/top/\nsrc/**/gen\n# note\ndocs/*.md\n")
add("ignore_rules", {p: "" for p in ("m{i}/a.log", "m{i}/keep.log", "top/a{i}.kt", "m{i}/top/a.kt", "src/x{i}/gen/a.kt", "src/x{i}/general/a.kt", "docs/a{i}.md", "docs/in/a{i}.md")}, lambda c: c.files.filter(~tree.ignored(F.col("path"), _RULES)).select("path"), "path VARCHAR", [("m{i}/keep.log",), ("m{i}/top/a.kt",), ("src/x{i}/general/a.kt",), ("docs/in/a{i}.md",)])
add("path_classes", {p: "" for p in ("m{i}/build.gradle", "m{i}/Main.xib", "m{i}/A.xcassets/x.json", "m{i}/res/layout/a.xml", "m{i}/res/raw/a.bin", "m{i}/a.kt", "m{i}/a.txt")}, lambda c: c.files.select("path", tree.path_class(F.col("path")).alias("path_class")), "path VARCHAR, path_class VARCHAR", [("m{i}/build.gradle", "module"), ("m{i}/Main.xib", "storyboard"), ("m{i}/A.xcassets/x.json", "asset"), ("m{i}/res/layout/a.xml", "layout"), ("m{i}/res/raw/a.bin", "resource"), ("m{i}/a.kt", "source"), ("m{i}/a.txt", None)])

# --- modules ---
BUILDS = {
    "x{i}/app/build.gradle.kts": 'dependencies {\n  api(projects.x{i}.core{i})\n  implementation(project(":x{i}:ui"))\n  testImplementation(project(":nope"))\n}',
    "x{i}/core{i}/build.gradle": "plugins {}", "x{i}/ui/build.gradle": "plugins {}",
    "x{i}/pkg/Package.swift": '.target(name: "Core{i}"), .testTarget(\n  name: "CoreTests")', "x{i}/lib/M.pm": "package My::M{i};\n1;\n",
    "x{i}/svc/pom.xml": "<project><artifactId>parent</artifactId><dependency><groupId>g</groupId>\n<artifactId> core{i} </artifactId></dependency></project>",
    "x{i}/Podfile": "target 'A' do\n  pod 'Alamo{i}'\nend\n", "x{i}/Cartfile": 'github "a/Repo{i}"\n',
}
_MODULE = "name VARCHAR, path VARCHAR"
add("modules_gradle", BUILDS, lambda c: extract.gradle_modules(c.files), _MODULE, [("x{i}.app", "x{i}/app"), ("x{i}.core{i}", "x{i}/core{i}"), ("x{i}.ui", "x{i}/ui")])
add("modules_swift", BUILDS, lambda c: extract.swift_targets(c.contents), _MODULE, [("x{i}.pkg.Core{i}", "x{i}/pkg/Core{i}"), ("x{i}.pkg.CoreTests", "x{i}/pkg/CoreTests")])
add("modules_perl", BUILDS, lambda c: extract.perl_packages(c.contents), _MODULE, [("My::M{i}", "x{i}/lib/M.pm")])
add("modules_maven", BUILDS, lambda c: extract.maven_modules(c.contents), _MODULE, [("x{i}.svc", "x{i}/svc")])
add("modules_pods", BUILDS, lambda c: extract.package_managers(c.lines), f"{_MODULE}, kind VARCHAR", [("pod.Alamo{i}", "x{i}/Podfile", "cocoapods"), ("carthage.Repo{i}", "x{i}/Cartfile", "carthage")])


def _named_deps(c: Code) -> DataFrame:
    modules = written(build.module_tables(c.contents), "modules")
    name = lambda key, to: shuffled(modules.select(F.col("id").alias(key), F.col("name").alias(to)))
    return build.dependency_tables(c.contents, modules).join(name("module_id", "module"), "module_id").join(name("dep_module_id", "dependency"), "dep_module_id").select("module", "dependency", "dep_kind")


add("module_dependencies", BUILDS, _named_deps, "module VARCHAR, dependency VARCHAR, dep_kind VARCHAR", [("x{i}.app", "x{i}.core{i}", "api"), ("x{i}.app", "x{i}.ui", "implementation"), ("x{i}.svc", "x{i}.core{i}", "compile")])
add("prefix_without_boundary", {"core{i}-ui/b.kt": "", "core{i}/a.kt": ""}, lambda c: graph.longest_prefix(c.files, c.files.select(F.regexp_extract("path", "^(core[0-9]+)/", 1).alias("path")).filter("path <> ''").withColumn("name", F.col("path")), boundary=False), "path VARCHAR, module VARCHAR", [("core{i}-ui/b.kt", "core{i}"), ("core{i}/a.kt", "core{i}")])

# --- resources ---
LAYOUT, VALUES, BOARD = "x{i}/res/layout/main_{i}.xml", "x{i}/res/values/strings.xml", "x{i}/Main.storyboard"
PLATFORM = {
    LAYOUT: '<LinearLayout>\n <com.app.Card{i} android:id="@+id/card" android:text="@string/title_{i}"/>\n <fragment class="com.app.Map{i}" />\n <fragment android:name="com.app.Nav{i}" />\n</LinearLayout>\n',
    VALUES: '<resources>\n<string name="title_{i}">T</string>\n<color name="red_{i}">#f00</color>\n</resources>\n', "x{i}/res/drawable/ic_{i}.png": "",
    "x{i}/src/A.kt": "val a = R.string.title_{i}\nval b = R.color.none\n", BOARD: '<viewController id="v1" customClass="Home{i}"/>\n<tableViewCell customClass="Row{i}"/>\n<label customClass="Tag{i}"/>\n',
    "x{i}/Assets.xcassets/logo{i}.imageset/Contents.json": "{}", "x{i}/V.swift": 'let a = UIImage(named: "logo{i}")\nlet b = Image("none")\n',
}
add("xml_usages", PLATFORM, lambda c: resources.xml_usages(c.lines), "path VARCHAR, line INTEGER, class_name VARCHAR, usage_type VARCHAR, element_id VARCHAR", [(LAYOUT, 2, "com.app.Card{i}", "view_tag", "card"), (LAYOUT, 3, "com.app.Map{i}", "view_class_attr", None), (LAYOUT, 4, "com.app.Nav{i}", "fragment", None)])
_RES = "type VARCHAR, name VARCHAR, path VARCHAR, line INTEGER"
add("resource_definitions", PLATFORM, lambda c: resources.resource_definitions(c.files, c.lines), _RES, [("layout", "main_{i}", LAYOUT, None), ("drawable", "ic_{i}", "x{i}/res/drawable/ic_{i}.png", None), ("string", "title_{i}", VALUES, 2), ("color", "red_{i}", VALUES, 3)])


def _used_resources(c: Code) -> DataFrame:
    known = written(build.keyed(resources.resource_definitions(c.files, c.lines), "type", "name", "path", "line"), "resources")
    return resources.resource_usages(c.lines, known).join(shuffled(known.select(F.col("id").alias("resource_id"), "type", "name")), "resource_id").drop("resource_id")


add("resource_usages", PLATFORM, _used_resources, "usage_file VARCHAR, usage_line INTEGER, usage_type VARCHAR, type VARCHAR, name VARCHAR", [("x{i}/src/A.kt", 1, "code", "string", "title_{i}"), (LAYOUT, 2, "xml", "string", "title_{i}")])
add("storyboard_usages", PLATFORM, lambda c: resources.storyboard_usages(c.lines), "path VARCHAR, line INTEGER, class_name VARCHAR, usage_type VARCHAR, storyboard_id VARCHAR", [(BOARD, 1, "Home{i}", "viewController", "v1"), (BOARD, 2, "Row{i}", "cell", None), (BOARD, 3, "Tag{i}", "other", None)])
add("ios_assets", PLATFORM, lambda c: resources.ios_assets(c.files), "type VARCHAR, name VARCHAR, path VARCHAR", [("imageset", "logo{i}", "x{i}/Assets.xcassets/logo{i}.imageset")])


def _asset_uses(c: Code) -> DataFrame:
    assets = build.keyed(resources.ios_assets(c.files), "type", "name", "path")
    return resources.asset_usages(c.lines, assets).join(assets.select(F.col("id").alias("asset_id"), "name"), "asset_id").drop("asset_id")


add("ios_asset_usages", PLATFORM, _asset_uses, "name VARCHAR, usage_file VARCHAR, usage_line INTEGER, usage_type VARCHAR", [("logo{i}", "x{i}/V.swift", 1, "UIImage")])

# --- reports ---
_TYPES = {"m{i}/a.kt": "class A{i}ViewModel\ninterface B{i}Repository\nclass C{i}Entity\nfun loadWidget() {}\nobject D{i}Gateway\nimport dagger.hilt.X{i}\nimport kotlinx.coroutines.flow.Y{i}\nimport javax.inject.Z{i}\nimport com.squareup.moshi.M{i}\nimport io.mockk.K{i}\nimport com.example.rx.R{i}\nimport com.example.Plain{i}\n"}
add("naming_patterns", _TYPES, lambda c: insight.suffix_counts(parsers.parse(c.contents)), "", "SELECT s AS suffix, count(*) AS n FROM part CROSS JOIN (SELECT unnest(['ViewModel', 'Repository', 'Gateway']) AS s) GROUP BY s HAVING count(*) >= 3")


def _frameworks(c: Code) -> DataFrame:
    symbols = parsers.parse(c.contents).select("name", "kind")
    return insight.first_rule(insight.import_counts(extract.references(c.lines), symbols), insight.FRAMEWORKS)


add("frameworks", _TYPES, _frameworks, "", "SELECT c AS category, l AS label, count(*) AS n FROM part CROSS JOIN (VALUES ('DI', 'Dagger'), ('Async', 'Coroutines'), ('DI', 'javax.inject'), ('Serialization', 'Moshi'), ('Testing', 'MockK'), ('Async', 'Rx')) AS t(c, l) GROUP BY c, l")
add("architectures", {p: "" for p in ("m/Presentation/a{i}.kt", "m/domain/a{i}.kt", "n/data/a{i}.kt", "m/hooks/a{i}.ts", "m/view/a{i}.kt", "m/features/a{i}.kt", "m/feature/a{i}.kt")}, lambda c: insight.architecture(c.files, insight.ARCHITECTURES), "", "SELECT unnest(['Clean Architecture', 'Feature-sliced', 'Hooks pattern']) AS label")
