"""Parsers against hand-derived nodes and edges."""

from collections import Counter

import pytest
from meshwright.parsing import parse, python_code
from meshwright.parsing.builder import Builder, short_hash

from .samples import CONFIG, PYTHON, TYPESCRIPT

LANGUAGES = {"py": "python", "ts": "typescript", "toml": "toml", "json": "json", "js": "javascript"}


def parsed(name, text):
    ext = name.rsplit(".", 1)[-1]
    return parse.parse_one(parse.PARSERS, "", name, LANGUAGES[ext], f".{ext}", len(text), text.lstrip("\n").encode(), "h")


def kinds(build):
    return Counter(n["node_type"] for n in build.nodes)


def named(build, fqn):
    return next(n for n in build.nodes if n["fqn"] == fqn)


def test_python_sample_counts():
    total = sum((kinds(parsed(n, t)) for n, t in PYTHON.items()), Counter())
    assert total == {"File": 4, "Class": 4, "Function": 7, "Method": 4, "Test": 3, "ApiEndpoint": 3}
    assert all(not parsed(n, t).errors for n, t in PYTHON.items())


def test_python_details():
    build = parsed("models.py", PYTHON["models.py"])
    method = named(build, "models.Account.accepts_amount")
    assert method["class_fqn"] == "models.Account" and method["signature"] == "def accepts_amount(self, plain) -> bool"
    assert method["node_id"] == short_hash("models.py", "models.Account.accepts_amount")
    assert named(build, "models.Account")["docstring"] == "A account account."
    assert "Charge" in named(parsed("billing.py", PYTHON["billing.py"]), "billing.charge")["docstring"]
    routes = parsed("routes.py", PYTHON["routes.py"])
    assert sorted(n["name"] for n in routes.nodes if n["node_type"] == "ApiEndpoint") == ["GET /ping", "POST /cart/buy", "POST /cart/undo"]
    assert named(routes, "routes.app.get")["is_static"] and not any("decorator" in n["fqn"] for n in routes.nodes)
    tests = parsed("test_billing.py", PYTHON["test_billing.py"])
    assert [n["is_parametrized"] for n in tests.nodes if n["node_type"] == "Test"] == [False, False, True]


def test_python_edges():
    build = parsed("billing.py", PYTHON["billing.py"])
    calls = {(e["src_id"], e["dst_ref"]): e for e in build.edges if e["edge_type"] == "CALLS"}
    source = named(build, "billing.charge")["node_id"]
    assert {d for s, d in calls if s == source} == {"_open_account", "account.accepts_amount", "ValueError", "_issue_receipt"}
    assert calls[source, "ValueError"]["is_conditional"] and not calls[source, "_open_account"]["is_conditional"]
    imports = [e for e in build.edges if e["edge_type"] == "IMPORTS"]
    assert [(e["dst_ref"], e["imported_names"]) for e in imports] == [("models", ["Receipt", "Account"])]


def test_orm_generators_relative_imports_and_async():
    build = parsed("p/m.py", "from . import a\nfrom ..b import c\nclass T(db.Model):\n    __tablename__ = 'tt'\n    x = Column(1)\nasync def g():\n    yield 1\nclass M(Base): pass\n")
    table = named(build, "p.m.T")
    assert (table["node_type"], table["fields"], table["table_name"]) == ("DbModel", ["__tablename__", "x"], "tt")
    assert named(build, "p.m.M")["node_type"] == "Class"
    assert named(build, "p.m.g")["is_async"] and named(build, "p.m.g")["is_generator"]
    assert [e["dst_ref"] for e in build.edges if e["edge_type"] == "IMPORTS"] == [".", "..b"]


@pytest.mark.parametrize("text", ["", "def f(:\n  pass\nclass A:\n  def m(self):\n    def inner(): pass\n", "\x00", "é = 1", "x = (" * 300])
def test_broken_python_still_gives_an_outline(text):
    build = parsed("b.py", text)
    assert build.nodes[0]["node_type"] == "File"
    if "class A" in text:
        assert kinds(build) == {"File": 1, "Function": 1, "Class": 1, "Method": 1} and build.errors


def test_typescript_sample():
    billing, types = parsed("billing.ts", TYPESCRIPT["billing.ts"]), parsed("types.ts", TYPESCRIPT["types.ts"])
    assert kinds(billing) == {"File": 1, "Class": 1, "Method": 5} and kinds(types) == {"File": 1, "Interface": 2, "TypeAlias": 1}
    buy = named(billing, "billing.Ledger.charge")
    assert buy["is_async"] and buy["parameter_names"] == ["owner", "amount"] and (buy["start_line"], buy["end_line"]) == (4, 9)
    assert not named(billing, "billing.Ledger.verify")["is_async"]
    owner = named(billing, "billing.Ledger")["node_id"]
    assert sum(e["edge_type"] == "CONTAINS" and e["src_id"] == owner for e in billing.edges) == 5
    assert [(e["dst_ref"], e["imported_names"]) for e in billing.edges if e["edge_type"] == "IMPORTS"] == [("./types", ["Account", "Receipt", "Outcome"])]


def test_typescript_forms():
    text = """import x, { a as b } from "m"
import * as n from 'k'
export { q } from './r';
export default abstract class A<T extends B> extends n.C<T> implements I, J<string> {
  static count = 0;
  private handler = (e: Event): void => { this.go() };
  constructor(private readonly s: S, { d }: D, ...rest: any[]) { super(); }
  get value(): { a: number } { return { a: 1 } }
  *gen() { if (1) { } }
  abstract later(x: number): void;
}
export async function go<T>(a: Map<string, number>, b = 1): Promise<void> { function inner() {} }
function testThing() {}
interface K extends I, L<M> { f(): void }
type U<T> = T | null;
const re = a / b / c;
"""
    build = parsed("d/x.ts", text)
    assert {n["fqn"]: n["node_type"] for n in build.nodes[1:]} == {
        "d.x.A": "Class", "d.x.A.constructor": "Method", "d.x.A.value": "Method", "d.x.A.gen": "Method", "d.x.go": "Function", "d.x.inner": "Function",
        "d.x.testThing": "Test", "d.x.K": "Interface", "d.x.U": "TypeAlias",
    }
    assert {(e["edge_type"], e["dst_ref"]) for e in build.edges if e["edge_type"] in ("IMPORTS", "IMPLEMENTS", "INHERITS")} == {
        ("IMPORTS", "m"), ("IMPORTS", "k"), ("IMPORTS", "./r"), ("IMPLEMENTS", "I"), ("IMPLEMENTS", "J"), ("INHERITS", "n.C"),
    }
    assert named(build, "d.x.A")["is_abstract"] and named(build, "d.x.go")["is_async"] and named(build, "d.x.K")["extends"] == ["I", "L"]
    assert named(build, "d.x.A.constructor")["parameter_names"] == ["s"]


@pytest.mark.parametrize("text", ["", "class", "class A {", "`${", "function f(", "import", "interface X", "a = /[/", "type T =", "@"])
def test_cut_off_typescript_does_not_fail(text):
    assert parsed("a.ts", text).errors == []


def test_config():
    for name, text in CONFIG.items():
        build = parsed(name, text)
        assert kinds(build) == {"File": 1, "ConfigFile": 1} and [e["edge_type"] for e in build.edges] == ["CONTAINS"]
        assert build.nodes[1]["end_line"] == text.count("\n") + 1


def test_docstring_cleaning():
    assert python_code.clean("  a\n\n\n\n  b  ") == "a\n\nb" and python_code.clean(" \n ") is None
    assert len(python_code.clean("x" * 600)) == 512


def test_a_failing_parser_is_an_error_of_its_file():
    def fails(build: Builder, source: str) -> None:
        raise RuntimeError("boom")

    build = parse.parse_one({"python": fails}, "", "a.py", "python", ".py", 1, b"x", "h")
    assert build.errors == ["RuntimeError: boom"] and len(build.nodes) == 1
