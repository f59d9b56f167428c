"""Python source to nodes and edges, by the standard library's syntax tree."""

from __future__ import annotations

import ast
import inspect
import re

from .builder import Builder

# Base classes that mark a table model, with either text in the class body; endpoint decorators.
ORM_BASES = frozenset(("Base", "DeclarativeBase", "DeclarativeBaseNoMeta", "Model"))
ORM_MARKS = ("__tablename__", "Column(")
ENDPOINT = re.compile(r"^(?:app|router|blueprint|api)\.(get|post|put|patch|delete|head|options|route)\b", re.I)
_DEFINITION = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)")
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
ABSTRACT = ("ABC", "abc.ABC", "Protocol")


def module_name(rel_path: str) -> str:
    return rel_path.removesuffix(".py").replace("/", ".")


class Visitor:
    def __init__(self, build: Builder, source: str):
        self.build, self.source = build, source
        self.stack = [module_name(build.rel_path)]

    def fqn(self, name: str) -> str:
        return ".".join([*self.stack, name])

    def text(self, node: ast.AST | None) -> str:
        return ast.get_source_segment(self.source, node) or ast.unparse(node) if node is not None else ""

    def block(self, body: list[ast.stmt]) -> None:
        """Definitions and imports of a block, those inside if, try, with and loops included."""
        for node in body:
            if isinstance(node, ast.ClassDef):
                self.class_(node)
            elif isinstance(node, _FUNCTION):
                self.function(node, None)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    self.build.imports(a.name, [])
            elif isinstance(node, ast.ImportFrom):
                self.build.imports("." * node.level + (node.module or ""), [a.name for a in node.names])
            else:
                for part in ("body", "orelse", "finalbody"):
                    self.block([s for s in getattr(node, part, []) or [] if isinstance(s, ast.stmt)])
                for h in getattr(node, "handlers", []) + getattr(node, "cases", []):
                    self.block(h.body)

    def class_(self, node: ast.ClassDef) -> None:
        fqn, bases = self.fqn(node.name), [self.text(b) for b in [*node.bases, *(k.value for k in node.keywords)]]
        decorators = [self.text(d) for d in node.decorator_list]
        plain = [self.text(b) for b in node.bases]
        body_text = "\n".join(self.text(s) for s in node.body)
        common = dict(name=node.name, fqn=fqn, docstring=docstring(node), lines=(node.lineno, node.end_lineno))
        if any(b in ORM_BASES or b.endswith(".Model") for b in plain) and any(m in body_text for m in ORM_MARKS):
            targets = [(s.targets[0] if isinstance(s, ast.Assign) else s.target, s) for s in node.body if isinstance(s, (ast.Assign, ast.AnnAssign))]
            names = {t.id: s.value for t, s in targets if isinstance(t, ast.Name)}
            table = names.get("__tablename__")
            node_id = self.build.node("DbModel", orm_framework="sqlalchemy", fields=list(names), table_name=table.value if isinstance(table, ast.Constant) else "", **common)
        else:
            abstract = any(b in ABSTRACT for b in plain) or "abstractmethod" in body_text
            node_id = self.build.node("Class", bases=bases, decorator_names=decorators, is_abstract=abstract, **common)
        self.build.contains(self.build.file_id, node_id)
        for base in plain:
            self.build.edge("INHERITS", node_id, base, is_mixin=base.endswith("Mixin"))
        self.stack.append(node.name)
        for child in node.body:
            if isinstance(child, _FUNCTION):
                self.function(child, node_id)
        self.stack.pop()

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, class_id: str | None) -> None:
        fqn, is_async = self.fqn(node.name), isinstance(node, ast.AsyncFunctionDef)
        decorators = [self.text(d) for d in node.decorator_list]
        a = node.args
        params = [p.arg for p in [*a.posonlyargs, *a.args, *a.kwonlyargs]]
        returns = self.text(node.returns) or None
        signature = f"{'async ' if is_async else ''}def {node.name}({', '.join(params)}){f' -> {returns}' if returns else ''}"
        common = dict(name=node.name, fqn=fqn, docstring=docstring(node), lines=(node.lineno, node.end_lineno))
        detail = dict(signature=signature, is_async=is_async, is_generator=yields(node), decorator_names=decorators, parameter_names=params, return_type=returns)
        if class_id is not None:
            marks = {f"is_{k}": k2 in decorators for k, k2 in (("static", "staticmethod"), ("classmethod", "classmethod"), ("property", "property"))}
            node_id = self.build.node("Method", class_fqn=".".join(self.stack), **marks, **detail, **common)
        elif node.name.startswith("test_") or "test" in (d.lower() for d in decorators):
            calls = list(dict.fromkeys(c for c, _ in self.calls(node)))
            node_id = self.build.node("Test", test_framework="pytest", is_parametrized=any("pytest.mark.parametrize" in d for d in decorators), targets=calls, **common)
        else:
            node_id = self.build.node("Function", **detail, **common)
        self.build.contains(class_id or self.build.file_id, node_id)
        for decorator, tree in zip(decorators, node.decorator_list):
            if m := ENDPOINT.match(decorator):
                args = tree.args if isinstance(tree, ast.Call) else []
                path = args[0].value if args and isinstance(args[0], ast.Constant) and isinstance(args[0].value, str) else "/unknown"
                method = m[1].upper()
                endpoint = self.build.node("ApiEndpoint", **{**common, "name": f"{method} {path}", "fqn": f"{fqn}:endpoint"}, http_method=method, path_pattern=path, framework="fastapi")
                self.build.edge("EXPOSES_ENDPOINT", node_id, endpoint)
                break
        for callee, conditional in dict(self.calls(node)).items():
            self.build.edge("CALLS", node_id, callee, key=callee + node_id, confidence=0.7, is_conditional=conditional, is_dynamic=False)

    def calls(self, node: ast.AST, conditional: bool = False):
        """(callee text up to a parenthesis, whether it stands under a condition) of each call in a body."""
        for child in ast.iter_child_nodes(node) if not isinstance(node, _FUNCTION) else node.body:
            inside = conditional or isinstance(child, (ast.If, ast.IfExp, ast.While, ast.Try))
            if isinstance(child, ast.Call):
                yield self.text(child.func).split("(")[0], conditional
            yield from self.calls(child, inside)


def docstring(node) -> str | None:
    return ast.get_docstring(node, clean=False)


def yields(node) -> bool:
    todo = list(node.body)
    while todo:
        at = todo.pop()
        if isinstance(at, (ast.Yield, ast.YieldFrom)):
            return True
        if not isinstance(at, (*_FUNCTION, ast.Lambda, ast.ClassDef)):
            todo += ast.iter_child_nodes(at)
    return False


def outline(build: Builder, source: str) -> None:
    """What a file with syntax errors still shows: its classes and functions by indentation."""
    stack: list[tuple[int, str, str, str]] = []  # indent, kind, name, id
    for number, line in enumerate(source.splitlines(), 1):
        if m := _DEFINITION.match(line):
            indent = len(m[1].expandtabs())
            while stack and stack[-1][0] >= indent:
                stack.pop()
            if stack and stack[-1][1] == "def":
                continue  # functions within functions aren't nodes
            owner = stack[-1] if stack else None
            fqn = ".".join([module_name(build.rel_path), *(s[2] for s in stack), m[3]])
            kind = "Class" if m[2] == "class" else "Method" if owner else "Test" if m[3].startswith("test_") else "Function"
            node_id = build.node(kind, name=m[3], fqn=fqn, docstring=None, lines=(number, number))
            build.contains(owner[3] if owner and kind == "Method" else build.file_id, node_id)
            stack.append((indent, m[2], m[3], node_id))


def parse(build: Builder, source: str) -> None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        build.errors.append(f"Parse error: {e}")
        outline(build, source)
        return
    Visitor(build, source).block(tree.body)


def clean(text: str | None) -> str | None:
    """Docstring without its indentation and outer blanks, at most one blank line in a row, 512 characters."""
    if not text or not (flat := inspect.cleandoc(text).strip()):
        return None
    flat = re.sub(r"\n{3,}", "\n\n", flat)
    return flat if len(flat) <= 512 else flat[:511] + "…"
