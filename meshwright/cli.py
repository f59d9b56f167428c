"""Command line: index, query, inspect, review, workspace, serve.

    python -m meshwright.cli index REPO [--incremental [--verify]] [--no-embed]
    python -m meshwright.cli query TEXT [--mode dsl|semantic|hybrid|nl|impact|path] [--to SYMBOL] [--json] [--context]
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .config import Workspace, load_config
from .deploy import ship
from .engine import QueryEngine, Result
from .index import Indexer, index_workspace
from .operators import find
from .operators.store import GraphStore

PAGE = 50


def session() -> SparkSession:
    spark = SparkSession.builder.appName("meshwright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="meshwright")
    sub = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--repo", default=".")
    common.add_argument("--db", dest="db_path")
    p = sub.add_parser("index", parents=[common])
    p.add_argument("path", nargs="?")
    p.add_argument("--incremental", action="store_true")
    p.add_argument("--verify", action="store_true", help="with --incremental: read all files, whatever their size and time")
    p.add_argument("--no-embed", action="store_true")
    p = sub.add_parser("query", parents=[common])
    p.add_argument("text", nargs="?", help="without it, questions are read line by line")
    p.add_argument("--mode", default="nl", choices=("dsl", "semantic", "hybrid", "nl", "impact", "path"))
    p.add_argument("--to", help="the other end, for path")
    p.add_argument("--depth", type=int, help="of impact (default 3) or path")
    p.add_argument("--top-k", type=int)
    p.add_argument("--json", action="store_true")
    p.add_argument("--context", action="store_true")
    p = sub.add_parser("inspect", parents=[common])
    p.add_argument("what", choices=("node", "path", "stats"))
    p.add_argument("names", nargs="*")
    p.add_argument("--depth", type=int, default=1, help="of a node's neighbourhood")
    p.add_argument("--max-depth", type=int, help="of a path")
    p = sub.add_parser("review", parents=[common])
    p.add_argument("--diff", default="-", help="a file, or - for standard input")
    p.add_argument("--budget", type=int, default=4000)
    p.add_argument("--model", default="claude")
    p.add_argument("--number", type=int)
    p.add_argument("--title", default="")
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("workspace")
    p.add_argument("action", choices=("init", "add", "remove", "list", "index", "query"))
    p.add_argument("names", nargs="*")
    p.add_argument("--workspace", default=".")
    p.add_argument("--id")
    p.add_argument("--mode", default="auto", choices=("auto", "dsl", "semantic", "hybrid", "nl"))
    p.add_argument("--context", action="store_true")
    p = sub.add_parser("serve", parents=[common])
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    return top


def ask(engine: QueryEngine, a: argparse.Namespace, text: str) -> Result:
    match a.mode:
        case "dsl":
            return engine.query_dsl(text)
        case "semantic":
            return engine.query_semantic(text, a.top_k)
        case "hybrid":
            return engine.query_hybrid(text, a.top_k)
        case "impact":
            return engine.query_impact(text, 3 if a.depth is None else a.depth)
        case "path":
            return engine.query_path(text, a.to or "", a.depth)
    return engine.query_nl(text)


def show(result: Result, as_json: bool = False, context: bool = False, page: int = PAGE) -> int:
    if as_json:
        print(json.dumps(result.as_dict() | ({"context": result.context} if context else {}), indent=2))
    elif result.error:
        print(f"error: {result.error}", file=sys.stderr)
    elif context:
        print(result.context)
    else:
        for r in result.rows[:page]:
            print(f"{r['score']:.4f}  {r['node_type']:<12} {r['fqn']}  {r['file_path'] or ''}:{r['start_line'] or ''}")
    return int(result.error is not None)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "workspace":
        return workspace(a, spark)
    spark = spark or session()
    root = Path(getattr(a, "path", None) or a.repo)
    config = load_config(root, repo_path=str(root), db_path=a.db_path or str(root / ".meshwright/graph"))
    if a.command == "index":
        indexer = Indexer(spark, config)
        report = indexer.update(not a.no_embed, a.verify) if a.incremental else indexer.run(not a.no_embed)
        print(f"files {report.files}, nodes {report.nodes}, edges {report.edges}, embedded {report.embedded}, {report.seconds:.1f} s")
        if report.failed:
            print(f"{report.failed} files could not be parsed whole", file=sys.stderr)
        for e in report.errors[:10]:
            print(f"  {e}", file=sys.stderr)
        return 0
    with QueryEngine(spark, config) as engine:
        if a.command == "query":
            if a.text is not None:
                return show(ask(engine, a, a.text), a.json, a.context)
            for line in filter(None, map(str.strip, sys.stdin)):
                show(ask(engine, a, line), a.json, a.context)
            return 0
        if a.command == "inspect":
            if a.what == "stats":
                for table, by in ((engine.store.nodes, "node_type"), (engine.store.edges, "edge_type")):
                    for r in find.counts(table, by).orderBy(by).collect():
                        print(f"{r[0]:<18} {r.n}")
                return 0
            return show(engine.neighbourhood(a.names[0], a.depth) if a.what == "node" else engine.query_path(*a.names[:2], a.max_depth))
        if a.command == "review":
            text = sys.stdin.read() if a.diff == "-" else Path(a.diff).read_text()
            bundle = engine.review(text, a.budget, a.model, a.number, a.title)
            print(json.dumps(bundle.to_dict(), indent=2) if a.json else bundle.context_text)
            print(f"# tokens={bundle.estimated_tokens}/{bundle.budget_tokens} nodes={len(bundle.nodes)} dropped={bundle.dropped_count}", file=sys.stderr)
            return 0
        from .serve import serve

        serve(engine, a.host, a.port)
    return 0


def workspace(a: argparse.Namespace, spark: SparkSession | None) -> int:
    if a.action == "init":
        Workspace.init(a.workspace)
        return 0
    ws = Workspace.load(a.workspace)
    if a.action == "list":
        for r in ws.repos:
            print(f"{r.id}\t{r.path}")
    elif a.action in ("add", "remove"):
        ws.add(a.names[0], a.id) if a.action == "add" else ws.remove(a.names[0])
        ws.save()
    elif a.action == "index":
        for repo, report in index_workspace(spark or session(), ws, a.id).items():
            print(f"{repo}: nodes {report.nodes}, edges {report.edges}, {report.seconds:.1f} s")
    else:
        spark = spark or session()
        config = load_config(a.workspace, db_path=str(ws.db_path), repo_id=a.id or "")
        engine, text = QueryEngine(spark, config, GraphStore(spark, str(ws.db_path))), " ".join(a.names)
        statement = text.split()[:1] and text.split()[0].upper() in ("FIND", "DEPENDENTS", "IMPACT", "PATH")
        mode = a.mode if a.mode != "auto" else "dsl" if statement else "semantic"
        return show(getattr(engine, f"query_{mode}")(text), context=a.context, page=20)
    return 0


if __name__ == "__main__":
    sys.exit(main())
