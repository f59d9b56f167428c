"""Collects one file's nodes and unresolved edges as rows of the schema."""

from __future__ import annotations

import hashlib

from ..schema import NODES, RAW_EDGES


def short_hash(*parts: str) -> str:
    return hashlib.sha256(":".join(parts).encode()).hexdigest()[:16]


class Builder:
    def __init__(self, repo_id: str, rel_path: str, language: str, extension: str, size_bytes: int, content_hash: str):
        self.repo_id, self.rel_path, self.language = repo_id, rel_path, language
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.errors: list[str] = []
        self.file_id = self.node("File", name=rel_path.rsplit("/", 1)[-1], fqn=rel_path, extension=extension, size_bytes=size_bytes, content_hash=content_hash)

    def node(self, node_type: str, name: str, fqn: str, docstring: str | None = None, lines: tuple[int, int] | None = None, **more) -> str:
        from .python_code import clean

        node_id = short_hash(self.rel_path, fqn)
        row = dict.fromkeys(NODES.names) | {
            "repo_id": self.repo_id, "node_id": node_id, "node_type": node_type, "name": name, "fqn": fqn, "language": self.language, "docstring": clean(docstring),
            "tags": [], "change_frequency": 0.0, "centrality_score": 0.0, "importance_score": 0.0, "file_path": self.rel_path,
            "start_line": lines[0] if lines else None, "end_line": lines[1] if lines else None, "file_ord": self.rel_path, "node_ord": len(self.nodes),
        }
        self.nodes.append(row | more)
        return node_id

    def edge(self, edge_type: str, src: str, dst: str, key: str | None = None, confidence: float = 1.0, **more) -> None:
        row = dict.fromkeys(RAW_EDGES.names) | {
            "repo_id": self.repo_id, "edge_id": short_hash(src, edge_type, dst if key is None else key), "edge_type": edge_type, "src_id": src, "dst_ref": dst,
            "confidence": confidence, "file_path": self.rel_path, "edge_ord": len(self.edges),
        }
        self.edges.append(row | more)

    def contains(self, parent: str, child: str) -> None:
        self.edge("CONTAINS", parent, child)

    def imports(self, module: str, names: list[str]) -> None:
        if module:
            self.edge("IMPORTS", self.file_id, module, imported_names=names, is_dynamic=False)
