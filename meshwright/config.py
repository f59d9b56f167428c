"""Settings, from a TOML file found in the folder or its parents, with overrides on top; and multi-repository workspaces."""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from .sources.repository import DEFAULT_EXCLUDES, MAX_FILE_BYTES

FILE_NAMES = ("meshwright.toml", ".meshwright.toml")
WORKSPACE_FILE = "workspace.toml"
PARENTS = 10


@dataclass(frozen=True)
class Config:
    repo_path: str = "."
    db_path: str = ".meshwright/graph"
    repo_id: str = ""
    max_file_size_bytes: int = MAX_FILE_BYTES
    exclude_patterns: tuple[str, ...] = DEFAULT_EXCLUDES
    #: Extensions and languages to index; empty for all that are known.
    include_extensions: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    git_history_limit: int = 500
    enable_git_enrichment: bool = True
    embedding_batch_size: int = 64
    embed_limit: int = 0
    context_max_tokens: int = 6000
    default_top_k: int = 20
    #: Most hops of a PATH query that names no depth.
    max_call_depth: int = 10


def find_config(start: str | Path) -> Path | None:
    """The nearest settings file in start or up to ten of its parents."""
    folder = Path(start).resolve()
    for at in [folder, *folder.parents][: PARENTS + 1]:
        for name in FILE_NAMES:
            if (at / name).is_file():
                return at / name
    return None


def load_config(start: str | Path = ".", **overrides) -> Config:
    """Overrides before the file before defaults. Settings may stand in a [meshwright] table or at the top."""
    path = find_config(start)
    data = tomllib.loads(path.read_text()) if path else {}
    data = data.get("meshwright", data)
    known = {f.name for f in fields(Config)}
    if unknown := sorted(set(data) - known):
        warnings.warn(f"settings that aren't known, in {path}: {', '.join(unknown)}", stacklevel=2)
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known}
    return replace(Config(**given), **{k: v for k, v in overrides.items() if v is not None})


@dataclass
class Repo:
    path: Path
    id: str


@dataclass
class Workspace:
    path: Path
    db_path: Path
    repos: list[Repo] = field(default_factory=list)

    @classmethod
    def init(cls, path: str | Path) -> Workspace:
        root = Path(path).resolve()
        made = cls(root, root / ".meshwright/workspace")
        made.save()
        return made

    @classmethod
    def load(cls, path: str | Path) -> Workspace:
        root = Path(path).resolve()
        file = root / WORKSPACE_FILE
        if not file.exists():
            raise FileNotFoundError(f"no {WORKSPACE_FILE} in {root}")
        data = tomllib.loads(file.read_text()).get("workspace", {})
        repos = [Repo((root / r["path"]).resolve(), r.get("id") or Path(r["path"]).name) for r in data.get("repos", [])]
        return cls(root, (root / data.get("db_path", ".meshwright/workspace")).resolve(), repos)

    def save(self) -> None:
        def shown(p: Path) -> str:
            return str(p.relative_to(self.path)) if p.is_relative_to(self.path) else str(p)

        lines = ["[workspace]", f'db_path = "{shown(self.db_path)}"']
        for r in self.repos:
            lines += ["", "[[workspace.repos]]", f'path = "{shown(r.path)}"', f'id = "{r.id}"']
        (self.path / WORKSPACE_FILE).write_text("\n".join(lines) + "\n")

    def add(self, path: str | Path, repo_id: str | None = None) -> Repo:
        repo = Repo(Path(path).resolve(), repo_id or Path(path).resolve().name)
        if any(r.id == repo.id for r in self.repos):
            raise ValueError(f"repository id {repo.id!r} is taken")
        self.repos.append(repo)
        return repo

    def get(self, repo_id: str) -> Repo:
        for r in self.repos:
            if r.id == repo_id:
                return r
        raise KeyError(repo_id)

    def remove(self, repo_id: str) -> None:
        self.repos.remove(self.get(repo_id))
