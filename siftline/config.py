"""One immutable configuration; environment variables with the prefix SIFTLINE_ override it."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass

# File extensions that are indexed, folders and files that are not.
EXTENSIONS = (
    ".rs", ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".cs", ".php", ".rb", ".swift", ".kt",
    ".kts", ".scala", ".sc", ".m", ".mm", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".sql", ".pl", ".pm", ".lua", ".r", ".R", ".jl", ".dart", ".nim",
    ".cr", ".elm", ".erl", ".hrl", ".ex", ".exs", ".clj", ".cljs", ".cljc", ".hs", ".lhs", ".fs", ".fsi", ".fsx", ".ml", ".mli", ".v", ".vh", ".vhd",
    ".sv", ".svh", ".cob", ".cbl", ".cpy", ".f", ".f90", ".f95", ".f03", ".f08", ".adb", ".ads", ".pas", ".pp", ".inc", ".asm", ".s", ".S", ".nasm",
    ".cmake", ".xml", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".md",
    ".markdown", ".rst", ".tex", ".bib", ".proto", ".graphql", ".gql", ".prisma", ".vue", ".svelte", ".sol", ".vy", ".zig", ".odin", ".d", ".di",
    ".nims", ".ecr", ".wat", ".wast", ".wit", ".glsl", ".vert", ".frag", ".hlsl", ".wgsl", ".metal",
)
SKIP_DIRS = (
    ".git", ".svn", ".hg", "node_modules", "target", "build", "dist", "__pycache__", ".pytest_cache", ".mypy_cache", "venv", ".venv", "env", ".env",
    "vendor", "bower_components", ".idea", ".vscode", ".vs", "bin", "obj", "pkg", ".gradle", ".mvn", "Pods", ".cache",
)
SKIP_FILES = (
    ".DS_Store", "Thumbs.db", "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dylib", "*.dll", "*.exe", "*.out", "*.app", "*.lock", "*.log", "*.tmp", "*.temp",
    "*.bak", "*.swp", "*.swo", "*~", ".env", ".env.local", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "composer.lock",
    "Gemfile.lock", "Podfile.lock", "poetry.lock", "go.sum",
)


@dataclass(frozen=True)
class EngineConfig:
    model: str = "minilm"
    chunk_size: int = 50
    chunk_overlap: int = 10
    limit: int = 10
    fts_weight: float = 0.6
    vector_weight: float = 0.4
    fuzzy: bool = True
    fuzzy_max_distance: int = 2
    learn_from_clicks: bool = True
    k1: float = 1.2
    b: float = 0.75
    content_weight: float = 1.5
    path_weight: float = 0.75
    rrf_k: int = 60
    batch_size: int = 32
    token_budget: str = "medium"
    extensions: tuple[str, ...] = EXTENSIONS
    skip_dirs: tuple[str, ...] = SKIP_DIRS
    skip_files: tuple[str, ...] = SKIP_FILES

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be at least 0 and less than chunk_size")
        if self.limit < 1 or self.fts_weight < 0 or self.vector_weight < 0:
            raise ValueError("limit must be positive, weights must not be negative")


def load(path: str | None = None, env: dict[str, str] | None = None) -> EngineConfig:
    """Defaults, then a TOML file, then the environment."""
    values: dict = {}
    if path:
        with open(path, "rb") as f:
            for k, v in tomllib.load(f).items():
                values |= v if isinstance(v, dict) else {k: v}
    fields = {f.name: f.type for f in dataclasses.fields(EngineConfig)}
    for name, kind in fields.items():
        raw = (env if env is not None else os.environ).get(f"SIFTLINE_{name.upper()}")
        if raw is not None:
            values[name] = raw.lower() in ("1", "true", "yes", "on") if kind == "bool" else int(raw) if kind == "int" else float(raw) if kind == "float" else tuple(raw.split(",")) if kind.startswith("tuple") else raw
    unknown = set(values) - set(fields)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return EngineConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
