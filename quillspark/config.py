"""Settings of jobs: environment first, then a file, then defaults."""
import json
import os
from dataclasses import dataclass, field, fields, replace

#: Prefix of environment variables.
PREFIX = "QUILLSPARK_"


@dataclass(frozen=True)
class Source:
    """A product's files: a root, globs that include and exclude, and what its documents are filed under."""

    product: str
    root: str
    version: str = "default"
    lang: str = "en"
    include: tuple[str, ...] = ("*.md", "*.mdx")
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    """Limits that jobs share. An empty value is filled by the next of environment, file and default."""

    target: str = ""
    near_threshold: float = 97.0
    near_min_chars: int = 1200
    max_tokens: int = 420
    max_sentences: int = 8
    min_chars: int = 180
    max_chunks: int = 60
    dim: int = 64
    provider: str = "hashing"
    sources: tuple[Source, ...] = field(default=())


def _read(path: str) -> dict:
    """A settings file: JSON, or YAML where its library is there."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    if path.endswith(".json"):
        return json.loads(raw) or {}
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{path}: only JSON can be read here") from e
    return yaml.safe_load(raw) or {}


def _source(raw: dict) -> Source:
    known = {f.name for f in fields(Source)}
    unknown = set(raw) - known
    if unknown or "product" not in raw or "root" not in raw:
        raise ValueError(f"bad source: {raw}")
    return Source(**{k: tuple(v) if k in ("include", "exclude") else v for k, v in raw.items()})


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Settings by precedence. Unknown names in a file raise; each value has its default's type."""
    given = _read(path) if path else {}
    plain = {f.name: f.default for f in fields(Settings) if f.name != "sources"}
    unknown = set(given) - set(plain) - {"sources"}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    env = os.environ if env is None else env
    out = Settings(sources=tuple(map(_source, given.get("sources", []))))
    for name, default in plain.items():
        for value in (env.get(PREFIX + name.upper()), given.get(name)):
            if value not in (None, ""):
                out = replace(out, **{name: type(default)(value)})
                break
    return out
