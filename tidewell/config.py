"""Settings from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from tidewell.functions.embedding import PROVIDERS


class ConfigError(ValueError):
    """A setting that can't be used."""


@dataclass(frozen=True)
class Settings:
    """Each is read from TIDEWELL_ and its name in capitals; keys of hosted services may be absent, as none is called."""

    master: str = "local[*]"
    data_dir: str = "data"
    warehouse_dir: str = "warehouse"
    index_dir: str = "index"
    collection: str = "semantic_catalog"
    embedding_provider: str = "hash"
    embedding_dimensions: int = 128
    embedding_api_key: str | None = None
    planner: str = "template"
    planner_api_key: str | None = None

    @classmethod
    def from_environment(cls, environ: dict[str, str] | None = None) -> Settings:
        environ = os.environ if environ is None else environ
        given = {f.name: environ[k] for f in fields(cls) if (k := f"TIDEWELL_{f.name.upper()}") in environ}
        if "embedding_dimensions" in given:
            if not given["embedding_dimensions"].isdigit():
                raise ConfigError("TIDEWELL_EMBEDDING_DIMENSIONS must be a whole number")
            given["embedding_dimensions"] = int(given["embedding_dimensions"])
        given.setdefault("planner_api_key", given.get("embedding_api_key"))
        out = cls(**given)
        out.check()
        return out

    def check(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, str) and not value.strip():
                raise ConfigError(f"TIDEWELL_{f.name.upper()} must not be empty")
        if not self.master.startswith(("local", "spark://", "yarn", "k8s://")):
            raise ConfigError("TIDEWELL_MASTER must be local, yarn, or a spark:// or k8s:// address")
        if self.embedding_dimensions < 2:
            raise ConfigError("TIDEWELL_EMBEDDING_DIMENSIONS must be 2 at least")
        if self.embedding_provider not in PROVIDERS:
            raise ConfigError(f"TIDEWELL_EMBEDDING_PROVIDER must be one of {sorted(PROVIDERS)}")
        if self.planner != "template":
            raise ConfigError("TIDEWELL_PLANNER must be template")
