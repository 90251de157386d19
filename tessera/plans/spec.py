"""Declarative inputs: configuration, the specification of a whole database, its fingerprint, and the guardrail of destinations."""

from __future__ import annotations

import hashlib
import json
from fnmatch import fnmatch
from importlib import metadata
from pathlib import Path
from typing import Any

import yaml
from pydantic import BaseModel, ConfigDict, Field, ValidationError

from .model import ConfigError, GuardrailError, Profile, Table, VersionError

NONPROD = "nonprod"
# fixed values: names that are never written to
DENIED = ("*prod*", "*production*")


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class ConnectionConfig(Strict):
    host: str
    port: int | None = Field(default=None, gt=0, le=65535)
    database: str | None = None
    driver: str | None = None
    encrypt: bool = True
    trust_server_certificate: bool = True
    user_env: str = "DB_USER"
    password_env: str = "DB_PASSWORD"


class SourceConfig(Strict):
    engine: str | None = None
    table: str | None = None
    connection: ConnectionConfig | None = None
    sensitive_columns: list[str] = Field(default_factory=list)
    not_sensitive_columns: list[str] = Field(default_factory=list)


class GenerationConfig(Strict):
    rows: int | None = Field(default=None, gt=0)
    tolerance: float = Field(default=0.9, ge=0, le=1)
    conditions: list[str] = Field(default_factory=list)


class MutatorConfig(Strict):
    name: str
    params: dict[str, Any] = Field(default_factory=dict)


class ChaosConfig(Strict):
    mode: str = Field(default="mixed", pattern="^(mixed|fully_chaotic)$")
    rate: float = Field(default=0.1, ge=0, le=1)
    mutators: list[MutatorConfig] = Field(default_factory=list)


class PrivacyConfig(Strict):
    similarity_enabled: bool = False
    similarity_threshold: float = Field(default=0.1, gt=0)
    outlier_enabled: bool = False
    outlier_threshold: float = Field(default=4.0, gt=0)


class Config(Strict):
    schema_version: str = "1.0.0"
    seed: int | None = None
    source: SourceConfig = Field(default_factory=SourceConfig)
    generation: GenerationConfig = Field(default_factory=GenerationConfig)
    chaos: ChaosConfig = Field(default_factory=ChaosConfig)
    privacy: PrivacyConfig = Field(default_factory=PrivacyConfig)


class CrossCorrelation(Strict):
    column: str
    parent_table: str
    parent_column: str
    rho: float = Field(ge=-1, le=1)


class TableSpec(Strict):
    profile: dict[str, Any]
    rows: int = Field(ge=0)
    sensitive_columns: list[str] = Field(default_factory=list)
    shared_keys: list[str] = Field(default_factory=list)
    reserved_key_block: int = Field(default=0, ge=0)
    fixtures: list[dict[str, Any]] = Field(default_factory=list)
    cross_correlations: list[CrossCorrelation] = Field(default_factory=list)


class DestinationSpec(Strict):
    environment: str
    host: str | None = None
    database: str | None = None


class Spec(Strict):
    schema_version: str = "1.0.0"
    seed: int = 0
    tolerance: float = Field(default=0.9, ge=0, le=1)
    chunk_rows: int = Field(default=50_000, gt=0)
    tables: dict[str, TableSpec] = Field(default_factory=dict)
    destination: DestinationSpec | None = None


def _load(kind: type[Strict], path: str | Path):
    try:
        data = yaml.safe_load(Path(path).read_text()) or {}
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{path} holds no mapping")
    if str(data.get("schema_version", "1")).split(".")[0] != "1":
        raise VersionError(f"{path} has version {data['schema_version']}")
    try:
        return kind(**data)
    except ValidationError as e:
        raise ConfigError(str(e)) from e


def load_config(path: str | Path) -> Config:
    return _load(Config, path)


def load_spec(path: str | Path) -> Spec:
    return _load(Spec, path)


def save_spec(spec: Spec, path: str | Path) -> None:
    Path(path).write_text(yaml.safe_dump(spec.model_dump(), sort_keys=True))


def save_profile(profile: Profile, path: str | Path) -> None:
    """As YAML; the digests of the guard as Parquet beside it."""
    if profile.guard is not None:
        save_guard(profile, f"{path}.guard")
    Path(path).write_text(yaml.safe_dump(profile.to_dict(), sort_keys=True))


def save_guard(profile: Profile, path: str) -> None:
    profile.guard_path = path if "://" in path else str(Path(path).absolute())
    profile.guard.write.mode("overwrite").parquet(profile.guard_path)


def load_profile(path: str | Path) -> Profile:
    profile = Profile.from_dict(yaml.safe_load(Path(path).read_text()) or {})
    beside = Path(f"{path}.guard")  # the two may have been moved together
    if profile.guard_path and Path(profile.guard_path).name == beside.name and beside.exists():
        profile.guard_path = str(beside.absolute())
    return profile


def bootstrap_spec(profiles: dict[str, Profile], seed: int = 0, tolerance: float = 0.9) -> Spec:
    return Spec(seed=seed, tolerance=tolerance, tables={t: TableSpec(profile=p.to_dict(), rows=p.row_count, sensitive_columns=list(p.sensitive)) for t, p in profiles.items()})


def bootstrap_from_source(source, tables: list[str], rows: int = 1000, seed: int = 0, tolerance: float = 0.9, sensitive: dict[str, list[str]] | None = None, classify_pii: bool = False, salt: str | None = None, guards: str | None = None) -> Spec:
    """Profile a sample of each table; guards cover all rows and are stored in the folder `guards`. The default salt follows the seed, so that runs agree; name a secret one where digests must withstand guessing."""
    from ..operators.profile import profile_table

    made = {}
    for t in tables:
        part = source.sample(t, rows, seed)
        made[t] = profile_table(part, sensitive=tuple((sensitive or {}).get(t, ())), classify_pii=classify_pii, salt=salt or f"spec-{t}-{seed}", whole=Table(source.read(t), part.schema))
        if made[t].guard is not None:
            if guards is None:
                raise ConfigError(f"{t} has sensitive columns {list(made[t].sensitive)}; name a folder for guards")
            save_guard(made[t], f"{guards}/{t}.guard")
    return bootstrap_spec(made, seed, tolerance)


def spec_profiles(spec: Spec) -> dict[str, Profile]:
    return {t: Profile.from_dict(s.profile) for t, s in spec.tables.items()}


def pinned_deps() -> dict[str, str]:
    return {p: metadata.version(p) for p in ("numpy", "pyspark")}


def consistency_fingerprint(spec: Spec, deps: dict[str, str] | None = None, mode: str = "spark") -> str:
    """What decides the generated bytes: the spec without its destination, chunking and places of guards, and the libraries. Layouts don't count: positions decide."""
    unit = {"spec": spec.model_dump(exclude={"destination": True, "chunk_rows": True, "tables": {"__all__": {"profile": {"guard_path"}}}}), "deps": pinned_deps() if deps is None else deps, "mode": mode}
    return hashlib.blake2b(json.dumps(unit, sort_keys=True, separators=(",", ":"), default=str).encode(), digest_size=32).hexdigest()


def assert_nonprod_destination(destination: DestinationSpec | None, deny: tuple[str, ...] = DENIED) -> None:
    """The destination must say that it is no production, and no pattern may match its host or database."""
    if destination is None or destination.environment != NONPROD:
        raise GuardrailError(f"the destination must affirm environment: {NONPROD}")
    for value in filter(None, (destination.host, destination.database)):
        # the affirmation itself is no reason to refuse
        if any(fnmatch(value.lower(), p.lower()) for p in deny):
            raise GuardrailError(f"{value} looks like production")


def assert_affirmed_place(destination: DestinationSpec, place: tuple[str | None, str | None], deny: tuple[str, ...] = DENIED) -> None:
    """What is written to must not look like production. A connection must be to the host and the database that the destination names, if
    it names them; a folder has no host to compare."""
    host, database = place
    assert_nonprod_destination(DestinationSpec(environment=destination.environment, host=host, database=database), deny)
    for what, affirmed, real in (("host", destination.host, host), ("database", destination.database, database)):
        if host is not None and affirmed and affirmed != real:
            raise GuardrailError(f"the destination affirms {what} {affirmed}, not {real}")
