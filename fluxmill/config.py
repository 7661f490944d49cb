"""Environments: immutable values that say where an instance of the engine lives."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


def param(params: Mapping[str, str] | None, name: str, default: str = "") -> str:
    """A parameter's text without surrounding blanks, or the default."""
    value = (params or {}).get(name)
    return (default if value is None else str(value)).strip()


@dataclass(frozen=True)
class Geofence:
    """A named box; its bounds belong to it."""

    name: str = "chicago_loop"
    min_lat: float = 41.80
    max_lat: float = 41.95
    min_lon: float = -87.75
    max_lon: float = -87.55

    @classmethod
    def from_params(cls, params: Mapping[str, str] | None) -> Geofence:
        own = cls()
        bounds = {k: float(param(params, f"geofence_{k}", str(getattr(own, k)))) for k in ("min_lat", "max_lat", "min_lon", "max_lon")}
        return cls(param(params, "geofence_name", own.name), **bounds)


@dataclass(frozen=True)
class Env:
    """One environment: a catalog and schema below a root that driver and executors share."""

    root: str
    catalog: str = "telematics"
    schema: str = "dev"
    landing_volume: str = "landing"
    checkpoints_volume: str = "checkpoints"
    geofence: Geofence = field(default_factory=Geofence)
    batches: int = 20
    schedule: str | None = None

    @classmethod
    def from_params(cls, root: str, params: Mapping[str, str] | None = None) -> Env:
        """Values of the named target (``schema``), overridden by ``params``."""
        target = TARGETS.get(param(params, "schema", "dev"), {})
        merged = {**target, **(params or {})}
        return cls(
            root.rstrip("/"),
            param(merged, "catalog", "telematics"),
            param(merged, "schema", "dev"),
            param(merged, "landing_volume", "landing"),
            param(merged, "checkpoints_volume", "checkpoints"),
            Geofence.from_params(merged),
            int(param(merged, "batches", "20")),
            param(merged, "schedule") or None,
        )

    @property
    def home(self) -> str:
        return f"{self.root}/{self.catalog}/{self.schema}"

    def table(self, name: str) -> str:
        return f"{self.catalog}.{self.schema}.{name}"

    def table_path(self, name: str) -> str:
        return f"{self.home}/tables/{name}"

    @property
    def landing_path(self) -> str:
        return f"{self.home}/volumes/{self.landing_volume}"

    @property
    def volumes(self) -> list[str]:
        return [self.checkpoints_volume, self.landing_volume]

    def checkpoint_path(self, stream: str) -> str:
        """Each stream of each environment has a checkpoint of its own."""
        return f"{self.home}/volumes/{self.checkpoints_volume}/{stream}"

    def substitutions(self) -> dict[str, str]:
        """What migrations may refer to as ${name}."""
        g = self.geofence
        return {"catalog": self.catalog, "schema": self.schema, "geofence_name": g.name, "geofence_min_lat": f"{g.min_lat}", "geofence_max_lat": f"{g.max_lat}", "geofence_min_lon": f"{g.min_lon}", "geofence_max_lon": f"{g.max_lon}"}


# What the three targets differ in.
TARGETS: dict[str, dict[str, str]] = {
    "dev": {"schema": "dev", "batches": "20"},
    "test": {"schema": "test", "batches": "10", "schedule": "hourly"},
    "prod": {"schema": "prod", "batches": "5", "schedule": "quarter-hourly"},
}
