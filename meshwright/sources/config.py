"""Configuration files: YAML or JSON into typed parameters, with typos refused."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path


class ConfigError(ValueError):
    """A configuration that can't be used."""


class SiteType(Enum):
    POP = "POP"
    DN = "DN"
    CN = "CN"


@dataclass
class Sector:
    """Radio of a sector."""

    horizontal_scan_range: float = 70.0
    number_sectors_per_node: int = 1
    antenna_boresight_gain: float = 30.0
    maximum_tx_power: float = 16.0
    minimum_tx_power: float | None = None
    tx_miscellaneous_loss: float = 0.0
    rx_miscellaneous_loss: float = 0.0
    tx_diversity_gain: float = 0.0
    rx_diversity_gain: float = 0.0
    minimum_mcs_level: int | None = None


@dataclass
class Device:
    device_sku: str = "DEFAULT_DEVICE"
    device_type: SiteType = SiteType.DN
    number_of_nodes_per_site: int = 4
    sector_params: Sector = field(default_factory=Sector)

    def __post_init__(self) -> None:
        covered = self.number_of_nodes_per_site * self.sector_params.number_sectors_per_node * self.sector_params.horizontal_scan_range
        if covered > 360:
            raise ConfigError(f"sectors of {self.device_sku} cover {covered} degrees")


@dataclass
class LineOfSight:
    minimum_los_distance: float = 20.0
    maximum_los_distance: float = 400.0
    maximum_elevation_scan_angle: float = 25.0
    los_confidence_threshold: float = 1.0
    use_ellipsoidal_los_model: bool = False
    carrier_frequency: float = 60_000.0

    def __post_init__(self) -> None:
        if not 0 <= self.los_confidence_threshold <= 1:
            raise ConfigError("los_confidence_threshold must be within 0 and 1")
        if self.minimum_los_distance > self.maximum_los_distance:
            raise ConfigError("minimum_los_distance is above maximum_los_distance")


@dataclass
class Plan:
    device_list: list[Device] = field(default_factory=lambda: [Device()])
    los: LineOfSight = field(default_factory=LineOfSight)
    thermal_noise_power: float = -81.0
    noise_figure: float = 7.0
    rain_rate: float = 30.0
    link_availability_percentage: float = 99.9
    maximum_number_hops: int | None = None

    def __post_init__(self) -> None:
        names = [d.device_sku.lower() for d in self.device_list]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ConfigError(f"devices given twice: {', '.join(twice)}")


def _typed(kind, value, where: str):
    if value is None:
        return None
    if isinstance(kind, types.UnionType) or typing.get_origin(kind) is typing.Union:
        return _typed(next(k for k in typing.get_args(kind) if k is not type(None)), value, where)
    if typing.get_origin(kind) is list:
        return [_typed(typing.get_args(kind)[0], v, f"{where}[{i}]") for i, v in enumerate(value)]
    if dataclasses.is_dataclass(kind):
        return from_dict(kind, value, where)
    if isinstance(kind, type) and issubclass(kind, Enum):
        try:
            return kind[str(value).strip().upper()]
        except KeyError:
            raise ConfigError(f"{where}: {value!r} is none of {[k.name for k in kind]}") from None
    if kind is bool and not isinstance(value, bool):
        raise ConfigError(f"{where}: {value!r} is not true or false")
    try:
        return kind(value)
    except (TypeError, ValueError):
        raise ConfigError(f"{where}: {value!r} is no {kind.__name__}") from None


def from_dict(cls, data: Mapping, where: str = ""):
    """Builds a parameter class; names ignore case, null keeps the default, unknown names are errors."""
    if not isinstance(data, Mapping):
        raise ConfigError(f"{where or 'configuration'}: fields expected")
    hints = typing.get_type_hints(cls)
    names = {f.name.lower(): f.name for f in dataclasses.fields(cls)}
    given = {str(k).strip().lower(): v for k, v in data.items()}
    if unknown := sorted(set(given) - set(names)):
        raise ConfigError(f"{where or 'configuration'}: unknown fields {', '.join(unknown)}")
    return cls(**{names[k]: _typed(hints[names[k]], v, f"{where}.{names[k]}".lstrip(".")) for k, v in given.items() if v is not None})


def to_dict(params) -> dict:
    """The inverse of from_dict."""
    if isinstance(params, Enum):
        return params.name
    if dataclasses.is_dataclass(params):
        return {f.name: to_dict(getattr(params, f.name)) for f in dataclasses.fields(params)}
    return [to_dict(x) for x in params] if isinstance(params, list) else params


def load(path: str, cls=Plan, section: str | None = None):
    """Parameters from a .yaml, .yml or .json file."""
    text, kind = Path(path).read_text(encoding="utf-8"), Path(path).suffix.lower()
    if kind in (".yaml", ".yml"):
        import yaml

        data = yaml.safe_load(text)
    elif kind == ".json":
        data = json.loads(text)
    else:
        raise ConfigError(f"{path}: .yaml, .yml or .json expected")
    return from_dict(cls, (data or {}).get(section, {}) if section else data or {})
