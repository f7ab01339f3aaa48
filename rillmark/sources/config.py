"""Settings, handed on explicitly."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Equilibration:
    days: int = 14
    overrides: dict[str, int] = field(default_factory=dict)
    variables: tuple[str, ...] = ("moisture", "soil_temp", "sat_extract_ec")


@dataclass(frozen=True)
class Settings:
    equilibration: Equilibration = Equilibration()
    data_root: str = "data/unpacked"
    metadata: str = "data/Metadata.xlsx"
    rain_gauge_valid_until: str | None = None
    x_sign: int = -1
    y_sign: int = -1


def load(path: str) -> Settings:
    """Settings of a JSON file; relative paths start from its parent folder's parent."""
    file = Path(path)
    raw = json.loads(file.read_text())
    eq, data, frame = raw.get("equilibration", {}), raw.get("data", {}), raw.get("spatial_frame", {})
    base = file.resolve().parent.parent
    place = lambda p: str(base / p)
    default = Settings()
    return Settings(
        Equilibration(int(eq.get("days_default", 14)), {k: int(v) for k, v in eq.get("days_overrides", {}).items()}, tuple(eq.get("variables", Equilibration().variables))),
        place(data.get("data_root", default.data_root)),
        place(data.get("metadata_xlsx", default.metadata)),
        data.get("rain_gauge_valid_until"),
        int(frame.get("raw_x_sign", -1)),
        int(frame.get("raw_y_sign", -1)),
    )
