"""Configuration: defaults, a file of NAME=value lines over them, the environment over both."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    root: str = "telemetry"
    table_prefix: str = "tel_"
    sealed: str = "sealed"
    model_name: str = ""
    job_days: int = 30
    refresh_days: int = 90
    max_counted: int = 60


def load(path: str | None = None, environ: dict[str, str] | None = None, prefix: str = "VIGIL_") -> Settings:
    """The settings; names in the file and the environment carry the prefix."""
    given = {}
    if path and Path(path).exists():
        lines = (line.strip() for line in Path(path).read_text().splitlines())
        given = {k.strip(): v.strip().strip("'\"") for k, _, v in (x.partition("=") for x in lines if x and not x.startswith("#"))}
    given |= os.environ if environ is None else environ
    out = Settings()
    for f in fields(out):
        if (text := given.get(prefix + f.name.upper())) is not None:
            out = replace(out, **{f.name: type(getattr(out, f.name))(text)})
    return out
