"""Parameters of a line-scan pipeline: defaults, config files, overrides, validation."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from enum import Enum

from scanloom.functions.kernel import DEFAULT_TAPS


class Mode(Enum):
    RANDOM = "random"
    CSV = "csv"


class Boundary(Enum):
    REPLICATE = "replicate"
    ZERO_PAD = "zero_pad"


class Mismatch(Enum):
    REJECT = "reject"
    TRUNCATE = "truncate"
    ZERO_PAD = "zero_pad"


class ConfigError(ValueError):
    pass


def _choice(kind: type[Enum], text: str) -> Enum:
    """Unknown text gives the first value, as the file format has it."""
    return next((x for x in kind if x.value == text.strip()), next(iter(kind)))


def _integer(text: str) -> int:
    found = re.match(r"\s*([+-]?\d+)", text)
    if not found:
        raise ConfigError(f"not a number: {text!r}")
    return int(found[1])


def _tap(text: str) -> str:
    if not math.isfinite(float(text)):
        raise ConfigError(f"kernel taps must be finite: {text!r}")
    return text.strip()


@dataclass(frozen=True)
class PipelineConfig:
    m: int = 0
    T: int = 0  # ns
    threshold: int = 0
    mode: Mode = Mode.RANDOM
    input_file: str = "sample_input.csv"
    kernel: tuple[str, ...] = ()
    run_duration_ms: int = 0
    max_rows: int = 0
    boundary_policy: Boundary = Boundary.REPLICATE
    csv_mismatch_policy: Mismatch = Mismatch.REJECT
    write_output: bool = True
    output_file: str = "output.csv"

    def validated(self) -> PipelineConfig:
        """The same with the default kernel where none is given; raises ConfigError if it cannot run."""
        if self.mode is Mode.RANDOM and (self.m < 2 or self.m % 2):
            raise ConfigError("m must be even and at least 2 in random mode")
        if self.T <= 0:
            raise ConfigError("T must be over 0 ns")
        if self.mode is Mode.CSV and not self.input_file:
            raise ConfigError("csv mode needs input_file")
        out = self if self.kernel else replace(self, kernel=DEFAULT_TAPS)
        if len(out.kernel) % 2 == 0:
            raise ConfigError("the kernel needs an odd number of taps")
        return out

    def describe(self) -> dict[str, str]:
        """Each parameter as text, for an echo of the configuration."""
        text = lambda v: v.value if isinstance(v, Enum) else ",".join(v) if isinstance(v, tuple) else str(v)
        return {f.name: text(getattr(self, f.name)) for f in fields(self)}


def parse_text(text: str, base: PipelineConfig | None = None) -> PipelineConfig:
    """key=value lines; a # in the first column is a comment; unknown keys are skipped; kernel lines add up."""
    out, taps = base or PipelineConfig(), []
    for line in text.splitlines():
        if line.startswith("#") or "=" not in line:
            continue
        key, _, value = (x.strip() for x in line.partition("="))
        if key == "kernel":
            taps += [_tap(x) for x in value.split(",") if x.strip()]
        else:
            out = _with(out, key, value)
    return replace(out, kernel=tuple(taps)) if taps else out


def _with(config: PipelineConfig, key: str, value: str) -> PipelineConfig:
    readers = {
        "m": _integer,
        "T": _integer,
        "threshold": lambda x: _integer(x) % 256,
        "mode": lambda x: _choice(Mode, x),
        "input_file": str,
        "run_duration_ms": _integer,
        "max_rows": _integer,
        "boundary_policy": lambda x: _choice(Boundary, x),
        "csv_mismatch_policy": lambda x: _choice(Mismatch, x),
        "write_output": lambda x: x in ("true", "1", "yes"),
        "output_file": str,
    }
    return replace(config, **{key: readers[key](value)}) if key in readers else config


#: Command-line options and the keys that they override.
OPTIONS = {"--mode": "mode", "--duration": "run_duration_ms", "--max-rows": "max_rows", "--boundary": "boundary_policy", "--csv-mismatch": "csv_mismatch_policy", "--write-output": "write_output", "--output-file": "output_file"}


def with_options(config: PipelineConfig, arguments: Sequence[str]) -> PipelineConfig:
    """--option=value arguments override parameters; unknown ones are skipped."""
    options = dict(a.split("=", 1) for a in arguments if a.startswith("--") and "=" in a)
    for option, key in OPTIONS.items():
        if option in options:
            config = _with(config, key, options[option])
    return config


def load(arguments: Sequence[str] = (), default_file: str = "Config.cfg", overrides: Mapping[str, str] | None = None) -> PipelineConfig:
    """A file (--config=; a missing one raises, the default one may be missing), then options, then overrides."""
    options = dict(a.split("=", 1) for a in arguments if a.startswith("--") and "=" in a)
    path = options.get("--config", default_file)
    config = PipelineConfig()
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            config = parse_text(f.read())
    elif "--config" in options:
        raise ConfigError(f"no config file {path}")
    config = with_options(config, arguments)
    for key, value in (overrides or {}).items():
        config = _with(config, key, value)
    return config.validated()
