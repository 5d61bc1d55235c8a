"""Run configuration: TOML merged with defaults, section by section."""

from __future__ import annotations

import tomllib
import warnings
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass(frozen=True)
class Preprocessing:
    v_coverage: float = 90.0
    j_coverage: float = 60.0
    v_evalue: float = 1e-3


@dataclass(frozen=True)
class GermlineCriteria:
    unique_cdr3s: int = 5
    unique_js: int = 3
    whitelist: bool = True
    cluster_size: int = 50
    allow_stop: bool = False
    cross_mapping_ratio: float = 0.02
    clonotype_ratio: float = 0.12
    exact_ratio: float = 0.12
    cdr3_shared_ratio: float = 0.8
    unique_d_ratio: float = 0.3
    unique_d_threshold: int = 10


PRE_GERMLINE = GermlineCriteria(unique_cdr3s=2, unique_js=2, cluster_size=0, allow_stop=True)


@dataclass(frozen=True)
class JDiscovery:
    allele_ratio: float = 0.2
    cross_mapping_ratio: float = 0.1
    propagate: bool = True


@dataclass(frozen=True)
class Config:
    species: str = ""
    sequence_type: str = "Ig"
    merge_program: str = "pear"
    limit: int = 0
    multialign_program: str = "builtin"
    mismatch_penalty: int = 0
    barcode_length: int = 0
    barcode_consensus: bool = True
    group_trim_g: bool = False
    group_by_cdr3: str = "none"
    pseudo_cdr3_start: int = 80
    pseudo_cdr3_end: int = 60
    group_minimum_length: int = 0
    iterations: int = 1
    ignore_j: bool = False
    d_coverage: float = 70
    subsample: int = 1000
    consensus_threshold: float = 60.0
    rename: bool = False
    race_g: bool = False
    seed: int = 1
    preprocessing_filter: Preprocessing = field(default_factory=Preprocessing)
    pre_germline_filter: GermlineCriteria = PRE_GERMLINE
    germline_filter: GermlineCriteria = field(default_factory=GermlineCriteria)
    j_discovery: JDiscovery = field(default_factory=JDiscovery)


#: Accepted for old files, without effect.
IGNORED = ("flash_maximum_overlap", "minimum_merged_read_length", "stranded", "exact_copies")


def parse(found: dict) -> Config:
    """Config of a parsed TOML document; what it lacks has its default."""
    known = {f.name: f for f in fields(Config)}
    base = Config()
    values = {}
    for k, v in found.items():
        if k in IGNORED:
            warnings.warn(f"setting {k} has no effect", stacklevel=2)
        elif k in known:
            now = getattr(base, k)
            values[k] = type(now)(**(asdict(now) | v)) if is_dataclass(now) else v
    return Config(**values)


def load(path: str | Path) -> Config:
    with open(path, "rb") as f:
        return parse(tomllib.load(f))


def dumps(config: Config) -> str:
    def value(v) -> str:
        return str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v)

    flat = {k: v for k, v in asdict(config).items() if not isinstance(v, dict)}
    parts = [*(f"{k} = {value(v)}" for k, v in flat.items())]
    for k, v in asdict(config).items():
        if isinstance(v, dict):
            parts += ["", f"[{k}]", *(f"{a} = {value(b)}" for a, b in v.items())]
    return "\n".join(parts) + "\n"


def write_default(path: str | Path) -> bool:
    """Whether the file was written; an existing one stays."""
    p = Path(path)
    if p.exists():
        return False
    p.write_text(dumps(Config()))
    return True
