"""Settings that change results, read from and written to TOML; and control files."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields

from wattloom.operators.closure import METRICS, MILESTONES, Budget


@dataclass(frozen=True)
class Config:
    """Fixed defaults; unknown keys of a file are ignored."""

    baseline_feature: str = "fe_physical_mw"
    linear_features: list[str] = field(default_factory=lambda: ["fe_physical_mw", "wire_cap_pf", "cell_cap_pf"])
    physics_features: list[str] = field(default_factory=lambda: ["dyn_term", "move_term", "leak_term", "fe_physical_mw"])
    datamove_features: list[str] = field(default_factory=lambda: ["cell_dyn_term", "wire_dyn_term", "move_term", "leak_term"])
    whatif_model: str = "datamove"
    cv_min_builds: int = 3
    test_fraction: float = 0.2
    min_builds_warn: int = 5
    top_n_errors: int = 10
    strict_consistency: bool = True
    qualify_tolerance_pct: float = 5.0
    stale_days: int = 120
    near_zero_mw: float = 0.01
    leakage_workload_tol_pct: float = 5.0
    group_sum_tol_pct: float = 5.0
    unit_magnitude_ratio: float = 50.0
    use_sanitized: bool = True
    source_patterns: dict[str, str] = field(default_factory=dict)
    disabled_sources: list[str] = field(default_factory=list)
    upf_pattern: str = "intent/*.upf"
    budgets_file: str = "budgets.toml"
    identity: dict[str, object] = field(default_factory=lambda: {"kind": "explicit_map", "replica_policy": "sum", "merge_basis": "share", "divider": "/", "strip_top": False, "lowercase": False, "name_rules": []})
    tree_features: list[str] = field(default_factory=lambda: ["fe_physical_mw", "wire_cap_pf", "cell_cap_pf", "area", "cell_count", "fanout", "frequency_ghz", "voltage_v", "activity", "wire_cap_fraction", "dyn_term", "leak_term"])
    anomaly_idle_ratio: float = 0.35
    anomaly_eff_ratio: float = 2.0
    anomaly_regression_pct: float = 10.0
    anomaly_clock_fraction: float = 0.5
    anomaly_creep_builds: int = 3
    anomaly_creep_pct: float = 15.0
    anomaly_replica_ratio: float = 1.3
    anomaly_profile_tol_pct: float = 5.0

    @classmethod
    def read(cls, path: str) -> Config:
        with open(path, "rb") as f:
            found = tomllib.load(f)
        return cls(**{k: v for k, v in found.items() if k in {x.name for x in fields(cls)}})

    def to_toml(self) -> str:
        """Flat keys, then a table for each group of them."""
        flat, tables = {}, {}
        for k, v in asdict(self).items():
            (tables if isinstance(v, dict) else flat)[k] = v
        lines = [f"{k} = {json.dumps(v)}\n" for k, v in flat.items()]
        for k, v in tables.items():
            lines += [f"\n[{k}]\n", *(f"{json.dumps(name)} = {json.dumps(x)}\n" for name, x in v.items())]
        return "".join(lines)


def read_budgets(path: str) -> list[Budget]:
    """Budgets with the file's defaults under them; ``<metric> = value`` stands for metric and target."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    known = {x.name for x in fields(Budget)}
    out = []
    for b in found.get("budget", []):
        b = found.get("defaults", {}) | b
        metric = b.get("metric") or next((m for m in METRICS if m in b), "be_mw")
        if metric not in METRICS:
            raise ValueError(f"{metric} is no convergence metric ({', '.join(METRICS)})")
        target = b.get("target", b.get(metric))
        if target is None:
            raise ValueError(f"no target for {b.get('design')} {b.get('scope', 'design')}")
        tolerance = MILESTONES | {k: float(v) for k, v in (b.get("tolerance_pct") or {}).items()}
        own = {k: v for k, v in b.items() if k in known} | {"metric": metric, "target": float(target), "tolerance_pct": tolerance}
        out.append(Budget(**{"scope": "design"} | own))
    return out


def read_scenarios(path: str) -> list[dict]:
    """Scenarios as overrides: ``set`` gives values, ``scale`` factors."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    out = []
    for s in found.get("scenario", []):
        s = found.get("defaults", {}) | s
        overrides = dict(s.get("set", {})) | {k: f"x{v}" for k, v in s.get("scale", {}).items()}
        overrides |= {k: s[k] for k in ("frequency_ghz", "voltage_v") if k in s}
        out.append({"name": s["name"], "design": s.get("design"), "workload": s.get("workload", "typical"), "operating_point": s.get("operating_point"), "overrides": overrides})
    return out


#: Named presets of how report names become blocks: what set-up each is for, and the settings that it changes.
#: Names and settings; a rule's replacement refers to groups as $1.
PRESETS: dict[str, tuple[str, dict[str, object]]] = {
    "flattened_backend": ("small modules are ungrouped: several blocks share a signoff object by share", {"merge_basis": "share"}),
    "replicated_units": ("one module, many instances: a glob in the map, and their sum (or each, by per_instance)", {"replica_policy": "sum"}),
    "rtl_activity_only": ("activity has RTL names: escapes, dots and copies' suffixes are rewritten", {"name_rules": [["\\\\", ""], ["\\.", "/"], ["_(?:phys|r\\d+)$", ""], ["_\\d+$", ""]], "lowercase": True}),
    "same_hierarchy": ("signoff keeps the RTL's paths: the map needs one path a block", {"kind": "same_hierarchy"}),
    "separate_hierarchies": ("a map relates both sides; suffixes of physical copies go", {"name_rules": [["_(?:phys|r\\d+)$", ""]]}),
}


def read_identity(path: str) -> dict[str, object]:
    """A preset of name rules and replica policy, by its name or from a file."""
    if path in PRESETS:
        return Config().identity | PRESETS[path][1]
    if "." not in path and "/" not in path:
        raise ValueError(f"no preset {path}; there are {', '.join(PRESETS)}")
    with open(path, "rb") as f:
        found = tomllib.load(f)
    return Config().identity | found.get("identity", found)
