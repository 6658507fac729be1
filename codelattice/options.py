"""Options of the reports, with their defaults; validation happens here only."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import floor

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def to_bool(value, default: bool = False) -> bool:
    if isinstance(value, bool):
        return value
    text = str(value).strip().lower() if value is not None else ""
    return True if text in _TRUE else False if text in _FALSE else default


def to_number(value, default: float = 0) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return default


def depth(value, default: int = 2) -> int:
    return max(0, floor(to_number(value, default)))


def at_least_one(value, default: int) -> int:
    return max(1, int(to_number(value, default)))


def direction(value) -> str:
    return "incoming" if str(value) in ("incoming", "in", "reverse") else "outgoing"


# The defaults of all options below.


@dataclass(frozen=True)
class Resolution:
    score_window: int = 25
    min_confidence: str = "medium"
    max_targets: int = 3


@dataclass(frozen=True)
class DeadCode:
    ignore_tests: bool = True
    ignore_entrypoints: bool = True
    ignore_prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class HotPath:
    top_n: int = 10
    max_depth: int = 4
    path_depth: int = 5
    path_count: int = 5
    direction: str = "outgoing"
    include_tests: bool = False
    weight_in: float = 2.2
    weight_out: float = 1.6
    weight_balance: float = 2.4
    weight_reach: float = 1.1
    include_churn: bool = True
    churn_limit: int = 60
    churn_since: str | None = None
    #: Also accepted under the command's name, churn_weight (see ``hot_path``).
    weight_churn: float = 0.15


@dataclass(frozen=True)
class Complexity:
    include_tests: bool = False
    top_n: int = 15
    scc_limit: int = 10
    cycle_weight: float = 12.0
    degree_weight: float = 1.0
    bridge_weight: float = 1.5
    scc_size_weight: float = 0.7
    thresholds: tuple[float, float, float] = (70.0, 45.0, 25.0)
    suggestion_scc_size: int = 6
    suggestion_density: float = 0.35
    suggestion_top_bridge: int = 6


#: Which layer may depend on which; ``*`` is any.
ALLOWED = {
    "interface": ("interface", "application", "domain", "shared"),
    "application": ("application", "domain", "shared"),
    "domain": ("domain", "shared"),
    "infrastructure": ("infrastructure", "domain", "shared"),
    "shared": ("shared", "domain"),
    "core": ("core", "interface", "application", "domain", "infrastructure", "shared"),
    "test": ("*",),
}
#: Heights of the layers.
LEVELS = {"interface": 5, "application": 4, "core": 4, "domain": 3, "shared": 3, "infrastructure": 2, "test": 1}
#: Words in a path or module that name a layer, first layer first.
LAYER_WORDS = {
    "interface": ("ui", "view", "views", "controller", "controllers", "handler", "handlers", "api", "cli", "window", "render"),
    "application": ("app", "application", "service", "services", "usecase", "usecases", "workflow", "orchestrator"),
    "domain": ("domain", "model", "models", "entity", "entities", "core", "graph", "analysis", "knowledge"),
    "infrastructure": ("infra", "infrastructure", "repo", "repository", "gateway", "adapter", "adapters", "storage", "db", "client", "lsp"),
}
#: Layers by top folder.
TOP_DIRS = {"lua": "core", "tests": "test", "test": "test", "spec": "test", "playground": "application"}


@dataclass(frozen=True)
class Architecture:
    include_tests: bool = False
    unknown_layer_policy: str = "allow"
    max_examples: int = 3
    layer_by_top_dir: dict = field(default_factory=lambda: dict(TOP_DIRS))
    layer_by_path_prefix: dict = field(default_factory=dict)
    layer_by_module_prefix: dict = field(default_factory=dict)
    domain_by_top_dir: dict = field(default_factory=dict)
    domain_by_path_prefix: dict = field(default_factory=dict)
    domain_segment: int = 2
    layer_words: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)
    thresholds: tuple[float, float, float] = (90.0, 70.0, 55.0)
    rules: dict = field(default_factory=dict)
    rules_mode: str = "merge"

    def allowed(self) -> dict[str, set[str]]:
        """Layers and what they may depend on; custom rules hold target: bool."""
        base = {} if self.rules_mode == "replace" else {k: dict.fromkeys(v, True) for k, v in ALLOWED.items()}
        for layer, own in self.rules.items():
            own = own if isinstance(own, dict) else dict.fromkeys(own, True)
            base[layer] = base.get(layer, {}) | own
        return {k: {t for t, on in v.items() if on is True} for k, v in base.items()}


@dataclass(frozen=True)
class Evolution:
    limit: int = 30
    hotspot_limit: int = 10
    include_merges: bool = False
    since: str | None = None
    path: str | None = None


@dataclass(frozen=True)
class Risk:
    top_n: int = 20
    include_tests: bool = False
    include_churn: bool = True
    churn_limit: int = 60
    churn_since: str | None = None
    weight_hot: float = 1.3
    weight_complexity: float = 1.1
    weight_architecture: float = 1.6
    weight_churn: float = 0.35
    thresholds: tuple[float, float, float] = (2.2, 1.4, 0.8)
    #: The risk map uses an architecture report of its own.
    architecture: Architecture = field(default_factory=lambda: Architecture(max_examples=8))
    heavy_churn: int = 400


@dataclass(frozen=True)
class Layout:
    algorithm: str = "hierarchical"
    spacing_x: float = 220
    spacing_y: float = 90
    iterations: int = 24
    width: float = 1200
    height: float = 800


@dataclass(frozen=True)
class Knowledge:
    include_types: bool = True
    include_tests: bool = True
    include_external: bool = True
    include_imports: bool = True
