"""A run's settings: small frozen classes, read from JSON or a dict, checked before anything runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from voxframe.engines.demons import ENGINES, Stage


@dataclass(frozen=True)
class Tiling:
    """Chunk geometry in voxels."""

    core: int = 32
    halo: int = 12
    lattice: int = 1


@dataclass(frozen=True)
class Solver:
    """How a chunk is solved, and when its result is trusted."""

    engine: str = "demons"
    features: str = "intensity"
    stages: tuple[Stage, ...] = (Stage(),)
    coarsest: tuple[Stage, ...] = (Stage(scales=(4, 2, 1), iterations=(40, 25, 15)),)
    min_tissue: float = 0.02
    max_folds: float = 1e-3
    ladder: tuple[str, ...] = ("none", "smoother", "shorter", "seed")


@dataclass(frozen=True)
class Stopping:
    """When a level's passes stop."""

    caps: tuple[int, ...] = (2, 3)
    residual_frac: float = 0.5
    residual_vox: float = 0.05
    ubar_vox: float = 0.05
    plateau_passes: int = 0
    plateau_rel: float = 0.05
    quantile: float = 99.0


@dataclass(frozen=True)
class Run:
    """A whole run: levels are numbered from 0, the finest."""

    spacing: float = 0.05
    tiling: Tiling = field(default_factory=Tiling)
    solver: Solver = field(default_factory=Solver)
    stopping: Stopping = field(default_factory=Stopping)
    eps: float = 0.25
    sharpen: float = 0.0
    coarsest_frac: float = 0.25
    template: int | None = None
    stop_at: int = 0

    def checked(self) -> Run:
        """Itself, if its parts fit together."""
        t, s = self.tiling, self.solver
        if t.core <= 0 or t.halo < 0 or t.lattice < 1 or t.core % t.lattice:
            raise ValueError("a core is a whole number of lattice voxels, a halo is not negative")
        if self.clamp_voxels() <= 0:
            raise ValueError("the halo leaves no room for a displacement")
        if s.engine not in ENGINES:
            raise ValueError(f"no engine {s.engine!r}")
        if not self.stopping.caps or min(self.stopping.caps) < 1:
            raise ValueError("each level needs a cap of one pass at least")
        if self.spacing <= 0 or not 0 <= self.eps <= 1:
            raise ValueError("spacing is positive, eps lies in [0, 1]")
        return self

    def clamp_voxels(self) -> float:
        """The longest displacement of a pass that the halo leaves room for: smoothing and gradients need the rest."""
        most = max((st.scales[0] * (1 + 3 * max(st.sigma_step, st.sigma_field)) for st in self.solver.stages), default=0)
        return self.tiling.halo - min(most, self.tiling.halo - 1)

    def cap(self, level: int, coarsest: int) -> int:
        """Passes of a level; the caps count from the coarsest on, the last one repeats."""
        caps = self.stopping.caps
        return caps[min(coarsest - level, len(caps) - 1)]

    def digest(self) -> str:
        """16 hexadecimal digits that stay the same while the settings do."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


_PARTS = {"tiling": Tiling, "solver": Solver, "stopping": Stopping}


def _made(kind: type, given: dict) -> object:
    known = {f.name for f in fields(kind)}
    if strange := sorted(set(given) - known):
        raise ValueError(f"{kind.__name__} has no {', '.join(strange)}")
    values = {}
    for k, v in given.items():
        if k in _PARTS and isinstance(v, dict):
            v = _made(_PARTS[k], v)
        elif k in ("stages", "coarsest"):
            v = tuple(s if is_dataclass(s) else _made(Stage, s) for s in v)
        elif isinstance(v, list):
            v = tuple(v)
        values[k] = v
    return kind(**values)


def load(given: str | dict) -> Run:
    """Settings from a dict or JSON text; names that do not exist are refused."""
    return _made(Run, json.loads(given) if isinstance(given, str) else given).checked()  # type: ignore[union-attr]


def dump(run: Run) -> str:
    """Settings as JSON that load() reads back."""
    return json.dumps(asdict(run), indent=2, sort_keys=True)
