"""Model specifications: priors of coefficient blocks, controls, and their calibration.

A model is one block or an ordered mapping of named blocks.  A block is a
mapping with ``model``, its predictors (``columns`` of raw data, ``indices`` or
names of summary data) and the fields of its prior; other fields are errors.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

MODELS = ("Normal", "SpikeSlab", "GlobalLocal", "SpikeMultiSlab", "Fixed")
_COMMON = {"model", "columns", "indices", "standardize"}
FIELDS = {
    "Normal": {"var", "var_shape", "var_scale", "expected_pve"},
    "SpikeSlab": {"var", "var_shape", "var_scale", "expected_pve", "pi"},
    "GlobalLocal": {"local_shape", "global_var", "global_scale", "expected_nonzero", "reference_residual_var", "expected_pve"},
    "SpikeMultiSlab": {"var", "var_shape", "var_scale", "expected_pve", "gamma", "alpha"},
    "Fixed": set(),
}
#: The priors' defaults.
DEFAULT_SHAPE, DEFAULT_SCALE = 2.0, 1.0
DEFAULT_PI, DEFAULT_LOCAL = (1.0, 1.0), (1.0, 0.5)
DEFAULT_GAMMA = (0.0, 0.01, 0.1, 1.0)
MAX_INT = 2**31 - 1


class SpecError(ValueError):
    """A specification that cannot be used as given."""


# -- scalars ----------------------------------------------------------------

def number(x: Any, what: str, *, above: float | None = None, below: float | None = None, least: float | None = None) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x):
        raise SpecError(f"{what} must be one finite number")
    if above is not None and x <= above or least is not None and x < least or below is not None and x >= below:
        raise SpecError(f"{what} is out of range")
    return float(x)


def positive(x: Any, what: str) -> float:
    return number(x, what, above=0)


def whole(x: Any, what: str, least: int = 0, most: int = MAX_INT) -> int:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x != math.floor(x) or not least <= x <= most:
        raise SpecError(f"{what} must be a whole number from {least} to {most}")
    return int(x)


def flag(x: Any, what: str) -> bool:
    if not isinstance(x, bool):
        raise SpecError(f"{what} must be true or false")
    return x


def pair(x: Any, what: str, names: tuple[str, str] = ("a", "b")) -> tuple[float, float]:
    """Two positive numbers, by name where names are given and by place otherwise."""
    if isinstance(x, Mapping):
        if set(x) != set(names):
            raise SpecError(f"{what} must have {names[0]} and {names[1]}")
        x = [x[n] for n in names]
    if isinstance(x, (str, bytes)) or not isinstance(x, Sequence) or len(x) != 2:
        raise SpecError(f"{what} must be two positive numbers")
    return positive(x[0], what), positive(x[1], what)


def many(x: Any, what: str) -> tuple[float, ...]:
    if isinstance(x, (str, bytes)) or not isinstance(x, Sequence):
        raise SpecError(f"{what} must be a sequence of numbers")
    return tuple(number(v, what, least=0) for v in x)


def share(x: Any, what: str) -> float:
    return number(x, what, above=0, below=1)


# -- blocks -----------------------------------------------------------------

@dataclass(frozen=True)
class Block:
    """One block after parsing; None for what does not apply or is still to be calibrated."""

    name: str
    model: str
    predictors: tuple[Any, ...] = ()
    standardize: bool = True
    var: float | None = None
    shape: float | None = None
    scale: float | None = None
    expected_pve: float | None = None
    pi: tuple[float, float] | None = None
    gamma: tuple[float, ...] | None = None
    alpha: tuple[float, ...] | None = None
    local_shape: tuple[float, float] | None = None
    global_var: float | None = None
    global_scale: float | None = None
    expected_nonzero: float | None = None
    reference_residual_var: float | None = None

    @property
    def penalized(self) -> bool:
        return self.model != "Fixed"

    @property
    def shares_sampled(self) -> bool:
        """Whether the block has a sampled quantity that all its predictors share."""
        if self.model in ("SpikeSlab", "SpikeMultiSlab"):
            return True
        if self.model == "Normal":
            return self.var is None
        return self.model == "GlobalLocal" and self.global_var is None


def unique_names(names: Sequence[str]) -> list[str]:
    """The names with ``.1``, ``.2`` ... after those that came before."""
    out: list[str] = []
    taken = set(names)
    seen: set[str] = set()
    for n in names:
        if n in seen:
            k = 1
            while f"{n}.{k}" in taken:
                k += 1
            n = f"{n}.{k}"
            taken.add(n)
        seen.add(n)
        out.append(n)
    return out


def parse_blocks(blocks: Mapping[str, Any] | Sequence[Any], where: str) -> list[Block]:
    """Blocks of a model; ``where`` is the field that names predictors (columns or indices)."""
    if isinstance(blocks, Mapping) and "model" in blocks:
        blocks = [blocks]
    if isinstance(blocks, Mapping):
        items = list(blocks.items())
    elif isinstance(blocks, Sequence) and not isinstance(blocks, (str, bytes)):
        items = [(None, b) for b in blocks]
    else:
        raise SpecError("a model is a block or named blocks")
    if not items:
        raise SpecError("a model needs a block")
    names = unique_names([n if isinstance(n, str) and n else f"ETA{i + 1}" for i, (n, _) in enumerate(items)])
    return [_block(n, b, where, len(items) == 1) for n, (_, b) in zip(names, items, strict=True)]


def _block(name: str, spec: Any, where: str, alone: bool) -> Block:
    if not isinstance(spec, Mapping):
        raise SpecError(f"block {name} must be a mapping")
    model = spec.get("model")
    if model not in MODELS:
        raise SpecError(f"block {name}: model must be one of {', '.join(MODELS)}")
    if unknown := set(spec) - FIELDS[model] - _COMMON:
        raise SpecError(f"block {name}: unknown fields {sorted(unknown)}")
    other = {"columns": "indices", "indices": "columns"}[where]
    if other in spec:
        raise SpecError(f"block {name}: {other} is not for this kind of data")
    given = spec.get(where)
    if given is None:
        if not (alone and where == "indices"):
            raise SpecError(f"block {name} needs {where}")
        given = ()
    elif isinstance(given, (str, int)) and not isinstance(given, bool):
        given = (given,)
    elif not isinstance(given, Sequence) or not given:
        raise SpecError(f"block {name}: {where} must name predictors")
    base = Block(name, model, tuple(given), flag(spec.get("standardize", True), f"block {name}: standardize"))
    has = lambda *keys: [k for k in keys if spec.get(k) is not None]
    if model == "Fixed":
        return base
    pve = share(spec["expected_pve"], f"block {name}: expected_pve") if has("expected_pve") else None
    if model == "GlobalLocal":
        return _global_local(base, spec, has, pve)
    out = replace(base, expected_pve=pve)
    if has("var"):
        if has("var_shape", "var_scale", "expected_pve"):
            raise SpecError(f"block {name}: var excludes var_shape, var_scale and expected_pve")
        out = replace(out, var=positive(spec["var"], f"block {name}: var"))
    else:
        if len(has("var_scale", "expected_pve")) == 2:
            raise SpecError(f"block {name}: var_scale excludes expected_pve")
        shape = positive(spec.get("var_shape", DEFAULT_SHAPE), f"block {name}: var_shape")
        if pve is not None and shape <= 1:
            raise SpecError(f"block {name}: expected_pve needs var_shape above 1")
        scale = None if pve is not None else positive(spec.get("var_scale", DEFAULT_SCALE), f"block {name}: var_scale")
        out = replace(out, shape=shape, scale=scale)
    if model == "SpikeSlab":
        out = replace(out, pi=pair(spec.get("pi", DEFAULT_PI), f"block {name}: pi"))
    elif model == "SpikeMultiSlab":
        gamma = many(spec.get("gamma", DEFAULT_GAMMA), f"block {name}: gamma")
        if len(gamma) < 2 or gamma[0] != 0 or any(b <= a for a, b in zip(gamma, gamma[1:], strict=False)):
            raise SpecError(f"block {name}: gamma must begin with 0 and increase")
        alpha = many(spec.get("alpha", (1.0,) * len(gamma)), f"block {name}: alpha")
        if len(alpha) != len(gamma) or min(alpha) <= 0:
            raise SpecError(f"block {name}: alpha must be positive, one for each gamma")
        out = replace(out, gamma=gamma, alpha=alpha)
    return out


def _global_local(base: Block, spec, has, pve) -> Block:
    name = base.name
    out = replace(base, local_shape=pair(spec.get("local_shape", DEFAULT_LOCAL), f"block {name}: local_shape"), expected_pve=pve)
    if has("global_var"):
        if has("global_scale", "expected_nonzero", "reference_residual_var", "expected_pve"):
            raise SpecError(f"block {name}: global_var excludes the other global fields")
        return replace(out, global_var=positive(spec["global_var"], f"block {name}: global_var"))
    if has("global_scale"):
        if has("expected_nonzero", "reference_residual_var", "expected_pve"):
            raise SpecError(f"block {name}: global_scale excludes expected_nonzero, reference_residual_var and expected_pve")
        return replace(out, global_scale=positive(spec["global_scale"], f"block {name}: global_scale"))
    if has("expected_nonzero"):
        if len(has("reference_residual_var", "expected_pve")) != 1:
            raise SpecError(f"block {name}: expected_nonzero needs reference_residual_var or expected_pve")
        ref = positive(spec["reference_residual_var"], f"block {name}: reference_residual_var") if has("reference_residual_var") else None
        return replace(out, expected_nonzero=positive(spec["expected_nonzero"], f"block {name}: expected_nonzero"), reference_residual_var=ref)
    if has("reference_residual_var", "expected_pve"):
        raise SpecError(f"block {name}: reference_residual_var and expected_pve need expected_nonzero")
    return replace(out, global_scale=1.0)


def sparsity_scale(expected_nonzero: float, p: int, residual_var: float, n: int) -> float:
    """The global scale at which about ``expected_nonzero`` of ``p`` coefficients escape shrinkage."""
    if expected_nonzero >= p:
        raise SpecError("expected_nonzero must be below the number of predictors")
    return expected_nonzero / (p - expected_nonzero) * math.sqrt(residual_var / n)


def calibrate(blocks: Sequence[Block], spread: Mapping[str, float], sizes: Mapping[str, int], response_var: float | None, n: int) -> list[Block]:
    """Work out the scales that ``expected_pve`` or ``expected_nonzero`` leave open.

    ``spread`` is each block's sum of predictor variances on the working scale,
    over the likelihood's dimension.
    """
    total = sum(b.expected_pve or 0 for b in blocks)
    if total >= 1:
        raise SpecError("expected_pve of all blocks must add up to less than 1")
    if any(b.expected_pve for b in blocks) and response_var is None:
        raise SpecError("expected_pve needs the response's variance")
    out = []
    for b in blocks:
        if b.model == "GlobalLocal" and b.expected_nonzero is not None:
            if b.expected_pve is not None:
                if any(o.penalized and o.expected_pve is None for o in blocks):
                    raise SpecError(f"block {b.name}: all penalized blocks need expected_pve")
                ref = (1 - total) * response_var
            else:
                ref = b.reference_residual_var
            b = replace(b, global_scale=sparsity_scale(b.expected_nonzero, sizes[b.name], ref, n))
        elif b.expected_pve is not None:
            d = spread[b.name]
            if b.model == "SpikeSlab":
                d *= b.pi[0] / sum(b.pi)
            elif b.model == "SpikeMultiSlab":
                d *= sum(a * g for a, g in zip(b.alpha, b.gamma, strict=True)) / sum(b.alpha)
            b = replace(b, scale=(b.shape - 1) * b.expected_pve * response_var / d)
        out.append(b)
    return out


@dataclass(frozen=True)
class Residual:
    """A fixed variance, or an inverse-gamma prior."""

    var: float | None = None
    shape: float | None = None
    scale: float | None = None


def residual_prior(blocks: Sequence[Block], var: Any = None, shape: Any = None, scale: Any = None, response_var: float | None = None) -> Residual:
    if var is not None:
        if shape is not None or scale is not None:
            raise SpecError("residual_var excludes residual_shape and residual_scale")
        return Residual(var=positive(var, "residual_var"))
    if shape is None:
        raise SpecError("give residual_var or residual_shape")
    shape = positive(shape, "residual_shape")
    if scale is not None:
        return Residual(shape=shape, scale=positive(scale, "residual_scale"))
    if any(b.expected_pve is None for b in blocks):
        raise SpecError("residual_scale may be left out only if every block has expected_pve")
    if shape <= 1:
        raise SpecError("a calibrated residual_scale needs residual_shape above 1")
    return Residual(shape=shape, scale=(shape - 1) * (1 - sum(b.expected_pve for b in blocks)) * response_var)


# -- controls ---------------------------------------------------------------

@dataclass(frozen=True)
class Controls:
    iterations: int = 4000
    burnin: int = 1000
    thin: int = 1
    chains: int = 1
    seed: int = 1
    store: str = "draws"  # or "moments"
    coefficient_cov: bool = False
    pve: bool = False
    pve_type: str = "standalone"
    joint: bool = False
    verbose: bool = field(default=False, compare=False)

    def __post_init__(self):
        whole(self.iterations, "iterations", 1)
        whole(self.burnin, "burnin", 0)
        whole(self.thin, "thin", 1)
        whole(self.chains, "chains", 1)
        whole(self.seed, "seed", 0)
        for name in ("coefficient_cov", "pve", "joint", "verbose"):
            flag(getattr(self, name), name)
        if self.store not in ("draws", "moments"):
            raise SpecError("store must be draws or moments")
        if self.pve_type not in ("standalone", "allocated"):
            raise SpecError("pve_type must be standalone or allocated")
        if len(self.kept()) < 2:
            raise SpecError("fewer than two draws are kept")

    def kept(self) -> range:
        """Iterations, counted from 1, whose draws are kept."""
        return range(self.burnin + 1, self.iterations + 1, self.thin)


def likelihood_df(given: Any, n: int, intercept: bool) -> int:
    return n - int(intercept) if given is None else whole(given, "likelihood_df", 1, n)
