"""Eigen representations of cross-products: decomposition, projection, scaled factors."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.quality import DataError
from .gram import ROOT_EPS

BLOCK_SCHEMA = "block string, p int, q int, vectors array<double>, values array<double>"


def decompose(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, values), values descending and unfiltered; negative ones are warned of."""
    values, vectors = np.linalg.eigh(np.asarray(gram, float))
    values, vectors = values[::-1], vectors[:, ::-1]
    if len(values) and values.min() < -ROOT_EPS * max(1.0, abs(values).max()):
        warnings.warn("cross-products have negative eigenvalues", stacklevel=2)
    return vectors, values


def decompose_blocks(triplets: DataFrame) -> DataFrame:
    """Eigenpairs of each block of ``(block, i, j, v)`` (one triangle, places within the block), a task for each block."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(max(pdf.i.max(), pdf.j.max())) + 1
        g = np.zeros((p, p))
        g[pdf.i, pdf.j] = g[pdf.j, pdf.i] = pdf.v
        u, lam = decompose(g)
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "p": [p], "q": [len(lam)], "vectors": [u.ravel(order="F").tolist()], "values": [lam.tolist()]})

    return triplets.groupBy("block").applyInPandas(one, BLOCK_SCHEMA)


def check_sets(vectors, values, prop_var, orthonormal: bool = False) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """A list of (vectors, values, share of variance kept); a single set or share is taken for all.

    Mappings are aligned by the names of the vectors' blocks.
    """
    if isinstance(vectors, Mapping):
        if not isinstance(values, Mapping) or set(values) != set(vectors) or isinstance(prop_var, Mapping) and set(prop_var) != set(vectors):
            raise DataError("vectors, values and shares name different blocks")
        values = [values[k] for k in vectors]
        prop_var = [prop_var[k] for k in vectors] if isinstance(prop_var, Mapping) else prop_var
        vectors = list(vectors.values())
    many = isinstance(vectors, (list, tuple))
    us, ls = (list(vectors), list(values)) if many else ([vectors], [values])
    props = list(prop_var) if isinstance(prop_var, (list, tuple, np.ndarray)) else [prop_var] * len(us)
    if not len(us) == len(ls) == len(props):
        raise DataError("each block needs vectors, values and a share")
    out = []
    for u, lam, prop in zip(us, ls, props, strict=True):
        u, lam = np.asarray(u, float), np.asarray(lam, float).reshape(-1)
        if u.ndim != 2 or u.shape[1] != len(lam) or u.shape[1] > u.shape[0] or not len(lam) or not np.isfinite(u).all():
            raise DataError("vectors are p x q with q values, q at most p")
        if not np.isfinite(lam).all() or (lam <= 0).any():
            raise DataError("eigenvalues must be positive")
        if not 0 < prop <= 1:
            raise DataError("the share of variance lies above 0 and up to 1")
        if orthonormal and abs(u.T @ u - np.eye(len(lam))).max() > ROOT_EPS * max(1, len(u)):
            raise DataError("eigenvectors are not orthonormal")
        out.append((u, lam, float(prop)))
    return out


@dataclass
class Projection:
    target: np.ndarray  # values**-1/2 U'g
    inside: np.ndarray  # U U'g
    diag: np.ndarray  # diagonal of U values U'


def project(u: np.ndarray, lam: np.ndarray, g: np.ndarray, prop: float) -> Projection:
    """What of the cross-products with the response the eigenpairs can hold; all of it if nothing was cut off."""
    w = u.T @ g
    inside = u @ w
    if prop == 1 and abs(g - inside).max(initial=0) > ROOT_EPS * max(1.0, abs(g).max(initial=0)):
        raise DataError("xty lies outside the eigenvectors' space")
    return Projection(w / np.sqrt(lam), inside, (u**2) @ lam)


def factor(u: np.ndarray, lam: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """values**1/2 U' over the predictors' scales: q x p."""
    return np.sqrt(lam)[:, None] * u.T / scale


def overall_share(traces: Sequence[tuple[float, float]]) -> float:
    """The share of variance kept over all blocks, from each block's trace and share."""
    return sum(t for t, _ in traces) / sum(t / s for t, s in traces)
