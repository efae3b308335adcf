"""Fitting the latent-space model from gram statistics (driver-side ``d x d`` algebra).

The objective of the bilingual fit is

    ½λ‖B‖² + tr(Wᵀ XᵀX W ZᵀZ) − 2⟨W, XᵀAZ⟩,   W = U₁ B U₂ᵀ,

with orthonormal ``U₁ (d_x x r)``, ``U₂ (d_z x r)`` and SPD ``B``.  With
``r = d_x`` every full-row-rank ``W`` is reachable and ``‖B‖ = ‖W‖``, so the
problem is a ridge regression in ``W`` with the closed form (eigenbases
``XᵀX = P diag(a) Pᵀ``, ``ZᵀZ = Q diag(b) Qᵀ``)

    W = P [ (Pᵀ C Q)_ij / (a_i b_j + λ/2) ] Qᵀ.

``B`` and the ``U``s follow from a thin SVD of ``W``.  Only the three grams
(``d x d``, computed on Spark) are inputs; no vector reaches the driver.
The multilingual fit (shared ``B``) has no closed form and is solved by
Riemannian gradient descent on the same grams (``multi_fit``).
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Model:
    """Per-language maps ``U`` (``d x r``) and the shared SPD ``B`` (``r x r``)."""

    U: dict[str, np.ndarray]
    B: np.ndarray
    info: dict = field(default_factory=dict)

    def latent_map(self, lang: str) -> np.ndarray:
        """``U_lang · B^{1/2}``: maps raw vectors into the shared space."""
        return self.U[lang] @ psd_sqrt(self.B)

    def cross_map(self, src: str, trg: str) -> np.ndarray:
        """``U_src · B · U_trgᵀ``: maps source vectors into the target space."""
        return self.U[src] @ self.B @ self.U[trg].T


def psd_sqrt(b: np.ndarray) -> np.ndarray:
    """Square root of a symmetric PSD matrix via ``eigh`` (negative round-off clipped)."""
    s = (b + b.T) / 2.0
    w, v = np.linalg.eigh(s)
    return (v * np.sqrt(np.clip(w, 0.0, None))) @ v.T


def ridge_w(sxx: np.ndarray, szz: np.ndarray, c: np.ndarray, reg: float) -> np.ndarray:
    """Minimiser of ``tr(WᵀSxxWSzz) − 2⟨W,C⟩ + reg·‖W‖²`` (``reg = λ/2``)."""
    return RidgePath(sxx, szz, c).solve(reg)


class RidgePath:
    """Closed forms for many ``reg`` from one pair of eigendecompositions."""

    def __init__(self, sxx: np.ndarray, szz: np.ndarray, c: np.ndarray):
        self.sxx, self.szz, self.c = sxx, szz, c
        a, self.p = np.linalg.eigh((sxx + sxx.T) / 2.0)
        b, self.q = np.linalg.eigh((szz + szz.T) / 2.0)
        self.weights = np.outer(np.clip(a, 0.0, None), np.clip(b, 0.0, None))
        self.inner = self.p.T @ c @ self.q

    def solve(self, reg: float, rank: int | None = None, max_iter: int = 500, tol: float = 1e-12) -> np.ndarray:
        """The best ``W``, or the best found of ``rank``.

        In the eigenbases the cost is the sum of ``(a_i b_j + reg)(W_ij − M_ij)²``, so a
        limited rank is a weighted low-rank problem. ``W = L Rᵀ`` starts from the
        truncation of the full solution, and ``L`` and ``R`` are solved exactly in turns, row by row, which
        lowers the cost each time, until it stays.
        """
        weights = self.weights + reg
        full = self.inner / weights
        if rank is None or rank >= min(full.shape):
            return self.p @ full @ self.q.T
        u, s, vt = np.linalg.svd(full, full_matrices=False)
        left, right = u[:, :rank] * np.sqrt(s[:rank]), vt[:rank].T * np.sqrt(s[:rank])
        cost = np.inf
        for _ in range(max_iter):
            left = _rows(right, weights, full)
            right = _rows(left, weights.T, full.T)
            now = float(np.sum(weights * (left @ right.T - full) ** 2))
            if cost - now <= tol * max(1.0, now):
                break
            cost = now
        return self.p @ (left @ right.T) @ self.q.T

    def objective(self, w: np.ndarray, lam: float) -> float:
        return objective(self.sxx, self.szz, self.c, w, lam)

    def residual(self, w: np.ndarray, lam: float) -> float:
        return float(np.abs(residual(self.sxx, self.szz, self.c, w, lam)).max(initial=0.0))


def _rows(fixed: np.ndarray, weights: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Rows ``l_i`` that minimise ``Σ_j weights_ij (l_i · fixed_j − goal_ij)²``."""
    normal = np.einsum("ij,jk,jl->ikl", weights, fixed, fixed, optimize=True)
    normal += 1e-12 * np.trace(normal, axis1=1, axis2=2)[:, None, None] * np.eye(fixed.shape[1])
    return np.linalg.solve(normal, ((weights * goal) @ fixed)[:, :, None])[:, :, 0]


def factor(w: np.ndarray, rank: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin SVD ``W = U₁ diag(s) U₂ᵀ`` truncated to ``rank``."""
    u, s, vt = np.linalg.svd(w, full_matrices=False)
    r = len(s) if rank is None else min(rank, len(s))
    return u[:, :r], s[:r], vt[:r].T


def bilingual_fit(sxx: np.ndarray, szz: np.ndarray, c: np.ndarray, lam: float,
                  src: str = "src", trg: str = "trg", n_pairs: float | None = None, rank: int | None = None) -> Model:
    """Closed-form bilingual fit.

    ``n_pairs=None``: gram-form objective (binary edges, ``reg = λ/2``).
    ``n_pairs=n``: self-training objective divided by ``n`` (``reg = nλ/2``).
    ``rank`` limits the rank of the maps (alternating exact steps, see ``RidgePath.solve``).
    """
    reg = lam / 2.0 if n_pairs is None else n_pairs * lam / 2.0
    w = RidgePath(sxx, szz, c).solve(reg, rank)
    u1, s, u2 = factor(w, rank)
    info = {"cost": objective(sxx, szz, c, w, lam, n_pairs), "lambda": lam}
    return Model({src: u1, trg: u2}, np.diag(s), info)


def residual(sxx, szz, c, w, lam, n_pairs=None) -> np.ndarray:
    """``Sxx W Szz + reg W - C`` over the largest entry of ``C``: zero where the convex objective is least."""
    reg = lam / 2.0 if n_pairs is None else n_pairs * lam / 2.0
    return (sxx @ w @ szz + reg * w - c) / max(1e-300, float(np.abs(c).max(initial=0.0)))


def objective(sxx, szz, c, w, lam, n_pairs=None) -> float:
    data = float(np.trace(w.T @ sxx @ w @ szz) - 2.0 * np.sum(w * c))
    if n_pairs:
        return data / n_pairs + 0.5 * lam * float(np.sum(w * w))
    return data + 0.5 * lam * float(np.sum(w * w))


def multi_objective(model: Model, pairs: list[dict], lam: float) -> float:
    cost = 0.5 * lam * float(np.sum(model.B * model.B))
    for p in pairs:
        w = model.U[p["src"]] @ model.B @ model.U[p["trg"]].T
        cost += (float(np.trace(w.T @ p["sxx"] @ w @ p["szz"])) - 2.0 * float(np.sum(w * p["c"]))
                 + p.get("a2", 0.0)) / p["n"]
    return cost


def _sym(m):
    return (m + m.T) / 2.0


def _retract_stiefel(u, step):
    q, r = np.linalg.qr(u + step)
    return q * np.sign(np.sign(np.diag(r)) + 0.5)


def _retract_spd(b, step):
    # affine-invariant exponential map
    s = psd_sqrt(b)
    w, v = np.linalg.eigh(b)
    inv_s = (v / np.sqrt(np.clip(w, 1e-300, None))) @ v.T
    m = _sym(inv_s @ step @ inv_s)
    ew, ev = np.linalg.eigh(m)
    return _sym(s @ ((ev * np.exp(ew)) @ ev.T) @ s)


def _gradients(model: Model, pairs: list[dict], lam: float):
    gU = {k: np.zeros_like(v) for k, v in model.U.items()}
    gB = lam * model.B
    for p in pairs:
        ui, uj, b = model.U[p["src"]], model.U[p["trg"]], model.B
        w = ui @ b @ uj.T
        g = (2.0 * p["sxx"] @ w @ p["szz"] - 2.0 * p["c"]) / p["n"]
        gU[p["src"]] += g @ uj @ b
        gU[p["trg"]] += g.T @ ui @ b
        gB = gB + ui.T @ g @ uj
    return gU, _sym(gB)


def multi_fit(pairs: list[dict], lam: float, init: Model, max_iter: int = 500, tol: float = 1e-10,
              gtol: float = 1e-3, max_seconds: float | None = None, flip_iter: int = 20) -> Model:
    """Shared-``B`` multilingual fit by Riemannian gradient descent with backtracking.

    ``pairs``: dicts with ``src``, ``trg`` (language names), ``sxx``, ``szz``,
    ``c`` (grams) and ``n`` (in-vocabulary pairs incl. duplicates).  The start
    point should come from pairwise closed forms (``init_from_pairs``).  It ends when
    the gradient norm is at most ``gtol`` times the cost (or one), or a step gains less
    than ``tol``, or after ``max_iter`` steps or ``max_seconds``; ``info`` holds the norm, the start cost and
    whether the norm was reached (``converged``).

    Square maps have a determinant of plus or minus one, and no descent crosses
    between the two.  So each language but the first is tried with the other sign
    for ``flip_iter`` steps, and goes on from there if that costs less.
    """
    limits = {"tol": tol, "gtol": gtol, "max_seconds": max_seconds}
    model = _descend(pairs, lam, init, max_iter, **limits)
    for lang in list(model.U)[1:]:
        u = model.U[lang]
        if flip_iter and u.shape[0] == u.shape[1]:
            flipped = Model({**model.U, lang: u * np.r_[np.ones(u.shape[1] - 1), -1.0]}, model.B, model.info)
            other = _descend(pairs, lam, flipped, flip_iter, **limits)
            if other.info["cost"] < model.info["cost"]:
                model = _descend(pairs, lam, other, max_iter, **limits)
    model.info["start_cost"] = multi_objective(init, pairs, lam)
    return model


def _descend(pairs: list[dict], lam: float, init: Model, max_iter: int, tol: float, gtol: float,
             max_seconds: float | None) -> Model:
    model = Model({k: v.copy() for k, v in init.U.items()}, init.B.copy(), dict(init.info))
    cost = multi_objective(model, pairs, lam)
    step = 1.0
    it = 0
    began = time.monotonic()
    for it in range(max_iter):
        if max_seconds is not None and time.monotonic() - began > max_seconds:
            break
        gU, gB = _gradients(model, pairs, lam)
        # Riemannian gradients: Stiefel tangent projection, SPD metric B·G·B
        rU = {k: g - model.U[k] @ _sym(model.U[k].T @ g) for k, g in gU.items()}
        rB = model.B @ gB @ model.B
        gnorm2 = sum(float(np.sum(g * g)) for g in rU.values()) + float(np.sum(gB * rB))
        if math.sqrt(max(0.0, gnorm2)) <= gtol * max(1.0, abs(cost)):
            break
        while True:
            cand = Model({k: _retract_stiefel(model.U[k], -step * rU[k]) for k in model.U},
                         _retract_spd(model.B, -step * rB), model.info)
            c2 = multi_objective(cand, pairs, lam)
            if c2 <= cost - 1e-4 * step * gnorm2 or step < 1e-12:
                break
            step *= 0.5
        if c2 > cost:
            break
        improvement = cost - c2
        model, cost = cand, c2
        step *= 2.0
        if improvement < tol * max(1.0, abs(cost)):
            break
    gU, gB = _gradients(model, pairs, lam)
    rU = {k: g - model.U[k] @ _sym(model.U[k].T @ g) for k, g in gU.items()}
    gnorm = math.sqrt(sum(float(np.sum(g * g)) for g in rU.values()) + float(np.sum(gB * (model.B @ gB @ model.B))))
    model.info = {**model.info, "cost": cost, "iterations": it + 1, "lambda": lam,
                  "gradient_norm": gnorm, "converged": gnorm <= gtol * max(1.0, abs(cost))}
    return model


def init_from_pairs(pairs: list[dict], langs: list[str], lam: float) -> Model:
    """Start point: closed form of the first pair, other languages chained along the pairs."""
    first = pairs[0]
    m0 = bilingual_fit(first["sxx"], first["szz"], first["c"], lam * first["n"],
                       first["src"], first["trg"])
    U = dict(m0.U)
    B = m0.B + 1e-6 * np.eye(m0.B.shape[0])
    sqrt_b = psd_sqrt(B)
    changed = True
    while changed:
        changed = False
        for p in pairs:
            for known, new, sk, sn, c in ((p["src"], p["trg"], p["sxx"], p["szz"], p["c"]),
                                          (p["trg"], p["src"], p["szz"], p["sxx"], p["c"].T)):
                if known in U and new not in U:
                    # Procrustes: U_new ≈ argmax <C_newᵀ-ish, ·> on the Stiefel manifold
                    m = c.T @ U[known] @ sqrt_b
                    u, _, vt = np.linalg.svd(m, full_matrices=False)
                    U[new] = u @ vt
                    changed = True
    for lang in langs:
        if lang not in U:
            raise ValueError(f"language {lang!r} is not connected to the training pairs")
    return Model(U, B, {})
