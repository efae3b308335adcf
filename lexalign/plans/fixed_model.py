"""The fixed model of FIXTURES.md (products are SQL-expressible, so mappings can be checked).

``U_s`` is the reversal permutation, ``U_t`` the identity, ``U_m`` the
half-rotation permutation and ``B = diag(1 + (k mod 4))`` for ``k = 1..d``.
"""

from __future__ import annotations

import numpy as np

from lexalign.operators.fit import Model


def fixed_model(d: int) -> Model:
    rev = np.eye(d)[::-1].copy()                 # (x·U_s)_j = x_{d-1-j}
    ident = np.eye(d)
    h = d // 2
    rot = np.zeros((d, d))                       # (x·U_m)_j = x_{(j+h) mod d}
    for j in range(d):
        rot[(j + h) % d, j] = 1.0
    b = np.diag([1.0 + (k % 4) for k in range(1, d + 1)])
    return Model({"s": rev, "t": ident, "m": rot}, b, {"fixed": True})
