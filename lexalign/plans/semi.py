"""Self-training (bootstrap) job.

Each round fits the self-training objective (pairs counted with multiplicity,
``reg = nλ/2``) on the seed pairs plus the pairs induced in the previous
round, scores precision@1 on the validation part, and induces a new
dictionary by bidirectional CSLS.  After ``patience`` rounds without a better
validation score the loop stops; it ends by itself, as there are only so many
scores.  The final model is fitted on the pairs that trained the best round plus
the full training dictionary, and only that model is scored on the test part.

The grams of a round are those of the round before plus what the pairs that came and went add
(``gram.PairGrams``). The neighbourhoods of a round's spaces are computed once, for validation and
induction.  Every induced dictionary is a written table, so each round starts
from a short lineage and survives lost executors; caches are released.

With ``state_path`` the loop's state is a table there: a row a finished round with its metrics and the places
of its pairs and grams. A job that is started again with the same path goes on behind the last finished round.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexalign.operators import dictionary as D
from lexalign.operators import normalize as N
from lexalign.operators import retrieval as R
from lexalign.operators.fit import Model, bilingual_fit, residual
from lexalign.operators.gram import PairGrams
from lexalign.operators.induce import induce_dictionary
from lexalign.plans import bilingual as BL
from lexalign.session import materialise
from lexalign.sources.sinks import children

SCHEMA = ("round int, phase string, n_pairs bigint, residual double, val_acc1 double, test_acc1 double, "
          "test_acc5 double, test_acc10 double")


def union_pairs(seed: DataFrame, induced: DataFrame) -> DataFrame:
    """Training pairs of a round: the seed's and the induced ones of both directions, repeated pairs kept."""
    return seed.select("src_idx", "trg_idx").unionByName(induced.select("src_idx", "trg_idx"))


def fit_grams(grams: PairGrams, lam: float, rank: int | None = None) -> Model:
    """The self-training fit from grams that are up to date."""
    dx, dz = BL._dim(grams.x), BL._dim(grams.z)
    m = {k: grams.matrices.get(k, np.zeros(0)) for k in ("sxx", "szz", "c")}
    sxx, szz, c = (m[k] if m[k].size else np.zeros(s) for k, s in (("sxx", (dx, dx)), ("szz", (dz, dz)), ("c", (dx, dz))))
    n = max(1, grams.n_pairs)
    model = bilingual_fit(sxx, szz, c, lam, n_pairs=n, rank=rank)
    model.info |= {"n_pairs": grams.n_pairs, "residual": residual(sxx, szz, c, model.cross_map("src", "trg"), lam, n)}
    return model


class _State:
    """Finished rounds in a folder, or nowhere."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path

    def last(self) -> dict | None:
        if not self.path:
            return None
        try:
            names = [n for n in children(self.spark, self.path) if n.startswith("round-")]
        except Exception:               # no folder: nothing was finished
            return None
        for name in sorted(names, reverse=True):
            entries = children(self.spark, f"{self.path}/{name}")
            if "done" in entries and "_SUCCESS" in children(self.spark, entries["done"]):
                return json.loads(self.spark.read.text(entries["done"]).first()[0])
        return None

    def pairs(self, name: str, pairs: DataFrame) -> DataFrame:
        if not self.path:
            return materialise(pairs, name)
        pairs.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def finish(self, n: int, state: dict, grams: PairGrams) -> None:
        """The marker is written last, so a round that was interrupted is not found."""
        if not self.path:
            return
        rows = [(k, i, [float(x) for x in r]) for k, m in grams.matrices.items() for i, r in enumerate(m)]
        self.spark.createDataFrame(rows, "name string, i int, vec array<double>").write.mode("overwrite").parquet(f"{self.path}/grams-{n:04d}")
        self.pairs(f"weights-{n:04d}", grams.pairs)
        line = self.spark.createDataFrame([(json.dumps(state | {"n_pairs": int(grams.n_pairs)}),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/round-{n:04d}/done")

    def grams(self, n: int, x: DataFrame, z: DataFrame, n_pairs: int) -> PairGrams:
        held: dict[str, dict[int, list]] = {}
        for r in self.read(f"grams-{n:04d}").collect():         # d x d numbers
            held.setdefault(r["name"], {})[r["i"]] = r["vec"]
        matrices = {k: np.array([v[i] for i in sorted(v)]) for k, v in held.items()}
        return PairGrams(x, z, matrices, self.read(f"weights-{n:04d}"), n_pairs)


def bootstrap(x: DataFrame, z: DataFrame, full: DataFrame, seed: DataFrame, val: DataFrame, test: DataFrame,
              lam: float = 0.01, normalize=("unit", "center"), x_cutoff: int | None = None,
              z_cutoff: int | None = None, patience: int = 1, csls_k: int = 10, rank: int | None = None,
              state_path: str | None = None, after_round: Callable[[int], None] | None = None) -> DataFrame:
    """Per-round metrics ``(round, phase, n_pairs, residual, val_acc1, test_acc1, test_acc5, test_acc10)``.

    ``seed`` is the part of the ``full`` training dictionary that the rounds start
    from; cut-offs default to the whole vocabularies.  ``phase`` is ``round`` (test
    scores null) or ``final``; ``residual`` is the largest entry of the fit's residual. ``after_round`` is called with the
    number of every round that was finished.
    """
    if patience < 1:
        raise ValueError("patience must be 1 at least")
    spark = x.sparkSession
    xn = N.normalize(x, normalize).persist(StorageLevel.MEMORY_AND_DISK)
    zn = N.normalize(z, normalize).persist(StorageLevel.MEMORY_AND_DISK)
    held = [xn, zn]
    try:
        state = _State(spark, state_path)
        start = materialise(D.encode(seed, x, z).select("src_idx", "trg_idx"), "seed")
        now = state.last()
        if now is None:
            now = {"rows": [], "best_acc": 0.0, "best": None, "bad": 0, "next": None}
            grams = PairGrams(xn, zn)
        else:
            grams = state.grams(len(now["rows"]) - 1, xn, zn, now["n_pairs"])
        rows = [tuple(r) for r in now["rows"]]
        tables = {name: state.read(name) for name in {now["best"], now["next"]} - {None}} if state_path else {}
        while now["bad"] < patience:
            n = len(rows)
            added = tables[now["next"]] if now["next"] else start.limit(0)
            grams.update(union_pairs(start, added))
            model, xw, zw = _spaces(xn, zn, grams, lam, rank)
            held += [xw, zw]
            r_x, r_z = R.neighbourhood(xw, zw, csls_k)
            v = BL.evaluate(xw, zw, val, x, z, "csls", csls_k, r_z=r_z).first()["acc1"] or 0.0
            rows.append((n, "round", int(grams.n_pairs), _worst(model), float(v), None, None, None))
            bad = now["bad"] + 1
            now = {**now, "rows": rows, "bad": bad}
            if v > now["best_acc"]:
                now |= {"best_acc": float(v), "best": now["next"], "bad": 0}
            if now["bad"] < patience:
                whole = x_cutoff is None and z_cutoff is None
                found = induce_dictionary(xw, zw, x_cutoff, z_cutoff, csls_k, **({"r_x": r_x, "r_z": r_z} if whole else {}))
                now["next"] = f"induced-{n:04d}"
                tables[now["next"]] = state.pairs(now["next"], found.select("src_idx", "trg_idx"))
            state.finish(n, now, grams)
            for df in (xw, zw):
                df.unpersist()
            if after_round:
                after_round(n)
        best = tables[now["best"]] if now["best"] else start.limit(0)
        grams.update(union_pairs(best, D.encode(full, x, z)))
        model, xw, zw = _spaces(xn, zn, grams, lam, rank)
        held += [xw, zw]
        r_z = materialise(R.nbr_mean(zw, xw, csls_k), "neighbourhoods")
        v = BL.evaluate(xw, zw, val, x, z, "csls", csls_k, r_z=r_z).first()
        t = BL.evaluate(xw, zw, test, x, z, "csls", csls_k, r_z=r_z).first()
        rows.append((len(rows), "final", int(grams.n_pairs), _worst(model), v["acc1"], t["acc1"], t["acc5"], t["acc10"]))
    finally:
        for df in held:
            df.unpersist()
    return spark.createDataFrame(rows, SCHEMA)


def _spaces(xn: DataFrame, zn: DataFrame, grams: PairGrams, lam: float, rank: int | None = None):
    model = fit_grams(grams, lam, rank)
    xw, zw = BL.mapped(BL.Fitted(model, xn, zn))
    return model, xw.persist(StorageLevel.MEMORY_AND_DISK), zw.persist(StorageLevel.MEMORY_AND_DISK)


def _worst(model) -> float:
    return float(abs(model.info["residual"]).max(initial=0.0))
