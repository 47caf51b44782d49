"""Chains as Spark tasks: one for each chain and component, a row for each kept draw."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Online, OnlineCov, Problem, chain
from .spec import Controls

DRAWS = (
    "chain int, part int, draw int, residual_var double, idx array<int>, theta array<double>, inclusion array<boolean>, mix_component array<int>, local_var array<double>, "
    "hyper map<string,double>, own array<double>, along array<double>, signal double, x_part double, noise double"
)
MOMENTS = "chain int, param string, idx int, n long, mean double, m2 double"
COVARIANCES = "chain int, block int, i int, j int, n long, mean_i double, mean_j double, c2 double"
#: What a chain that keeps moments gives: a row for each moment or covariance, and of each draw what concerns the whole model.
RUNNING = (
    "chain int, part int, kind string, param string, idx int, j int, block int, n long, mean double, mean_j double, m2 double, "
    "draw int, residual_var double, own array<double>, along array<double>, signal double, x_part double, noise double"
)
_ARROW = pa.schema([
    ("chain", pa.int32()), ("part", pa.int32()), ("draw", pa.int32()), ("residual_var", pa.float64()), ("idx", pa.list_(pa.int32())), ("theta", pa.list_(pa.float64())),
    ("inclusion", pa.list_(pa.bool_())), ("mix_component", pa.list_(pa.int32())), ("local_var", pa.list_(pa.float64())), ("hyper", pa.map_(pa.string(), pa.float64())),
    ("own", pa.list_(pa.float64())), ("along", pa.list_(pa.float64())), ("signal", pa.float64()), ("x_part", pa.float64()), ("noise", pa.float64()),
])


def generator(seed: int, number: int, part: int) -> np.random.Generator:
    """A stream of its own for each chain and component, whatever runs where."""
    return np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(number, part)))


def draw_rows(problem: Problem, controls: Controls, number: int, part: int, noise: Callable | None = None):
    """Arrow batches of one chain's draws."""
    rows: list[dict] = []
    spike, multi, local = ([problem.blocks[b].model in kinds for b in problem.block_of] for kinds in (("SpikeSlab", "SpikeMultiSlab"), ("SpikeMultiSlab",), ("GlobalLocal",)))
    only = lambda x, where: [v if w else None for v, w in zip(x.tolist(), where, strict=True)] if any(where) else None
    for d in chain(problem, controls, generator(controls.seed, number, part), noise):
        rows.append({
            "chain": number, "part": part, "draw": d["draw"], "residual_var": d["residual_var"], "idx": problem.index, "theta": d["theta"], "inclusion": only(d["included"], spike),
            "mix_component": only(d["component"], multi), "local_var": only(d["local_var"], local), "hyper": list(d["hyper"].items()),
            "own": d["own"], "along": d["along"], "signal": d["signal"], "x_part": d["x_part"], "noise": d["noise"],
        })
        if len(rows) == 256:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
_RUNNING = pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in RUNNING.split(", "))])


def running_rows(problem: Problem, controls: Controls, number: int, part: int, noise: Callable | None = None):
    """Arrow batches of one chain reduced to running moments, with what each draw says of the whole model.

    Moments: theta, inclusion (of predictors with a spike), component_k (of
    mixtures), local_var (of global-local blocks), and hyper-parameters.
    """
    k = len(problem.index)
    members = [np.flatnonzero(problem.block_of == b) for b in range(len(problem.blocks))]
    of = lambda *models: np.flatnonzero(np.isin(problem.block_of, [b for b, x in enumerate(problem.blocks) if x.model in models]))
    spike, local, multi = of("SpikeSlab", "SpikeMultiSlab"), of("GlobalLocal"), [(m, len(b.gamma)) for m, b in zip(members, problem.blocks, strict=True) if b.model == "SpikeMultiSlab"]
    names = [("theta", i) for i in range(k)] + [("inclusion", i) for i in spike] + [(f"component_{c}", i) for m, n in multi for c in range(n) for i in m] + [("local_var", i) for i in local]
    online, cov, hyper, rows = Online(), [OnlineCov() for _ in members] if controls.coefficient_cov else [], [], []
    blank = dict.fromkeys(_RUNNING.names) | {"chain": number, "part": part}
    for d in chain(problem, controls, generator(controls.seed, number, part), noise):
        hyper = hyper or list(d["hyper"])
        online.add(np.concatenate([d["theta"], d["included"][spike], *((d["component"][m] == c).astype(float) for m, n in multi for c in range(n)), d["local_var"][local], list(d["hyper"].values())]))
        for c, m in zip(cov, members, strict=False):
            c.add(d["theta"][m])
        rows.append(blank | {"kind": "draw", **{x: d[x] for x in ("draw", "residual_var", "own", "along", "signal", "x_part", "noise")}})
        if len(rows) == 256:
            yield pa.RecordBatch.from_pylist(rows, _RUNNING)
            rows = []
    for (name, i), mean, m2 in zip([(n, int(problem.index[i])) for n, i in names] + [(h, -1) for h in hyper], online.mean.tolist(), online.m2.tolist(), strict=True):
        rows.append(blank | {"kind": "moment", "param": name, "idx": i, "n": online.n, "mean": mean, "m2": m2})
    for b, c, m in zip(problem.block_index, cov, members, strict=False):
        ids = problem.index[m].tolist()
        for x in range(len(m)):
            rows += [blank | {"kind": "cov", "block": b, "idx": ids[x], "j": ids[y], "n": online.n, "mean": float(c.mean[x]), "mean_j": float(c.mean[y]), "m2": float(c.m2[x, y])} for y in range(x, len(m))]
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, _RUNNING)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _RUNNING)


def run(spark: SparkSession, problems: Sequence[Problem], controls: Controls, noise: Callable | None = None) -> DataFrame:
    """Draws of all chains and components (or what ``RUNNING`` says, if the controls keep moments), in tasks of their own.

    A task is sent the one problem that it works on.
    """
    rows, schema = (draw_rows, DRAWS) if controls.store == "draws" else (running_rows, RUNNING)
    shipped = spark.createDataFrame(pa.table({"part": pa.array(range(len(problems)), pa.int32()), "problem": pa.array([pickle.dumps(p, 5) for p in problems], pa.large_binary())}))
    n = controls.chains * len(problems)
    each = shipped.select("part", "problem", F.explode(F.sequence(F.lit(1), F.lit(controls.chains))).alias("chain"))

    def tasks(batches):
        for b in batches:
            for part, problem, number in zip(*(b.column(k).to_pylist() for k in ("part", "problem", "chain")), strict=True):
                yield from rows(pickle.loads(problem), controls, number, part, noise)

    return each.repartitionByRange(n, "part", "chain").mapInArrow(tasks, schema)


def running_draws(raw: DataFrame, blocks: int) -> DataFrame:
    """What draws say of the whole model, added over components: a row for each chain and draw."""
    d = raw.where("kind = 'draw'")
    add = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(blocks)]).alias(c)
    return d.groupBy("chain", "draw").agg(F.first("residual_var").alias("residual_var"), add("own"), add("along"), *[F.sum(c).alias(c) for c in ("signal", "x_part", "noise")])


def moments(raw: DataFrame, blocks: Sequence[str], y_mean: float | None, n: int, df: int, pve: str | None) -> DataFrame:
    """Chains' moments of all quantities: those that tasks keep, and of the whole model the residual variance, the intercept and variance shares."""
    # a hyper-parameter belongs to one component unless it is fixed, and then all agree
    own = raw.where("kind = 'moment'").select("chain", "param", "idx", "n", "mean", "m2").dropDuplicates(["chain", "param", "idx"])
    w = whole_model(running_draws(raw, len(blocks)), y_mean, n, df)
    cols = [("residual_var", F.col("residual_var"))] + ([("intercept", F.col("intercept"))] if y_mean is not None else [])
    if pve:
        cols += [(f"pve::{b}", F.col(f"pve_{pve}")[i]) for i, b in enumerate(blocks)]
        cols += [("pve_total", F.col("pve_total")), ("pve_cross_block", F.col("pve_total") - F.aggregate("pve_standalone", F.lit(0.0), lambda a, x: a + x))]
    each = w.select("chain", F.explode(F.array(*[F.struct(F.lit(p).alias("param"), c.alias("value")) for p, c in cols])).alias("r")).select("chain", "r.*")
    count = F.count("value")
    return own.unionByName(each.groupBy("chain", "param").agg(count.alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * count).alias("m2")).withColumn("idx", F.lit(-1)))


def covariances(raw: DataFrame) -> DataFrame:
    return raw.where("kind = 'cov'").select("chain", "block", F.col("idx").alias("i"), "j", "n", F.col("mean").alias("mean_i"), "mean_j", F.col("m2").alias("c2"))


def whole_model(draws: DataFrame, y_mean: float | None, n: int, df: int) -> DataFrame:
    """Add the intercept, drawn around the response's mean, and shares of variance."""
    mean = F.lit(None).cast("double") if y_mean is None else F.lit(y_mean) - F.col("x_part") + F.sqrt(F.col("residual_var") / n) * F.col("noise")
    total = F.col("signal") / df + F.col("residual_var")
    share = lambda c: F.transform(c, lambda x: x / df / total)
    return draws.withColumns({"intercept": mean, "pve_standalone": share("own"), "pve_allocated": share("along"), "pve_total": F.col("signal") / df / total})


def recombine(draws: DataFrame, parts: int, y_mean: float | None, n: int, df: int) -> DataFrame:
    """One row for each chain and draw: predictors in order, signals and means added over components, the intercept drawn."""
    if parts > 1:
        arrays = ("theta", "inclusion", "mix_component", "local_var")
        item = F.struct("idx", *arrays)
        g = draws.groupBy("chain", "draw").agg(
            F.first("residual_var").alias("residual_var"), F.collect_list(item).alias("items"), F.array_agg("hyper").alias("hypers"), F.array_agg("own").alias("owns"), F.array_agg("along").alias("alongs"),
            F.sum("signal").alias("signal"), F.sum("x_part").alias("x_part"), F.sum("noise").alias("noise"),
        )
        flat = F.array_sort(F.flatten(F.transform("items", lambda x: F.transform(F.sequence(F.lit(0), F.size(x["idx"]) - 1), lambda k: F.struct(
            x["idx"][k].alias("idx"), x["theta"][k].alias("theta"), F.get(x["inclusion"], k).alias("inclusion"), F.get(x["mix_component"], k).alias("mix_component"), F.get(x["local_var"], k).alias("local_var"))))))
        add = lambda c: F.aggregate(F.slice(c, 2, 1 << 30), c[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        # a hyper-parameter belongs to one component unless it is fixed, and then all agree
        merged = F.aggregate("hypers", F.create_map().cast("map<string,double>"), lambda a, m: F.map_concat(a, F.map_filter(m, lambda k, _: ~F.map_contains_key(a, k))))
        draws = g.withColumn("flat", flat).select("chain", "draw", "residual_var", *[F.col("flat")[c].alias(c) for c in arrays], merged.alias("hyper"), add(F.col("owns")).alias("own"), add(F.col("alongs")).alias("along"), "signal", "x_part", "noise")
    return whole_model(draws, y_mean, n, df).select("chain", "draw", "residual_var", "intercept", "theta", "inclusion", "mix_component", "local_var", "hyper", "pve_standalone", "pve_allocated", "pve_total")
