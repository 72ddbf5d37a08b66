"""Preprocessing that is fitted once, stored, and applied to any rows: Spark ML stages over long frames, whose fitted state is a few
tables; and many such pipelines at once, each shared prefix computed once."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.matrix import array_from_long
from assayloom.operators import impute, normalize
from assayloom.operators.missing import detect_mnar
from assayloom.operators.ordered import medians
from assayloom.runtime import kept

CELL = ("fi", "feature", "value")
#: What is imputed row by row in a censored way, and what needs whole rows to learn from.
CENSORED, BY_ROWS = ("qrilc", "minprob"), ("knn", "mice", "miss_forest")


class _Writer(MLWriter):
    def __init__(self, stage: _Fitted):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, {"tables": sorted(self.stage.tables)})
        for name, df in self.stage.tables.items():
            df.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> _Fitted:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(known["uid"])
        DefaultParamsReader.getAndSetParams(stage, known)
        stage.tables = {name: self.sparkSession.read.parquet(f"{path}/{name}") for name in known["tables"]}
        return stage


class _Step(Params):
    """A method by name, and its parameters as JSON."""

    method = Param(Params._dummy(), "method", "the method's name", typeConverter=TypeConverters.toString)
    how = Param(Params._dummy(), "how", "its parameters as JSON", typeConverter=TypeConverters.toString)
    strategy = Param(Params._dummy(), "strategy", "mar, mnar or mixed", typeConverter=TypeConverters.toString)

    features = Param(Params._dummy(), "features", "names of the features, in the order of their places", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, method: str = "none", how: str = "{}", strategy: str = "mar", features: list[str] | None = None):
        super().__init__()
        self._setDefault(method="none", how="{}", strategy="mar", features=[])
        self._set(**self._input_kwargs)

    @property
    def name(self) -> str:
        return self.getOrDefault("method")

    @property
    def options(self) -> dict:
        return json.loads(self.getOrDefault("how"))


class _Fitted(_Step, Model, MLReadable, MLWritable):
    tables: dict[str, DataFrame]

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    @classmethod
    def of(cls, step: _Step, tables: dict[str, DataFrame]) -> _Fitted:
        made = cls(**{p.name: step.getOrDefault(p) for p in step.params})
        made.tables = {name: kept(df) for name, df in tables.items()}
        return made


class Scaler(_Step, Estimator):
    """none, standard, min_max, median, log2, top_l or quantile; learns from rows (id, fi, value)."""

    def _fit(self, long: DataFrame) -> ScalerModel:
        name, odd = self.name, sorted(set(self.options) - ({"l"} if self.name == "top_l" else set()))
        if name != "none" and name not in normalize.METHODS and name not in normalize.FITTED:
            raise ValueError(f"no such scaler: {name}")
        if odd:
            raise ValueError(f"{name} takes no {odd[0]}")
        if name == "standard":
            sd = F.stddev_pop("value")
            line = long.groupBy("fi").agg(F.avg("value").alias("shift"), F.when(sd > 0, sd).otherwise(1.0).alias("scale"))
        elif name == "min_max":
            line = long.groupBy("fi").agg(F.min("value").alias("shift"), (F.max("value") - F.min("value")).alias("scale"))
        elif name == "median":
            line = medians(long, ("fi",)).select("fi", F.col("median").alias("shift"), F.lit(1.0).alias("scale"))
        elif name == "top_l":
            line = normalize.top_l_scales(long, **self.options).select("fi", F.lit(0.0).alias("shift"), "scale")
        elif name == "quantile":
            return ScalerModel.of(self, {"ranks": normalize.ranked(long).groupBy("k").agg(F.avg("value").alias("m"))})
        else:
            return ScalerModel.of(self, {})
        return ScalerModel.of(self, {"line": line})


class ScalerModel(_Fitted):
    """(value - shift) / scale by feature, or the training rows' mean at a value's rank in its row; an infinite result counts as missing.
    A feature that the training rows did not have becomes missing."""

    def _transform(self, long: DataFrame) -> DataFrame:
        name, done = self.name, long
        if name == "log2":
            done = normalize.log2(long)
        elif name == "quantile":
            met = normalize.ranked(long).join(F.broadcast(self.tables["ranks"]), "k", "left")  # a row a feature
            done = met.withColumn("value", F.when(F.col("value").isNotNull(), F.coalesce("m", "value")))
        elif name != "none":
            moved = F.col("value") - F.col("shift")
            scaled = F.try_divide(moved, F.col("scale"))
            if name == "min_max":
                scaled = F.when(moved.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(scaled, F.lit(0.0)))))
            done = long.join(F.broadcast(self.tables["line"]), "fi", "left").withColumn("value", scaled)  # a row a feature
        return done.withColumn("value", F.when(F.abs("value") < float("inf"), F.col("value"))).select(long.columns)


class Imputer(_Step, Estimator):
    """A method of impute.PARAMETERS or none; learns from rows (id, target, fi, value)."""

    def _fit(self, long: DataFrame) -> ImputerModel:
        name, how = self.name, self.options
        if name == "none":
            return ImputerModel.of(self, {})
        if name not in impute.PARAMETERS:
            raise ValueError(f"no such method: {name}")
        if odd := sorted(set(how) - set(impute.PARAMETERS[name])):
            raise ValueError(f"{name} takes no {odd[0]}; it takes {', '.join(impute.PARAMETERS[name]) or 'nothing'}")
        if name in BY_ROWS:
            return ImputerModel.of(self, {"rows": long.select("id", "target", "fi", "value")})
        if name not in CENSORED:
            return ImputerModel.of(self, {"fill": impute.fill_table(long, name)})
        tables = {"spread": impute.minprob_parameters(long, observed=how.get("observed", 0.5))[1]} if name == "minprob" else {}
        if self.getOrDefault("strategy") == "mixed":
            tables["chosen"] = detect_mnar(long).filter("mnar").select("fi")
        return ImputerModel.of(self, tables)


class ImputerModel(_Fitted):
    """Gaps filled as the training rows say; what a row gets depends on no other row that is transformed with it."""

    def _transform(self, long: DataFrame) -> DataFrame:
        name, how, keep = self.name, self.options, tuple(c for c in long.columns if c not in CELL)
        if name == "none":
            return long
        cells = long.select(*keep, "fi", "value")
        if name in BY_ROWS:
            done = impute.impute(cells, name, keep=keep, reference=self.tables["rows"], **how)
        elif name in CENSORED:
            spread = self.tables["spread"].first()[0] if name == "minprob" else None
            done = impute.censored(cells, name, keep, self.tables.get("chosen"), spread, **how)
        else:
            done = impute.filled_by(cells, self.tables["fill"])
        return done.select(*keep, "fi", "value")


def pipeline(combination: dict, strategy: str = "mar", features: list[str] | None = None) -> Pipeline:
    """The stages of one combination: its scaler, then its censored method, then the one for what is still missing."""
    stages = [Scaler(method=combination["scaler"], features=features or [])]
    for step, kind in (("mnar", strategy), ("mar", "mar")):
        if combination[step]:
            how = dict(combination[step])
            stages.append(Imputer(method=how.pop("method"), how=json.dumps(how, sort_keys=True), strategy=kind, features=features or []))
    return Pipeline(stages=stages)


def pipeline_name(c: dict) -> str:
    part = lambda p: "none" if not p else "-".join(str(v) for v in p.values())
    return f"{c['scaler']}_{part(c['mnar'])}_{part(c['mar'])}"


def _once(values: list) -> list:
    return [v for i, v in enumerate(values) if v not in values[:i]]


def prefixes(split: DataFrame, combinations: list[dict], strategy: str = "mar", seed: int = 0) -> DataFrame:
    """(scaler string, mnar int, id, target, test, x array<double>) of rows (id, target, test, fi, value), fitted where not ``test``:
    each scaler runs once, each censored method (by its place among those of ``combinations``) once a scaler. Rows lack no feature."""
    options = _once([c["mnar"] for c in combinations])
    for how in options:
        if how and how["method"] not in CENSORED:
            raise ValueError(f"{how['method']} is no censored method")
        if how and "observed" in how:
            raise ValueError("the share of observed values is fixed here")
    parts = None
    train = split.filter("not test")
    for name in _once([c["scaler"] for c in combinations]):  # as many as there are scalers
        fit = Scaler(method=name).fit(train)
        own = fit.transform(split)
        learn = own.filter("not test")
        arrays = array_from_long(own, ["id", "target", "test"]).withColumn("scaler", F.lit(name))
        spread = impute.minprob_parameters(learn)[1] if any(o and o["method"] == "minprob" for o in options) else None
        arrays = arrays.withColumn("sd", F.lit(0.0)) if spread is None else arrays.join(F.broadcast(spread))  # one row
        if strategy == "mixed" and any(options):
            # Places in x: features in ascending order.
            order = own.select("fi").distinct().agg(F.array_sort(F.collect_set("fi")).alias("order"))
            chosen = detect_mnar(learn).filter("mnar").agg(F.collect_set("fi").alias("own"))
            places = order.join(F.broadcast(chosen)).select(F.transform("order", lambda f: F.array_contains("own", f)).alias("chosen"))  # one row
            arrays = arrays.join(F.broadcast(places))
        else:
            arrays = arrays.withColumn("chosen", F.lit(None).cast("array<boolean>"))
        one = arrays.select("scaler", "id", "target", "test", "x", F.coalesce("sd", F.lit(0.0)).alias("sd"), "chosen")
        parts = one if parts is None else parts.unionByName(one)

    def censor(key: object, x: np.ndarray, sd: float, how: dict | None) -> np.ndarray:
        if not how:
            return x
        if how["method"] == "qrilc":
            return impute.qrilc_row(key, x, how.get("tune_sigma", 1.0), how.get("seed", seed))
        there = x[~np.isnan(x)]
        mean = np.quantile(there, how.get("quantile_percent", 0.01) / 100) if len(there) else np.nan
        return impute.minprob_row(key, x, mean, sd * how.get("tune_sigma", 1.0), how.get("lower", 0.0), how.get("seed", seed))

    def run(batches):
        for pdf in batches:
            for i, how in enumerate(options):
                done = []
                for key, x, sd, chosen in zip(pdf["id"], pdf["x"], pdf["sd"], pdf["chosen"], strict=True):
                    x = np.array([np.nan if v is None else v for v in x], float)
                    new = censor(key, x, sd, how)
                    done.append(new if chosen is None else np.where(np.array(chosen, bool), new, x))
                yield pdf[["scaler", "id", "target", "test"]].assign(mnar=i, x=[[None if np.isnan(v) else float(v) for v in x] for x in done])

    return parts.mapInPandas(run, "scaler string, id long, target int, test boolean, mnar int, x array<double>")


def over_pipelines(split: DataFrame, combinations: list[dict], each: Callable[[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, strategy: str = "mar", seed: int = 0) -> DataFrame:
    """``each(pipeline, ids, y, test, x)`` of every pipeline's completed matrix, as one job however many pipelines there are.

    A task has the matrix of one prefix and completes it by one method, in all the ways that are asked for, so neighbours are looked
    for once for all numbers of them. The caller checks the matrix's size; as many copies travel as there are prefixes times methods."""
    options = _once([c["mnar"] for c in combinations])
    seats: dict[tuple, list[dict]] = {}
    for c in combinations:
        seats.setdefault((c["scaler"], options.index(c["mnar"]), (c["mar"] or {}).get("method", "none")), []).append(c)
    spark = split.sparkSession
    table = spark.createDataFrame(list(seats), "scaler string, mnar int, method string")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, y, test = (pdf[c].to_numpy() for c in ("id", "target", "test"))
        x = np.array([[np.nan if v is None else v for v in r] for r in pdf["x"]], float)
        own, out = seats[key], []
        if key[2] == "knn":
            made = impute.filled_by_nearest(ids, x, ~test, [(c["mar"].get("k", 5), c["mar"].get("weights", "uniform")) for c in own])
        else:
            made = (impute.completed(ids, x, ~test, seed=seed, **c["mar"]) if c["mar"] else x for c in own)
        for c, done in zip(own, made, strict=True):
            out.append(each(pipeline_name(c), ids, y, test, done))
        return pd.concat(out, ignore_index=True)

    held = prefixes(split, combinations, strategy, seed).join(F.broadcast(table), ["scaler", "mnar"])  # a row a prefix and method
    return held.groupBy("scaler", "mnar", "method").applyInPandas(run, schema)


def completed_cells(split: DataFrame, combinations: list[dict], strategy: str = "mar", seed: int = 0) -> DataFrame:
    """(pipeline string, id long, place int, value double): every pipeline's completed matrix, features by their place in ascending order."""

    by_mean = [c for c in combinations if not c["mar"] or c["mar"] == {"method": "mean"}]
    others = [c for c in combinations if c not in by_mean]
    parts = []
    if by_mean:
        parts.append(_cells_by_mean(split, by_mean, strategy, seed))
    if others:

        def each(name: str, ids: np.ndarray, y: np.ndarray, test: np.ndarray, x: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"pipeline": name, "id": ids, "x": list(x)})

        rows = over_pipelines(split, others, each, "pipeline string, id long, x array<double>", strategy, seed)
        parts.append(rows.select("pipeline", "id", F.posexplode("x").alias("place", "value")))
    done = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return done.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def _cells_by_mean(split: DataFrame, combinations: list[dict], strategy: str, seed: int) -> DataFrame:
    """Cells of pipelines that put means of the fitted rows, or nothing, into gaps: no task needs a whole matrix for that."""
    options = _once([c["mnar"] for c in combinations])
    names = [(c["scaler"], options.index(c["mnar"]), pipeline_name(c), bool(c["mar"])) for c in combinations]
    table = split.sparkSession.createDataFrame(names, "scaler string, mnar int, pipeline string, fills boolean")
    held = prefixes(split, combinations, strategy, seed)
    cells = held.select("scaler", "mnar", "id", "test", F.posexplode("x").alias("place", "value"))
    means = cells.filter("not test").groupBy("scaler", "mnar", "place").agg(F.avg("value").alias("mean"))
    met = cells.join(F.broadcast(means), ["scaler", "mnar", "place"], "left").join(F.broadcast(table), ["scaler", "mnar"])  # a row a prefix and feature, a row a pipeline
    return met.select("pipeline", "id", "place", F.coalesce("value", F.when(F.col("fills"), F.col("mean"))).alias("value"))


def best_of(scores: DataFrame, by: tuple[str, ...] = ("sens_at_95", "roc_auc", "pr_auc", "ppv", "npv"), n: int = 5) -> DataFrame:
    """The ``n`` rows that are best by these scores, the first counting first; ties by the pipeline's name."""
    return scores.orderBy(*(F.desc_nulls_last(c) for c in by), "pipeline").limit(n)
