"""Ridge on date features for every series of a panel, from mergeable day-block moments.

Features depend on the date alone, so a row needs only its series, its date and its values; the
features of the calendar (one row per day, bounded by the span) are sent to the tasks once.

1. ``day_moments``: the days are cut at the folds' training ends.  For each (series, block, target) one row of
   moments: n, the means, and the centred sums X'X (upper triangle) and X'y.  One scan of the rows, whatever the
   number of folds; a new block of days adds rows and changes none.
2. ``fit``: moments of the blocks up to a fold's training end add up by key (pairwise update of centred sums, so
   nothing cancels), then each fold is a solve of the features' order: z-scores with population deviation
   (0 counts as 1), (Z'Z + alpha I) w = Z'(y - mean y).
3. ``predict``: a fitted row writes its own days; nothing is joined.

``zero_days="drop"`` fits selling days.  ``"keep"`` fits ln max(y, 1) on all days of the span, and the days
without a row need not exist: they add nothing to X'y, and X'X over a block is the calendar's own, the same for all
series.  So a sparse series costs its selling days and one number for each feature, and each fold's matrix is factored
once in a task.

Cases: null, NaN and infinite values are left out (in ``"keep"`` they count as zero days); a series without a training
day in a fold has no row for it; null keys are a series; repeated (series, day) rows are repeated observations in
``"drop"`` and must be summed first in ``"keep"``; an empty panel gives no rows.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendora.operators.calendar_ops import MAX_SPAN_DAYS

ALPHA = 3.0                # fixed value: the published model's ridge penalty
FLAT = 1e-9                # a deviation below this part of the feature's largest value is rounding


@dataclass
class Calendar:
    """Features of all days from ``first`` on, one row for each day."""

    first: int                 # days since 1970
    x: np.ndarray
    names: list

    @classmethod
    def of(cls, features: DataFrame, names: list, date_col: str = "date") -> "Calendar":
        """From a table of one row per day; fails where it isn't a calendar."""
        rows = features.select(F.unix_date(date_col).alias("d"), *[F.col(c).cast("double") for c in names]).orderBy("d")
        got = rows.limit(MAX_SPAN_DAYS + 1).toArrow()
        days = got.column("d").to_numpy()
        if len(days) > MAX_SPAN_DAYS or (len(days) and (np.diff(days) != 1).any()):
            raise ValueError("features must have one row for each day of a calendar's span")
        return cls(int(days[0]) if len(days) else 0, np.column_stack([got.column(c).to_numpy() for c in names]), list(names))

    def scale(self) -> np.ndarray:
        return np.abs(self.x).max(axis=0)


def _number(day) -> int:
    day = datetime.date.fromisoformat(day) if isinstance(day, str) else day
    return (day - datetime.date(1970, 1, 1)).days


def _cuts(folds: list) -> list:
    """Training ends as day numbers, ascending; ``folds`` are (name, train_end, ...), an end of None is the last day."""
    return sorted({_number(f[1]) for f in folds if f[1] is not None})


@dataclass
class Moments:
    """n, mean of x, mean of y, centred X'X and X'y; they add up."""

    n: float
    mx: np.ndarray
    my: float
    xx: np.ndarray | None
    xy: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> "Moments":
        mx, my = x.mean(axis=0), y.mean()
        z = x - mx
        return cls(len(y), mx, my, z.T @ z, z.T @ (y - my))

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        dx, dy = other.mx - self.mx, other.my - self.my
        w = self.n * other.n / n
        xx = self.xx + other.xx + np.outer(dx, dx) * w
        return Moments(n, self.mx + dx * (other.n / n), self.my + dy * (other.n / n), xx, self.xy + other.xy + dx * (dy * w))

    def ridge(self, alpha: float, scale: np.ndarray) -> tuple:
        """(mu, sigma, coefficients of the z-scores, intercept)."""
        sigma = np.sqrt(np.diag(self.xx) / self.n)
        sigma = np.where(sigma <= FLAT * scale, 1.0, sigma)
        a = self.xx / np.outer(sigma, sigma)
        a[np.diag_indices_from(a)] += alpha
        return self.mx, sigma, np.linalg.solve(a, self.xy / sigma), self.my


def _names(schema, keys: list) -> str:
    return ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)


def day_moments(rows: DataFrame, cal: Calendar, keys: list, targets: list, folds: list, date_col: str = "date",
                zero_days: str = "drop") -> DataFrame:
    """(keys, block, target, n, mx, my, xx, xy) of the log values; in ``"keep"`` n, mx and xx belong to the calendar and
    are left null."""
    if zero_days not in ("drop", "keep"):
        raise ValueError("zero_days is 'drop' or 'keep'")
    cuts = _cuts(folds)
    block = F.lit(0)
    for cut in cuts:
        block = block + (F.unix_date(date_col) > cut).cast("int")
    src = rows.select(*keys, F.unix_date(F.col(date_col).cast("date")).alias("_day"), *[F.col(t).cast("double").alias(f"_y{i}") for i, t in enumerate(targets)],
                      block.alias("block"))
    known, p = rows.sparkSession.sparkContext.broadcast(cal), len(cal.names)
    upper = np.triu_indices(p)
    edges = np.array(cuts, np.int64)

    def run(table: pa.Table) -> pa.Table:
        cal = known.value
        day = table.column("_day").to_numpy()
        out = []
        for i, t in enumerate(targets):
            y = table.column(f"_y{i}").to_numpy(zero_copy_only=False).astype(np.float64)
            use = np.isfinite(y) & (y > (1.0 if zero_days == "keep" else 0.0))
            if not use.any():
                continue
            x, ly = cal.x[day[use] - cal.first], np.log(np.maximum(y[use], 1.0))
            if zero_days == "drop":
                m = Moments.of(x, ly)
                out.append((t, float(m.n), m.mx, m.my, m.xx[upper], m.xy))
                continue
            # against the means of all days of the block, selling or not
            at = np.searchsorted(edges, cal.first + np.arange(len(cal.x)))
            mine = cal.x[at == int(table.column("block")[0].as_py())]
            out.append((t, None, None, float(ly.sum()), None, (x - mine.mean(axis=0)).T @ ly))
        head = {k: pa.array([table.column(k)[0].as_py()] * len(out), table.schema.field(k).type) for k in [*keys, "block"]}
        cols = dict(zip(["target", "n", "mx", "my", "xx", "xy"], zip(*out))) if out else dict.fromkeys(["target", "n", "mx", "my", "xx", "xy"], ())
        kinds = [pa.string(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table({**head, **{c: pa.array(list(v), k) for (c, v), k in zip(cols.items(), kinds)}})

    schema = f"{_names(rows.schema, keys)}, block int, target string, n double, mx array<double>, my double, xx array<double>, xy array<double>"
    return src.groupBy(*keys, "block").applyInArrow(run, schema)


FIT = "fold string, target string, n long, mu array<double>, sigma array<double>, coef array<double>, intercept double"


def fit(moments: DataFrame, cal: Calendar, keys: list, folds: list, alpha: float = ALPHA, zero_days: str = "drop",
        span: tuple | None = None) -> DataFrame:
    """(keys, fold, target, n, mu, sigma, coef, intercept); ``span`` (first and last day) is needed for ``"keep"``: the days that
    count as observed."""
    cuts = _cuts(folds)
    last = {f[0]: len(cuts) if f[1] is None else cuts.index(_number(f[1])) for f in folds}
    known, p = moments.sparkSession.sparkContext.broadcast(cal), len(cal.names)
    upper = np.triu_indices(p)
    if zero_days == "keep" and span is None:
        raise ValueError("zero_days='keep' needs the span of observed days")
    days = None if span is None else (_number(span[0]), _number(span[1]))
    shared: dict = {}

    def whole(packed) -> np.ndarray:
        out = np.zeros((p, p))
        out[upper] = packed
        return out + np.triu(out, 1).T

    def calendar_blocks() -> list:
        """Moments of x over the observed days of each block, with y at zero."""
        if "blocks" not in shared:
            cal = known.value
            number = cal.first + np.arange(len(cal.x))
            at = np.searchsorted(np.array(cuts, np.int64), number)
            inside = (number >= days[0]) & (number <= days[1])
            shared["blocks"] = [Moments.of(cal.x[use], np.zeros(int(use.sum()))) if (use := inside & (at == b)).any() else None for b in range(len(cuts) + 1)]
        return shared["blocks"]

    def run(table: pa.Table) -> pa.Table:
        blocks = dict(zip(table.column("block").to_pylist(), range(table.num_rows)))
        get = lambda c, i: np.array(table.column(c)[i].as_py(), np.float64)
        if zero_days == "drop":
            of = {b: Moments(table.column("n")[i].as_py(), get("mx", i), table.column("my")[i].as_py(), whole(get("xx", i)), get("xy", i)) for b, i in blocks.items()}
        else:
            of = {b: Moments(m.n, m.mx, table.column("my")[blocks[b]].as_py() / m.n if b in blocks else 0.0, m.xx, get("xy", blocks[b]) if b in blocks else m.xy)
                  for b, m in enumerate(calendar_blocks()) if m is not None}
        out, total, done = [], None, -1
        for name, end in sorted(last.items(), key=lambda f: f[1]):
            for b in range(done + 1, end + 1):
                if b in of:
                    total = of[b] if total is None else total + of[b]
            done = end
            if total is not None:
                mu, sigma, coef, mean = total.ridge(alpha, known.value.scale())
                out.append((name, int(total.n), mu, sigma, coef, float(mean)))
        head = {k: pa.array([table.column(k)[0].as_py()] * len(out), table.schema.field(k).type) for k in keys}
        name, n, mu, sigma, coef, mean = zip(*out) if out else [()] * 6
        lists = lambda v: pa.array(list(v), pa.list_(pa.float64()))
        return pa.table({**head, "fold": pa.array(name, pa.string()), "target": pa.array([table.column("target")[0].as_py()] * len(out), pa.string()),
                         "n": pa.array(n, pa.int64()), "mu": lists(mu), "sigma": lists(sigma), "coef": lists(coef), "intercept": pa.array(mean, pa.float64())})

    return moments.groupBy(*keys, "target").applyInArrow(run, f"{_names(moments.schema, keys)}, {FIT}")


def zscores(fits: DataFrame, keys: list, names: list) -> DataFrame:
    """(keys, fold, target, n, feature, mu, sigma)."""
    each = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), "mu", "sigma")
    return fits.select(*keys, "fold", "target", "n", F.inline(each))


def predict(fits: DataFrame, cal: Calendar, keys: list, spans: dict, date_col: str = "date") -> DataFrame:
    """(keys, fold, target, date, pred) for the days of ``spans`` (fold -> first and last day), back on the values' own scale."""
    known = fits.sparkSession.sparkContext.broadcast(cal)
    spans = {f: (_number(a), _number(b)) for f, (a, b) in spans.items()}
    own = [*keys, "fold", "target"]

    def run(batches):
        cal = known.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                value = lambda c: row.column(row.schema.get_field_index(c))[0].as_py()
                if value("fold") not in spans:
                    continue
                lo, hi = spans[value("fold")]
                mu, sigma, coef = (np.array(value(c)) for c in ("mu", "sigma", "coef"))
                pred = np.exp((cal.x[lo - cal.first:hi - cal.first + 1] - mu) / sigma @ coef + value("intercept"))
                names = [*own, date_col, "pred"]
                same = [pa.array([value(c)] * len(pred), row.schema.field(c).type) for c in own]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(lo, lo + len(pred), dtype=np.int32)).cast(pa.date32()), pa.array(pred)], names=names)
    return fits.mapInArrow(run, f"{_names(fits.schema, own)}, `{date_col}` date, pred double")


def score(x: Column, mu: Column, sigma: Column, coef: Column, intercept: Column) -> Column:
    """The linear prediction on the log scale of a row with its features as an array."""
    z = F.zip_with(F.zip_with(x, mu, lambda a, m: a - m), sigma, lambda a, s: a / s)
    return F.aggregate(F.zip_with(z, coef, lambda a, w: a * w), intercept, lambda a, b: a + b)
