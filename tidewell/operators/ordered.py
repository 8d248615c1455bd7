"""Ordered per-key computation that does not put a heavy key into one task.

A window partitioned by the key alone sorts all rows of that key in one task. Here keys with more
than ``slice_rows`` rows are cut into slices along the order first. Every slice is an own window partition;
what crosses slice borders (positions, previous rows, moments, decays) is merged afterwards from
one small row per slice. Ordinary keys have the single slice 0 and cost no extra join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_ROWS = 2_000_000
#: Sampled rows per slice, from which slice bounds are taken, and slices of one key at most.
SAMPLES = 64
MOST_SLICES = 4096
#: Distinct values in a range of running totals.
RANGE_VALUES = 100_000


def split_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``_slice``: 0 for ordinary keys, slices 1, 2, ... along ``order`` for heavy ones.

    Bounds are rows of the data, picked from a sample by hash (so that each evaluation picks the same),
    and compare on all columns of ``order``, of any type. So slices hold about ``slice_rows`` rows each,
    even if a key's rows share one timestamp or a stray one lies far off. Slices outgrow ``slice_rows``
    only beyond ``MOST_SLICES`` slices of a key, or by rows that are equal on all of ``order``.
    """
    columns = [f"`{c}`" for c in df.columns]
    at = "struct(" + ", ".join(order) + ")"
    rate = max(1, slice_rows // SAMPLES)
    every = max(1, slice_rows // rate)
    heavy = df.groupBy(*keys).agg(F.expr("count(*) AS _rows")).filter(f"_rows > {slice_rows}")
    picked = df.selectExpr(*keys, f"{at} AS _at").filter(f"pmod(xxhash64({', '.join(keys)}, _at), {rate}) = 0")
    numbered = picked.join(heavy, list(keys)).selectExpr(*keys, "_at", f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY _at) AS _k", f"greatest({every}, ceil(_rows / {rate} / {MOST_SLICES})) AS _step")
    bounds = numbered.filter("_k % _step = 0").groupBy(*keys).agg(F.expr("array_sort(collect_list(_at)) AS _bounds"))
    bounds = heavy.select(*keys).join(bounds, list(keys), "left").selectExpr(*keys, "1 AS _heavy", "_bounds")
    number = f"IF(_heavy IS NULL, 0, 1 + coalesce(size(filter(_bounds, b -> b < {at})), 0))"
    return df.join(bounds, list(keys), "left").selectExpr(*columns, f"CAST({number} AS BIGINT) AS _slice")


def sequenced(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: dict[str, str] | None = None,
    position: str = "pos",
    total: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Number the rows of each key from 1 in ``order``; add values of the row before.

    ``previous`` maps a new column to the column whose previous value it takes. ``total`` names a
    column for the row count of the key.
    """
    previous = previous or {}
    key, by = ", ".join(keys), ", ".join(order)
    columns = [f"`{c}`" for c in df.columns]
    cut = split_hot(df, keys, order, slice_rows)
    inner = f"OVER (PARTITION BY {key}, _slice ORDER BY {by})"
    rows = cut.selectExpr(
        *columns,
        "_slice",
        f"CAST(row_number() {inner} AS BIGINT) AS _rn",
        *[f"lag({source}) {inner} AS _p_{name}" for name, source in previous.items()],
        *([f"count(*) OVER (PARTITION BY {key}, _slice) AS _held"] if total else []),
    )

    # One row per slice of a heavy key; empty when there is none.
    tail = "struct(" + ", ".join([f"{source} AS {name}" for name, source in previous.items()] + ["1 AS _"]) + ")"
    heavy = (
        cut.filter("_slice > 0")
        .groupBy(*keys, "_slice")
        .agg(F.expr("count(*) AS _n"), F.expr(f"max_by({tail}, struct({by})) AS _last"))
    )
    by_key = f"OVER (PARTITION BY {key} ORDER BY _slice"
    borders = heavy.selectExpr(
        *keys,
        "_slice",
        f"sum(_n) {by_key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before",
        f"sum(_n) OVER (PARTITION BY {key}) AS _all",
        f"lag(_last) {by_key}) AS _tail",
    )
    return rows.join(borders, [*keys, "_slice"], "left").selectExpr(
        *columns,
        *[f"if(_rn = 1, _tail.{name}, _p_{name}) AS {name}" for name in previous],
        f"_rn + coalesce(_before, 0) AS {position}",
        *([f"coalesce(_all, _held) AS {total}"] if total else []),
    )


def series_summary(
    df: DataFrame,
    key: str = "user_id",
    ts: str = "ts",
    row_id: str = "id",
    value: str = "risk",
    alpha: float = 0.3,
    high: float = 0.7,
    gap_days: int = 7,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per key with everything the trend operators need, from one shuffle of the rows.

    Null values are dropped first. Columns: ``n, first, last, prev, prev2, prev3, mean, low, peak,
    m2`` (sum of squared deviations), ``slope`` over positions 0..n-1, ``ema``, ``delta_low``,
    ``delta_peak`` (smallest and largest step), ``n_high``, ``gap_max_days``, ``n_gaps``,
    ``base_mean`` and ``base_m2`` (the same moments without the last value), ``first_ts``,
    ``last_ts``.
    """
    keep = f"CAST({1.0 - alpha!r} AS DOUBLE)"
    rows = df.filter(f"{value} IS NOT NULL").selectExpr(
        key, f"{ts} AS _ts", f"{row_id} AS _id", f"CAST({value} AS DOUBLE) AS _x"
    )
    cut = split_hot(rows, [key], ["_ts", "_id"], slice_rows)
    inner = f"OVER (PARTITION BY {key}, _slice ORDER BY _ts, _id)"
    local = cut.selectExpr(
        key,
        "_slice",
        "_ts",
        "_x",
        f"row_number() {inner} AS _rn",
        f"_x - lag(_x) {inner} AS _d",
        f"(unix_micros(CAST(_ts AS TIMESTAMP)) - unix_micros(CAST(lag(_ts) {inner} AS TIMESTAMP))) / 86400e6 AS _g",
        f"count(*) OVER (PARTITION BY {key}, _slice) AS _held",
    )
    # Per slice; the suffix _e marks figures without the slice's last row.
    measures = {
        "n": "count(*)",
        "s": "sum(_x)",
        "m2": "var_pop(_x) * count(*)",
        "low": "min(_x)",
        "peak": "max(_x)",
        "ix": "sum((_rn - 1) * _x)",
        "ema": f"sum(CAST({alpha!r} AS DOUBLE) * pow({keep}, _held - _rn) * _x)",
        "first": "max(if(_rn = 1, _x, NULL))",
        "tail": "array(" + ", ".join(f"max(if(_held - _rn = {b}, _x, NULL))" for b in (3, 2, 1, 0)) + ")",
        "d_low": "min(_d)",
        "d_peak": "max(_d)",
        "g_max": "max(_g)",
        "n_gaps": f"count_if(floor(_g) > {gap_days})",
        "n_high": f"count_if(_x >= CAST({high!r} AS DOUBLE))",
        "s_e": "coalesce(sum(if(_held > _rn, _x, NULL)), 0e0)",
        "m2_e": "coalesce(var_pop(if(_held > _rn, _x, NULL)) * (count(*) - 1), 0e0)",
        "t0": "min(_ts)",
        "t1": "max(_ts)",
    }
    slices = local.groupBy(key, "_slice").agg(*[F.expr(f"{e} AS {n}") for n, e in measures.items()])
    by_key = f"OVER (PARTITION BY {key} ORDER BY _slice"
    every = f"OVER (PARTITION BY {key})"
    placed = slices.selectExpr(
        "*",
        f"count(*) {every} - row_number() {by_key}) AS _k",
        f"coalesce(sum(n) {by_key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off",
        f"sum(n) {every} AS _n_all",
        f"sum(s) {every} AS _s_all",
        f"element_at(lag(tail) {by_key}), -1) AS _px",
        f"lag(t1) {by_key}) AS _pt",
    ).selectExpr(
        "*",
        "if(_k = 0, n - 1, n) AS _ne",
        "if(_k = 0, s_e, s) AS _se",
        "if(_k = 0, m2_e, m2) AS _m2e",
        f"sum(if(_k = 0, s_e, s)) {every} / nullif(_n_all - 1, 0) AS _base",
        "first - _px AS _bd",
        "(unix_micros(CAST(t0 AS TIMESTAMP)) - unix_micros(CAST(_pt AS TIMESTAMP))) / 86400e6 AS _bg",
    )
    merged = {
        "n": "sum(n)",
        "_s": "sum(s)",
        "m2": "sum(m2 + n * pow(s / n - _s_all / _n_all, 2))",
        "low": "min(low)",
        "peak": "max(peak)",
        "_ix": "sum(ix + off * s)",
        "_ema": f"sum(ema * pow({keep}, _n_all - off - n))",
        "first": "min_by(first, _slice)",
        # the last four values; only the last four slices can hold them
        "_tail": "filter(flatten(transform(array_sort(collect_list(if(_k < 4, struct(_slice, tail), NULL))), p -> p.tail)), v -> v IS NOT NULL)",
        "delta_low": "min(least(d_low, _bd))",
        "delta_peak": "max(greatest(d_peak, _bd))",
        "_gap": "max(greatest(g_max, _bg))",
        "n_gaps": f"sum(n_gaps) + count_if(floor(_bg) > {gap_days})",
        "n_high": "sum(n_high)",
        "base_mean": "max(_base)",
        "base_m2": "sum(_m2e + if(_ne > 0 AND _base IS NOT NULL, _ne * pow(_se / _ne - _base, 2), 0e0))",
        "first_ts": "min(t0)",
        "last_ts": "max(t1)",
    }
    out = placed.groupBy(key).agg(*[F.expr(f"{e} AS {n}") for n, e in merged.items()])

    def from_end(back: int, name: str) -> str:
        return f"if(size(_tail) >= {back}, element_at(_tail, -{back}), NULL) AS {name}"

    return out.selectExpr(
        key,
        "n",
        "first",
        from_end(1, "last"),
        from_end(2, "prev"),
        from_end(3, "prev2"),
        from_end(4, "prev3"),
        "_s / n AS mean",
        "low",
        "peak",
        "m2",
        "if(n > 1, (_ix - (n - 1) / 2 * _s) / (CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) * n - 1) / 12), 0e0) AS slope",
        f"_ema + pow({keep}, n) * first AS ema",
        "delta_low",
        "delta_peak",
        "n_high",
        "CAST(floor(_gap) AS BIGINT) AS gap_max_days",
        "n_gaps",
        "base_mean",
        "base_m2",
        "first_ts",
        "last_ts",
    )


def running_totals(
    df: DataFrame, axis: str, sums: Sequence[str], descending: bool = False, by: Sequence[str] = (), slice_rows: int = RANGE_VALUES
) -> DataFrame:
    """Add ``<name>_before`` for each of ``sums``: its total over all rows ahead on ``axis``.

    ``df`` has one row per value of ``axis`` (within ``by``, a handful of groups such as field
    names). Large groups are cut into ranges of about equally many values; only the range totals (at
    most ``MOST_SLICES`` per group) are ordered in one task, the rows themselves per range.
    """
    groups = [*by, "_all"]
    columns = [f"`{c}`" for c in df.columns]
    cut = split_hot(df.withColumn("_all", F.lit(0)), groups, [axis], slice_rows)
    way = "DESC" if descending else "ASC"
    ahead_rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    key = ", ".join(groups)
    totals = cut.groupBy(*groups, "_slice").agg(*[F.expr(f"sum({s}) AS _t_{s}") for s in sums])
    ahead = totals.selectExpr(*groups, "_slice", *[f"coalesce(sum(_t_{s}) OVER (PARTITION BY {key} ORDER BY _slice {way} {ahead_rows}), 0) AS _a_{s}" for s in sums])
    inside = f"OVER (PARTITION BY {key}, _slice ORDER BY {axis} {way} {ahead_rows})"
    local = cut.selectExpr(*columns, "_all", "_slice", *[f"coalesce(sum({s}) {inside}, 0) AS _l_{s}" for s in sums])
    return local.join(ahead, [*groups, "_slice"]).selectExpr(*columns, *[f"_a_{s} + _l_{s} AS {s}_before" for s in sums])


def exact_quantiles(
    df: DataFrame, column: str, quantiles: Sequence[float], by: Sequence[str] = (), slice_rows: int = RANGE_VALUES
) -> DataFrame:
    """Exact quantiles ``q0, q1, ...`` of a column, linearly interpolated; one row (per ``by``).

    The built-in exact percentile keeps all distinct values of the table in one task; this one
    counts per value and looks the two neighbours up by their running count.
    """
    by = list(by)
    values = df.selectExpr(*by, f"CAST({column} AS DOUBLE) AS _x").filter("_x IS NOT NULL AND NOT isnan(_x)")
    counts = values.groupBy(*by, "_x").agg(F.expr("count(*) AS _n"))
    placed = running_totals(counts, "_x", ["_n"], by=by, slice_rows=slice_rows)
    size = F.expr("sum(_n) AS _all")
    total = counts.groupBy(*by).agg(size) if by else counts.agg(size)
    rows = placed.join(total, by) if by else placed.crossJoin(total)
    picks = []
    for i, q in enumerate(quantiles):
        at = f"((_all - 1) * CAST({q!r} AS DOUBLE))"
        for name, index in (("l", f"floor({at})"), ("h", f"ceil({at})")):
            picks.append(F.expr(f"max(if(_n_before <= {index} AND {index} < _n_before + _n, _x, NULL)) AS _{name}{i}"))
        picks.append(F.expr(f"max({at} - floor({at})) AS _f{i}"))
    return rows.groupBy(*by).agg(*picks).selectExpr(*by, *[f"_l{i} + (_h{i} - _l{i}) * _f{i} AS q{i}" for i in range(len(quantiles))])
