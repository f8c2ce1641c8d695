"""Queries over labels with memory, their methods and switches, and clamped rails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators import features, states
from quaymark.plans.shape import BY, bars_sql, fold_sql, over, panels_sql, query
from quaymark.plans.model_queries import EWMA
from quaymark.plans.signal_queries import REG, _regimes, raw_sql
from quaymark.sources.bars import derive_bars

OVER = "CASE WHEN coalesce(x.close > x.m20, false) THEN s.ov + 1 ELSE 0 END"
UNDER = "CASE WHEN coalesce(x.close > x.m20, false) THEN 0 ELSE s.un + 1 END"
BULL, BEAR = "coalesce(x.m20 > x.m60, false)", "coalesce(x.m20 < x.m60, false)"
PEAK, TROUGH = "greatest(coalesce(s.pk, x.close), x.close)", "least(coalesce(s.tr, x.close), x.close)"


def mean20_sql(name: str, confirm: int, source: str = "rw") -> str:
    rises, falls = f"(x.raw = 'up' AND ({OVER} >= {confirm} OR {BULL}))", f"(x.raw = 'down' AND ({UNDER} >= {confirm} OR {BEAR}))"
    left_up = f"({UNDER} >= 2 OR x.close / {PEAK} - 1 <= -0.06 OR (x.raw = 'range' AND {UNDER} >= {confirm} + 1))"
    left_down = f"({OVER} >= 2 OR x.close / {TROUGH} - 1 >= 0.04 OR (x.raw = 'range' AND {OVER} >= {confirm}))"
    wait = "greatest(s.wt - 1, 0)"
    held = f"(coalesce(x.close > s.tr, false) OR ({wait} > 0 AND {UNDER} < greatest({confirm}, 3)))"
    return fold_sql(
        name, source, "close, m20, m60, raw",
        {"ov": "0", "un": "1", "wt": "0", "pk": "CAST(NULL AS DOUBLE)", "tr": "CAST(NULL AS DOUBLE)", "label": "'range'"},
        {
            "ov": OVER, "un": UNDER,
            "wt": f"CASE s.label WHEN 'up' THEN CASE WHEN {falls} THEN 0 ELSE s.wt END WHEN 'down' THEN CASE WHEN {rises} THEN 0 WHEN {left_down} THEN 3 ELSE s.wt END ELSE CASE WHEN {rises} OR ({falls} AND NOT {held}) THEN 0 ELSE {wait} END END",
            "pk": f"CASE s.label WHEN 'up' THEN CASE WHEN {falls} OR {left_up} THEN NULL ELSE {PEAK} END WHEN 'down' THEN CASE WHEN {rises} THEN x.close WHEN {left_down} THEN NULL ELSE s.pk END ELSE CASE WHEN {rises} THEN x.close WHEN {falls} AND NOT {held} THEN NULL ELSE s.pk END END",
            "tr": f"CASE s.label WHEN 'up' THEN CASE WHEN {falls} THEN x.close WHEN {left_up} THEN NULL ELSE s.tr END WHEN 'down' THEN CASE WHEN {rises} THEN NULL ELSE {TROUGH} END ELSE CASE WHEN {rises} THEN NULL WHEN {falls} AND NOT {held} THEN x.close ELSE s.tr END END",
            "label": f"CASE s.label WHEN 'up' THEN CASE WHEN {falls} THEN 'down' WHEN {left_up} THEN 'range' ELSE 'up' END WHEN 'down' THEN CASE WHEN {rises} THEN 'up' WHEN {left_down} THEN 'range' ELSE 'down' END ELSE CASE WHEN {rises} THEN 'up' WHEN {falls} AND NOT {held} THEN 'down' ELSE 'range' END END",
        },
    )


BULLS, BEARS = f"CASE WHEN {BULL} THEN s.bu + 1 ELSE 0 END", f"CASE WHEN {BEAR} THEN s.be + 1 ELSE 0 END"


def mean60_sql(name: str, enter: int, source: str = "rw") -> str:
    left_up = f"({UNDER} >= 3 OR x.close / {PEAK} - 1 <= -0.12 OR (x.raw = 'range' AND {BEARS} >= {enter}))"
    left_down = f"({OVER} >= 3 OR x.close / {TROUGH} - 1 >= 0.04 OR (x.raw = 'range' AND {BULLS} >= {enter}))"
    to_up, rise, fall = f"({BULLS} >= 3 AND {OVER} >= {enter})", f"(x.raw = 'up' AND {BULLS} >= {enter} AND {OVER} >= {enter})", f"(x.raw = 'down' AND {BEARS} >= {enter})"
    return fold_sql(
        name, source, "close, m20, m60, raw",
        {"ov": "0", "un": "1", "bu": "0", "be": "0", "pk": "CAST(NULL AS DOUBLE)", "tr": "CAST(NULL AS DOUBLE)", "label": "'range'"},
        {
            "ov": OVER, "un": UNDER, "bu": BULLS, "be": BEARS,
            "pk": f"CASE s.label WHEN 'up' THEN CASE WHEN {BEARS} >= 3 OR {left_up} THEN NULL ELSE {PEAK} END WHEN 'down' THEN CASE WHEN {to_up} THEN x.close END ELSE CASE WHEN {rise} THEN x.close END END",
            "tr": f"CASE s.label WHEN 'up' THEN CASE WHEN {BEARS} >= 3 THEN x.close END WHEN 'down' THEN CASE WHEN {to_up} OR {left_down} THEN NULL ELSE {TROUGH} END ELSE CASE WHEN {rise} THEN NULL WHEN {fall} THEN x.close END END",
            "label": f"CASE s.label WHEN 'up' THEN CASE WHEN {BEARS} >= 3 THEN 'down' WHEN {left_up} THEN 'range' ELSE 'up' END WHEN 'down' THEN CASE WHEN {to_up} THEN 'up' WHEN {left_down} THEN 'range' ELSE 'down' END ELSE CASE WHEN {rise} THEN 'up' WHEN {fall} THEN 'down' ELSE 'range' END END",
        },
    )


def majority_sql(name: str, source: str, n: int = 3, label: str = "label") -> str:
    """Table ``name``: code, d and the commonest of the last ``n`` labels, the first by name of those as common."""
    return f"""{name}_h AS (SELECT code, d, list({label}) {over(n)} AS l FROM {source}),
    {name} AS (SELECT code, d, (SELECT arg_max(x, n * 10 - ord) FROM (SELECT x, len(list_filter(l, lambda v: v = x)) AS n, ord FROM (VALUES ('down', 0), ('range', 1), ('up', 2)) t(x, ord))) AS label FROM {name}_h)"""


def raws_sql(name: str, kind: str) -> str:
    return f"{name} AS (SELECT code, d, close, m20, m60, {raw_sql(kind)} AS raw FROM fx)"


STACKED = f"{mean20_sql('m3', 3)}, {majority_sql('stk', 'm3')}"
STRUCTURED = f"{raws_sql('r_so', 'soft')}, {mean60_sql('so', 3, 'r_so')}, {majority_sql('soft', 'so')}"
STRICT = f"{raws_sql('r_st', 'strict')}, {mean20_sql('st', 3, 'r_st')}, {majority_sql('strict', 'st')}"
CROSSES = f"{raws_sql('r_cr', 'cross')}, {mean60_sql('crs', 3, 'r_cr')}, {majority_sql('crosses', 'crs')}"
ADX = f"{raws_sql('r_ax', 'adx')}, {mean20_sql('ax', 2, 'r_ax')}, {majority_sql('adx_di', 'ax')}"
BANDS = f"{raws_sql('r_ba', 'band')}, {majority_sql('bands', 'r_ba', 5, 'raw')}"
HYBRID = f"""{STACKED}, hyb AS (SELECT s.code, s.d, CASE WHEN coalesce(adx, 0) < 15 AND abs(q60) < 0.06 AND abs(q20) < 0.04 AND NOT (label = 'up' AND coalesce(close > m20, false) AND q20 >= 0.02) THEN 'range' ELSE label END AS label
      FROM stk s JOIN fx ON fx.code = s.code AND fx.d = s.d)"""
LABEL = "code:s d:d label:s"


@query(LABEL, f"{REG}, {mean20_sql('m2', 2)}, final AS (SELECT * FROM m2)")
def mean20_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.labels_by(_regimes(spark, sf_dir), "mean20")


@query(LABEL, f"{REG}, {mean60_sql('m6', 2)}, final AS (SELECT * FROM m6)")
def mean60_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.labels_by(_regimes(spark, sf_dir), "mean60")


@query(LABEL, f"{REG}, {STACKED}, final AS (SELECT * FROM stk)")
def stacked_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.labels_by(_regimes(spark, sf_dir), "stacked")


@query(LABEL, f"{REG}, {STRUCTURED}, final AS (SELECT * FROM soft)")
def structured_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.labels_by(_regimes(spark, sf_dir), "structured")


@query(LABEL, f"{REG}, {STRICT}, final AS (SELECT * FROM strict)")
def strict_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.labels_by(_regimes(spark, sf_dir), "strict")


@query(LABEL, f"{REG}, {CROSSES}, final AS (SELECT * FROM crosses)")
def cross_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.labels_by(_regimes(spark, sf_dir), "crosses")


@query(LABEL, f"{REG}, {ADX}, final AS (SELECT * FROM adx_di)")
def directional_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.labels_by(_regimes(spark, sf_dir), "adx_di")


@query(LABEL, f"{REG}, {BANDS}, final AS (SELECT * FROM bands)")
def momentum_band_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.labels_by(_regimes(spark, sf_dir), "momentum_bands")


@query(LABEL, f"{REG}, {HYBRID}, final AS (SELECT * FROM hyb)")
def hybrid_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.labels_by(_regimes(spark, sf_dir), "hybrid")


@query("code:s d:d plus_di:f minus_di:f adx:f", f"{REG}, final AS (SELECT * FROM fx)")
def directional_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regimes(spark, sf_dir)


@query(
    "code:s bar:i match:i",
    f"""{REG}, b AS (SELECT *, row_number() {BY} AS bar, CASE WHEN m20 > m60 THEN 'up' ELSE 'other' END AS sd FROM rw),
    t AS MATERIALIZED (SELECT code, bar, row_number() OVER (PARTITION BY code ORDER BY bar) AS i FROM (SELECT *, lag(raw) {BY} AS p FROM b) WHERE raw <> p),
    p AS MATERIALIZED (SELECT code, bar FROM (SELECT *, lag(sd) {BY} AS q FROM b) WHERE sd <> q),
    pl AS MATERIALIZED (SELECT code, list(bar ORDER BY bar) AS bars FROM p GROUP BY code), e AS (SELECT t.*, coalesce(bars, []) AS bars FROM t LEFT JOIN pl USING (code)),
    g AS (SELECT code, i, bar, list_filter(bars, lambda z: abs(z - bar) <= 10) AS near FROM e),
    f AS (SELECT code, i, bar, list_transform(list_filter([list_min(list_transform(near, lambda z: abs(z - bar) * 1000000 + z))], lambda v: v IS NOT NULL), lambda v: v % 1000000) AS used,
        list_min(list_transform(near, lambda z: abs(z - bar) * 1000000 + z)) % 1000000 AS match FROM g WHERE i = 1
      UNION ALL SELECT g.code, g.i, g.bar, list_concat(f.used, list_transform(list_filter([list_min(list_transform(list_filter(g.near, lambda z: NOT list_contains(f.used, z)), lambda z: abs(z - g.bar) * 1000000 + z))], lambda v: v IS NOT NULL), lambda v: v % 1000000)),
        list_min(list_transform(list_filter(g.near, lambda z: NOT list_contains(f.used, z)), lambda z: abs(z - g.bar) * 1000000 + z)) % 1000000 FROM f JOIN g ON g.code = f.code AND g.i = f.i + 1),
    final AS (SELECT code, bar, match FROM f)""",
)
def regime_switch_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches of the raw label against those of the order of the means."""
    rows = _regimes(spark, sf_dir).withColumns({"bar": w.bar_no(), "side": F.when(F.col("m20") > F.col("m60"), "up").otherwise("other")})
    rows = rows.withColumns({"t": F.col("raw") != F.lag("raw").over(w.by_code()), "p": F.col("side") != F.lag("side").over(w.by_code())})
    return states.switch_matches(rows.where("t"), rows.where("p"))


CALM = "CASE WHEN x.calm AND x.g IS NOT NULL THEN list_append(s.past, abs(x.g)) ELSE s.past END"
WIDTH = f"""CASE WHEN x.calm AND len({CALM}) >= 20 THEN CASE WHEN len(s.ins[-60:]) >= 20 AND list_avg(s.ins[-60:]) > 0.98 THEN least(x.wd, list_aggregate({CALM}, 'quantile_cont', 0.95))
    ELSE greatest(x.wd, list_aggregate({CALM}, 'quantile_cont', 0.5)) END ELSE x.wd END"""
CLAMP = fold_sql(
    "cl", "cw", "g, mid, wd, calm", {"past": "CASE WHEN x.calm AND x.g IS NOT NULL THEN [abs(x.g)] ELSE CAST([] AS DOUBLE[]) END", "ins": "CAST([] AS DOUBLE[])", "width": "CAST(NULL AS DOUBLE)"},
    {"past": CALM, "ins": f"CASE WHEN x.calm AND x.wd IS NOT NULL AND x.g IS NOT NULL THEN list_append(s.ins, CASE WHEN abs(x.g) <= {WIDTH} THEN 1.0 ELSE 0.0 END) ELSE s.ins END", "width": f"CASE WHEN x.wd IS NOT NULL THEN {WIDTH} END"},
)


CALM_ROWS = f"""{bars_sql()}, {panels_sql(['fig9'])}, v AS (SELECT *, CASE WHEN count(r) {over(5)} >= 5 THEN stddev_pop(r) {over(5)} * sqrt(252) END AS rv FROM feat),
    h AS (SELECT *, list(rv) FILTER (WHERE rv IS NOT NULL) {over(252)} AS hist FROM v),
    cm AS (SELECT code, d, coalesce(CASE WHEN len(hist) >= 60 AND rv IS NOT NULL THEN len(list_filter(hist, lambda x: x <= rv)) / len(hist) END <= 0.30, false) AS calm FROM h),
    {EWMA}, z AS (SELECT *, sqrt(v) AS sigma, abs(g / CASE WHEN v > 0 THEN sqrt(v) END) AS z FROM ew),
    cw AS (SELECT z.code, z.d, g, mid, calm, CASE WHEN v > 0 AND mid IS NOT NULL AND count(z) OVER o >= 63 THEN quantile_cont(z, 0.95) OVER o * sigma END AS wd FROM z JOIN cm ON cm.code = z.code AND cm.d = z.d WINDOW o AS (PARTITION BY z.code ORDER BY z.d ROWS UNBOUNDED PRECEDING))"""


@query("code:s d:d lower:f upper:f", f"{CALM_ROWS}, {CLAMP}, final AS (SELECT code, d, mid * exp(-width) AS lower, mid * exp(width) AS upper FROM cl)")
def clamped_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.vol_regime(features.rails(features.fair_path(features.with_logs(derive_bars(spark, sf_dir)), ["fig9"]), ["fig9"]))
    return states.clamped_rails(rows, "fig9_gap", "fig9_path")


RAW = f"greatest(x.wd, CASE WHEN len({CALM}) >= 20 THEN list_aggregate({CALM}, 'quantile_cont', 0.95) ELSE 0 END)"
INFLATED = f"least(CASE WHEN x.calm AND len(s.sc) >= 20 AND list_avg(s.ins) < 0.95 THEN {RAW} * least(4, greatest(1, list_aggregate(s.sc, 'quantile_cont', 0.95))) ELSE {RAW} END, 5)"
SCORED = f"(x.calm AND x.wd IS NOT NULL AND x.g IS NOT NULL AND {RAW} >= 1e-8)"
SCALED = fold_sql(
    "sr", "cw", "g, mid, wd, calm",
    {"past": "CASE WHEN x.calm AND x.g IS NOT NULL THEN [abs(x.g)] ELSE CAST([] AS DOUBLE[]) END", "sc": "CAST([] AS DOUBLE[])", "ins": "CAST([] AS DOUBLE[])", "width": "CAST(NULL AS DOUBLE)"},
    {"past": CALM, "sc": f"CASE WHEN {SCORED} THEN list_append(s.sc, abs(x.g) / {RAW}) ELSE s.sc END",
     "ins": f"CASE WHEN {SCORED} THEN list_append(s.ins, CASE WHEN abs(x.g) <= {INFLATED} THEN 1.0 ELSE 0.0 END) ELSE s.ins END", "width": f"CASE WHEN x.wd IS NOT NULL THEN {INFLATED} END"},
)


@query("code:s d:d lower:f upper:f", f"{CALM_ROWS}, {SCALED}, final AS (SELECT code, d, mid * exp(-width) AS lower, mid * exp(width) AS upper FROM sr)")
def scaled_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.vol_regime(features.rails(features.fair_path(features.with_logs(derive_bars(spark, sf_dir)), ["fig9"]), ["fig9"]))
    return states.scaled_rails(rows, "fig9_gap", "fig9_path")
