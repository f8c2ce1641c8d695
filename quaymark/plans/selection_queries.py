"""Queries over swings in hindsight and as confirmed, walk-forward folds and the choice of a labelling method."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.lineage import cut_lineage
from quaymark.operators import selection, stages, states, swings
from quaymark.plans.shape import BY, bars_sql, fold_sql, over, query
from quaymark.plans.signal_queries import REG, _regimes
from quaymark.plans.state_queries import BANDS, CROSSES, STACKED
from quaymark.sources.bars import derive_bars

BARS = bars_sql()
#: The derived bars move less than listed funds do.
PROM, UP, DOWN = 0.05, 0.06, -0.06

TURN = "CASE WHEN x.sm >= x.pv AND x.sm >= x.nx THEN 'H' WHEN x.sm <= x.pv AND x.sm <= x.nx THEN 'L' END"
FURTHER = f"(({TURN}) = 'H' AND x.sm >= s.lp OR ({TURN}) = 'L' AND x.sm <= s.lp)"
SMOOTH = f"""s0 AS (SELECT code, d, close, avg(close) {over(8)} AS sm FROM bars), sx AS (SELECT *, lag(sm) {BY} AS pv, lead(sm) {BY} AS nx FROM s0)"""


def swings_sql(prom: float = PROM, up: float = UP, down: float = DOWN, apart: int = 25, shortest: int = 30, least: int = 60) -> str:
    """Tables up to ``truth``: code, d, label."""
    swap = f"coalesce(({TURN}) <> s.lt AND abs(x.sm - s.lp) / greatest(s.lp, 1e-8) >= {prom} AND x.i - s.li >= {apart}, false)"
    take = f"(({TURN}) IS NOT NULL AND (s.lt IS NULL OR {swap} OR (({TURN}) = s.lt AND {FURTHER})))"
    fold = fold_sql(
        "sw", "sx", "close, sm, pv, nx",
        {"lt": "CAST(NULL AS VARCHAR)", "li": "CAST(1 AS BIGINT)", "lp": "x.sm", "oi": "CAST(NULL AS BIGINT)", "ot": "CAST(NULL AS VARCHAR)"},
        {"lt": f"CASE WHEN {take} THEN {TURN} ELSE s.lt END", "li": f"CASE WHEN {take} THEN x.i ELSE s.li END", "lp": f"CASE WHEN {take} THEN x.sm ELSE s.lp END",
         "oi": f"CASE WHEN {swap} THEN s.li END", "ot": f"CASE WHEN {swap} THEN s.lt END"},
    )
    return f"""{SMOOTH}, {fold},
    p0 AS (SELECT code, oi AS i, ot AS k FROM sw WHERE oi IS NOT NULL UNION ALL SELECT code, li, coalesce(lt, 'L') FROM sw WHERE i = n_rows),
    nn AS (SELECT code, max(i) AS n FROM sw GROUP BY code),
    pt AS (SELECT * FROM p0 UNION ALL SELECT code, 1, CASE WHEN arg_min(k, i) = 'H' THEN 'L' ELSE 'H' END FROM p0 GROUP BY code HAVING min(i) > 1
      UNION ALL SELECT code, n, CASE WHEN arg_max(k, i) = 'L' THEN 'H' ELSE 'L' END FROM p0 JOIN nn USING (code) GROUP BY code, n HAVING max(i) < n),
    pc AS (SELECT pt.code, pt.i, k, close, lead(pt.i) OVER o AS ni, lead(k) OVER o AS nk, lead(close) OVER o AS nc FROM pt JOIN sw_n USING (code, i) WINDOW o AS (PARTITION BY pt.code ORDER BY pt.i)),
    lg AS (SELECT *, CASE WHEN k = 'L' AND nk = 'H' AND nc / close - 1 >= {up} THEN 'up' WHEN k = 'H' AND nk = 'L' AND nc / close - 1 <= {down} THEN 'down' ELSE 'range' END AS lab FROM pc WHERE ni IS NOT NULL),
    ln AS (SELECT *, CASE WHEN lab = lag(lab) OVER o THEN 0 ELSE 1 END AS nw FROM lg WINDOW o AS (PARTITION BY code ORDER BY i)),
    lr AS (SELECT *, sum(nw) OVER (PARTITION BY code ORDER BY i) AS rn FROM ln), rr AS (SELECT code, rn, min(i) AS i, max(ni) AS e, arg_min(lab, i) AS lab FROM lr GROUP BY code, rn),
    rl AS (SELECT code, i, last_value(CASE WHEN e - i + 1 >= {shortest} OR rn = 1 THEN lab END IGNORE NULLS) OVER (PARTITION BY code ORDER BY i) AS lab FROM rr),
    truth AS (SELECT s.code, s.d, CASE WHEN n_rows < {least} THEN 'range' ELSE coalesce(last_value(lab IGNORE NULLS) OVER (PARTITION BY s.code ORDER BY s.i), 'range') END AS label FROM sw_n s LEFT JOIN rl ON rl.code = s.code AND rl.i = s.i)"""


@query("code:s d:d label:s", f"{BARS}, {swings_sql()}, final AS (SELECT * FROM truth)")
def swing_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swings.swing_labels(derive_bars(spark, sf_dir), PROM, up=UP, down=DOWN)


AT = "({t}) IS NOT NULL AND (s.hk IS NULL OR (({t}) = s.hk AND (({t}) = 'H' AND x.p1 >= s.hp OR ({t}) = 'L' AND x.p1 <= s.hp)))".format(t="x.tn")
HI, HK, HP = f"CASE WHEN {AT} THEN x.i - 1 ELSE s.hi END", f"CASE WHEN {AT} THEN x.tn ELSE s.hk END", f"CASE WHEN {AT} THEN x.p1 ELSE s.hp END"
AGED = f"coalesce(x.i - ({HI}) >= 15, false)"
HELD_C = f"(CASE WHEN {AT} THEN x.c1 ELSE s.hc END)"
OTHER = f"({AGED} AND s.dk IS NOT NULL AND s.dk <> ({HK}))"
MOVED = f"({AGED} AND (s.dk IS NULL OR s.dk <> ({HK}) OR (({HK}) = 'H' AND ({HP}) >= s.dc) OR (({HK}) = 'L' AND ({HP}) <= s.dc)))"
CONFIRMED = fold_sql(
    "cf", "sy", "tn, p1, c1",
    {c: f"CAST(NULL AS {k})" for c, k in (("hi", "BIGINT"), ("hk", "VARCHAR"), ("hp", "DOUBLE"), ("hc", "DOUBLE"), ("di", "BIGINT"), ("dk", "VARCHAR"), ("dc", "DOUBLE"), ("b", "BIGINT"), ("e", "BIGINT"), ("lab", "VARCHAR"))},
    {
        "hi": f"CASE WHEN NOT {AGED} THEN {HI} END", "hk": f"CASE WHEN NOT {AGED} THEN {HK} END", "hp": f"CASE WHEN NOT {AGED} THEN {HP} END", "hc": f"CASE WHEN NOT {AGED} THEN {HELD_C} END",
        "di": f"CASE WHEN {MOVED} THEN {HI} ELSE s.di END", "dk": f"CASE WHEN {MOVED} THEN {HK} ELSE s.dk END", "dc": f"CASE WHEN {MOVED} THEN {HELD_C} ELSE s.dc END",
        "b": f"CASE WHEN {OTHER} THEN s.di END", "e": f"CASE WHEN {OTHER} THEN {HI} END",
        "lab": f"""CASE WHEN {OTHER} THEN CASE WHEN ({HI}) - s.di + 1 >= 10 AND ({HK}) = 'H' AND {HELD_C} / greatest(s.dc, 1e-8) - 1 >= {UP} THEN 'up'
          WHEN ({HI}) - s.di + 1 >= 10 AND ({HK}) = 'L' AND {HELD_C} / greatest(s.dc, 1e-8) - 1 <= {DOWN} THEN 'down' ELSE 'range' END END""",
    },
)


# A turn is seen one bar after it, so each row has that of the bar before. Bars count from 0.
@query(
    "code:s first_bar:i last_bar:i label:s known:i",
    f"""{BARS}, {SMOOTH}, st AS (SELECT *, CASE WHEN sm >= pv AND sm >= nx THEN 'H' WHEN sm <= pv AND sm <= nx THEN 'L' END AS t FROM sx),
    sy AS (SELECT code, d, lag(t) {BY} AS tn, lag(sm) {BY} AS p1, lag(close) {BY} AS c1 FROM st), {CONFIRMED},
    final AS (SELECT code, b - 1 AS first_bar, e - 1 AS last_bar, lab AS label, i - 1 AS known FROM cf WHERE lab IS NOT NULL AND n_rows >= 40)""",
)
def confirmed_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swings.confirmed_legs(derive_bars(spark, sf_dir), up=UP, down=DOWN, final=False)


ORDER = ["stacked", "crosses", "bands", "raw"]
LABELLED = f"""{REG}, {STACKED}, {CROSSES}, {BANDS},
    nb AS MATERIALIZED (SELECT rw.code, rw.d, rw.close, rw.raw, stk.label AS stacked, crosses.label AS crosses, bands.label AS bands, row_number() OVER (PARTITION BY rw.code ORDER BY rw.d) - 1 AS i
      FROM rw JOIN stk ON stk.code = rw.code AND stk.d = rw.d JOIN crosses ON crosses.code = rw.code AND crosses.d = rw.d JOIN bands ON bands.code = rw.code AND bands.d = rw.d),
    la AS ({' UNION ALL '.join(f"SELECT code, d, i, close, '{c}' AS candidate, {c} AS label FROM nb" for c in ORDER)})"""
FOLDS = """fn AS (SELECT code, count(*) AS n FROM bars GROUP BY code), fp AS (SELECT *, greatest(20, least(60, (n - 160) // 4)) AS st, greatest(30, CAST(floor(n * 0.7) AS BIGINT)) AS cut FROM fn),
    fs AS (SELECT code, n, st, unnest((range(160, n, st))[-4:]) AS start FROM fp WHERE n >= 180),
    fk AS (SELECT code, start, least(n, start + st) AS stop FROM fs WHERE least(n, start + st) - start >= 10 UNION ALL SELECT code, cut, n FROM fp WHERE n < 180 AND cut < n),
    folds AS (SELECT code, row_number() OVER (PARTITION BY code ORDER BY start) - 1 AS fold, start, stop FROM fk)"""


def hold_sql(name: str, source: str, cost: float) -> str:
    """Table ``name``: metrics of holding while the label is up, of ``source`` (code, fold, candidate, i, close, label)."""
    o = "OVER (PARTITION BY code, fold, candidate ORDER BY i)"
    return f"""{name}_a AS (SELECT *, coalesce(label = 'up', false) AS up, coalesce(lag(label) {o} = 'up', false) AS was, lag(label) {o} AS before FROM {source}),
    {name}_b AS (SELECT *, last_value(CASE WHEN up AND NOT was THEN close END IGNORE NULLS) {o} AS entry FROM {name}_a),
    {name}_c AS (SELECT *, close * {1 - cost} / (entry * {1 + cost}) AS sold FROM {name}_b), {name}_d AS (SELECT *, CASE WHEN NOT up AND was THEN sold - 1 END AS net FROM {name}_c),
    {name}_e AS (SELECT *, exp(coalesce(sum(ln(net + 1)) {o}, 0)) AS wealth FROM {name}_d), {name}_f AS (SELECT *, CASE WHEN up THEN wealth * sold ELSE wealth END AS equity FROM {name}_e),
    {name}_g AS (SELECT *, equity / max(equity) {o} - 1 AS fall FROM {name}_f),
    {name} AS (SELECT code, fold, candidate, count(net) AS n_closed, count(*) FILTER (WHERE net > 0) AS wins, coalesce(avg(net), 0) AS mean_ret, max_by(equity, i) - 1 AS compound,
      max_by(equity, i) - max_by(close, i) / min_by(close, i) AS edge, min(fall) AS worst, avg(CASE WHEN up THEN 1.0 ELSE 0 END) AS exposure, count(*) FILTER (WHERE label <> before) AS switches FROM {name}_g GROUP BY 1, 2, 3)"""


FOLD_METRICS = f"{LABELLED}, {FOLDS}, lf AS (SELECT la.*, fold FROM la JOIN folds f ON f.code = la.code AND i >= start AND i < stop), {hold_sql('hm', 'lf', 0.001)}"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regimes(spark, sf_dir)
    for name, method in (("stacked", "stacked"), ("crosses", "crosses"), ("bands", "momentum_bands")):
        rows = rows.join(states.labels_by(rows, method).withColumnRenamed("label", name), ["code", "d"])
    return selection.by_candidate(rows, ORDER)


def _fold_metrics(labelled: DataFrame, bars: DataFrame) -> DataFrame:
    return selection.hold_metrics(selection.in_folds(labelled, selection.fold_table(bars)))


@query("code:s fold:i start:i stop:i", f"{BARS}, {FOLDS}, final AS (SELECT * FROM folds)")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.fold_table(derive_bars(spark, sf_dir))


@query("code:s fold:i candidate:s n_closed:i wins:i mean_ret:f compound:f edge:f worst:f exposure:f switches:i", f"{FOLD_METRICS}, final AS (SELECT * FROM hm)")
def method_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold_metrics(_labelled(spark, sf_dir), derive_bars(spark, sf_dir))


# The swings' bars are those of REG, so their tables follow it.
SCORES = f"""{swings_sql()}, lw AS (SELECT la.*, 0 AS fold FROM la), {hold_sql('wh', 'lw', 0)},
    sh AS (SELECT la.code, candidate, avg(CASE WHEN la.label = t.label THEN 1.0 ELSE 0 END) AS agree, avg(CASE WHEN la.label = 'up' THEN 1.0 ELSE 0 END) AS us, avg(CASE WHEN la.label = 'range' THEN 1.0 ELSE 0 END) AS rs,
      avg(CASE WHEN la.label IN ('up', 'down') THEN 1.0 ELSE 0 END) AS ds, avg(CASE WHEN t.label = 'range' THEN 1.0 ELSE 0 END) AS tr, avg(CASE WHEN t.label IN ('up', 'down') THEN 1.0 ELSE 0 END) AS td
      FROM la JOIN truth t ON t.code = la.code AND t.d = la.d GROUP BY 1, 2),
    sc AS (SELECT sh.*, compound, switches, 0.45 * compound + 0.25 * agree + 0.15 * us - 0.015 * switches AS score,
      rs >= 0.85 OR (rs >= 0.75 AND rs > tr + 0.35 AND tr >= 0.30) OR (td >= 0.20 AND ds < td * 0.25 AND rs >= 0.65) AS vetoed FROM sh JOIN wh USING (code, candidate))"""
PLACE = f"list_position({ORDER}, candidate)"
BASE = f"""lb_ AS (SELECT code, max(tr) AS tr, max(td) AS td, arg_min(candidate, (vetoed::INT, -round(score, 12), {PLACE})) AS best FROM sc GROUP BY code),
    base AS (SELECT code, CASE WHEN tr >= 0.90 OR td < 0.05 THEN 'stacked' ELSE best END AS baseline FROM lb_)"""


@query("code:s candidate:s score:f agree:f compound:f switches:i vetoed:i", f"{LABELLED}, {SCORES}, final AS (SELECT * FROM sc)")
def method_training_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = swings.swing_labels(derive_bars(spark, sf_dir), PROM, up=UP, down=DOWN)
    return selection.training_scores(_labelled(spark, sf_dir), truth)


@query(
    "code:s baseline:s candidate:s chosen:s accepted:i reason:s posterior:f",
    f"""{FOLD_METRICS}, {SCORES}, {BASE}, fl AS (SELECT *, max(fold) OVER (PARTITION BY code) AS lastf, min(fold) OVER (PARTITION BY code) AS firstf FROM hm),
    pl AS (SELECT code, candidate, sum(n_closed) AS n_closed, sum(wins) AS wins, (sum(wins) + 2.5) / (sum(n_closed) + 5) AS posterior, sum(mean_ret * greatest(n_closed, 1)) / sum(greatest(n_closed, 1)) AS mean_ret,
      avg(edge) AS edge, min(worst) AS worst FROM fl WHERE fold < lastf GROUP BY 1, 2),
    wn AS (SELECT code, arg_min(candidate, (-round(posterior, 12), -round(mean_ret, 12), -round(edge, 12), -n_closed, {PLACE})) AS winner FROM pl WHERE n_closed >= 2 AND mean_ret >= 0 AND worst >= -0.25 GROUP BY code),
    ch0 AS (SELECT base.code, baseline, coalesce(winner, baseline) AS candidate FROM base LEFT JOIN wn ON wn.code = base.code),
    nf AS (SELECT code, max(fold) > min(fold) AS nested FROM hm GROUP BY code),
    cj AS (SELECT c.*, nested, p.posterior, c.candidate = c.baseline AS same, a.n_closed > 0 AND a.mean_ret >= b.mean_ret AND a.edge >= b.edge AND a.worst >= b.worst - 0.02 AS better
      FROM ch0 c LEFT JOIN nf ON nf.code = c.code LEFT JOIN fl a ON a.code = c.code AND a.candidate = c.candidate AND a.fold = a.lastf LEFT JOIN fl b ON b.code = c.code AND b.candidate = c.baseline AND b.fold = b.lastf
      LEFT JOIN pl p ON p.code = c.code AND p.candidate = c.candidate),
    final AS (SELECT code, baseline, candidate, CASE WHEN nested AND (same OR better) THEN candidate ELSE baseline END AS chosen, coalesce(nested, false) AND (same OR coalesce(better, false)) AS accepted,
      CASE WHEN NOT coalesce(nested, false) THEN 'one_fold' WHEN same THEN 'baseline' WHEN better IS NULL THEN 'no_figures' WHEN better THEN 'passed' ELSE 'failed' END AS reason, posterior FROM cj)""",
)
def method_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, labelled = derive_bars(spark, sf_dir), cut_lineage(_labelled(spark, sf_dir))
    truth = swings.swing_labels(bars, PROM, up=UP, down=DOWN)
    baselines = selection.legacy_choice(selection.training_scores(labelled, truth), ORDER, "stacked")
    return selection.nested_choice(_fold_metrics(labelled, bars), baselines, ORDER)


def _stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stage_rows(derive_bars(spark, sf_dir), _regimes(spark, sf_dir).select("code", "d", F.col("raw").alias("label")))


@query("code:s stage:s buy:s exit:s n_trades:i wins:i mean_ret:f mean_net:f compound:f edge:f")
def stage_rule_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.sweep(_stage_rows(spark, sf_dir))


@query("code:s stage:s buy:s exit:s own:f prior:f posterior:f n_trades:i")
def stage_rule_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_lineage(stages.sweep(_stage_rows(spark, sf_dir)))
    return stages.choose(found, stages.pool_prior(found))


@query("code:s n_closed:i win:f compound:f open_ret:f")
def stage_rule_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stage_rows(spark, sf_dir)
    found = cut_lineage(stages.sweep(rows))
    return stages.book_summary(stages.book(rows, stages.choose(found, stages.pool_prior(found))))
