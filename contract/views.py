"""SQL views over the driver's tables, the counterparts of ``bindings``."""

from __future__ import annotations

from contract.bindings import FEATURES, NARROW, ONE, PLAN, TARGETS
from curvewalk.functions import numeric
from curvewalk.operators.candidates import KERNELS, NUGGET, PRIORS
from curvewalk.operators.curve import COEFFICIENTS, TENORS
from curvewalk.operators.ridge import ROUNDS
from curvewalk.operators.ridge import TOLERANCE as ROUND_TOLERANCE

NAMES = [name for name, _ in TENORS]

_COEFFICIENTS = """
 0.02e0 + avg(o_totalprice)/1e7 as beta0,
 -0.01e0 - 0.01e0*avg(case when o_orderstatus='F' then 1e0 else 0e0 end) as beta1,
 -0.005e0 + 0.01e0*avg(case when o_orderpriority like '1%' then 1e0 else 0e0 end) as beta2,
 0.3e0 + 0.1e0*avg(case when o_orderstatus='O' then 1e0 else 0e0 end) + 1e-3*least(count(*),50) as lambda_
"""

V1 = f"v1 as (select 'ALL' as series_id, cast(o_orderdate as date) as date, {_COEFFICIENTS} from orders group by cast(o_orderdate as date))"

V2 = f"""v2 as (select *, row_number() over (partition by series_id order by date) - 1 as pos,
  count(*) over (partition by series_id) as pos_total
 from (select c_mktsegment as series_id, cast(o_orderdate as date) as date, {_COEFFICIENTS}
  from orders join customer on o_custkey = c_custkey group by c_mktsegment, cast(o_orderdate as date)) as grouped_rows)"""


def trailing(column: str, rows: int) -> str:
    over = f"(partition by series_id order by date rows between {rows - 1} preceding and current row)"
    return f"case when count({column}) over {over} = {rows} then avg({column}) over {over} end"


_LABELS = ", ".join(
    f"lead({c}, 7) over (partition by series_id order by date) as {t}" for c, t in zip(COEFFICIENTS, TARGETS)
)
_PRESENT = " and ".join(f"{c} is not null" for c in [*FEATURES, *TARGETS])

F3 = f"""{V2}, f3 as (select series_id, date, {', '.join(COEFFICIENTS)},
  lag(beta0) over (partition by series_id order by date) as beta0_lag,
  {trailing('beta0', 5)} as beta0_moving_avg_5, beta1 - beta2 as slope_spread, {_LABELS} from v2)"""

V3 = f"""{F3}, v3 as (select *, row_number() over (partition by series_id order by date) - 1 as pos,
  count(*) over (partition by series_id) as pos_total from f3 where {_PRESENT})"""

V4 = """r4 as (select c_mktsegment as segment, cast(o_orderdate as date) as date, o_orderkey as order_key,
  o_totalprice/1e5 as y_true from orders join customer on o_custkey = c_custkey),
v4 as (select *, row_number() over (partition by segment order by date, order_key) - 1 as pos,
  avg(y_true) over (partition by segment order by date, order_key rows between 10 preceding and 1 preceding) as y_pred,
  stddev_samp(y_true) over (partition by segment order by date, order_key rows between 30 preceding and 1 preceding) as y_std
 from r4),
ok4 as (select *, y_true - y_pred as e, row_number() over (partition by segment order by date, order_key) - 1 as vpos,
  count(*) over (partition by segment) as vtotal from v4 where y_true is not null and y_pred is not null)"""

TENOR_ROWS = "tenors(ordinal, tenor, maturity) as (values " + ", ".join(
    f"({i}, '{name}', {years}e0)" for i, (name, years) in enumerate(TENORS)
) + ")"


def curve_value(maturity: str, prefix: str = "", scale: str = "100e0") -> str:
    b0, b1, b2, lam = (f"{prefix}{c}" for c in COEFFICIENTS)
    slope = f"((1e0 - exp(-{lam}*{maturity}))/({lam}*{maturity}))"
    return f"({b0} + {b1}*{slope} + {b2}*({slope} - exp(-{lam}*{maturity})))*{scale}"


V5 = f"{V1}, {TENOR_ROWS}, v5 as (select series_id, date, ordinal, tenor, maturity, {curve_value('maturity')} as yield_pct from v1 cross join tenors)"

V6 = """e6 as (select vec_id, label, i, cast(embedding[i] as double) as x
  from (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) as opened),
m6 as (select label, i, avg(x) as y from e6 group by label, i),
v6 as (select vec_id, label, sum(x*y) as xy, sum(x*x) as xx, sum(y*y) as yy, sum((x-y)*(x-y)) as gap
  from e6 join m6 using (label, i) group by vec_id, label)"""

_R = PLAN.refit_every
_W = PLAN.window
FOLDS = f"""{V3}, folds as (select distinct series_id, (pos - {_W}) // {_R} as fold,
  {_W} + ((pos - {_W}) // {_R})*{_R} as fit_end from v3 where pos >= {_W})"""
TRAIN = f"""{FOLDS}, train as (select v3.*, fold from v3 join folds on v3.series_id = folds.series_id
  and v3.pos >= fit_end - {_W} and v3.pos < fit_end)"""

PENALTIES = {"small": 1e-4, "medium": 1e-3, "large": 1e-2}
def _symmetric(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def _sweep(rows: str, size: int) -> str:
    """rows with columns s<i>_<j> of a symmetric matrix, which become its negative inverse; pivots' product is its determinant."""

    def s(i: int, j: int) -> str:
        return f"s{min(i, j)}_{max(i, j)}"

    for k in range(size):
        swaps = []
        for i, j in _symmetric(size):
            if i == k == j:
                new = f"-1e0/{s(k, k)}"
            elif k in (i, j):
                new = f"{s(i, j)}/{s(k, k)}"
            else:
                new = f"{s(i, j)} - {s(i, k)}*{s(k, j)}/{s(k, k)}"
            swaps.append(f"{new} as {s(i, j)}")
        rows = f"select * replace ({', '.join(swaps)}), {s(k, k)} as pivot{k} from ({rows}) as swept{k}"
    return rows


def _solved(rows: str, shift: str, size: int) -> str:
    """rows (a<i>_<j>, b<i>) with s, the negative inverse of a + shift on the diagonal, and w, the solution for b."""
    start = ", ".join(f"a{i}_{j}" + (f" + {shift}" if i == j else "") + f" as s{i}_{j}" for i, j in _symmetric(size))
    swept = _sweep(f"select *, {start} from ({rows}) as shifted", size)
    w = [" + ".join(f"s{min(i, j)}_{max(i, j)}*b{j}" for j in range(size)) for i in range(size)]
    return f"select *, {', '.join(f'-({x}) as w{i}' for i, x in enumerate(w))} from ({swept}) as inverted"


def _moments(train: str) -> str:
    """Counts, means and centred product sums of each fold's training rows."""
    found = ["count(*) as n", *[f"avg({x}) as m{i}" for i, x in enumerate(FEATURES)]]
    found += [f"covar_pop({FEATURES[i]}, {FEATURES[j]})*count(*) as a{i}_{j}" for i, j in _symmetric(len(FEATURES))]
    for t in TARGETS:
        found += [f"avg({t}) as m_{t}", f"var_pop({t})*count(*) as yy_{t}"]
        found += [f"covar_pop({x}, {t})*count(*) as b{i}_{t}" for i, x in enumerate(FEATURES)]
    return f"{train}, moments as (select series_id, fold, {', '.join(found)} from train group by series_id, fold)"


_P = len(FEATURES)
_A = ", ".join(f"a{i}_{j}" for i, j in _symmetric(_P))
_B = ", ".join(f"b{i}" for i in range(_P))
_MEANS = ", ".join(f"m{i}" for i in range(_P))
def _systems(train: str) -> str:
    """Moments of one target a row."""
    each = [
        f"select series_id, fold, n, {j} as t, {_MEANS}, m_{t} as y_mean, yy_{t} as yy, {_A}, {', '.join(f'b{i}_{t} as b{i}' for i in range(_P))} from moments"
        for j, t in enumerate(TARGETS)
    ]
    return f"{_moments(train)}, systems as ({' union all '.join(each)})"


def _wide(source: str) -> str:
    """Rows of source (series_id, fold, n, candidate, ordinal, t, intercept, w, ...) with all targets side by side."""
    columns = []
    for j, t in enumerate(TARGETS):
        pick = f"max(case when t = {j} then {{}} end) as {{}}_{t}"
        columns += [pick.format("y_mean - (" + " + ".join(f"w{i}*m{i}" for i in range(_P)) + ")", "w0")]
        columns += [pick.format(f"w{i}", f"w{i + 1}") for i in range(_P)]
    return f"select series_id, fold, candidate, ordinal, max(n) as n, {', '.join(columns)} from {source} group by series_id, fold, candidate, ordinal"


def _fixed() -> str:
    grid = ", ".join(f"('{k}', {i}, {v!r}::double)" for i, (k, v) in enumerate(PENALTIES.items()))
    solved = _solved("select * from systems cross join grid", "penalty", _P)
    return f"{_systems(TRAIN)}, grid(candidate, ordinal, penalty) as (values {grid}), solved as ({solved}), fits as ({_wide('solved')})"


def evidence(train: str) -> str:
    """Evidence maximisation of six priors as a recursion: noise precision al and weight precision la by turns with w."""
    grid = ", ".join(f"('{k}', {i}, {v!r}::double)" for i, (k, v) in enumerate(PRIORS.items()))
    keys = "series_id, fold, candidate, ordinal, prior, t, n, yy, y_mean"
    w, none = [f"w{i}" for i in range(_P)], ", ".join(f"null::double as v{i}" for i in range(_P))
    start = f"select {keys}, {_MEANS}, {_A}, {_B}, 1e0/(yy/n + 2.220446049250313e-16) as al, 1e0 as la, {none}, true as running, 0 as round from systems cross join grid"
    solved = _solved("select * from evidence where running", "la/al", _P)
    ww, wb = " + ".join(f"{x}*{x}" for x in w), " + ".join(f"{x}*b{i}" for i, x in enumerate(w))
    trace = " + ".join(f"s{i}_{i}" for i in range(_P))
    step = f"select *, {ww} as ww, greatest(yy - ({wb}) - la/al*({ww}), 0e0) as sse, {_P} + la/al*({trace}) as gamma from ({solved}) as solved_rows"
    moved = " + ".join(f"abs({x} - v{i})" for i, x in enumerate(w))
    again = f"(v0 is null or {moved} >= {ROUND_TOLERANCE}) and round + 1 < {ROUNDS}"
    more = f"select {keys}, {_MEANS}, {_A}, {_B}, (n - gamma + 2*prior)/(sse + 2*prior) as al, (gamma + 2*prior)/(ww + 2*prior) as la, {', '.join(w)}, {again} as running, round + 1 as round from ({step}) as stepped"
    final = _solved("select * from evidence where not running", "la/al", _P)
    return f"""{_systems(train)}, grid(candidate, ordinal, prior) as (values {grid}), evidence as ({start} union all {more}),
 solved as ({final}), fits as ({_wide('solved')})"""


FIXED_FITS, EVIDENCE_FITS = _fixed(), evidence(TRAIN)
#: One fold a series, before its last row.
LAST = f"""{V3}, folds as (select distinct series_id, 0 as fold, pos_total - 1 as fit_end from v3 where pos_total > {_W}),
 train as (select v3.*, fold from v3 join folds on v3.series_id = folds.series_id and v3.pos >= fit_end - {_W} and v3.pos < fit_end)"""
_EVERY = f"select *, (pos - {_W}) // {_R} as fold from v3 where pos >= {_W}"
_LAST = f"select *, 0 as fold from v3 where pos = pos_total - 1 and pos >= {_W}"
_GUESS = ", ".join(
    f"w0_{t} + " + " + ".join(f"w{i}_{t}*{x}" for i, x in enumerate(FEATURES, 1)) + f" as prediction_{t}" for t in TARGETS
)


def in_sample(fits: str) -> str:
    return f"""{fits}, fitted as (select train.series_id, train.fold, candidate, ordinal, date, pos, {', '.join(TARGETS)}, {_GUESS}
  from train join fits using (series_id, fold))"""


def scores(fits: str) -> str:
    return fitted_scores(in_sample(fits))


def fitted_scores(fitted: str) -> str:
    inner = " + ".join(f"{t}*prediction_{t}" for t in TARGETS)
    yy = " + ".join(f"{t}*{t}" for t in TARGETS)
    pp = " + ".join(f"prediction_{t}*prediction_{t}" for t in TARGETS)
    gap = " + ".join(f"({t}-prediction_{t})*({t}-prediction_{t})" for t in TARGETS)
    r2 = " + ".join(f"1e0 - sum(({t}-prediction_{t})*({t}-prediction_{t}))/nullif(var_pop({t})*count(*), 0)" for t in TARGETS)
    middle = "(" + " + ".join(f"avg({t})" for t in TARGETS) + f")/{len(TARGETS)}"
    flat = " + ".join(f"var_pop({t})*count(*) + count(*)*(avg({t})-{middle})*(avg({t})-{middle})" for t in TARGETS)
    return f"""{fitted}, scores as (select series_id, fold, candidate, ordinal, count(*) as n_train,
  avg(({inner})/(sqrt({yy})*sqrt({pp}))) as cosine_similarity, sqrt(avg({gap})) as euclidean_rmse,
  ({r2})/{len(TARGETS)} as r2_avg, 1e0 - sum({gap})/({flat}) as r2_flat
  from fitted group by series_id, fold, candidate, ordinal)"""


def best(fits: str, metric: str) -> str:
    return best_of(scores(fits), metric)


def best_of(scored: str, metric: str) -> str:
    return f"""{scored}, best as (select * from (select *, row_number() over (partition by series_id, fold
  order by {metric} desc, cosine_similarity desc, ordinal) as place from scores) as placed where place = 1)"""


def ahead(fits: str, metric: str, rows: str = _EVERY) -> str:
    """Predictions of the best candidates for the rows of their folds."""
    actual = ", ".join(f"{t} as actual_{t}" for t in TARGETS)
    return f"""{best(fits, metric)}, ahead as ({rows}),
 predicted as (select series_id, fold, candidate, pos, date, {actual}, {_GUESS}
  from ahead join best using (series_id, fold) join fits using (series_id, fold, candidate))"""


def spread(metric: str = "cosine_similarity", train: str = TRAIN, rows: str = _EVERY) -> str:
    """Standard deviations of the best evidence fits' predictions, by target number: noise and weight uncertainty."""
    away = [f"({x} - m{i})" for i, x in enumerate(FEATURES)]
    form = " + ".join(f"{1 if i == j else 2}*s{i}_{j}*{away[i]}*{away[j]}" for i, j in _symmetric(_P))
    return f"""{ahead(evidence(train), metric, rows)}, spreads as (select series_id, fold, pos, t, sqrt((1e0 - ({form}))/al) as std
  from ahead join best using (series_id, fold) join solved using (series_id, fold, candidate))"""


LAST_SPREAD = spread(train=LAST, rows=_LAST)
SCORES = scores(FIXED_FITS)
IN_SAMPLE = in_sample(FIXED_FITS)
BEST = best(FIXED_FITS, "r2_avg")
AHEAD = ahead(FIXED_FITS, "r2_avg")


def _process() -> str:
    """Exact processes with given hyper-parameters on NARROW windows: their inverses, evidence and training targets."""
    n, c, nu, noise = NARROW.window, ONE.constant[0], ONE.noise[0] + NUGGET, ONE.noise[0]
    o = range(n)
    held = [f"max(case when o = {i} then {x} end) as x{i}_{d}" for i in o for d, x in enumerate(FEATURES)]
    held += [f"max(case when o = {i} then {t} end) as y{i}_{j}" for i in o for j, t in enumerate(TARGETS)]
    gap = lambda a, b: " + ".join(f"({a(d)} - {b(d)})*({a(d)} - {b(d)})" for d in range(_P))
    gaps = [f"{gap(lambda d: f'x{i}_{d}', lambda d: f'x{j}_{d}')} as d{i}_{j}" for i, j in _symmetric(n)]
    kernels = []
    for ordinal, kernel in enumerate(KERNELS):
        value = {"RBF": f"exp(-{{d}}/{2 * ONE.length[0] ** 2!r}::double)", "RationalQuadratic": f"1e0/(1e0 + {{d}}/{2 * ONE.length[0] ** 2!r}::double)"}
        value["ExpSineSquared"] = f"exp(-2e0*power(sin(pi()*sqrt({{d}}))/{ONE.length[0]!r}::double, 2))"
        entries = [f"{c!r}::double*{value[kernel].format(d=f'd{i}_{j}')}" + (f" + {nu!r}::double" if i == j else "") + f" as s{i}_{j}" for i, j in _symmetric(n)]
        kernels.append(f"select *, '{kernel}' as candidate, {ordinal} as ordinal, {', '.join(entries)} from gaps")
        VALUES[kernel] = f"{c!r}::double*{value[kernel]}"
    turned = [
        "-(" + " + ".join(f"s{min(i, k)}_{max(i, k)}*y{k}_{j}" for k in o) + f") as u{i}_{j}" for i in o for j in range(len(TARGETS))
    ]
    misfit = " + ".join(f"y{i}_{j}*u{i}_{j}" for i in o for j in range(len(TARGETS)))
    volume = " + ".join(f"ln(pivot{k})" for k in o)
    evidence = f"-0.5e0*({misfit} + {len(TARGETS)}*({volume} + {n}*ln(2e0*pi())))"
    rows = ", ".join(
        "{" + ", ".join([f"'o': {i}"] + [f"'f{j}': y{i}_{j} - {nu!r}::double*u{i}_{j}" for j in range(len(TARGETS))]) + "}" for i in o
    )
    guess = ", ".join(f"f.f{j} as prediction_{t}" for j, t in enumerate(TARGETS))
    return f"""{V3}, narrow as (select distinct series_id, (pos - {n}) // {NARROW.refit_every} as fold,
  {n} + ((pos - {n}) // {NARROW.refit_every})*{NARROW.refit_every} as fit_end from v3 where pos >= {n}),
 train as (select v3.*, fold, pos - fit_end + {n} as o from v3 join narrow on v3.series_id = narrow.series_id and pos >= fit_end - {n} and pos < fit_end),
 windows as (select series_id, fold, {', '.join(held)} from train group by series_id, fold),
 gaps as (select *, {', '.join(gaps)} from windows),
 inverses as ({_sweep('select * from (' + ' union all '.join(kernels) + ') as matrices', n)}),
 turned as (select *, {', '.join(turned)} from inverses),
 process as (select *, {evidence} as log_marginal_likelihood from turned),
 each as (select series_id, fold, candidate, ordinal, unnest([{rows}]) as f from process),
 fitted as (select series_id, fold, candidate, ordinal, {', '.join(TARGETS)}, {guess}
  from each join (select series_id, fold, o as at_row, {', '.join(TARGETS)} from train) as t using (series_id, fold) where f.o = at_row)"""


def _process_ahead() -> str:
    """Means and standard deviations of the best process of each fold for its rows, one target a row."""
    n, noise = NARROW.window, ONE.noise[0]
    gap = [" + ".join(f"({x} - x{i}_{d})*({x} - x{i}_{d})" for d, x in enumerate(FEATURES)) + f" as g{i}" for i in range(n)]
    near = [
        "case " + " ".join(f"when candidate = '{k}' then {v.format(d=f'g{i}')}" for k, v in VALUES.items()) + f" end as k{i}" for i in range(n)
    ]
    form = " + ".join(f"{1 if i == j else 2}*s{i}_{j}*k{i}*k{j}" for i, j in _symmetric(n))
    spread = f"sqrt({ONE.constant[0]!r}::double + ({form}) + {noise!r}::double)"
    means = [" + ".join(f"k{i}*u{i}_{j}" for i in range(n)) + f" as mean{j}" for j in range(len(TARGETS))]
    long = " union all ".join(
        f"select series_id, date, pos - {n} as k, fold, (pos - {n}) % {NARROW.refit_every} = 0 as retrain, candidate as best_candidate,"
        f" '{t}' as target, {t} as actual, mean{j} as prediction, std as prediction_std from predicted"
        for j, t in enumerate(TARGETS)
    )
    return f"""{best_of(fitted_scores(_process()), "cosine_similarity")},
 ahead as (select *, (pos - {n}) // {NARROW.refit_every} as fold from v3 where pos >= {n}),
 apart as (select ahead.*, process.* exclude (series_id, fold), {', '.join(gap)} from ahead join (select series_id, fold, candidate from best) as b using (series_id, fold)
  join process using (series_id, fold, candidate)),
 close as (select *, {', '.join(near)} from apart),
 predicted as (select *, {', '.join(means)}, {spread} as std from close),
 long as ({long})"""


#: Kernel values of a squared distance d, filled in with the process.
VALUES: dict[str, str] = {}
PROCESS_SCORES = fitted_scores(_process())
PROCESS_LONG = _process_ahead()


def draws(targets: list[str], n: int) -> str:
    def uniform(t: str, tag: str) -> str:
        return f"((('0x'||substr(md5(i||'-{t}-{tag}'),1,8))::bigint + 0.5e0)/4294967296e0)"

    columns = ", ".join(
        f"sqrt(-2e0*ln({uniform(t, 'r')}))*cos(6.283185307179586e0*{uniform(t, 'a')}) as z_{t}" for t in targets
    )
    return f"z as (select i::int as sample_id, {columns} from range({n}) as ids(i))"


def curve_samples(n: int, scale: str) -> str:
    picked = ", ".join(f"{c} + ({scale.format(c=c)})*z_{c} as {c}" for c in COEFFICIENTS)
    return f"{V1}, {TENOR_ROWS}, {draws(COEFFICIENTS, n)}, samples as (select series_id, date, sample_id, {picked} from v1 cross join z)"


def _poly(values: tuple[float, ...], x: str) -> str:
    text = f"{values[0]!r}::double"
    for v in values[1:]:
        text = f"({text}*{x} + {v!r}::double)"
    return text


def normal_quantile(p: str) -> str:
    q = f"(({p}) - 0.5e0)"
    central = f"{_poly(numeric.CENTRAL_NUM, f'({q}*{q})')}*{q}/{_poly(numeric.CENTRAL_DEN, f'({q}*{q})')}"

    def tail(prob: str) -> str:
        t = f"sqrt(-2e0*ln({prob}))"
        return f"{_poly(numeric.TAIL_NUM, t)}/{_poly(numeric.TAIL_DEN, t)}"

    cut = numeric.TAIL_CUT
    return (
        f"case when ({p}) < {cut}e0 then {tail(p)} when ({p}) <= 1e0 - {cut}e0 then {central} "
        f"else -({tail(f'1e0 - ({p})')}) end"
    )


def normal_upper(z: str) -> str:
    x = f"least(abs({z}), 37e0)"
    fraction = f"({x} + 0.65e0)"
    for k in (4, 3, 2, 1):
        fraction = f"({x} + {k}e0/{fraction})"
    near = f"exp(-{x}*{x}/2e0)*{_poly(numeric.NORMAL_NUM, x)}/{_poly(numeric.NORMAL_DEN, x)}"
    far = f"exp(-{x}*{x}/2e0)/{fraction}/sqrt(2e0*pi())"
    tail = f"(case when {x} < {numeric.NORMAL_CUT}e0 then {near} else {far} end)"
    return f"case when ({z}) > 0 then {tail} else 1e0 - {tail} end"
