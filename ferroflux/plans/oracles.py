"""DuckDB SQL for the registered queries, stated row by row with plain aggregates."""

from __future__ import annotations

from ..functions import welch
from ..schema import AXES, DB4_LOW, LSB_TO_UT, MATERIALS, SENSORS, WINDOW, feature_names

_CODES = "('fanguangbu', 'tianerong', 'dengxinrong', 'muoshayuyi', 'shawang', 'luowenbu')"

SIGNAL = """signal as (
  select user_id as series, row_number() over w - 1 as i, epoch_us(ts) / 1e6 - epoch_us(first_value(ts) over w) / 1e6 as t_0,
         (epoch_us(ts) - epoch_us(first_value(ts) over w)) / 1e6 as t_s, value - 40 as X, cast(props ->> '$.k' as double) - 50 as Y,
         coalesce((epoch_us(ts) - epoch_us(lag(ts) over w)) / 1e6, 0) / 3600 as Z
  from events window w as (partition by user_id order by ts, event_id))"""

CLIPPED = """bounds as (select series, quantile_cont(X, 0.01) x1, quantile_cont(X, 0.99) x2, quantile_cont(Y, 0.01) y1, quantile_cont(Y, 0.99) y2,
  quantile_cont(Z, 0.01) z1, quantile_cont(Z, 0.99) z2, count(*) as n from signal group by series),
clipped as (select series, i, n, least(greatest(X, x1), x2) as X, least(greatest(Y, y1), y2) as Y, least(greatest(Z, z1), z2) as Z
  from signal join bounds using (series))"""

STARTS = "starts as (select series, unnest(range(0, n - 50, 25)) as win_start from (select series, count(*) as n from signal group by series))"

WINDOWS = f"""{STARTS},
cut as (select c.series, s.win_start, c.i - s.win_start as p, unnest([{{'a': 'X', 'v': X}}, {{'a': 'Y', 'v': Y}}, {{'a': 'Z', 'v': Z}}], recursive := true)
  from clipped c join starts s on c.series = s.series and c.i >= s.win_start and c.i < s.win_start + 50),
edge as (select series, win_start, a, quantile_cont(v, 0.01) lo, quantile_cont(v, 0.99) hi from cut group by all),
w as (select series, win_start, a, p, least(greatest(v, lo), hi) as v from cut join edge using (series, win_start, a)),
d as (select *, v - lag(v) over q as dv, lag(v) over q as pv, avg(v) over (partition by series, win_start, a) as m from w
  window q as (partition by series, win_start, a order by p))"""

BASE = f"with {SIGNAL}, {CLIPPED}, {WINDOWS}"


def _clean(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def _time_values() -> dict[str, str]:
    m2 = "avg((v - m) * (v - m))"
    return {
        "t0": "avg(v)", "t1": f"sqrt({m2})", "t2": "min(v)", "t3": "max(v)", "t4": "max(v) - min(v)",
        "t5": f"case when {m2} > 0 then avg(pow(v - m, 3)) / pow({m2}, 1.5) else 'nan'::double end",
        "t6": f"case when {m2} > 0 then avg(pow(v - m, 4)) / pow({m2}, 2) - 3 else 'nan'::double end",
        "t7": "sum(v * v)", "t8": "sum(abs(dv))", "t9": "sum(dv * dv)", "t10": "sum(case when (v < 0) <> (pv < 0) then 1.0 else 0.0 end)",
        "t11": "quantile_cont(v, 0.25)", "t12": "quantile_cont(v, 0.75)", "t13": "quantile_cont(v, 0.5)", "t14": "avg(abs(v))",
    }


def _time_table() -> str:
    return "select series, win_start, a, " + ", ".join(f"{v} as {k}" for k, v in _time_values().items()) + " from d group by series, win_start, a"


def _numbers(rows: list[list[float]]) -> str:
    return "(values " + ", ".join(f"({k}, {p}, {v!r}::double)" for k, row in enumerate(rows) for p, v in enumerate(row) if v) + ")"


def _spectral_table() -> str:
    cos, sin, scale, bins = welch(WINDOW)
    scales = "(values " + ", ".join(f"({k}, {s!r}::double, {f!r}::double)" for k, (s, f) in enumerate(zip(scale, bins))) + ")"
    psd = f"""psd as (select series, win_start, a, k, f, s * (re * re + im * im) as p from
      (select series, win_start, a, k, sum((v - m) * c) as re from d join {_numbers(cos)} t(k, p, c) using (p) group by all)
      join (select series, win_start, a, k, sum((v - m) * c) as im from d join {_numbers([[x or 1e-300 for x in r] for r in sin])} t(k, p, c) using (p) group by all)
      using (series, win_start, a, k) join {scales} b(k, s, f) using (k))"""
    share = lambda part: f"coalesce({part} / nullif(sum(p), 0), 0)"
    low, mid, high = "sum(p) filter (where f < 10)", "sum(p) filter (where f >= 10 and f < 50)", "sum(p) filter (where f >= 50)"
    values = ["sum(p)", low, mid, high, share(low), share(mid), share(high), "arg_max(f, (p, -k))", "-sum(p * log2(p + 1e-10))", "avg(p)", "stddev_pop(p)", "max(p)"]
    return psd, "select series, win_start, a, " + ", ".join(f"{v} as f{i}" for i, v in enumerate(values)) + " from psd group by series, win_start, a"


def _wavelet_table() -> str:
    """Two levels of the filter bank, each a sum over the taps of the mirrored signal."""
    low = ", ".join(f"({j}, {v!r}::double, {(-1) ** (j + 1) * DB4_LOW[7 - j]!r}::double)" for j, v in enumerate(DB4_LOW))

    def level(source: str, n: int) -> str:
        at = f"(2 * k + 1 - j + {2 * n}) % {2 * n}"
        return f"""select series, win_start, a, k, sum(v * h) as y, sum(v * g) as z from (
          select k, j, h, g, case when {at} < {n} then {at} else {2 * n - 1} - {at} end as p from range({(n + 7) // 2}) r(k), (values {low}) t(j, h, g))
          join {source} using (p) group by all"""

    first = f"({level('d', WINDOW)})"
    second = f"({level(f'(select series, win_start, a, k as p, y as v from {first})', (WINDOW + 7) // 2)})"
    parts = []
    for g, (source, c) in enumerate(((second, "y"), (second, "z"), (first, "z"))):
        values = [f"avg({c})", f"stddev_pop({c})", f"min({c})", f"max({c})", f"sum({c} * {c})"]
        parts.append(f"(select series, win_start, a, {', '.join(f'{v} as w{5 * g + i}' for i, v in enumerate(values))} from {source} group by series, win_start, a)")
    return f"select * from {parts[0]} join {parts[1]} using (series, win_start, a) join {parts[2]} using (series, win_start, a)"


def _long(table: str, names: list[str], extra: str = "") -> str:
    pairs = ", ".join(f"{{'k': '{n}', 'v': {n}}}" for n in names)
    return f"{BASE}{extra}, f as ({table}), l as (select series, win_start, a, unnest([{pairs}], recursive := true) from f) select series, win_start, a || '_' || k as feature, {_clean('v')} as value from l"


def _wide() -> str:
    psd, spectral = _spectral_table()
    names = [f"t{i}" for i in range(15)] + [f"f{i}" for i in range(12)] + [f"w{i}" for i in range(15)]
    columns = ", ".join(f"{_clean(f'max({n}) filter (where a = {chr(39)}{a}{chr(39)})')} as {a}_{n}" for a in AXES for n in names)
    return f"""{BASE}, {psd}, t as ({_time_table()}), f as ({spectral}), w_ as ({_wavelet_table()}),
    every as (select * from t join f using (series, win_start, a) join w_ using (series, win_start, a)), {_MATERIALS}
    select series, win_start, label, {columns} from every join (select label, row_number() over (order by label) - 1 as k from materials) on series % 8 = k
    group by series, win_start, label"""


_MATERIALS = "materials(label, code, english) as (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in MATERIALS) + ")"


def _lines() -> str:
    n = lambda k: f"cast(event_id * {k + 7} % 401 - 200 as varchar)"
    ms = "cast(event_id * 100 as varchar)"
    seventeen = " || ' ' || ".join([ms, *map(n, range(16))])
    bad = " || ' ' || ".join([ms, "'abc'", *map(n, range(1, 16))])
    twenty = " || ' ' || ".join(x for s in range(SENSORS) for x in (ms if s == 0 else "'stamp'", "'warm'", *[n(4 * s + a) for a in (1, 2, 3)]))
    return f"""lines as (select cast(user_id as varchar) as session, event_id as seq, case when event_id % 10 <= 3 then {seventeen} when event_id % 10 <= 5 then {twenty}
      when event_id % 10 = 6 then {bad} when event_id % 10 = 7 then {ms} || '  ' || {n(1)} || '  ' || {n(2)} when event_id % 10 = 8 then '# note ' || {ms} else '   ' end as value from events),
    tokens as (select *, string_split_regex(trim(value), '\\s+') as tok from lines where trim(value) <> '' and not starts_with(trim(value), '#')),
    judged as (select *, case when len(tok) not in (17, 20) then 'count' when len(tok) = 17 and len(list_filter(tok, lambda x: try_cast(x as double) is null)) > 0 then 'number' end as reason from tokens)"""


def _values(sensors) -> str:
    place = lambda s, a: f"cast(case when len(tok) = 20 then tok[{5 * s + a + 3}] else tok[{4 * s + a + 3}] end as double)"
    return ", ".join(f"{{'sensor': {s}, 'axis': '{name}', 'raw': {place(s, a)}}}" for s in sensors for a, name in enumerate(AXES))


def _parsed(sensors) -> str:
    return f"""with {_lines()}, good as (select session, seq, cast(tok[1] as double) as ms, unnest([{_values(sensors)}], recursive := true) from judged where reason is null)
    select session, seq, ms, sensor, axis, raw, {_clean(f'raw * {LSB_TO_UT}')} as ut from good"""


def _elapsed() -> str:
    return f"with {_lines()}, good as (select *, cast(tok[1] as double) as ms from judged where reason is null), timed as (select *, (ms - min(ms) over (partition by session)) / 1000 as t_s from good)"


SCORED = "scored as (select doc_id, cast(quality as varchar) as actual, case when n_chars / (n_chars + 2000.0) >= 0.5 then '1' else '0' end as predicted, n_chars::double / (n_chars + 2000.0::double) as score from documents join labels using (doc_id))"
CONFUSION = f"{SCORED}, classes as (select actual as c from scored union select predicted from scored), pairs as (select x.c as label, y.c as prediction, count(actual) as n from classes x cross join classes y left join scored on actual = x.c and predicted = y.c group by all)"
ROC = f"""{SCORED}, one as (select '1' as class, score, actual = '1' as positive from scored union all select '0', 1 - score, actual = '0' from scored),
  steps as (select class, score, count(*) filter (where positive) as p, count(*) filter (where not positive) as n from one group by all),
  curve as (select class, score as threshold, sum(p) over r as tp, sum(n) over r as fp, sum(p) over r / sum(p) over (partition by class) as tpr, sum(n) over r / sum(n) over (partition by class) as fpr
    from steps window r as (partition by class order by score desc rows unbounded preceding))"""
POOLED = "unnest([{'axis': 'X', 'v': X}, {'axis': 'Y', 'v': Y}, {'axis': 'Z', 'v': Z}], recursive := true)"


def _trailing(n: int) -> str:
    return f"back as (select *, row_number() over (partition by series order by i desc) as b, count(*) over (partition by series) as n from signal), last as (select series, i, {POOLED} from back where b <= {n} and n > 5)"


def _vectors(n: int) -> str:
    return "vectors as (select vec_id, label, " + ", ".join(f"embedding[{i + 1}]::double as v{i}" for i in range(n)) + " from embeddings)"


def _importances(n: int = 64) -> str:
    pairs = ", ".join(f"{{'feature': 'v{i}', 'idx': {i}, 'v': v{i}}}" for i in range(n))
    return f"with {_vectors(n)}, l as (select unnest([{pairs}], recursive := true) from vectors) select feature, idx, round(var_pop(v), 6) as importance from l group by all order by importance desc, idx desc"


def _split(legacy: bool) -> str:
    offset = "0" if legacy else "head"
    return f"""with n as (select user_id as series, count(*) * 8 as n from events group by all), h as (select *, floor(n * 0.8::double)::bigint as head from n)
    select series, unnest(range(0, head - 50, 25)) as win_start, 'train' as split from h union all
    select series, unnest(range(0, n - head - 50, 25)) + {offset}, 'test' from h"""


def oracle_sql() -> dict[str, str]:
    psd, spectral = _spectral_table()
    pick = lambda k: f"{_list()}[({k}) % 6 + 1]"
    files = f"""files as (select case when c_custkey % 7 = 0 then 'log_' || c_custkey || '_none_05.csv' when c_custkey % 9 = 0 then 'x_' || {pick('c_custkey')} || '_' || {pick('c_custkey + 1')} || '_' || c_custkey || '.csv'
      else 'log_sensor0_' || {pick('c_custkey')} || '_' || c_custkey || '.csv' end as file_name from customer), {_MATERIALS},
      matched as (select * from files join materials on file_name like '%\\_' || code || '\\_%.csv' escape '\\')"""
    scaled = ", ".join(f"{_clean(f'coalesce((v{i} - avg(v{i}) over ()) / nullif(stddev_pop(v{i}) over (), 0), 0)')} as v{i}" for i in range(64))
    vector_pairs = ", ".join(f"{{'k': 'v{i}', 'v': v{i}}}" for i in range(64))
    corr = f"l as (select vec_id, unnest([{vector_pairs}], recursive := true) from vectors) select x.k as a, y.k as b, {_clean('corr(x.v, y.v)')} as r from l x join l y using (vec_id) group by all"
    train = ", ".join(f"{_clean(f'coalesce((v{i} - avg(v{i}) filter (where vec_id % 2 = 0) over ()) / nullif(stddev_pop(v{i}) filter (where vec_id % 2 = 0) over (), 0), 0)')} as v{i}" for i in range(64))
    cell = lambda n: f"(event_id % {n})"
    logs = f"logs as (select user_id, 'log_' || user_id || '.csv' as file_name, event_id, row_number() over (partition by user_id order by event_id) - 1 as i, user_id % 5 as kind, user_id % 5 = 3 and event_id % 11 = 0 as bad from events)"
    wide = ", ".join(f"cast(case when len(tok) = 20 then tok[{5 * k + a + 3}] else tok[{4 * k + a + 3}] end as double) as S{k}_{n}" for k in range(SENSORS) for a, n in enumerate(AXES))
    feature_pairs = ", ".join(f"{{'k': '{c}', 'v': {c}}}" for c in feature_names())
    masks = f"with {_vectors(64)}, l as (select vec_id % 5 <> 0 as train, unnest([{vector_pairs}], recursive := true) from vectors), c as (select train, k, case when k = 'v1' and train or k = 'v2' and not train then 1.0 else v end as v from l), kept as (select k as feature, coalesce(max(v) filter (train) > min(v) filter (train), false) as train, coalesce(max(v) filter (not train) > min(v) filter (not train), false) as test from c group by k)"
    return {
        "parse_all": _parsed(range(SENSORS)),
        "parse_one_sensor": _parsed([2]),
        "parse_rejects": f"with {_lines()} select session, seq, value as line, reason from judged where reason is not null",
        "reject_counts": f"with {_lines()} select coalesce(reason, 'accepted') as outcome, count(*) as n from judged group by all",
        "parse_wide": f"{_elapsed()} select session, seq, ms, {_clean('t_s')} as t_s, {wide} from timed",
        "duration_limit": f"{_elapsed()} select session, seq, {_clean('t_s')} as t_s, floor(t_s)::bigint || '/600s' as banner from timed where t_s <= 600",
        "simulated": f"with r as (select i * 100.0::double as ms, unnest(range(4))::int as sensor from (select event_id as i from events)), a as (select *, ms / 1000 + sensor * pi() / 2 as angle from r) select ms, sensor, {_clean('100 * sin(angle)')} as X, {_clean('100 * cos(angle)')} as Y, {_clean('50 * sin(2 * angle)')} as Z from a",
        "clipped": f"with {SIGNAL}, {CLIPPED} select series, i, {', '.join(f'{_clean(a)} as {a}' for a in AXES)} from clipped",
        "window_index": f"with {SIGNAL}, {STARTS} select g.series, win_start, count(*) as n, min(i) as first_i, max(i) as last_i from signal g join starts s on g.series = s.series and i >= win_start and i < win_start + 50 group by all",
        "time_features": _long(_time_table(), [f"t{i}" for i in range(15)]),
        "spectral_features": _long(spectral, [f"f{i}" for i in range(12)], f", {psd}"),
        "wavelet_features": _long(_wavelet_table(), [f"w{i}" for i in range(15)]),
        "feature_matrix": _wide(),
        "feature_variance": f"with m as ({_wide()}), l as (select unnest([{feature_pairs}], recursive := true) from m), v as (select k as feature, case when count(*) filter (where isnan(v)) > 0 then 'nan'::double else var_pop(case when isnan(v) then null else v end) end as var from l group by k) select feature, case when var < 1e6 then round(var, 4) else round(var, -2) end as var, var > 0 and not isnan(var) as kept from v",
        "feature_correlation": f"with m as ({_wide()}), l as (select series, win_start, unnest([{feature_pairs}, {{'k': 'flat', 'v': 0.1::double}}], recursive := true) from m), odd as (select k, min(v) = max(v) or count(*) filter (where isnan(v)) > 0 as odd from l group by k), p as (select x.k as a, y.k as b, x.v as s, y.v as t from l x join l y using (series, win_start) where x.k not in (select k from odd where odd) and y.k not in (select k from odd where odd)) select a, b, {_clean('greatest(-1, least(1, corr(s, t)))')} as r from p group by all union all select x.k, y.k, 'nan'::double from odd x cross join odd y where x.odd or y.odd",
        "vector_scaling": f"with {_vectors(64)} select vec_id, label, {scaled} from vectors",
        "vector_correlation": f"with {_vectors(64)}, {corr}",
        "scaled_split": f"with {_vectors(64)} select vec_id, label, {train} from vectors",
        "split_masks": f"{masks} select feature, train, train as test from kept",
        "split_masks_legacy": f"{masks} select feature, train, test from kept",
        "log_guard": f"with {logs} select file_name, count(*) as n from logs where kind <> 2 group by file_name",
        "log_quarantine": f"with {logs} select '/logs/' || file_name as file, count(*) as cells from logs where bad group by file_name",
        "log_decoded": f"with {logs} select file_name, i, event_id::double as X, {cell(7)}::double as Y, {cell(5)}::double as Z from logs where kind <> 2 and user_id not in (select user_id from logs where bad)",
        "inverse_scale": _parsed(range(SENSORS)).replace("select session, seq, ms, sensor, axis, raw, ", "select session, seq, sensor, axis, ").replace(f"raw * {LSB_TO_UT}", f"raw * {LSB_TO_UT} / {LSB_TO_UT}").replace("as ut from good", "as raw from good"),
        "data_received": "with l as (select cast(event_id % 40 as varchar) as session, event_id % 10 < 8 as data from events) select session, count(*) filter (where data) as lines, count(*) filter (where data) > 0 as received, case when count(*) filter (where data) > 0 then 'receiving data' else 'waiting for data' end as message from l group by session",
        "device_state": "with c as (select user_id as session, event_id as seq, case when event_id % 5 = 0 then 'g' when event_id % 7 = 0 then 's' end as word from events) select session, seq, coalesce(last_value(word ignore nulls) over (partition by session order by seq) = 'g', false) as streaming from c",
        "log_names": "select user_id as session, 'log_' || strftime(min(ts), '%Y%m%d_%H%M%S') || '.csv' as name from events group by user_id",
        "label_codes": f"with {_MATERIALS}, m as (select label, row_number() over (order by label) - 1 as k from materials), seen as (select distinct label from events join m on user_id % 8 = k) select label, row_number() over (order by label) - 1 as code from seen",
        "random_split": "select vec_id, label, case when row_number() over (partition by label order by (vec_id * 7919 + 42) % 104729, vec_id) <= round(count(*) over (partition by label) * 0.2) then 'test' else 'train' end as split from embeddings",
        "temporal_split": _split(False),
        "temporal_split_legacy": _split(True),
        "prefix_suffix": "with n as (select user_id as series, count(*) as n from events group by all) select series, n, floor(n * 0.8::double)::bigint as head, n - floor(n * 0.8::double)::bigint as tail from n",
        "confusion": f"with {CONFUSION} select label, prediction, n from pairs",
        "report": f"""with {CONFUSION}, e as (select c, sum(n) filter (where label = c) as support, sum(n) filter (where prediction = c) as told, sum(n) filter (where label = c and prediction = c) as hits from classes, pairs group by c),
          s as (select c, support, coalesce(hits / nullif(told, 0), 0) as precision, coalesce(hits / nullif(support, 0), 0) as recall, hits from e), f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from s)
          select c as class, {_clean('precision')} as precision, {_clean('recall')} as recall, {_clean('f1')} as f1, support::bigint as support from f
          union all select 'accuracy', {_clean('sum(hits) / sum(support)')}, {_clean('sum(hits) / sum(support)')}, {_clean('sum(hits) / sum(support)')}, sum(support)::bigint from f
          union all select 'macro avg', {_clean('avg(precision)')}, {_clean('avg(recall)')}, {_clean('avg(f1)')}, sum(support)::bigint from f
          union all select 'weighted avg', {_clean('sum(precision * support) / sum(support)')}, {_clean('sum(recall * support) / sum(support)')}, {_clean('sum(f1 * support) / sum(support)')}, sum(support)::bigint from f""",
        "roc": f"with {ROC} select class, {_clean('threshold', 9)} as threshold, tp::bigint as tp, fp::bigint as fp, {_clean('tpr', 9)} as tpr, {_clean('fpr', 9)} as fpr from curve",
        "auc": f"with {ROC}, s as (select class, (fpr - coalesce(lag(fpr) over w, 0)) * (tpr + coalesce(lag(tpr) over w, 0)) / 2 as part from curve window w as (partition by class order by threshold desc)) select class, {_clean('sum(part)')} as auc from s group by class",
        "probability_histogram": f"with {SCORED}, p as (select actual as class, floor(score * 4096) as p from scored), b as (select *, min(p) over (partition by class) as lo, max(p) over (partition by class) as hi from p) select class, least(floor((p - lo) / (hi - lo) * 50) + 1, 50)::int as bin, count(*) as n from b group by all",
        "learning_summary": f"with f as (select event_id % 10 as size, value as train, value / 2 + user_id % 3 as validation from events) select size, {', '.join(f'{_clean(f"{g}({c})")} as {c}_{n}' for c in ('train', 'validation') for n, g in (('mean', 'avg'), ('std', 'stddev_pop')))} from f group by size",
        "top_features": f"{_importances()} limit 20",
        "top_features_ascending": f"select * from ({_importances()} limit 10) order by importance, idx",
        "pooled_stats": f"with {SIGNAL}, {_trailing(30)} select series, {_clean('avg(v)')} as mean, {_clean('stddev_pop(v)')} as std, {_clean('min(v)')} as low, {_clean('max(v)')} as high, count(*) as n from last group by series",
        "three_sigma": f"with {SIGNAL}, l as (select series, {POOLED} from signal), m as (select *, avg(v) over q as m, stddev_pop(v) over q as s from l window q as (partition by series, axis)) select series, axis, count(*) as n, {_clean('sum(v)')} as total from m where abs(v - m) < 3 * s group by all",
        "axis_range": f"""with {SIGNAL}, {_trailing(40)}, m as (select *, avg(v) over q as m, stddev_pop(v) over q as s from last window q as (partition by series)),
          r as (select series, min(v) as dmin, max(v) as dmax from m where abs(v - m) < 3 * s group by series), p as (select *, greatest(20, 0.2 * (dmax - dmin)) as pad from r)
          select series, {_clean('dmin')} as dmin, {_clean('dmax')} as dmax, {_clean('pad')} as pad, {_clean('greatest(-150, least(-20, dmin - pad))')} as ymin, {_clean('least(150, greatest(20, dmax + pad))')} as ymax from p""",
        "recent_view": f"with {SIGNAL}, d as (select series, i, t_s / 86400 as t_s from signal), m as (select *, max(t_s) over (partition by series) as latest from d) select series, i, {_clean('t_s')} as t_s from m where t_s >= trunc(greatest(0, latest - 10)) and t_s <= latest + 5",
        "retained": f"with {SIGNAL}, b as (select *, row_number() over (partition by series order by i desc) as b from signal) select series, count(*) as n, min(i) as first_i, max(i) as last_i from b where b <= 60 group by series",
        "decimated": f"with {SIGNAL}, c as (select series, i, count(*) over (partition by series) as n from signal) select series, i from c where n <= 60 or i >= 20 or i % 2 = 0",
        "markers": f"with {SIGNAL}, c as (select series, i, row_number() over (partition by series order by i desc) as b, least(20, count(*) over (partition by series)) as n from signal) select series, i from c where b <= 20 and (n - b) % 4 = 0",
        "segments": f"with {SIGNAL}, c as (select series, i, count(*) over (partition by series) as n from signal) select series, least(i // greatest(1, n // 5), 4)::int as segment, count(*) as n, min(i) as first_i from c group by all",
        "file_materials": f"with {files} select file_name, label, code, english from matched",
        "missing_materials": f"with {files} select label, code, english from materials where code not in (select code from matched)",
        "english_names": f"with {_MATERIALS}, e as (select case when user_id % 3 = 0 then '纱网布' else event_type end as label from events) select e.label, coalesce(english, e.label) as english, count(*) as n from e left join materials m on e.label = m.label group by all",
        "dataset_shape": f"with {SIGNAL}, {STARTS}, {_MATERIALS}, m as (select label, english, row_number() over (order by label) - 1 as k from materials) select label, english, count(*) as windows, count(distinct series) as series from starts join m on series % 8 = k group by all",
    }


def _list() -> str:
    return "[" + _CODES[1:-1] + "]"
