"""The same queries as plain SQL over the star-schema tables, for checking.

Each text is independent of the Spark code: global sorts, row numbers and cross
joins are fine here, because the checking engine runs on small data.
"""

from __future__ import annotations

import hashlib
import math

from ..functions import rules
from ..operators import augment as augmenting
from ..operators.evaluate import report_parts
from ..schema import RISKY_TYPES

SEED = 42
RAW = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]

TX = """
k as (
  select l.*, o.o_custkey, o.o_orderpriority, c.c_acctbal, s.s_acctbal,
         md5(concat_ws('|', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar),
             cast(l_suppkey as varchar), cast(cast(round(l_extendedprice*100) as bigint) as varchar))) as txn_id
  from lineitem l join orders o on l_orderkey=o_orderkey
                  join customer c on o_custkey=c_custkey
                  join supplier s on l_suppkey=s_suppkey),
b as (
  select *, ('0x'||substr(txn_id,1,8))::BIGINT as h,
         case o_orderpriority when '1-URGENT' then 'CASH_OUT' when '2-HIGH' then 'PAYMENT'
              when '3-MEDIUM' then 'CASH_IN' when '4-NOT SPECIFIED' then 'TRANSFER' else 'DEBIT' end as type,
         round(l_extendedprice*10,2) as amount,
         cast(1 + (datediff('day', date '1995-01-01', l_shipdate::date)*24 + cast(l_quantity as int)) % 743 as int) as step
  from k),
f as (
  select *,
         case when type in ('TRANSFER','CASH_OUT') and l_returnflag='R' then 1 else 0 end as drain,
         case when type in ('TRANSFER','CASH_OUT') and l_returnflag='R'
               and ((l_linestatus='F' and h % 10 < 8) or (l_linestatus='O' and h % 10 = 0))
              then 1 else 0 end as isFraud
  from b),
g as (
  select *,
         case when drain=1 then amount else round((c_acctbal+1000)*100,2) end as oldbalanceOrg,
         case when l_linestatus='F' then 0.0e0 else round((s_acctbal+1000)*100,2) end as oldbalanceDest
  from f),
tx as (
  select txn_id, step, type, amount,
       concat('C',cast(o_custkey as varchar)) as nameOrig, oldbalanceOrg,
       case when type='CASH_IN' then round(oldbalanceOrg+amount,2)
            else greatest(round(oldbalanceOrg-amount,2),0.0e0) end as newbalanceOrig,
       concat(case when type='PAYMENT' then 'M' else 'C' end, cast(l_suppkey as varchar)) as nameDest, oldbalanceDest,
       case when drain=1 and floor(h/10) % 10 < 6 then oldbalanceDest
            when type='CASH_IN' then greatest(round(oldbalanceDest-amount,2),0.0e0)
            else round(oldbalanceDest+amount,2) end as newbalanceDest,
       isFraud, case when isFraud=1 and amount>200000 then 1 else 0 end as isFlaggedFraud
  from g)
""".strip()

RISKY = "(" + ", ".join(f"'{t}'" for t in RISKY_TYPES) + ")"
DRAINED = "(oldbalanceOrg > 0 and newbalanceOrig = 0)"
SCORED = f"""
scored as (
  select *, cast(p > 0.5 as int) as prediction from (
    select *, round(1/(1+exp(-(-5.0e0 + 2.5e0*(type in {RISKY})::int + 2.0e0*{DRAINED}::int
        + 2.0e0*(newbalanceDest = oldbalanceDest)::int - 1.0e0*(amount < 100000)::int))),6) as p from tx))
""".strip()
MEMBERS = f"""
members as (
  select txn_id, isFraud, p as base,
         round(1/(1+exp(-(-3.0e0 + amount/250000 - 2.0e0*(type not in {RISKY})::int))),6) as by_amount,
         round(1/(1+exp(-(-4.0e0 + 1.5e0*(type in {RISKY})::int + 1.5e0*{DRAINED}::int
             + 3.0e0*(newbalanceDest = oldbalanceDest)::int))),6) as by_rules
  from scored),
long as (unpivot members on base, by_amount, by_rules into name model value p)
""".strip()


def _sql(*ctes: str, select: str) -> str:
    return "with " + ",\n".join([TX, *ctes]) + "\n" + select


def _q(select: str) -> str:
    return _sql(select=select)


def _s(select: str, *ctes: str) -> str:
    return _sql(SCORED, *ctes, select=select)


def _ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::double / nullif(({b})::double, 0), 0)"


def _r(value: str, name: str, digits: int = 6) -> str:
    return f"round({value}, {digits}) as {name}"


def _threshold(tp="tp", fp="fp", fn="fn", tn="tn") -> dict[str, str]:
    return {
        "accuracy": _ratio(f"{tp}+{tn}", f"{tp}+{tn}+{fp}+{fn}"),
        "precision": _ratio(tp, f"{tp}+{fp}"),
        "recall": _ratio(tp, f"{tp}+{fn}"),
        "f1_score": _ratio(f"2*{tp}", f"2*{tp}+{fp}+{fn}"),
        "mcc": _ratio(
            f"{tp}::double*{tn}-{fp}::double*{fn}",
            f"sqrt(({tp}+{fp})::double*({tp}+{fn})*({tn}+{fp})*({tn}+{fn}))",
        ),
        "specificity": _ratio(tn, f"{tn}+{fp}"),
        "false_positive_rate": _ratio(fp, f"{fp}+{tn}"),
    }


def _metric_ctes(source: str, by: str) -> str:
    """Per group ``by``: confusion counts, tie-aware AUC by pair counting, step-sum AP."""
    return f"""
cf as (select {by} as model, count(*) filter (isFraud=0 and p<=0.5) as tn, count(*) filter (isFraud=0 and p>0.5) as fp,
              count(*) filter (isFraud=1 and p<=0.5) as fn, count(*) filter (isFraud=1 and p>0.5) as tp
       from {source} group by 1),
sc as (select {by} as model, p, sum(isFraud) as pos, sum(1-isFraud) as neg from {source} group by 1, 2),
cu as (select *, sum(pos) over (partition by model order by p desc) as cpos,
              sum(neg) over (partition by model order by p desc) as cneg from sc),
ar as (select model, sum(neg*(cpos-pos+pos/2.0e0)) / nullif(sum(pos)::double*sum(neg),0) as roc_auc,
              sum(pos*cpos/(cpos+cneg)::double) / sum(pos)::double as avg_precision from cu group by 1),
mt as (select cf.model, {", ".join(f"{v} as {k}" for k, v in _threshold().items())}, roc_auc, avg_precision,
              tn, fp, fn, tp from cf join ar using (model))
""".strip()


METRICS = _metric_ctes("scored", "'test_score'")
METRICS_LONG = _metric_ctes("long", "model")
_ORDER = ("accuracy", "precision", "recall", "f1_score", "roc_auc", "avg_precision", "mcc", "specificity", "false_positive_rate")


def _features() -> dict[str, str]:
    fin = lambda v: f"coalesce({v}, 0)"
    return {
        "amount_log": fin("ln(1+amount)"),
        "amount_sqrt": fin("sqrt(amount)"),
        "balance_change_orig": "newbalanceOrig - oldbalanceOrg",
        "balance_change_ratio_orig": _ratio("newbalanceOrig - oldbalanceOrg", "oldbalanceOrg+1"),
        "amount_to_balance_ratio": _ratio("amount", "oldbalanceOrg+1"),
        "zero_balance_orig": "(newbalanceOrig = 0)::int::double",
        "balance_change_dest": "newbalanceDest - oldbalanceDest",
        "balance_change_ratio_dest": _ratio("newbalanceDest - oldbalanceDest", "oldbalanceDest+1"),
        "amount_vs_type_mean": _ratio("amount", "mean+1"),
        "amount_zscore_by_type": "case when std > 0 then (amount-mean)/std else 0 end",
        "hour_of_day": "(((step % 24) + 24) % 24)::double",
        "day_of_sim": "floor(step/24.0e0)",
        "unusual_hour": "(step % 24 < 6 or step % 24 > 22)::int::double",
        "hour_sin": "sin(2*pi()*(step % 24)/24)",
        "hour_cos": "cos(2*pi()*(step % 24)/24)",
        "round_amount": "(amount = round(amount))::int::double",
    }


TYPED = "typed as (select tx.*, mean, std from tx join (select type, avg(amount) as mean, stddev_samp(amount) as std from tx group by 1) using (type))"


def _feature_sql(*names: str) -> str:
    cells = _features()
    return _sql(TYPED, select="select txn_id, " + ", ".join(_r(cells[n], n) for n in names) + " from typed")


SCALED_COLUMNS = RAW + ["zero_balance_orig", "constant"]
SCALE_INPUT = "inp as (select txn_id, " + ", ".join(RAW) + ", (newbalanceOrig=0)::int as zero_balance_orig, 7.0e0 as constant from tx)"


def _scale_sql(offset: str, divisor: str) -> str:
    """``offset``/``divisor`` are aggregate templates over {c}."""
    stats = ", ".join(f"{offset.format(c=c)} as {c}_a, {divisor.format(c=c)} as {c}_b" for c in SCALED_COLUMNS)
    cells = ", ".join(_r(f"({c} - {c}_a) / (case when {c}_b = 0 then 1 else {c}_b end)", c) for c in SCALED_COLUMNS)
    return _sql(SCALE_INPUT, f"st as (select {stats} from inp)", select=f"select txn_id, {cells} from inp, st")


def _variance_sql() -> str:
    rows = " union all ".join(
        f"select '{c}' as feature, var_pop(({c}-a)/(case when b=a then 1 else b-a end)) as variance "
        f"from inp, (select min({c}) as a, max({c}) as b from inp)"
        for c in SCALED_COLUMNS
    )
    return _sql(SCALE_INPUT, f"v as ({rows})", select=f"select feature, {_r('variance', 'variance')} from v where variance > 0.01")


MI_COLUMNS = RAW + ["zero_balance_orig", "balance_change_dest", "type_code"]


def _mi_ctes() -> str:
    codes = "case type when 'CASH_IN' then 0 when 'CASH_OUT' then 1 when 'DEBIT' then 2 when 'PAYMENT' then 3 else 4 end"
    inp = (
        f"mi_in as (select txn_id, isFraud, {', '.join(RAW)}, (newbalanceOrig=0)::int as zero_balance_orig, "
        f"round(newbalanceDest-oldbalanceDest,2) as balance_change_dest, {codes} as type_code from tx)"
    )
    parts = []
    for c in MI_COLUMNS:
        qs = ", ".join(f"quantile_cont({c}::double, {i}/10.0) as q{i}" for i in range(1, 10))
        bin_ = f"len(list_filter(list_distinct([{', '.join(f'q{i}' for i in range(1, 10))}]), lambda e: e <= {c}))"
        parts.append(f"select '{c}' as feature, {bin_} as bin, isFraud as y from mi_in, (select {qs} from mi_in)")
    return inp + ",\nj as (select feature, bin, y, count(*) as n from (" + " union all ".join(parts) + ") group by 1, 2, 3)," + """
tm as (select feature, n, sum(n) over (partition by feature) as t, sum(n) over (partition by feature, bin) as b,
              sum(n) over (partition by feature, y) as l from j),
mi as (select feature, round(greatest(sum(n/t::double*ln(n::double*t/(b::double*l))),0),6) as mi from tm group by 1)"""


LEAK = {
    "orig_error_flag": "abs(oldbalanceOrg-amount-newbalanceOrig) > 0.01",
    "dest_error_flag": "abs(oldbalanceDest+amount-newbalanceDest) > 0.01",
    "balance_mismatch": "abs(oldbalanceOrg-amount-newbalanceOrig) > 0.01 or abs(oldbalanceDest+amount-newbalanceDest) > 0.01",
    "emptied_account": DRAINED,
    "zero_balance_after": "newbalanceOrig = 0",
}


def _leak_sql() -> str:
    return _q(" union all ".join(
        f"select '{n}' as feature, {_r('avg(((' + e + ')::int = isFraud)::int)', 'agreement')}, "
        f"{_r(_ratio(f'sum(({e})::int*isFraud)', f'sum(({e})::int)'), 'precision')}, "
        f"{_r(_ratio(f'sum(({e})::int*isFraud)', 'sum(isFraud)'), 'recall')} from tx"
        for n, e in LEAK.items()
    ))


# ---- sampling ---------------------------------------------------------------------------

def _hash(seed: object, key: str = "txn_id") -> str:
    return f"md5('{seed}|' || {key})"


BUDGET = "bd as (select count(*)//2 - sum(isFraud) as budget, sum(isFraud) as nf, sum(1-isFraud) as nl from tx)"
SAMPLE_COLUMNS = RAW
STRATIFIED = f"""
st_q as (select type, count(*) as n, floor(any_value(budget)*(count(*)/any_value(nl)::double)) as quota from tx, bd where isFraud=0 group by 1),
st as (select txn_id from (select txn_id, row_number() over (partition by type order by {_hash(SEED)}) as rn, type from tx where isFraud=0)
       join st_q using (type) where rn <= quota)
""".strip()


def _distance() -> str:
    return " + ".join(f"(({c}-{c}_m)/{c}_s)*(({c}-{c}_m)/{c}_s)" for c in SAMPLE_COLUMNS)


CENTROID = "ce as (select " + ", ".join(
    f"avg({c}) as {c}_m, coalesce(nullif(stddev_samp({c}),0),1) as {c}_s" for c in SAMPLE_COLUMNS
) + " from tx where isFraud=1)"
FOCUSED = f"""
di as (select txn_id, {_distance()} as d from tx, ce where isFraud=0),
ff_c as (select txn_id from (select txn_id, row_number() over (order by d, txn_id) as rn from di), bd where rn <= floor(budget*0.7e0)),
ff_r as (select txn_id from (select txn_id, row_number() over (order by {_hash(SEED)}) as rn from tx
         where isFraud=0 and txn_id not in (select txn_id from ff_c)), bd where rn <= budget - floor(budget*0.7e0)),
ff as (select * from ff_c union all select * from ff_r)
""".strip()
_SPREAD = "(" + " + ".join(f"abs(({c}-{c}_lm)/{c}_ls)" for c in SAMPLE_COLUMNS) + f")/{len(SAMPLE_COLUMNS)}"
INFORMATIVE = f"""
le as (select {", ".join(f"avg({c}) as {c}_lm, stddev_samp({c}) as {c}_ls" for c in SAMPLE_COLUMNS)},
              quantile_cont(amount, 0.95) as p95 from tx where isFraud=0),
sp as (select tx.txn_id, d, {_SPREAD} as spread, (amount > p95)::int as big from tx join di using (txn_id), le),
sco as (select txn_id, 0.4e0/(1+d) + 0.2e0*(spread/(select max(spread) from sp)) + 0.05e0*big as score from sp),
in_c as (select txn_id from (select txn_id, row_number() over (order by score desc, txn_id) as rn from sco), bd where rn <= floor(budget*0.8e0)),
in_r as (select txn_id from (select txn_id, row_number() over (order by {_hash(SEED)}) as rn from tx
         where isFraud=0 and txn_id not in (select txn_id from in_c)), bd where rn <= budget - floor(budget*0.8e0)),
inf as (select * from in_c union all select * from in_r)
""".strip()


def _sample_sql(table: str, *ctes: str) -> str:
    return _sql(BUDGET, *ctes, select=f"select txn_id, type, isFraud from tx where isFraud=1 or txn_id in (select txn_id from {table})")


def _diversity() -> str:
    return "(" + " + ".join(f"coalesce(stddev_samp({c}),0)" for c in RAW) + f")/{len(RAW)}"


def _compare_sql() -> str:
    rows = " union all ".join(
        f"select '{name}' as strategy, count(*) as n_rows, sum(isFraud)::bigint as fraud_count, "
        f"{_r('avg(isFraud)', 'fraud_ratio')}, {_r(_diversity(), 'diversity', 3)} "
        f"from tx where isFraud=1 or txn_id in (select txn_id from {t})"
        for name, t in (("stratified", "st"), ("fraud_focused", "ff"), ("informative", "inf"))
    )
    return _sql(BUDGET, STRATIFIED, CENTROID, FOCUSED, INFORMATIVE, select=rows)


# ---- augmentation -------------------------------------------------------------------------

def _u(draw: str, key: str = "id") -> str:
    return f"(('0x'||substr(md5('{SEED}|{draw}|' || {key}),1,8))::BIGINT / 4294967296.0e0)"


def _span(draw: str, low: float, high: float) -> str:
    return f"({low}::double + {high - low!r}::double * {_u(draw)})"


def _gen_case(values: dict[str, str], default: str) -> str:
    return "case gen " + " ".join(f"when '{g}' then {v}" for g, v in values.items()) + f" else {default} end"


# Rows of the test part: a fifth of each class, of the distinct contents.
_TEST_ROWS = (
    "select sum(n)::bigint from (select floor(0.2e0*count(*)+0.5) as n from (select distinct * exclude (txn_id) from tx) group by isFraud)"
)


def _augment_sql(head: str = "", tail: str = "") -> str:
    sizes = ", ".join(f"floor(n*{s}::double)::bigint as s{i}" for i, (_, s) in enumerate(augmenting.SHARES))
    gen = "case " + " ".join(
        f"when id < {'+'.join(f's{j}' for j in range(i + 1))} then '{g}'" for i, (g, _) in enumerate(augmenting.SHARES)
    ) + f" else '{augmenting.LAST}' end"
    pick = lambda slot: (
        f"floor((('0x'||substr(md5('{SEED}|pick|' || case when gen in ('clone','noisy') then 'row' else '{slot}' end "
        f"|| '|' || id),1,8))::BIGINT / 4294967296.0e0) * nf)::bigint"
    )
    amount = _gen_case(
        {g: f"ta.amount*{_span('amount', a, b)}" for g, (a, b) in augmenting.AMOUNT_FACTOR.items()},
        f"near*{_span('drain', 0.9, 1.0)}",
    )
    old_org = _gen_case(
        {
            "clone": f"case when t_org > 0 then t_org*{_span('org', 0.5, 1.5)} else t_org end",
            "near_drain": "near",
            "large": f"amount*{_span('org', 1.0, 1.5)}",
            "noisy": f"amount*{_span('org', 0.8, 1.3)}",
            "zero_origin": "0.0e0",
        },
        "amount",
    )
    old_dest = _gen_case({g: f"t_dest*{_span('dest', a, b)}" for g, (a, b) in augmenting.DEST_FACTOR.items()}, "null")
    cut = _u("settle")
    new_dest = _gen_case(
        {
            "clone": f"case when {cut} < 0.8 then od+amount else od+amount*{_span('part', 0.5, 1.0)} end",
            "delayed_dest": "od",
            "near_drain": f"case when {cut} < 0.33 then od+amount when {cut} < 0.66 then od+amount*{_span('part', 0.0, 0.3)} else od end",
            "noisy": f"od+amount*{_span('part', 0.3, 1.0)}",
            "zero_origin": f"od+amount*{_span('part', 0.5, 1.0)}",
        },
        "od+amount",
    )
    shift = _gen_case({g: f"floor({_u('step')}*{2 * w + 1}) - {w}" for g, w in augmenting.STEP_SHIFT.items()}, "0")
    return _sql(
        f"fr as (select *, row_number() over (order by {_hash(f'{SEED}|template')}) - 1 as rk from tx where isFraud=1)",
        "cnt as (select count(*) as nf, 2*count(*) as n from fr)",
        f"ids as (select id, nf, {gen} as gen from (select unnest(range(n)) as id, nf, n, {sizes} from cnt))",
        f"dr as (select id, gen, ta.type as t_type, ta.amount as t_amount, tb.oldbalanceOrg as t_org, tc.oldbalanceDest as t_dest, td.step as t_step, "
        f"round(greatest(tb.oldbalanceOrg*{_span('org', 0.5, 2.0)}, 100.0e0),2) as near from ids "
        f"join fr ta on ta.rk = {pick('amount')} join fr tb on tb.rk = {pick('oldbalanceOrg')} "
        f"join fr tc on tc.rk = {pick('oldbalanceDest')} join fr td on td.rk = {pick('step')})",
        f"am as (select *, round({amount.replace('ta.amount', 't_amount')},2) as amount from dr)",
        f"bo as (select *, round({old_org},2) as oo, round(greatest({old_dest},0.0e0),2) as od from am)",
        select=(
            head + f"select md5('{SEED}|synthetic|' || id) as txn_id, greatest(t_step + {shift}, 1)::int as step, "
            f"case when gen in ('clone','noisy') then t_type when {_u('type')} < 0.5 then 'TRANSFER' else 'CASH_OUT' end as type, "
            f"amount, oo as oldbalanceOrg, "
            f"case when gen in ('full_drain','delayed_dest','zero_origin') then 0.0e0 else round(greatest(oo-amount,0.0e0),2) end as newbalanceOrig, "
            f"od as oldbalanceDest, round({new_dest},2) as newbalanceDest, 0 as isFraud, 0 as isFlaggedFraud, gen as generator from bo" + tail
        ),
    )


# ---- rules -----------------------------------------------------------------------------------

def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MISMATCHED = "(amount > 0 and abs((oldbalanceOrg-newbalanceOrig)-amount) > 0.01)"
FACTORS = f"""list_filter([
  case when type in {RISKY} then {_quote(rules.TEXT_TYPE)} || type end,
  case when amount > 200000 then {_quote(rules.TEXT_VERY_LARGE)} || format('{{:,.2f}}', amount)
       when amount > 50000 then {_quote(rules.TEXT_LARGE)} || format('{{:,.2f}}', amount) end,
  case when {DRAINED} then {_quote(rules.TEXT_DRAIN)} end,
  case when {MISMATCHED} then {_quote(rules.TEXT_MISMATCH)} end,
  case when oldbalanceDest = 0 and newbalanceDest = 0 and type = 'TRANSFER' then {_quote(rules.TEXT_DEST_UNCHANGED)} end,
  case when amount > oldbalanceOrg and oldbalanceOrg > 0 then {_quote(rules.TEXT_OVERDRAWN)} end], lambda x: x is not null)"""
LEVEL = "case when p > 0.7 then 'HIGH' when p > 0.3 then 'MEDIUM' else 'LOW' end"
ADVICE = (
    f"case when prediction=1 and p > 0.7 then {_quote(rules.TEXT_BLOCK)} when prediction=1 and p > 0.3 then {_quote(rules.TEXT_HOLD)} "
    f"when p > 0.3 then {_quote(rules.TEXT_MONITOR)} else {_quote(rules.TEXT_APPROVE)} end"
)
UPDATED = "abs(newbalanceDest-oldbalanceDest-amount) <= 0.01"
DECISION = (
    f"case when type not in {RISKY} then 1 when {DRAINED} and newbalanceDest=oldbalanceDest then 2 "
    f"when amount > 200000 and {DRAINED} and oldbalanceDest=0 then 4 when {DRAINED} and {UPDATED} then 3 "
    f"when amount <= 200000 and newbalanceOrig > 0 and {UPDATED} then 5 when amount > 200000 and newbalanceOrig > 0 and {UPDATED} then 6 "
    f"when {MISMATCHED} then 7 else 0 end"
)
FULL = "(amount = oldbalanceOrg and newbalanceOrig = 0)"
PATTERN = (
    f"case when type='TRANSFER' and {FULL} and newbalanceDest=oldbalanceDest then 'classic_drain' "
    f"when type='CASH_OUT' and amount > 200000 and {FULL} then 'large_cash_out_drain' "
    f"when type='TRANSFER' and amount > 200000 and {UPDATED} then 'large_transfer_settled' "
    f"when type='PAYMENT' then 'payment' "
    f"when type='TRANSFER' and amount < 10000 and newbalanceOrig > 0 and {UPDATED} then 'small_transfer_settled' else 'other' end"
)


def _case_of(column: str, rows, position: int) -> str:
    q = lambda v: str(v) if isinstance(v, int) else _quote(v)
    return f"case {column} " + " ".join(f"when {q(r[0])} then {q(r[position])}" for r in rows) + " end"


def _report_sql() -> str:
    pieces = []
    for text, cell, spec in report_parts():
        pieces.append("'" + text.replace("'", "''") + "'")
        if cell is None:
            continue
        if spec == "":
            pieces.append(cell)
        elif spec == ",":
            pieces.append(f"lpad(format('{{:,}}', {cell}), 8, ' ')")
        elif spec.endswith("%"):
            pieces.append(f"format('{{:.{spec[:-1]}f}}', {cell}*100)")
        else:
            pieces.append(f"format('{{:.{spec}f}}', {cell})")
    return _s("select model, " + " || ".join(pieces) + " as report from mt", METRICS)


_TITLE = "array_to_string(list_transform(string_split(model, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"


def _curve_ctes(source: str, by: str) -> str:
    return f"""
sc as (select {by} as model, p, sum(isFraud) as pos, sum(1-isFraud) as neg from {source} group by 1, 2),
cu as (select *, sum(pos) over (partition by model order by p desc) as cpos, sum(neg) over (partition by model order by p desc) as cneg,
              sum(pos) over (partition by model) as tp, sum(neg) over (partition by model) as tn,
              lag(p) over w as before, lead(p) over w as after, lead(pos) over w as npos, lead(neg) over w as nneg
       from sc window w as (partition by model order by p desc))
""".strip()


def _columns_sql() -> str:
    return _q(" union all ".join(
        f"select '{c}' as \"column\", count({c}) as n, {_r(f'avg({c})', 'mean', 4)}, {_r(f'stddev_samp({c})', 'std', 4)}, "
        f"min({c})::double as min, max({c})::double as max from tx" for c in RAW
    ))


def _null_sql() -> str:
    cells = {
        "txn_id": "false", "step": "false", "oldbalanceDest": "oldbalanceDest=0", "newbalanceOrig": "newbalanceOrig=0",
        "nameDest": "type='DEBIT'",
    }
    return _q(" union all ".join(f"select '{c}' as \"column\", {_r(f'avg(({e})::int)', 'share')} from tx" for c, e in cells.items()))


def _sweep_sql() -> str:
    m = _threshold()
    return _s(
        "select threshold, tn, fp, fn, tp, " + ", ".join(_r(m[k], k) for k in ("accuracy", "precision", "recall", "f1_score", "specificity")) + " from sw",
        "sw as (select t::double as threshold, count(*) filter (isFraud=0 and p<=t) as tn, count(*) filter (isFraud=0 and p>t) as fp, "
        "count(*) filter (isFraud=1 and p<=t) as fn, count(*) filter (isFraud=1 and p>t) as tp "
        "from scored, (select unnest([0.1e0,0.3e0,0.5e0,0.7e0,0.9e0]) as t) group by 1)",
    )


def _class_report_sql() -> str:
    m0, m1 = _threshold("tn", "fn", "fp", "tp"), _threshold()
    n = "(tn+fp+fn+tp)"
    line = lambda name, p, r, f, s: (
        f"select '{name}' as class, {_r(p, 'precision')}, {_r(r, 'recall')}, {_r(f, 'f1_score')}, ({s})::bigint as support from cf"
    )
    w = lambda k: _ratio(f"{m0[k]}*(tn+fp)+{m1[k]}*(tp+fn)", n)
    a = m1["accuracy"]
    keys = ("precision", "recall", "f1_score")
    return _s(
        " union all ".join([
            line("Legitimate", *[m0[k] for k in keys], "tn+fp"),
            line("Fraud", *[m1[k] for k in keys], "tp+fn"),
            line("accuracy", a, a, a, n),
            line("macro avg", *[f"({m0[k]}+{m1[k]})/2" for k in keys], n),
            line("weighted avg", *[w(k) for k in keys], n),
        ]),
        METRICS,
    )


def oracle_sql() -> dict[str, str]:
    feature_groups = {
        "features_amount": ("amount_log", "amount_sqrt", "round_amount"),
        "features_balance": tuple(list(_features())[2:8]),
        "features_time": tuple(list(_features())[10:15]),
        "features_type": ("amount_vs_type_mean", "amount_zscore_by_type"),
        "features_all": tuple(_features()),
    }
    conf = "count(*) filter (isFraud=0 and prediction=0) as tn, count(*) filter (isFraud=0 and prediction=1) as fp, count(*) filter (isFraud=1 and prediction=0) as fn, count(*) filter (isFraud=1 and prediction=1) as tp"
    share = "count(*)/sum(count(*)) over ()"
    sql = {
        "profile_dataset": _q(
            "select count(*) as total_rows, 12 as total_columns, sum(isFraud)::bigint as fraud_count, "
            "(count(*)-sum(isFraud))::bigint as legitimate_count, round(avg(isFraud),6) as fraud_ratio from tx"),
        "profile_columns": _columns_sql(),
        "type_stats": _q("select type, count(*) as n, round(avg(amount),4) as mean, round(stddev_samp(amount),4) as std from tx group by 1"),
        "type_share": _q(f"select type, count(*) as n, {_r(share, 'share')} from tx group by 1"),
        "type_risk_profile": _q("select type, isFraud, count(*) as n, round(avg(amount),4) as avg_amount, max(amount) as max_amount from tx group by 1,2"),
        "step_bands": _q(
            "select case when step<=24 then '1-24' when step<=168 then '25-168' when step<=336 then '169-336' when step<=504 then '337-504' "
            "else '505-743' end as band, count(*) as n, sum(isFraud)::bigint as fraud, round(avg(isFraud),6) as fraud_rate from tx group by 1"),
        "class_distribution": _q(f"select isFraud, count(*) as n, {_r('100.0e0*' + share, 'percent')} from tx group by 1"),
        "flag_vs_label": _q("select isFlaggedFraud, isFraud, count(*) as n from tx group by 1,2"),
        "null_share": _null_sql(),
        "diversity_score": _q(f"select type, {_r(_diversity(), 'diversity', 4)} from tx group by 1"),
        "target_ratio_table": _q(
            "select t as target_ratio, fraud, least(budget, legit)::bigint as legit, (fraud+least(budget,legit))::bigint as total from ("
            "select t, fraud, legit, case when t>0 then least(floor(fraud*(1-t)/t), 1000000000-fraud) else 1000000000-fraud end as budget from "
            "(select sum(isFraud)::bigint as fraud, sum(1-isFraud)::bigint as legit from tx), (select unnest([0.0e0,0.1e0,0.15e0,0.3e0,0.5e0]) as t))"),
        "csv_round_trip": _q("select step, type, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud from tx"),
        "read_split": _q("select case when isFraud=1 then 'fraud' else 'other' end as side, count(*) as n, sum(step)::bigint as steps from tx group by 1"),
        "results_round_trip": _q(
            "select count(*) as total_rows, 12 as total_columns, sum(isFraud)::bigint as fraud_count, "
            "(count(*)-sum(isFraud))::bigint as legitimate_count, round(avg(isFraud),6) as fraud_ratio from tx"),
        "balance_errors": _q(
            "select txn_id, isFraud, round(oldbalanceOrg-amount-newbalanceOrig,2)+0.0e0 as orig_balance_error, "
            "round(oldbalanceDest+amount-newbalanceDest,2)+0.0e0 as dest_balance_error from tx"),
        "augmented_table": _augment_sql("select txn_id, step, type, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud from tx union all select * exclude (generator) from (", ")"),
        **{f"sample_rules_{s}": _q(
            f"select '{s}' as strategy, sum(isFraud)::bigint as fraud_rows, 0::bigint as fraud_lost, 0::bigint as over_budget, "
            "0::bigint as unknown_rows, 0::bigint as repeated_rows from tx") for s in ("clustering", "anomaly_focused", "hybrid", "intelligent")},
        "voting_rules": _q(f"select unnest(['soft','hard']) as mode, ({_TEST_ROWS}) as rows, 0::bigint as other_votes"),
        "tree_shap_rules": _q(f"select ({_TEST_ROWS}) as rows, 0::bigint as unequal"),
        "preset_shap_rules": _q(f"select ({_TEST_ROWS}) as rows, 0::bigint as unequal"),
        "model_score_rules": _q("select count(*) as rows, 0::bigint as bad_scores, 0::bigint as bad_confidence, 0::bigint as bad_decisions from tx"),
        "stream_model_score": _q("select count(*) as rows, 0::bigint as unequal from tx"),
        "read_columns": _q("select txn_id, type, amount from tx"),
        "filter_fraud": _q("select txn_id, type, amount from tx where isFraud=1"),
        "narrow_types": _q(
            "select 'step' as \"column\", case when max(step)<128 then 'tinyint' when max(step)<32768 then 'smallint' else 'int' end as type from tx "
            + "".join(f"union all select '{c}', case when max({c})<128 then 'tinyint' else 'smallint' end from tx " for c in ("isFraud", "isFlaggedFraud"))
            + "".join(f"union all select '{c}', 'float' " for c in RAW[1:])),
        "dedupe": _q(
            "select min(txn_id) as txn_id, type, amount, step from (select * from tx union all select * replace (md5('copy|'||txn_id) as txn_id) from tx) "
            "group by step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud"),
        "drop_sparse": _q(f"select txn_id, step, case when type not in {RISKY} then amount end as calm_amount from tx"),
        "missing_to_zero": _q("select txn_id, case when type='DEBIT' then 0 else amount end as amount, oldbalanceDest, newbalanceOrig from tx"),
        "row_offset_nulls": _q("select txn_id from (select txn_id, row_number() over (order by case when step % 7 = 0 then null else step end nulls last, txn_id) as rn, count(*) over () as n from tx) where rn > n*9//10"),
        "file_row_offset": _q(
            "select txn_id, file_row from (select txn_id, row_number() over (order by txn_id) - 1 as file_row, count(*) over () // 3 as n from tx) where file_row >= n"),
        "row_offset": _q("select txn_id, step from (select txn_id, step, row_number() over (order by step, txn_id) as rn, count(*) over () as n from tx) where rn > n//3"),
        "request_defaults": _q(
            "select txn_id, step, type, case when amount > 100000 then amount else 10000.0e0 end as amount, 50000.0e0 as oldbalanceOrg, "
            "40000.0e0 as newbalanceOrig, oldbalanceDest, 10000.0e0 as newbalanceDest from tx"),
        "parse_form": _q(
            "select txn_id, case when step%24=0 then 1 else step end as step, case when type='DEBIT' then 0.0e0 else step::double end as amount, "
            "case when newbalanceOrig=0 then 0.0e0 else step::double end as oldbalanceOrg from tx"),
        **{name: _feature_sql(*cells) for name, cells in feature_groups.items()},
        "features_unseen_type": _sql(
            "kn as (select type, avg(amount) as m, stddev_samp(amount) as s from tx where type<>'DEBIT' group by 1)",
            "al as (select txn_id, amount, coalesce(m, (select avg(amount) from tx)) as mean, coalesce(s, 1) as std, "
            "case tx.type when 'CASH_IN' then 0 when 'CASH_OUT' then 1 when 'PAYMENT' then 2 when 'TRANSFER' then 3 else -1 end as code "
            "from tx left join kn using (type))",
            select="select txn_id, round(amount/(mean+1),6) as amount_vs_type_mean, round((amount-mean)/std,6) as amount_zscore_by_type, code::double as type_code from al"),
        "encode_type": _q("select type, (dense_rank() over (order by type) - 1)::int as code, count(*) as n from tx group by 1"),
        "scale_standard": _scale_sql("avg({c})", "stddev_pop({c})"),
        "scale_minmax": _scale_sql("min({c})", "max({c})-min({c})"),
        "scale_robust": _scale_sql("quantile_cont({c}::double,0.5)", "quantile_cont({c}::double,0.75)-quantile_cont({c}::double,0.25)"),
        "variance_select": _variance_sql(),
        "mi_binned": _sql(_mi_ctes(), select="select feature, mi from mi"),
        "leakage_audit": _leak_sql(),
        "load_preserving": _q(
            f"select txn_id, isFraud from (select txn_id, isFraud, row_number() over (partition by isFraud order by {_hash(SEED)}) as rn, "
            "count(*) over () // 2 - sum(isFraud) over () as budget from tx) where isFraud=1 or rn <= budget"),
        "load_target_ratio": _q(
            "select txn_id, isFraud, step from (select *, row_number() over (partition by isFraud order by step, txn_id) as lr from ("
            "select txn_id, isFraud, step, row_number() over (order by step, txn_id) as rn, count(*) over () as n, sum(isFraud) over () as f from tx) "
            "where isFraud=1 or rn > n//10) where isFraud=1 or lr <= floor(f*0.85e0/0.15e0)"),
        "sample_stratified": _sample_sql("st", STRATIFIED),
        "sample_fraud_focused": _sample_sql("ff", CENTROID, FOCUSED),
        "sample_informative": _sample_sql("inf", CENTROID, FOCUSED, INFORMATIVE),
        "sample_compare": _compare_sql(),
        "split_stratified": _q(
            f"select txn_id, isFraud, case when rn <= floor(0.2e0*n+0.5) then 'test' else 'train' end as split from (select txn_id, isFraud, "
            f"row_number() over (partition by isFraud order by {_hash(SEED)}) as rn, count(*) over (partition by isFraud) as n from tx)"),
        "folds_stratified": _q(f"select txn_id, isFraud, (ntile(3) over (partition by isFraud order by {_hash(SEED)}) - 1)::int as fold from tx"),
        "hash_rank": _q(f"select txn_id, row_number() over (order by {_hash(SEED)}) - 1 as rank from tx where isFraud=1"),
        "class_weights": _q("select isFraud, count(*) as n, round(sum(count(*)) over () / (2.0e0*count(*)),6) as weight from tx group by 1"),
        "imbalance_report": _q(
            "select 'smote' as method, n as original_train_size, (n+a)::bigint as balanced_train_size, round(pos/n::double,6) as original_fraud_ratio, "
            "round((pos+a)/(n+a)::double,6) as balanced_fraud_ratio from (select count(*) as n, sum(isFraud) as pos, floor(0.3e0*sum(1-isFraud))-sum(isFraud) as a from tx)"),
        "augment_points": _augment_sql(),
        "augment_report": _q(
            "select stage, fraud, legit, fraud+legit as total, round(fraud/(fraud+legit)::double,6) as fraud_ratio from ("
            "select 'before' as stage, sum(isFraud)::bigint as fraud, sum(1-isFraud)::bigint as legit from tx union all "
            "select 'after', sum(isFraud)::bigint, (sum(1-isFraud)+2*sum(isFraud))::bigint from tx)"),
        "risk_factors": _q(f"select txn_id, len(x)::int as n_factors, array_to_string(x, '; ') as factors from (select txn_id, {FACTORS} as x from tx)"),
        "risk_levels": _s(f"select type, {LEVEL} as risk_level, isFraud, count(*) as n from scored group by 1,2,3"),
        "recommendations": _s(f"select {ADVICE} as recommendation, {LEVEL} as risk_level, count(*) as n, sum(isFraud)::bigint as fraud from scored group by 1,2"),
        "score_batch": _s(f"select txn_id, prediction as is_fraud, p as fraud_probability, {LEVEL} as risk_level, round(greatest(p,1-p),6) as confidence from scored"),
        "batch_summary": _s(
            "select count(*) as total_transactions, sum(prediction)::bigint as fraud_detected, (count(*)-sum(prediction))::bigint as legitimate, "
            "round(avg(prediction),6) as fraud_rate from scored"),
        "decision_table": _q(
            f"select rule, {_case_of('rule', rules.DECISIONS, 1)} as prediction, {_case_of('rule', rules.DECISIONS, 2)} as confidence, n, fraud from "
            f"(select {DECISION} as rule, count(*) as n, sum(isFraud)::bigint as fraud from tx group by 1)"),
        "pattern_table": _q(
            f"select pattern, {_case_of('pattern', rules.PATTERN_SIGNALS, 1)} as signal, n, fraud, round(fraud/n::double,6) as fraud_rate from "
            f"(select {PATTERN} as pattern, count(*) as n, sum(isFraud)::bigint as fraud from tx group by 1)"),
        "confusion": _s(f"select {conf} from scored"),
        "metrics": _s("select model, " + ", ".join(_r(m, m) for m in _ORDER) + ", tn, fp, fn, tp from mt", METRICS),
        "classification_report": _class_report_sql(),
        "roc_curve": _s("select p as threshold, round(cneg/tn::double,6) as fpr, round(cpos/tp::double,6) as tpr from cu", _curve_ctes("scored", "'x'")),
        "roc_auc": _s("select round(roc_auc,6) as roc_auc from mt", METRICS),
        "pr_curve": _s("select p as threshold, round(cpos/(cpos+cneg)::double,6) as precision, round(cpos/tp::double,6) as recall from cu", _curve_ctes("scored", "'x'")),
        "avg_precision": _s("select round(avg_precision,6) as avg_precision from mt", METRICS),
        "mcc": _s("select round(mcc,6) as mcc from mt", METRICS),
        "threshold_sweep": _sweep_sql(),
        "eval_report": _report_sql(),
        "comparison_rank": _s(
            "select model, " + ", ".join(_r(m, m) for m in _ORDER[:5]) + ", rank::int as rank, (rank=1)::int as is_best from "
            "(select *, row_number() over (order by f1_score desc, model) as rank from mt)", MEMBERS, METRICS_LONG),
        "comparison_long": _s(
            " union all ".join(
                f"select model, {_TITLE} as label, '{t}' as metric, round({m}*100,2) as percent from mt"
                for m, t in (("precision", "Precision"), ("recall", "Recall"), ("f1_score", "F1 Score"), ("roc_auc", "ROC AUC"))),
            MEMBERS, METRICS_LONG),
        "vote_soft": _s(
            "select isFraud, (v > 0.5)::int as prediction, count(*) as n, round(sum(v),3) as sum_p from "
            "(select isFraud, (base+by_amount+by_rules)/3 as v from members) group by 1,2", MEMBERS),
        "vote_hard": _s(
            "select txn_id, (v > 1.5)::int as prediction, (v > 1.5)::int::double as p from "
            "(select txn_id, (base>0.5)::int+(by_amount>0.5)::int+(by_rules>0.5)::int as v from members)", MEMBERS),
        "final_selection": _s(
            "select case when e > t then 'ensemble_by_rules' else 'tuned_base' end as selected, round(greatest(e,t),6) as f1_score from "
            "(select max(f1_score) filter (model='by_rules') as e, max(f1_score) filter (model='base') as t from mt)", MEMBERS, METRICS_LONG),
        "importance_top": _sql(
            _mi_ctes(),
            select="select rank::int as rank, feature, case when length(feature) > 18 then substr(feature,1,18) || '...' else feature end as label, mi as importance "
            "from (select *, row_number() over (order by mi desc, feature) as rank from mi) where rank <= 5"),
        "linear_shap": _sql(
            TYPED,
            "fe as (select " + ", ".join(f"{_features()[c]} as {c}" for c in LINEAR) + " from typed)",
            select=" union all ".join(
                f"select '{c}' as feature, round(avg(abs({w}::double*({c}-(select avg({c}) from fe)))),6) as importance from fe" for c, w in LINEAR.items())),
        "amount_histogram": _sql(
            "ra as (select isFraud, min(amount) as lo, (max(amount)-min(amount))/50 as width, count(*) as total from tx group by 1)",
            "pl as (select isFraud, lo, width, total, least(floor((amount-lo)/width),49)::int as bin from tx join ra using (isFraud))",
            "pc as (select isFraud, bin, count(*) as n from pl group by 1,2)",
            "gr as (select ra.*, b.bin::int as bin from ra, range(50) b(bin))",
            select="select isFraud, bin, coalesce(n,0) as n, round(lo+bin*width,4) as bin_start, "
            "round(coalesce(n,0)/(total*width),12) as density, "
            "round((select quantile_cont(amount,0.99) from tx where isFraud=1),4) as x_limit from gr left join pc using (isFraud, bin)"),
        "amount_box": _sql(
            "lg as (select isFraud, ln(1+amount) as v from tx)",
            "qu as (select isFraud, quantile_cont(v,0.25) as q1, quantile_cont(v,0.5) as median, quantile_cont(v,0.75) as q3 from lg group by 1)",
            "bx as (select lg.isFraud, v, q1, median, q3, v between q1-1.5*(q3-q1) and q3+1.5*(q3-q1) as inside from lg join qu using (isFraud))",
            select="select isFraud, round(q1,6) as q1, round(median,6) as median, round(q3,6) as q3, round(min(v) filter (inside),6) as whisker_low, "
            "round(max(v) filter (inside),6) as whisker_high, count(*) filter (not inside) as outliers from bx group by isFraud, q1, median, q3"),
        "confusion_cells": _s(
            " union all ".join(
                f"select '{n}' as cell, {c} as n, round({c}/(tn+fp+fn+tp)::double,6) as share from cf"
                for n, c in (("True Negative", "tn"), ("True Positive", "tp"), ("False Positive", "fp"), ("False Negative", "fn"))),
            METRICS),
        "metric_badges": _s(
            " union all ".join(
                f"select model, '{m}' as metric, round({m},6) as value, ({m} > {limit})::int as good from mt"
                for m, limit in (("precision", 0.9), ("specificity", 0.9), ("mcc", 0.7))),
            METRICS),
        "roc_lines": _s(
            "select model, p as threshold, round(cneg/tn::double,6) as fpr, round(cpos/tp::double,6) as tpr from cu "
            "where model in ('base','by_rules') and (before is null or after is null or npos <> pos or nneg <> neg)",
            MEMBERS, _curve_ctes("long", "model")),
        "pr_lines": _s(
            "select model, p as threshold, round(cpos/(cpos+cneg)::double,6) as precision, round(cpos/tp::double,6) as recall from cu where model in ('base','by_rules') "
            "union all select unnest(['base','by_rules']), null::double, 1.0e0, 0.0e0",
            MEMBERS, _curve_ctes("long", "model")),
    }
    sql.update(_job_sql())
    return sql


KNN = """
fq as (select * from tx where isFraud=1),
nn as (select * from (select a.txn_id, b.txn_id as nid, b.amount as na, b.oldbalanceDest as nd,
         sqrt((a.amount-b.amount)*(a.amount-b.amount) + (a.oldbalanceDest-b.oldbalanceDest)*(a.oldbalanceDest-b.oldbalanceDest)) as dist
         from fq a join fq b on a.txn_id <> b.txn_id)
       qualify row_number() over (partition by txn_id order by dist, nid) <= 5),
kn as (select *, row_number() over (partition by txn_id order by dist, nid) as rank from nn)
""".strip()


_DRAW = f"('0x'||substr(md5('{SEED}|rows|' || txn_id),1,12))::bigint % 2147483647"


def _mix(tree: int) -> tuple[int, int]:
    """Multiplier and shift of a tree's row draws, from the md5 of seed and number."""
    digest = hashlib.md5(f"{SEED}|{tree}".encode()).hexdigest()
    return 1 + int(digest[:12], 16) % 2147483646, int(digest[12:24], 16) % 2147483647


def _bootstrap_sql() -> str:
    """Poisson(1) counts by inversion: a row comes as often as its number passes the distribution's steps."""
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]
    trees = ", ".join(f"({t}, {a}::bigint, {b}::bigint)" for t in range(80) for a, b in [_mix(t)])
    times = " + ".join(f"(u >= {p!r}::double)::int" for p in steps)
    return _sql(
        f"bs_d as (select isFraud, {_DRAW} as d from tx)",
        f"bs_u as (select t, isFraud, ((d * a + b) % 2147483647)::double / 2147483647 as u from bs_d, (values {trees}) v(t, a, b))",
        f"bs_n as (select t, sum(case when isFraud=0 then {times} else 0 end)::bigint as z, sum(case when isFraud=1 then {times} else 0 end)::bigint as o from bs_u group by 1)",
        select="select t::int as tree, z as zeros, o as ones, round((z+o)/(2.0e0*z),9) as weight_0, round((z+o)/(2.0e0*o),9) as weight_1 from bs_n")


def _root_sql() -> str:
    """Sums of gradient (w (1/2 - y)) and hessian (w / 4) left of each decile, weight 5 for fraud, 0.85 of the rows."""
    a, b = _mix(0)
    worth = lambda g, h: f"pow(greatest(abs({g})-0.05e0,0),2)/({h}+2.0e0)"
    parts = []
    for c in RAW:
        edges = ", ".join(f"quantile_cont({c}::double, {i}/10.0)" for i in range(1, 10))
        parts.append(
            f"select '{c}' as feature, e, sum(case when {c} <= e then g else 0 end) as gl, sum(case when {c} <= e then h else 0 end) as hl, "
            f"sum(({c} <= e)::int) as nl, sum(g) as g, sum(h) as h, count(*) as n from rt, "
            f"(select unnest(list_distinct([{edges}])) as e from tx) group by e")
    return _sql(
        f"rt as (select *, w*(0.5e0-isFraud) as g, w*0.25e0 as h from (select *, case when isFraud=1 then 5.0e0 else 1.0e0 end as w, {_DRAW} as d from tx) "
        f"where ((d * {a}::bigint + {b}::bigint) % 2147483647)::double / 2147483647 < 0.85e0)",
        "rs as (" + " union all ".join(parts) + ")",
        select=f"select feature, round(e,4) as edge, round({worth('gl', 'hl')} + {worth('(g-gl)', '(h-hl)')} - {worth('g', 'h')},4) as gain from rs "
        "where nl >= 1 and n-nl >= 1 and hl >= 2 and h-hl >= 2")


def _digamma(n: str) -> str:
    """psi of a whole number: shifted by six, then the asymptotic series."""
    x = f"(({n})::double+6)"
    y = f"(1/({x}*{x}))"
    series = f"ln({x}) - 0.5e0/{x} - {y}*(1/12.0e0 - {y}*(1/120.0e0 - {y}*(1/252.0e0 - {y}*(1/240.0e0 - {y}/132.0e0))))"
    return f"({series} - (" + " + ".join(f"1/(({n})::double+{i})" for i in range(6)) + "))"


def _near_mi_sql() -> str:
    """Third neighbour of the class by lead and lag, and how many rows lie nearer by ordered counts."""
    columns = [*RAW, "zero_balance_orig"]
    rows = " union all ".join(
        f"select '{c}' as feature, isFraud as y, (round_even({c}::double * pow(2, 35-ceil(log2((select max(abs({c}::double)) from nm_in)))), 0))::bigint * 67108864 "
        f"+ (('0x'||substr(md5('{SEED}|near|{c}|' || txn_id),1,7))::bigint % 67108864) as v from nm_in" for c in columns)
    reach = [f"greatest(v - lag(v,{j}) over c, lead(v,{3 - j}) over c - v)" if 0 < j < 3 else ("lead(v,3) over c - v" if j == 0 else "v - lag(v,3) over c") for j in range(4)]
    whole = [f"case when {' and '.join(x for x in (f'lag(v,{j}) over c is not null' if j else '', f'lead(v,{3 - j}) over c is not null' if j < 3 else '') if x)} then {r} end" for j, r in enumerate(reach)]
    return _sql(
        "nm_in as (select *, (newbalanceOrig=0)::int as zero_balance_orig from tx)", f"nm as ({rows})",
        f"nm_d as (select feature, y, v, least({', '.join(whole)}) as d from nm window c as (partition by feature, y order by v))",
        # Below an open end: rows at or before v - d don't count, nor do rows from v + d on.
        "nm_e as (select feature, v, 0 as kind, 0::bigint as id from nm union all select feature, v-d, 1, row_number() over () from nm_d "
        "union all select feature, v+d, -1, row_number() over () from nm_d)",
        "nm_c as (select feature, kind, id, sum((kind=0)::int) over (partition by feature order by v, case kind when -1 then 0 when 0 then 1 else 2 end rows unbounded preceding) as n from nm_e)",
        "nm_m as (select feature, sum(case when kind=-1 then n else -n end) as m from nm_c where kind<>0 group by feature, id)",
        "nm_n as (select isFraud as y, count(*) as n from tx group by 1)",
        "nm_r as (select feature, greatest(" + _digamma("(select count(*) from tx)") + " + " + _digamma("3") + " - (select sum(n*" + _digamma("n") + ")/sum(n) from nm_n) - avg("
        + _digamma("m") + "), 0) as mi from nm_m group by 1)",
        select="select feature, round(mi,6) as mi, (row_number() over (order by mi desc, feature))::int as rank from nm_r")


NEAR = [
    "balance_change_ratio_orig", "amount_to_balance_ratio", "zero_balance_orig", "balance_change_ratio_dest", "hour_of_day", "day_of_sim",
    "unusual_hour", "hour_sin", "hour_cos", "round_amount", "amount_log", "amount_sqrt", "amount_vs_type_mean", "amount_zscore_by_type",
    "balance_change_orig", "balance_change_dest",
]


def _near_sql() -> str:
    cells = {"step": "step/24.0e0", **{c: f"{c}/100000.0e0" for c in RAW if c != "step"}, **{c: _features()[c] for c in NEAR}}
    gaps = "+".join(f"(a.f{i}-b.f{i})*(a.f{i}-b.f{i})" for i in range(len(cells)))
    return _sql(
        TYPED, "nf as materialized (select txn_id, isFraud, " + ", ".join(f"({e})::double as f{i}" for i, e in enumerate(cells.values())) + " from typed)",
        f"nd as (select a.txn_id, min({gaps}, 5) as best from nf a join nf b on a.isFraud=1 and a.txn_id <> b.txn_id group by 1)",
        select="select txn_id, unnest(range(1, len(best)+1))::int as rank, round(sqrt(unnest(best)),6) as distance from nd")


def _job_sql() -> dict[str, str]:
    draw = lambda name: _u(name)
    smote = _sql(
        KNN,
        f"ba as (select txn_id, amount, oldbalanceDest, row_number() over (order by {_hash(f'{SEED}|base')}) - 1 as rk from fq)",
        "ct as (select sum(isFraud) as nmin, floor(0.3e0*sum(1-isFraud))-sum(isFraud) as n from tx)",
        f"dw as (select id, floor({draw('row')}*nmin)::bigint as rk, floor({draw('slot')}*5)::int + 1 as slot, {draw('gap')} as gap "
        "from (select unnest(range(n::bigint)) as id, nmin from ct))",
        select=f"select md5('{SEED}|smote|' || id) as txn_id, 1 as isFraud, round(amount+gap*(na-amount),4) as amount, "
        "round(oldbalanceDest+gap*(nd-oldbalanceDest),4) as oldbalanceDest from dw join ba using (rk) "
        "join kn on kn.txn_id=ba.txn_id and kn.rank=slot",
    )
    sides = _sql(
        f"fa as (select 1 as side, row_number() over (order by {_hash(SEED)}) - 1 as pair, *, len({FACTORS}) as factors from tx where isFraud=1)",
        f"le as (select 2 as side, row_number() over (order by {_hash(SEED)}) - 1 as pair, *, len({FACTORS}) as factors from tx where isFraud=0 and type in {RISKY})",
        select="select fa.pair, "
        + ", ".join(f"fa.{c} as {c}_1, le.{c} as {c}_2" for c in ("type", "amount", "newbalanceOrig", "newbalanceDest"))
        + ", fa.factors::int as factors_1, le.factors::int as factors_2, (fa.factors-le.factors)::int as factor_gap from fa left join le using (pair)",
    )
    return {
        "knn_features": _near_sql(),
        "mi_neighbours": _near_mi_sql(),
        "forest_bootstrap": _bootstrap_sql(),
        "boosting_root": _root_sql(),
        "ordered_type_statistics": _q(
            f"select txn_id, type, (coalesce(sum(isFraud) over w, 0)+0.5e0)/(count(*) over w + 1.0e0) as statistic from tx "
            f"window w as (partition by type order by {_hash(SEED)} rows between unbounded preceding and 1 preceding)"),
        "knn_minority": _sql(KNN, select="select txn_id, rank::int as rank, nid as neighbour, round(dist,4) as distance from kn"),
        "smote_points": smote,
        "paired_cases": sides,
        "results_summary": _s(
            "select n as total_rows, fraud::bigint as fraud_count, (n-fraud)::bigint as legitimate_count, round(fraud/n::double,6) as fraud_ratio, "
            "model as best_model, " + ", ".join(_r(m, m) for m in ("accuracy", "precision", "recall", "f1_score", "roc_auc", "specificity", "mcc"))
            + ", tn, fp, fn, tp from mt, (select count(*) as n, sum(isFraud) as fraud from tx)", METRICS),
        "stream_score": _s(f"select txn_id, p, {LEVEL} as risk_level, {ADVICE} as recommendation from scored"),
        "stream_risk_counts": _s(
            "select (d*24)::int as window_hour, risk_level, n, flagged from ("
            f"select step//24 as d, {LEVEL} as risk_level, count(*) as n, sum(prediction)::bigint as flagged from scored group by 1,2) "
            "where (d+1)*24 <= (select max(step) from tx) - 1"),
        "stream_dedupe": _q("select step, type, amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest, isFraud from tx"),
        "stream_dedupe_any_distance": _q(
            "select min(least(txn_id, md5('copy|' || txn_id))) as txn_id, step, type, amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, "
            "oldbalanceDest, newbalanceDest, isFraud from tx group by all"),
        "stream_profile": _q(
            "select count(*) as total_rows, sum(isFraud)::bigint as fraud_count, (count(*)-sum(isFraud))::bigint as legitimate_count, "
            "round(avg(isFraud),6) as fraud_ratio from tx"),
    }


LINEAR = {"amount_log": 0.8, "zero_balance_orig": 2.0, "balance_change_ratio_dest": -0.3, "hour_sin": 0.1}
