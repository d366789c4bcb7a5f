"""Building blocks of the ANSI SQL counterparts: the panel as common table expressions."""

from __future__ import annotations

EPS = "1e-6::DOUBLE"


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(CASE WHEN round(({expr})::DOUBLE,{digits})=0 THEN 0::DOUBLE ELSE round(({expr})::DOUBLE,{digits}) END)"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def ym(expr: str = "period") -> str:
    return f"strftime({expr},'%Y-%m')"


def corr(x: str, y: str) -> str:
    """Pearson correlation over complete pairs, NULL for a constant side."""
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    return (
        f"(covar_pop(({x})::DOUBLE,({y})::DOUBLE)/nullif(stddev_pop(CASE WHEN {both} THEN ({x})::DOUBLE END)"
        f"*stddev_pop(CASE WHEN {both} THEN ({y})::DOUBLE END),0))"
    )


def cv(x: str) -> str:
    return f"(stddev_samp({x})/(avg({x})+{EPS}))"


def scaled(x: str) -> str:
    return (
        f"(CASE WHEN max({x}) OVER ()-min({x}) OVER () <= {EPS} THEN 0::DOUBLE "
        f"ELSE ({x}-min({x}) OVER ())/(max({x}) OVER ()-min({x}) OVER ()+{EPS}) END)"
    )


def avg_rank(x: str, desc: bool = True) -> str:
    return f"(rank() OVER (ORDER BY {x} {'DESC' if desc else 'ASC'})+(count(*) OVER (PARTITION BY {x})-1)/2::DOUBLE)"


def _case(rules, pick):
    parts = []
    for rule in rules[:-1]:
        cond = " AND ".join(f"{i}{op}{v}" for i, op, v in rule[-1])
        parts.append(f"WHEN {cond} THEN '{pick(rule)}'")
    return "(CASE " + " ".join(parts) + f" ELSE '{pick(rules[-1])}' END)"


from panelwise.functions.fixed import ACTION_RULES, LABEL_RULES  # noqa: E402

LABEL = _case(LABEL_RULES, lambda x: x[0])
STATUS = _case(ACTION_RULES, lambda x: x[0])
ACTION = _case(ACTION_RULES, lambda x: x[1])
case_rules = _case

CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "fa": (
        (),
        """SELECT n_name AS entity, o_orderdate::DATE AS date,
 (CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS a_1,
 (CASE WHEN o_orderpriority='2-HIGH' THEN 1 ELSE 0 END)::BIGINT AS a_2,
 (CASE WHEN o_orderpriority NOT IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS a_3
 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey""",
    ),
    "fb": (
        (),
        """SELECT n_name AS entity, l_shipdate::DATE AS date,
 (CASE WHEN l_linestatus='F' THEN l_quantity ELSE 0 END)::BIGINT AS b_1,
 (CASE WHEN l_linestatus='O' THEN l_quantity ELSE 0 END)::BIGINT AS b_2
 FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey""",
    ),
    "fc": (
        (),
        """SELECT n_name AS entity, l_shipdate::DATE AS date,
 (CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END)::BIGINT AS c_1,
 (CASE WHEN l_returnflag='A' THEN l_quantity ELSE 0 END)::BIGINT AS c_2
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
 JOIN nation ON c_nationkey=n_nationkey WHERE l_returnflag IN ('R','A')""",
    ),
    "ra": (
        ("fa",),
        """SELECT entity, date_trunc('month',date)::DATE AS period, sum(a_1+a_2+a_3)::BIGINT AS a_total,
 sum(a_1)::BIGINT AS a_1, sum(a_2)::BIGINT AS a_2, sum(a_3)::BIGINT AS a_3 FROM fa GROUP BY 1,2""",
    ),
    "rb": (
        ("fb",),
        """SELECT entity, date_trunc('month',date)::DATE AS period, sum(b_1+b_2)::BIGINT AS b_total,
 sum(b_1)::BIGINT AS b_1, sum(b_2)::BIGINT AS b_2 FROM fb GROUP BY 1,2""",
    ),
    "rc": (
        ("fc",),
        """SELECT entity, date_trunc('month',date)::DATE AS period, sum(c_1+c_2)::BIGINT AS c_total,
 sum(c_1)::BIGINT AS c_1, sum(c_2)::BIGINT AS c_2 FROM fc GROUP BY 1,2""",
    ),
    "panel": (
        ("ra", "rb", "rc"),
        f"""SELECT entity, period, a_total,a_1,a_2,a_3,b_total,b_1,b_2,c_total,c_1,c_2,
 (b_total+c_total)/(a_total+{EPS}) AS update_ratio, b_total/(a_total+{EPS}) AS b_ratio, c_total/(a_total+{EPS}) AS c_ratio,
 a_1/(a_total+{EPS}) AS a1_share, a_2/(a_total+{EPS}) AS a2_share, b_2/(b_total+{EPS}) AS b2_share,
 c_2/(c_total+{EPS}) AS c2_share, a_total+b_total+c_total AS activity
 FROM ra JOIN rb USING (entity,period) JOIN rc USING (entity,period)""",
    ),
    "leads": (
        ("panel",),
        """SELECT *, lead(c_2,1) OVER w AS c_next1, lead(c_2,2) OVER w AS c_next2 FROM panel
 WINDOW w AS (PARTITION BY entity ORDER BY period)""",
    ),
    "profile0": (
        ("leads",),
        f"""SELECT entity, sum(a_total)::BIGINT AS a_total, sum(b_total)::BIGINT AS b_total, sum(c_total)::BIGINT AS c_total,
 avg(a1_share) AS a1_share, avg(a2_share) AS a2_share, avg(b2_share) AS b2_share, avg(c2_share) AS c2_share,
 avg(update_ratio) AS avg_update_ratio, avg(b_ratio) AS avg_b_ratio, avg(c_ratio) AS avg_c_ratio,
 count(DISTINCT period)::BIGINT AS active_periods,
 {cv('a_total')} AS a_cv, {cv('b_total')} AS b_cv, {cv('c_total')} AS c_cv, {cv('update_ratio')} AS ratio_cv,
 CASE WHEN count(*)>=3 THEN {corr('a_2','c_next1')} END AS lag1_corr,
 CASE WHEN count(*)>=3 THEN {corr('a_2','c_next2')} END AS lag2_corr
 FROM leads GROUP BY entity""",
    ),
    "profile": (
        ("profile0",),
        "SELECT *, a_total+b_total+c_total AS activity, ln(1+a_total+b_total+c_total) AS log_activity FROM profile0",
    ),
    "raws": (
        ("profile",),
        f"""SELECT *, a_rank+b_rank+c_rank AS maturity_raw, ln(1+b_total+c_total)-ln(1+a_total) AS pressure_raw,
 coalesce(ratio_cv,0) AS volatility_raw, coalesce(abs(lag1_corr),0) AS predictability_raw FROM
 (SELECT *, {avg_rank('a_total')} AS a_rank, {avg_rank('b_total')} AS b_rank, {avg_rank('c_total')} AS c_rank FROM profile)""",
    ),
    "idx0": (
        ("raws",),
        f"""SELECT *, 1-{scaled('maturity_raw')} AS maturity, {scaled('pressure_raw')} AS pressure,
 {scaled('volatility_raw')} AS volatility, {scaled('predictability_raw')} AS predictability FROM raws""",
    ),
    "idx": (("idx0",), f"SELECT *, {LABEL} AS label, {STATUS} AS status, {ACTION} AS action FROM idx0"),
    "fl0": (
        ("idx",),
        f"""SELECT idx.*, {avg_rank('log_activity', False)}/count(*) OVER () AS expected_volatility,
 volatility > v3+1.5*(v3-v1) AS flag_stress, pressure>p3 AND maturity<m1 AS flag_mismatch,
 volatility-{avg_rank('log_activity', False)}/count(*) OVER () AS volatility_excess,
 sqrt(pow(maturity-mm,2)+pow(pressure-pm,2)) AS index_distance
 FROM idx, (SELECT quantile_cont(volatility,0.25) AS v1, quantile_cont(volatility,0.75) AS v3, quantile_cont(pressure,0.75) AS p3,
 quantile_cont(maturity,0.25) AS m1, quantile_cont(maturity,0.5) AS mm, quantile_cont(pressure,0.5) AS pm FROM idx) k""",
    ),
    "fl": (
        ("fl0",),
        """SELECT *, flag_stress::BIGINT+flag_mismatch::BIGINT+flag_scale::BIGINT+flag_distance::BIGINT AS flag_count FROM
 (SELECT fl0.*, volatility_excess>e9 AS flag_scale, index_distance>d9 AS flag_distance FROM fl0,
 (SELECT quantile_cont(volatility_excess,0.9) AS e9, quantile_cont(index_distance,0.9) AS d9 FROM fl0) k)""",
    ),
    "focus": (
        ("fl",),
        """SELECT *, 0.30*pressure+0.25*volatility+0.20*(1-predictability)+0.15*flag_count/4.0+0.10*(1-maturity) AS priority FROM fl""",
    ),
    # customers as entities
    "cust": (
        (),
        """SELECT o_custkey AS entity, count(*)::BIGINT AS orders, sum(round(o_totalprice*100)::BIGINT)::BIGINT AS cents,
 count(*) FILTER (o_orderpriority='1-URGENT')::BIGINT AS urgent FROM orders GROUP BY 1""",
    ),
    "daily": (
        (),
        """SELECT event_type AS entity, ts::DATE AS period, count(*)::BIGINT AS n, sum(round(value*100)::BIGINT)::BIGINT AS cents
 FROM events GROUP BY 1,2""",
    ),
    # numbered series of b_total per entity (0-based)
    "series": (
        ("panel",),
        """SELECT entity, period, b_total::DOUBLE AS y, row_number() OVER (PARTITION BY entity ORDER BY period)-1 AS t,
 count(*) OVER (PARTITION BY entity) AS n FROM panel""",
    ),
}


def need(names: tuple[str, ...], extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> list[str]:
    pool = CTE | (extra or {})
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in pool[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def build(names: str, tail: str, **extra: str) -> str:
    """``WITH`` the named expressions (and extra ones, in order) then ``tail``."""
    parts = [f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in need(tuple(names.split()))]
    parts += [f"{n} AS MATERIALIZED ({body})" for n, body in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + tail
