"""Common table expressions that several queries' SQL shares: the bootstraps drawn by hash."""

from __future__ import annotations

_DRAWS = (
    "{p}d as (select scope, sample, (('0x' || substr(hash, 1 + 8 * p, 8))::bigint) % k as idx from (select scope, k, sample, chunk, md5(concat_ws('|', '{seed}', scope, sample, chunk)) as hash from (select scope, k, sample, unnest(range(0, (k + 3) // 4)) as chunk "
    "from (select distinct scope, k, unnest(range(0, {samples})) as sample from {p}n where k > {exact}))), (select unnest(range(0, 4)) as p) where chunk * 4 + p < k)"
)


def cluster_bootstrap(rows: str, samples: int, level: float, prefix: str = "b", seed: int = 0, exact_to: int = 0, pooled: bool = False) -> str:
    """CTEs over the relation ``rows`` (scope, cluster, delta), the last named ``<prefix>r``: scope, rows, clusters, mean_delta, low, high and win_rate.

    Up to ``exact_to`` clusters, every sequence of them is a sample.
    """
    p, tail = prefix, (1 - level) / 2
    value = "s as x, n::double as w" if pooled else "s / n as x, 1.0::double as w"
    exact = f"{p}e as (select scope, r as sample, (r // pow(k, j)::bigint) % k as idx from (select *, unnest(range(0, k)) as j from (select distinct scope, k, unnest(range(0, pow(k, k)::bigint)) as r from {p}n where k <= {exact_to}))), " if exact_to else ""
    both = f"(select * from {p}d union all select * from {p}e)" if exact_to else f"{p}d"
    return (
        f"{p}m as (select scope, cluster, sum(delta) as s, count(delta) as n, sum((delta < 0)::int) as wins from {rows} where delta is not null group by all), "
        f"{p}n as (select *, row_number() over (partition by scope order by cluster) - 1 as idx, count(*) over (partition by scope) as k, {value} from {p}m), "
        + _DRAWS.format(p=p, seed=seed, samples=samples, exact=exact_to) + ", " + exact
        + f"{p}s as (select d.scope, d.sample, sum(x) / sum(w) as mean from {both} d join {p}n n on n.scope = d.scope and n.idx = d.idx group by all), "
        f"{p}i as (select scope, quantile_cont(mean, {tail}) as low, quantile_cont(mean, {1 - tail}) as high from {p}s group by scope), "
        f"{p}g as (select scope, sum(n)::bigint as rows, count(*) as clusters, sum(s) / sum(n) as mean_delta, sum(wins) / sum(n) as win_rate from {p}m group by scope), "
        f"{p}r as (select *, case when high < 0 then 'lower_error' when low > 0 then 'higher_error' else 'uncertain' end as interpretation from {p}g join {p}i using (scope))"
    )


BOOTSTRAP_COLUMNS = "rows, clusters, round(mean_delta, 6) + 0.0 as mean_delta, round(low, 6) + 0.0 as low, round(high, 6) + 0.0 as high, round(win_rate, 6) as win_rate, interpretation"


def spearman_bootstrap(rows: str, unit: str, samples: int, level: float, prefix: str = "q", seed: int = 0) -> str:
    """CTEs over ``rows`` (scope, the unit's columns, x, y), the last named ``<prefix>r``: scope, low, high and samples."""
    p, tail = prefix, (1 - level) / 2
    return (
        f"{p}n as (select scope, x, y, row_number() over (partition by scope order by {unit}) - 1 as idx, count(*) over (partition by scope) as k from {rows} where x is not null and y is not null), "
        + _DRAWS.format(p=p, seed=seed, samples=samples, exact=0)
        + f", {p}t as (select scope, sample, idx, count(*) as m from {p}d group by all), {p}v as (select t.*, x, y from {p}t t join {p}n n on n.scope = t.scope and n.idx = t.idx), "
        f"{p}k as (select scope, sample, m, sum(m) over (partition by scope, sample order by x) - (sum(m) over (partition by scope, sample, x) - 1) / 2 as a, sum(m) over (partition by scope, sample order by y) - (sum(m) over (partition by scope, sample, y) - 1) / 2 as b from {p}v), "
        f"{p}s as (select scope, sample, sum(m)::double as n, sum(m * a)::double as a, sum(m * b)::double as b, sum(m * a * a)::double as aa, sum(m * b * b)::double as bb, sum(m * a * b)::double as ab from {p}k group by all), "
        f"{p}i as (select scope, (n * ab - a * b) / sqrt(n * aa - a * a) / sqrt(n * bb - b * b) as rho from {p}s where n * aa > a * a and n * bb > b * b), "
        f"{p}r as (select scope, case when count(*) >= {max(1, samples // 2)} then quantile_cont(rho, {tail}) end as low, case when count(*) >= {max(1, samples // 2)} then quantile_cont(rho, {1 - tail}) end as high, count(*) as samples from {p}i group by scope)"
    )
