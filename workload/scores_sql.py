"""SQL text of the score table, for comparison."""

from __future__ import annotations

from collections.abc import Sequence


def correlation_ctes(source: str, by: Sequence[str], prefix: str = "s") -> str:
    """CTEs ending in ``{prefix}_stats`` (by…, n, kendalltau, pearson, spearman) from
    ``source`` with columns by…, x, y. NaN is written as NULL."""
    g = ", ".join(by)
    on = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in by)
    cg = ", ".join(f"c.{c}" for c in by)
    p = prefix
    return f"""
{p}_cells AS MATERIALIZED (SELECT {g}, x, y, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY ALL),
{p}_whole AS MATERIALIZED (SELECT * FROM {p}_cells WHERE x IS NOT NULL AND y IS NOT NULL),
{p}_levels AS (SELECT DISTINCT {g}, x AS lv FROM {p}_whole),
{p}_marg AS (SELECT {cg}, l.lv, c.y, sum(CASE WHEN c.x = l.lv THEN c.n ELSE 0 END) AS at_lv, sum(CASE WHEN c.x > l.lv THEN c.n ELSE 0 END) AS above
  FROM {p}_whole c JOIN {p}_levels l ON {on('c', 'l')} GROUP BY ALL),
{p}_conc AS (SELECT {g}, sum(above * below) AS c FROM (SELECT {g}, above, sum(at_lv) OVER (PARTITION BY {g}, lv ORDER BY y
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM {p}_marg) GROUP BY ALL),
{p}_rx AS (SELECT {g}, x, nx, sum(nx) OVER (PARTITION BY {g} ORDER BY x) - nx + (nx + 1) / 2 AS rx FROM (SELECT {g}, x, sum(n) AS nx FROM {p}_whole GROUP BY ALL)),
{p}_ry AS (SELECT {g}, y, ny, sum(ny) OVER (PARTITION BY {g} ORDER BY y) - ny + (ny + 1) / 2 AS ry FROM (SELECT {g}, y, sum(n) AS ny FROM {p}_whole GROUP BY ALL)),
{p}_tx AS (SELECT {g}, sum(nx * (nx - 1) / 2) AS tx FROM {p}_rx GROUP BY ALL),
{p}_ty AS (SELECT {g}, sum(ny * (ny - 1) / 2) AS ty FROM {p}_ry GROUP BY ALL),
{p}_base AS (SELECT {g}, sum(n) AS n, sum(n * x) / sum(n) AS mx, sum(n * y) / sum(n) AS my, bool_or(x IS NULL OR y IS NULL) AS gap,
  min(x) = max(x) OR min(y) = max(y) AS flat, sum(n * (n - 1) / 2) AS txy FROM {p}_cells GROUP BY ALL),
{p}_sums AS (SELECT {cg}, sum(c.n * (c.x - b.mx) * (c.y - b.my)) AS sxy, sum(c.n * (c.x - b.mx) * (c.x - b.mx)) AS sxx, sum(c.n * (c.y - b.my) * (c.y - b.my)) AS syy,
  sum(c.n * (rx - (b.n + 1) / 2) * (ry - (b.n + 1) / 2)) AS rxy, sum(c.n * (rx - (b.n + 1) / 2) * (rx - (b.n + 1) / 2)) AS rxx, sum(c.n * (ry - (b.n + 1) / 2) * (ry - (b.n + 1) / 2)) AS ryy
  FROM {p}_whole c JOIN {p}_base b ON {on('c', 'b')} JOIN {p}_rx x ON {on('c', 'x')} AND c.x = x.x JOIN {p}_ry y ON {on('c', 'y')} AND c.y = y.y GROUP BY ALL),
{p}_all AS (SELECT {', '.join(f'b.{c}' for c in by)}, b.n, gap, flat, n * (n - 1) / 2 AS n0, tx, ty, txy, c, sxy, sxx, syy, rxy, rxx, ryy
  FROM {p}_base b LEFT JOIN {p}_conc k ON {on('b', 'k')} LEFT JOIN {p}_tx t ON {on('b', 't')} LEFT JOIN {p}_ty u ON {on('b', 'u')} LEFT JOIN {p}_sums s ON {on('b', 's')}),
{p}_stats AS MATERIALIZED (SELECT {g}, CAST(n AS BIGINT) AS n,
  CASE WHEN n < 2 OR gap THEN NULL WHEN flat THEN 0.0 ELSE (coalesce(c, 0) - (n0 - tx - ty + txy - coalesce(c, 0))) / (sqrt(n0 - tx) * sqrt(n0 - ty)) END AS kendalltau,
  CASE WHEN n < 2 OR gap THEN NULL WHEN flat THEN 0.0 ELSE sxy / (sqrt(sxx) * sqrt(syy)) END AS pearson,
  CASE WHEN n < 2 OR gap THEN NULL WHEN flat THEN 0.0 ELSE rxy / (sqrt(rxx) * sqrt(ryy)) END AS spearman FROM {p}_all)"""


def rollup_ctes(pairs: str, domain: str, by: Sequence[str] = (), prefix: str = "s", datasets: Sequence[str] = ("d0", "d1")) -> str:
    """CTEs ending in ``{prefix}_scores`` (by…, scope, lang, metric, stat, value) from
    ``pairs`` with by…, dataset, lang, metric, x, y; ``domain`` is SQL giving by…, scope, lang, metric."""
    b = "".join(f"{c}, " for c in by)
    listed = ", ".join(f"'{d}'" for d in datasets)
    keys = [*by, "scope", "lang", "metric"]
    on = " AND ".join(f"d.{c} IS NOT DISTINCT FROM t.{c}" for c in keys)
    dk = ", ".join(f"d.{c}" for c in keys)
    p = prefix
    return f"""
{p}_scoped AS (SELECT {b}'ALL' AS scope, lang, metric, x, y FROM {pairs} UNION ALL
  SELECT {b}dataset, lang, metric, x, y FROM {pairs} WHERE dataset IN ({listed})),
{correlation_ctes(f'{p}_scoped', keys, p).strip()},
{p}_wide AS (SELECT {dk}, kendalltau, pearson, spearman, list_avg(list_filter([kendalltau, pearson, spearman], lambda v: v IS NOT NULL)) AS mean
  FROM ({domain}) d LEFT JOIN {p}_stats t ON {on}),
{p}_long AS (SELECT {', '.join(keys)}, 'kendalltau' AS stat, kendalltau AS value FROM {p}_wide UNION ALL
  SELECT {', '.join(keys)}, 'pearson', pearson FROM {p}_wide UNION ALL
  SELECT {', '.join(keys)}, 'spearman', spearman FROM {p}_wide UNION ALL
  SELECT {', '.join(keys)}, 'mean', mean FROM {p}_wide),
{p}_scores AS MATERIALIZED (SELECT * FROM {p}_long UNION ALL
  SELECT {b}scope, lang, 'ALL', 'mean', avg(value) FROM {p}_long WHERE scope = 'ALL' AND stat = 'mean' GROUP BY {b}scope, lang)"""


def domain_sql(lang_metrics: dict, datasets: Sequence[str] = ("d0", "d1")) -> str:
    rows = [f"('{s}', '{l}', '{m}')" for l, ms in lang_metrics.items() for m in ms for s in ("ALL", *datasets)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v(scope, lang, metric)"


def r6(column: str) -> str:
    return f"round({column}, 6) + 0 AS {column}"
