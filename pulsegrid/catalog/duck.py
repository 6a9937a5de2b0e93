"""View definitions for the SQL side of the comparison."""

from __future__ import annotations

POLLER = """poller AS (SELECT concat('CI-', e.user_id) AS ci_name,
  CASE WHEN e.user_id % 2 = 0 THEN 'Interface' ELSE 'Logical Connection' END AS ci_type,
  e.ts AS event_date_time,
  CASE WHEN e.event_type IN ('view','click') THEN 'in_bandwidth_pct' ELSE 'out_bandwidth_pct' END AS event_type,
  CASE WHEN e.user_id % 4 < 2 THEN 'CE' ELSE 'PE' END AS device_role,
  e.value AS event_value,
  concat('SITE-', e.user_id % 25) AS site_name,
  CASE WHEN e.user_id % 7 = 0 THEN NULL ELSE n.n_name END AS site_country,
  CASE WHEN e.user_id % 11 = 0 THEN NULL ELSE concat(7 + e.user_id % 3, '-', 17 + e.user_id % 3) END AS site_business_hours,
  CASE WHEN e.user_id % 5 = 0 THEN 'Unknown' WHEN e.user_id % 5 = 1 THEN 'low' WHEN e.user_id % 5 = 2 THEN 'medium'
       WHEN e.user_id % 5 = 3 THEN 'high' ELSE 'very high' END AS site_criticality,
  CASE WHEN e.user_id % 9 = 0 THEN 'Switch' ELSE 'IP Router' END AS device_type_label,
  CASE WHEN e.user_id % 10 = 0 THEN 'TENANT_B' ELSE 'TENANT_A' END AS customer_name
FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25)"""

AT_RISK = "at_risk AS (SELECT DISTINCT ci_name FROM poller WHERE site_criticality IN ('high', 'very high'))"

HOURLY = """hourly AS (SELECT ci_name, ci_type, device_role, site_name, site_country, site_criticality, site_business_hours,
  CAST(day(event_date_time) AS INT) AS event_day, CAST(hour(event_date_time) AS INT) AS event_hour,
  max(CASE WHEN event_value > 100 THEN 100 ELSE event_value END) AS max_event_value
FROM poller
WHERE event_type = 'in_bandwidth_pct' AND device_type_label = 'IP Router' AND customer_name = 'TENANT_A'
  AND event_date_time >= TIMESTAMP '2024-01-01 00:00:00' AND event_date_time < TIMESTAMP '2024-02-01 00:00:00' {extra}
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9)"""

SUPPLIER_DAILY = """supplier_daily AS (SELECT concat('CI-', l_suppkey) AS ci_name,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Interface' ELSE 'Logical Connection' END AS ci_type,
  l_shipdate AS event_date_time,
  CAST(year(l_shipdate) AS INT) AS event_year, CAST(month(l_shipdate) AS INT) AS event_month,
  max(l_quantity * 2) AS event_value
FROM lineitem
WHERE l_returnflag = 'R'
  AND l_shipdate >= TIMESTAMP '1996-12-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-07-01 00:00:00'
GROUP BY 1, 2, 3, 4, 5)"""

TYPE_HOURLY = """type_hourly AS (SELECT event_type AS ci_name, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS event_date_time,
  max(CASE WHEN value > 100 THEN 100 ELSE value END) AS event_value
FROM events GROUP BY 1, 2)"""

SUPPLIER_WEEKLY = """supplier_weekly AS (SELECT concat('CI-', l_suppkey) AS ci_name,
  CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS event_date_time,
  max(l_quantity * 2) AS event_value
FROM lineitem GROUP BY 1, 2)"""

_VIEWS = {
    "poller": [POLLER],
    "at_risk": [POLLER, AT_RISK],
    "hourly": [POLLER, HOURLY.format(extra="")],
    "hourly_business": [POLLER, HOURLY.format(
        extra="AND hour(event_date_time) >= 7 AND hour(event_date_time) < 18")],
    "supplier_daily": [SUPPLIER_DAILY],
    "type_hourly": [TYPE_HOURLY],
    "supplier_weekly": [SUPPLIER_WEEKLY],
}


def sql(views: str, body: str, ctes: list[str] | None = None) -> str:
    """``WITH`` the named views (space separated), extra CTEs, then the body."""
    parts: list[str] = []
    for v in views.split():
        for text in _VIEWS[v]:
            if text not in parts:
                parts.append(text)
    parts += ctes or []
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def rounded(cols: str, digits: int = 6) -> str:
    """Comma-separated names as rounded columns of the same name."""
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in cols.split(","))
