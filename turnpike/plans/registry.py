"""Named queries: a callable of (spark, folder) and, where SQL can say it, the equivalent DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The movements relation as a DuckDB common table expression ``m``.
MOV = """m as (
    select *, case when mvt_id % 41 <> 0 then sched_us + mvt_id % 7 * 60000000 end as eobt_us, case when mvt_id % 43 <> 0 then sched_us + mvt_id % 5 * 60000000 end as iobt_us,
           case when mvt_id % 53 <> 0 then sched_us + mvt_id % 11 * 60000000 end as lobt_us,
           case when phase = 'DEP' and mvt_id % 67 <> 0 then block_us + (mvt_id % 9 - 4) * 30000000 end as aobt_us
    from (select event_id as mvt_id, case when event_type in ('view', 'signup') then 'ARR' else 'DEP' end as phase,
           'A' || (user_id % 10) as airport, 'A' || ((user_id + event_id) % 12) as ades, case when event_id % 50 <> 0 then 'R' || (event_id % 3) end as runway,
           case when event_id % 97 <> 0 then 'S' || user_id end as stand, 'T' || (event_id % 4) as actype,
           case when event_id % 5 <> 0 then 'W' || (event_id % 2) end as wake, case when event_id % 29 <> 0 then 'O' || (user_id % 7) end as operator,
           epoch_us(ts) as t_us,
           case when event_type in ('view', 'signup') then epoch_us(ts) + floor(value * 20000000)::bigint
                else epoch_us(ts) - floor(value * 20000000)::bigint end as block_us,
           (case when event_type in ('view', 'signup') then epoch_us(ts) + floor(value * 20000000)::bigint
                 else epoch_us(ts) - floor(value * 20000000)::bigint end)
             - (regexp_extract(props, '([0-9]+)', 1)::bigint - 30) * 20000000 as sched_us,
           floor(value * 20)::bigint as taxi, (regexp_extract(props, '([0-9]+)', 1)::bigint - 30) * 20 as d, value, user_id, ts
    from events)
)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
