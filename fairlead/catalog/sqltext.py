"""Building blocks of the check SQL: shared CTEs and rounding."""

from __future__ import annotations

from fairlead.catalog.registry import SETTLED_HALF
from fairlead.constants import ALL_DRIVERS, RATES
from fairlead.sources.standin import AS_OF


def fr(expr: str, dp: int = 6) -> str:
    """Floor rounding where the result itself is rounded."""
    s = 10**dp
    return f"floor(({expr})*{s}::double+0.5)/{s}::double"


def r(expr: str, dp: int = 6) -> str:
    """Rounding for comparison, see ``SETTLED_HALF``."""
    s = 10**dp
    return f"floor(({expr})*{s}::double+{SETTLED_HALF})/{s}::double"


def rc(column: str, dp: int = 6) -> str:
    return f"{r(column, dp)} as {column}"


def season(d: str) -> str:
    return (f"case when month({d}) in (12,1,2) then 'Winter' when month({d}) in (3,4,5) then 'Spring' "
            f"when month({d}) in (6,7,8) then 'Summer' else 'Fall' end")


def month(d: str) -> str:
    return f"cast(date_trunc('month', {d}) as date)"


def steps(prefix: str, source: str, pax: str, extra: str = "") -> str:
    """Waterfall of unrounded amounts as three chained CTEs ending in ``<prefix>_wf``."""
    return f"""
{prefix}_p as (select *, {pax} as pax from {source}),
{prefix}_g as (select *, pax*gross_fare_per_diem*itinerary_length as gross from {prefix}_p),
{prefix}_d as (select *, gross*discount_rate as disc, pax*promo_cost_per_pax as promo,
  pax*air_inclusive_pct*air_cost_per_pax as air, pax*taxes_fees_per_pax as tax from {prefix}_g),
{prefix}_c as (select *, (gross-disc)*commission_rate*(1-direct_booking_pct) as comm from {prefix}_d),
{prefix}_wf as (select *, gross-disc-promo-comm{extra}-air-tax as net from {prefix}_c)"""


_MED = ", ".join(f"floor(median({d})*1000000::double+0.5)/1000000::double as {d}" for d in ALL_DRIVERS)

# name -> (CTEs it needs, text); in dependency order.
CTES: dict[str, tuple[list[str], str]] = {
    "li": ([], """li as (
  select l_orderkey, count(*) as n_lines, sum(l_quantity) as qty,
         cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as gross,
         cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2))) as double) as disc,
         cast(sum(cast(l_tax as decimal(4,2))) as double) / count(*) as tax
  from lineitem group by l_orderkey)"""),
    "facts": (["li"], f"""facts as (
  select o_orderkey as sailing_id,
    concat('Ship_', cast(o_custkey % 200 as varchar)) as ship_name,
    c_mktsegment as ship_class, r_name as brand, o_orderpriority as trade,
    cast(3 + o_orderkey % 12 as int) as itinerary_length,
    cast(o_orderdate as date) as departure_date,
    cast(50 * coalesce(n_lines, 1) as int) as lower_berth_capacity,
    cast(qty as int) as passengers_booked,
    gross as gross_ticket_revenue,
    floor(gross / (qty * (3 + o_orderkey % 12)) * 100 + 0.5) / 100 as gross_fare_per_diem,
    floor(qty / (50 * n_lines) * 10000 + 0.5) / 10000 as load_factor,
    floor(disc / gross * 10000 + 0.5) / 10000 as discount_rate,
    floor(tax * 10000 + 0.5) / 10000 as commission_rate,
    cast(30 + o_custkey % 51 as double) as promo_cost_per_pax,
    cast(15 + o_orderkey % 16 as double) / 100 as direct_booking_pct,
    cast(10 + o_custkey % 16 as double) / 100 as air_inclusive_pct,
    cast(250 + (o_orderkey * 7) % 201 as double) as air_cost_per_pax,
    cast(80 + (o_custkey * 3) % 121 as double) as taxes_fees_per_pax,
    case when o_orderkey % 3 = 0 then cast(10 + o_custkey % 21 as double) * 0.4::double / 1000 else 0::double end
      as commission_override_pct,
    case when o_orderkey % 3 = 1 then cast(o_custkey % 76 as double) else 0::double end as kicker_per_cabin
  from orders left join li on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey)"""),
    "hist": (["facts"], f"""hist0 as (
  select * exclude (commission_override_pct, kicker_per_cabin), cast(month(departure_date) as bigint) as departure_month,
    {season('departure_date')} as season,
    gross_ticket_revenue*discount_rate as xd, passengers_booked*promo_cost_per_pax as xp,
    passengers_booked*air_inclusive_pct*air_cost_per_pax as xa, passengers_booked*taxes_fees_per_pax as xt
  from facts where departure_date < date '{AS_OF}'),
hist1 as (select *, (gross_ticket_revenue-xd)*commission_rate*(1-direct_booking_pct) as xc from hist0),
hist as (
  select * exclude (xd, xp, xa, xt, xc) replace ({fr('gross_ticket_revenue', 2)} as gross_ticket_revenue),
    {fr('xd', 2)} as discount_amount, {fr('xp', 2)} as promo_cost_total, {fr('xc', 2)} as ta_commission,
    {fr('xa', 2)} as air_cost_total, {fr('xt', 2)} as taxes_total,
    {fr('gross_ticket_revenue-xd-xp-xc-xa-xt', 2)} as net_ticket_revenue
  from hist1)"""),
    "future": (["facts"], f"""future as (
  select sailing_id, ship_name, ship_class, brand, trade, itinerary_length, departure_date, lower_berth_capacity,
    cast(month(departure_date) as bigint) as departure_month, {season('departure_date')} as season
  from facts where departure_date >= date '{AS_OF}' and departure_date < date '{AS_OF}' + interval 12 month)"""),
    "monthly": (["hist"], f"""monthly as (
  select {month('departure_date')} as month, brand, trade, ship_class,
    count(*) as n_sailings, cast(sum(passengers_booked) as bigint) as total_passengers,
    cast(sum(lower_berth_capacity) as bigint) as total_capacity,
    sum(passengers_booked)::double / nullif(sum(lower_berth_capacity), 0) as load_factor,
    {fr('sum(gross_fare_per_diem*passengers_booked) / nullif(sum(passengers_booked), 0)', 9)} as gross_fare_per_diem,
    sum(gross_ticket_revenue) as gross_ticket_revenue, sum(net_ticket_revenue) as net_ticket_revenue,
    {', '.join(f'avg({c}) as {c}' for c in RATES)}
  from hist group by all)"""),
    "med1": (["hist"], f"med1 as (select trade, ship_class, season, {_MED} from hist group by all)"),
    "med2": (["hist"], f"med2 as (select trade, season, {_MED} from hist group by all)"),
    "med0": (["hist"], f"med0 as (select {_MED} from hist)"),
    "fcst": (["future", "med1", "med2", "med0"], f"""fdrv as (
  select f.*, {month('departure_date')} as forecast_month,
    {', '.join(f"coalesce(a.{d}, b.{d}, c.{d}){'*1.02' if d == 'gross_fare_per_diem' else '*1.005' if d == 'load_factor' else ''} as {d}".replace('*1.02', '*1.02::double').replace('*1.005', '*1.005::double') for d in ALL_DRIVERS)}
  from future f
  left join med1 a on f.trade = a.trade and f.ship_class = a.ship_class and f.season = a.season
  left join med2 b on f.trade = b.trade and f.season = b.season
  cross join med0 c),
{steps('f', 'fdrv', 'trunc(lower_berth_capacity*load_factor)')},
fcst as (
  select sailing_id, ship_name, ship_class, brand, trade, itinerary_length, departure_date, lower_berth_capacity,
    departure_month, season, forecast_month, {', '.join(ALL_DRIVERS)}, cast(pax as bigint) as passengers_booked,
    gross as gross_ticket_revenue, disc as discount_amount, promo as promo_cost_total, comm as ta_commission,
    air as air_cost_total, tax as taxes_total, net as net_ticket_revenue
  from f_wf)"""),
}


def with_ctes(names: str, body: str, more: str = "") -> str:
    """``body`` under the named CTEs and all they need; ``more`` adds CTEs of its own after them."""
    needed: list[str] = []

    def add(n):
        for dep in CTES[n][0]:
            add(dep)
        if n not in needed:
            needed.append(n)

    for n in names.split():
        add(n)
    parts = [CTES[n][1] for n in needed] + ([more] if more else [])
    return "with " + ",\n".join(parts) + "\n" + body
