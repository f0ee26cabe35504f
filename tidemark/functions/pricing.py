"""Price columns: discounts, tiers, labels, display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the deal rules.
MIN_POINTS, DROP_SHARE, DROP_AMOUNT, NEAR_LOW, EARLY_DROP = 3, 0.10, 2.00, 0.02, 0.05
COOLDOWN_HOURS, STALE_HOURS, FRESH_HOURS = 6, 48, 4
TIER_LABELS = {1: "Boa Oferta", 2: "Ótima Oferta", 3: "Melhor Preço"}
CONFIDENCE_LABELS = {"insufficient_data": "Dados insuficientes", "low_confidence": "⚠️ Poucos dados disponíveis", "moderate_confidence": "Confiança moderada", "high_confidence": "Alta confiança"}


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounded half up by floor, which every engine computes alike."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def mean_or_latest(avg: Column, latest: Column) -> Column:
    return F.coalesce(avg.cast("double"), latest.cast("double"))


def discount(avg: Column, latest: Column) -> Column:
    """(m - p) / m, where m is the average or else the price itself; 0 unless m is above 0."""
    m, p = mean_or_latest(avg, latest), latest.cast("double")
    return F.when(m > 0, (m - p) / F.nullif(m, F.lit(0.0))).otherwise(0.0)


def discount_known(avg: Column, latest: Column) -> Column:
    """The same, written for a known average: 0 without one."""
    return F.when(F.coalesce(avg.cast("double"), F.lit(0.0)) > 0, discount(avg, latest)).otherwise(0.0)


def discount_or_null(avg: Column, latest: Column) -> Column:
    """The ratio for ordering: null where the mean is 0."""
    m = mean_or_latest(avg, latest)
    return F.try_divide(m - latest.cast("double"), m)


def percent_shown(d: Column) -> Column:
    """The discount in whole percent, where that is above 0."""
    p = F.floor(d * 100 + 0.5)
    return F.when(p > 0, p)


def badge(percent: Column) -> Column:
    return F.when(F.abs(percent) < 1, F.lit(None).cast("string")).when(percent >= 10, "strong").when(percent > 0, "mild").otherwise("negative")


def stars(rating: Column) -> Column:
    return F.coalesce(F.floor(rating + 0.5), F.lit(0)).cast("int")


def fresh_score(score: Column, crawled_at: Column, as_of: Column, hours: int = FRESH_HOURS) -> Column:
    """The score, while the product was seen within so many hours (exactly so many is fresh)."""
    return F.when(crawled_at >= as_of - F.make_dt_interval(hours=F.lit(hours)), score)


def confidence_tier(points: Column, days: Column) -> Column:
    return F.when((points < MIN_POINTS) | (days < 1), "insufficient_data").when((days < 14) | (points < 10), "low_confidence").when((days < 45) | (points < 30), "moderate_confidence").otherwise("high_confidence")


def near_low(price: Column, low: Column) -> Column:
    return F.coalesce((low > 0) & (price <= low * (1.0 + NEAR_LOW)), F.lit(False))


def raw_score(price: Column, avg_short: Column, avg_long: Column, low_short: Column, confidence: Column) -> Column:
    """1: well below the short average; 2: below the long one too, at high confidence; 3: near the low; null: no deal."""
    drop = avg_short - price
    deal = (confidence != "insufficient_data") & (avg_short > 0) & (F.try_divide(drop, avg_short) >= DROP_SHARE) & (drop >= DROP_AMOUNT)
    tier = F.when(confidence.isin("moderate_confidence", "high_confidence") & near_low(price, low_short), 3).when((confidence == "high_confidence") & (price < avg_long), 2).otherwise(1)
    return F.when(deal, tier)


def price_status(latest: Column, low: Column, mean: Column, points: Column) -> Column:
    return F.when(points < 2, F.lit(None).cast("string")).when(latest <= low, "menor").when(latest > mean * 1.03, "aumento").otherwise("estavel")


def priority(avg: Column, price: Column) -> Column:
    """The drop below the average, in percent with two decimals."""
    return half_up(F.try_divide(avg - price, avg) * 100)


def labels(column: Column, names: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def count_label(n: Column) -> Column:
    return F.when(n == 0, "Nenhum disco de vinil encontrado").when(n == 1, "1 disco de vinil encontrado").otherwise(F.concat(n.cast("string"), F.lit(" discos de vinil encontrados")))


def page_count(total: Column, size: int = 24) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def page_range(current: int, total: int) -> list[int | None]:
    """Page numbers to offer: all of seven, else the first, the last and two on either side; None stands for a gap."""
    near = [n for n in range(1, total + 1) if total <= 7 or n in (1, total) or abs(n - current) <= 2]
    gap = {2: current > 3 and total > 7, total: current < total - 2 and total > 7}
    out: list[int | None] = []
    for i, n in enumerate(near):
        if i and (i == 1 and gap[2] or n == total and gap[total]):
            out.append(None)
        out.append(n)
    return out


def clamp_page(page: Column, pages: Column) -> Column:
    """The page to show: not behind the last one."""
    return F.least(page, pages)


def has_more(page: Column, pages: Column) -> Column:
    """Whether another page can be appended."""
    return page < pages


def sparkline_points(values: Column, width: int = 44, height: int = 18, least: float = 0.10) -> Column:
    """(x, y) of each value in a box, the range being at least a tenth of the maximum; needs two values."""
    high, low, n = F.array_max(values), F.array_min(values), F.size(values)
    span = F.greatest(high - low, high * least)
    point = lambda v, i: F.struct((i * width / (n - 1)).alias("x"), (height - F.try_divide(v - low, span) * height).alias("y"))
    return F.when(n >= 2, F.transform(values, point))


def trend_down(values: Column) -> Column:
    return F.element_at(values, -1) <= F.element_at(values, 1)


def chart_scale(values: Column, ticks: int = 5, most: int = 4) -> Column:
    """The ends of the axis, 0.8 of the lowest to 1.1 of the highest value, and evenly spaced ticks; the places (from 0) of at
    most so many labels along the other axis, first and last included; the last places of the lowest and highest value."""
    low, high, n = F.array_min(values) * 0.8, F.array_max(values) * 1.1, F.size(values)
    marks = F.transform(F.sequence(F.lit(0), F.lit(ticks - 1)), lambda i: low + (high - low) * i / (ticks - 1))
    count = F.least(n, F.lit(most))
    along = F.when(n <= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.floor(i * (n - 1) / (count - 1) + 0.5).cast("int")))
    last = lambda value: n - F.array_position(F.reverse(values), value).cast("int")
    return F.struct(low.alias("low"), high.alias("high"), marks.alias("ticks"), F.when(n > 0, along).alias("x_ticks"), last(F.array_min(values)).alias("low_at"), last(F.array_max(values)).alias("high_at"))


def local_date(ts: Column, zone: str = "America/Sao_Paulo") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_label(ts: Column, as_of: Column, zone: str = "America/Sao_Paulo") -> Column:
    """"hoje" on the local day of as_of, else day/month."""
    return F.when(local_date(ts, zone) == local_date(as_of, zone), "hoje").otherwise(F.date_format(F.from_utc_timestamp(ts, zone), "dd/MM"))


def full_label(ts: Column, zone: str = "America/Sao_Paulo") -> Column:
    """Day, month, year and time, local."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "dd/MM/yyyy HH:mm")


def within_hours(ts: Column, first: int = 8, last: int = 22, zone: str = "America/Sao_Paulo") -> Column:
    h = F.hour(F.from_utc_timestamp(ts, zone))
    return (h >= first) & (h < last)
