"""Scores, verdicts and decisions as Catalyst expressions over candidate columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions import fixed
from provena.functions.text import any_of, lookup


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def geo_score(country: Column, target: str | None, text: Column) -> Column:
    """Exact country, another country of the region, one of the region named in the text, a country that is not the one asked for, or unknown."""
    low = F.lower(F.coalesce(text, F.lit("")))
    serves = any_of(low, tuple(c.lower() for c in fixed.COUNTRIES))
    return F.when(country == F.lit(target), fixed.GEO_EXACT).when(country.isin(*fixed.COUNTRIES), fixed.GEO_REGION).when(serves, fixed.GEO_SERVES).when(country != F.lit(target), fixed.GEO_CONFLICT).otherwise(fixed.GEO_UNKNOWN)


def product_score(status: Column, has_moq: Column, has_site: Column, has_refs: Column, geo: Column, completeness: Column) -> Column:
    price = lookup(status, fixed.PRICE_QUALITY, 0.0)
    site = F.when(has_site & has_refs, 20.0).when(has_site, 10.0).otherwise(0.0)
    return F.round(30 * price + F.when(has_moq, 15.0).otherwise(0.0) + site + F.greatest(F.lit(0.0), geo) / 20 * 15 + 20 * completeness, 2)


def service_score(match: Column, channel: Column, geo: Column, checklist: Column, penalty: Column) -> Column:
    quality = lookup(channel, fixed.CHANNEL_QUALITY, 0.0)
    reach = F.when(channel == "contact_email", 15.0).when(channel.isNotNull(), 10.0).otherwise(0.0)
    return F.round(25 * F.least(F.lit(1.0), match) + 25 * quality + F.greatest(F.lit(0.0), geo) / 20 * 20 + reach + 10 * F.least(F.lit(1.0), checklist) + F.greatest(F.lit(-20.0), penalty), 2)


def contact_score(confidence: Column, business: Column, cross_sources: Column, domain_match: Column, geo: Column, completeness: Column) -> Column:
    own = F.least(F.lit(35.0), 35 * confidence + F.when(business, 3.0).otherwise(0.0))
    proof = 25 * (0.6 * F.least(cross_sources, F.lit(3)) / 3 + 0.4 * domain_match.cast("double"))
    return F.round(own + proof + F.greatest(F.lit(0.0), geo) * 15 / 20 + 25 * completeness, 2)


def weighted(metrics: dict[str, Column], weights: dict[str, float], conflict: Column, budget: Column) -> Column:
    """Each weighted metric rounded to four places, summed, less the penalties."""
    total = sum((F.round(F.lit(w) * metrics[k], 4) for k, w in weights.items()), F.lit(0.0))
    return F.round(total - conflict - budget, 4)


def page_score(relevance: Column, authority: Column, fresh: Column, contradiction: Column) -> Column:
    return F.round(clamp(0.4 * relevance + 0.35 * authority + 0.15 * fresh - 0.3 * contradiction), 4)


def page_verdict(relevance: Column, authority: Column, fresh: Column, contradiction: Column) -> Column:
    bad = (authority <= 0.25) | (relevance <= 0.1) | (contradiction >= 0.8)
    odd = (authority < 0.5) | (fresh <= 0.25) | (contradiction >= 0.4) | (page_score(relevance, authority, fresh, contradiction) < 0.45)
    return F.when(bad, "reject").when(odd, "flag").otherwise("accept")


def crag_verdict(mean: Column, most: Column, pages: Column) -> Column:
    return F.when(pages == 0, "incorrect").when((mean >= 0.5) | (most >= 0.6), "correct").when((mean <= 0.1) & (most <= 0.2), "incorrect").otherwise("ambiguous")


def validated(mode: Column, refs: Column, completeness: Column, threshold: Column, status: Column, channel: Column, match: Column, contacts: Column) -> Column:
    """Evidence, enough completeness, and what the mode asks for."""
    priced = status.isin("EXACT_PRICE", "PRICE_RANGE", "STARTING_FROM")
    own = F.when(mode.isin("product_exact_price", "electronics_substitution"), priced).when(mode == "service_quote_required", channel.isNotNull() & (match > 0)).otherwise(contacts > 0)
    return (refs > 0) & (completeness >= threshold) & own


def checklist(channel: Column, match: Column, identity: Column, geo: Column) -> Column:
    return F.round(0.40 * channel.cast("double") + 0.25 * match.cast("double") + 0.20 * identity.cast("double") + 0.15 * geo.cast("double"), 3)


def grade(prior: Column, exact_span: Column, grounding: Column, width: Column, spans: Column) -> Column:
    """very_low to high: the source's tier, down for weak grounding, up for independent spans."""
    tier = F.when(prior >= 0.9, 4).when(prior >= 0.6, 3).when(prior >= 0.4, 2).otherwise(1)
    tier = tier - F.when(grounding.isin("contradicted", "ungrounded"), 2).when(grounding == "complementary", 1).otherwise(0)
    tier = tier - F.when(exact_span, 0).otherwise(1) - F.when(F.coalesce(width, F.lit(0.0)) > 0.3, 1).otherwise(0)
    tier = tier + F.when((grounding == "grounded") & (spans >= 3), 1).otherwise(0)
    return F.element_at(F.array(*map(F.lit, fixed.GRADE_TIERS)), F.least(F.lit(4), F.greatest(F.lit(1), tier)))


def grounding_decision(label: Column) -> Column:
    return F.when(label == "grounded", "proceed").when(label == "contradicted", "replan").otherwise("regenerate")


def stability_days(reinforced: Column, disputes: Column, half_life: float = fixed.HALF_LIFE_DAYS) -> Column:
    return F.lit(half_life / math.log(2)) * (1 + fixed.REINFORCE_GROWTH * F.greatest(F.lit(0), reinforced)) / F.pow(F.lit(2.0), disputes)


def age_days(then: Column, now: Column) -> Column:
    """Days, to the microsecond; 0 for a future or unknown time."""
    return F.greatest(F.lit(0.0), F.coalesce((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 86_400_000_000, F.lit(0.0)))


def decayed(confidence: Column, age: Column, reinforced: Column, disputes: Column) -> Column:
    return F.round(confidence * F.exp(-age / stability_days(reinforced, disputes)), 4)


def citation_multiplier(citations: Column) -> Column:
    return F.round(1 + 0.2 * F.log2(1.0 + citations), 4)


def ltb_quantity(demand: Column, years: Column, safety: Column, short_cost: Column, carry_cost: Column) -> Column:
    """Last-time-buy quantity with the critical ratio of shortage against carrying cost; one half without shortage cost."""
    ratio = F.when((short_cost > 0) & (short_cost + carry_cost > 0), short_cost / (short_cost + carry_cost)).otherwise(0.5)
    demand, years = F.greatest(F.lit(0.0), demand), F.greatest(F.lit(0.0), years)
    return (F.ceil(demand * years) + F.ceil(demand * safety * (0.5 + ratio))).cast("long")


def counterfeit(listed: Column, authorized: Column) -> Column:
    return F.when(listed, "red").when(authorized, "green").otherwise("amber")


def stop_reason(found: Column, wanted: Column, tracker: Column, needs_channel: Column, over_time: Column) -> Column:
    return F.when(found >= wanted, "min_validated_candidates_met").when(tracker.isNotNull(), tracker).when(needs_channel, "no_quote_channel_found").when(over_time, "max_runtime_reached").otherwise("insufficient_evidence")


def trust_summary(enabled: Column, verified: Column, grade: Column, decision: Column, belief: Column, plausibility: Column, calibrated: Column, coverage: Column, disputed: Column) -> Column:
    """One sentence on a candidate's trust: its claims, its channel's interval, the guarantee, and its disputed facts.

    Without an assessment (``verified`` null), an interval (``belief`` null) or a calibration (``calibrated`` null) that
    part is left out.
    """
    said = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("n/a"))
    text = lambda c: c.cast("string")
    claims = F.when(~enabled, "claim verification disabled for this run").when(verified.isNotNull(), F.concat(text(verified), F.lit(" verified claim(s), grade "), said(grade), F.lit(", decision "), said(decision)))
    interval = F.concat(F.lit("quote-channel belief ["), text(belief), F.lit(", "), text(plausibility), F.lit("]"))
    guarantee = F.when(calibrated, F.concat(F.lit("conformal coverage >= "), text(coverage))).when(~calibrated, "conformal guarantee unavailable (uncalibrated)")
    facts = F.when(disputed > 0, F.concat(text(disputed), F.lit(" disputed fact(s) flagged"))).otherwise("no disputed facts")
    return F.concat(F.concat_ws("; ", claims, interval, guarantee, facts), F.lit("."))
