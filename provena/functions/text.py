"""Extraction from text as Catalyst expressions: one pass over a row, no Python on executors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions import fixed


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lookup(c: Column, table: dict, default=None) -> Column:
    """The table's value for ``c``; its ``default`` for others and null."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def hits(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur in the text, as substrings."""
    return reduce(lambda a, t: a + F.contains(text, F.lit(t)).cast("int"), terms, F.lit(0))


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether one of the terms occurs, as one pattern: a long chain of tests outgrows a compiled method."""
    return text.rlike("|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in terms))


def ignoring_case(pattern: str) -> str:
    return "(?i)" + pattern


def pricing(text: Column) -> Column:
    """struct(status, price, currency, unit, n_prices) of a page's text."""
    t = _text(text)
    tokens = F.regexp_extract_all(t, F.lit(ignoring_case(fixed.PRICE)), F.lit(1))
    values = F.transform(F.regexp_extract_all(t, F.lit(ignoring_case(fixed.PRICE)), F.lit(2)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))

    def of(v: Column) -> Column:
        seen = F.array_distinct(v)
        found = F.when(t.rlike(ignoring_case(fixed.PRICE_RANGE)), "PRICE_RANGE").when(t.rlike(ignoring_case(fixed.STARTING)), "STARTING_FROM")
        found = found.when((F.size(seen) >= 2) & (F.array_max(seen) > F.array_min(seen) * 1.5), "CONFLICTING").otherwise("EXACT_PRICE")
        none = F.when(t.rlike(ignoring_case(fixed.RATE_CARD_PRICE)), "RATE_CARD_FOUND").when(t.rlike(ignoring_case(fixed.QUOTE_PHRASE)), "QUOTE_REQUIRED").when(t.rlike(ignoring_case(fixed.CONTACT_PRICE)), "CONTACT_FOR_PRICING").otherwise("NOT_FOUND")
        status = F.when(F.size(v) > 0, found).otherwise(none)
        unit = F.nullif(F.lower(F.regexp_extract(t, ignoring_case(fixed.UNIT), 1)), F.lit(""))
        priced = F.size(v) > 0
        return F.struct(status.alias("status"), F.when(status != "CONFLICTING", F.get(v, 0)).alias("price"), F.when(priced, lookup(F.lower(F.get(tokens, 0)), fixed.CURRENCY)).alias("currency"), F.when(priced, unit).alias("unit"), F.size(v).alias("n_prices"))

    return F.element_at(F.transform(F.array(values), of), 1)


def emails(text: Column) -> Column:
    """Distinct lower-cased e-mail addresses in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_text(text), F.lit(fixed.EMAIL), F.lit(0)), F.lower))


def email_confidence(email: Column) -> Column:
    """Role addresses .85, first.last .7, others .55."""
    local = F.substring_index(F.lower(email), "@", 1)
    return F.when(local.isin(*fixed.ROLE_LOCALPARTS), 0.85).when(local.rlike(fixed.NAMED_PERSON), 0.7).otherwise(0.55)


def privacy_class(email: Column) -> Column:
    return F.when(email_confidence(email) == 0.7, "named_person_high_sensitivity").otherwise("business_contact")


def quote_channels(text: Column, links: Column, url: Column) -> Column:
    """Distinct (type, value) of a page, links first."""
    t = _text(text)
    of_link = lambda x: F.struct(F.when(x.rlike(ignoring_case(fixed.RFQ_LINK)), "rfq_form").when(x.rlike(ignoring_case(fixed.CONTACT_LINK)), "contact_page").when(x.rlike(ignoring_case(fixed.RATE_CARD)), "rate_card").alias("type"), x.alias("value"))
    from_links = F.filter(F.transform(F.coalesce(links, F.array().cast("array<string>")), of_link), lambda x: x["type"].isNotNull())
    one = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    phones = F.filter(F.regexp_extract_all(t, F.lit(fixed.PHONE), F.lit(0)), lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= 7)
    rest = F.filter(
        F.array(
            one("contact_email", F.get(F.regexp_extract_all(t, F.lit(fixed.EMAIL), F.lit(0)), 0)),
            one("phone", F.trim(F.get(phones, 0))),
            one("portal_login_required", F.when(t.rlike(ignoring_case(fixed.PORTAL)), F.coalesce(url, F.lit("portal")))),
            one("rate_card", F.nullif(F.regexp_extract(t, ignoring_case(fixed.RATE_CARD), 1), F.lit(""))),
        ),
        lambda x: x["value"].isNotNull(),
    )
    return F.array_distinct(F.concat(from_links, rest))


def best_channel(channels: Column) -> Column:
    """The channel of the highest priority, the first on ties."""
    ranked = F.transform(channels, lambda x, i: F.struct(lookup(x["type"], fixed.CHANNEL_PRIORITY, 0).alias("p"), (-i).alias("i"), x.alias("x")))
    return F.array_max(ranked)["x"]


def service_terms(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(_text(text)), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*fixed.SERVICE_STOPWORDS)))


def service_match(query: Column, text: Column) -> Column:
    """struct(matched, score): the share of the query's terms in the text; matched from .34, before rounding."""
    wanted = service_terms(query)
    share = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, service_terms(text))) / F.size(wanted)).otherwise(0.0)
    return F.struct((share >= 0.34).alias("matched"), F.round(share, 3).alias("score"))


def host(url: Column) -> Column:
    h = F.lower(F.coalesce(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), url, F.lit("")))
    return F.regexp_replace(h, r"^www\.", "")


def registrable(url: Column) -> Column:
    """The last two labels of the host."""
    return F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(host(url), r"\.")), 1, 2)), 1, 2), ".")


def canonical_url(url: Column) -> Column:
    """https, lower-case host without www, no trailing slash, no tracking parameters, sorted query, no fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    keys = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~reduce(lambda a, x: a | F.startswith(F.lower(p), F.lit(x)), fixed.TRACKING_PREFIXES, F.lit(False))))
    joined = F.array_join(keys, "&")
    return F.concat(F.lit("https://"), host(bare), F.when(path == "", "/").otherwise(path), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


def _suffix(h: Column, domains: tuple[str, ...]) -> Column:
    return h.rlike(r"(?:^|\.)(?:" + "|".join(re.escape(d) for d in domains) + ")$")


def source_class(url: Column, text: Column) -> Column:
    h = host(url)
    signal = any_of(F.lower(_text(text)), fixed.BUSINESS_SIGNALS)
    return F.when(any_of(h, fixed.MARKETPLACES), "marketplace").when(_suffix(h, fixed.DISTRIBUTORS), "distributor").when(_suffix(h, fixed.MANUFACTURERS), "manufacturer").when(any_of(h, fixed.BROKERS), "broker").when(_suffix(h, fixed.AGGREGATORS), "aggregator").when(h.rlike(r"\.(gov|edu)(\.|$)"), "government").when(signal, "business").otherwise("unknown")


def reliability(source: Column) -> Column:
    return lookup(source, fixed.RELIABILITY, fixed.RELIABILITY["unknown"])


def country(name: Column, url: Column, text: Column) -> Column:
    """From the corporate suffix, else the country domain, else the first country mentioned in the table's order."""
    low, h = F.lower(_text(name)), host(url)
    out = reduce(lambda a, kv: a.when(F.contains(low, F.lit(kv[0])), kv[1]), list(fixed.SUFFIX_COUNTRY.items())[1:], F.when(F.contains(low, F.lit("pte ltd")), "Singapore"))
    out = reduce(lambda a, kv: a.when(F.endswith(h, F.lit(kv[0])), kv[1]), fixed.TLD_COUNTRY.items(), out)
    return reduce(lambda a, c: a.when(F.contains(_text(text), F.lit(c)), c), fixed.COUNTRIES, out)


def lifecycle(text: Column) -> Column:
    """The most severe lifecycle state that the text names."""
    low = F.lower(_text(text))
    out = None
    for state, words in fixed.LIFECYCLE:
        found = low.rlike(r"\b(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + r")\b")
        out = F.when(found, state) if out is None else out.when(found, state)
    return out.otherwise("unknown")


def has_pcn(text: Column) -> Column:
    low = F.lower(_text(text))
    return low.rlike(fixed.PCN_PHRASE) | low.rlike(fixed.PCN_ID)


def mpns(text: Column) -> Column:
    """Part numbers in prose: four characters or more, a letter first, with a digit; distinct, upper case."""
    words = F.regexp_extract_all(_text(text), F.lit(fixed.PROSE_MPN), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 4) & w.rlike("[0-9]")), F.upper))


def entity_key(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.regexp_replace(F.lower(name), "[^a-z0-9]", ""))


def numeric_claims(body: Column, corpus: Column) -> Column:
    """Amounts, percentages and durations of the body that the corpus doesn't hold."""
    held = F.regexp_replace(F.trim(F.lower(_text(corpus))), r"\s+", " ")
    claims = F.transform(F.regexp_extract_all(_text(body), F.lit(ignoring_case(fixed.NUMERIC_CLAIM)), F.lit(0)), lambda x: F.regexp_replace(F.trim(F.lower(x)), r"\s+", " "))
    return F.array_distinct(F.filter(claims, lambda c: ~F.contains(held, c)))


def mode(query: Column) -> Column:
    """struct(mode, confidence) from substring hits of the lexicons."""
    q = F.lower(_text(query))
    n = {k: hits(q, v) for k, v in {"sub": fixed.SUBSTITUTE_INTENT, "obs": fixed.OBSOLESCENCE_INTENT, "comp": fixed.ELECTRONICS_TERMS, "reval": fixed.REVALIDATION_INTENT, "contact": fixed.CONTACT_INTENT, "price": fixed.PRICE_INTENT, "service": fixed.SERVICE_TERMS, "intent": fixed.SERVICE_INTENT, "product": fixed.PRODUCT_TERMS}.items()}
    mpn, quantity = q.rlike(ignoring_case(fixed.QUERY_MPN)).cast("int"), q.rlike(fixed.QUANTITY).cast("int")

    def of(c: Column) -> Column:
        strong = (c["sub"] > 0) | (c["obs"] > 0) | ((c["mpn"] > 0) & (c["comp"] > 0))
        scores = [
            ("electronics_substitution", F.when(strong, 2 * c["sub"] + 1.5 * c["obs"] + 1.5 * c["comp"] + 1.5 * c["mpn"]).otherwise(0.0)),
            ("revalidation", 3.0 * c["reval"]),
            ("contact_enrichment_only", 2.0 * c["contact"] - 1.5 * c["price"] - 1.0 * c["intent"]),
            ("service_quote_required", 2.0 * c["service"] + 1.5 * c["intent"]),
            ("product_exact_price", 1.5 * c["product"] + 1.5 * c["price"] + 1.0 * c["quantity"]),
        ]
        ranked = F.reverse(F.array_sort(F.array(*(F.struct(s.cast("double").alias("s"), F.lit(-i).alias("i"), F.lit(m).alias("m")) for i, (m, s) in enumerate(scores)))))
        top, second = F.get(ranked, 0), F.get(ranked, 1)
        sure = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.3), 0.5 + 0.15 * (top["s"] - second["s"]))), 2)
        return F.struct(F.when(top["s"] <= 0, "service_quote_required").otherwise(top["m"]).alias("mode"), sure.alias("confidence"))

    counts = F.struct(*(c.alias(k) for k, c in n.items()), mpn.alias("mpn"), quantity.alias("quantity"))
    return F.element_at(F.transform(F.array(counts), of), 1)


def content_terms(query: Column) -> Column:
    words = F.regexp_extract_all(F.lower(_text(query)), F.lit(r"[a-z0-9][a-z0-9\-]*"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*fixed.CONTENT_STOPWORDS, *fixed.GENERIC_TERMS, *fixed.GEO_TERMS)))


def page_relevance(query: Column, text: Column) -> Column:
    """.6 times the share of the query's terms in the text, .4 if the page talks like a source."""
    low, terms = F.lower(_text(text)), content_terms(query)
    cover = F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms)).otherwise(1.0)
    return F.round(0.6 * cover + 0.4 * any_of(low, fixed.PROCUREMENT_SIGNALS).cast("double"), 4)


def freshness(text: Column, year: int) -> Column:
    """1 less a tenth for each year since the newest plausible year named; .5 without one."""
    years = F.filter(F.transform(F.regexp_extract_all(_text(text), F.lit(fixed.YEAR), F.lit(0)), lambda y: y.cast("int")), lambda y: y.between(1990, year + 1))
    return F.when(F.size(years) == 0, 0.5).otherwise(F.round(F.greatest(F.lit(0.0), 1 - (F.lit(year) - F.least(F.array_max(years), F.lit(year))) / 10), 4))


def skeleton(query: Column) -> Column:
    """Regions and numbers become placeholders, white space is squeezed."""
    low = F.lower(_text(query))
    low = F.regexp_replace(low, r"\b(?:" + "|".join(fixed.REGION_WORDS) + r")\b", "{region}")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\d+", "{number}"), r"\s+", " "))


def _entity(word: Column) -> Column:
    """The node id of a name or part number."""
    low = F.lower(word)
    return F.coalesce(lookup(low, fixed.MAKER_KEYS), lookup(low, fixed.SELLER_KEYS), entity_key("part", word))


def triples(text: Column) -> Column:
    """Distinct (src, rel, dst, sentence): of each sentence the first relation phrase that has an entity on both sides.

    The subject is the last entity before the phrase, the object the first after it; a part is no relation of itself.
    """
    names = sorted({**fixed.MAKER_KEYS, **fixed.SELLER_KEYS}, key=lambda n: (-len(n), n))
    entity = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(n).replace(r"\ ", " ") for n in names) + r")(?![a-z0-9])|\b[A-Za-z](?=[A-Za-z0-9]*[0-9])[A-Za-z0-9]{3,}\b"
    found = lambda c: F.regexp_extract_all(c, F.lit(entity), F.lit(0))

    def of(sentence: Column) -> Column:
        low = F.lower(sentence)
        made = []
        for phrase, rel in fixed.REL_PHRASES:
            at = F.locate(phrase, low)
            before, after = F.get(F.reverse(found(F.substring(sentence, F.lit(1), at - 1))), 0), F.get(found(F.substring(sentence, at + len(phrase), F.lit(2**31 - 1))), 0)
            src, dst = _entity(before), _entity(after)
            made.append(F.when((at > 0) & before.isNotNull() & after.isNotNull() & (src != dst), F.struct(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), sentence.alias("sentence"))))
        return F.coalesce(*made)

    sentences = F.filter(F.transform(F.split(_text(text), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_distinct(F.filter(F.transform(sentences, of), lambda t: t.isNotNull()))


def cross_references(text: Column) -> Column:
    """Distinct (original, replacement): of each line the first part number, with each of the others."""

    def of(line: Column) -> Column:
        parts = mpns(line)
        return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.get(parts, 0).alias("original"), p.alias("replacement")))

    return F.array_distinct(F.flatten(F.transform(F.split(_text(text), "\n"), of)))


def premise(text: Column) -> Column:
    """Lower case without currency marks before numbers, thousands separators or runs of white space."""
    low = F.regexp_replace(F.lower(_text(text)), fixed.PREMISE_CURRENCY, "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?<=\d),(?=\d)", ""), r"\s+", " "))


def value_grounded(value: Column, text: Column) -> Column:
    """A number must equal a whole number of the text; anything else must occur in it."""
    held, wanted = premise(text), premise(value)
    numbers = F.transform(F.regexp_extract_all(held, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    same = F.exists(numbers, lambda x: F.abs(x - wanted.try_cast("double")) < 1e-9)
    return F.when(wanted.rlike(r"^\d+(?:\.\d+)?$"), same).otherwise(F.contains(held, wanted) & (wanted != ""))


def vendor_key(name: Column) -> Column:
    """Words of a vendor's name without legal forms."""
    words = F.split(F.trim(F.regexp_replace(F.lower(_text(name)), "[^a-z0-9 ]", " ")), " +")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*fixed.VENDOR_STOPWORDS)), " ")


def channel_of_value(value: Column) -> Column:
    return F.when(F.contains(value, F.lit("@")), "contact_email").when(F.length(F.regexp_replace(value, "[^0-9]", "")) >= 7, "phone").otherwise("contact_page")


def moq(text: Column) -> Column:
    return F.regexp_replace(F.nullif(F.regexp_extract(_text(text), ignoring_case(fixed.MOQ), 1), F.lit("")), ",", "").try_cast("bigint")


def subject_tokens(subject: Column) -> Column:
    """A subject's tokens of three characters or more, or else of two."""
    raw = F.filter(F.regexp_extract_all(F.lower(_text(subject)), F.lit(fixed.CLAIM_TOKEN), F.lit(0)), lambda w: ~w.isin(*fixed.SUBJECT_STOP))
    strong = F.filter(raw, lambda w: F.length(w) >= 3)
    return F.when(F.size(strong) > 0, strong).otherwise(F.filter(raw, lambda w: F.length(w) >= 2))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(_text(text), fixed.SENTENCE_SPLIT), lambda s: F.trim(s)), lambda s: s != "")


def relation_grounded(subject: Column, value: Column, text: Column) -> Column:
    """Whether the value stands in a sentence with half of the subject's tokens, or right after one that has them."""
    tokens, held = subject_tokens(subject), sentences(text)

    def named(sentence: Column, wanted: Column) -> Column:
        words = F.regexp_extract_all(F.lower(sentence), F.lit(fixed.CLAIM_TOKEN), F.lit(0))
        return F.size(F.filter(wanted, lambda t: F.array_contains(words, t))) >= F.greatest(F.lit(1), F.floor((F.size(wanted) + 1) / 2))

    def of(x: Column) -> Column:
        s, t = x["s"], x["t"]
        return F.exists(F.transform(s, lambda one, i: value_grounded(value, one) & (named(one, t) | ((i > 0) & F.coalesce(named(F.get(s, i - 1), t), F.lit(False))))), lambda ok: ok)

    return F.element_at(F.transform(F.array(F.struct(held.alias("s"), tokens.alias("t"))), of), 1)


def lifecycle_of(text: Column, mpn: Column) -> Column:
    """The first known state of a sentence that names the part other than as another's successor."""

    def of(sentence: Column) -> Column:
        before = F.transform(F.slice(F.split(sentence, F.concat(F.lit(r"(?i)\b"), mpn, F.lit(r"\b")), -1), F.lit(1), F.size(F.split(sentence, F.concat(F.lit(r"(?i)\b"), mpn, F.lit(r"\b")), -1)) - 1), lambda b: b)
        own = F.exists(before, lambda b: ~b.rlike(ignoring_case(fixed.SUCCESSOR)))
        state = lifecycle(sentence)
        return F.when(own & (state != "unknown"), state)

    return F.coalesce(F.get(F.filter(F.transform(F.split(_text(text), fixed.SENTENCE_SPLIT), of), lambda s: s.isNotNull()), 0), F.lit("unknown"))


def unwrapped(raw: Column) -> Column:
    """The object inside an object of a single key, as JSON text; null for anything else."""
    keys = F.json_object_keys(raw)
    inner = F.element_at(F.map_values(F.from_json(raw, "map<string,string>")), 1)
    return F.when((F.size(keys) == 1) & F.json_object_keys(inner).isNotNull(), inner)


def alnum(c: Column) -> Column:
    """Lower-case letters and digits: what values and parts are compared by."""
    return F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "")


def contacts(text: Column, links: Column, repeated: bool = False) -> Column:
    """Array of (type, value, confidence): distinct addresses, phones of seven digits or more, and links to contact pages.

    A phone counts once, or with ``repeated`` at each place where it stands.
    """
    row = lambda kind, value, sure: F.struct(kind.alias("type"), value.alias("value"), sure.cast("double").alias("confidence"))
    digits = lambda p: F.regexp_replace(p, "[^0-9]", "")
    found = F.filter(F.transform(F.regexp_extract_all(_text(text), F.lit(fixed.PHONE), F.lit(0)), lambda p: F.trim(p)), lambda p: F.length(digits(p)) >= 7)
    phones = F.filter(F.transform(found, lambda p, i: F.struct(p.alias("p"), F.array_position(F.transform(found, digits), digits(p)).alias("first"), (i + 1).alias("i"))), lambda x: x["first"] == x["i"])
    if repeated:
        phones = F.transform(found, lambda p: F.struct(p.alias("p")))
    pages = F.array_distinct(F.filter(F.coalesce(links, F.array().cast("array<string>")), lambda x: x.rlike(ignoring_case(fixed.CONTACT_LINK))))
    kind = lambda x: F.when(F.contains(F.lower(x), F.lit("form")), "contact_form").otherwise("contact_page")
    return F.concat(F.transform(emails(text), lambda e: row(F.lit("email"), e, email_confidence(e))), F.transform(phones, lambda x: row(F.lit("phone"), x["p"], F.lit(0.5))), F.transform(pages, lambda x: row(kind(x), x, F.lit(0.4))))


def interleaved(first: Column, second: Column, most: int) -> Column:
    """Two lists of searches in turn, each search once whatever its case or spaces, ``most`` at most."""
    squeezed = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))), lambda x: x != "")
    low = lambda xs: F.transform(xs, lambda x: F.lower(x))

    def once(xs: Column) -> Column:
        return F.transform(F.filter(F.transform(xs, lambda x, i: F.struct(x.alias("x"), (F.array_position(low(xs), F.lower(x)) == i + 1).alias("new"))), lambda s: s["new"]), lambda s: s["x"])

    a = once(squeezed(first))
    b = F.filter(once(squeezed(second)), lambda x: ~F.array_contains(low(a), F.lower(x)))
    turns = F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b), F.lit(1)) - 1), lambda i: F.array_compact(F.array(F.get(a, i), F.get(b, i))))
    return F.slice(F.flatten(turns), 1, most)


def note_tags(entity: Column, field: Column, value: Column, disputed: Column) -> Column:
    """(geo, stage, risk) of a fact's note: the first country that it names, the stage of its field, and whether it warns."""
    low = F.lower(F.concat(F.lit(" "), _text(entity), F.lit(" "), _text(value), F.lit(" ")))
    geo = F.coalesce(*(F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), F.lit(c)) for c, words in fixed.NOTE_GEO.items()))
    stage = F.when(F.startswith(field, F.lit("contact")), "contact").otherwise(lookup(field, fixed.NOTE_STAGES, "general"))
    risk = reduce(lambda a, b: a | b, (F.contains(F.lower(_text(value)), F.lit(w)) for w in fixed.NOTE_RISKS))
    return F.struct(geo.alias("geo"), stage.alias("stage"), (F.coalesce(disputed, F.lit(False)) | risk).alias("risk"))


def _titled(label: Column) -> Column:
    """Every run of letters with a capital first."""
    runs = F.regexp_extract_all(F.lower(label), F.lit(r"([^\p{L}]*\p{L}*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.regexp_extract(r, r"^([^\p{L}]*)", 1), F.initcap(F.regexp_replace(r, r"^[^\p{L}]*", "")))), "")


def vendor(url: Column, title: Column) -> Column:
    """(name, website) of a page: the title without what is after its mark, else the host's first label; https and the host."""
    name = host(url)
    noise = rf"(?i)\s*[{re.escape(fixed.TITLE_MARKS)}]\s*(?:{'|'.join(fixed.TITLE_ENDINGS)}).*$"
    cleaned = F.regexp_replace(F.regexp_replace(_text(title), noise, ""), r"(?U)^\s+|\s+$", "")
    label = _titled(F.replace(F.substring_index(name, ".", 1), F.lit("-"), F.lit(" ")))
    called = F.when(cleaned != "", cleaned).when(name != "", label).otherwise(fixed.UNKNOWN_VENDOR)
    return F.struct(called.alias("name"), F.when(name != "", F.concat(F.lit("https://"), name)).alias("website"))
