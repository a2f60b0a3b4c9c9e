"""Queries over claims in texts, drafts, slots, and what is promoted from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import fixed, grounding, scores, searches
from provena.functions import text as T
from provena.operators import ranking, spine, verification
from provena.operators.iterate import dealt, side
from provena.plans import query
from provena.plans.extraction import _lit
from provena.plans.inputs import duck, table, view

_MATCH = "cast(cast(floor(price) AS bigint) AS varchar)"
_AT = f"CASE WHEN contains(lower(text), {_MATCH}) THEN {_MATCH} WHEN contains(lower(text), 'quote') THEN 'quote' WHEN contains(lower(text), 'price') THEN 'price' END"


def _price():
    return F.floor("price").cast("bigint").cast("string")


@query(duck("part_pages") + f", t AS (SELECT *, {_AT} AS term, {_MATCH} AS want FROM part_pages), p AS (SELECT *, CASE WHEN term IS NULL THEN -1 ELSE strpos(lower(text), term) - 1 END AS s FROM t), x AS (SELECT *, CASE WHEN s < 0 THEN -1 ELSE s + length(term) END AS e, CASE WHEN s < 0 THEN want ELSE substr(text, s + 1, length(term)) END AS span FROM p) SELECT run_id, id, 'claim_' || left(sha256(id || ':price:' || s || ':' || e || ':' || span), 12) AS claim_id, s::int AS start, e::int AS \"end\", span, CASE WHEN s >= 0 THEN sha256(span) END AS span_hash, CASE WHEN s < 0 THEN want ELSE trim(substr(text, greatest(0, s - 180) + 1, e + 180 - greatest(0, s - 180))) END AS snippet FROM x")
def record_claims(spark, sf_dir):
    """EX8, EX9: an evidence row with its span's hash for each page's price, or the words that stand for one."""
    return spine.claim_rows(view(spark, sf_dir, "part_pages"), ["run_id", "id"], "price", _price(), ("quote", "price")).drop("field", "confidence")


def _claims(spark, sf_dir):
    """A claim of each page's price, cited from the page itself or, for each ninth, from another page."""
    p = view(spark, sf_dir, "part_pages")
    return p.select("run_id", F.concat(F.lit("k"), F.col("id").cast("string")).alias("claim_id"), F.lit("").alias("subject"), F.lit("price").alias("predicate"), _price().alias("value"), F.when(F.col("id") % 9 == 0, F.col("id") + 50).otherwise(F.col("id")).alias("page")), p


@query()
def verify_claims(spark, sf_dir):
    """INT9, EX36, EX37, JN2, JN9: claims through the whole spine; tests hold it against a plain loop."""
    return spine.verify(*_claims(spark, sf_dir), ["run_id"])


@query(duck("part_pages") + f", v AS (SELECT *, {_MATCH} AS value, list_transform(regexp_extract_all(regexp_replace(text, '([0-9]),([0-9])', '\\1\\2', 'g'), '[0-9]+(?:\\.[0-9]+)?'), lambda n: cast(n AS double)) AS numbers, regexp_extract_all(lower(text), '[a-z0-9@.+]+') AS words FROM part_pages), c AS (SELECT *, list_contains(numbers, cast(value AS double)) AS held, list_contains(words, value) AS word FROM v) SELECT run_id, id, text <> '' AND (held OR word) AS supported, CASE WHEN text = '' THEN 0.0 WHEN held OR word THEN 1.0 ELSE 0.0 END::double AS score, CASE WHEN text = '' THEN 'no_evidence' WHEN held THEN 'value_grounded' ELSE 'token_overlap' END AS method FROM c")
def check_prices(spark, sf_dir):
    """EX36: whether a page supports its price, without a subject."""
    p = view(spark, sf_dir, "part_pages")
    return p.select("run_id", "id", grounding.check(F.lit("price"), _price(), F.col("text"), F.lit("")).alias("r")).select("run_id", "id", "r.*")


_LETTER = "'Dear ' || vendor || ' Team,' || chr(10) || chr(10) || 'We are sourcing quotations for: bolts.' || chr(10) || chr(10) || 'Could you please provide a quotation covering scope of work, pricing basis, service frequency/schedule, and contract terms? We have outlined the inputs we can share in the attached checklist and would appreciate guidance on any additional details you require to quote.' || chr(10) || chr(10) || 'Kindly include your standard lead time and any minimum contract conditions.' || chr(10) || chr(10) || 'Thank you,' || chr(10) || 'Procurement Team' || CASE WHEN channel = 'contact_email' THEN ' (sent to sales@vendor.sg)' ELSE '' END"


@query(duck("candidates") + f", c AS (SELECT *, 'Vendor ' || supp AS vendor, round((0.40 * (channel IS NOT NULL)::int + 0.25 * (match_score >= 0.5)::int + 0.20 * (refs > 0)::int + 0.15 * (country IS NOT NULL)::int)::double, 3) AS done FROM candidates) SELECT run_id, seq, CASE WHEN channel IS NULL OR done < 0.65 THEN 'incomplete' ELSE 'complete' END AS status, CASE WHEN channel IS NULL THEN '' ELSE {_LETTER} END AS email, CASE WHEN flagged THEN TRUE ELSE FALSE END AS held FROM c")
def draft_rfqs(spark, sf_dir):
    """EX42, CTL7: the draft of each candidate: no letter without a channel, incomplete below .65, held for review where flagged."""
    c = view(spark, sf_dir, "candidates")
    done = scores.checklist(F.col("channel").isNotNull(), F.col("match_score") >= 0.5, F.col("refs") > 0, F.col("country").isNotNull())
    email = searches.rfq_email(F.lit("bolts"), F.concat(F.lit("Vendor "), F.col("supp").cast("string")), F.col("channel"), F.lit("sales@vendor.sg"))
    return c.select("run_id", "seq", F.when(F.col("channel").isNull() | (done < 0.65), "incomplete").otherwise("complete").alias("status"), email.alias("email"), F.col("flagged").alias("held"))


@query(duck("candidates") + ", r AS (SELECT *, completeness + confidence AS score, row_number() OVER (PARTITION BY run_id ORDER BY completeness + confidence DESC, seq) AS n, max(completeness + confidence) OVER (PARTITION BY run_id) AS top FROM candidates WHERE refs > 0) SELECT run_id, max(CASE WHEN n = 1 THEN seq END) AS primary_seq, coalesce(string_agg(seq::varchar, ',' ORDER BY n) FILTER (WHERE n BETWEEN 2 AND 4), '') AS substitutes, coalesce(string_agg(seq::varchar, ',' ORDER BY n) FILTER (WHERE n > 4), '') AS others, coalesce(round(sum(CASE WHEN n > 1 THEN round(score / top::double * 10000)::bigint END)::double / nullif(count(*) - 1, 0)) / 10000, 0.0) AS overall FROM r GROUP BY run_id")
def compose_slots(spark, sf_dir):
    """RNK5, SET1: a run's primary answer, substitutes and long tail, and their mean score."""
    c = view(spark, sf_dir, "candidates").where("refs > 0").withColumn("score", (F.col("completeness") + F.col("confidence")).cast("double"))
    s = spine.compose(c, ["run_id"], "score", "seq")
    joined = lambda n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n)
    return s.select("run_id", F.col("primary").alias("primary_seq"), joined("substitutes"), joined("others"), "overall")


@query(duck("candidates") + ", v AS (SELECT run_id, seq, CASE WHEN confidence < 0.2 THEN 'reject' WHEN confidence < 0.5 THEN 'flag' ELSE 'accept' END AS verdict, CASE line WHEN 1 THEN 'accept' WHEN 2 THEN 'flag' WHEN 3 THEN 'reject' WHEN 4 THEN 'unheard of' END AS told FROM candidates) SELECT run_id, seq, CASE WHEN told = 'reject' THEN 'reject' WHEN told = 'flag' AND verdict = 'accept' THEN 'flag' ELSE verdict END AS verdict FROM v")
def tighten_verdicts(spark, sf_dir):
    """JDG2: a model's verdict counts only if it is more severe."""
    c = view(spark, sf_dir, "candidates")
    verdict = F.when(F.col("confidence") < 0.2, "reject").when(F.col("confidence") < 0.5, "flag").otherwise("accept")
    told = T.lookup(F.col("line"), {1: "accept", 2: "flag", 3: "reject", 4: "unheard of"})
    return c.select("run_id", "seq", grounding.tightened(verdict, told).alias("verdict"))


_MEMORY = "m AS (SELECT seq, entity, field, value, score, concat('Brand#', entity % 5 + 1, entity % 4 + 1, CASE entity % 3 WHEN 0 THEN ' Sdn Bhd' ELSE '' END) AS vendor, CASE disputes WHEN 0 THEN 'active' WHEN 1 THEN 'disputed' ELSE 'stale' END AS status FROM facts)"


def _memory(spark, sf_dir):
    f = view(spark, sf_dir, "facts")
    vendor = F.concat(F.lit("Brand#"), (F.col("entity") % 5 + 1).cast("string"), (F.col("entity") % 4 + 1).cast("string"), F.when(F.col("entity") % 3 == 0, " Sdn Bhd").otherwise(""))
    status = F.when(F.col("disputes") == 0, "active").when(F.col("disputes") == 1, "disputed").otherwise("stale")
    return f.select("seq", "entity", "field", "value", "score", vendor.alias("vendor"), status.alias("status"))


_KEY = "array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g')), ' +'), lambda w: w NOT IN ('pte', 'ltd', 'sdn', 'bhd', 'llc', 'inc', 'co', 'company', 'team')), ' ')"


@query(duck("facts", "part_pages") + f", {_MEMORY}, d AS (SELECT seq, {_KEY.format('vendor')} AS k FROM m WHERE status = 'disputed'), r AS (SELECT {_KEY.format('vendor_name')} AS k, min(id) AS id FROM part_pages GROUP BY 1) SELECT d.seq, min(r.id) AS id FROM d JOIN r ON (contains(d.k, r.k) OR contains(r.k, d.k)) AND d.k <> '' AND r.k <> '' GROUP BY d.seq")
def disputed_vendor_facts(spark, sf_dir):
    """JN4: disputed facts on ranked vendors, by their names."""
    d = _memory(spark, sf_dir).where("status = 'disputed'").select(F.col("seq").alias("id"), "vendor")
    r = view(spark, sf_dir, "part_pages").select(F.col("id").alias("seq"), F.col("vendor_name").alias("vendor"))
    return verification.same_vendor(d, r, []).select(F.col("id").alias("seq"), F.col("seq").alias("id"))


@query(duck("facts") + f", {_MEMORY} SELECT seq, vendor, field, value FROM m WHERE status = 'active'")
def active_facts(spark, sf_dir):
    """FLT5: facts that are neither disputed nor stale."""
    return _memory(spark, sf_dir).where("status = 'active'").select("seq", "vendor", "field", "value")


@query(duck("candidates") + ", a AS (SELECT run_id, supp, max(confidence) AS sure FROM candidates WHERE refs > 1 GROUP BY run_id, supp) SELECT c.run_id, c.seq, CASE WHEN a.sure >= 0.6 THEN 'high' WHEN a.sure >= 0.3 THEN 'moderate' WHEN a.sure IS NOT NULL THEN 'low' END AS grade FROM candidates c LEFT JOIN a USING (run_id, supp) WHERE c.channel IS NOT NULL")
def rfq_assessments(spark, sf_dir):
    """JN14: each draft with the assessment of its vendor, if there is any."""
    c = view(spark, sf_dir, "candidates")
    a = c.where("refs > 1").groupBy("run_id", "supp").agg(F.max("confidence").alias("sure"))
    grade = F.when(F.col("sure") >= 0.6, "high").when(F.col("sure") >= 0.3, "moderate").when(F.col("sure").isNotNull(), "low")
    return c.where("channel is not null").join(a, ["run_id", "supp"], "left").select("run_id", "seq", grade.alias("grade"))


@query(duck("candidates", "facts") + ", recalled AS (SELECT DISTINCT entity AS supp FROM facts WHERE disputes = 0) SELECT run_id, seq FROM candidates WHERE supp IN (SELECT supp FROM recalled) AND refs > 0 AND completeness >= 0.5")
def memory_credits(spark, sf_dir):
    """CTL12: candidates that cite a recalled fact and are verified."""
    recalled = view(spark, sf_dir, "facts").where("disputes = 0").select(F.col("entity").alias("supp")).distinct()
    return view(spark, sf_dir, "candidates").where((F.col("refs") > 0) & (F.col("completeness") >= 0.5)).join(recalled, "supp", "left_semi").select("run_id", "seq")


@query(duck("candidates") + ", p AS (SELECT run_id, seq, supp, 'contact_email' AS field, confidence AS sure, status = 'CONFLICTING' AS disputed FROM candidates WHERE channel = 'contact_email' AND (refs >= 2 OR (refs >= 1 AND confidence >= 0.8 AND match_score >= 0.5)) UNION ALL SELECT run_id, seq, supp, 'quote_channel', 0.85, status = 'CONFLICTING' FROM candidates WHERE channel IS NOT NULL) SELECT run_id, seq, field, sure::double AS confidence, CASE WHEN disputed THEN 'review semantic fact ' || supp || ':' || field END AS review FROM p")
def promote_facts(spark, sf_dir):
    """MEM4, MEM15, CTL14: contacts with two references, or one sure one of the vendor's domain, and quote channels become facts; disputed ones a review."""
    c = view(spark, sf_dir, "candidates")
    sure = (F.col("refs") >= 2) | ((F.col("refs") >= 1) & (F.col("confidence") >= 0.8) & (F.col("match_score") >= 0.5))
    facts = F.array_compact(F.array(F.when((F.col("channel") == "contact_email") & sure, F.struct(F.lit("contact_email").alias("field"), F.col("confidence").cast("double").alias("confidence"))), F.when(F.col("channel").isNotNull(), F.struct(F.lit("quote_channel").alias("field"), F.lit(0.85).alias("confidence")))))
    rows = c.select("run_id", "seq", "supp", "status", F.explode(facts).alias("f")).select("run_id", "seq", "supp", "status", "f.*")
    review = F.when(F.col("status") == "CONFLICTING", F.concat(F.lit("review semantic fact "), F.col("supp").cast("string"), F.lit(":"), F.col("field")))
    return rows.select("run_id", "seq", "field", "confidence", review.alias("review"))


@query(duck("candidates") + ", a AS (SELECT run_id, supp, max(line <= 3) AS one, max(line > 3) AS two FROM candidates GROUP BY run_id, supp) SELECT run_id, count(*) FILTER (WHERE one AND two) AS shared, count(*) FILTER (WHERE one AND two) = 0 AS disjoint FROM a GROUP BY run_id")
def reference_overlap(spark, sf_dir):
    """SET4: references that both sides of a run cite."""
    a = view(spark, sf_dir, "candidates").groupBy("run_id", "supp").agg(F.max(F.col("line") <= 3).alias("one"), F.max(F.col("line") > 3).alias("two"))
    return a.groupBy("run_id").agg(F.count_if(F.col("one") & F.col("two")).alias("shared")).withColumn("disjoint", F.col("shared") == 0)


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosines(spark, sf_dir):
    """DD4: the cosine of each vector with the next one."""
    e = table(spark, sf_dir, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(n, "vec_id").select("vec_id", F.round(searches.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


_PARTS = "s AS (SELECT 'part:' || p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'EOL' WHEN 1 THEN 'nrnd' WHEN 2 THEN 'End of Life' WHEN 3 THEN 'active' WHEN 4 THEN 'Obsolete' ELSE NULL END AS lifecycle FROM part)"


@query(duck("edges") + f", {_PARTS}, f AS (SELECT src AS seed, dst AS id, max(confidence) AS confidence, count(*) AS refs FROM edges WHERE valid_to IS NULL AND rel IN ({', '.join(_lit(r) for r in fixed.SUBSTITUTE_RELS)}) AND src <> dst GROUP BY src, dst), v AS (SELECT f.* FROM f LEFT JOIN s USING (id) WHERE coalesce(regexp_replace(lower(lifecycle), '[^a-z0-9]+', '', 'g'), '') NOT IN ('obsolete', 'eol', 'endoflife', 'discontinued', 'inactive') AND refs > 0), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, id) AS rank FROM v) SELECT seed, id, rank FROM r WHERE rank <= 8")
def verify_substitutes(spark, sf_dir):
    """UNC8, GR9: drafted substitutes that are not out of production and have evidence, the eight surest of each part."""
    e = view(spark, sf_dir, "edges").where(F.col("valid_to").isNull() & F.col("rel").isin(*fixed.SUBSTITUTE_RELS) & (F.col("src") != F.col("dst")))
    drafts = e.groupBy(F.col("src").alias("seed"), F.col("dst").alias("id")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("refs"))
    state = T.lookup(F.col("p_size") % 6, {0: "EOL", 1: "nrnd", 2: "End of Life", 3: "active", 4: "Obsolete"})
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), state.alias("lifecycle"))
    alive = drafts.join(parts, "id", "left").where(grounding.alive(F.col("lifecycle"), F.col("refs")))
    return ranking.top_k(alive, ["seed"], [F.desc("confidence"), F.asc("id")], 8).select("seed", "id", F.col("rank").cast("long"))


@query(duck("part_pages") + ", c AS (SELECT id, query, CASE WHEN contains(lower(query), 'regulator') THEN 'voltage regulator equivalent replacement cross reference' ELSE query || ' alternative supplier' END AS back FROM part_pages) SELECT id, unnest(['broker_operator', 'step_back', 'obsolescence']) AS kind, unnest([query || ' obsolete stock rochester OR lansdale OR oemsecrets OR octopart OR avnet', back, query || ' obsolete EOL NRND NLA LTB superseded by NOS']) AS search FROM c")
def corrective_searches(spark, sf_dir):
    """EX20, EX21: what is searched after an off-target retrieval."""
    return dealt(view(spark, sf_dir, "part_pages").select("id", "query")).select("id", F.explode(searches.corrective(F.col("query"))).alias("x")).select("id", "x.kind", F.col("x.text").alias("search"))


@query(duck("candidates") + ", m AS (SELECT run_id, seq, CASE line % 4 WHEN 0 THEN 'service_quote_required' WHEN 1 THEN 'contact_enrichment_only' WHEN 2 THEN 'electronics_substitution' ELSE 'other' END AS mode, confidence FROM candidates) SELECT run_id, seq, CASE WHEN mode IN ('service_quote_required', 'contact_enrichment_only') THEN 'official_site_first' ELSE 'authorized_distributor_first' END AS first, CASE WHEN mode IN ('service_quote_required', 'contact_enrichment_only') THEN 'bolts official site' ELSE 'bolts authorized distributor,bolts Mouser Digi-Key' END AS searches, mode IN ('service_quote_required', 'electronics_substitution') AND confidence < 0.75 AS reasons FROM m")
def strategy_searches(spark, sf_dir):
    """EX50: the first strategy of a mode, its searches, and whether reasoning is asked for."""
    mode = T.lookup(F.col("line") % 4, {0: "service_quote_required", 1: "contact_enrichment_only", 2: "electronics_substitution"}, "other")
    m = view(spark, sf_dir, "candidates").select("run_id", "seq", mode.alias("mode"), "confidence")
    first = F.get(searches.strategies(F.col("mode")), 0)
    return m.select("run_id", "seq", first.alias("first"), F.array_join(searches.strategy_queries(first, F.lit("bolts")), ",").alias("searches"), searches.reasons(F.col("mode"), F.col("confidence")).alias("reasons"))


@query("SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 7 = 0 OR event_type = 'purchase' THEN 'max' ELSE 'flash' END AS tier, event_id % 7 = 0 AND event_type NOT IN ('purchase', 'error') AS escalated FROM events")
def route_tasks(spark, sf_dir):
    """EX52: planning, reasoning and high risk go to the larger model."""
    task = T.lookup(F.col("event_type"), {"purchase": "planning", "error": "reasoning"}, "extraction")
    return table(spark, sf_dir, "events").select("event_id", searches.tier(task, F.col("event_id") % 7 == 0).alias("r")).select("event_id", "r.*")


@query(duck("part_pages") + ", s AS (SELECT DISTINCT trim(regexp_replace(lower(query), '\\d+', '{number}', 'g')) AS template, length(query) AS support FROM part_pages UNION SELECT 'datasheet for lm{number} mosfet regulator', 3), q AS (SELECT id, regexp_replace(regexp_replace(lower(query), '\\bsingapore\\b', '{region}', 'g'), '\\d+', '{number}', 'g') AS k FROM part_pages), x AS (SELECT q.id, s.template, s.support, q.k = s.template AS exact, len(list_intersect(list_distinct(string_split(k, ' ')), list_distinct(string_split(template, ' ')))) / greatest(1, len(list_distinct(list_concat(string_split(k, ' '), string_split(template, ' ')))))::double AS sim FROM q, s), e AS (SELECT *, max(exact) OVER (PARTITION BY id) AS hit FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN hit THEN 0 ELSE sim END DESC, support DESC, template) AS rank FROM e WHERE CASE WHEN hit THEN exact ELSE sim >= 0.5 END) SELECT id, template, rank FROM r WHERE rank <= 5")
def retrieve_skills(spark, sf_dir):
    """MEM9: the skill of a query's very template, else those that share half of its tokens; they meet on a token."""
    p = view(spark, sf_dir, "part_pages")
    s = p.select(F.trim(F.regexp_replace(F.lower("query"), r"\d+", "{number}")).alias("template"), F.length("query").alias("support")).distinct()
    s = s.unionByName(spark.createDataFrame([("datasheet for lm{number} mosfet regulator", 3)], "template string, support int")).distinct()
    q = p.select("id", T.skeleton(F.col("query")).alias("k"))
    words = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("w")
    kinds = q.select("k").distinct()
    met = kinds.select("k", words("k")).join(s.select("template", "support", words("template")), "w").select("k", "template", "support").distinct()
    met = met.withColumns({"sim": searches.skill_match(F.col("k"), F.col("template")), "exact": F.col("k") == F.col("template")})
    told = met.groupBy("k").agg(F.max("exact").alias("any"))
    met = met.join(told, "k").where(F.when(F.col("any"), F.col("exact")).otherwise(F.col("sim") >= 0.5))
    best = ranking.top_k(met, ["k"], [F.desc(F.when(F.col("any"), 0.0).otherwise(F.col("sim"))), F.desc("support"), F.asc("template")], 5)
    return q.join(best, "k").select("id", "template", F.col("rank").cast("long"))


@query(duck("part_pages") + ", g AS (SELECT DISTINCT lower(type) AS context, 'check ' || type AS advice FROM part_pages UNION SELECT 'bulk office', 'ask for volume prices' UNION SELECT 'revalidate', 'compare dates') SELECT p.id, g.advice FROM part_pages p JOIN g ON contains(lower(p.query || ' ' || p.type), g.context)")
def guidelines_for(spark, sf_dir):
    """MEM11: the guidelines whose trigger a context holds; triggers, a counted few, are given to every task."""
    p = view(spark, sf_dir, "part_pages")
    g = p.select(F.lower("type").alias("context"), F.concat(F.lit("check "), F.col("type")).alias("advice")).distinct()
    g = g.unionByName(spark.createDataFrame([("bulk office", "ask for volume prices"), ("revalidate", "compare dates")], "context string, advice string"))
    # A trigger is found by its first word, so that contexts and triggers are joined on a key.
    word = F.regexp_extract("context", r"[a-z0-9]+", 0)
    low = F.lower(F.concat_ws(" ", "query", "type"))
    return p.select("id", low.alias("low"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)))).alias("w")).join(side(g.withColumn("w", word)), "w").where(F.contains("low", F.col("context"))).select("id", "advice")
