"""Whether evidence supports a claim, as Catalyst expressions. Scorers of models may only tighten what these say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provena.functions import fixed
from provena.functions import text as T

THRESHOLD = 0.5
#: Characters on either side of a number in which its price or quantity context is looked for.
CONTEXT = 24


def _squeezed(c: Column) -> Column:
    """Without currency marks before numbers, white space and commas."""
    return F.regexp_replace(T.premise(c), r"[\s,]", "")


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(fixed.CLAIM_TOKEN), F.lit(0)))


def _overlap(claim: Column, span: Column) -> Column:
    words = _words(claim)
    return F.when(F.size(words) > 0, F.round(F.size(F.array_intersect(words, _words(span))) / F.size(words), 4)).otherwise(0.0)


def subject_grounded(subject: Column, span: Column) -> Column:
    """Half of the subject's tokens, or the subject itself where it has none, anywhere in the span."""
    tokens = T.subject_tokens(subject)
    named = F.size(F.array_intersect(F.array_distinct(tokens), _words(span))) >= F.greatest(F.lit(1), F.floor((F.size(tokens) + 1) / 2))
    return F.when(F.size(tokens) > 0, named).otherwise((_squeezed(subject) != "") & F.contains(_squeezed(span), _squeezed(subject)))


def check(claim: Column, value: Column, span: Column, subject: Column) -> Column:
    """(supported, score, method): whether ``span`` supports the claim's value, together with its subject if it names one."""
    verdict = lambda ok, score, method: F.struct(ok.alias("supported"), score.cast("double").alias("score"), F.lit(method).alias("method"))
    yes, no = F.lit(True), F.lit(False)
    blank = F.trim(F.coalesce(span, F.lit(""))) == ""
    relation, valued = F.trim(F.coalesce(subject, F.lit(""))) != "", _squeezed(value) != ""
    together, alone = T.relation_grounded(subject, value, span), T.value_grounded(value, span)
    by_value = F.when(relation, F.when(_overlap(value, span) >= THRESHOLD, 0.0).otherwise(_overlap(value, span))).otherwise(_overlap(value, span))
    words = _overlap(F.when(F.trim(claim) != "", claim).otherwise(value), span)
    by_claim = F.when(relation & (words >= THRESHOLD) & ~subject_grounded(subject, span), 0.0).otherwise(words)
    score = F.when(valued, by_value).otherwise(by_claim)
    return (
        F.when(blank, verdict(no, F.lit(0.0), "no_evidence"))
        .when(valued & relation & together, verdict(yes, F.lit(1.0), "relation_grounded"))
        .when(valued & relation & alone, verdict(no, F.lit(0.0), "subject_ungrounded"))
        .when(valued & ~relation & alone, verdict(yes, F.lit(1.0), "value_grounded"))
        .otherwise(F.struct((score >= THRESHOLD).alias("supported"), score.cast("double").alias("score"), F.lit("token_overlap").alias("method")))
    )


def with_model(base: Column, model_score: Column, value: Column, span: Column, subject: Column) -> Column:
    """``base`` with a model's score, clamped; support without the subject beside the value is taken back. Null: ``base``."""
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), model_score)), 4)
    gated = (score >= THRESHOLD) & (F.trim(F.coalesce(subject, F.lit(""))) != "") & (_squeezed(value) != "") & ~T.relation_grounded(subject, value, span)
    lone = gated & T.value_grounded(value, span)
    told = F.struct(((score >= THRESHOLD) & ~gated).alias("supported"), F.when(lone, 0.0).otherwise(score).alias("score"), F.when(lone, "subject_ungrounded").otherwise("model").alias("method"))
    return F.when(model_score.isNull(), base).otherwise(told)


def contradicted(subject: Column, value: Column, span: Column) -> Column:
    """Whether a sentence on the subject gives another price or quantity, and none the claimed one; only numbers can be."""
    tokens = T.subject_tokens(subject)
    number = T.premise(value).rlike(r"^\d+(?:\.\d+)?$")
    pattern = F.concat(F.lit(r"(?i)\b(?:"), F.array_join(F.transform(tokens, lambda t: F.regexp_replace(t, r"([.+])", r"\\$1")), "|"), F.lit(r")\b"))

    def about(sentence: Column) -> Column:
        named = F.size(F.array_intersect(F.array_distinct(tokens), _words(sentence))) >= F.greatest(F.lit(1), F.floor((F.size(tokens) + 1) / 2))
        return F.when(F.trim(subject) == "", True).when(F.size(tokens) > 0, named).otherwise(F.contains(_squeezed(sentence), _squeezed(subject)))

    def competing(sentence: Column) -> Column:
        """Whether a number has a currency or a price word near it."""
        pieces = F.transform(F.split(sentence, fixed.COMPETING_NUMBER, -1), lambda p: F.length(p))
        found = F.regexp_extract_all(sentence, F.lit(fixed.COMPETING_NUMBER), F.lit(0))

        def near(n: Column, i: Column) -> Column:
            sizes = F.transform(F.slice(found, F.lit(1), i), lambda x: F.length(x))
            start = F.aggregate(F.concat(F.slice(pieces, F.lit(1), i + 1), sizes), F.lit(0), lambda a, x: a + x)
            first = F.greatest(F.lit(0), start - CONTEXT)
            return F.substring(sentence, first + 1, start + F.length(n) + CONTEXT - first).rlike(fixed.VALUE_CONTEXT)

        return F.exists(F.transform(found, near), lambda ok: ok)

    held = F.filter(T.sentences(span), about)
    bare = F.transform(held, lambda s: F.when(F.size(tokens) > 0, F.regexp_replace(s, pattern, F.lit(" "))).otherwise(s))
    return F.coalesce(number & ~F.exists(bare, lambda s: T.value_grounded(value, s)) & F.exists(bare, competing), F.lit(False))


def label(on_cited: Column, on_corpus: Column, subject: Column, value: Column, span: Column) -> Column:
    """grounded, complementary, contradicted or ungrounded."""
    return F.when(on_cited, "grounded").when(on_corpus, "complementary").when((F.coalesce(span, F.lit("")) != "") & contradicted(subject, value, span), "contradicted").otherwise("ungrounded")


def tightened(verdict: Column, override: Column) -> Column:
    """A page's verdict with a model's: only a more severe one counts."""
    severity = lambda c: T.lookup(c, {"accept": 0, "flag": 1, "reject": 2}, -1)
    return F.when(severity(override) > severity(verdict), override).otherwise(verdict)


def alive(lifecycle: Column, refs: Column) -> Column:
    """Whether a drafted substitute stands: it is not out of production and has evidence."""
    return ~F.regexp_replace(F.lower(F.coalesce(lifecycle, F.lit(""))), "[^a-z0-9]+", "").isin(*fixed.DEAD_LIFECYCLE) & (refs > 0)
