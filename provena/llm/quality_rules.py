"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Everything over documents is DataFrame functions. The votes of R rules fall into at most 3^R patterns; their counts,
the only thing collected, are what the expectation-maximisation runs on, so its cost does not depend on the corpus.
The classes are good and, for each rule, bad in that rule's way; how often each class gets a rule's bad vote is
estimated together with the documents' classes. A document is kept when the posterior probability of being good is at
least ``threshold`` and the two base limits hold.

Null and empty texts have zeros everywhere and fail the base limits. Rows are independent: repeated rows repeat their
result. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import written
from provena.llm.native import let

SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
ROUNDS = 200
#: How often votes on good texts are right beforehand, and the votes of it that stay.
RIGHT, PRIOR = 0.95, 10.0
#: Bad votes among a rule's votes on good texts, at most: the rules' limits are set for that.
MISTAKES = 0.005


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are hashed to 64 bits, sorted with their places, and those equal to a neighbour are kept; each adds the
    words up to the next kept window, three at most.
    """
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            n = F.size(s)
            hits = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i + 1 < n) & (F.get(s, i + 1)["h"] == x["h"])))
            at = F.array_sort(F.transform(hits, lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n")), lambda a: a["n"]))

        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(placed, again))

    return F.when(F.size(words) >= 4, let(grams, covered)).otherwise(F.lit(0).cast("long"))


def stats(docs: DataFrame) -> DataFrame:
    """(doc_id, and what the rules look at) over whole texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")

    def row(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"))

    out = docs.select("doc_id", let(words, row).alias("x"), F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"), _count(text, SYMBOLS).cast("long").alias("n_symbols"), _count(text, UPPER).cast("long").alias("n_upper"), _count(text, "!?").cast("long").alias("n_exclaim"))
    return out.select("doc_id", "x.n_words", "word_chars", "n_symbols", F.col("x.lines.dup").alias("n_dup_lines"), "x.n_repeat_words", F.col("x.lines.n").alias("n_lines"), "n_upper", "n_exclaim")


def _vote(bad: Column, good: Column) -> Column:
    """1 bad, 2 good, 0 abstains; rules that see no words abstain."""
    return F.when(F.col("n_words") == 0, 0).when(bad, 1).when(good, 2).otherwise(0)


def rules() -> dict[str, Column]:
    """Name and vote, good well inside a limit and bad outside it. A text's length is no vote: the base limit on words decides it.

    A text that fails one rule gets good votes from others, as single statistics see one kind of badness each. One
    line says nothing about repeated lines.
    """
    w, c, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    mean = c / w
    return {
        "word_length": _vote((mean < 2.5) | (mean > 9), (mean >= 3) & (mean <= 8)),
        "symbols": _vote(F.col("n_symbols") * 10 > w, F.col("n_symbols") * 50 <= w),
        "duplicate_lines": _vote(F.col("n_dup_lines") * 10 > lines * 3, (F.col("n_dup_lines") * 10 <= lines) & (lines >= 2)),
        "repetition": _vote(F.col("n_repeat_words") * 4 > w, F.col("n_repeat_words") * 10 <= w),
        "upper_case": _vote(F.col("n_upper") * 2 > c, F.col("n_upper") * 5 <= c),
        "shouting": _vote(F.col("n_exclaim") * 5 > w, F.col("n_exclaim") * 20 <= w),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation over the patterns' counts.

    A text is good or bad in the way of one rule that votes it bad, so one without bad votes is good. Abstaining says
    nothing, and a text without votes is at 0.5. Other rules' votes tell whether a bad vote is a good text's accident:
    they are weighed by how often the rule votes a class bad. Classes' shares start from the votes, in proportion.
    """
    width = len(next(iter(patterns))) if patterns else 0
    normal = lambda x: [v / sum(x) for v in x]
    share = {p: normal([float(p.count(2)), *(float(v == 1) for v in p)]) for p in patterns if any(p)}
    for _ in range(rounds):
        masses = [PRIOR + sum(patterns[p] * x[k] for p, x in share.items()) for k in range(width + 1)]
        prior = normal(masses)
        bad = []  # by class and rule: bad votes among its votes
        for k in range(width + 1):
            bad.append([])
            for j in range(width):
                votes = sum(patterns[p] * x[k] for p, x in share.items() if p[j])
                against = sum(patterns[p] * x[k] for p, x in share.items() if p[j] == 1)
                rate = (against + PRIOR * (0.5 if k else 1 - RIGHT)) / (votes + PRIOR)
                bad[k].append(min(0.999 if k else MISTAKES, max(0.001, rate)))
        moved = 0.0
        for p, old in share.items():
            fits = [prior[k] * math.prod(bad[k][j] if v == 1 else 1 - bad[k][j] for j, v in enumerate(p) if v and j != k - 1) if not k or p[k - 1] == 1 else 0.0 for k in range(width + 1)]
            share[p] = normal(fits)
            moved = max(moved, abs(share[p][0] - old[0]))
        if moved < 1e-9:
            break
    return {p: share[p][0] if p in share else 0.5 for p in patterns}


def classify(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document its statistics, ``quality`` (the posterior), ``base_failed`` and ``kept``."""
    spark = docs.sparkSession
    table = written(stats(docs), "stats")
    named = rules()
    code = sum((v * 3**j for j, v in enumerate(named.values())), F.lit(0)).cast("int")
    # At most 3^6 rows.
    counts = {r["votes"]: r["n"] for r in table.groupBy(code.alias("votes")).agg(F.count("*").alias("n")).collect()}
    posterior = estimate({tuple(v // 3**j % 3 for j in range(len(named))): n for v, n in counts.items()})
    rows = [(sum(v * 3**j for j, v in enumerate(p)), q) for p, q in posterior.items()]
    quality = F.element_at(F.create_map(*[x for v, q in rows for x in (F.lit(v), F.lit(q))]), code) if rows else F.lit(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = table.withColumn("quality", quality)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality")
