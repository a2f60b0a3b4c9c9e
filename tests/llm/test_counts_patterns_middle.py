"""Prefix token counts, row patterns and fill-in-middle against plain definitions."""

import hashlib
import random
import re
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from provena.llm import fill_in_middle, queries, row_patterns, token_counts

sys.path.insert(0, "/opt/tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a  b ", "a\tb\nc", "ﬁ ①　x", "<s>hi</s><unk>", "▁x ▁", "\x00a", "​", "éé", "😀🤦🏼‍♂️ ok", "漢字かな交じり文", "مرحبا بالعالم", "1234567890.00", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 40 + "x", "x" + " " * 75, "def f(x):\n        return x\n\n\n", "http://www.example.com/?q=1&b=%20", "ﷺ" * 3, "zzzzqqqxxwv" * 5]


@pytest.fixture(scope="module")
def plain():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_every_prefix_has_the_count_of_the_library(plain):
    rng, dp = random.Random(7), token_counts.Counter(MODEL)
    alphabet = "etaoin shrdlu  ETAQ09.,-_'\"/\n\t▁éñüß漢字😀ж—"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + [" ".join(rng.choice(["the", "internationalisation", "xqz", "don't", "Über", " ", "naïve", "12,5"]) for _ in range(20)) for _ in range(60)]
    texts += [chr(c) + chr(c) + "a" for c in range(1, 0x2FF)]
    for t in texts:
        got = dp.prefixes(t).tolist()
        assert got == [len(plain.encode(t[:i])) for i in range(len(t) + 1)], t


def test_parts_and_caches_change_nothing(plain, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("ab cde  fgh\n漢") for _ in range(20_000)) + "a" * 3000 + " " * 3000 + "b"
    whole = token_counts.Counter(MODEL).prefixes(long)
    monkeypatch.setattr(token_counts, "PART", 7)
    monkeypatch.setattr(token_counts, "CHUNKS", 5)
    monkeypatch.setattr(token_counts, "PAIRS", 5)
    assert (token_counts.Counter(MODEL).prefixes(long) == whole).all() and whole[-1] == len(plain.encode(long))


def test_token_counts_of_tables(spark, plain, monkeypatch):
    monkeypatch.setattr(token_counts, "STORED", 50)
    docs = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, "", "x"), (99, None, None), (3, ODD[3], "y"), (None, "no id", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, counts string")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.counts(df, MODEL).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(plain.encode(t or ""))) for i, t, _ in docs), key=str)
    assert token_counts.counts(df.limit(0), MODEL).count() == 0
    once = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    stored = token_counts.prefixes(once, MODEL)
    counts = {i: [len(plain.encode(t[:k])) for k in range(len(t) + 1)] for i, t in enumerate(ODD)}
    for budget in (0, 3, 10):
        want = {i: max(k for k, n in enumerate(c) if n <= budget) for i, c in counts.items()}
        assert {r["doc_id"]: r["chars"] for r in token_counts.within(stored, F.lit(budget)).collect()} == want
    asked = [(i, k) for i, c in counts.items() for k in {0, len(c) // 2, len(c) - 1}]
    got = {(r["doc_id"], r["chars"]): r["tokens"] for r in token_counts.at(stored, spark.createDataFrame(asked, "doc_id long, chars long")).collect()}
    assert got == {(i, k): counts[i][k] for i, k in asked}


def test_token_counts_query(spark, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_token_counts(spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {i: (len((t or "").encode()), n := len(plain.encode(t or "")), n > 4096) for i, t in texts.items()}


def _backtrack(rows):
    """The pattern A D+ U+ P over (ts, id, kind, cents), as a backtracking matcher tries it."""
    near = lambda i: rows[i][0] - rows[i - 1][0] <= timedelta(minutes=5)
    sound = lambda i: rows[i][2] is not None and rows[i][2] != "error" and None not in (rows[i][3], rows[i - 1][3])
    d = lambda i: near(i) and sound(i) and rows[i][3] < rows[i - 1][3]
    u = lambda i: near(i) and sound(i) and rows[i][3] > rows[i - 1][3]
    out = []
    for s in range(len(rows)):
        if rows[s][3] is None:
            continue
        p = lambda i: near(i) and rows[i][2] == "click" and rows[i][3] is not None and rows[i][3] >= rows[s][3]  # noqa: B023, E731

        def go(i, q):
            if i == len(rows):
                return None
            for letter, fits, to in {"A": [("D", d, "D")], "D": [("D", d, "D"), ("U", u, "U")], "U": [("U", u, "U"), ("P", p, None)]}[q]:  # noqa: B023
                if fits(i):
                    rest = "" if to is None else go(i + 1, to)
                    if rest is not None:
                        return letter + rest
            return None

        if (found := go(s + 1, "A")) is not None:
            m = rows[s : s + 1 + len(found)]
            out.append((m[0][1], m[-1][1], len(m), sum(r[3] for r in m), hashlib.sha256(("A" + found).encode()).hexdigest()))
    return [(n + 1, *x) for n, x in enumerate(out)]


def _clicks(seed, clients, per):
    rng, rows, k = random.Random(seed), [], 0
    for c in range(clients):
        t = datetime(2024, 1, 1)
        for _ in range(per if c else 6 * per):
            t += timedelta(seconds=rng.choice([0, 1, 60, 300, 300.000001] if rng.random() < 0.97 else [301, 9000]))
            cents = rng.choice([None, *range(6)]) if rng.random() < 0.2 else rng.randrange(12)
            rows.append((k, t, t, c, rng.choice(["click", "click", "click", "view", "view", "error", None]), None if cents is None else cents / 100, "{}"))
            k += 1
    # A fall and a rise over many blocks, whose end is only for the smaller starts.
    for i, v in enumerate([*range(60, 0, -1), *range(2, 40), 45, 39]):
        rows.append((k + i, datetime(2024, 2, 1) + timedelta(seconds=i), None, 1, "view" if v not in (20, 45) else "click", v / 100, "{}"))
    rows += [(7777, None, None, 1, "click", 1.0, "{}"), (7778, datetime(2024, 2, 1), None, None, "click", 1.0, "{}"), (7779, datetime(2024, 2, 1), None, 1, None, None, None), *rows[:9], *rows[:9]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 3, 14])
def test_row_patterns_are_those_of_a_backtracking_matcher(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(row_patterns, "BLOCK", block)
    rows = _clicks(block, 4, 60)
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
    spark.createDataFrame(rows, schema).withColumn("match_no", F.lit(1)).withColumn("_id", F.lit(1)).write.parquet(f"{tmp_path}/clicks.parquet")
    got = sorted((r["client_id"], r["match_no"], r["first_id"], r["last_id"], r["n_rows"], r["sum_cents"], r["labels_sha256"]) for r in queries.op12_row_patterns(spark, str(tmp_path)).collect())
    want = []
    for c in sorted({r[3] for r in rows if r[3] is not None}):
        mine = sorted({(r[1], r[0], r[4], None if r[5] is None else int(100 * r[5] + 0.5)) for r in rows if r[3] == c and r[1] is not None}, key=lambda r: r[:2])
        want += [(c, *x) for x in _backtrack(mine)]
    assert got == want and max(x[4] for x in want) > 60


def test_row_patterns_without_rows(spark, tmp_path):
    spark.createDataFrame([], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string").write.parquet(f"{tmp_path}/clicks.parquet")
    assert queries.op12_row_patterns(spark, str(tmp_path)).count() == 0


def test_row_patterns_of_bounded_repeats(spark, monkeypatch):
    """Of S H+ E every H is at least the start, and the last E is taken."""
    monkeypatch.setattr(row_patterns, "BLOCK", 2)
    rng = random.Random(5)
    rows = [(i % 2, i, rng.randrange(6), rng.random() < 0.3) for i in range(160)]
    steps = [row_patterns.Step("H", F.col("v") >= 0, repeat=True, bounded=True), row_patterns.Step("E", F.col("stop"))]
    found = row_patterns.find(spark.createDataFrame(rows, "k long, i long, v long, stop boolean"), "k", ["i"], "i", "v", F.col("v") > 2, steps)
    got = sorted((r["k"], r["first"], r["last"]) for r in found.collect())
    want = []
    for k in (0, 1):
        mine = [r for r in rows if r[0] == k]
        for s in range(len(mine)):
            if mine[s][2] > 2:
                high = next((j for j in range(s + 1, len(mine)) if mine[j][2] < mine[s][2]), len(mine))
                ends = [j for j in range(s + 2, min(high + 1, len(mine))) if mine[j][3]]
                want += [(k, mine[s][1], mine[ends[-1]][1])] if ends else []
    assert got == sorted(want)
    with pytest.raises(ValueError, match="last step"):
        row_patterns.find(spark.createDataFrame(rows, "k long, i long, v long, stop boolean"), "k", ["i"], "i", "v", F.lit(True), steps[:1])


def _middle(doc_id, text, pattern):
    text = text or ""
    units = [m.group() for m in re.finditer(pattern, text)]
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("pattern", "run"), [(fill_in_middle.CODE_POINT, 1), (fill_in_middle.CODE_POINT, 4), (r"\S+\s*|\s+", 1), (r"\S+\s*|\s+", 3)])
def test_fill_in_middle_is_the_plain_cut(spark, pattern, run):
    rng = random.Random(run)
    docs = [(i, "".join(rng.choice("ab c\n😀é漢  ") for _ in range(rng.randrange(30)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "has <M> in it"), (203, "<P"), (204, "P>x<"), (7, docs[7][1]), (7, "another text"), (None, "no id at all, but some words"), (205, "<<S" * 5), *((300 + i, "abcd") for i in range(40))]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, key string, n int")
    found = fill_in_middle.transform(df, pattern, run)
    rows = found.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    size = lambda x: None if x is None else len(x)
    assert sorted(((r["doc_id"], r["n"], r["form"], size(r["prefix"]), size(r["middle"]), r["output"]) for r in rows), key=str) == sorted((_middle(i, t, pattern) for i, t in docs), key=str)
    assert sorted(r["back"] for r in rows) == sorted(t or "" for _, t in docs)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"} and fill_in_middle.transform(df.limit(0)).count() == 0
