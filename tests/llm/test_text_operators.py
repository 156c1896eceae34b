"""Decontamination, line dedup, secrets, personal data and licences against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import decontam, license_scan, line_dedup, pii, secrets

DOCS = "doc_id long, text string"


def words_of(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_decontam(docs, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        m = min(8, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    found |= windows[tuple(w[s : s + m])]
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = ["the", "Cat", "É", "é", "x1", "of", "日本", "run"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 8, 9, 14]))) for i in range(12)] + [(3, text(9)), (None, "zebra"), (50, None), (51, " .. ")]
    docs = [(i, text(rng.randint(0, 30)) + ", " + rng.choice(items[:12])[1].upper() + "! " + text(5)) for i in range(25)]
    docs += [(100, None), (101, ""), (None, "a zebra"), (0, docs[0][1]), (7, "other text under the same id")]
    docs += [(200, " ".join(f"w{i}" for i in range(30_000)) + " " + items[0][1])]
    want = brute_decontam(docs, items)
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    d = d.withColumn("item_id", F.lit(1)).withColumn("hits", F.lit("clash")).withColumn("_id", F.lit(9))
    for bound in (1000, -1):
        got = decontam.decontaminate(d, b, broadcast_rows=bound).collect()
        assert sorted(((r["_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got), key=str) == want
    assert decontam.decontaminate(d.limit(0), b).count() == 0
    assert decontam.decontaminate(d, b.limit(0)).filter("n_hit > 0").count() == 0


def test_clean_cuts_hits_and_drops_documents_of_two_items(spark):
    a, b = "a1 a2 a3 a4 a5 a6 a7 a8 a9", "b1 b2 b3 b4 b5 b6 b7 b8"
    docs = [(1, f"(x) y, {a}. z!"), (2, f"{a} then {b}"), (3, "left alone -- as it is"), (4, None), (5, a)]
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    d = spark.createDataFrame(docs, DOCS).withColumn("hits", F.lit("kept"))
    got = {r["doc_id"]: r["text"] for r in decontam.clean(d, bench).collect()}
    assert got == {1: "(x) y, z!", 3: "left alone -- as it is", 4: None, 5: ""}


def test_clean_equals_cutting_word_by_word(spark):
    rng = random.Random(12)
    vocab = ["aa", "Bb", "cc", "É", "dd"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 8, 11])))) for i in range(3)]
    docs = [(i, "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(90, ". " + " ".join(items[2][1] + " zz" for _ in range(300)))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontam.clean(spark.createDataFrame(docs, DOCS), b, max_items=3).collect()}
    for i, t in docs:
        pieces = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", t)
        w, hit = words_of(t), set()
        for _, item in items:
            x = words_of(item)
            m = min(8, len(x))
            grams = {tuple(x[s : s + m]) for s in range(len(x) - m + 1)}
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in grams:
                    hit |= set(range(s, s + m))
        head = re.match(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", t)[0]
        assert got[i] == (head + "".join(p for k, p in enumerate(pieces) if k not in hit) if hit else t), i


def brute_lines(docs, min_words):
    """Every run of lines with a word, of whatever length, that has an equal run at an earlier place."""
    lines = {d: t.split("\n") for d, t in sorted(docs, key=lambda r: r[0]) if t is not None}
    weight = lambda x: len(re.findall(r"[\u3040-\u30ff\u4e00-\u9fff]|[^\s\u3040-\u30ff\u4e00-\u9fff]+", x))
    first, runs = {}, []
    for d, ls in lines.items():
        at = [i for i, x in enumerate(ls) if weight(x)]
        for a in range(len(at)):
            total = 0
            for b in range(a, len(at)):
                total += weight(ls[at[b]])
                if total >= min_words:
                    key = tuple(ls[i] for i in at[a : b + 1])
                    runs.append((d, a, b, at, key))
                    first.setdefault(key, (d, a))
    gone = {d: set() for d in lines}
    for d, a, b, at, key in runs:
        if first[key] != (d, a):
            gone[d] |= {at[i] for i in range(a, b + 1)}
    for d, ls in lines.items():  # lines without a word between two that go
        at = [i for i, x in enumerate(ls) if weight(x)]
        gone[d] |= {i for x, y in zip(at, at[1:]) if x in gone[d] and y in gone[d] for i in range(x, y)}
    return {d: "\n".join(x for i, x in enumerate(ls) if i not in gone[d]) for d, ls in lines.items()}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    pool = ["", "one", "two words", "a b c d", "e f g h i j", "  ", "k l m", "n o p q r s t u v", "tab\tand\u00a0no-break", "日本語の文", " two  spaces ", "l1\rl2"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(8)] + [(200, None), (201, ""), (202, "\n".join(["solo"] * 40)), (203, "\n" * 50)]
    for min_words in (1, 6, 20):
        want = brute_lines(docs, min_words)
        d = spark.createDataFrame(docs + [docs[3]], DOCS).withColumn("s", F.lit(1)).withColumn("_n_lines", F.lit("clash"))
        rows = line_dedup.dedup_lines(d, min_words=min_words).collect()
        assert len(rows) == len(docs) + 1
        for r in rows:
            assert r["text"] == want.get(r["doc_id"]), (r["doc_id"], min_words)
            if r["text"] is not None and r["_n_deleted"] < r["_n_lines"]:
                assert r["_n_lines"] - r["_n_deleted"] == r["text"].count("\n") + 1


def test_line_dedup_measures_against_any_earlier_copy(spark):
    a, c = " ".join(f"a{i}" for i in range(45)), " ".join(f"c{i}" for i in range(10))
    docs = [(1, f"{a}\nx"), (2, f"{a}\n{c}\ny"), (3, f"{a}\n{c}\nz"), (4, f"{c}\n{a}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: f"{a}\nx", 2: f"{c}\ny", 3: "z", 4: c}
    assert got == brute_lines(docs, 20)


def test_line_dedup_of_a_text_of_many_lines(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(100_000))
    docs = [(1, long), (2, "head\n" + long + "\ntail"), (3, "\n".join(["again"] * 100_000))]
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert rows[1]["text"] == long and rows[2]["text"] == "head\ntail" and rows[2]["_n_deleted"] == 100_000
    assert rows[3]["text"] == "\n".join(["again"] * 20)[: 6 * rows[3]["text"].count("again") - 1] and rows[3]["_n_lines"] == 100_000


def test_line_dedup_of_shuffled_join_null_ids_and_no_rows(spark):
    long = "this line is long enough to count as a run of its own"
    d = spark.createDataFrame([(None, long), (1, long), (2, "short\n" + long + "\nend")], DOCS)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d, min_words=10, broadcast_rows=-1).collect()}
    assert got == {None: long, 1: "", 2: "short\nend"}
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def brute_secrets(text):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text or "") if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_secrets_equal_brute_force_and_owners_decide(spark):
    rng = random.Random(4)
    parts = ["password", "Token", "api_key", "APIKEY=", " = ", ":", "'", "é🙂", "AKIA", "ABCDEFGH12345678", "deadbeef01", "0123456789abcdef", " ", "xyz", "secret"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), f"src{i % 5}", "en") for i in range(300)]
    shared, own = "Ab9xQ72mLp05ZtR4kWvY", "Zz81kPq0Lm3nB7vC5xTd"
    docs += [(1000 + i, f"see {shared} here", f"src{i}", "en") for i in range(3)] + [(1100, f"é {own}!", "src1", None), (1101, f"é {own}!", None, None)]
    wide, many = "Qw7eRt5yUi3oPa1sDf9g", "Mn6bVc4xZl2kJh8gFd0s"
    docs += [(1300 + i, f"{i} {wide}", "src1", f"lang{i}") for i in range(5)] + [(1400 + i, f"{i} {many}", "src1", "en") for i in range(21)]
    docs += [(1200, None, None, None), (1201, "", "src1", "en"), (1202, "x" * 300_000 + " token=abcdefg1", "src2", "de"), (None, f"null {own}", None, None)]
    d = spark.createDataFrame(docs + [docs[0]], "doc_id long, text string, source string, lang string").withColumn("hash", F.lit(0))
    rows = secrets.scan_secrets(d).withColumn("b", secrets.joined(F.col("base"))).withColumn("all", secrets.joined(F.col("spans"))).collect()
    assert len(rows) == len(docs) + 1
    text = {r[0]: r[1] for r in docs}
    for r in rows:
        assert r["b"] == ",".join(brute_secrets(text[r["_id"]])), r
        assert set(r["b"].split(",")) - {""} <= set(r["all"].split(","))
    by_id = {r["_id"]: r for r in rows}
    frequency = lambda i: tuple(by_id[i][c] for c in ("all", "most_owners", "most_repos", "most_texts"))
    assert frequency(1000) == ("copied:4:24", 3, 3, 3)  # three owners
    assert frequency(1100) == ("owned:2:22", 2, 2, 3) == frequency(1101)  # a null owner is one
    assert frequency(None) == ("owned:5:25", 2, 2, 3)
    assert frequency(1300) == ("copied:2:22", 1, 5, 5)  # one owner, but many repositories
    assert frequency(1400) == ("copied:2:22", 1, 1, 21)  # one repository, but many texts
    assert (by_id[1202]["n_assign"], by_id[1200]["n_hex"]) == (1, 0)
    assert secrets.scan_secrets(d.limit(0)).count() == 0


def test_ownership_equals_sets(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), rng.randint(0, 3), rng.randint(0, 5), rng.randint(0, 9)) for _ in range(200)]
    got = {r["hash"]: tuple(r)[1:] for r in secrets.ownership(spark.createDataFrame(rows, "hash string, owner long, repo long, _th long")).collect()}
    assert got == {h: (len({o for x, o, _, _ in rows if x == h}), len({(o, p) for x, o, p, _ in rows if x == h}), len({y for y in rows if y[0] == h})) for h in "abc"}


def brute_pii(t):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t):
            digits = re.sub(r"\D", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if k == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_pii_patterns_equal_plain_matching():
    rng = random.Random(9)
    for alphabet in ("ab.@_", "12.0", "1 -2+().", "a1b2.@+- ()%_9:0\n4é"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(t) == brute_pii(t), t
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_terms_that_disclose_an_entity_are_generalised(spark):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice(["apple", "river", "stone", "cloud", "green", "house"]) for _ in range(30))
    docs = [(i, filler()) for i in range(200)]
    docs += [(500 + i, f"{filler()} mister zoltan river a.b{0}@mail.example.com {filler()}") for i in range(4)]
    docs += [(600, None), (601, ""), (500, docs[200][1])]
    d = spark.createDataFrame(docs, DOCS).withColumn("entity", F.lit("clash")).withColumn("spans", F.lit(0))
    rows = pii.sanitise_scan(d).withColumn("all", pii.joined(F.col("spans"))).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    for r in rows:
        found = [text[r["_id"]][x["s"] : x["e"]] for x in r["spans"] if x["kind"] == 4]
        assert set(found) == ({"mister", "zoltan"} if 500 <= r["_id"] < 600 else set()), r
    got = {r["_id"]: r["text"] for r in pii.sanitise(d).collect()}
    assert "[TERM] [TERM] river [EMAIL]" in got[501] and got[600] is None
    assert pii.sanitise_scan(d.limit(0)).count() == 0


def test_terms_far_from_an_entity_of_one_document_are_generalised(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["apple", "river", "stone", "cloud", "green", "house"]) for _ in range(n))
    docs = [(i, filler(60)) for i in range(300)]
    docs += [(500, f"Zoltan {filler(200)} x.y@mail.example.com {filler(200)} zoltan"), (501, f"{filler(40)} pq@mail.example.com and 1.2.3.4 {filler(90)} Pelikan")]
    docs += [(502, f"pelikan {filler(40)} 1.2.3.4"), (503, f"{filler(20)} walter"), (504, f"walter {filler(20)} rs@mail.example.com")]
    docs += [(600 + i, f"walter {filler(9)}") for i in range(40)] + [(700, None), (504, "")]
    text = dict(docs[:-1])
    every = [pii.words(t or "") for _, t in docs]
    held = [{pii._value(k, t[a:b]) for k, a, b in pii.base_spans(t or "")} for _, t in docs]
    n_e, n_t, n_te = Counter(e for h in held for e in h), Counter(w for s in every for w in s), Counter((e, w) for h, s in zip(held, every) for e in h for w in s)
    told = set()
    for (e, w), k in n_te.items():
        p = n_e[e] / len(docs)
        if math.log((k + p * pii.PRIOR) / (n_t[w] + pii.PRIOR) / p) >= -pii.ALPHA * math.log(p):
            told.add((e, w))
    rows = pii.sanitise_scan(spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = (text[r["_id"]] or "") if r["base"] else ""
        spans = pii.base_spans(t)
        mine = {w for k, a, b in spans for e, w in told if e == pii._value(k, t[a:b])}
        expected = sorted(m.span() for m in re.finditer(r"[^\W\d_]{2,}", t) if m[0].lower() in mine and not any(a < m.end() and m.start() < b for _, a, b in spans))
        assert [(x["s"], x["e"]) for x in r["spans"] if x["kind"] == 4] == expected
    found = {r["_id"]: [text[r["_id"]][x["s"] : x["e"]] for x in r["spans"] if x["kind"] == 4] for r in rows if r["base"]}
    assert found == {500: ["Zoltan", "zoltan"], 501: ["and", "Pelikan"], 502: ["pelikan"], 504: []}


@pytest.mark.parametrize("seed", [1, 2])
def test_terms_equal_brute_force_over_random_corpora(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    entities = ["a.b@mail.example.com", "c.d@mail.example.com", "10.0.0.1", "+1 555 010 9999", "4539578763621486"]
    entities += [f"user{chr(97 + i)}@mail.example.com" for i in range(20)]
    docs = []
    for i in range(120):
        words = [rng.choice(vocab[: rng.choice([5, 60])]) for _ in range(rng.randint(0, 40))]
        words += ["z" + "".join(rng.choices("abcdef", k=6)) for _ in range(3)]  # rare ones
        words += rng.sample(entities, rng.choice([0, 0, 0, 0, 0, 0, 1, 2]))
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
    docs += [docs[7], docs[7], docs[30], (200, None), (201, ""), (None, docs[31][1])]  # a row counts as often as it is listed
    every = [pii.words(t or "") for _, t in docs]
    held = [{pii._value(k, t[a:b]) for k, a, b in brute_pii(t)} if t else set() for _, t in docs]
    n_e, n_t, n_te = Counter(e for h in held for e in h), Counter(w for s in every for w in s), Counter((e, w) for h, s in zip(held, every) for e in h for w in s)
    told = {(e, w) for (e, w), k in n_te.items() for p in [n_e[e] / len(docs)] if math.log((k + p * pii.PRIOR) / (n_t[w] + pii.PRIOR) / p) >= -pii.ALPHA * math.log(p)}
    want = []
    for (i, t), h in zip(docs, held):
        base = brute_pii(t) if t else []
        mine = {w for e, w in told if e in h}
        terms = [m.span() for m in re.finditer(r"[^\W\d_]{2,}", t or "") if m[0].lower() in mine and not any(a < m.end() and m.start() < b for _, a, b in base)]
        want.append((i, sorted([*base, *((4, a, b) for a, b in terms)])))
    got = [(r["_id"], [(x["kind"], x["s"], x["e"]) for x in r["spans"]]) for r in pii.sanitise_scan(spark.createDataFrame(docs, DOCS).withColumn("told", F.lit(1))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(x[0] == 4 for _, s in got for x in s)


def test_terms_arise_on_the_real_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = pii.sanitise_scan(d).select(F.size(F.filter("spans", lambda x: x["kind"] == 4)).alias("n"), F.size("base").alias("base")).agg(
        F.sum("n").alias("terms"), F.sum(F.when(F.col("base") == 0, F.col("n"))).alias("clean")).first()
    assert row["terms"] > 0 and row["clean"] == 0


def test_license_templates_match_themselves_and_bounds_lose_nothing(spark):
    m = license_scan.Matcher(license_scan.TEMPLATES, 0.8)
    rng = random.Random(3)
    every = [w for t in license_scan.TEMPLATES.values() for w in license_scan.normalised(t)]
    for _ in range(2000):
        base = license_scan.normalised(rng.choice(list(license_scan.TEMPLATES.values())))
        words = [rng.choice(every) if rng.random() < 0.08 else w for w in base]
        grams = license_scan.bigrams(words)
        best = max(license_scan.dice(grams, t) for t in m.templates.values())
        got = m.best(words)
        assert (got is not None) == (best >= 0.8) and (got is None or got[1] == best)
    docs = [(1, "text\n\nReleased under the MIT License.\nmore"), (2, None), (3, ""), (4, "plain " * 50_000)]
    docs += [(5, license_scan.TEMPLATES["MIT-text"].replace(". ", ".\n")), (1, docs[0][1])]
    d = spark.createDataFrame(docs, DOCS).withColumn("found", F.lit(1))
    got = sorted((r["doc_id"], [(x["first_line"], x["end_line"], x["license"]) for x in r["found"]]) for r in license_scan.scan_licenses(d).collect())
    assert got == [(1, [(2, 3, "MIT")]), (1, [(2, 3, "MIT")]), (2, []), (3, []), (4, []), (5, [(0, 2, "MIT-text")])]
    assert license_scan.scan_licenses(d.limit(0)).count() == 0


def test_license_runs_are_found_wherever_they_stand():
    m = license_scan.Matcher(license_scan.TEMPLATES, 0.8)

    def found(text):
        return [(a, b, k) for a, b, k, _ in m.scan(text)]

    assert found("Some prose before it. Released under the MIT License. And some prose after it in the same line.") == [(0, 1, "MIT")]
    assert found("Released under the MIT License. Then prose. Licensed under CC BY 4.0.") == [(0, 1, "MIT"), (0, 1, "CC-BY-4.0")]
    gpl = license_scan.TEMPLATES["GPL-3.0-notice"].replace("GNU General ", "GNU General\n// ").replace("either ", "either\n// ")
    code = "\n".join(f"int value{i} = compute(value{i});" for i in range(30))
    assert found(f"{code}\n// {gpl}\n{code}") == [(30, 33, "GPL-3.0-notice")]
    full = license_scan.TEMPLATES["MIT-full"]
    a, b = full.index("The above"), full.index("THE SOFTWARE IS")
    head = f"/* Copyright (c) 1999 The Long Name of Some Company and all its many contributors\n\n{full[:a]}\n\n{full[a:b]}\n\n{full[b:]}\n*/\n"
    assert found(head + code) == [(2, 7, "MIT-full")]


def test_license_runs_equal_all_windows():
    few = {k: license_scan.TEMPLATES[k] for k in ("MIT", "GPL-3.0", "CC-BY-4.0", "Unlicense")}
    m = license_scan.Matcher(few, 0.8)
    rng = random.Random(8)
    every = [w for t in few.values() for w in license_scan.normalised(t)] + ["other", "words"]
    for _ in range(150):
        words = []
        while len(words) < 40:
            t = license_scan.normalised(rng.choice(list(few.values())))
            words += [rng.choice(every) if rng.random() < 0.06 else w for w in t] + rng.choices(every, k=rng.randint(0, 6))
        for k, t in m.templates.items():
            dice = {(i, j): license_scan.dice(license_scan.bigrams(words[i:j]), t) for i in range(len(words)) for j in range(i + 2, min(i + m.reach[k], len(words)) + 1)}
            best = max(dice.values())
            got = [r for r in m.runs(words) if r[2] == k]
            assert all(d == dice[i, j] for i, j, _, d in got)
            assert max((r[3] for r in got), default=0.0) == (best if best >= 0.8 else 0.0)
            # every window at the threshold meets a run that is found
            assert all(any(i < y and x < j for x, y, _, _ in got) for (i, j), d in dice.items() if d >= 0.8)


def test_license_scan_equals_all_candidates():
    few = {k: license_scan.TEMPLATES[k] for k in ("MIT", "GPL-3.0", "CC-BY-4.0", "BSD-3-Clause")}
    m = license_scan.Matcher(few, 0.8)
    rng = random.Random(18)
    every = [w for t in few.values() for w in license_scan.normalised(t)] + ["other", "words"]
    for _ in range(200):
        lines = []
        for _ in range(rng.randint(1, 9)):
            t = rng.choice([*few.values(), "", "plain text here", " ".join(rng.choices(every, k=5))])
            words = [rng.choice(every) if rng.random() < 0.08 else w for w in t.split(" ")]
            lines += " ".join(words).replace(" License", "\nLicense" if rng.random() < 0.2 else " License").split("\n")
        rows = [re.findall("[a-z0-9]+", x.lower()) for x in lines]
        first = [sum(map(len, rows[:i])) for i in range(len(rows) + 1)]
        words = [w for r in rows for w in r]
        blocks, at = [], None
        for i, r in enumerate([*rows, []]):
            at = i if r and at is None else at
            if not r and at is not None:
                blocks.append((at, i))
                at = None
        spans = {(first[a], first[b]) for a, b in [*((i, i + 1) for i in range(len(rows))), *blocks, (0, len(rows))]}
        found = list(m.runs(words))
        for a, b in spans:
            grams = set(zip(words[a:b], words[a + 1 : b]))
            best = [(-2 * len(grams & t) / (len(grams) + len(t)), k) for k, t in m.templates.items()] if grams else []
            if best and -min(best)[0] >= 0.8:
                found.append((a, b, min(best)[1], -min(best)[0]))
        line, taken, want = [i for i, r in enumerate(rows) for _ in r], set(), []
        for a, b, k, d in sorted(found, key=lambda x: (-x[3], x[0], -x[1], x[2])):
            if not taken & set(range(a, b)):
                taken |= set(range(a, b))
                want.append((a, b, k, d))
        assert m.scan("\n".join(lines)) == [(line[a], line[b - 1] + 1, k, d) for a, b, k, d in sorted(want)]


def test_texts_of_very_many_spans_take_linear_time():
    began = time.time()
    text = " ".join(f"user{i}@mail{i}.example.com" for i in range(20_000))
    spans = pii.base_spans(text)
    assert len(spans) == 20_000 and pii.term_spans(text + " word", [x[1:] for x in spans], {"word"}) == [(len(text) + 1, len(text) + 5)]
    notices = "\n".join(["Released under the MIT License."] * 5_000)
    assert len(license_scan.Matcher(license_scan.TEMPLATES, 0.8).scan(notices)) == 5_000
    assert time.time() - began < 60


def test_digests_of_the_query(spark):
    d = spark.createDataFrame([("x",)], "a string").select(F.sha2(F.lit("").cast("binary"), 256).alias("s")).first()["s"]
    assert d == hashlib.sha256(b"").hexdigest()
