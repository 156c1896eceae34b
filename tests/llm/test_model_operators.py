"""Divergence, quality, encoding, near duplicates, sharding and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.llm import bpe, divergence, jaccard, quality, sharding
from sedimenta.llm.components import components
from sedimenta.llm.textstats import COMMON, counts

DOCS = "doc_id long, text string"


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é🙂\x0b\x85 ", max_size=60))
def test_base_counts(t):
    m = counts(t, "en")
    assert [m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute_counts(t)


def prose(rng, lang, n):
    return " ".join(rng.choice(COMMON[lang]) if rng.random() < 0.5 else "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(n)) + "."


def corpus(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        good = rng.random() < 0.8
        t = prose(rng, lang, rng.randint(80, 200))
        out.append((i, t if good else t.upper().replace(" ", "!! "), lang, f"src{i % 7}", int(good)))
    return out


def test_divergence_keeps_prose_and_rejects_junk(spark):
    rows = corpus(random.Random(1), 300)
    extra = [(900, None, "en", "x", 0), (901, "", None, None, 0), (902, prose(random.Random(2), "en", 60), "zz", "x", 1), rows[0]]
    d = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, good int").withColumn("n_words", F.lit("clash"))
    got = divergence.divergence_rules(d).collect()
    assert len(got) == len(rows) + len(extra)
    good = {r[0]: r[4] for r in rows}
    for r in got:
        if r["doc_id"] in good:
            assert r["kept"] == bool(good[r["doc_id"]]), r
    by = {r["doc_id"]: r for r in got}
    assert by[900]["base_failed"] and by[901]["n_words"] == 0 and not by[901]["kept"]
    assert by[902]["kept"] and by[902]["class_js"] is None  # a language with too few documents gives no verdict
    assert divergence.divergence_rules(d.limit(0)).count() == 0


def brute_divergence(rows):
    """(id, class_far, word_far, kept) by plain loops."""
    def js2(p, q):
        m = (p + q) / 2
        part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
        return (part(p) + part(q)) / 2

    def quantile(values, q):
        return sorted(values)[max(0, int(np.ceil(q * len(values) - 1e-9)) - 1)]

    found = []
    for i, t, lang in rows:
        t, lang = t or "", lang or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        kinds = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[#*$%&|<>]", r"[^\x00-\x7F]"]
        n = [len(re.findall(k, t)) for k in kinds]
        n = [*n[:5], len(t) - sum(n), n[5]]
        words = [x.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower() for x in w if len(x.encode()) < 16]
        common = [words.count(c) for c in COMMON[lang]] if lang in COMMON else None
        failed = len(w) < 50 or 100 * brute_counts(t)[4] > 50 * len(w)
        p = np.array(n) / len(t) if t else None
        q = np.array([*common, len(w) - sum(common)]) / len(w) if w and common else None
        found.append([i, lang, failed, p, q, sum(map(len, w)), len(w)])
    out = []
    for lang in {f[1] for f in found}:
        own = [f for f in found if f[1] == lang]
        good = [f for f in own if not f[2]]
        if len(good) < 20:
            out += [(f[0], False, False, not f[2]) for f in own]
            continue
        ref = np.mean([f[3] for f in good], axis=0)
        steps = [int(np.sqrt(js2(f[3], ref)) * divergence.STEPS) for f in good]
        near = [f for f, d in zip(good, steps) if d <= quantile(steps, 0.5)]
        rp, rw = np.mean([f[3] for f in near], axis=0), np.mean([f[4] for f in near], axis=0) if lang in COMMON else None

        def level(ts):
            edge = [2 ** ((np.floor(np.log2(max(quantile(ts, q), 1e-9)) * divergence.OCTAVE) + 1) / divergence.OCTAVE) for q in (0.5, 0.1)]
            return edge[0] + divergence.Z / divergence.TENTH * (edge[0] - edge[1])

        ct = lambda f: js2(f[3], rp) * f[5]
        wt = lambda f: js2(f[4], rw) * f[6]
        cl, wl = level([ct(f) for f in good]), level([wt(f) for f in good]) if lang in COMMON else None
        for f in own:
            far = [f[3] is not None and ct(f) > divergence.CLASS_FLOOR**2 * f[5] + cl, f[4] is not None and wt(f) > divergence.WORD_FLOOR**2 * f[6] + wl]
            out.append((f[0], bool(far[0]), bool(far[1]), not f[2] and not any(far)))
    return out


def test_divergence_equals_plain_loops_and_finds_wrong_languages(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, lang, rng.randint(30, 260)), lang) for i in range(240) for lang in [rng.choice(["en", "de", "fr", "es"])]]
    rows += [(300 + i, prose(rng, a, 400), b) for i, (a, b) in enumerate([("de", "en"), ("en", "de"), ("fr", "es"), ("es", "fr"), ("de", "fr"), ("fr", "en")])]
    rows += [(400 + i, prose(rng, "en", 200).upper(), "en") for i in range(5)] + [(500, None, "en"), (501, "", None), (502, prose(rng, "en", 90), "xx"), (None, rows[0][1], rows[0][2]), rows[1]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("p", F.lit(1)).withColumn("middle", F.lit("x"))
    got = [(r["doc_id"], r["class_far"], r["word_far"], r["kept"]) for r in divergence.divergence_rules(d).collect()]
    assert sorted(got, key=str) == sorted(brute_divergence(rows), key=str)
    by = {r[0]: r[1:] for r in got}
    assert all(by[300 + i][1] and not by[300 + i][2] for i in range(6))  # the words tell a wrong language
    assert not any(by[400 + i][2] for i in range(5))
    clean = [r for r in got if r[0] is not None and r[0] < 240 and len(rows[r[0]][1].split()) >= 50]
    assert sum(r[3] for r in clean) >= 0.98 * len(clean)


def test_js_distance_equals_numpy(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    arr = lambda x: F.array(*map(F.lit, x))
    got = spark.range(1).select(divergence.js_distance(arr(p), arr(q)).alias("d")).first()["d"]
    m = (np.array(p) + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    assert got == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_quality_held_out_accuracy_and_edges(spark):
    rows = corpus(random.Random(3), 400)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, good int")
    labels = d.filter("doc_id % 2 = 0").select("doc_id", F.col("good").alias("quality"), F.lit("x").alias("text"))
    labels = labels.unionByName(spark.createDataFrame([(9999, 1, "x"), (1, None, "x")], labels.schema))
    extra = spark.createDataFrame([(5000, None, None, None, 0), (5001, "", "en", "src1", 0), rows[1]], d.schema)
    got = quality.classify(d.unionByName(extra), labels).collect()
    assert len(got) == len(rows) + 3
    good = {r[0]: r[4] for r in rows}
    held = [r["kept"] == bool(good[r["doc_id"]]) for r in got if r["doc_id"] in good and r["doc_id"] % 2]
    assert sum(held) / len(held) > 0.97
    assert all(0 < r["host_rate"] < 1 and 0 < r["path_rate"] < 1 for r in got)
    none = quality.classify(d, labels.limit(0)).agg(F.min("p_doc"), F.max("p_doc")).first()
    assert none[0] == none[1] == 0.5
    assert quality.classify(d.limit(0), labels).count() == 0


def test_quality_scores_equal_plain_sums(spark):
    rng = random.Random(13)
    rows = corpus(rng, 300) + [(None, prose(rng, "en", 50), None, None, 1), (900, "x", None, "src1", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, good int").withColumn("hn", F.lit(1)).withColumn("score", F.lit("x"))
    labels = d.filter("doc_id % 2 = 0").select("doc_id", F.col("good").alias("quality"))
    got = quality.classify(d, labels).collect()
    at = {r["doc_id"]: r["p_doc"] for r in got}
    host, path = {}, {}
    for i, _, lang, src, _ in rows:
        host.setdefault(src or "", []).append(at[i])
        path.setdefault((src or "", lang or ""), []).append(at[i])
    every = list(at.values())
    rate = (sum(every) + 1) / (len(every) + 2)

    def strength(groups):
        """Groups (n, sum, target): variance between them over that of single documents."""
        between = sum(n * ((s / n - t) ** 2 - t * (1 - t) / n) for n, s, t in groups)
        return 1 / min(0.5, max(1e-4, between / sum(n * t * (1 - t) for n, _, t in groups))) - 1

    k_host = strength([(len(v), sum(v), rate) for v in host.values()])
    host_rate = {h: (sum(v) + k_host * rate) / (len(v) + k_host) for h, v in host.items()}
    k_path = strength([(len(v), sum(v), host_rate[p[0]]) for p, v in path.items()])
    logit = lambda p: np.log(p / (1 - p))
    where = {i: (src or "", lang or "") for i, _, lang, src, _ in rows}
    for r in got:
        p, v = where[r["doc_id"]], path[where[r["doc_id"]]]
        path_rate = min(1 - 1e-6, max(1e-6, (sum(v) - r["p_doc"] + k_path * host_rate[p[0]]) / (len(v) - 1 + k_path)))
        score = 1 / (1 + np.exp(-(logit(r["p_doc"]) + quality.PATH_WEIGHT * (logit(path_rate) - logit(rate)))))
        assert (r["host_rate"], r["path_rate"]) == pytest.approx((host_rate[p[0]], path_rate), rel=1e-6)
        assert r["score"] == pytest.approx(score, rel=1e-5) and r["kept"] == (r["score"] >= quality.MIN_SCORE)


def test_the_fit_is_at_a_standstill():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 5, 0.1, 2, 1] + 3
    y = (x @ [1, -0.2, 3, 0, 0] + rng.normal(size=400) > 11.4).astype(float)
    b, w = quality.fit_logistic(x, y)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    p = 1 / (1 + np.exp(-(b + x @ w)))
    z = (x - mean) / std
    assert abs((y - p).sum()) < 1e-4 and np.abs(z.T @ (y - p) - w * std).max() < 1e-4  # the ridge's gradient


def test_very_long_texts_have_features(spark):
    d = spark.createDataFrame([(1, "word " * 400_000, "en", "a"), (2, "x" * 2_000_000, "en", "a"), (3, "\n" * 300_000, None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert quality.classify(d, labels).count() == 3
    by = {r["doc_id"]: r for r in divergence.divergence_rules(d).collect()}
    assert by[1]["n_words"] == by[1]["n_repeat_words"] == 400_000 and by[2]["word_chars"] == 2_000_000 and by[3]["n_words"] == 0


def test_sparse_hosts_shrink_toward_the_global_rate(spark):
    groups = spark.createDataFrame([(1000, 900.0), (1000, 500.0), (2, 2.0)], "n long, s double")
    strong = quality.prior_strength(groups, F.lit(0.7))
    same = quality.prior_strength(spark.createDataFrame([(1000, 700.0), (900, 630.0)], "n long, s double"), F.lit(0.7))
    assert strong < 50 < same


ENC = bpe.TreeEncoder(bpe.default_tokenizer(), leaf_chars=8)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "'s", "'re", "'", "!", "é", "日本", "🙂", "the", "ing", "<|endoftext|>", "1", "\t", "aaaa", "́"]), max_size=80), st.integers(1, 30))
def test_tree_equals_direct_encoding(parts, leaf):
    ENC.leaf = leaf
    text = "".join(parts)
    ids = ENC.encode_all([text])[0]
    assert ids == ENC.tok.encode(text, add_special_tokens=False).ids
    assert ENC.decode([ids])[0] == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZé ß'st\n\t\r .,!—“”…09-_~×÷ªº²½\xa0\x1c\x85ſƀ日🙂́|<>endoftext"), max_size=60))
def test_words_one_by_one_equal_the_library(text):
    """Over the characters around the edges of what is split here."""
    ids = ENC.encode([text])[0]
    assert ids == ENC.tok.encode(text, add_special_tokens=False).ids
    assert ENC.decode([ids]) == [ENC.tok.decode(ids, skip_special_tokens=False)]


def test_words_that_are_forgotten_are_learned_again(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 10)
    enc, rng = bpe.TreeEncoder(bpe.default_tokenizer()), random.Random(2)
    for _ in range(20):
        texts = [prose(rng, "de", 30), "日本", ""]
        assert enc.encode(texts) == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.decode([[50256, 220]]) == enc.tok.decode_batch([[50256, 220]], skip_special_tokens=False)
    assert enc.decode([[162]]) == enc.tok.decode_batch([[162]], skip_special_tokens=False)  # part of a character


@pytest.mark.parametrize("fan", [2, 16])
def test_encoding_equals_the_library_row_by_row(spark, fan):
    rng = random.Random(6)
    docs = [(i, prose(rng, "en", rng.randint(0, 400))) for i in range(20)] + [(50, None), (51, ""), (52, "x" * 50_000), (53, "ab " * 30_000), (0, "same id")]
    docs += [(None, "null id"), (None, prose(rng, "de", 900)), (54, "é日" * 9_000 + "<|endoftext|>" * 300)] + [docs[53 - 50 + 20]] * 3
    d = spark.createDataFrame(docs, DOCS).withColumn("ids", F.lit(1)).withColumn("node", F.lit(2)).repartition(3)
    got = bpe.encode_documents(d, bpe.default_tokenizer(), leaf_chars=700, fan=fan, keep_text=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in docs:
        ids = ENC.tok.encode(t or "", add_special_tokens=False).ids
        text = ENC.tok.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, text, sha(",".join(map(str, ids))), sha(text)))
    rows = [(r["doc_id"], r["n_tokens"], r["ids"], r["decoded"], r["ids_sha256"], r["decoded_sha256"]) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert bpe.encode_documents(d.limit(0), bpe.default_tokenizer()).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in nodes}


def test_near_duplicates_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    docs = []
    for g in range(12):
        words = prose(rng, "en", rng.randint(6, 150)).split()
        for _ in range(rng.randint(1, 9)):
            edited = [w if rng.random() > 0.012 else "edit" + str(rng.randint(0, 99)) for w in words]
            docs.append((len(docs), " ".join(edited)))
    docs += [(500, docs[0][1]), (501, docs[0][1].upper()), (502, None), (503, ""), (504, "..."), (505, "two words"), (506, "Two, words!"), (0, docs[0][1])]
    docs += [(600, " ".join(f"t{i}" for i in range(30_000))), (601, " ".join(f"t{i}" for i in range(30_050)))]
    docs += [(700, "snake_case is two words, é-à too"), (701, "SNAKE case, IS two_words; É à TOO"), (None, docs[3][1] + " null")]
    sets = {}
    for i, t in docs:  # shingled here anew
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    links, parent, first = Counter(), {i: i for i in sets}, lambda i: -1 if i is None else i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if first(a) < first(b) and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)), key=first)
                parent[y] = x
    d = spark.createDataFrame(docs, DOCS).withColumn("home", F.lit(1)).withColumn("bands", F.lit(2))
    for blocks in (128, 2):  # blocks of two sets: most pairs meet across blocks
        monkeypatch.setattr(jaccard, "BLOCK_SETS", blocks)
        got = {r["_id"]: r for r in jaccard.near_duplicates(d).collect()}
        assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == {i: (find(i), links[i]) for i in sets}
        assert got[0]["n_rows"] == 2 and all(r["is_first"] == (r["_id"] == r["class_id"]) for r in got.values())
    assert jaccard.near_duplicates(d.limit(0)).count() == 0


def test_bands_reach_the_recall():
    b = jaccard.bands_for(0.8, 0.999, 5)
    assert 1 - (1 - 0.8**5) ** b >= 0.999 > 1 - (1 - 0.8**5) ** (b - 1)


def test_overlaps_at_the_threshold_are_links():
    """Whole numbers decide: 4 of 5 is a link, and one shingle in a million less isn't."""
    def row(sid, ids):
        return {"sid": sid, "weight": 1, "homes": [1], "blk": 0, "sh": np.array(sorted(ids), dtype=np.uint64).tobytes()}

    for size in (5, 1_000_000):
        a, four = range(size), size * 4 // 5
        assert jaccard.linked([row(1, a), row(2, range(four))], 1, 0, 0, 0.8) == [(1, 1, 1), (2, 1, 1)]
        assert jaccard.linked([row(1, a), row(2, range(four - 1))], 1, 0, 0, 0.8) == []


def test_sharding_equals_scores_by_hand(spark):
    import math
    import struct

    import xxhash

    def draw(key, shard):
        seed = 42
        for kind, v in (("<q", key), ("<i", shard)):
            if v is not None:  # Spark's hash passes over nulls
                seed = xxhash.xxh64_intdigest(struct.pack(kind, v), seed)
        return -1 / math.log(((seed >> 11) + 0.5) / 2**53)

    docs = [(i * 7919 - 5000, "x") for i in range(1500)] + [(None, "null id"), (None, None)]
    weights = [1.0, 2.5, 0.5, 1.0, 4.0]
    for r in sharding.shard_rows(spark.createDataFrame(docs, DOCS), weights, grown_weight=3.0).collect():
        scores = [w * draw(r["doc_id"], k) for k, w in enumerate(weights)]
        best = max(range(5), key=lambda k: (scores[k], k))
        assert r["shard"] == best and r["grown_shard"] == (5 if 3.0 * draw(r["doc_id"], 5) > scores[best] else best)


def test_sharding_laws(spark):
    docs = [(i, "é" * (i % 9)) for i in range(4000)] + [(7, "again")] * 500 + [(None, None)] * 300
    d = spark.createDataFrame(docs, DOCS).withColumn("shard", F.lit(1)).withColumn("block", F.lit("x"))
    rows = sharding.shard_rows(d, [1.0] * 9 + [3.0]).collect()
    assert len(rows) == len(docs)
    slots, at = {}, {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert at.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 10)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    alone = Counter(v[0] for v in at.values())
    assert 2.2 < alone[9] / np.mean([alone[i] for i in range(9)]) < 4
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(d, [1.0] * 9 + [3.0, 1.0]).collect()}
    assert grown == {k: v[1] for k, v in at.items()}
    assert sharding.shard_rows(d.limit(0), [1.0] * 3).count() == 0
