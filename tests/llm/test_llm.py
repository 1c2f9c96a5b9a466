"""The ten operators and the pipeline against brute force, round trips and held-out rows."""

import datetime
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import bpe, decontaminate, licenses, near_dedup, pseudonyms, quality, secrets, token_counts, toxicity, warc
from granary.llm.rows import Shingler
from granary.session import table

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "!!! ???", "x", "one two three four five", "one two three four five", "é🙂 ß", "a" * 30_000, "the quick " * 6_000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, and extra columns whose names clash with the operators' own."""
    rows = [(i, t, "node", 1, "edits") for i, t in enumerate(ODD)] + [(3, ODD[3], "node", 1, "edits"), (None, "lost id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, n int, item_id string")


def corpus(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def test_bpe_equals_the_library():
    with open(WORDS, "rb") as f:
        own = bpe.BacktrackingBPE(f.read())
    theirs, rng = Tokenizer.from_file(WORDS), random.Random(1)
    letters = "abcdefghiABCéßΣςİ'’ \t\n\x1c\x85\xa0 ́12½Ⅷ一🙂<|>_-.!"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["<|endoftext|>x<|startoftext|>", "thethethe" * 300]
    texts += ["".join(rng.choice("etaoinshrd") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == struct.pack(f"<{len(ids)}I", *ids)
        assert own.decode(own.encode(t)).decode() == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_works_out_each_word_once():
    """As many different words as a few thousand documents have; what comes again is remembered."""
    with open(WORDS, "rb") as f:
        own = bpe.BacktrackingBPE(f.read())
    made = []
    make = own.cache.make
    own.cache.make = lambda piece: made.append(piece) or make(piece)
    text = "".join(f" {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}" for k in range(120_000))
    assert own.encode(text) == own.encode(text)
    assert len(made) == len(set(made)) == 120_000
    ids = own.encode("tea for two")
    assert own.decode(ids).decode().replace(" ", "").replace("</w>", " ") == "tea for two "


def test_bpe_query_shape(spark, odd):
    got = bpe.encode_documents(odd, WORDS).collect()
    assert len(got) == odd.count() and {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert bpe.encode_documents(odd.limit(0), WORDS).count() == 0


def secret_brute(text):
    fold = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(map(fold, ("password", "passwd", "secret", "token", "api_?key")))
    base = [re.compile(f"({words})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    out = []
    for k, p in enumerate(base):
        out += [(k, m.start(), m.end()) for m in p.finditer(text) if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]]
    for k, r in enumerate(secrets.EXTRA, 3):
        out += [(k, m.start(), m.end()) for m in re.finditer(r.pattern, text) if m.end() - m.start() >= r.size]
    return [(secrets.RULES[k].kind, s, e) for k, s, e in sorted(out, key=lambda x: (x[1], x[0]))]


def test_secrets_equal_backtracking(spark, odd):
    scan, rng = secrets.Scanner(), random.Random(3)
    parts = ["password", "passwd", "Secret", "token", "API_KEY", "apikey", '"', "'", " ", ":", "=", "abc", "def0123", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "🙂", "ghp_", "A1b2" * 8, "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "_", "\n", "0a" * 20]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert scan.spans(t) == secret_brute(t)
    got = {r["doc_id"]: r for r in secrets.secret_report(table(spark, SF, "documents")).collect()}
    for i, t in corpus(spark):
        show = [f"{k}:{s}:{e}" for k, s, e in secret_brute(t)]
        assert got[i]["spans"] == ",".join(show)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(x for x in show if x.split(":")[0] in ("assign", "access", "hex")).encode()).hexdigest()
    assert secrets.secret_report(odd).count() == odd.count()
    df = spark.createDataFrame([(1, 'a token = "abcdef123" b', 7), (2, None, 8)], "doc_id long, text string, spans int")
    assert [tuple(r) for r in secrets.redact(df).collect()] == [(1, 'a [SECRET]" b', 7), (2, None, 8)]


def test_toxicity_held_out(spark, odd):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert held[held.toxic == 0].score.lt(0.5).mean() > 0.95
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.2
    # rows of fold 0 have no influence
    held_ids = toxicity.fold("doc_id", 5) == 0
    other = toxicity.train(docs, labels.withColumn("toxic", F.when(held_ids, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(model.weights, other.weights)
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    none = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd, none).collect()} == {0}


def test_quality_base_figures_and_ratio(spark, odd):
    trusted = table(spark, SF, "labels").where("quality = 1").select("doc_id")
    got = {r["doc_id"]: r for r in quality.quality(table(spark, SF, "documents"), trusted).collect()}
    import xxhash

    signed = lambda h: h - 2**64 if h >= 2**63 else h
    h = lambda *t: signed(__import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x.encode(), seed % 2**64), t, 42)) % 10_000
    tokens = {i: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", t.lower()) for i, t in corpus(spark)}
    grams = {i: [h(a) for a in t] + [h(a, b) for a, b in zip(t, t[1:])] for i, t in tokens.items()}
    good = {r["doc_id"] for r in trusted.collect()}
    raw, target = Counter(x for g in grams.values() for x in g), Counter(x for i, g in grams.items() if i in good for x in g)
    ratio = [np.log((target[b] + 1) / (target.total() + 10_000)) - np.log((raw[b] + 1) / (raw.total() + 10_000)) for b in range(10_000)]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for i, t in corpus(spark):
        w, r = word.findall(t), got[i]
        lines = [x for x in t.split("\n") if word.search(x)]
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        covered = {j for v in at.values() if len(v) > 1 for k in v for j in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        mean = sum(ratio[b] for b in grams[i]) / max(1, len(grams[i]))
        assert r["score"] == pytest.approx(mean, abs=2e-6) and r["kept"] == (not failed and r["score"] >= -0.2)
    edge = quality.quality(odd, trusted.limit(0)).collect()
    assert len(edge) == odd.count() and {r["n_words"] for r in edge if r["doc_id"] in (0, 1, 2)} == {0}


def test_pseudonyms(spark, odd):
    f = pseudonyms.Feistel(b"k")
    for domain in (1, 2, 7, 100, 997):
        out = [f.permute(x, domain, "t") for x in range(domain)]
        assert sorted(out) == list(range(domain)) and [f.permute(x, domain, "t", True) for x in out] == list(range(domain))
    names, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", inverse=True)
    text = "call +1 (017) 555-7713, pay 4417744280351547 or 4417 7442 8035 1547! from 97.51.17.173, on 2024-02-29 / 30.01.1999; a.b7@x.example.com 2023-02-30 999.1.1.1 1234567890123456"
    card = "441774428035154"
    text = text.replace("4417744280351547", card + str(pseudonyms.check_digit(card))).replace("8035 1547", "8035 154" + str(pseudonyms.check_digit(card)))
    new, n = names.replace(text)
    assert n == {"card": 2, "phone": 1, "ip": 1, "date": 2, "email": 1} and back.replace(new)[0] == text
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", new)
    assert cards[0] == cards[1].replace(" ", "") != card and pseudonyms.check_digit(cards[0][:-1]) == int(cards[0][-1])
    assert "2023-02-30" in new and "999.1.1.1" in new and len(new) - len(text) < 8
    assert datetime.date.fromisoformat(re.search(r"on (\S+)", new)[1])
    got = pseudonyms.pseudonymise(odd, b"k").collect()
    assert len(got) == odd.count() and next(r for r in got if r["doc_id"] == 0)["text"] is None


def test_pseudonyms_beside_other_numbers():
    names, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", inverse=True)
    card, phone = "4111 1111 1111 1111", "+1 (017) 555-7713"
    other, own = names.card(card), names.phone(phone)
    assert names.card(card.replace(" ", "")) == other.replace(" ", "") and names.phone("+44 20 7946 0958")
    for form in ("card {} 12/26", "{} 123", "2 {}", "{} 2024", "2 {} 7", "{} {}", "{} x", "12 34 {}", "{}, {} 9", "+1 {}", "{} 12x"):
        for layout in (lambda x: x, lambda x: x.replace(" ", ""), lambda x: x.replace(" ", "-")):
            text = form.replace("{}", layout(card))
            new, n = names.replace(text)
            assert new == form.replace("{}", layout(other)) and n["card"] == form.count("{}"), (text, new)
            assert back.replace(new)[0] == text
    for form in ("{} 42 times", "{} 4417", "{}", "call {}.", "{} 12 34", "{} {}"):
        new, n = names.replace(form.replace("{}", phone))
        assert new == form.replace("{}", own) and n["phone"] == form.count("{}")
    for number in ("+44 20 7946 0958", "+49 89 1234-567", "+49-30-123 4567 89", "+7 (495) 123-45-67"):
        assert names.replace(number)[0] == names.phone(number) != number
    assert names.replace("+44 20 7946 0958 42")[0] == names.phone("+44 20 7946 0958") + " 42"
    assert names.replace(f"{phone} {card}")[0] == f"{own} {other}"
    new, n = names.replace(f"5 2024-01-02 {card} 2023-03-04")
    assert new == f"5 {names.date('2024-01-02')} {other} {names.date('2023-03-04')}" and n["date"] == 2


def test_decontaminate_equals_brute_force(spark, odd):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 40)))) for i in range(25)] + [(90, ""), (91, None)]
    docs = []
    for i in range(120):
        w = rng.choices(vocab, k=rng.randint(0, 200))
        if i % 2:
            own = items[rng.randrange(25)][1].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "changed"
            w[len(w) // 2 : len(w) // 2] = own
        docs.append((i, " ".join(w)))
    s, want = Shingler(), {}
    for i, t in docs:
        for j, item in items[:25]:
            a, b = s.words(item), s.words(t)
            k = min(5, len(a))
            if len(b) < k:
                continue
            x, y = Counter(s.shingles(a, k).tolist()), s.shingles(b, k).tolist()
            width = min(len(a) - k + 1, len(y))
            best = max(decontaminate.weighted_similarity(Counter(y[p : p + width]), x) for p in range(len(y) - width + 1))
            if best >= 0.8:
                want[i, j] = best
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for settings in (decontaminate.Settings(), decontaminate.Settings(block_bytes=1000)):
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(df, bench, settings).collect()}
        assert got == pytest.approx(want) and len(want) > 20
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_simhash_blocks_lose_nothing():
    """Every fingerprint within the radius shares a near block (pigeonhole); of random ones under 1 % do."""
    s, rng = decontaminate.Settings(), np.random.default_rng(4)
    prints = rng.integers(0, 256, (300, s.bits // 8), dtype=np.uint8)
    index = decontaminate.Blocks(prints, s)
    assert index.candidates(rng.integers(0, 256, (300, s.bits // 8), dtype=np.uint8)).mean() < 0.01
    for k in range(300):
        bits = np.unpackbits(prints[k])
        bits[rng.choice(s.bits, rng.integers(0, s.radius + 1), replace=False)] ^= 1
        assert index.candidates(np.packbits(bits)[None])[0, k]


def test_decontaminate_ids_and_ties(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(None, item), ("b", item), ("c", None)], "item_id string, text string")
    docs = spark.createDataFrame([("x", f"{item} and {item}"), ("x", "no " + item), (None, "so " + item), ("y", "none"), ("z", None)], "doc_id string, text string")
    got = sorted((tuple(r) for r in decontaminate.contaminated(docs, bench).collect()), key=str)
    assert got == sorted([("x", None, 1.0, 0), ("x", "b", 1.0, 0), (None, None, 1.0, 1), (None, "b", 1.0, 1)], key=str)
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {"y", "z"}


def test_licenses(spark, odd):
    text = 'Words.\nReleased under the MIT License.\nLICENSED** UNDER## CC%% BY-NC 4.0.**\nLicensed under the Apache\nLicense, Version 2.0 (the "License"); you may not use this file except in\ncompliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nThe MIT License is short.'
    df = spark.createDataFrame([(1, text), (2, "no notice"), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["license"], r["rule"], text[r["start"] : r["end"]][:20]) for r in licenses.find_licenses(df).collect()]
    assert got == [(1, "MIT", "mit-line", "Released under the M"), (1, "CC-BY-NC-4.0", "cc-by-nc-line", "LICENSED** UNDER## C"), (1, "Apache-2.0", "apache-header", "Licensed under the A")]
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    found = Counter((r["doc_id"], r["license"]) for r in licenses.find_licenses(table(spark, SF, "documents")).collect())
    assert all(found[i, k] >= (line in t) for i, t in corpus(spark) for k, line in lines.items())
    assert licenses.find_licenses(odd).count() == 0


def test_every_license_rule_matches_its_text():
    gpl = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
    s = licenses.SENTENCES
    texts = {rule: "\n".join(s[w] for w in wanted) for _, rule, wanted in licenses.RULES}
    wrapped = {**{r: t.replace(" the ", "\nthe ") for r, t in texts.items()}, "gpl-header": gpl, "gpl-free": gpl.partition("\n\n")[0], "apache-header": apache}
    one = licenses.Recogniser(s, licenses.RULES)
    for licence, rule, _ in licenses.RULES:
        for t in (texts[rule], wrapped[rule], wrapped[rule].strip().replace("\n", "\n# ")):
            for before, after in (("", ""), ("Some words.\n\n", "\n\nOther words follow here.\n"), ("Copyright 2020 N. N.\n", "\n\nUnless required")):
                text = before + t + after
                got = one.matches(text)
                assert [m[:2] for m in got] == [(licence, rule)], (rule, text)
                assert text[got[0][2] : got[0][3]].strip() == t.strip()
    assert not one.matches("This program is free software: you can redistribute it.\n\nUnder the MIT License")


def near_brute(texts):
    s = Shingler()
    k = [near_dedup.labelled(s.shingles(s.words(t))) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (texts[a] or "") == (texts[b] or "") or near_dedup.aligned_similarity(k[a], k[b], 0.8) >= 0.8 - 1e-12:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(len(texts))]


def test_alignment_is_the_longest_chain():
    rng = random.Random(7)
    for _ in range(300):
        a = rng.sample(range(60), rng.randint(1, 40))
        b = list(a)
        for _ in range(rng.randrange(6)):
            b[rng.randrange(len(b))] = rng.randrange(100, 200)
            x, y = sorted(rng.choices(range(len(b) + 1), k=2))
            b = b[:x] + b[y:] + b[x:y] if rng.random() < 0.3 else b
        b = list(dict.fromkeys(b))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if p == q else max(d[i, j + 1], d[i + 1, j])
        exact = d[-1, -1] / (len(a) + len(b) - d[-1, -1])
        got = near_dedup.aligned_similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert (got >= 0.8) == (exact >= 0.8) and (got < 0.8 or got == pytest.approx(exact))


def test_alignment_matches_any_occurrence():
    def lcs(a, b):
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if p == q else max(d[i, j + 1], d[i + 1, j])
        return int(d[-1, -1])

    rng = random.Random(8)
    for _ in range(300):
        a = [rng.randrange(rng.choice((3, 12, 60))) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            x = rng.randrange(len(b) + 1)
            b[x : x + rng.randrange(3)] = rng.choices(range(12), k=rng.randrange(3))
        exact = lcs(a, b) / (len(a) + len(b) - lcs(a, b))
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert near_dedup.longest_common(x, y) == lcs(a, b)
        got = near_dedup.aligned_similarity(x, y, 0.8)
        assert (got >= 0.8) == (exact >= 0.8) and (got < 0.8 or got == pytest.approx(exact))


def test_near_duplicates_with_repeated_lines(spark):
    """A copy that lacks the first of ten equal headings."""
    head = " ".join(f"h{i}" for i in range(15))
    parts = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(10)]
    texts = ["\n".join(f"{head}\n{p}" for p in parts), "\n".join([parts[0], *(f"{head}\n{p}" for p in parts[1:])])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(df).collect()} == {(0, 2)}
    assert [r["doc_id"] for r in near_dedup.keep_one(df).collect()] == [0]


def test_near_duplicates_equal_brute_force(spark, odd):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(900)]
    texts = list(ODD[:8])
    for _ in range(12):
        base = rng.choices(vocab, k=rng.randint(20, 150))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_brute(texts)
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: (c, want.count(c)) for i, c in enumerate(want)}
    kept = near_dedup.keep_one(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want))
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    own = near_dedup.near_duplicates(odd)
    assert own.count() == odd.count()
    once = near_dedup.keep_one(odd)
    assert once.columns == odd.columns and once.count() == own.select("class_id", "class_size").distinct().count()


def test_classes_with_null_and_repeated_ids(spark):
    words = lambda k: " ".join(f"{k}x{i}" for i in range(30))
    rows = [(None, words("a")), (None, words("b")), (None, words("b") + " more"), (5, words("c")), (5, words("d")), (5, words("d")), (None, words("e")), (7, words("e") + " more"), (None, None), (-(1 << 63), words("f"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.keep_one(df).collect()
    b = [r["text"] for r in kept if (r["text"] or "").startswith("b")]
    assert len(b) == 1 and b[0] in (words("b"), words("b") + " more")
    assert Counter((r["doc_id"], r["text"]) for r in kept if r["text"] not in b) == Counter([(None, words("a")), (5, words("c")), (5, words("d")), (7, words("e") + " more"), (None, None), (-(1 << 63), words("f"))])
    own = near_dedup.near_duplicates(df).collect()
    assert len(own) == len(rows) and len({bytes(r["label"]) for r in own}) == 7
    text_ids = spark.createDataFrame([(None, "x"), ("i", "y"), (None, "z")], "doc_id string, text string")
    assert near_dedup.keep_one(text_ids).count() == 3


def test_token_counts_follow_edits(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        counter = token_counts.Counter(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(9)
    letters = ["ab ", " ", "   ", "\n", "\n \n", "it's", "12", "é", "🙂", "!!", "word ", "x" * 50]
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 900)))
        tree = token_counts.Tree(text, counter)
        for _ in range(6):
            a, b = sorted(rng.randint(0, len(text) + 2) for _ in range(2))
            b = min(b, a + rng.choice((0, 3, 400)))
            new = "".join(rng.choice(letters) for _ in range(rng.randint(0, 5)))
            tree.edit(a, b, new)
            text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
            assert tree.text() == text and tree.tokens == len(counter.whole(text))
    edited = odd.withColumn("edits", F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit("zz").alias("text")), F.lit(None)))
    got = {r["doc_id"]: r for r in token_counts.count_with_edits(edited, path, public_tokenizers.PATTERN).collect()}
    assert got[0]["n_tokens"] == 0 and got[0]["n_tokens_after"] > 0 and got[9]["chars_encoded"] < 2000


def test_warc_derivatives(spark):
    page = '<html lang="de"><head><title>A &amp; B</title><script>x<p></script></head><body><p>One<br>two &lt; 3</p><a href="/q?a=1&amp;b=2">l</a><!-- no --></body></html>'
    df = spark.createDataFrame([(1, "<urn:r:1>", "http://x/", "2024-01-01T00:00:00Z", "X-A: b\r\nbad", page), (2, None, None, None, None, None)], "key long, id string, target_uri string, date string, http_headers string, payload string")
    got = [r.asDict() for r in warc.derivatives(df).collect()]
    meta, text = got[0], got[1]
    assert meta["block"].split("\r\n")[:-1] == ["title: A & B", "languageOfPage: de", "outlink: /q?a=1&b=2", "source-x-a: b"]
    assert text["block"] == "A & B\nOne\ntwo < 3\nl" and text["refers_to"] == meta["refers_to"] == "<urn:r:1>" and text["refers_to_date"] == "2024-01-01T00:00:00Z"
    assert text["source_payload_digest"] == warc.digest(page.encode()) and text["block_digest"] == warc.digest(text["block"].encode()) and text["record_id"] != meta["record_id"]
    raw = warc.serialise(text)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1") and block[: int(fields["Content-Length"])].decode() == text["block"] and fields["WARC-Refers-To"] == "<urn:r:1>"
    assert [(r["record_type"], r["content_length"], r["refers_to"]) for r in got[2:]] == [("metadata", 0, None), ("conversion", 0, None)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    got = corpus_pipeline.run(spark, SF).toPandas()
    model = toxicity.train(docs, table(spark, SF, "labels"))
    rows = [(i, t) for i, t in corpus(spark) if model.margin(t) < 0]
    classes = near_brute([t for _, t in rows])
    rows = [rows[k] for k in sorted(set(classes))]
    index = decontaminate.Index([(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()], decontaminate.Settings())
    rows = [(i, t) for i, t in rows if not index.matches(t)]
    assert sorted(got.doc_id) == sorted(i for i, _ in rows)
    theirs = Tokenizer.from_file(WORDS)
    n = dict(zip(got.doc_id, got.n_tokens, strict=True))
    assert all(n[i] == len(theirs.encode(t, add_special_tokens=False).ids) for i, t in rows if not secret_brute(t))
