"""Text operators against plain versions: whole test tables, planted fixtures and odd rows."""

import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from vicinal.llm import language, licenses, ordinal, queries, rules, secrets

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
ODD = [None, "", " \t\n", "a", "İstanbul ſ K", "#*$%&|<> " * 30, "line\nline\n\nline \nother\nline", "x y z " * 40, "\x0b\x0c\x1c a b", "é́" * 60, "Token: 'abcdefgh' 😀 password=😀 secret=abcdefg1", "a" * 100_000]


def base_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    count = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows(spark):
    return spark.createDataFrame([(k, t, 7, "c") for k, t in enumerate(ODD)] + [(1, "", 7, "c")], "doc_id long, text string, n_words int, rule string")


@needs_tables
@pytest.mark.parametrize("packed", [1 << 16, 0])
def test_rule_statistics_of_all_documents(spark, documents, packed):
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    stats = rules.text_statistics(documents, packed_words=packed)
    got = {r["doc_id"]: tuple(r[c] for c in rules.BASE) for r in stats.select("doc_id", *rules.BASE).collect()}
    assert got == {k: base_of(t) for k, t in texts.items()}


def test_rule_statistics_of_odd_texts(spark):
    for packed in (1 << 16, 0):
        rows = rules.text_statistics(odd_rows(spark), packed_words=packed).select("doc_id", *rules.BASE).collect()
        assert Counter(map(tuple, rows)) == Counter([*((k, *base_of(t)) for k, t in enumerate(ODD)), (1, *base_of(""))])


def test_rule_statistics_of_a_very_long_text(spark):
    words = [str(n) for n in range(400_000)]
    words[300_000:300_003] = words[5:8]
    frame = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    assert rules.text_statistics(frame).first()["n_repeat_words"] == 6


def test_verdicts_follow_the_list(spark):
    learned = rules.DecisionList([rules.Rule((("symbol_share", ">", 0.2), ("n_words", "<=", 100.0))), rules.Rule((("digit_share", ">", 0.5),))])
    texts = ["# word " * 3 + " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70)), " ".join(f"#{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)), " ".join(str(k * 7919) for k in range(60)), "few words", "a b c " * 50, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["base_failed"], r["kept"], r["rule"]) for r in rules.apply_rules(frame, learned).orderBy("doc_id").collect()]
    assert got == [(False, True, -1), (False, False, 0), (False, False, 1), (True, False, -1), (True, False, -1), (True, False, -1)]
    empty = rules.apply_rules(frame.where("false"), rules.train_rules(frame.where("false"), spark.createDataFrame([], "doc_id long, quality int")))
    assert empty.count() == 0


def test_conjunctions_are_learned():
    draw = np.random.default_rng(3)
    x = draw.random((3000, len(rules.FEATURES)))
    bad = (x[:, 1] > 0.7) & (x[:, 6] <= 0.4)
    learned = rules.learn_list(x, bad)
    assert any(len(r.tests) > 1 for r in learned.rules)
    hit = np.any([r.covers(x, rules.FEATURES) for r in learned.rules], axis=0)
    assert (hit & bad).sum() / hit.sum() > 0.97 and (hit & bad).sum() / bad.sum() > 0.95


def plain_base(text):
    text, out = text or "", []
    for kind, pattern, least, group in (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
        ("access", r"AKIA[A-Z0-9]+", 16, 0),
        ("hex", r"[0-9a-f]+", 32, 0),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return sorted(out)


@needs_tables
def test_base_secrets_of_all_documents(spark, documents):
    frame = documents.select("doc_id", "text").unionByName(odd_rows(spark).selectExpr("doc_id - 1000 AS doc_id", "text"))
    texts = Counter((r["doc_id"], r["text"]) for r in frame.collect())
    want = Counter()
    for (doc, text), n in texts.items():
        spans = plain_base(text)
        named = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want[(doc, *(sum(k == kind for _, k, _ in spans) for kind in range(3)), hashlib.sha256(named.encode()).hexdigest())] += n
    rows = secrets.scan_secrets(frame).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    for r in rows:
        spans = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in r["spans"].split(",") if s))
        novel = sorted((int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s) if k == "novel")
        assert len(spans) == sum(r[1:4]) + len(novel) and all(x[1] <= y[0] for x, y in zip(novel, novel[1:], strict=False))


def planted(n, seed):
    """(text, secret or None): keys without an assignment, and identifiers, paths and prose as decoys."""
    draw = np.random.default_rng(seed)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    names = secrets.DICTIONARY_WORDS
    out = []
    for k in range(n):
        before = ["Authorization: Bearer ", "the session cookie is ", "my private signature\n", "auth header x-auth "][k % 4]
        after = " and then the client reads the response body"
        key = "".join(draw.choice(letters, 5000 if k == 7 else int(draw.integers(24, 90))))
        out.append((before + key + after, key))
        word = ["_".join(draw.choice(names, 4)) + "_2", "/".join(draw.choice(names, 5)) + "1", "-".join(draw.choice(names, 4)) + "-v2", "".join(w.capitalize() for w in draw.choice(names, 4)) + "3"][k % 4]
        out.append((before + word + after, None))
    return out


def test_novelty_finds_planted_keys():
    novelty, hits, found, n = secrets.Novelty(), 0, 0, 0
    for text, key in planted(200, 11):
        base, more = secrets.scan(text, novelty)
        clean = secrets.redact(text, base + more)
        n += key is not None
        found += bool(more)
        hits += key is not None and bool(more) and clean.count("[NOVEL]") == 1 and key[-8:] not in clean and key[:8] not in clean
    assert hits / n >= 0.95, (hits, n)
    assert hits / found >= 0.9, (hits, found)


def spoiled(text, seed):
    """The same licence, with other owner lines, case, breaks, marks and spellings."""
    draw = np.random.default_rng(seed)
    words = [re.sub(r"\b([Ll])icense\b", r"\1icence", w) for w in text.split()]
    words = [w.upper() if draw.random() < 0.2 else w for w in words]
    body = "".join(w + draw.choice([" ", "  ", "\n", "\n * ", " -- "]) for w in words)
    return f"Copyright (c) {1990 + seed} Owner {seed}\nAll rights reserved.\n{body}"


def test_license_files_meet_their_digests(spark):
    whole = [(n, t) for n, t in licenses.KNOWN_LICENSES if len(t) > 200]
    data, want = [], {}
    for k, (name, text) in enumerate(whole * 4):
        data += [(3 * k, spoiled(text, k)), (3 * k + 1, text.replace("software", "hardware").replace("SOFTWARE", "HARDWARE")), (3 * k + 2, text + "\nand one clause more")]
        want |= {3 * k: name, 3 * k + 1: None, 3 * k + 2: None}
    data += [(-1, None), (-2, ""), (-3, "licence licence"), (-4, "license license")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {k: got[k]["license"] for k in want} == want
    assert got[-1]["digest"] is None and got[-2]["digest"] is None and got[-3]["digest"] == got[-4]["digest"]


@needs_tables
def test_license_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(f"SELECT doc_id, digest, license, notices FROM ({queries.oracle_sql()['op9_license_scan']})").fetchall()
    assert Counter(want) == Counter(map(tuple, queries.op9_license_scan(spark, SF).select("doc_id", "digest", "license", "notices").collect()))


@needs_tables
def test_languages_of_held_out_documents(spark, documents):
    rows = queries.op1_language_id(spark, SF).join(documents.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.97


def test_word_shapes_see_whole_words():
    assert ordinal.word_shape("Ab9!") == "Xx9!"
    assert ordinal.word_shape("a" * 100 + "9") == "x9" != ordinal.word_shape("a" * 100)
    assert ordinal.word_shape("a-" * 20) != ordinal.word_shape("a-" * 21)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert licenses.scan_licenses(spark, none).count() == 0 == secrets.scan_secrets(none).count()
    assert ordinal.rate_documents(spark, none, ordinal.train_quality(none, labels)).count() == 0
    assert language.identify_languages(spark, none, language.train_language_model(none)).count() == 0
