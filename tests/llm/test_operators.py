"""The ten operators against brute force on small fixtures, with the odd rows that tables hold."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillrank.llm import fingerprints, frequency, jaccard, language, licenses, mixing, pieces, quality, recompression, repeats, suffix_levels, warc
from quillrank.llm.arrays import Spans, mix, text_chunks, word_tokens
from quillrank.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = r"[^\x20\x09-\x0D]+"
D = "/root/testdata/sf0.001"


def words(text):
    return re.findall(WS, text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    base = [f"w{rng.randint(0, 400)}" for _ in range(70)]
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
        if i % 4 == 0:
            w = [rng.choice("a b c".split()) for _ in range(rng.randint(0, 60))]
        if i % 9 == 0:
            w = ["x"] * rng.randint(15, 60)
        out.append((i * 2, "  ".join(w), "en", f"s{i % 3}", 0))
    out += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, " \n", "en", None, 0), (103, "É ünï 中\n中", "de", "s2", 0)]
    out += [(104, " ".join(base * 3), "en", "s0", 0), (106, " ".join(base), "en", "s0", 0), (108, " ".join(base), "en", "s0", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, rows):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, text, *_ in rows:
        w, n = words(text), len(words(text))
        count = Counter(tuple(w[a : a + 8]) for a in range(n - 7))
        inside = {b for a in range(n - 7) if count[tuple(w[a : a + 8])] > 1 for b in range(a, a + 8)}
        longest = max((k for k in range(1, n) if max(Counter(tuple(w[a : a + k]) for a in range(n - k + 1)).values()) > 1), default=0)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["longest_repeat"]) == (n, sum(map(len, w)), len(inside), longest)
        short = Counter(tuple(w[a : a + 3]) for a in range(n - 2))
        union = {b for a in range(n - 2) if short[tuple(w[a : a + 3])] > 1 for b in range(a, a + 3)}
        assert r["n_covered_words"] == len(union)
        assert r["base_failed"] == (n < 20 or 100 * len(inside) > 30 * n)
        assert r["kept"] == (not r["base_failed"] and 100 * len(union) <= 50 * n and not (longest >= 50 and 100 * longest > 5 * n))


def test_quality_limits_of_the_method(spark, empty):
    own = [f"w{i}" for i in range(800)]
    texts = {
        "clean": own,
        "phrase": [x for i in range(60) for x in (*"buy this now please".split(), f"n{i}")],
        "pasted": own[:500] + own[:60],
        "long and pasted": own + [f"v{i}" for i in range(800)] + own[:60],
        "very long": [f"u{i}" for i in range(60_000)],
        "short": own[:19],
    }
    docs = spark.createDataFrame([(k, " ".join(w), True, 1) for k, w in texts.items()], "doc_id string, text string, kept boolean, n_words int")
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert {k for k, r in got.items() if r["base_failed"]} == {"short"}
    assert {k for k, r in got.items() if r["kept"]} == {"clean", "long and pasted", "very long"}
    passed = quality.passing(docs)
    assert passed.schema == docs.schema and {(r["doc_id"], r["kept"], r["n_words"]) for r in passed.collect()} == {(k, True, 1) for k in ("clean", "long and pasted", "very long")}
    assert quality.quality(empty).count() == quality.passing(empty).count() == 0


def test_quality_lines_and_symbols():
    batch = pa.RecordBatch.from_arrays([pa.array(["a\nb\na\n\n\n", None, "#x *\n#x *"])], names=["text"])
    (_, offsets, data), *_ = text_chunks(batch)
    m = quality.measure(data, offsets)
    assert m["n_dup_lines"].tolist() == [1, 0, 1] and m["n_symbols"].tolist() == [0, 0, 4]


def java_xxhash(spark, rows):
    """Spark's xxhash64 of tuples of strings (words first, then the longs)."""
    df = spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "i long, w array<string>").select("i", F.transform("w", lambda x: F.when(x.isNotNull(), F.xxhash64(x))).alias("h"))
    five = F.xxhash64(*(F.get("h", F.lit(k)) for k in range(fingerprints.SHINGLE)))
    return [r[0] for r in df.select("i", F.shiftrightunsigned(five, 64 - fingerprints.HASH_BITS).alias("x")).orderBy("i").select("x").collect()]


@pytest.mark.parametrize("buckets", [1, 5, 300])
def test_fingerprints(spark, rows, buckets, monkeypatch):
    given = [*rows, (None, "lone words of no id at all", "en", "s", 0), (None, None, "en", "s", 0), (106, rows[3][1], "x", "s", 1), (7, " ".join(map(str, range(900))), "", "", 0)]
    docs = spark.createDataFrame(given, SCHEMA).withColumn("sketch", F.lit("clash")).repartition(3)
    real = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda d, made: real(d, made, buckets))
    got = fingerprints.fingerprints(docs).collect()
    hashes = spark.createDataFrame([(r[1] or "",) for r in given], "text string").select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).distinct()
    at = {r["text"]: r["h"] for r in hashes.collect()}
    order = sorted(((r[0], r[1] or "") for r in given), key=lambda r: (r[0] is None, -(r[0] or 0), at[r[1]], r[1]))
    follows = [(i, text, after[1]) for (i, text), after in zip(order, order[1:] + order[:1], strict=True)]
    edits = [text[: len(text) - len(text) // 3] + after[: len(text) // 3] for _, text, after in follows]
    texts = {t for _, text, after in follows for t in (text, after)} | set(edits)
    grams = {t: [tuple((w[a : a + 5] + [None] * 5)[:5]) for a in range(max(1, len(w) - 4))] if (w := words(t)) else [] for t in texts}
    flat = sorted({g for found in grams.values() for g in found}, key=str)
    number = dict(zip(flat, java_xxhash(spark, flat), strict=True))

    def sketch(t):
        all_of = sorted({number[g] for g in grams[t]})
        return [x for x in all_of if x < 2**fingerprints.HASH_BITS // fingerprints.FRACTION] or all_of[:1]

    def like(a, b):
        small = min(len(a), len(b))
        return len(set(a) & set(b)) / small if small else float(not a and not b)

    shown = lambda s: ",".join(f"{x:x}" for x in s)
    want = [
        (str(i), len(text), sha256(e.encode()).hexdigest(), shown(sketch(text)), shown(sketch(e)), like(sketch(text), sketch(e)), like(sketch(text), sketch(after)))
        for (i, text, after), e in zip(follows, edits, strict=True)
    ]
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_fingerprint_fraction_and_merging(spark):
    a, b = " ".join(map(str, range(5000))), " ".join(map(str, range(4000, 9000)))
    df = spark.createDataFrame([(a, b)], "a string, b string").select("a", "b", *(fingerprints.sketch(F.col(c)).alias(f"s{c}") for c in "ab"))
    r = df.select("sa", "sb", fingerprints.merged(F.col("sa"), F.col("sb")).alias("m"), fingerprints.containment(F.col("sa"), fingerprints.sketch(F.substring("a", 1, 5000))).alias("c")).first()
    assert 1050 < len(r["sa"]) < 1450 and r["sa"] == sorted(set(r["sa"])) and r["c"] == 1 and r["m"] == sorted({*r["sa"], *r["sb"]})
    high = spark.createDataFrame([([2**47 + 5], [2**47 + 2], [3])], "a array<long>, b array<long>, c array<long>")
    merged = high.select(fingerprints.merged(F.col("a"), F.col("b")).alias("ab"), fingerprints.merged(F.col("a"), F.col("c")).alias("ac")).first()
    assert merged["ab"] == [2**47 + 2] and merged["ac"] == [3]


def test_next_of_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    assert fingerprints.with_next(one, {}, 4).first()["next_text"] == "abcdef"
    assert fingerprints.with_next(empty.select("doc_id", "text"), {}, 4).count() == 0 and fingerprints.fingerprints(empty).count() == 0
    cuts = sorted(random.Random(1).sample(range(-1000, 1000), 500))
    df = spark.range(-1010, 1010).select("id", fingerprints._range_of(F.col("id"), cuts).alias("k"))
    assert all(r["k"] == sum(c <= r["id"] for c in cuts) for r in df.collect())


def test_suffix_automaton_matches_every_substring():
    rng = np.random.default_rng(0)
    text = rng.integers(2, 6, 200)
    table = language.suffix_automaton(text)
    has = {tuple(text[a:b]) for a in range(200) for b in range(a + 1, min(200, a + 7) + 1)}
    for _ in range(400):
        probe = rng.integers(2, 6, rng.integers(1, 7))
        state = 0
        for c in probe:
            state = table[state, c]
            if not state:
                break
        assert bool(state) == (tuple(probe) in has)


def test_phrases_match_a_plain_parse():
    rng = random.Random(1)
    sample = "".join(rng.choice("abcd ") for _ in range(500))
    model = language.Model({"x": sample.encode(), "y": b"zzzz yyyy"})
    texts = ["".join(rng.choice("abcdz ") for _ in range(n)) for n in (0, 3, 80, 700)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    text, first = language.gaps_closed(data, np.cumsum([0, *map(len, texts)]))
    got = model.phrases(text, first)[:, 0]
    closed = re.sub(" +", " ", sample)
    for k in range(len(texts)):
        own = "".join(chr(c + 95) if c > 1 else " " for c in text[first[k] : first[k + 1]])
        n = 0
        for a in range(0, len(own), language.SEGMENT):
            run = ""
            n += 1
            for c in own[a : a + language.SEGMENT]:
                run += c
                if run not in closed:
                    n, run = n + 1, ""
        assert got[k] == n


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.op3_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_language_odd_rows(docs, empty):
    model = language.Model(language.sample(docs))
    got = {r["doc_id"]: r for r in language.identify(docs.withColumn("score", F.lit(1)), model).collect()}
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == got[102]["lang_pred"] == "und" and got[100]["score"] == 0
    assert language.sample(empty) == {} and language.identify(docs, language.Model({})).where("lang_pred <> 'und'").count() == 0


def test_licenses(spark):
    texts = {
        1: "Licensed under the Apache License, Version 2.0; see CC-BY-SA 4.0, GNU General Public License version 3 or later. All rights reserved. (c) 2019 X",
        2: None,
        3: "CC BY cc by CC-BY",
        4: "MIT License\nmit licenses and general  public\tlicense",
        5: "allrights reserved, all rights reservedly",
    }
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("score", F.lit("x"))).collect()}
    for i, text in texts.items():
        w = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        hits = [(a, label) for phrase, label in licenses.BASE for a in range(len(w)) if w[a : a + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert r["base_labels"] == ",".join(sorted({h[1] for h in hits})) and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}
    assert {"apache-2.0", "cc-by-sa-4.0", "gpl-3+"} <= set(got[1]["labels"].split(",")) and "mit" in got[4]["labels"] and len(licenses.build_rules()) > 300


@pytest.mark.parametrize("pattern, n", [("a", 1), (r"a \S+", 2), (r"a(?: \S+){1,4} b", 6), ("(?:a|b c d) e ?f", 5), ("a (?:b (?:c )?)?d", 4)])
def test_longest_match_in_words(pattern, n):
    assert licenses.most_words(pattern) == n


@pytest.mark.parametrize("pattern", ["a(?: b)*", "a [b ]c", "a(?: b){2,}", r"a\sb"])
def test_patterns_of_any_length_are_refused(pattern):
    with pytest.raises(ValueError):
        licenses.most_words(pattern)


def test_license_notices(spark):
    published = "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    notices = {
        "gpl-2+": "under the terms of the GNU General Public License " + published.format(2),
        "gpl-3+": "under the terms of the GNU General Public License " + published.format("3.0"),
        "lgpl-2.1+": "under the terms of the GNU Lesser General Public License " + published.format("2.1"),
        "lgpl-2+": "under the terms of the GNU Library General Public License " + published.format("2.0"),
        "lgpl-3+": "the GNU Lesser General Public License version 3 of the License, or (at your option) any later version",
        "agpl-3+": "under the terms of the GNU Affero General Public License " + published.format("3.0"),
        "fdl-1.3+": "under the terms of the GNU Free Documentation License " + published.format("1.3"),
    }
    docs = spark.createDataFrame(list(enumerate(notices.values())), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, label in enumerate(notices):
        assert label in got[i]["labels"].split(",") and label[:-1] not in got[i]["labels"].split(",") and got[i]["score"] == 1.0


def test_containment_suppression(spark):
    rows = [(1, [(0, 5, "a", 1.0, False, 3), (1, 4, "b", 1.0, False, 0), (0, 5, "c", 1.0, False, 1), (4, 7, "d", 0.5, False, 9)]), (2, [(1, 4, "e", 1.0, False, 5), (0, 9, "f", 1.0, True, 0)]), (3, [])]
    df = spark.createDataFrame(rows, "k long, found array<struct<start: long, end: long, label: string, score: double, base: boolean, priority: int>>")
    assert {r["k"]: (sorted(r["o"]["labels"]), r["o"]["score"]) for r in df.select("k", licenses.unsuppressed(F.col("found")).alias("o")).collect()} == {1: (["c", "d"], 1.0), 2: (["e"], 1.0), 3: ([], 0.0)}


def plain_licenses(text, rules):
    """Words, detections of every rule at every place, and what containment leaves."""
    w = re.findall(licenses.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for i in range(len(w)):
        ahead = " ".join(w[i:])
        for k, r in enumerate(rules):
            if r.pattern[0] in ("(", w[i][0]) and (m := re.match(rf"(?:{r.pattern})(?= |$)", ahead)):
                found.append((i, i + len(m[0].split(" ")) - 1, k, r))
    base = [d for d in found if d[3].base]
    other = [d for d in found if not d[3].base]
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and ((a[0], a[1]) != (b[0], b[1]) or b[2] < a[2])
    left = base + [d for d in other if not any(inside(d, e) for e in other)]
    return len(w), len(base), sorted({d[3].label for d in base}), sorted({d[3].label for d in left}), max((d[3].score for d in left), default=0.0)


def test_licenses_against_every_rule_at_every_place(spark):
    """Texts made of the rules' own wordings, between words that look like gates and keywords."""
    rng = random.Random(4)
    rules = licenses.build_rules()
    fill = ["mit", "accept", "cc", "by", "the", "The", "publicly", "oslo", "(c)", "©", "2019", "19999", "é", "licen", "x,", "2", "CC0", "May not", "ümit"]
    plain = [re.sub(r"\\S\+", "any", re.sub(r"\\d", "7", re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?:\?|\{1,4\})?", r"\1", r.pattern))).replace("?", "") for r in rules]
    rows = [(1, None), (2, ""), (3, " \n")] + [(10 + i, " - ".join(rng.choice(fill) if rng.random() < 0.6 else rng.choice(plain).title() for _ in range(rng.randint(1, 40)))) for i in range(60)]
    rows += [(200 + i, p) for i, p in enumerate(plain)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("marks", F.lit(1)).repartition(4)).collect()}
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"], r["labels"], r["score"]) == (lambda n, b, bl, la, sc: (n, b, ",".join(bl), ",".join(la), sc))(*plain_licenses(text, rules)), text
    assert len({r["labels"] for r in got.values()}) > 120


def test_licenses_of_long_texts_and_none(spark, empty):
    text = "mit license cc by " * 5000
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_base"], r["labels"], r["last_word"]) == (20_000, 5000, "cc-by,mit", 19_998)
    assert licenses.scan(empty).count() == 0


def removed(rows, size, units, join):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        w, gone = units(text or ""), set()
        for a in range(len(w) - size + 1):
            k = w[a : a + size] if isinstance(w, bytes) else tuple(w[a : a + size])
            if k in seen:
                gone |= set(range(a, a + size))
            seen.add(k)
        out[i] = (len(w), len(gone), sha256(join([x for j, x in enumerate(w) if j not in gone])).hexdigest(), sum(j - 1 not in gone for j in gone))
    return out


def test_repeated_words(docs, rows):
    want = removed(rows, 20, words, lambda w: " ".join(w).encode())
    got = recompression.dedup_words(docs.withColumn("n_words", F.lit("clash"))).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {k: v[:3] for k, v in want.items()}
    assert all(r["text"] == t for r in got for i, t, *_ in rows if i == r["doc_id"] and r["n_removed"] == 0)


@pytest.mark.parametrize("batches", [1, 5])
def test_repeated_bytes(docs, rows, batches):
    want = removed(rows, 100, str.encode, bytes)
    got = suffix_levels.dedup_bytes(docs, batches=batches).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"], r["n_spans"]) for r in got} == want


@pytest.fixture(params=[1, 10000], ids=["batches of one row", "one batch"])
def batch_rows(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def passages(*names):
    return " ".join(f"{name}{i}" for name in names for i in range(30))


def test_repeated_rows_keep_their_text(spark, batch_rows):
    distinct = [(1, passages("a", "b", "a")), (2, passages("c", "b")), (3, passages("d"))]
    docs = spark.createDataFrame([*distinct, *distinct, distinct[0]], "doc_id long, text string").coalesce(1)
    want = removed(distinct, 20, words, lambda w: " ".join(w).encode())
    got = recompression.dedup_words(docs).collect()
    assert len(got) == 7 and all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]][:3] for r in got)
    want = removed(distinct, 100, str.encode, bytes)
    got = suffix_levels.dedup_bytes(docs, batches=2).collect()
    assert len(got) == 7 and all((r["n_bytes"], r["n_removed"], r["kept_sha256"], r["n_spans"]) == want[r["doc_id"]] for r in got)


def test_rows_without_doc_id_have_places_of_their_own(spark, batch_rows):
    texts = [passages("a", "b"), passages("c", "b", "d"), passages("e", "a"), passages("c", "b", "d"), passages("f"), None]
    docs = spark.createDataFrame([*((None, t) for t in texts), (0, passages("f", "g")), (9, passages("h", "f")), (9, passages("i", "h"))], "doc_id int, text string").coalesce(1)
    order = docs.withColumn("h", F.struct(F.xxhash64("text"), F.sha2("text", 256))).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()
    known, copies = [], []
    for r in order:  # rows that repeat doc_id and text are one document
        again = [k for k, before in enumerate(known) if (before[2], before[1]) == (r["doc_id"], r["text"])]
        copies.append(again[0] if again else len(known))
        if not again:
            known.append((len(known), r["text"], r["doc_id"]))
    want = removed(known, 20, words, lambda w: " ".join(w).encode())
    got = recompression.dedup_words(docs)
    assert got.schema["doc_id"] == docs.schema["doc_id"]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == sorted((str(known[k][2]), *want[k][:3]) for k in copies)
    want = removed(known, 100, str.encode, bytes)
    got = suffix_levels.dedup_bytes(docs, batches=2).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["kept_sha256"], r["n_spans"]) for r in got) == sorted((str(known[k][2]), *want[k]) for k in copies)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_repeats_in_long_and_periodic_texts_with_wide_ids(spark, monkeypatch, rounds):
    """Texts that are read in pieces, runs and periods, ids of 64 bits."""
    monkeypatch.setattr(recompression, "CHUNK", 700)
    monkeypatch.setattr(suffix_levels, "CHUNK", 700)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = random.Random(rounds)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(15, 60))) for _ in range(6)]
    texts = ["  ".join(rng.choice(pool) if rng.random() < 0.6 else " ".join(str(rng.random()) for _ in range(9)) for _ in range(rng.randint(0, 14))) for _ in range(14)]
    texts += ["x " * 900, "a b " * 300 + "c", "x " * 30 + "é" * 400, "z" * 3000 + " " + pool[0], pool[1], "x y z " * 5]
    rows = [((i * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63), t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = removed(rows, 20, words, lambda w: " ".join(w).encode())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompression.dedup_words(docs, rounds=rounds).collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    if rounds == 1:
        want = removed(rows, 100, str.encode, bytes)
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"], r["n_spans"]) for r in suffix_levels.dedup_bytes(docs).collect()} == want


def test_words_of_a_pattern_do_not_collide():
    """Words that a polynomial modulo 2^64 cannot tell apart."""
    a = "a"
    for _ in range(10):
        a += a.translate({97: 98, 98: 97})
    data = np.frombuffer((a + " " + a.translate({97: 98, 98: 97})).encode(), np.uint8)
    tokens, _ = word_tokens(data, np.array([0, len(data)]))
    whole = Spans(data.astype(np.uint64), octets=True).of(np.array([0, 1025]), np.array([1024, 2049]))
    assert tokens[0] != tokens[1] and whole[0] != whole[1]


def test_repeats_of_nothing(empty):
    assert recompression.dedup_words(empty).count() == 0 and suffix_levels.dedup_bytes(empty).count() == 0


@pytest.mark.parametrize(("shingle", "num"), [(3, 90), (5, 80)])
def test_jaccard(docs, rows, shingle, num):
    sets = {}
    for i, text, *_ in rows:
        w = words((text or "").lower() if (text or "").isascii() else text)
        sets[i] = frozenset(tuple(w[a : a + shingle]) for a in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = jaccard.near_duplicates(docs, jaccard.Likeness(shingle, num, 100)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("num", [50, 30])
def test_jaccard_across_size_classes(spark, num):
    sizes = (5, 10, 18, 33, 60, 100)
    sets = {10 * k + i: {f"g{k}w{j}" for j in range(n)} for k, (a, b) in enumerate((a, b) for a in sizes for b in sizes if a < b) for i, n in enumerate((a, b))}
    docs = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, jaccard.Likeness(1, num, 100)).collect()}
    linked = {i: i - 1 if i % 10 and 100 * len(sets[i] & sets[i - 1]) >= num * len(sets[i] | sets[i - 1]) else i for i in sets}
    assert got == linked and any(i != k for i, k in linked.items())


def brute_components(sets, num):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("small", "members"), [(64, 2048), (2, 2048), (2, 6)], ids=["pairs", "groups", "split groups"])
def test_jaccard_near_the_threshold(spark, monkeypatch, small, members):
    """Copies of three texts with so many edits that links come and go, some edits shared, some in chains."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "MOST_MEMBERS", members)
    rng = random.Random(11)
    texts = []
    for b in range(3):
        base = [f"b{b}w{j}" for j in range(90)]
        for _ in range(40):
            w = list(base)
            for at in rng.sample([3, 20, 21, 44, 60, 61, 80], rng.randint(0, 3)) + [rng.randrange(90) for _ in range(rng.randint(0, 2))]:
                w[at] = f"e{at}" if rng.random() < 0.5 else f"own{rng.random()}"
            texts.append(" ".join(w[rng.randint(0, 4) :]))
    sets = {i: frozenset(tuple(w[a : a + 3]) for a in range(len(w) - 2)) for i, w in enumerate(map(str.split, texts))}
    got = jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), jaccard.Likeness(3, 90, 100)).collect()
    want = brute_components(sets, 90)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and 10 < len(set(want.values())) < 110


def test_jaccard_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, long), (3, long + " x"), (None, long), (None, None), (7, ""), (9, "A b"), (9, "a B"), (9, "c d"), (None, "q r s"), (4, "q R s")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_shingles int, node int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["class_size"]) for r in jaccard.near_duplicates(docs, jaccard.Likeness(3, 90, 100)).collect()), key=str)
    want = [(5, 29_998, 3, 2), (3, 29_999, 3, 1), (None, 29_998, 3, 2), (None, 0, None, 1), (7, 0, 7, 1), (9, 1, 9, 2), (9, 1, 9, 2), (9, 1, 9, 1), (None, 1, 4, 2), (4, 1, 4, 2)]
    assert got == sorted(want, key=str)


def test_jaccard_keeps_one_row_of_each_component(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(4, a), (4, a), (2, a + " x"), (None, a), (7, b), (7, "q r s t u v"), (7, b), (None, None), (None, ""), (None, "other words here"), (None, "other words here"), (8, None)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, node string, id int")
    out = jaccard.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["node"], r["id"]) for r in out.collect()), key=str)
    assert got == sorted(((*r, "k", 1) for r in [(2, a + " x"), (7, b), (7, "q r s t u v"), (None, None), (None, ""), (None, "other words here"), (8, None)]), key=str)
    assert jaccard.deduplicated(docs.limit(0)).count() == 0


def test_frequency_in_spark(spark):
    keys = mix(np.arange(1, 4001, dtype=np.uint64))
    times = np.array([1, 2, 20, 200])[np.arange(4000) % 4]
    layout = frequency.Layout(3, 16)
    df = spark.createDataFrame([(int(k), int(t)) for k, t in zip(keys.view(np.int64), times)], "k long, t int").repartition(3)
    packs = df.mapInArrow(lambda batches: frequency.counted((np.repeat(b["k"].to_numpy().view(np.uint64), b["t"].to_numpy()) for b in batches), layout), "range int, hashes binary")
    got = frequency.frequency(packs, layout).occurrences(keys)
    want = np.array([0, 1, 2, 3])[np.arange(4000) % 4]
    assert (got >= want).all() and (got == want).mean() > 0.98


def test_jaccard_of_nothing(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(50, 60), (60, 55), (3, 40), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {3: 3} | {i: 3 for i in range(20, 41)} | {50: 50, 55: 50, 60: 50}


def test_warc_round_trip(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz \x00"
    pages = spark.createDataFrame([(1, "http://a", tricky), (2, "http://b", tricky), (3, None, None), (4, "http://c", ""), (2, "http://b", tricky), (None, "u\r\n\r\nWARC/1.1\nx", "é")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w"))
    assert records.count() == 18 and records.where("intact = false").count() == 0
    got = sorted(((r["metadata"]["page_id"], r["response"]["type"], r["response"]["payload_bytes"], bytes(r["response"]["payload"] or b"").decode()) for r in warc.transactions(records).collect()), key=str)
    n = len(tricky.encode())
    assert got == sorted([(1, "response", n, tricky), (2, "revisit", n, ""), (2, "revisit", n, ""), (3, "response", 0, ""), (4, "revisit", 0, ""), (None, "response", 2, "é")], key=str)


def test_pieces_are_those_of_the_library(spark, docs, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(2)
    texts = [r[1] or "" for r in rows] + ["".join(rng.choice("ab  \n\t▁éßü中😀.,1x<s>́\x00") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [" " * k + "x" for k in range(40)]
    codec = pieces.Codec(pieces.vocabulary(pieces.default_model()))
    for text in texts:
        joined, decoded = codec.encode(text)
        want = model.encode(text)
        assert codec.ids_of(joined) == want and joined == ",".join(map(str, want)) and decoded == model.decode(want) == codec.decode(want)
    for r in pieces.encode(docs.withColumn("ids", F.lit(1)), pieces.default_model()).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        assert r["ids"] == model.encode(text) and r["n_tokens"] == len(r["ids"])


def test_mixing(spark, docs, rows, empty):
    got = mixing.plan_mix(docs.withColumn("size", F.lit("clash"))).collect()
    size = {i: len(words(t)) for i, t, *_ in rows}
    total = Counter()
    for i, _, _, s, _ in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * total[s] if s in capped else level * weight[s] for s in order}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        rate = target[r["source"]] / total[r["source"]] if total[r["source"]] else 0
        assert r["copies"] in (int(rate + 1e-9), int(rate + 1e-9) + 1) and r["copies"] <= 3
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in mixing.plan_mix(docs.repartition(5)).collect())
    clashing = docs.select("*", *(F.lit(c).alias(c) for c in ("rate", "size", "copies", "target", "_copy")))
    assert mixing.mix(clashing).columns == clashing.columns and mixing.mix(clashing).where("rate = 'rate' AND size = 'size' AND copies = 'copies'").count() == sum(r["copies"] for r in got)
    long = spark.createDataFrame([(1, "w " * 200_000, "a"), (2, "w", "b")], "doc_id long, text string, source string")
    assert mixing.plan_mix(long).where("doc_id = 1").first()["size"] == 200_000
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.plan_mix(empty).count() == 0


def test_bytes_that_are_no_utf8(spark):
    """Broken bytes count as U+FFFD; words are compared as they are."""
    text = F.expr("cast(unhex('616220ff63') as string)")
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, F.concat_ws(" ", F.array_repeat(text, 12))).otherwise("ab").alias("text"))
    fixed = docs.withColumn("text", F.make_valid_utf8("text"))
    model = pieces.default_model()
    of = lambda d: sorted(map(tuple, pieces.encode(d, model).select("doc_id", "n_tokens", "ids_sha256", "decoded").collect()))
    assert of(docs) == of(fixed)
    cut = {r["doc_id"]: r for r in recompression.dedup_words(docs).collect()}
    assert cut[1]["n_removed"] == cut[1]["n_words"] == 24
    learned = language.Model({"en": b"ab ab abba", "de": b"zzz zz"})
    assert [r["lang_pred"] for r in language.identify(docs, learned).collect()] == ["en"] * 3


def test_language_keeps_user_columns(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, None, "y")], "doc_id long, text string, _letter string")
    learned = language.Model({"en": b"ab ab abba"})
    got = {r["doc_id"]: r for r in language.identify(docs.withColumn("letter", F.lit(3)), learned).collect()}
    assert (got[1]["_letter"], got[1]["letter"], got[1]["lang_pred"], got[2]["lang_pred"]) == ("x", 3, "en", "und")


def test_order_of_places_does_not_hang_on_length(monkeypatch):
    from quillrank.llm import arrays

    hashes = np.array([7 << 30, 5 << 30, (5 << 30) + 1, 9 << 30, 5 << 30], dtype=np.uint64)
    for bits in (24, 2):  # fewer places than the array has, and more
        monkeypatch.setattr(arrays, "_PLACE_BITS", bits)
        order, place_of = arrays.ordered(hashes)
        assert place_of(np.sort(order)).tolist() == [1, 2, 4, 0, 3]


def test_queries_are_the_operators(spark, docs, tmp_path):
    """op1, op2, op4 and op8 give for a table what their operators, tested above, give for its rows."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: sorted(map(str, df.collect()))
    d = str(tmp_path)
    assert rows(quality.op1_quality(spark, d)) == rows(quality.quality(docs.select("doc_id", "text")).drop("text"))
    assert rows(fingerprints.op2_fingerprints(spark, d)) == rows(fingerprints.fingerprints(docs))
    assert rows(licenses.op4_licenses(spark, d)) == rows(licenses.scan(docs.select("doc_id", "text")).drop("text"))
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r, text in zip(pieces.op8_pieces(spark, d).orderBy("doc_id").collect(), (x["text"] or "" for x in docs.orderBy("doc_id").collect()), strict=True):
        ids = library.encode(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_long_repeated_and_no_texts(spark, empty):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    long = "the quick brown fox " * 40_000
    df = spark.createDataFrame([(1, "twice over"), (1, "twice over"), (2, long), (3, None)], "doc_id long, text string")
    got = pieces.encode(df, model).select("doc_id", "ids").collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=i, ids=library.encode(t))) for i, t in ((1, "twice over"), (1, "twice over"), (2, long), (3, "")))
    assert pieces.encode(empty, model).count() == 0


def test_ids_that_are_no_numbers_are_named(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", "u", "h")], "doc_id string, text string, url string, html string")
    with pytest.raises(ValueError, match="doc_id"):
        fingerprints.fingerprints(df)
    with pytest.raises(ValueError, match="page_id"):
        warc.write_archives(df.withColumnRenamed("doc_id", "page_id"), f"{tmp_path}/w")


def test_archives_of_no_pages_and_of_a_long_one(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    none.write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op7_warc(spark, str(tmp_path)).count() == 0
    long = "<p>" + "x" * 3_000_000 + "</p>"
    spark.createDataFrame([(1, "u", long), (2, None, long), (3, "v", None)], none.schema).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op7_warc(spark, str(tmp_path)).collect()}
    assert got == {1: (len(long), "response", None), 2: (len(long), "revisit", 1), 3: (0, "response", None)}


def test_language_scores_by_a_plain_parse(spark):
    """lang_pred and score of texts shorter than a segment, against phrases counted one by one; long, tied and no texts."""
    samples = {"de": b"der hund und die katze und das haus", "en": b"the dog and the cat and the house"}
    model = language.Model(samples)
    texts = ["the dog", "der hund", "zzz qq", "die und the and", "", None, "12 .."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, "the cat and the dog " * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 99)] == ["en", "de", "en"]
    assert got[2]["lang_pred"] == "de"  # a tie goes to the one that sorts first
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (4, 5, 6))
    assert all(0 < got[i]["score"] <= 1 for i in (0, 1, 2, 3, 99))
    assert language.identify(df.limit(0), model).count() == 0


def test_full_bit_tables_lose_nothing(docs, rows, monkeypatch):
    """Where the tables' bound is far too small for the keys, everything passes the filters and results stay."""
    from quillrank.llm import bits

    want = [sorted(map(str, f(docs).collect())) for f in (recompression.dedup_words, lambda d: suffix_levels.dedup_bytes(d), lambda d: jaccard.deduplicated(d, jaccard.Likeness(3, 90, 100)))]
    monkeypatch.setattr(frequency, "MOST_TABLE_LOG2", 4)
    monkeypatch.setattr(frequency, "_SLICE_LOG2", 4)
    monkeypatch.setattr(bits, "MOST_BITS_LOG2", 7)
    monkeypatch.setattr(bits, "bits_for", lambda keys, per_key=16: 7)
    monkeypatch.setattr(repeats, "bits_for", lambda keys, per_key=16: 7)
    monkeypatch.setattr(jaccard, "bits_for", lambda keys, per_key=16: 7)
    got = [sorted(map(str, f(docs).collect())) for f in (recompression.dedup_words, lambda d: suffix_levels.dedup_bytes(d), lambda d: jaccard.deduplicated(d, jaccard.Likeness(3, 90, 100)))]
    assert got == want
