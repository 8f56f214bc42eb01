"""The corpus pipeline against plain versions of its stages, on a small table and on odd rows."""

from __future__ import annotations

from collections import Counter
from hashlib import md5

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quillrank.llm import pieces


def passes(text):
    """The quality rules by counting windows."""
    w, n = (text or "").split(), len((text or "").split())

    def inside(k):
        count = Counter(tuple(w[a : a + k]) for a in range(n - k + 1))
        return len({b for a in range(n - k + 1) if count[tuple(w[a : a + k])] > 1 for b in range(a, a + k)})

    least = max(50, n // 20 + 1)  # words of a repeat that is too long
    return n >= 20 and 100 * inside(8) <= 30 * n and 100 * inside(3) <= 50 * n and not inside(least)


def one_of_each_group(rows):
    shingled = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, text in rows.items() for w in [text.lower().split()]}
    root = {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(rows):
        for j in sorted(rows):
            if j < i and shingled[i] and 100 * len(shingled[i] & shingled[j]) >= 80 * len(shingled[i] | shingled[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(i for i in rows if find(i) == i)


def without_repeats(rows, order):
    seen, out = set(), {}
    for i in order:
        w, gone = rows[i].split(), set()
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if k in seen:
                gone |= set(range(a, a + 20))
            seen.add(k)
        out[i] = rows[i] if not gone else " ".join(x for n, x in enumerate(w) if n not in gone)
    return out


def copies(texts, source):
    """How often the mix takes each document: weights 5, 2, 1, at most three times a source."""
    size = {i: len(t.split()) for i, t in texts.items()}
    total = Counter()
    for i in texts:
        total[source[i]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        free = [s for s in order if s not in full]
        level = (sum(total.values()) - 3 * sum(total[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    rate = {s: 0.0 if not total[s] else 3.0 if s in full else level * weight[s] / total[s] for s in order}
    draw = {i: int(md5(f"{i}:17".encode()).hexdigest()[:12], 16) / 2**48 for i in texts}
    return {i: int(rate[source[i]]) + (draw[i] < rate[source[i]] % 1) for i in texts}


def test_run(spark):
    d = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, d).collect()
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    kept = {i: r["text"] for i, r in rows.items() if passes(r["text"])}
    left = one_of_each_group(kept)
    texts = without_repeats(kept, left)
    taken = copies(texts, {i: rows[i]["source"] for i in texts})
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = [(i, rows[i]["source"], model.encode(text)) for i, text in texts.items() for _ in range(taken[i])]
    assert sorted(((r["doc_id"], r["source"], r["ids"]) for r in got), key=str) == sorted(want, key=str)
    assert len(kept) < len(rows) and len(left) < len(kept) and any(texts[i] != kept[i] for i in left)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated rows, one doc_id with two texts, a long text, and columns of the stages' own names."""
    p = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, p("a"), "s"), (1, p("a"), "s"), (1, p("b"), "s"), (None, p("c"), None), (None, p("c"), None), (2, None, "t"), (3, "", "t"), (4, p("d") + " " + p("b"), "t"), (5, p("e", 30_000), None), (6, "w " * 99, "s")]
    docs = spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("kept", "n_words", "n_removed", "rate", "size", "copies", "node", "id", "rank", "spans", "_text")
    return docs.select("*", *(F.lit(c).alias(c) for c in names))


def test_stages_on_odd_rows(spark, odd):
    docs, counts = odd, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), odd.schema)
        counts.append(docs.count())
        assert docs.where(" OR ".join(f"{c} <> '{c}'" for c in odd.columns[5:])).count() == 0
    # two copies of a, b, two of c, d and b, e pass the rules; one row of each text is left
    assert counts[:3] == [7, 5, 5]
    cut = {(r["doc_id"], r["n_chars"]): r["text"] for r in corpus_pipeline.substring_dedup(spark, odd, "").collect() if r["doc_id"] == 4}
    assert list(cut.values()) == [" ".join(f"d{i}" for i in range(60))] and all(n == len(t) for (_, n), t in cut.items())
    encoded = corpus_pipeline.piece_ids(spark, odd, "").collect()
    assert len(encoded) == odd.count() and all(r["n_tokens"] == 0 for r in encoded if r["doc_id"] in (2, 3))


def test_stages_keep_columns_of_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 0
