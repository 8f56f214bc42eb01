"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers how far a text can be
followed inside that language's sample. A text is cut into phrases: the longest match
from where the last phrase ended, and the symbol that broke it. Phrases per symbol, times
the cost of naming one, is the cross-parsing entropy; the language that needs fewest
normalised phrases wins.

The automata are learned from a bounded sample (SAMPLE_BYTES per language). Whole
texts are parsed: in segments of fixed length, many at a time as lanes of one numpy loop.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.arrays import frugal, text_chunks
from quillrank.llm.shared import table, unused

SAMPLE_BYTES = 40_000  # labelled text per language, the bound of the sample
SAMPLE_ROWS = 400  # rows per language that are asked for, about
SEGMENT = 512
UNKNOWN = "und"

#: Symbol of each byte: letters and bytes of other scripts stand for themselves, all else is a gap.
_SYMBOL = np.ones(256, dtype=np.int64)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(2, 28)
_SYMBOL[128:] = np.arange(28, 156)
N_SYMBOLS = 156


def symbols(data: np.ndarray) -> np.ndarray:
    return _SYMBOL[data]


def suffix_automaton(text: np.ndarray) -> np.ndarray:
    """Transitions [state, symbol] of the suffix automaton of a symbol sequence; 0 is the start and 'no way'."""
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = cur
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.zeros((len(follow), N_SYMBOLS), dtype=np.int32)
    for state, ways in enumerate(follow):
        for c, to in ways.items():
            table[state, c] = to
    return table


def compact(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table without symbols that never lead anywhere, and the new number of each symbol (0: none)."""
    used = np.flatnonzero(table.any(axis=0))
    number = np.zeros(N_SYMBOLS, dtype=np.int64)
    number[used] = np.arange(1, len(used) + 1)
    small = np.zeros((len(table), len(used) + 1), dtype=np.int32)
    small[:, 1:] = table[:, used]
    return small, number


def gaps_closed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with runs of gaps as one gap, and where each document starts."""
    s = symbols(data)
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != 1) | (s[:-1] != 1)
    keep[offsets[:-1][offsets[:-1] < len(s)]] = True
    total = np.zeros(len(s) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    return s[keep], total[offsets]


class Model:
    """Automata by language; languages in order of code points."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        self.tables, self.numbers, self.cost = [], [], []
        for name in self.languages:
            data = np.frombuffer(samples[name], dtype=np.uint8)
            text, _ = gaps_closed(data, np.array([0, len(data)]))
            small, number = compact(suffix_automaton(text))
            self.tables.append(small)
            self.numbers.append(number)
            self.cost.append(math.log2(len(text) + 2))

    def phrases(self, text: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Number of phrases [document, language]; the symbols of a chunk are cut into segments."""
        n = np.diff(first)
        per = (n + SEGMENT - 1) // SEGMENT
        owner = np.repeat(np.arange(len(n)), per)
        start = first[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * SEGMENT
        size = np.minimum(SEGMENT, first[1:][owner] - start)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        out = np.zeros((len(n), len(self.languages)), dtype=np.int64)
        if not len(owner):
            return out
        width = int(size[0])
        lanes = np.zeros((width, len(start)), dtype=np.int32)
        active = np.searchsorted(-size, -np.arange(width), side="left")  # segments longer than step
        for step in range(width):
            k = active[step]
            lanes[step, :k] = text[start[:k] + step]
        for j, (table, number) in enumerate(zip(self.tables, self.numbers, strict=True)):
            ways, flat = table.shape[1], table.ravel()
            codes = number.astype(np.int32)[lanes]
            state = np.zeros(len(start), dtype=np.int32)
            broken = np.zeros(len(start), dtype=np.int32)
            for step in range(width):
                k = active[step]
                state[:k] = flat[state[:k] * ways + codes[step, :k]]
                broken[:k] += state[:k] == 0
            np.add.at(out[:, j], owner, broken + 1)
        return out

    def judge(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, score) per document."""
        bits = self.phrases(text, first) * np.array(self.cost)
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        # chance of the best language if each phrase's bits are a code length, tempered by text length
        odds = np.exp2(-np.minimum((bits - least[:, None]) / np.sqrt(1 + least)[:, None], 60))
        return best, 1 / odds.sum(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """At most `size` bytes of labelled text per language, from rows that are not held out.

    Rows are chosen by a hash of doc_id at a rate that follows from the language's count,
    so about `rows` rows per language reach the driver, cut at `size` bytes each.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rates = F.create_map(*chain_literals({k: min(1.0, rows / n) for k, n in counts.items()}))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    chosen = labelled.where(draw <= F.element_at(rates, F.col("lang"))).select("lang", "doc_id", F.substring(F.coalesce("text", F.lit("")), 1, size).alias("text"))
    found: dict[str, bytes] = {}
    got = chosen.toPandas().sort_values(["lang", "doc_id"], kind="stable")
    for name, group in got.groupby("lang"):
        # shorter texts first: more documents within the bound
        texts = sorted((t.lower() for t in group["text"] if t), key=lambda t: (len(t), t))
        middle = texts[len(texts) // 4 :] + texts[: len(texts) // 4]
        found[name] = "\n".join(middle).encode()[:size]
    return {k: v for k, v in found.items() if v}


def chain_literals(pairs: dict) -> list[Column]:
    return [F.lit(x) for pair in pairs.items() for x in pair]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score; columns of these names are replaced.

    A text that is null or has no letter is `und` with score 0, as is every text if no
    language was learned. Ties go to the language that sorts first. Only the text
    decides: equal texts get equal answers. Texts of any length are parsed whole, bytes
    that are no UTF-8 count as U+FFFD, and an empty table gives an empty result.
    """
    base = docs.drop("lang_pred", "score")
    mark = unused("letter", {*base.columns, "lang_pred", "score"})
    text = F.make_valid_utf8(F.col("text").cast("string"))
    base = base.withColumn("text", text).withColumn(mark, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SAMPLE_BYTES * 2 states per language
    columns = [c for c in base.columns if c not in (mark, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        names = np.array([*learned.languages, UNKNOWN], dtype=object)
        for batch in batches:
            lower = batch.set_column(batch.schema.get_field_index("text"), "text", pc.utf8_lower(batch.column("text").cast(pa.large_string())))
            for part, offsets, data in text_chunks(lower):
                letter = part.column(mark).to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.full(part.num_rows, len(names) - 1), np.zeros(part.num_rows)
                if learned.languages and len(data):
                    best, score = learned.judge(*gaps_closed(data, offsets))
                    best, score = np.where(letter, best, len(names) - 1), np.where(letter, score, 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(names[best], pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    fields = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    return base.mapInArrow(frugal(run), ", ".join([*fields, "lang_pred string", "score double"]))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = Model(sample(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
