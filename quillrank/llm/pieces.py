"""SentencePiece (BPE) encoding by a prefix table, and decoding.

A token sequence is what merging gives exactly if every two neighbours are what merging
gives for their joined text. So each prefix of a word has one last token: of the tokens
that end there (an automaton over the vocabulary finds them), the one that is compatible
with the last token of the prefix before it. Ids are then read backwards. No piece
reaches over a space, so words are encoded apart, each distinct word once per cache.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.arrays import frugal, text_chunks
from quillrank.llm.shared import small_batches, table

SPACE_MARK = "▁"
CACHE_BYTES = 40 << 20  # of each half
COMPATIBLE_PAIRS = 200_000
_NEVER = float("inf")


def vocabulary(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, read from a model file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "none" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece"
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class Codec:
    """Encoder and decoder of one vocabulary; each Python worker holds one."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        import ahocorasick

        self.text = [p for p, _, _ in pieces]
        self.shown = [p.replace(SPACE_MARK, " ") for p in self.text]
        self.number = [str(i) for i in range(len(pieces))]
        self.bytes = {i: int(p[3:5], 16) for i, (p, _, k) in enumerate(pieces) if k == "byte"}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == "piece"}
        self.priority = {p: -score for p, score, k in pieces if k == "piece"}
        self.chars = {p for p in self.id if len(p) == 1}
        self.longest_run = max((len(p) for p in self.id if not p.strip(SPACE_MARK)), default=1)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.id):
            raise ValueError("pieces that reach over a space are not supported")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if set(piece) <= self.chars and (len(piece) == 1 or piece.strip(SPACE_MARK)):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, dict[int, bool]] = {}  # right piece -> left piece -> compatible
        self.n_pairs = 0
        self.whole: dict[int, bool] = {}
        self.histories: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.words: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}
        self.held = 0

    def merge(self, text: str) -> list[str]:
        """What merging gives for a short text: best priority first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.priority.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == float("inf"):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def history(self, a: int) -> tuple[list[float], list[str], list[str]]:
        """Priorities of the merges that form a piece, and its first and last part before each and at the end."""
        found = self.histories.get(a)
        if found is None:
            parts = list(self.text[a])
            order, firsts, lasts = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, i = min((self.priority.get(x + y, _NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
                if best == _NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                order.append(best)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            order.append(_NEVER)
            found = self.histories[a] = order, firsts, lasts
        return found

    def compatible(self, a: int, b: int) -> bool:
        """True if merging the joined text of two pieces gives the two pieces.

        Each side merges as it does alone until a pair across the border is due: better
        than the left side's next merge (equal ones on the left come first) and no worse
        than the right side's.
        """
        lefts = self.pairs.get(b)
        found = lefts.get(a) if lefts else None
        if found is None:
            if self.n_pairs >= COMPATIBLE_PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
            left, _, lasts = self.history(a)
            right, firsts, _ = self.history(b)
            i = j = 0
            priority = self.priority
            while True:
                across = priority.get(lasts[i] + firsts[j], _NEVER)
                if across < left[i] and across <= right[j]:
                    found = False
                    break
                if left[i] == right[j] == _NEVER:
                    found = True
                    break
                if left[i] <= right[j]:
                    i += 1
                else:
                    j += 1
            self.pairs.setdefault(b, {})[a] = found
            self.n_pairs += 1
        return found

    def alone(self, a: int) -> bool:
        found = self.whole.get(a)
        if found is None:
            found = self.whole[a] = self.merge(self.text[a]) == [self.text[a]]
        return found

    def known(self, text: str) -> list[int]:
        """Ids of a text of known characters without inner spaces, by the prefix table."""
        last = [-1] * (len(text) + 1)  # the last token of each prefix
        sizes = [0] * (len(text) + 1)
        pairs, whole, nothing = self.pairs, self.whole, {}
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - size
                if start:
                    fits = pairs.get(token, nothing).get(last[start])
                    if fits is None:
                        fits = self.compatible(last[start], token)
                else:
                    fits = whole.get(token)
                    if fits is None:
                        fits = self.alone(token)
                if fits:
                    last[end] = token
                    sizes[end] = size
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= sizes[at]
        ids.reverse()
        return ids

    def word(self, text: str) -> list[int]:
        """Ids of a word with its leading mark; characters outside the vocabulary become bytes."""
        if self.chars.issuperset(text):
            return self.known(text)
        ids: list[int] = []
        begin = 0
        for i, c in enumerate(text):
            if c not in self.chars:
                ids += self.known(text[begin:i])
                ids += (self.byte_id[b] for b in c.encode())
                begin = i + 1
        return ids + self.known(text[begin:])

    def marks(self, n: int) -> list[int]:
        """A run of spaces: the longest piece of marks forms from the left and never grows on."""
        full, rest = divmod(n, self.longest_run)
        return [self.id[SPACE_MARK * self.longest_run]] * full + [self.id[p] for p in self.merge(SPACE_MARK * rest)]

    def pieces_text(self, ids: list[int] | tuple[int, ...]) -> str:
        """The text of ids, marks as spaces; runs of byte pieces are read as UTF-8."""
        if self.bytes.keys().isdisjoint(ids):
            shown = self.shown
            return "".join([shown[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE_MARK, " ")

    def joined(self, ids: list[int] | tuple[int, ...]) -> str:
        number = self.number
        return ",".join([number[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_text(ids)
        return text[1:] if text.startswith(" ") else text

    def cached(self, part: str) -> str | tuple[str, str]:
        """Ids of a word joined by commas; with its decoded text where that isn't a space and the word."""
        found = self.older.get(part)
        if found is None:
            text = SPACE_MARK + part
            if self.chars.issuperset(text):  # such pieces join to the text again
                found = self.joined(self.known(text))
            else:
                ids = self.word(text)
                found, shown = self.joined(ids), self.pieces_text(ids)
                if shown[1:] != part or shown[0] != " ":
                    found = found, shown
        size = 250 + len(part) + len(found if isinstance(found, str) else found[0] + found[1])  # of the entry, about
        if size < CACHE_BYTES // 1000:
            self.words[part] = found
            self.held += size
            if self.held > CACHE_BYTES:  # words that are not met again are forgotten with the older half
                self.older, self.words, self.held = self.words, {}, 0
        return found

    def encode(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text)."""
        if not text:
            return "", ""
        text = text.replace(SPACE_MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            rows: list = list(map(self.words.get, parts))
            if None in rows:
                for at, part in enumerate(parts):
                    if rows[at] is None:
                        rows[at] = self.words.get(part) or self.cached(part)
            try:
                return ",".join(rows), text  # words that decode to themselves
            except TypeError:
                decoded = "".join([r[1] if isinstance(r, tuple) else " " + p for r, p in zip(rows, parts, strict=True)])
                return ",".join([r[0] if isinstance(r, tuple) else r for r in rows]), decoded[1:] if decoded.startswith(" ") else decoded
        ids: list[str] = []
        shown: list[str] = []
        marks = 0
        for part in parts:
            marks += 1
            if part:
                found = self.words.get(part) or self.cached(part)
                joined, decoded = found if isinstance(found, tuple) else (found, " " + part)
                if marks > 1:  # else the cached row is right as it is
                    own = self.ids_of(joined)
                    own = [*self.marks(marks), *own[1:]] if self.text[own[0]] == SPACE_MARK else [*self.marks(marks - 1), *own]
                    joined, decoded = self.joined(own), self.pieces_text(own)
                ids.append(joined)
                shown.append(decoded)
                marks = 0
        if marks:
            own = self.marks(marks)
            ids.append(self.joined(own))
            shown.append(self.pieces_text(own))
        decoded = "".join(shown)
        return ",".join(ids), decoded[1:] if decoded.startswith(" ") else decoded

    @staticmethod
    def ids_of(joined: str) -> list[int]:
        return list(map(int, joined.split(","))) if joined else []


_CODECS: dict[int, Codec] = {}


def _codec(pieces) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    if pieces.id not in _CODECS:
        _CODECS.clear()
        _CODECS[pieces.id] = Codec(pieces.value)
    return _CODECS[pieces.id]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def encode(docs: DataFrame, model_path: str, ids: bool = True) -> DataFrame:
    """`docs` without text, with n_tokens, ids_sha256, decoded_sha256 and (ids) ids, decoded.

    Null texts are empty: no ids, an empty decoded text. Columns of these names are
    replaced; rows stay as they are (repeated ones too), an empty table gives an empty
    result. Bytes that are no UTF-8 count as U+FFFD. A long text is encoded whole, by its
    words. The
    vocabulary (its size is fixed by the model) is broadcast.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])]
    columns = [c for c in docs.columns if c != "text" and c not in new]
    small_batches(docs.sparkSession)
    docs = docs.withColumn("text", F.make_valid_utf8(F.col("text").cast("string")))
    pieces = _Shared(docs.sparkSession.sparkContext.broadcast(vocabulary(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(pieces)
        for batch in batches:
            for part, offsets, data in text_chunks(batch):
                data = data.tobytes()
                count, digest, back, lists, texts = [], [], [], [], []
                for i in range(part.num_rows):
                    joined, decoded = codec.encode(data[offsets[i] : offsets[i + 1]].decode())
                    count.append(joined.count(",") + 1 if joined else 0)
                    digest.append(sha256(joined.encode()).hexdigest())
                    back.append(sha256(decoded.encode()).hexdigest())
                    if ids:
                        lists.append(np.array(joined.split(","), dtype=np.int32) if joined else np.zeros(0, np.int32))
                        texts.append(decoded)
                made = [pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
                if ids:
                    made += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *made], names=[*columns, *new])

    fields = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in columns]
    kinds = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>", "decoded string"] if ids else [])]
    return docs.mapInArrow(frugal(run), ", ".join([*fields, *kinds]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model(), ids=False)
