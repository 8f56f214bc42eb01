"""Conversation structure repair by lazy weighted determinisation.

A conversation is right if the initials of its roles read `(s?(ua)+)?`. Four states tell
what has been read: nothing, s, u, a. An edit of a row (keep, rerole, delete) or an
inserted row moves between them at a cost, so a nondeterministic weighted automaton holds
all repairs. Its determinisation runs over vectors: the cheapest way from each state to
the end. Normalised (least cost taken off) they are the states of a deterministic
automaton that is built as far as conversations need it: a transition (vector, row) is
worked out once, with the cost taken off and, for each of the four states, the tight arc
that is ASCII-least; afterwards it is a table look-up.

A scan over a conversation's rows from the last one to the first gives its cost. The trace
then runs back over the vectors met, along tight arcs only, and gives the audit string.

Conversations are dealt by ranges of (conversation, order), so one that holds a third of
all rows spreads over many tasks. What lies inside a part is done there. The first and the
last conversation of each part may cross a border; they are handled by their parts: each
part is a min-plus matrix (the scan of the four unit vectors); the matrices give the
vector after each part, each part then says where the trace leaves it for each state where
it may enter, and at last every part traces itself. Some dozen numbers for each of these
meet on the driver (two per part at most), texts and audits never.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.arrays import frugal
from quillrank.llm.shared import small_batches, stored, table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INF = 1 << 40
N_STATES = 4
#: What each state reads next as (state after) user or assistant: a rerole or an insertion has no other choice.
FOLLOW = (2, 2, 3, 2)
FOLLOW_ROLE = ("user", "user", "assistant", "user")
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ACCEPTING = (0, 3)
#: Rows as symbols: 0 must go; 1.. the initial s, u, a or another one, with 4 more if truncated.
GONE, INITIALS = 0, "sua"
#: Bytes of text for which a range is made, about; a task holds the rows of one conversation's part.
PART_BYTES = 32 << 20


class Automaton:
    """The deterministic automaton as far as it was needed: vectors, transitions and tight arcs."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, int], list[tuple[str, int]]] = {}
        final = [0 if q in ACCEPTING else INF for q in range(N_STATES)]
        self.final = self.closed(final)

    @staticmethod
    def closed(costs: list[int]) -> tuple[int, ...]:
        """Costs where rows may be inserted first."""
        costs = list(costs)
        for _ in range(N_STATES):
            costs = [min(c, INF, costs[FOLLOW[q]] + INSERT) for q, c in enumerate(costs)]
        return tuple(costs)

    def state(self, vector: tuple[int, ...]) -> tuple[int, int]:
        """(number of the normalised vector, what was taken off)."""
        least = min(vector)
        vector = tuple(INF if c >= INF else c - least for c in vector)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    @staticmethod
    def options(q: int, symbol: int) -> list[tuple[str, int, int]]:
        """(edit, cost, state after) of a row in state q, in ASCII order of edits; insertions aside."""
        out = [("D", DELETE, q)]
        if symbol != GONE:
            worse = TRUNCATED if symbol > 4 else 0
            kept = KEPT[INITIALS[(symbol - 1) % 4]][q] if (symbol - 1) % 4 < 3 else None
            if kept is not None:
                out.append(("K", worse, kept))
            out.append(("R", REROLE + worse, FOLLOW[q]))
        return out

    def step(self, after: int, symbol: int) -> tuple[int, int]:
        """(vector before the row, cost taken off), cached."""
        known = self.table.get((after, symbol))
        if known is None:
            costs = self.vectors[after]
            before = self.closed([min(c + costs[to] for _, c, to in self.options(q, symbol)) for q in range(N_STATES)])
            known = self.table[after, symbol] = self.state(before)
            self.arcs[after, symbol] = [self.trace(before, costs, symbol, q) for q in range(N_STATES)]
        return known

    def trace(self, before: tuple[int, ...], after: tuple[int, ...], symbol: int, q: int) -> tuple[str, int]:
        """The tight edits up to and with the row from state q, ASCII-least, and the state after it."""
        edits = ""
        while before[q] < INF:
            tight = [("I", FOLLOW[q])] if before[q] == before[FOLLOW[q]] + INSERT else []
            tight += [(e, to) for e, c, to in self.options(q, symbol) if before[q] == c + after[to]]
            edit, q = min(tight)
            edits += edit
            if edit != "I":
                return edits, q
        return "", -1

    def tail(self, q: int) -> str:
        """Insertions after the last row."""
        edits = ""
        while q not in ACCEPTING:
            q, edits = FOLLOW[q], edits + "I"
        return edits

    def scan(self, symbols: list[int], vector: tuple[int, ...]) -> tuple[list[int], int]:
        """(the automaton's state after each row, and before the first at the end; the cost) from the last row back."""
        now, cost = self.state(vector)
        met = [now]
        for symbol in reversed(symbols):
            now, off = self.step(now, symbol)
            cost += off
            met.append(now)
        return met, cost

    def matrix(self, symbols: list[int]) -> list[int]:
        """Costs from state q before the rows to state r after them, at 4 * r + q."""
        out: list[int] = []
        for r in range(N_STATES):
            met, cost = self.scan(symbols, tuple(0 if q == r else INF for q in range(N_STATES)))
            out += [min(INF, c + cost) for c in self.vectors[met[-1]]]
        return out

    def edits(self, symbols: list[int], met: list[int], q: int) -> tuple[list[str], int]:
        """The edits of each row (insertions before it first) from state q, and the state after all."""
        out = []
        for symbol, after in zip(symbols, reversed(met[:-1]), strict=True):
            edit, q = self.arcs[after, symbol][q]
            out.append(edit)
        return out, q


def apply_matrix(matrix: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(INF, *(matrix[4 * r + q] + after[r] for r in range(N_STATES))) for q in range(N_STATES))


def fault_of_text() -> Column:
    """blank, truncated or null: what a row's text alone tells."""
    text = F.col("text")
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank").when(~last.isin(".", "!", "?"), "truncated")


class Piece:
    """The rows of one conversation, or of its part of a range, with their faults and symbols.

    `seen` tells rows whose role and text occur in an earlier part; `contents` identify texts.
    """

    def __init__(self, turns: list, roles: list[str], own: list, contents: list, texts: list, seen: list):
        self.turns, self.roles, self.texts = turns, roles, texts
        self.faults, self.symbols = [], []
        known = set()
        for role, fault, content, before in zip(roles, own, contents, seen, strict=True):
            if fault != "blank" and (before or (role, content) in known):
                fault = "duplicate"
            known.add((role, content))
            self.faults.append(fault)
            kind = INITIALS.find(role[0]) if role else -1
            self.symbols.append(GONE if fault in ("blank", "duplicate") else 1 + (kind if kind >= 0 else 3) + 4 * (fault == "truncated"))

    def counts(self) -> dict:
        dated = [t for t in self.turns if t is not None]
        pairs = zip(self.roles[:-1], self.roles[1:], strict=True)
        out = {k: self.faults.count(k) for k in ("blank", "duplicate", "truncated")}
        out["illegal"] = sum(illegal(a, b) for a, b in pairs)
        return out | {"low": dated[0] if dated else None, "high": dated[-1] if dated else None, "turns": len(set(dated))}

    def lines(self, edits: list[str], q: int) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of each edit from state q; deleted rows with the role and text they had."""
        for role, text, several in zip(self.roles, self.texts, edits, strict=True):
            for edit in several:
                if edit in "IR":
                    yield edit, FOLLOW_ROLE[q], "" if edit == "I" else text
                    q = FOLLOW[q]
                else:
                    yield edit, role, text
                    q = KEPT[role[0]][q] if edit == "K" else q


def illegal(a: str, b: str) -> bool:
    return a[:1] + b[:1] not in ("su", "ua", "au")


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LINES = "array<struct<edit: string, role: string, text: string>>"
RAW = "part int, turn long, role string, text string, own string"
_REPORT = [x.split()[0] for x in REPORT.split(", ")]
_RAW = [x.split()[0] for x in RAW.split(", ")]
_KINDS = dict.fromkeys([*_REPORT, "turn"], pa.int64()) | dict.fromkeys(("audit", "repaired_sha256", "role", "text", "own"), pa.string()) | {"part": pa.int32(), "lines": pa.list_(pa.struct([(x, pa.string()) for x in ("edit", "role", "text")]))}


def _batch(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of REPORT, lines and RAW columns; those not named are null."""
    columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {}
    every = [*_REPORT, "lines", *_RAW]
    return pa.RecordBatch.from_arrays([pa.array(list(columns[c]) if c in columns else [None] * len(rows), _KINDS[c]) for c in every], names=every)


def _finished(automaton: Automaton, conv, p: Piece, with_lines: bool) -> tuple:
    n, (met, cost) = p.counts(), automaton.scan(p.symbols, automaton.final)
    edits, q = automaton.edits(p.symbols, met, 0)
    edits[-1] += automaton.tail(q)
    done = list(p.lines(edits, 0))
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for edit, role, text in done if edit != "D").encode()).hexdigest()
    return (conv, _gaps(n["low"], n["high"], n["turns"]), n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost + automaton.vectors[met[-1]][0], "".join(edits), digest, done if with_lines else None)


def inner_conversations(rows: DataFrame, part_bytes: int, with_lines: bool) -> DataFrame:
    """A stored table: REPORT and lines of conversations inside a range; RAW rows of the first and last of each range."""
    octets = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), octets // part_bytes + 1)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    dealt = rows.withColumn("own", fault_of_text()).repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    dealt = dealt.select("conv_id", F.spark_partition_id().alias("part"), *_RAW[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, conv, held, first, some, done = Automaton(), None, [], True, False, []
        raw = ["conv_id", *_RAW]

        for batch in batches:
            border = []
            for row in zip(*(batch.column(c).to_pylist() for c in raw), strict=True):
                if some and row[0] != conv:
                    if not first:
                        _, _, turns, roles, texts, own = map(list, zip(*held, strict=True))
                        done.append(_finished(automaton, conv, Piece(turns, roles, own, texts, texts, [False] * len(own)), with_lines))
                    first, held = False, []
                conv, some = row[0], True
                (border if first else held).append(row)
            if border:
                yield _batch(raw, border)
            if done:
                yield _batch([*_REPORT, "lines"], done)
                done = []
        if held:
            yield _batch(raw, held)

    return stored(dealt.mapInArrow(frugal(run), f"{REPORT}, lines {LINES}, {RAW}"), "repair")


def border_conversations(rows: DataFrame, with_lines: bool) -> DataFrame:
    """REPORT and lines (one row per part and conversation if with_lines, else one per conversation), by the parts."""
    content = F.sha2("text", 256)
    rows = rows.select("conv_id", *_RAW, content.alias("content"))
    earliest = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("content").alias("x")).agg(F.min("part").alias("earliest"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("content") == F.col("x"))
    rows = rows.join(earliest, same).withColumn("seen", F.col("part") > F.col("earliest"))
    order = ["part", F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"), "text"]
    read = ["part", "conv_id", "turn", "role", "own", "content", "text", "seen"]
    dealt = rows.repartition("part", "conv_id").sortWithinPartitions(*order).select(*read)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, Piece]]:
        held, key = [], None
        for batch in batches:
            for part, conv, *rest in zip(*(batch.column(c).to_pylist() for c in read), strict=True):
                if held and (part, conv) != key:
                    yield *key, Piece(*map(list, zip(*held, strict=True)))
                    held = []
                key = (part, conv)
                held.append(rest)
        if held:
            yield *key, Piece(*map(list, zip(*held, strict=True)))

    def at(part, conv) -> dict:
        return {"part": pa.array([part], pa.int32()), "conv_id": pa.array([conv], pa.int64())}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for part, conv, p in parts(batches):
            n = p.counts()
            numbers = [n[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")]
            yield pa.RecordBatch.from_pydict(at(part, conv) | {"n": pa.array([numbers], pa.list_(pa.int64())), "ends": [[p.roles[0][:1], p.roles[-1][:1]]], "matrix": [automaton.matrix(p.symbols)]})

    seen = dealt.mapInArrow(frugal(look), "part int, conv_id long, n array<long>, ends array<string>, matrix array<long>").collect()  # two rows per part at most
    of: dict = {}
    for r in sorted(seen, key=lambda r: r["part"]):
        of.setdefault(r["conv_id"], []).append(r)
    final, after, reports = Automaton().final, {}, {}
    for c, found in of.items():
        now = final
        for r in reversed(found):
            after[r["part"], c] = now
            now = apply_matrix(r["matrix"], now)
        blank, duplicate, truncated, wrong, turns = (sum(r["n"][k] for r in found) for k in range(5))
        wrong += sum(illegal(a["ends"][1], b["ends"][0]) for a, b in zip(found[:-1], found[1:], strict=True))
        dated = [r["n"] for r in found if r["n"][5] is not None]
        turns -= sum(a[6] == b[5] for a, b in zip(dated[:-1], dated[1:], strict=True))  # a turn on both sides of a border
        reports[c] = (c, _gaps(dated[0][5], dated[-1][6], turns) if dated else 0, blank, duplicate, truncated, wrong, now[0])

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for part, conv, p in parts(batches):
            met, _ = automaton.scan(p.symbols, after[part, conv])
            leaves = [automaton.edits(p.symbols, met, q)[1] if automaton.vectors[met[-1]][q] < INF else -1 for q in range(N_STATES)]
            yield pa.RecordBatch.from_pydict(at(part, conv) | {"leaves": pa.array([leaves], pa.list_(pa.int32()))})

    moves = {(r["part"], r["conv_id"]): r["leaves"] for r in dealt.mapInArrow(frugal(ways), "part int, conv_id long, leaves array<int>").collect()}
    enter, ends = {}, {c: found[-1]["part"] for c, found in of.items()}
    for c, found in of.items():
        q = 0
        for r in found:
            enter[r["part"], c] = q
            q = moves[r["part"], c][q]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for part, conv, p in parts(batches):
            q = enter[part, conv]
            met, _ = automaton.scan(p.symbols, after[part, conv])
            edits, leaves = automaton.edits(p.symbols, met, q)
            if ends[conv] == part:
                edits[-1] += automaton.tail(leaves)
            done = list(p.lines(edits, q))
            repaired = "".join(f"{role}:{text}\n" for edit, role, text in done if edit != "D")
            yield pa.RecordBatch.from_pydict(at(part, conv) | {"audit": ["".join(edits)], "repaired": [repaired], "lines": pa.array([done if with_lines else None], _KINDS["lines"])})

    traced = dealt.mapInArrow(frugal(told), f"part int, conv_id long, audit string, repaired string, lines {LINES}")
    if with_lines:
        return traced
    # SHA-256 has no parallel form: the digest of one conversation streams through one task, part by part
    streams = traced.drop("lines").repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, digest, joint = None, [], None, b""

        def report() -> pa.RecordBatch:
            return _batch([*_REPORT], [(*reports[conv], "".join(audit), digest.hexdigest())])

        for batch in batches:
            for c, part_audit, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "audit", "repaired")), strict=True):
                if digest is not None and c != conv:
                    yield report()
                    digest = None
                if digest is None:
                    conv, audit, digest, joint = c, [], hashlib.sha256(), b""
                audit.append(part_audit)
                if text:
                    digest.update(joint + text[:-1].encode())
                    joint = b"\n"
        if digest is not None:
            yield report()

    return streams.mapInArrow(frugal(digests), f"{REPORT}, lines {LINES}, {RAW}").select(*_REPORT)


def _prepared(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    text = lambda c: F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"))


def repair(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """A row per conversation of `rows` (conv_id, turn, role, text): faults, cost, audit and digest of the repair.

    Null roles and texts are one space. Rows are taken by turn (null first), those of one
    turn by role and content. A row's first fault counts: blank (no word), duplicate (role
    and text of an earlier row), truncated (the last character but white space is none of
    .!?). Rows without conv_id form one conversation. A row with an empty role has no
    initial: it is reroled or deleted. An empty table gives an empty result; other columns
    are left alone. `audit` names the cheapest edits in order: D, I, K, R; the ASCII-least
    of equal ones. Texts of any length pass whole.
    """
    found = inner_conversations(_prepared(rows), part_bytes, False)
    return found.where("part IS NULL").select(*_REPORT).unionByName(border_conversations(found.where("part IS NOT NULL"), False))


def repaired_rows(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, at, edit, role, text: every edit of the cheapest repairs, in order of (part, at); rows of D are those that go."""
    found = inner_conversations(_prepared(rows), part_bytes, True)
    inner = found.where("part IS NULL").select("conv_id", F.lit(0).alias("part"), "lines")
    lines = inner.unionByName(border_conversations(found.where("part IS NOT NULL"), True).select("conv_id", "part", "lines"))
    return lines.select("conv_id", "part", F.posexplode("lines").alias("at", "line")).select("conv_id", "part", "at", "line.*")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the contract's damage, by crc32('conv_id:turn') % 20; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    role, text = space("role"), space("text")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", "role", "text")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "_own")
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_own")), "left").drop("_own")
    return joined.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
