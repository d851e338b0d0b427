"""Repair of conversations whose turns must read (s?(ua)+)?: an optional system turn, then user and
assistant by turns. The cheapest edits are found in one pass over each conversation in order of turns.

Rows are dealt by conversation and sorted by turn; mapInPandas then reads them as a stream and carries
the state of a dynamic program from batch to batch: for each of four places in the pattern (nothing yet,
after system, after user, after assistant) the least cost to be there, and which of the cheapest edit
lists sorts first. After a row every such list ends with that row's edit, so none is the beginning of
another, and four ranks are enough to keep the ASCII order. Costs relative to the least one are
bounded once hopeless places are dropped, so a step is one lookup in a table that fills as new cases turn up.

A row leaves four bytes of backpointers. A conversation of more than `held` rows or `held_bytes` of text
goes to files in the shared folder piece by piece (texts and backpointers apart); at its end the
backpointers are read backwards, and the texts once more forwards. Memory holds one piece and the audit.

Whether a turn's role and text were seen before in its conversation is decided by Spark: the first turn
of every (conversation, role, text digest) that occurs more than once is joined to the rows.

Edits of a row, and what they cost: Keep 0, Rerole to user or assistant 3, Delete 4 (the only choice for a
blank or duplicate row); a truncated row that stays costs 3 more. Insert puts an empty turn anywhere, for 3.

Defined cases: a null role or text is one space. Null turns come first; rows of one turn go by role and
text, so repeated rows stand together. A null conversation id is a conversation. A conversation that has
only lost rows, or an empty role, is returned like any other. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import open_store, shared_folder

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
EDITS = "DKR"  # of a row; I stands for Insert
HELD, HELD_BYTES = 100_000, 16 << 20
#: place in the pattern after one more turn with that initial
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLE = {"u": "user", "a": "assistant"}
COMPLETE = (0, 3)
LEGAL = {"su", "ua", "au"}
INSERTS = 2  # more between two rows only come back to the same place

_SPACE = r"\x20\x09-\x0D"


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, lost): rows after damage that a hash of conversation and turn decides. Lost
    rows stay as marks, so that a conversation without any other row is still known."""
    c = conversations
    key = F.concat(F.coalesce(c[conv].cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(c[turn].cast("string"), F.lit(" ")))
    rows = c.select(c[conv].alias("conv"), c[turn].alias("turn"), F.coalesce(c[role], F.lit(" ")).alias("role"),
                    F.coalesce(c[text], F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("damage"))
    kind = F.col("damage")
    return rows.select(
        "conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (kind == 0).alias("lost"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


# --- the dynamic program -------------------------------------------------------------------------


def _choices(cost, rank, initial: str, must_go: bool, cut: bool):
    """(place, cost, (rank of the list before, letters), source) of every way to take one more row."""
    for before in range(4):
        if cost[before] is None:
            continue
        place, letters = before, ""
        for j in range(INSERTS + 1):
            if j:
                place, letters = AFTER[place, WANTED[place]], letters + "I"
            base = cost[before] + INSERT * j
            yield place, base + DELETE, (rank[before], letters + "D"), (before, j, 0)
            if must_go:
                continue
            base += TRUNCATED * cut
            kept = AFTER.get((place, initial))
            if kept is not None:
                yield kept, base, (rank[before], letters + "K"), (before, j, 1)
            yield AFTER[place, WANTED[place]], base + REROLE, (rank[before], letters + "R"), (before, j, 2)


class Steps:
    """The dynamic program as an automaton: states are relative costs and ranks of the four places."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table: dict[tuple, tuple[int, int, bytes]] = {}
        self.first = self._number((0, None, None, None), (0, None, None, None))

    def _number(self, cost: tuple, rank: tuple) -> int:
        if (cost, rank) not in self.numbers:
            self.numbers[cost, rank] = len(self.states)
            self.states.append((cost, rank))
        return self.numbers[cost, rank]

    def step(self, state: int, initial: str, must_go: bool, cut: bool) -> tuple[int, int, bytes]:
        """(next state, by how much the least cost grows, backpointer of each place)."""
        key = (state, initial, must_go, cut)
        if key not in self.table:
            cost, rank = self.states[state]
            best: list = [None] * 4
            for place, total, order, source in _choices(cost, rank, initial, must_go, cut):
                if best[place] is None or (total, order) < best[place][:2]:
                    best[place] = (total, order, source)
            # After the assistant, all that follows from "nothing yet" can follow but a kept system turn, which
            # can go for DELETE; all that follows from "after system" can follow. What costs more is no use.
            if best[3]:
                best[:2] = [b if b and b[0] <= best[3][0] + more else None for b, more in zip(best, (DELETE, 0))]
            least = min(b[0] for b in best if b)
            orders = sorted(b[1] for b in best if b)
            pointers = bytes(b[2][0] << 4 | b[2][1] << 2 | b[2][2] if b else 255 for b in best)
            self.table[key] = (self._number(tuple(b[0] - least if b else None for b in best),
                                            tuple(orders.index(b[1]) if b else None for b in best)), least, pointers)
        return self.table[key]

    def end(self, state: int) -> tuple[int, int, int]:
        """(cost, place, inserts) of the cheapest way to complete the pattern."""
        cost, rank = self.states[state]
        found = []
        for before in range(4):
            place = before
            for j in range(INSERTS + 1):
                if j:
                    place = AFTER[place, WANTED[place]]
                if cost[before] is not None and place in COMPLETE:
                    found.append((cost[before] + INSERT * j, rank[before], "I" * j, before))
        total, _, letters, before = min(found)
        return total, before, len(letters)


# --- one conversation, row by row ----------------------------------------------------------------


class _Conversation:
    def __init__(self, conv, steps: Steps, folder: str, held: int, held_bytes: int):
        self.conv, self.steps, self.folder, self.held, self.held_bytes = conv, steps, folder, held, held_bytes
        self.state, self.cost, self.rows = steps.first, 0, 0
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: tuple | None = None
        self.roles, self.texts, self.pointers, self.size = [], [], bytearray(), 0
        self.pieces, self.store = 0, None

    def take(self, turn: int | None, role: str, text: str, seen: bool, blank: bool, cut: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        again = seen or self.last == (turn, role, text)
        if self.last is not None:
            self.illegal += self.last[1][:1] + role[:1] not in LEGAL
        self.last = (turn, role, text)
        self.blank += blank
        self.duplicate += again and not blank
        cut = cut and not again and not blank
        self.truncated += cut
        self.state, grown, pointers = self.steps.step(self.state, role[:1], blank or again, cut)
        self.cost += grown
        self.rows += 1
        self.pointers += pointers
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        if len(self.roles) >= self.held or self.size >= self.held_bytes:
            self._spill()

    def _spill(self) -> None:
        if self.store is None:
            self.store, path = open_store(self.folder)
            self.path = f"{path}/{uuid.uuid4().hex}"
            self.store.create_dir(self.path, recursive=True)
        table = pa.table({"role": pa.array(self.roles, pa.large_string()), "text": pa.array(self.texts, pa.large_string())})
        with self.store.open_output_stream(f"{self.path}/{self.pieces}.turns") as f, pa.ipc.new_stream(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        with self.store.open_output_stream(f"{self.path}/{self.pieces}.back") as f:
            f.write(bytes(self.pointers))
        self.pieces += 1
        self.roles, self.texts, self.pointers, self.size = [], [], bytearray(), 0

    def _pointers(self) -> Iterator[bytes]:
        """Backpointers of the pieces, last piece first."""
        yield bytes(self.pointers)
        for k in range(self.pieces - 1, -1, -1):
            with self.store.open_input_stream(f"{self.path}/{k}.back") as f:
                yield f.read()

    def _turns(self) -> Iterator[tuple[str, str]]:
        for k in range(self.pieces):
            with self.store.open_input_stream(f"{self.path}/{k}.turns") as f:
                table = pa.ipc.open_stream(f).read_all()
            yield from zip(table.column("role").to_pylist(), table.column("text").to_pylist())
        yield from zip(self.roles, self.texts)

    def edits(self) -> tuple[int, str]:
        """(cost, letters) of the cheapest edits that sort first."""
        extra, place, tail = self.steps.end(self.state)
        pieces = ["I" * tail]
        for pointers in self._pointers():
            letters = []
            for i in range(len(pointers) - 4, -1, -4):
                source = pointers[i + place]
                letters.append("I" * (source >> 2 & 3) + EDITS[source & 3])
                place = source >> 4
            pieces.append("".join(reversed(letters)))
        return self.cost + extra, "".join(reversed(pieces))

    def repaired(self, audit: str) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of every edit in order; a deleted row has neither role nor text."""
        place, rows = 0, self._turns()
        for letter in audit:
            role, text = (None, "") if letter == "I" else next(rows)
            if letter == "D":
                yield letter, None, None
                continue
            initial = role[:1] if letter == "K" else WANTED[place]
            place = AFTER[place, initial]
            yield letter, role if letter == "K" else ROLE[initial], text

    def close(self) -> None:
        if self.store is not None:
            self.store.delete_dir(self.path)

    def summary(self) -> tuple:
        cost, audit = self.edits()
        digest, between = hashlib.sha256(), b""
        for letter, role, text in self.repaired(audit):
            if letter != "D":
                digest.update(between + role.encode() + b":" + text.encode())
                between = b"\n"
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, self.rows, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest())


_SUMMARY = ["conv", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_EDITS = ["conv", "step", "edit", "role", "text"]


def _streamed(rows: DataFrame, folder: str, held: int, held_bytes: int, give, columns: list[str], batch: int = 2000):
    """A function for mapInPandas: rows in order of conversation and turn to what `give` makes of each conversation."""

    def run(frames):
        steps, now, out = Steps(), None, []
        for frame in frames:
            for conv, turn, role, text, lost, seen, blank, cut in frame.itertuples(index=False, name=None):
                conv = None if conv is None or conv != conv else conv
                if now is None or now.conv != conv:
                    if now is not None:
                        for row in give(now):
                            out.append(row)
                            if len(out) >= batch:
                                yield pd.DataFrame(out, columns=columns)
                                out = []
                        now.close()
                    now = _Conversation(conv, steps, folder, held, held_bytes)
                if not lost:
                    now.take(None if turn is None or turn != turn else int(turn), role, text, seen, blank, cut)
        if now is not None:
            for row in give(now):
                out.append(row)
                if len(out) >= batch:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            now.close()
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _judged(rows: DataFrame) -> DataFrame:
    """Rows in the order in which they are read: ids and turns as strings (pandas has no null integers),
    and whether a turn's role and text were seen in an earlier turn, whether it is blank, or cut short."""
    rows = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "lost")
    rows = rows.withColumn("digest", F.sha2("text", 256))
    several = (rows.filter(~F.col("lost")).groupBy("conv", "role", "digest")
               .agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("null_turn"))
               .filter("n > 1").alias("s"))
    r = rows.alias("r")
    both = r.join(several, F.col("r.conv").eqNullSafe(F.col("s.conv")) & (F.col("r.role") == F.col("s.role")) & (F.col("r.digest") == F.col("s.digest")), "left")
    seen = F.coalesce(F.col("r.turn").isNotNull() & (F.col("s.null_turn") | (F.col("s.first") < F.col("r.turn"))), F.lit(False))
    text = F.col("r.text")
    both = both.select("r.conv", "r.turn", "r.role", "r.text", "r.lost", seen.alias("seen"), (~text.rlike(f"[^{_SPACE}]")).alias("blank"),
                       (~text.rlike(rf"[.!?][{_SPACE}]*\z")).alias("cut"))
    ordered = both.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    return ordered.select(F.col("conv").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", "text", "lost", "seen", "blank", "cut")


def _with_marks(rows: DataFrame) -> DataFrame:
    return rows if "lost" in rows.columns else rows.withColumn("lost", F.lit(False))


def repair(rows: DataFrame, held: int = HELD, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per conversation of (conv, turn, role, text): its faults, the cost and the letters of the
    cheapest edits, and the SHA-256 of what they leave (`role:text` lines)."""
    rows = _with_marks(rows)
    folder = shared_folder(rows.sparkSession, "conversation-pieces")
    schema = "conv string, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    out = _judged(rows).mapInPandas(_streamed(rows, folder, held, held_bytes, lambda c: [c.summary()], _SUMMARY), schema)
    return out.withColumn("conv", F.col("conv").cast(dict(rows.dtypes)["conv"]))


def repaired_turns(rows: DataFrame, held: int = HELD, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(conv, step, edit, role, text): every edit in order; the turns that stay or are inserted have a role."""
    rows = _with_marks(rows)
    folder = shared_folder(rows.sparkSession, "conversation-pieces")

    def give(c: _Conversation):
        for step, edit in enumerate(c.repaired(c.edits()[1])):
            yield (c.conv, step, *edit)

    out = _judged(rows).mapInPandas(_streamed(rows, folder, held, held_bytes, give, _EDITS), "conv string, step long, edit string, role string, text string")
    return out.withColumn("conv", F.col("conv").cast(dict(rows.dtypes)["conv"]))
