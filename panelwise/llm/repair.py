"""Cheapest repair of damaged conversations to alternating turns.

Every row is kept (K, cost 0), given the role that fits (R, 2) or deleted (D, 3, the only way for blank and repeated
rows), and empty rows are put in (I, 2); a truncated row that stays costs 1 more. The rows that are left must read
``system? (user assistant)+`` by the first letters of their roles, or be none.

**One integer decides.** A node is (rows consumed, state), the states being what the row before allows. The weight of a way from
a node to the end is ``cost << width | letters``: the cost in the high digits, the audit letters in
three-bit digits from the left, zeros behind the end. The least integer over all ways is the cheapest audit, the ASCII-least of
several, a prefix before what it begins.

**Long conversations.** The ways out of one node differ in their first letter, so equal costs are decided by letters at once
and never by what comes far behind. The integers therefore need room for the letters of one chunk of
rows only: chunks are solved from the last to the first, each starting from the least costs of the four states behind
it, with the letters behind it as zeros. Work is linear in the rows, integers are short.

**On Spark.** Rows travel without their text first: sorted within the task that holds their conversation, they become one
byte each (the audit is of the same size), and the audits come out. Then the audit goes as a first row before the rows with
texts, again sorted within a task, and the repaired text is hashed row by row as it streams past, never held. The digest of a conversation
is one hash over all its rows, so a conversation belongs to one task; all else that needs more than a row's neighbour
(earlier equal rows, distinct turns) is an aggregate or a join whose keys spread within a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import store

BLANKS, BLANK_CLASS = " \t\n\x0b\x0c\r", r"\x20\x09-\x0D"
CHUNK = 64
DIGIT = 3
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
NAME = {code: letter for letter, code in LETTERS.items()}
#: states: nothing yet, after a system row, after a user row, after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: the state behind a row of the role that fits
FITTING = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: costs of the four states behind the last row; 1 << 60 is out of reach of any conversation
NEVER = 1 << 60
END = (0, NEVER, NEVER, 0)
#: a row as one byte: 2 bits for the role's letter (3: any other), 4 for must go, 8 for truncated
INITIALS = {"s": SYSTEM - 1, "u": USER - 1, "a": ASSISTANT - 1}
OTHER, MUST_GO, CUT_OFF = 3, 4, 8


def kept_state(state: int, symbol: int) -> int | None:
    """The state behind a kept row, or None if its role does not fit."""
    behind = (symbol & 3) + 1
    if behind == SYSTEM and state == START:
        return SYSTEM
    return behind if behind <= ASSISTANT and behind == FITTING[state] else None


@lru_cache(maxsize=1 << 12)
def solve_chunk(symbols: bytes, behind: tuple[int, ...] = END) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Least cost to the end of the conversation and audit letters of these rows, from each of the four states.

    ``behind`` holds the least costs from the states after these rows. At most two rows are put in at one place: a third would
    come back to a state already passed.
    """
    width = DIGIT * (3 * len(symbols) + 2)  # a row's letter and two more before each row, and behind the last
    digit = {letter: code << (width - DIGIT) for letter, code in LETTERS.items()}
    low = (1 << width) - 1

    def before(letter: str, cost: int, weight: int) -> int:
        """Weight with one more edit in front."""
        return (((weight >> width) + cost) << width) | digit[letter] | ((weight & low) >> DIGIT)

    def put_in(direct: list[int]) -> list[int]:
        once = [min(direct[s], before("I", INSERT, direct[FITTING[s]])) for s in STATES]
        return [min(direct[s], before("I", INSERT, once[FITTING[s]])) for s in STATES]

    node = put_in([cost << width for cost in behind])
    for symbol in reversed(symbols):
        stays = TRUNCATED if symbol & CUT_OFF else 0
        direct = []
        for s in STATES:
            ways = [before("D", DELETE, node[s])]
            if not symbol & MUST_GO:
                ways.append(before("R", REROLE + stays, node[FITTING[s]]))
                if (to := kept_state(s, symbol)) is not None:
                    ways.append(before("K", stays, node[to]))
            direct.append(min(ways))
        node = put_in(direct)
    return tuple(w >> width for w in node), tuple(_spell(w & low, width) for w in node)


def _spell(letters: int, width: int) -> str:
    digits = ((letters >> at) & 7 for at in range(width - DIGIT, -1, -DIGIT))
    return "".join(NAME[d] for d in digits if d)


def walk(audit: str, symbols: bytes, state: int = START) -> int:
    """The state behind the rows when ``audit`` is carried out from ``state``."""
    rows = iter(symbols)
    for letter in audit:
        symbol = None if letter == "I" else next(rows)
        if letter == "K":
            state = kept_state(state, symbol)
        elif letter != "D":
            state = FITTING[state]
    return state


def solve(symbols: bytes, chunk: int = CHUNK) -> tuple[int, str]:
    """(cost, audit) of one conversation.

    At a border between chunks a row put in is the later chunk's: there the same cost without a letter is the lesser integer.
    """
    if not symbols:
        return 0, ""
    parts, behind = [], END
    for at in range((len(symbols) - 1) // chunk * chunk, -1, -chunk):
        behind, audits = solve_chunk(symbols[at : at + chunk], behind)
        parts.append((symbols[at : at + chunk], audits))
    state, audit = START, []
    for rows, audits in reversed(parts):
        audit.append(audits[state])
        state = walk(audits[state], rows, state)
    return behind[START], "".join(audit)


# ---- rows ----------------------------------------------------------------------------------


def damage(df: DataFrame) -> DataFrame:
    """The rows of a (conv_id, turn, role, text) table after damage by their number's CRC-32.

    Null roles and texts become one space; null numbers are one space in the CRC only. Of 20 classes, 0 drops a row, 1 empties its
    text, 2 removes its sentence ends, 3 repeats it, 4 makes its role ``user``.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("hit"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("hit <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _printed(rows: DataFrame) -> DataFrame:
    """``rows`` with their text's MD5, by which rows of one turn and role are ordered."""
    return rows.withColumn("print", F.unhex(F.md5(F.col("text").cast("binary"))))


def _equal(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, print, copies, blank, cut, first): one row for all equal rows.

    ``first`` says that no row before has the role and text. The earliest turn of a role and text is one
    aggregate, combined on the map side; it comes back by the whole key, which no two rows share.
    """
    shape = _printed(rows).select(
        "conv_id", "turn", "role", "print",
        (~F.regexp_like("text", F.lit(f"[^{BLANK_CLASS}]"))).alias("blank"),
        (~F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    same = store(shape.groupBy("conv_id", "turn", "role", "print").agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut")), "turns")
    early = same.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("print").alias("p")).agg(F.min(F.struct("turn")).alias("t"))
    early = early.select("c", "r", "p", F.col("t.turn").alias("t"))
    on = _equal("conv_id", "c") & (F.col("role") == F.col("r")) & (F.col("print") == F.col("p")) & _equal("turn", "t")
    return same.join(early, on, "left").select(*same.columns, F.col("p").isNotNull().alias("first"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches as tuples of Python values, each with whether it starts a conversation."""
    last: object = _runs  # no conversation's number
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row[0] != last, row
            last = row[0]


_AUDIT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_LEGAL = {(SYSTEM - 1, USER - 1), (USER - 1, ASSISTANT - 1), (ASSISTANT - 1, USER - 1)}


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its ordered (conv_id, turn, copies, initial, blank, cut, first) rows."""
    out: list[tuple] = []
    own: dict | None = None

    def closed() -> tuple:
        cost, audit = solve(bytes(own["symbols"]))
        gaps = own["top"] - own["low"] + 1 - own["turns"] if own["turns"] else 0
        return (own["id"], gaps, own["blank"], own["duplicate"], own["truncated"], own["illegal"], cost, audit)

    for fresh, (conv_id, turn, copies, initial, blank, cut, first) in _runs(batches):
        if fresh:
            if own is not None:
                out.append(closed())
            own = {"id": conv_id, "symbols": bytearray(), "turns": 0, "low": None, "top": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "initial": None}
        if len(out) >= 4096:
            yield _batch(out)
            out = []
        if not copies:
            continue
        if turn is not None and turn != own["top"]:
            own["turns"], own["top"] = own["turns"] + 1, turn
            own["low"] = turn if own["low"] is None else own["low"]
        if own["initial"] is not None:
            own["illegal"] += (own["initial"], initial) not in _LEGAL
        own["illegal"] += copies - 1
        own["initial"] = initial
        alone = int(first and not blank)
        own["blank"] += copies if blank else 0
        own["duplicate"] += 0 if blank else copies - alone
        own["truncated"] += int(cut and alone)
        if alone:
            own["symbols"].append(initial | (CUT_OFF if cut else 0))
        own["symbols"] += bytes([initial | MUST_GO]) * (copies - alone)
    if own is not None:
        out.append(closed())
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", *(c.split()[0] for c in _AUDIT.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def audits(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation of ``ids`` or ``rows``."""
    letter = F.substring("role", 1, 1)
    initial = F.lit(OTHER)
    for name, code in INITIALS.items():
        initial = F.when(letter == name, code).otherwise(initial)
    marks = ids.select("conv_id").distinct().select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("print"), F.lit(0).cast("bigint").alias("copies"),
        F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(False).alias("first"),
    )
    ordered = faults(rows).withColumn("turn", F.col("turn").cast("bigint")).unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "print")
    ready = ordered.select("conv_id", "turn", "copies", initial.alias("initial"), "blank", "cut", "first")
    kind = ready.schema["conv_id"].dataType.simpleString()
    return ready.mapInArrow(_audited, f"conv_id {kind}, {_AUDIT}")


# ---- repaired conversations ----------------------------------------------------------------


def _beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of each conversation in order, its audit before them, within the task that holds it."""
    texts = _printed(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), F.col("turn").cast("bigint").alias("turn"), "role", "print", "text")
    heads = found.select("conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("print", "binary"), ("text", "string"))])
    both = texts.unionByName(heads).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "print").select("conv_id", "audit", "role", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, position, role, text) of the repaired rows; position 0 with a null role opens each conversation."""
    letters, at, position, state = "", 0, 0, START

    def put_in(conv_id) -> Iterator[tuple]:
        nonlocal at, position, state
        while at < len(letters) and letters[at] == "I":
            at, position, state = at + 1, position + 1, FITTING[state]
            yield conv_id, position, ROLE[state], ""

    for _, (conv_id, audit, role, text) in _runs(batches):
        if audit is not None:
            letters, at, position, state = audit, 0, 0, START
            yield conv_id, 0, None, None
            yield from put_in(conv_id)
            continue
        letter, at = letters[at], at + 1
        if letter != "D":
            position += 1
            if letter == "K":
                state = kept_state(state, INITIALS[role[0]])
            else:
                state = FITTING[state]
                role = ROLE[state]
            yield conv_id, position, role, text
        yield from put_in(conv_id)


def _row_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in _edited(batches):
        if row[1]:
            out.append(row)
            size += len(row[3])
        if len(out) >= 4096 or size > 1 << 22:
            yield _rows(out)
            out, size = [], 0
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["conv_id", "position", "role", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, digests, own = [], [], None
    for conv_id, position, role, text in _edited(batches):
        if position == 0:
            if own is not None:
                digests.append(own.hexdigest())
            ids.append(conv_id)
            own = hashlib.sha256()
        else:
            own.update((("\n" if position > 1 else "") + role + ":" + text).encode())
        if len(ids) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(ids[:-1]), pa.array(digests)], names=["conv_id", "repaired_sha256"])
            ids, digests = ids[-1:], []
    if own is not None:
        digests.append(own.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(digests)], names=["conv_id", "repaired_sha256"])


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations, positions from 1, by the audits ``found``."""
    return _beside(rows, found).mapInArrow(_row_batches, f"conv_id {_kind(rows)}, position bigint, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): hash of each repaired conversation as ``role:text`` lines, for every audit."""
    return _beside(rows, found).mapInArrow(_digests, f"conv_id {_kind(rows)}, repaired_sha256 string")


def check(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The damaged rows of a (conv_id, turn, role, text) table and the audit of each of its conversations.

    Rows go by turn (nulls first), then role, then the MD5 of the text; the conversation with a null number is one like any other. Null
    roles and texts are one space, so such a row is blank or has a role that must change. Equal rows of one turn are
    repeats. A conversation without rows after the damage has zeros and an empty audit. Other columns, whatever their
    names, don't matter; an empty table gives empty results. Both results are stored.
    """
    rows = store(damage(turns), "damaged")
    return rows, store(audits(rows, turns), "audits")
