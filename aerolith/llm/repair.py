"""Conversation structure repair: cheapest edits by Hirschberg's divide and conquer over four-state cost vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.common import SPACES, free, staged, table

#: States of role initials read so far: none, s, ends in u, ends in a. None and ends in a may be the end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, BROKEN, GONE = range(3)
#: Cost and letters that lead from a state to an end.
CLOSE = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
FAR = 1 << 60
#: Rows and characters of a piece of a conversation; longer ones are repaired piece by piece.
PIECE, PIECE_CHARS = 4096, 1 << 22
NAMES = {"u": "user", "a": "assistant"}
LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


def _other(state: int) -> str:
    """The one role that an edit can add after a state."""
    return "a" if state == USER else "u"


def _moves(fault: int, initial: str) -> list[list[tuple[int, str]]]:
    """[from][to]: least (cost, letters) that read one row, inserts before it included."""
    out = [[(FAR, "")] * 4 for _ in range(4)]
    for start, before in product(range(4), range(3)):
        s = start
        for _ in range(before):
            s = STEP[s, _other(s)]
        more = TRUNCATED if fault == BROKEN else 0
        found = [(s, DELETE, "D")]
        if fault != GONE:
            found.append((STEP[s, _other(s)], REROLE + more, "R"))
            if (s, initial) in STEP:
                found.append((STEP[s, initial], more, "K"))
        for end, cost, letter in found:
            out[start][end] = min(out[start][end], (cost + INSERT * before, "I" * before + letter))
    return out


#: By a row's kind: 4 * fault + place of the initial in s, u, a, anything else.
INITIALS = "sua"
MOVES = [_moves(fault, i) for fault in (FINE, BROKEN, GONE) for i in (*INITIALS, "")]
#: The same as lists of (from, cost, letters) by to; and of (to, cost) by from.
INTO = [[[(s, *m[s][t]) for s in range(4) if m[s][t][0] < FAR] for t in range(4)] for m in MOVES]
OUT = [[[(t, m[s][t][0]) for t in range(4) if m[s][t][0] < FAR] for s in range(4)] for m in MOVES]


def kind(fault: int, role: str) -> int:
    place = INITIALS.find(role[0]) if role else -1
    return 4 * fault + (place if place >= 0 else 3)


def forward(kinds: bytes, start: int) -> tuple[list[int], list[int]]:
    """Cost of each state after kinds, and its rank: the ASCII order of the least letters that lead there at that cost.

    Letters up to a row end with that row's own letter, so none of two different ones begins with the other, and what
    comes after never changes their order. So ranks of four states are all that ties need.
    """
    cost, rank = [FAR] * 4, [0] * 4
    cost[start] = 0
    for k in kinds:
        into, new, via = INTO[k], [FAR] * 4, [(9, "")] * 4
        for t in range(4):
            best, by = FAR, (9, "")
            for s, c, letters in into[t]:
                c += cost[s]
                if c < best or c == best and c < FAR and (rank[s], letters) < by:
                    best, by = c, (rank[s], letters)
            new[t], via[t] = best, by
        cost = new
        order = sorted(set(via))
        rank = [order.index(x) for x in via]
    return cost, rank


def backward(kinds: bytes, end: int) -> list[int]:
    """Cost of reaching end by kinds from each state."""
    cost = [FAR] * 4
    cost[end] = 0
    for k in reversed(kinds):
        out = OUT[k]
        cost = [min([FAR, *(c + cost[t] for t, c in out[s])]) for s in range(4)]
    return cost


def between(kinds: bytes, start: int, end: int) -> str:
    """Least letters of least cost from start to end: both vectors meet in the middle, the crossing of least rank is kept, halves follow."""
    if len(kinds) < 2:
        return MOVES[kinds[0]][start][end][1] if kinds else ""
    half = len(kinds) // 2
    cost, rank = forward(kinds[:half], start)
    rest = backward(kinds[half:], end)
    _, _, middle = min((cost[s] + rest[s], rank[s], s) for s in range(4))
    return between(kinds[:half], start, middle) + between(kinds[half:], middle, end)


def closing(cost: list[int], rank: list[int]) -> tuple[int, int]:
    """Whole cost and the state before the closing inserts."""
    whole, _, state = min((cost[s] + CLOSE[s][0], rank[s], s) for s in range(4))
    return whole, state


@lru_cache(1 << 16)
def whole(kinds: bytes) -> tuple[int, str]:
    cost, state = closing(*forward(kinds, NONE))
    return cost, between(kinds, NONE, state) + CLOSE[state][1]


def summary(kinds: bytes) -> list[int]:
    """A piece as seen from outside: for each state before it, cost and rank of each state after it."""
    return [x for s in range(4) for part in forward(kinds, s) for x in part]


def crossings(pieces: list[list[int]]) -> tuple[int, list[int]]:
    """Whole cost and the state after each piece, from summaries: the same divide and conquer, with a piece as a row."""

    def onward(xs: list[list[int]], start: int) -> tuple[list[int], list[int]]:
        cost, rank = [FAR] * 4, [0] * 4
        cost[start] = 0
        for x in xs:
            via = [min((cost[s] + x[8 * s + t], rank[s], x[8 * s + 4 + t]) if cost[s] < FAR and x[8 * s + t] < FAR else (FAR, 9, 9) for s in range(4)) for t in range(4)]
            order = sorted({v[1:] for v in via})
            cost, rank = [v[0] for v in via], [order.index(v[1:]) for v in via]
        return cost, rank

    def back(xs: list[list[int]], end: int) -> list[int]:
        cost = [FAR] * 4
        cost[end] = 0
        for x in reversed(xs):
            cost = [min([FAR, *(x[8 * s + t] + cost[t] for t in range(4))]) for s in range(4)]
        return cost

    total, last = closing(*onward(pieces, NONE))
    found: dict[int, int] = {}
    todo = [(0, len(pieces), NONE, last)]
    while todo:
        low, high, start, end = todo.pop()
        found[high] = end
        if high - low > 1:
            half = (low + high) // 2
            cost, rank = onward(pieces[low:half], start)
            rest = back(pieces[half:high], end)
            middle = min((cost[s] + rest[s], rank[s], s) for s in range(4))[2]
            todo += [(low, half, start, middle), (half, high, middle, end)]
    return total, [found[k + 1] for k in range(len(pieces))]


def edited(roles: list[str], texts: list[str], letters: str, state: int) -> list[tuple[str, str]]:
    """Role and text of each turn that letters leave, from a state."""
    out, k = [], 0
    for x in letters:
        if x != "D":
            role = roles[k] if x == "K" else NAMES[_other(state)]
            out.append((role, "" if x == "I" else texts[k]))
            state = STEP[state, role[0]]
        k += x != "I"
    return out


def identity(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def faults(roles: list[str], texts: list[str], earlier: set[bytes] = frozenset()) -> tuple[bytes, list[int]]:
    """Kinds of rows, and how many are blank, duplicate, truncated. earlier: identities of rows before these."""
    kinds, n, seen = bytearray(), [0, 0, 0], set()
    for role, text in zip(roles, texts, strict=True):
        fault, me = FINE, (role, text)
        if not text.strip(SPACES):
            fault, n[0] = GONE, n[0] + 1
        elif me in seen or earlier and identity(role, text) in earlier:
            fault, n[1] = GONE, n[1] + 1
        elif LAST.search(text)[0] not in ".!?":
            fault, n[2] = BROKEN, n[2] + 1
        seen.add(me)
        kinds.append(kind(fault, role))
    return bytes(kinds), n


LEGAL = {"su", "ua", "au"}
_PIECE = "part int, seq int, whole boolean, roles array<string>, texts array<string>, turns array<long>"


def pieces(conversations: DataFrame) -> DataFrame:
    """Rows of each conversation in order, cut into bounded pieces: conv_id, part, seq (order of pieces), whole, roles, texts, turns.

    Rows are dealt by range, so a conversation of any size is spread over tasks. whole: the piece surely is all of its conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    # Rows equal in all of these are alike; the last key lets even those be dealt to several tasks.
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "__at"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).drop("__at")
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(_PIECE).fields])
    most, most_chars = PIECE, PIECE_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, held, chars, seq, inside, part = None, None, 0, 0, False, 0

        def close(ended: bool) -> None:
            nonlocal held, chars, seq
            if held:
                out.append((key, part, seq, inside and ended, *held))
                seq += 1
            held, chars = None, 0

        def rows_out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], schema.names)
            out.clear()
            return batch

        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())]
            for conv, turn, role, said, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv != key:
                    close(True)
                    inside = True
                elif held and (len(held[0]) >= most or chars >= most_chars):
                    close(False)
                    inside = False
                if held is None:
                    key, held = conv, ([], [], [])
                held[0].append(role)
                held[1].append(said)
                held[2].append(turn)
                chars += len(said)
            if out:
                yield rows_out()
        close(False)
        if out:
            yield rows_out()

    return staged(rows.mapInArrow(run, schema), "pieces")


_DONE = "part int, seq int, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _solved(found: DataFrame, letters_of) -> DataFrame:
    """found (conv_id, part, seq, roles, texts, turns, more) with each piece's counts, cost, letters and turns. letters_of(kinds, more): cost, letters, state before."""
    schema = T.StructType([found.schema["conv_id"], *T._parse_datatype_string(_DONE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.struct([("role", pa.string()), ("text", pa.string())])
        types = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(turn)]
        for batch in batches:
            for k in range(batch.num_rows):  # a piece may hold megabytes
                row = batch.slice(k, 1)
                part, seq, roles, texts, turns, more, earlier = (c[0].as_py() for c in row.columns[1:])
                kinds, n = faults(roles, texts, frozenset(earlier or ()))
                cost, letters, state = letters_of(kinds, more)
                initials = [r[:1] for r in roles]
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
                known = [x for x in turns if x is not None]
                new = [{"role": r, "text": x} for r, x in edited(roles, texts, letters, state)]
                values = (part, seq, *n, illegal, len(set(known)), min(known, default=None), max(known, default=None), initials[0], initials[-1], cost, letters, new)
                yield pa.RecordBatch.from_arrays([row.column(0), *(pa.array([v], t) for v, t in zip(values, types, strict=True))], schema.names)

    return found.mapInArrow(run, schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, part, seq, counts of faults, cost, audit and repaired (array of role, text) for each piece of each conversation.

    A conversation is one piece, but for long ones and those at the edge of a task; its pieces follow one another by
    (part, seq), its audit and its turns are theirs one after another. A row is blank (no character but ASCII space),
    else duplicate (role and text are those of an earlier row), else truncated (the last character that isn't space is
    not one of .!?). Edits: Keep, Rerole (1), Delete (2, a must for blank and duplicate rows), Insert an empty turn (5);
    a truncated row that stays costs 5 more. The result has roles s?(ua)+ by their initials, or is empty; among the
    cheapest edits the ones whose letters come first in ASCII order are taken.

    Rows go by turn (null first), then role, then text; equal rows are rows of their own, so the later ones are
    duplicates. A null role or text is one space: such a text is blank, such a role, like the empty one, fits nowhere and
    is rerolled or deleted. A null conv_id is a conversation. An empty table gives an empty one; columns of other names
    are not read; a text of any length is one row's work, a conversation of any length is spread over tasks.
    """
    cut = pieces(conversations)
    blank = F.lit(None).cast("array<binary>")
    simple = cut.where("whole").select("conv_id", "part", "seq", "roles", "texts", "turns", F.lit(None).cast("array<long>").alias("more"), blank.alias("earlier"))
    done = _solved(simple, lambda kinds, _: (*whole(kinds), NONE))

    split = cut.where("not whole")
    before = _earlier(split)
    key = [F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")), F.col("x.part") == F.col("y.part"), F.col("x.seq") == F.col("y.seq")]
    of = lambda x, y: x.alias("x").join(y.alias("y"), key, "left")
    known = staged(of(split, before).select("x.*", "y.earlier"), "split")
    places = _crossed(known)
    found = of(known, places).select("x.conv_id", "x.part", "x.seq", "x.roles", "x.texts", "x.turns", "y.more", "x.earlier")

    def letters_of(kinds: bytes, more: list[int]) -> tuple[int, str, int]:
        cost, start, end, last = more
        return cost, between(kinds, start, end) + (CLOSE[end][1] if last else ""), start

    return done.unionByName(_solved(found, letters_of))


def _earlier(split: DataFrame) -> DataFrame:
    """conv_id, part, seq, earlier: identities of the piece's rows that an earlier piece has. Each piece says a row once, so a frequent one is few rows here."""
    schema = T.StructType([*split.select("conv_id", "part", "seq").schema.fields, T.StructField("id", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                roles, texts = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
                ids = sorted({identity(r, t) for r, t in zip(roles, texts, strict=True)})
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([c.slice(k, 1)] * len(ids)) for c in batch.columns[:3]), pa.array(ids, pa.binary())], schema.names)

    ids = split.select("conv_id", "part", "seq", "roles", "texts").mapInArrow(run, schema)
    place = F.struct("part", "seq")
    first = ids.groupBy("conv_id", "id").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = ids.alias("x").join(first.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")) & (F.col("x.id") == F.col("y.id")))
    later = later.where(F.struct("x.part", "x.seq") > F.col("y.first"))
    return later.groupBy("x.conv_id", "x.part", "x.seq").agg(F.collect_list("x.id").alias("earlier"))


def _crossed(known: DataFrame) -> DataFrame:
    """conv_id, part, seq, more: cost (the whole conversation's at its first piece, else 0), state before, state after, 1 at the last piece.

    What travels is a piece's summary, 32 numbers for up to PIECE rows.
    """
    some = T.StructType([*known.select("conv_id", "part", "seq").schema.fields, T.StructField("x", T.ArrayType(T.LongType()))])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = []
            for k in range(batch.num_rows):
                roles, texts, earlier = (batch.column(c)[k].as_py() for c in (3, 4, 5))
                xs.append(summary(faults(roles, texts, frozenset(earlier or ()))[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(xs, pa.list_(pa.int64()))], some.names)

    xs = known.select("conv_id", "part", "seq", "roles", "texts", "earlier").mapInArrow(summed, some)
    listed = xs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "x"))).alias("xs"))
    place = "array<struct<part:int,seq:int,more:array<bigint>>>"
    schema = T.StructType([known.schema["conv_id"], T.StructField("places", T._parse_datatype_string(place))])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("more", pa.list_(pa.int64()))]))
        for batch in batches:
            out = []
            for ps in batch.column(1).to_pylist():
                cost, ends = crossings([p["x"] for p in ps])
                starts = [NONE, *ends[:-1]]
                out.append([{"part": p["part"], "seq": p["seq"], "more": [0 if k else cost, starts[k], ends[k], int(k == len(ps) - 1)]} for k, p in enumerate(ps)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind_of)], schema.names)

    return listed.mapInArrow(crossed, schema).select("conv_id", F.inline("places"))


_AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audits(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of role:text, newline-joined).

    Pieces of a conversation come to one task in order and pass through it one at a time. What repaired() says of odd rows holds here.
    """
    done = staged(repaired(conversations), "repaired")
    ordered = done.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    schema = T.StructType([done.schema["conv_id"], *T._parse_datatype_string(_AUDIT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None

        def result() -> tuple:
            gaps = state["high"] - state["low"] + 1 - state["turns"] if state["high"] is not None else 0
            return (key[0], gaps, *state["n"], state["cost"], "".join(state["audit"]), state["sha"].hexdigest())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], schema.names)

        for batch in batches:
            conv_type, rows = batch.schema.field(0).type, []
            for k in range(batch.num_rows):
                conv, _, _, *n, turns, low, high, first, last, cost, audit, new = (c[k].as_py() for c in batch.columns)
                if key is None or key[0] != conv:
                    if key is not None:
                        rows.append(result())
                    key = (conv,)
                    state = {"n": [0] * 4, "turns": 0, "low": None, "high": None, "last": None, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False}
                state["n"] = [a + b for a, b in zip(state["n"], n, strict=True)]
                state["n"][3] += state["last"] is not None and state["last"] + first not in LEGAL
                state["turns"] += turns - (low is not None and low == state["high"])
                state["low"] = low if state["low"] is None else state["low"]
                state["high"] = high if high is not None else state["high"]
                state["last"], state["cost"] = last, state["cost"] + cost
                state["audit"].append(audit)
                for turn in new:
                    state["sha"].update(f"{chr(10) if state['any'] else ''}{turn['role']}:{turn['text']}".encode())
                    state["any"] = True
            if rows:
                yield out(rows)
        if key is not None:
            yield out([result()])

    return ordered.mapInArrow(run, schema)


def turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, turn (from 0 in a piece of its conversation), part, seq, role, text."""
    return repaired(conversations).select("conv_id", "part", "seq", F.posexplode("repaired").alias("turn", "t")).select("conv_id", "part", "seq", "turn", "t.role", "t.text")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; nulls of role and text are one space. A fifth of the rows is damaged, by CRC-32 of conv_id:turn: dropped, emptied, without .!?, twice, or said by the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = free(conversations, "lot")
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), F.pmod(F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")), F.lit(20)).alias(lot))
    said = F.when(F.col(lot) == 1, "").when(F.col(lot) == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col(lot) == 0, 0).when(F.col(lot) == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col(lot) == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("__")).drop("__")


def query(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = audits(damaged(given)).withColumnRenamed("conv_id", "id")
    every = given.select("conv_id").distinct()
    both = every.join(found, every.conv_id.eqNullSafe(found.id), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def oracle() -> str:
    """Least (cost, letters) from each state, row by row from the last to the first; letters of one cost are compared as text."""
    byte = "list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda b: [ascii(b), 0, 0, 0, 0, 0, 0, 0])"
    crc = f"xor(list_reduce(list_prepend(4294967295, CAST(flatten({byte}) AS BIGINT[])), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"
    after = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
    pair = lambda cost, letters: f"{{'c': {cost}, 'a': {letters}}}"
    read, filled = [], []
    for s in range(4):
        keep = " ".join(f"WHEN '{x}' THEN {pair(f'y{STEP[s, x]}.c + m', f"'K' || y{STEP[s, x]}.a")}" for x in INITIALS if (s, x) in STEP)
        new = pair(f"CASE WHEN f < {GONE} THEN y{after[s]}.c + m + {REROLE} ELSE {FAR} END", f"'R' || y{after[s]}.a")
        read.append(f"list_min([{pair(f'y{s}.c + {DELETE}', f"'D' || y{s}.a")}, {new}, CASE CASE WHEN f < {GONE} THEN r1 END {keep} ELSE {pair(FAR, "''")} END]) AS b{s}")
        one, two = after[s], after[after[s]]
        filled.append(f"list_min([b{s}, {pair(f'b{one}.c + {INSERT}', f"'I' || b{one}.a")}, {pair(f'b{two}.c + {2 * INSERT}', f"'II' || b{two}.a")}]) AS y{s}")
    ends = ", ".join(f"{{'c': CAST({c} AS BIGINT), 'a': '{a}'}} AS y{s}" for s, (c, a) in enumerate(CLOSE))
    space = r"[\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS lot FROM conversations),
h AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE lot WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS k FROM g),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS r1, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    lag(left(role, 1)) OVER w AS r0, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) AS nth
  FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k)),
z AS (SELECT *, NOT regexp_matches(text, '[^{space[1:]}') AS blank, regexp_extract(text, '([^{space[1:]}){space}*\\z', 1) AS final FROM o),
e AS (SELECT *, CASE WHEN blank OR nth > 1 THEN {GONE} WHEN final NOT IN ('.', '!', '?') THEN {BROKEN} ELSE {FINE} END AS f FROM z),
q AS (SELECT *, CASE f WHEN {BROKEN} THEN {TRUNCATED} ELSE 0 END AS m FROM e),
d AS (SELECT DISTINCT conv_id, n AS i, {ends} FROM q
  UNION ALL SELECT conv_id, i - 1, {", ".join(filled)} FROM (SELECT q.conv_id, q.i, {", ".join(read)} FROM d JOIN q ON q.conv_id IS NOT DISTINCT FROM d.conv_id AND q.i = d.i)),
best AS (SELECT conv_id, y0.c AS cost, y0.a AS audit FROM d WHERE i = 0),
l AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM best),
t AS (SELECT conv_id, p, audit[p] AS letter, len(replace(audit[1:p], 'I', '')) AS i, len(replace(audit[1:p], 'D', '')) AS k FROM l),
u AS (SELECT t.conv_id, p, letter, k - max(CASE WHEN k = 1 AND letter = 'K' AND r1 = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS k, role, text
  FROM t LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM t.conv_id AND q.i = t.i WHERE letter <> 'D'),
w AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN k % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM u GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND nth > 1) AS duplicate,
    count(*) FILTER (f = {BROKEN}) AS truncated, count(*) FILTER (r0 || r1 NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""
