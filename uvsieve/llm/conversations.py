"""Repair of conversations by lightest derivations.

A conversation's roles must read: perhaps a system turn, then user and assistant in turn, ending with an assistant; or nothing. Items say
that so many rows have been dealt with and which role stands last. An edit deduces one item from another, and a stretch's items from
those of its two halves; a derivation weighs its edits' costs, and its audit is their initials in order. Weights are pairs (cost, audit): to add an edit never makes
one lighter, and keeps the order of two that lead to the same item (of equal cost, neither audit begins with the other: more letters over the
same rows are inserts, which cost). So the agenda may pop items lightest first, and the first time an item is popped its weight is final.

Rows are sorted over the cluster by conversation and place. A conversation that crosses partitions is derived in pieces, each from all four roles that may
stand before it, and the pieces' weights are joined; no more than its audit meets in one task. Repaired texts stream by, a row at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: White space of the faults' definitions.
WHITE = " \t\n\x0b\x0c\r"
#: Costs of edits; a truncated row that stays costs ``LEFT_CUT`` more.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
LEFT_CUT = 3
#: What stands last: nothing, a system, a user or an assistant turn. Nothing and an assistant turn may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: A row is one letter: its role's initial, or o for others; in capitals if truncated; a digit if it has to go.
FOLLOWS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
LEGAL = ("su", "ua", "au")
#: Rows of one stretch that the agenda takes edit by edit; longer stretches are joined from halves.
STRETCH = 64
Weight = tuple[int, str]
Table = tuple[dict[int, Weight], ...]  # for each role that may stand before, the roles that may stand last and their weights


def lightest(axiom: Hashable, deductions: Callable[[Hashable], list[tuple[int, str, Hashable]]]) -> dict[Hashable, Weight]:
    """The lightest weight of every item that can be deduced from ``axiom``; ``deductions`` gives the costs, letters and items that follow from one."""
    agenda, final = [(0, "", axiom)], {}
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit)
        for more, letters, following in deductions(item):
            if following not in final:
                heapq.heappush(agenda, (cost + more, audit + letters, following))
    return final


def edits(rows: str, item: tuple[int, int]) -> list[tuple[int, str, tuple[int, int]]]:
    """What an edit deduces from an item (rows dealt with, role last)."""
    at, last = item
    turn = ASSISTANT if last == USER else USER  # the one role that can be made to follow
    out = [(COSTS["I"], "I", (at, turn))]
    if at < len(rows):
        row = rows[at]
        out.append((COSTS["D"], "D", (at + 1, last)))
        if not row.isdigit():
            cut = LEFT_CUT if row.isupper() else 0
            out.append((COSTS["R"] + cut, "R", (at + 1, turn)))
            if last in (kept := FOLLOWS[row.lower()]):
                out.append((COSTS["K"] + cut, "K", (at + 1, kept[last])))
    return out


@lru_cache(maxsize=50_000)
def stretch(rows: str, before: int) -> dict[int, Weight]:
    """The weights of a short stretch's ends, by the role last."""
    found = lightest((0, before), lambda item: edits(rows, item))
    return {last: weight for (at, last), weight in found.items() if at == len(rows)}


def joined(left: Table, right: Table, before: tuple[int, ...]) -> Table:
    """The table of two stretches one after the other."""

    def deductions(item):
        half, last = item
        return [] if half == 2 else [(*weight, (half + 1, end)) for end, weight in (left, right)[half][last].items()]

    every = [{last: w for (half, last), w in lightest((0, b), deductions).items() if half == 2} if b in before else {} for b in range(4)]
    return tuple(every)


ALL = (NOTHING, SYSTEM, USER, ASSISTANT)


def table(rows: str, before: tuple[int, ...] = ALL) -> Table:
    """The table of rows of any number, from the roles ``before``: halves are joined, so that letters are copied once for each doubling."""
    if len(rows) <= STRETCH:
        return tuple(stretch(rows, b) if b in before else {} for b in ALL)
    half = max(STRETCH, len(rows) // 2 // STRETCH * STRETCH)
    return joined(table(rows[:half], before), table(rows[half:]), before)


def best_end(ends: dict[int, Weight]) -> Weight:
    """The goal: the lightest of the ends that a conversation may have."""
    return min(ends[e] for e in ENDS if e in ends)


def illegal_pairs(initials: str) -> int:
    return sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of ``rows`` under an audit; rows are taken as they come."""
    last = NOTHING
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            last = FOLLOWS[role[:1]][last]
        else:
            last = ASSISTANT if last == USER else USER
            role = "assistant" if last == ASSISTANT else "user"
        yield role, text


# over the cluster

FIRST = {"s": "1", "u": "2", "a": "3", "o": "4"}
LETTERS = str.maketrans({d: c for c, d in FIRST.items()})
GONE = str.maketrans("234", "111")  # what has to go is alike
ORDER = ("conv_id", "turn", "role", "digest", "row_id")
PIECE = "conv_id long, piece int, first string, last string, illegal long, costs array<long>, audits array<string>"
REPORT = ("gaps", "blank", "duplicate", "truncated")
REPAIRED = "conv_id long, place long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with row_id, digest, blank and truncated, written to the shared folder, so that row numbers stand still."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    given = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")
    )
    marked = given.withColumn("digest", digest).withColumn("blank", bare == "").withColumn("truncated", ~F.substring(bare, -1, 1).isin(".", "!", "?"))
    return written(marked.withColumn("row_id", F.monotonically_increasing_id()))


def _lettered(rows: DataFrame) -> DataFrame:
    """Narrow rows with whether they are duplicates, and their letter. The first row of each role and text is found by an aggregate and told by its number, so no group is dealt out."""
    narrow = rows.select(*ORDER, "blank", "truncated")
    first = narrow.groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "row_id"))["row_id"].alias("row_id")).select("row_id", F.lit(True).alias("_first"))
    known = narrow.join(first, "row_id", "left").withColumn("duplicate", ~F.col("blank") & F.col("_first").isNull())
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    gone, cut = F.col("blank") | F.col("duplicate"), F.col("truncated")
    letter = F.when(gone, F.translate(initial, "suao", "1234")).when(cut, F.upper(initial)).otherwise(initial)
    return known.select(*ORDER, "blank", "duplicate", (cut & ~gone).alias("truncated"), letter.alias("letter"))


def _runs(batch: pa.RecordBatch) -> list[tuple[int | None, int, int]]:
    """(conv_id, from, to) of runs of equal conv_id."""
    ids = batch.column("conv_id").to_pylist()
    at = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
    return [(ids[a], a, b) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's conversations as pieces; the first and the last may go on in other partitions, and are derived from all roles."""
    done: list[tuple[int | None, str, bool]] = []
    open_id, parts, count = None, [], 0
    number = TaskContext.get().partitionId()

    def piece(conv: int | None, letters: str, edge: bool) -> dict:
        rows = letters.translate(GONE)
        found = table(rows, ALL if edge else (NOTHING,))
        flat = [found[b].get(e) for b in ALL for e in ALL]
        initials = letters.translate(LETTERS).lower()
        return {"conv_id": conv, "piece": number, "first": initials[0], "last": initials[-1], "illegal": illegal_pairs(initials), "costs": [w and w[0] for w in flat], "audits": [w and w[1] for w in flat]}

    def given(pieces: list) -> pa.RecordBatch:
        schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
        return pa.RecordBatch.from_pylist([piece(*p) for p in pieces], schema)

    for batch in batches:
        letters = "".join(batch.column("letter").to_pylist())
        for conv, a, b in _runs(batch):
            if parts and conv != open_id:
                done.append((open_id, "".join(parts), count == 0))
                parts, count = [], count + 1
            open_id = conv
            parts.append(letters[a:b])
        if len(done) > 1000:
            yield given(done)
            done = []
    if parts:
        done.append((open_id, "".join(parts), True))
    if done:
        yield given(done)


def _merged(pieces: list[dict]) -> tuple[int, int, str]:
    """Illegal pairs, cost and audit of a conversation's pieces in order."""
    if not pieces:
        return 0, 0, ""
    illegal = sum(p["illegal"] for p in pieces) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(pieces[:-1], pieces[1:], strict=True))
    tables = [tuple({e: (p["costs"][4 * b + e], p["audits"][4 * b + e]) for e in ALL if p["costs"][4 * b + e] is not None} for b in ALL) for p in pieces]
    while len(tables) > 1:
        tables = [joined(tables[k], tables[k + 1], ALL) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    return illegal, *best_end(tables[0][NOTHING])


#: Rows of one output batch.
OUT = 2000


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and kind: its report, its pieces, its rows. Texts stream by."""
    names = [part.strip().split(" ")[0] for part in REPAIRED.split(",")]
    schema = pa.schema([(n, pa.string() if n in ("role", "text", "audit") else pa.int64()) for n in names])
    out: list[dict] = []

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def conversations() -> Iterator[tuple[dict, list[dict], Iterator[tuple[str, str]]]]:
        stream = rows()
        row = next(stream, None)
        while row is not None:
            head, pieces = row, []
            row = next(stream, None)
            while row is not None and row["kind"] == 1:
                pieces.append(row)
                row = next(stream, None)

            def own() -> Iterator[tuple[str, str]]:
                nonlocal row
                while row is not None and row["kind"] == 2:
                    yield row["role"], row["text"]
                    row = next(stream, None)

            texts = own()
            yield head, pieces, texts
            for _ in texts:  # rows that are left, of which the last edits made nothing
                pass

    for head, pieces, texts in conversations():
        illegal, cost, audit = _merged(pieces)
        out.append({"conv_id": head["conv_id"], "place": 0, **{n: head[n] for n in REPORT}, "illegal": illegal, "cost": cost, "audit": audit})
        for place, (role, text) in enumerate(edited(audit, texts), 1):
            out.append({"conv_id": head["conv_id"], "place": place, "role": role, "text": text})
            if len(out) >= OUT:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The conversations of ``rows(conv_id, turn, role, text)`` repaired: for each a row of place 0 with its report (gaps, blank, duplicate, truncated, illegal, cost, audit), and behind it in the
    same partition, in order of place, its repaired turns (place, role, text).

    ``ids(conv_id)``: conversations to report even if they have no rows. A null role or text is one blank; rows without conv_id are one conversation; rows without turn come first; rows of one turn are ordered by role and by a
    digest of the text. A conversation may have any number of rows, and texts any length. Repeated rows are duplicates, of which one stays. Other columns are not read. An empty table gives an empty one.
    Texts are shuffled once, by conversation: a text's repaired rows have to follow each other.
    """
    kept = faults(rows)
    lettered = written(_lettered(kept))
    every = lettered.select("conv_id", "turn", "blank", "duplicate", "truncated")
    if ids is not None:
        every = every.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), allowMissingColumns=True)
    wide = lambda c: c.cast("decimal(20,0)")
    gaps = (wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn"))).try_cast("long")
    heads = every.groupBy("conv_id").agg(F.when(F.count("turn") == 0, F.lit(0).cast("long")).otherwise(gaps).alias("gaps"), *[F.count_if(F.coalesce(n, F.lit(False))).alias(n) for n in REPORT[1:]])
    pieces = lettered.select(*ORDER, "letter").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("conv_id", "letter").mapInArrow(_pieces, PIECE)
    kinds = [heads.withColumn("kind", F.lit(0)), pieces.withColumn("kind", F.lit(1)), kept.select(*ORDER, "text").withColumn("kind", F.lit(2))]
    together = kinds[0].unionByName(kinds[1], allowMissingColumns=True).unionByName(kinds[2], allowMissingColumns=True)
    dealt = together.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "piece", *ORDER[1:]).drop("turn", "digest", "row_id", "piece")
    return dealt.mapInArrow(_repaired, REPAIRED)


def summarised(repaired: DataFrame) -> DataFrame:
    """A row for each conversation of what ``repair_conversations`` returns: its report and ``repaired_sha256``, of its turns as ``role:text`` with line feeds between. Turns stream by; none is held."""
    names = ["conv_id", *REPORT, "illegal", "cost", "audit", "repaired_sha256"]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, hashed, done = None, hashlib.sha256(), []
        for batch in batches:
            for row in batch.to_pylist():
                if row["place"] == 0:
                    if head is not None:
                        done.append(head | {"repaired_sha256": hashed.hexdigest()})
                    head, hashed = {n: row[n] for n in names[:-1]}, hashlib.sha256()
                else:
                    hashed.update(f"{'' if row['place'] == 1 else chr(10)}{row['role']}:{row['text']}".encode())
            if len(done) >= OUT:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if head is not None:
            done.append(head | {"repaired_sha256": hashed.hexdigest()})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    kinds = ", ".join(f"{n} {'string' if n in ('audit', 'repaired_sha256') else 'long'}" for n in names)
    return repaired.mapInArrow(run, kinds)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults, one row in four: by the crc32 of ``conv_id:turn`` modulo 20 a row goes (0), loses its text (1) or its stops (2), is repeated (3), or is given to the user (4). A null of any column is one blank first."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    given = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("_fault")).where(F.col("_fault") != 0)
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")
