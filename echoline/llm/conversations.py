"""Repair of damaged conversations: distinct role/fault signatures are solved once, their edits replayed on the texts.

A conversation's rows become one letter each: its role's initial (``s``, ``u``, ``a``, ``x`` for others), upper case if the
row is truncated, ``-`` if it is blank or a duplicate and must go. Few signatures are distinct, so each is solved once by a
memoised recursion over (row, what stands last) and its audit is joined back; a common signature is dealt over tasks. The
replay streams a conversation's rows in order beside its audit and hashes as it goes, without holding texts.

Cases: nulls count as one space, in the damage key, as a role and as a text; null turns come first; rows of a turn stand
by role, then by the SHA-256 of their text; repeated rows are duplicates; a null conv_id is a conversation of its own; one
that loses all rows gives zeros, an empty audit and the hash of nothing; an empty table gives no rows; other columns are
ignored. A conversation's audit is one value and its rows meet in one sort, which spills: a task needs room for one
letter a row, not for the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from echoline.llm.common import spread
from echoline.session import stored

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: What stands last after a row of a role is kept, by (what stood last, letter); and after the next user or assistant row.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone) after the damage that crc32 of ``conv_id:turn`` decides; dropped rows stay, marked."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("gone"))


def signatures(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``damaged`` rows: conv_id, gaps, blank, duplicate, truncated, illegal, signature.

    Texts don't travel, their digests do; both windows and the aggregate share one exchange by conv_id.
    """
    letter, rest = F.substring("role", 1, 1), F.rtrim("text", F.lit(SPACES))
    slim = rows.select(
        "conv_id", "turn", "role", "copy", "gone", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), letter.alias("initial"),
        (rest == "").alias("blank"), (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    line = Window.partitionBy("conv_id").orderBy("gone", F.col("turn").asc_nulls_first(), "role", "digest", "copy")
    same = Window.partitionBy("conv_id", "role", "digest").orderBy("at")
    here = ~F.col("gone")
    out = slim.withColumns({"at": F.row_number().over(line), "before": F.lag("initial").over(line), "turn_before": F.lag("turn").over(line)})
    out = out.withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    own = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(own)).otherwise(own)
    out = out.withColumn("fault", fault).withColumn("code", code)
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    turn = F.when(here, F.col("turn"))
    fresh = here & F.col("turn").isNotNull() & ((F.col("at") == 1) | ~F.col("turn").eqNullSafe(F.col("turn_before")))
    line_of = F.array_sort(F.collect_list(F.when(here, F.struct("at", "code"))))
    return out.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if(fresh), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(here & (F.col("fault") == x)).alias(x) for x in ("blank", "duplicate", "truncated")),
        F.count_if(here & (F.col("at") > 1) & ~legal).alias("illegal"),
        F.array_join(F.transform(line_of, lambda x: x["code"]), "").alias("signature"),
    )


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that make the roles ``(s?(ua)+)?``; of equally cheap ones the ASCII-least audit.

    The cost from a row on depends only on what stands last, so the recursion is memoised; it is asked from the back
    first, which keeps it shallow however long the signature is. Two inserts at a place are the most that can help.
    """
    n = len(signature)
    memo = np.full((n + 1) * 4, -1, np.int64)
    far = 1 << 40

    def edits(i: int, last: int):
        """(initial, cost, what stands last) of the edits of row i, by initial."""
        letter = signature[i]
        yield "D", DELETE, last
        if letter != "-":
            extra = TRUNCATED if letter.isupper() else 0
            kept = KEPT.get((last, letter.lower()))
            if kept is not None:
                yield "K", KEEP + extra, kept
            yield "R", REROLE + extra, NEXT[last]

    def plain(i: int, last: int) -> int:
        if i == n:
            return 0 if last in (START, ASSISTANT) else far
        return min(cost + best(i + 1, after) for _, cost, after in edits(i, last))

    def best(i: int, last: int) -> int:
        known = int(memo[4 * i + last])
        if known < 0:
            once = NEXT[last]
            known = min(plain(i, last), INSERT + plain(i, once), 2 * INSERT + plain(i, NEXT[once]))
            memo[4 * i + last] = known
        return known

    for i in range(n, -1, -64):
        for last in range(4):
            best(i, last)
    audit, i, last = [], 0, START
    while i < n or last not in (START, ASSISTANT):
        left, found = best(i, last), None
        inserts = [("I", INSERT, NEXT[last])]
        options = sorted([*edits(i, last), *inserts]) if i < n else inserts
        for initial, cost, after in options:
            if cost + best(i if initial == "I" else i + 1, after) == left:
                found = initial, after
                break
        audit.append(found[0])
        i, last = i + (found[0] != "I"), found[1]
    return best(0, START), "".join(audit)


def solved(distinct: DataFrame) -> DataFrame:
    """Add cost and audit to rows of distinct signatures."""

    def run(batches):
        for b in batches:
            found = [solve(s) for s in b.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], [*b.schema.names, "cost", "audit"])

    return distinct.select("signature", "n").mapInArrow(run, "signature string, n long, cost long, audit string")


class Replay:
    """Edits of one conversation, row by row; ``told`` is what to hash, piece by piece."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last, self.digest, self.first = audit, 0, START, hashlib.sha256(), True

    def _say(self, role: str, text: str, last: int) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first, self.last = False, last

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._say(NAMES[NEXT[self.last]], "", NEXT[self.last])
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._say(role, text, KEPT[self.last, role[:1]])
        elif edit == "R":
            self._say(NAMES[NEXT[self.last]], text, NEXT[self.last])

    def end(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` (one row per conversation) with repaired_sha256: rows of a conversation follow its audit in one sorted exchange."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    body = rows.filter("not gone").select("conv_id", F.lit(1).alias("part"), "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "copy", "text")
    head = audits.select("conv_id", F.lit(0).alias("part"), "audit", *FOUND)
    both = head.unionByName(body, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "digest", "copy").drop("turn", "digest", "copy")
    schema = f"conv_id {kind}, {', '.join(f'{x} long' for x in FOUND)}, audit string, repaired_sha256 string"
    names = ["conv_id", *FOUND, "audit", "repaired_sha256"]

    def run(batches):
        held, now = [], None
        for b in batches:
            heads = b.column("part").to_pylist()
            own = b.select(["conv_id", *FOUND, "audit"]).to_pylist() if 0 in heads else None
            for i, (part, role, text) in enumerate(zip(heads, b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)):
                if part == 0:
                    if now is not None:
                        held.append({**now[0], "repaired_sha256": now[1].end()})
                    now = own[i], Replay(own[i]["audit"])
                else:
                    now[1].row(role, text)
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, target)
                held = []
        if now is not None:
            held.append({**now[0], "repaired_sha256": now[1].end()})
        if held:
            yield pa.RecordBatch.from_pylist(held, target)

    target = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.mapInArrow(run, schema).select(names)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text) after the damage: its faults, cheapest edits and the repaired hash."""
    hurt = damaged(rows)
    convs = stored(signatures(hurt), "conv-signatures")
    distinct = convs.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    answers = stored(solved(distinct), "conv-audits")
    audits = spread(convs, answers, "signature", "n", "conv_id")
    return replayed(hurt, audits)
