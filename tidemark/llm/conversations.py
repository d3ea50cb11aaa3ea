"""Conversation structure repair: the cheapest edits that give a conversation the roles (s?(ua)+)?, audited.

Each row becomes a fact: the initial of its role and its first fault.  Facts, without texts, are dealt by ranges of
(conversation, turn), so that a conversation of any length is cut into segments; a segment gives, for each state in which it
may be entered and each in which it may be left, the least cost and its audit.  Segments of a conversation are then
joined in order.  Texts pass one shuffle, to be written or hashed as the audit says.

Audits are linked nodes (``Audits``): an edit points to the edit before it, so the states of a row share their prefixes.  A
node keeps ancestors at powers of two and a rolling hash of its whole string; of two audits of one cost the ASCII-least
is found at the end of their longest common prefix, by descent over these ancestors.  Equal hashes are
verified character by character up to a shared node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textbatch as tb

#: Rows of a conversation that are summarised at once.
SEGMENT_ROWS = 4096
#: States after some edits: nothing kept yet, after system, after user, after assistant; the last two follow each other.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits: K keeps, R changes the role, D deletes, I inserts; and of a truncated row that stays.
COST, CUT_COST = {"K": 0, "R": 2, "D": 3, "I": 2}, 1
_SPACE = " \t\n\x0b\x0c\r"
_MODULUS, _BASE = (1 << 61) - 1, 911_382_323


class Audits:
    """Audit strings that share their prefixes; node 0 is the empty one."""

    def __init__(self, modulus: int = _MODULUS):
        self.modulus, self.char, self.depth, self.hash, self.up = modulus, [""], [0], [0], [()]

    def add(self, node: int, char: str) -> int:
        """The audit of ``node`` followed by one more edit."""
        above, at, j = [node], node, 0
        while len(self.up[at]) > j:  # the ancestor 2 ** (j + 1) above lies 2 ** j above the one at 2 ** j
            at = self.up[at][j]
            above.append(at)
            j += 1
        self.char.append(char)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(char)) % self.modulus)
        self.up.append(tuple(above))
        return len(self.char) - 1

    def ancestor(self, node: int, depth: int) -> int:
        rest = self.depth[node] - depth
        while rest:
            j = rest.bit_length() - 1
            node, rest = self.up[node][j], rest - (1 << j)
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        """Equal strings of one depth, character by character until they share a node."""
        while a != b:
            if self.char[a] != self.char[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """ASCII order of two audits; a prefix comes before what it begins."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y] and self._same(x, y):
            return self.depth[a] < self.depth[b]
        for j in range(len(self.up[x]) - 1, -1, -1):  # up to the first edit after the longest common prefix
            if j < len(self.up[x]) and self.hash[self.up[x][j]] != self.hash[self.up[y][j]]:
                x, y = self.up[x][j], self.up[y][j]
        if self.char[x] == self.char[y] or not self._same(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)  # two different strings have one hash
        return self.char[x] < self.char[y]


#: A state's (cost, audit node), or None where it cannot be reached.
State = tuple[int, int] | None


def _better(audits: Audits, a: State, b: State) -> State:
    if a is None or b is None:
        return a or b
    return a if a[0] < b[0] or (a[0] == b[0] and (a[1] == b[1] or audits.less(a[1], b[1]))) else b


def _insertions(audits: Audits, now: list[State]) -> list[State]:
    """The states after any insertions that can pay: a user, an assistant, or both."""

    def inserted(state: State) -> State:
        return state and (state[0] + COST["I"], audits.add(state[1], "I"))

    out = list(now)
    for before in (NONE, SYSTEM, ASSISTANT):
        if now[before] and (out[USER] is None or now[before][0] + COST["I"] <= out[USER][0]):
            out[USER] = _better(audits, out[USER], inserted(now[before]))
    if out[USER] and (out[ASSISTANT] is None or out[USER][0] + COST["I"] <= out[ASSISTANT][0]):
        out[ASSISTANT] = _better(audits, out[ASSISTANT], inserted(out[USER]))
    return out


def _follows(state: int) -> int:
    """The state after an inserted or re-roled row."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that is kept, or None where its role may not follow."""
    if initial == "s":
        return SYSTEM if state == NONE else None
    return _follows(state) if initial == ("a" if state == USER else "u") else None


#: A fact's code: the initial (s, u, a, or x for any other) and the fault.
FAULTS = {"-": 0, "b": 1, "d": 2, "t": 3}


@lru_cache(maxsize=100_000)
def segment(facts: str, entry: int = NONE) -> tuple[tuple[int, str] | None, ...]:
    """For each state in which rows may be left, the least (cost, audit) of those that enter in ``entry``.

    facts: two characters a row, its initial and its fault (- none, b blank, d duplicate, t truncated)."""
    audits = Audits()
    now: list[State] = [None] * 4
    now[entry] = (0, 0)
    for i in range(0, len(facts), 2):
        initial, fault = facts[i], facts[i + 1]
        given, now = _insertions(audits, now), [None] * 4
        for state, held in enumerate(given):
            if held is None:
                continue
            moves = [("D", state, COST["D"])]
            if fault not in "bd":
                stays = CUT_COST if fault == "t" else 0
                moves.append(("R", _follows(state), COST["R"] + stays))
                if (to := _kept(state, initial)) is not None:
                    moves.append(("K", to, stays))
            for edit, to, cost in moves:
                if now[to] is None or held[0] + cost <= now[to][0]:
                    now[to] = _better(audits, now[to], (held[0] + cost, audits.add(held[1], edit)))
    return tuple(s and (s[0], audits.text(s[1])) for s in now)


def _continued(before: list[tuple[int, str] | None], tables: list[tuple[tuple[int, str] | None, ...] | None]) -> list[tuple[int, str] | None]:
    """The states after one more segment."""
    out: list[tuple[int, str] | None] = [None] * 4
    for held, table in zip(before, tables, strict=True):
        for to, more in enumerate(table or ()):
            if held and more:
                made = (held[0] + more[0], held[1] + more[1])
                out[to] = made if out[to] is None else min(out[to], made)
    return out


def closed(states: list[tuple[int, str] | None]) -> tuple[int, str]:
    """The least (cost, audit) that ends well: what is missing at the end is inserted."""
    ends = [states[NONE], states[ASSISTANT]]
    ends += [s and (s[0] + n * COST["I"], s[1] + "I" * n) for s, n in ((states[USER], 1), (states[SYSTEM], 2))]
    return min(e for e in ends if e)


def repaired(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that an audit leaves or inserts."""
    state = NONE
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = _kept(state, role[:1])
        else:
            state = _follows(state)
            role = "assistant" if state == ASSISTANT else "user"
        yield edit, role, text


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of damaged rows: by crc32 of conv_id:turn, of 20 one drops the row (copies 0), one
    empties its text, one takes its . ! ?, one repeats it and one makes it a user's.  Nulls read as one space, but
    conv_id and turn stay null."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    given = conversations.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    return given.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the text of their conv_id (a null's is one space, which no other has) and the digest of role and text."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return rows.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), "digest": digest, "turn": F.col("turn").cast("long")})


def _base_fault() -> Column:
    kept = F.rtrim(F.col("text"), F.lit(_SPACE))
    return F.when(F.length(kept) == 0, "b").when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-")


_SEGMENT = """conv string, conv_id {0}, part int, at long, blank long, duplicate long, truncated long, illegal long, first string, last string,
 first_turn long, last_turn long, turns long, tables array<array<struct<cost: long, audit: string>>>"""
_AUDIT = "conv string, conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class _Segment:
    """Rows of one conversation that follow each other, in the making."""

    def __init__(self, row: dict, part: int, at: int, entered: bool):
        self.conv, self.conv_id, self.part, self.at, self.entered = row["conv"], row["conv_id"], part, at, entered
        self.facts: list[str] = []
        self.turns: list[int] = []  # first and last, not null
        self.distinct = 0

    def add(self, row: dict) -> None:
        if not row["n"]:
            return
        base, again = row["base"], "b" if row["base"] == "b" else "d"
        self.facts += [row["initial"] + (base if row["leads"] else again), *[row["initial"] + again] * (row["n"] - 1)]
        if row["turn"] is not None:
            if not self.turns:
                self.turns = [row["turn"]] * 2
                self.distinct = 1
            elif row["turn"] != self.turns[1]:
                self.turns[1] = row["turn"]
                self.distinct += 1

    def row(self) -> dict:
        text = "".join(self.facts)
        initials, faults = text[::2], text[1::2]
        table = [[s and dict(cost=s[0], audit=s[1]) for s in segment(text, entry)] if entry == NONE or self.entered else None for entry in range(4)]
        counts = {name: faults.count(name[0]) for name in ("blank", "duplicate", "truncated")}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        first, last = self.turns or (None, None)
        return counts | {"conv": self.conv, "conv_id": self.conv_id, "part": self.part, "at": self.at, "illegal": illegal, "first": initials[:1], "last": initials[-1:], "first_turn": first, "last_turn": last, "turns": self.distinct, "tables": table}


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def audits(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation.

    rows: (conv_id, turn, role, text, copies), roles and texts not null; a row of no copies only names its conversation."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["conv_id"]
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    facts = _keyed(rows).select("conv", "conv_id", "turn", "digest", initial.alias("initial"), _base_fault().alias("base"), "copies")
    each = facts.groupBy("conv", "turn", "digest").agg(F.first("conv_id").alias("conv_id"), F.first("initial").alias("initial"), F.first("base").alias("base"), F.sum("copies").cast("int").alias("n"))
    since = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    leading = each.where("n > 0").groupBy("conv", "digest").agg(F.min(since).alias("since"))
    known = each.join(leading, ["conv", "digest"], "left").withColumn("leads", F.coalesce(since.eqNullSafe(F.col("since")), F.lit(False)))
    cut, out = _SEGMENT.format(kind), _AUDIT.format(kind)
    cut_schema, out_schema = _arrow(spark, cut), _arrow(spark, out)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def segments() -> Iterator[dict]:
            held = None
            for at, row in enumerate(_groups(batches)):
                if held is None or held.conv != row["conv"] or len(held.facts) >= SEGMENT_ROWS:
                    if held is not None:
                        yield held.row()
                    held = _Segment(row, part, at, entered=held is None or held.conv == row["conv"])
                held.add(row)
            if held is not None:
                yield held.row()

        return _batched(segments(), cut_schema, 200)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(x: dict, states: list) -> dict:
            cost, audit = closed(states)
            gaps = x["last_turn"] - x["first_turn"] + 1 - x["turns"] if x["first_turn"] is not None else 0
            return {c: x[c] for c in ("conv", "conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit}

        def found() -> Iterator[dict]:
            held, states = None, []
            for row in _groups(batches):
                tables = [t and [s and (s["cost"], s["audit"]) for s in t] for t in row["tables"]]
                if held is None or held["conv"] != row["conv"]:
                    if held is not None:
                        yield ended(held, states)
                    held, states = row, list(tables[NONE])
                    continue
                states = _continued(states, tables)
                held["illegal"] += row["illegal"] + (bool(held["last"] and row["first"]) and held["last"] + row["first"] not in ("su", "ua", "au"))
                held["turns"] += row["turns"] - (row["first_turn"] is not None and row["first_turn"] == held["last_turn"])
                for c in ("blank", "duplicate", "truncated"):
                    held[c] += row[c]
                held["last"] = row["last"] or held["last"]
                held["first_turn"] = row["first_turn"] if held["first_turn"] is None else held["first_turn"]
                held["last_turn"] = held["last_turn"] if row["last_turn"] is None else row["last_turn"]
            if held is not None:
                yield ended(held, states)

        return _batched(found(), out_schema, 200)

    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("digest")]
    dealt = known.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "conv_id", "turn", "initial", "base", "n", "leads")
    return dealt.mapInArrow(summarise, cut).repartition("conv").sortWithinPartitions("conv", "part", "at").mapInArrow(fold, out)


def _applied(rows: DataFrame, found: DataFrame, each, schema: str) -> DataFrame:
    """``each(audit row, its rows)`` for every conversation, texts read in order and one at a time."""
    kind = dict(rows.dtypes)["conv_id"]
    texts = _keyed(rows).where("copies > 0").withColumn("_", F.explode(F.sequence(F.lit(1), "copies")))
    texts = texts.select("conv", "conv_id", F.lit(1).alias("part"), "turn", "digest", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv", "conv_id", F.lit(0).alias("part"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("digest", "binary"), ("role", "string"), ("text", "string"))), "audit")
    out_schema = _arrow(rows.sparkSession, schema.format(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ahead = _groups(batches), []

        def own(conv: str) -> Iterator[tuple[str, str]]:
            for row in rows:
                if row["part"] == 0 or row["conv"] != conv:
                    ahead.append(row)
                    return
                yield row["role"], row["text"]

        def made() -> Iterator[dict]:
            while head := (ahead.pop() if ahead else next(rows, None)):
                mine = own(head["conv"])
                yield from each(head, mine)
                for _ in mine:  # rows that the audit deletes at the end
                    pass

        return _batched(made(), out_schema, 500)

    together = heads.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "part", F.asc_nulls_first("turn"), "digest")
    return together.drop("turn", "digest").mapInArrow(run, schema.format(kind))


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, role, text): the repaired conversations."""

    def each(head: dict, mine: Iterator[tuple[str, str]]) -> Iterator[dict]:
        for pos, (edit, role, text) in enumerate(repaired(mine, head["audit"])):
            yield {"conv_id": head["conv_id"], "pos": pos, "edit": edit, "role": role, "text": text}

    return _applied(rows, found, each, "conv_id {0}, pos long, edit string, role string, text string")


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of ``role:text`` lines; one row of text is held at a time."""

    def each(head: dict, mine: Iterator[tuple[str, str]]) -> Iterator[dict]:
        digest = hashlib.sha256()
        for pos, (_, role, text) in enumerate(repaired(mine, head["audit"])):
            digest.update(f"{chr(10) if pos else ''}{role}:{text}".encode())
        yield {"conv": head["conv"], "repaired_sha256": digest.hexdigest()}

    return _applied(rows, found, each, "conv string, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    rows: (conv_id, turn, role, text, copies) as ``damage`` gives them.  Rows go by turn, nulls first, those of one turn by the
    SHA-256 of role and text; repeated rows are rows, the second a duplicate.  Rows of a null conv_id are one conversation.
    A role that does not begin with s, u or a (an empty one too) cannot be kept.  A conversation without rows has zeros, an empty audit
    and the hash of the empty string; an empty table gives no row.  A conversation's audit and hash are made in order,
    so by one task each, which holds the audit but never the texts; its faults, costs and audits are found by segments."""
    spark, out = rows.sparkSession, tb.shared_dir(rows.sparkSession, "audits")
    audits(rows).write.parquet(out)  # read for the texts and for the result
    found = spark.read.schema(_AUDIT.format(dict(rows.dtypes)["conv_id"])).parquet(out)
    digests = repaired_digests(rows, found)
    return found.join(digests, "conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
