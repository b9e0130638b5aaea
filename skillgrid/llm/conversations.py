"""Repair of conversation structure by the cheapest edits.

A conversation is read by turn. Edits keep, re-role or delete a message or insert an empty one, so that the initials of the
roles read ``(s?(ua)+)?``. The initials of the edits, in order, are the audit; among equally cheap ones the ASCII-least counts.

The search is a dynamic program over four states of that grammar. Its edit strings are persistent: a string is a node that
points to the string without its last letter, so all strings of a conversation share their prefixes. Each node has its
2^k-th ancestors and a rolling hash. Equally cheap strings are compared by a search for their longest common prefix over these
ancestors; equal hashes are verified letter by letter, and what was verified once is remembered in a union-find, so all
verifications together take time in proportion to the nodes. Two equally cheap strings that end in the same place never extend one
another, since each letter has a cost by its message, so the better prefix stays better whatever follows.

Conversations are sorted by ranges of (conversation, turn, role, text), so one that holds a large part of all rows is
dealt over many tasks. Each task gives, for the part of a conversation it holds, the cheapest edits from every state to
every state; parts are then joined along the conversation. Only the parts at the ends of a task take that way: at most
two a task. The hash of the repaired text is a stream by nature: for such conversations it is computed message by message, holding
the audit and one message at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from skillgrid.llm.common import salted_lookup
from skillgrid.session import stored

_BLOCK = 20_000  # messages whose nodes are held together
_SPACE = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))

# States of the grammar: nothing yet, after s, after u, after a. A conversation may end in the first or the last.
_STATES, _ENDS = range(4), (0, 3)
_NEXT: list[dict[str, int]] = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_WANTED = ["user", "user", "assistant", "user"]  # the role that may be written in a state
KEPT, DELETED, TRUNCATED = 0, 1, 2  # what a message is to the search: sound, blank or duplicate, truncated

Path = tuple[int, str]  # cost, audit


class EditLog:
    """Edit strings as linked nodes; node 0 is the empty string."""

    _BASE, _MOD = 1_000_003, (1 << 61) - 1

    def __init__(self):
        self.parent, self.letter, self.depth, self.hash = [0], [""], [0], [0]
        self.up: list[list[int]] = [[]]
        self._same = [0]  # union-find of nodes whose strings were verified to be equal

    def extend(self, node: int, letter: str) -> int:
        ups, k = [node], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.parent.append(node)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self._BASE + ord(letter)) % self._MOD)
        self.up.append(ups)
        self._same.append(len(self._same))
        return len(self.parent) - 1

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(letters))

    def _class(self, node: int) -> int:
        while self._same[node] != node:
            self._same[node] = self._same[self._same[node]]
            node = self._same[node]
        return node

    def equal(self, a: int, b: int) -> bool:
        """Whether two strings of one length are equal: by hash, then verified from the end to a known equal prefix."""
        if a == b:
            return True
        if self.hash[a] != self.hash[b]:
            return False
        seen = []
        while (x := self._class(a)) != (y := self._class(b)):
            if self.letter[a] != self.letter[b]:
                return False
            seen.append((x, y))
            a, b = self.parent[a], self.parent[b]
        for x, y in seen:
            self._same[self._class(x)] = self._class(y)
        return True

    def _cut(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def before(self, a: int, b: int) -> bool:
        """Whether string ``a`` comes before string ``b``."""
        shared = min(self.depth[a], self.depth[b])
        x, y = self._cut(a, shared), self._cut(b, shared)
        if self.equal(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self.equal(self.parent[x], self.parent[y]):
            # Equal hashes of unequal strings: look for the first difference letter by letter.
            p, q = self.parent[x], self.parent[y]
            while p != q:
                if self.letter[p] != self.letter[q]:
                    x, y = p, q
                p, q = self.parent[p], self.parent[q]
        return self.letter[x] < self.letter[y]


class _Frontier:
    """The cheapest string into each state so far; ties go to the string that comes first."""

    def __init__(self, log: EditLog, paths: list[tuple[int, int] | None]):
        self.log, self.paths = log, paths

    def _offer(self, best: list, state: int, cost: int, node: int, letter: str) -> None:
        held = best[state]
        if held is not None:
            if cost > held[0]:
                return
            if cost == held[0]:
                if held[1] == node and held[2]:
                    if letter >= held[2]:
                        return
                else:
                    new = self.log.extend(node, letter)
                    old = self.log.extend(held[1], held[2]) if held[2] else held[1]
                    best[state] = (cost, new, "") if self.log.before(new, old) else (cost, old, "")
                    return
        best[state] = (cost, node, letter)

    def _settle(self, best: list) -> list[tuple[int, int] | None]:
        return [b and (b[0], self.log.extend(b[1], b[2]) if b[2] else b[1]) for b in best]

    def insert(self) -> None:
        """Inserts at this place: at most a user and an assistant are ever worth their cost."""
        for sources, state in (((0, 1, 3), 2), ((2,), 3)):
            best = [None if p is None else (*p, "") for p in self.paths]
            for s in sources:
                if self.paths[s] is not None:
                    self._offer(best, state, self.paths[s][0] + 2, self.paths[s][1], "I")
            self.paths = self._settle(best)

    def message(self, initial: str, fault: int) -> None:
        self.insert()
        best: list = [None] * 4
        extra = 1 if fault == TRUNCATED else 0
        for s, path in enumerate(self.paths):
            if path is None:
                continue
            cost, node = path
            self._offer(best, s, cost + 3, node, "D")
            if fault != DELETED:
                if (kept := _NEXT[s].get(initial)) is not None:
                    self._offer(best, kept, cost + extra, node, "K")
                self._offer(best, _NEXT[s][_WANTED[s][0]], cost + 2 + extra, node, "R")
        self.paths = self._settle(best)


def _from_state(messages: list[tuple[str, int]], start: int, ends: bool) -> dict[int, Path]:
    log = EditLog()
    frontier = _Frontier(log, [(0, 0) if s == start else None for s in _STATES])
    for initial, fault in messages:
        frontier.message(initial, fault)
    if ends:
        frontier.insert()
    return {s: (p[0], log.text(p[1])) for s, p in enumerate(frontier.paths) if p is not None}


def _joined(paths: dict[int, Path], table: dict[int, dict[int, Path]]) -> dict[int, Path]:
    """Continue paths by the cheapest ways of the next part."""
    best: dict[int, Path] = {}
    for middle, (cost, audit) in paths.items():
        for end, (more, rest) in table[middle].items():
            way = (cost + more, audit + rest)
            if end not in best or way < best[end]:
                best[end] = way
    return best


def cheapest_paths(messages: list[tuple[str, int]], start: int = 0, ends: bool = False) -> dict[int, Path]:
    """Cheapest (cost, audit) from a state to each state over messages (initial, fault), in blocks of bounded size.

    With ``ends`` the inserts after the last message count as well.
    """
    paths: dict[int, Path] = {start: (0, "")}
    for at in range(0, max(1, len(messages)), _BLOCK):
        block = messages[at:at + _BLOCK]
        last = ends and at + _BLOCK >= len(messages)
        paths = _joined(paths, {s: _from_state(block, s, last) for s in paths})
    return paths


def cheapest_audit(paths: dict[int, Path]) -> Path:
    return min(paths[s] for s in _ENDS if s in paths)


class Repair:
    """Applies an audit message by message."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            role = _WANTED[self.state]
            self.state, self.at = _NEXT[self.state][role[0]], self.at + 1
            yield "I", role, ""

    def message(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what is inserted before this message, and of the message unless it is deleted."""
        yield from self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            role = _WANTED[self.state] if letter == "R" else role
            self.state = _NEXT[self.state][role[:1]]
            yield letter, role, text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        return self._inserts()


class _Digest:
    """SHA-256 of ``role:text`` lines."""

    def __init__(self):
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, said: Iterable[tuple[str, str, str]]) -> None:
        for _, role, text in said:
            self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False


def repaired_digest(messages: Iterable[tuple[str, str]], audit: str) -> str:
    repair, digest = Repair(audit), _Digest()
    for role, text in messages:
        digest.add(repair.message(role, text))
    digest.add(repair.rest())
    return digest.sha.hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``; ``present`` is false for rows that only name their conversation."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    drawn = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), draw.alias("_draw"))
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.col("_draw") != 0, F.when(F.col("_draw") == 3, 2).otherwise(1))
    return drawn.select("conv_id", "turn", F.when(F.col("_draw") == 4, "user").otherwise(F.col("role")).alias("role"),
                        text.alias("text"), F.explode(copies).alias("present"))


def _messages(rows: DataFrame) -> DataFrame:
    """Distinct messages with their number of copies, and what the search must know of each."""
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    plain = rows.select("conv_id", F.when(present, F.col("turn")).alias("turn"),
                        *(F.when(present, F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text")),
                        present.alias("present"))
    distinct = plain.groupBy("conv_id", "turn", "role", "text", "present").agg(F.count("*").alias("copies"))
    conv = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    known = stored(distinct.withColumns({
        "_conv": conv, "_said": F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")),
        "_place": F.struct(F.col("turn").isNotNull(), "turn"),
    }).withColumn("_key", F.xxhash64("_conv", "_said")), "messages")
    said = known.where("present").groupBy("_conv", "_said", "_key").agg(F.min("_place").alias("_first"))
    asked = known.where("present").select("_conv", "_said", "_key", "_place")
    # Only messages said again are few columns; texts stay where they are.
    again = salted_lookup(asked, said, ["_conv", "_said"], "_key", ["_place"]).where(
        ~F.col("_place").eqNullSafe(F.col("_first"))).select("_conv", "_said", F.col("_place").alias("_again"))
    stripped = F.rtrim(F.col("text"), F.lit(_SPACE))
    marked = known.join(again, (known["_conv"] == again["_conv"]) & (known["_said"] == again["_said"])
                        & known["_place"].eqNullSafe(again["_again"]), "left").select(
        known["*"], F.col("_again").isNotNull().alias("said_before"))
    return marked.select(
        "conv_id", "_conv", F.col("turn").cast("bigint").alias("turn"), "role", "text", "present", "copies", "_said",
        F.substring("text", 1, 64).alias("_start"),
        F.substring("role", 1, 1).alias("initial"), (stripped == "").alias("blank"), "said_before",
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut_short"))


_ORDER = ["_conv", "turn", "role", "_start", "_said"]


class _Part:
    """What one task knows of one conversation."""

    def __init__(self, conv_id, key: str):
        self.conv_id, self.key = conv_id, key
        self.messages: list[tuple[str, int]] = []
        self.said: list[tuple[str, str]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.turn_ends: list[int] = []

    def add(self, turn, role, text, copies, initial, blank, said_before, cut_short) -> None:
        for copy in range(copies):
            if blank:
                self.blank += 1
            elif said_before or copy:
                self.duplicate += 1
            elif cut_short:
                self.truncated += 1
            fault = DELETED if blank or said_before or copy else TRUNCATED if cut_short else KEPT
            if self.messages and self.messages[-1][0] + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.messages.append((initial, fault))
            self.said.append((role, text))
        if turn is not None:
            if not self.turn_ends:
                self.turn_ends = [turn, turn]
                self.turns = 1
            elif turn != self.turn_ends[1]:
                self.turn_ends[1] = turn
                self.turns += 1

    def row(self, task: int, edge: bool) -> tuple:
        first, last = self.turn_ends or (None, None)
        initials = (self.messages[0][0], self.messages[-1][0]) if self.messages else (None, None)
        head = (self.conv_id, self.key, task, edge, self.blank, self.duplicate, self.truncated, self.illegal, self.turns,
                first, last, *initials)
        if not edge:
            cost, audit = cheapest_audit(cheapest_paths(self.messages, ends=True))
            return (*head, cost, audit, repaired_digest(self.said, audit), [], [])
        costs, audits = [], []
        for start in _STATES:
            found = cheapest_paths(self.messages, start) if self.messages else {start: (0, "")}
            for end in _STATES:
                cost, audit = found.get(end, (-1, ""))
                costs.append(cost)
                audits.append(audit)
        return (*head, 0, "", "", costs, audits)


_PART = ("conv_id {kind}, _conv string, task int, edge boolean, blank bigint, duplicate bigint, truncated bigint, "
         "illegal bigint, turns bigint, first_turn bigint, last_turn bigint, first_initial string, last_initial string, "
         "cost bigint, audit string, repaired_sha256 string, costs array<bigint>, audits array<string>")
_ANSWER = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, part, first, out = TaskContext.get().partitionId(), None, True, []
    schema = None

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        if schema is None:
            text, long, flag = pa.string(), pa.int64(), pa.bool_()
            types = [batch["conv_id"].type, text, pa.int32(), flag, *[long] * 7, text, text, long, text, text,
                     pa.list_(long), pa.list_(text)]
            names = [c.split()[0] for c in _PART.format(kind="x").split(", ")]
            schema = pa.schema(list(zip(names, types)))
        columns = [batch[c].to_pylist() for c in ("conv_id", "_conv", "present", "turn", "role", "text", "copies", "initial",
                                                  "blank", "said_before", "cut_short")]
        for conv_id, key, present, *message in zip(*columns):
            if part is None or part.key != key:
                if part is not None:
                    out.append(part.row(task, first))
                    first = False
                part = _Part(conv_id, key)
            if present:
                part.add(*message)
        if len(out) >= 5_000:
            yield flush()
    if part is not None:
        out.append(part.row(task, True))
        yield flush()


def _along(parts: pa.Table) -> pa.Table:
    """Join the parts of one conversation (at most one a task) in order."""
    paths: dict[int, Path] = {0: (0, "")}
    illegal = turns = 0
    lowest = highest = last_initial = None
    rows = sorted(parts.to_pylist(), key=lambda r: r["task"])
    for row in rows:
        costs, audits = row["costs"], row["audits"]
        paths = _joined(paths, {s: {e: (costs[4 * s + e], audits[4 * s + e]) for e in _STATES if costs[4 * s + e] >= 0}
                                for s in _STATES})
        illegal += row["illegal"]
        if row["first_initial"] is not None:
            illegal += last_initial is not None and last_initial + row["first_initial"] not in ("su", "ua", "au")
            last_initial = row["last_initial"]
        if row["first_turn"] is not None:
            turns += row["turns"] - (highest == row["first_turn"])
            lowest = row["first_turn"] if lowest is None else lowest
            highest = row["last_turn"]
    cost, audit = cheapest_audit(_joined(paths, {s: cheapest_paths([], s, ends=True) for s in paths}))
    sums = {c: [sum(r[c] for r in rows)] for c in ("blank", "duplicate", "truncated")}
    return pa.table({"conv_id": parts["conv_id"].slice(0, 1), "_conv": [rows[0]["_conv"]],
                     "gaps": [0 if lowest is None else highest - lowest + 1 - turns], **sums, "illegal": [illegal],
                     "cost": [cost], "audit": [audit]})


_STREAMED = "_conv string, place bigint, edit string, role string, text string, repaired_sha256 string"


def _apply(batches: Iterator[pa.RecordBatch], lines: bool) -> Iterator[pa.RecordBatch]:
    """Per conversation its audit, then its messages in order: the repaired messages, or with no ``lines`` their hash."""
    key, repair, digest, place, out = None, None, None, 0, []
    names = [c.split()[0] for c in _STREAMED.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

    def take(said: Iterable[tuple[str, str, str]]) -> None:
        nonlocal place
        if not lines:
            digest.add(said)
            return
        for edit, role, text in said:
            out.append((key, place, edit, role, text, None))
            place += 1

    def finish() -> None:
        take(repair.rest())
        if not lines:
            out.append((key, None, None, None, None, digest.sha.hexdigest()))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        out.clear()
        return batch

    for batch in batches:
        for conv, audit, role, text, copies in zip(*(batch[c].to_pylist() for c in ("_conv", "audit", "role", "text", "copies"))):
            if audit is not None:
                if repair is not None:
                    finish()
                key, repair, digest, place = conv, Repair(audit), _Digest(), 0
            else:
                for _ in range(copies):
                    take(repair.message(role, text))
            if len(out) >= 5_000:
                yield flush()
    if repair is not None:
        finish()
    if out:
        yield flush()


def _streamed(messages: DataFrame, audits: DataFrame, lines: bool) -> DataFrame:
    """Send each conversation's audit ahead of its messages and apply it."""
    columns = [*_ORDER, "role", "text", "copies"]
    told = messages.where("present").select(*dict.fromkeys(columns), F.lit(None).cast("string").alias("audit"),
                                            F.lit(1).alias("_kind"))
    heads = audits.select("_conv", "audit", F.lit(0).alias("_kind"))
    both = told.unionByName(heads, allowMissingColumns=True).repartition("_conv").sortWithinPartitions(
        "_conv", "_kind", *_ORDER[1:])
    return both.select("_conv", "audit", "role", "text", "copies").mapInArrow(lambda b: _apply(b, lines), _STREAMED)


def _audited(messages: DataFrame) -> DataFrame:
    """_conv and the answer's columns, from messages already written."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "_conv", "present", "turn", "role", "text", "copies", "initial", "blank", "said_before", "cut_short"]
    sorted_rows = messages.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select(*names)
    parts = stored(sorted_rows.mapInArrow(_parts, _PART.format(kind=kind)), "conversation_parts")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = parts.where("NOT edge").select("_conv", "conv_id", gaps, *_ANSWER[2:])
    edges = stored(parts.where("edge").groupBy("_conv").applyInArrow(
        _along, f"conv_id {kind}, _conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
                "illegal bigint, cost bigint, audit string"), "conversation_edges")
    # At most two conversations a task stand here, so their keys are a small table of proven size.
    split = F.broadcast(edges.select("_conv"))
    hashes = _streamed(messages.join(split, "_conv", "left_semi"), edges, lines=False).select("_conv", "repaired_sha256")
    return whole.unionByName(edges.join(hashes, "_conv"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text, and may have ``present``: where it is false, the row only names a conversation.
    Other columns are not read. A null role or text is one space; a null conv_id is a conversation of its own. Rows are
    read by turn, nulls first, then by role, the first 64 characters and the MD5 of role and text. Repeated rows are
    duplicates of the first. A message whose role has no initial, or another than s, u and a, can be re-roled or deleted. A conversation
    without messages has zeros, an empty audit and the hash of the empty string. An empty table gives no rows.
    """
    return _audited(stored(_messages(rows), "conversation_messages")).select(*_ANSWER)


def repaired_messages(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text of every message after the repair, by place from 0; rows as above."""
    messages = stored(_messages(rows), "conversation_messages")
    audits = stored(_audited(messages), "conversation_audits")
    said = _streamed(messages, audits, lines=True)
    return said.join(audits.select("conv_id", "_conv"), "_conv").select("conv_id", "place", "edit", "role", "text")
