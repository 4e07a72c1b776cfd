"""Repair of conversations: rows as an input acceptor, composed with an edit transducer and the roles' grammar, shortest path taken."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import _io

#: What the edits cost, and what a truncated row that stays adds. Their letters in the audit are their initials.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The grammar's states: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state the row that may follow by its role's initial, and those that an edit can put there.
ARCS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
MADE = {s: next((r, t) for r, t in arcs.items() if r != "s") for s, arcs in ARCS.items()}
FINAL = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}
#: Faults of a row, by its first.
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
_INK, _STOPPED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def damage(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text) with the test damage of their ids; dropped rows stay, marked in `dropped`.

    Nulls become one space. By crc32("conv:turn") % 20: 0 drops a row, 1 empties its text, 2 takes its full stops,
    question and exclamation marks, 3 repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv"), space("turn"))) % 20
    rows = turns.select("conv", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(times).alias("copy")).drop("copy")


def order(*more: Column) -> list[Column]:
    """How a conversation's rows follow each other: by turn, nulls first; equal ones by role and digest of the text."""
    return [*more, F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, mark, blank, stopped, dropped) with `fault`, by the first that holds.

    A window over equal rows, within the conversations' own partitioning: no shuffle more.
    """
    again = F.row_number().over(Window.partitionBy("conv", "dropped", "role", "mark").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(~F.col("stopped"), CUT).otherwise("")
    return rows.withColumn("fault", fault)


def arcs(state: int, role: str, fault: str):
    """(letter, cost, next state) of the edits that read a row in a state of the grammar; built when a state is reached.

    Letters of one state's arcs all differ, those of insertions too. So of two labelled paths of equal cost from a
    state the one with the smaller first label that differs is the smaller string, and costs alone need be kept.
    """
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    if (to := ARCS[state].get(role)) is not None:
        yield "K", more, to
    yield "R", REROLE + more, MADE[state][1]


def inserted(after: list[float]) -> list[float]:
    """Costs to the end from each state where rows may be inserted first; a cycle of insertions never pays."""
    out = list(after)
    for s in (USER, ASSISTANT):
        out[s] = min(after[s], INSERT + after[MADE[s][1]])
    for s in (START, SYSTEM):
        out[s] = min(after[s], INSERT + out[MADE[s][1]])
    return out


class Lattice:
    """The composed automaton of one conversation, taken from its last row to its first: in that order it is topological.

    A row is kept as one byte, two bits a state: its best edit (D, I, K, R by number) where ties go to the
    smaller letter. Those choices and four costs are all that stays of a row.
    """

    LETTERS = "DIKR"

    def __init__(self):
        self.cost = [0.0 if s in FINAL else float("inf") for s in range(4)]
        self.choices = bytearray([0])
        self.finish()

    def finish(self, best: list[tuple[float, str]] | None = None) -> None:
        """Let insertions come before what was just read, and note each state's choice."""
        best = best or [(c, "") for c in self.cost]
        cost = inserted([c for c, _ in best])
        code = 0
        for s in range(4):
            c, letter = best[s]
            if cost[s] < c or cost[s] == INSERT + cost[MADE[s][1]] and letter > "I":
                letter = "I"
            code |= (self.LETTERS.index(letter) if letter else 0) << 2 * s
        self.cost, self.choices[-1] = cost, code

    def read(self, role: str, fault: str) -> None:
        self.choices.append(0)
        self.finish([min((c + self.cost[to], letter) for letter, c, to in arcs(s, role, fault)) for s in range(4)])

    def audit(self, roles: str) -> str:
        """The letters of the best path; roles are the initials of the rows, first to last."""
        out, state = [], START
        for i in range(len(self.choices) - 1, -1, -1):
            while (letter := self.LETTERS[self.choices[i] >> 2 * state & 3]) == "I":
                out.append("I")
                state = MADE[state][1]
            if not i:
                break
            out.append(letter)
            state = {"D": state, "K": ARCS[state].get(roles[len(self.choices) - 1 - i]), "R": MADE[state][1]}[letter]
        return "".join(out)


def initial(role: str) -> str:
    """One character that stands for a role: its first, or a blank."""
    return role[:1] or " "


class Summary:
    """What is told of one conversation, from its rows last to first."""

    def __init__(self):
        self.lattice, self.roles, self.counts = Lattice(), [], {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.illegal, self.turns, self.most, self.least = 0, 0, None, None

    def read(self, turn, role: str, fault: str) -> None:
        now = initial(role)
        if self.roles and now + self.roles[-1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.roles.append(now)
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.least:
            self.turns, self.most, self.least = self.turns + 1, turn if self.most is None else self.most, turn
        self.lattice.read(now, fault)

    def row(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        audit = self.lattice.audit("".join(reversed(self.roles)))
        return gaps, *self.counts.values(), self.illegal, int(self.lattice.cost[START]), audit


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SUMMARY = pa.schema([("conv", pa.string()), *((f, pa.int64()) for f in FIELDS), ("audit", pa.string())])


def summaries(batches):
    """Rows (conv, turn, role, fault, dropped) by conversation, last row first -> one row a conversation."""
    now, held = None, None

    def done():
        return pa.RecordBatch.from_pylist([{"conv": now[0], **dict(zip((*FIELDS, "audit"), held.row()))}], _SUMMARY)

    for b in batches:
        for conv, turn, role, fault, dropped in zip(*(b.column(i).to_pylist() for i in range(5))):
            if now != (conv,):
                if now:
                    yield done()
                now, held = (conv,), Summary()
            if not dropped:
                held.read(turn, role, fault)
    if now:
        yield done()


def repaired(audit: str, rows):
    """Lines role:text that an audit makes of the (role, text) rows of a conversation, one after the other."""
    state, rows = START, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = ARCS[state][initial(role)]
        else:
            made, state = MADE[state]
            role = NAMES[made]
        yield f"{role}:{text}"


_HASHED = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])


def digests(batches):
    """A conversation's audit, then its rows in order -> the digest of what the audit makes of them; texts stream by."""

    def rows():
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)))

    def group(first):
        """The rows of one conversation; what follows is left in `ahead`."""
        for x in stream:
            if x[2] is not None and x[3] is None:  # an audit stands alone
                ahead.append(x)
                return
            yield x[2], x[3]

    stream, ahead = rows(), []
    first = next(stream, None)
    while first is not None:
        ahead.clear()
        h, own = hashlib.sha256(), group(first)
        for i, line in enumerate(repaired(first[2], own)):
            h.update((b"\n" if i else b"") + line.encode())
        for _ in own:  # nothing is left but on a wrong audit
            raise ValueError("the audit is shorter than its conversation")
        yield pa.RecordBatch.from_pylist([{"conv": first[0], "repaired_sha256": h.hexdigest()}], _HASHED)
        first = ahead[0] if ahead else None


def repair(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text, dropped) -> (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    Roles and texts are not null. Of a row the first fault counts: blank, duplicate of an earlier row, truncated
    (no full stop at its end). The cheapest edits that make the roles follow the grammar are found for
    all conversations; of equal cost the least audit is taken. A conversation streams through its task twice, first
    without its texts: what is held of a row is a byte and its role's initial, as much as the audit itself holds.
    """
    mark = F.md5("text")
    slim = turns.select(
        F.col("conv").cast("string").alias("conv"), "turn", "role", mark.alias("mark"), (~F.col("text").rlike(_INK)).alias("blank"), F.col("text").rlike(_STOPPED).alias("stopped"), "dropped"
    ).repartition("conv")
    back = ["conv", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("mark").desc(), F.col("again").desc()]
    ranked = faults(slim).withColumn("again", F.col("fault") == DUPLICATE)  # of equal rows the duplicate comes later
    told = ranked.sortWithinPartitions(*back).select("conv", F.col("turn").cast("long"), "role", "fault", "dropped")
    told = _io.cut(told.mapInArrow(summaries, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
    texts = turns.where("not dropped").select(F.lit(1).alias("kind"), F.col("conv").cast("string").alias("conv"), "turn", "role", "text", mark.alias("mark"))
    heads = told.select(F.lit(0).alias("kind"), "conv", F.lit(None).cast("long").alias("turn"), F.col("audit").alias("role"), F.lit(None).cast("string").alias("text"), F.lit("").alias("mark"))
    both = heads.unionByName(texts).repartition("conv").sortWithinPartitions(*order(F.col("conv"), F.col("kind")))
    _io.small_batches(turns.sparkSession)
    hashed = both.select("conv", "kind", "role", "text").mapInArrow(digests, "conv string, repaired_sha256 string")
    hashed = hashed.withColumnRenamed("conv", "_conv")
    return told.join(hashed, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")


def repair_damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """repair() of a conversations table after damage(): one row for every conv_id, those left without rows too.

    Null turns come first, and rows of equal turns by role and digest of their text; null roles and texts are one
    space (such a text is blank). Rows without a conversation are one conversation of the null id. Repeated rows are duplicates;
    very long texts are hashed as they stream; other columns may have any names; an empty table gives an empty result.
    """
    kind = turns.schema[id_col].dataType
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    out = repair(damage(rows))
    return out.withColumn("conv_id", F.col("conv").cast(kind)).select("conv_id", *FIELDS, "audit", "repaired_sha256")


#: The same in DuckDB: crc32 bit by bit, then a fold over each conversation from its end, costs and strings outright.
ORACLE = r"""
WITH named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(list_transform(range(1, len(k) + 1), lambda i: unicode(k[i])::BIGINT), lambda c, b:
    list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
    4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind FROM named
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM summed WHERE kind <> 0
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) || role[1:1] AS two
  FROM hurt
), convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal,
    list({'r': role, 'x': text, 'f': fault} ORDER BY turn DESC NULLS LAST, role DESC, md5(text) DESC, fault = 'duplicate' DESC) AS rows
  FROM faulty GROUP BY conv_id
), folded AS (
  -- Of each grammar state (1 start, 2 after s, 3 after u, 4 after a): cost to the end, audit, repaired lines.
  SELECT * EXCLUDE (rows), list_reduce(
    list_transform(rows, lambda x: {'row': x, 'best': []::STRUCT(c BIGINT, t VARCHAR, y VARCHAR[])[]}),
    lambda n, z: {'row': z.row, 'best': list_transform([list_transform([
      {'d': n.best[1], 'k': CASE z.row.r[1:1] WHEN 's' THEN n.best[2] WHEN 'u' THEN n.best[3] END, 'm': n.best[3], 'w': 'user'},
      {'d': n.best[2], 'k': CASE z.row.r[1:1] WHEN 'u' THEN n.best[3] END, 'm': n.best[3], 'w': 'user'},
      {'d': n.best[3], 'k': CASE z.row.r[1:1] WHEN 'a' THEN n.best[4] END, 'm': n.best[4], 'w': 'assistant'},
      {'d': n.best[4], 'k': CASE z.row.r[1:1] WHEN 'u' THEN n.best[3] END, 'm': n.best[3], 'w': 'user'}],
      lambda o: list_min(list_filter([
        {'c': o.d.c + 4, 't': 'D' || o.d.t, 'y': o.d.y},
        CASE WHEN o.k IS NOT NULL AND z.row.f NOT IN ('blank', 'duplicate')
          THEN {'c': o.k.c + CASE z.row.f WHEN 'truncated' THEN 3 ELSE 0 END, 't': 'K' || o.k.t, 'y': list_prepend(z.row.r || ':' || z.row.x, o.k.y)} END,
        CASE WHEN z.row.f NOT IN ('blank', 'duplicate')
          THEN {'c': o.m.c + 3 + CASE z.row.f WHEN 'truncated' THEN 3 ELSE 0 END, 't': 'R' || o.m.t, 'y': list_prepend(o.w || ':' || z.row.x, o.m.y)} END
      ], lambda p: p IS NOT NULL)))],
      lambda b: list_transform([[
        list_min([b[3], {'c': b[4].c + 3, 't': 'I' || b[4].t, 'y': list_prepend('assistant:', b[4].y)}]),
        list_min([b[4], {'c': b[3].c + 3, 't': 'I' || b[3].t, 'y': list_prepend('user:', b[3].y)}])]],
        lambda q: [
          list_min([b[1], {'c': q[1].c + 3, 't': 'I' || q[1].t, 'y': list_prepend('user:', q[1].y)}]),
          list_min([b[2], {'c': q[1].c + 3, 't': 'I' || q[1].t, 'y': list_prepend('user:', q[1].y)}]), q[1], q[2]])[1])[1]},
    {'row': {'r': '', 'x': '', 'f': ''}, 'best': [{'c': 0, 't': '', 'y': []}, {'c': 6, 't': 'II', 'y': ['user:', 'assistant:']}, {'c': 3, 't': 'I', 'y': ['assistant:']},
      {'c': 0, 't': '', 'y': []}]::STRUCT(c BIGINT, t VARCHAR, y VARCHAR[])[]}).best[1] AS answer
  FROM convs
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(answer.c, 0) AS cost, coalesce(answer.t, '') AS audit, sha256(coalesce(array_to_string(answer.y, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN folded f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
"""
