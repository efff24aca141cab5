"""Conversation repair: fault flags from windows, and the cheapest edits that give a conversation its structure.

A conversation is repaired when the initials of its roles read `(s?(ua)+)?`. Edits, in the order of the turns:

    Keep    0   (not for a blank or duplicate turn; 3 for a truncated one)
    Rerole  3   to user or assistant (not for a blank or duplicate turn; 3 more for a truncated one)
    Delete  4
    Insert  3   an empty user or assistant turn, anywhere

The sorted turns of a block of `BLOCK` turns are folded by aggregate(), which carries four structs (cost, audit), one for
each state: nothing yet, the system turn, a user turn, an assistant turn. Every step takes least() of the structs that lead
to a state, so costs decide and then the audit, in ASCII order. Inside the fold an audit tells the role of an edit, as
`I R` (user) or `J S` (assistant): what came before decides it, so this changes no comparison; `J S` become `I R` in the
result. A block is folded from each of the four states, and a second fold joins the blocks of a long conversation: so its
audit is copied once a block and not once a turn.

Faults of a turn, the first that holds: blank (no character but white space), duplicate (an earlier turn has the same role
and text), truncated (the last such character is none of `.!?`). All windows and both groupings are by conv_id: one
exchange. A conversation is one row of the result, so its turns meet in one task, as arrays; nothing else does.

Cases: a null role or text is one space, so it is neither system, user nor assistant, and blank; an empty role has no
initial and can't be kept; null turns come first, turns of equal number by role and text; a null conv_id is a conversation
of its own; repeated rows are turns of their own; a conversation without turns (`gone` rows only) costs nothing, with an
empty audit; `gaps` is null beyond 64 bits; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.llm import common

NAME = "op12_conversation_repair"

#: Turns folded at once.
BLOCK = 512
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The cost of a state that can't be reached.
NEVER = 1 << 50

SPACE = " \t\n\x0b\f\r"
STATES = ("nothing", "system", "user", "assistant")
ROLES = {"user": ("I", "R"), "assistant": ("J", "S")}


def state(cost, audit) -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))


def edited(s: Column, letter: str, cost) -> Column:
    return F.struct((s["cost"] + F.lit(cost)).cast("long").alias("cost"), F.concat(s["audit"], F.lit(letter)).alias("audit"))


def four(nothing: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(*(s.alias(n) for s, n in zip((nothing, system, user, assistant), STATES, strict=True)))


def with_inserts(s: Column) -> Column:
    """The four states after any inserts: a user turn follows all but a user turn, an assistant turn a user turn."""
    letter = {role: letters[0] for role, letters in ROLES.items()}
    user = F.least(s["user"], *(edited(s[k], letter["user"], INSERT) for k in STATES if k != "user"))
    return four(s["nothing"], s["system"], user, F.least(s["assistant"], edited(user, letter["assistant"], INSERT)))


def step(s: Column, turn: Column) -> Column:
    """The four states after a turn and any inserts behind it."""
    more = F.when(turn["truncated"], TRUNCATED).otherwise(0)
    stays = ~turn["dropped"]
    first = F.least(*(s[k] for k in STATES if k != "user"))  # what a user turn may follow

    def taken(before: Column, initial: str, role: str | None = None) -> list[Column]:
        found = [F.when(stays & (turn["initial"] == initial), edited(before, "K", more))]
        return found + ([F.when(stays, edited(before, ROLES[role][1], F.lit(REROLE) + more))] if role else [])

    gone = {k: edited(s[k], "D", DELETE) for k in STATES}
    after = four(
        gone["nothing"],
        F.least(gone["system"], *taken(s["nothing"], "s")),
        F.least(gone["user"], *taken(first, "u", "user")),
        F.least(gone["assistant"], *taken(s["user"], "a", "assistant")),
    )
    return F.transform(F.array(after), with_inserts)[0]


def opened() -> Column:
    """The four states before the first turn of a conversation, inserts included."""
    return with_inserts(four(*(state(0 if k == STATES[0] else NEVER, "") for k in STATES)))


def folded(turns: Column, start: str) -> Column:
    """The four states after a block of turns, from one state before it."""
    return F.aggregate(turns, four(*(state(0 if k == start else NEVER, "") for k in STATES)), step)


def joined(blocks: Column) -> Column:
    """The four states after all blocks, from what each makes of the four states before it."""
    over = lambda acc, b, k: F.least(*(F.struct((acc[a]["cost"] + b[f"from_{a}"][k]["cost"]).alias("cost"), F.concat(acc[a]["audit"], b[f"from_{a}"][k]["audit"]).alias("audit")) for a in STATES))
    return F.aggregate(blocks, opened(), lambda acc, b: four(*(over(acc, b, k) for k in STATES)))


def flagged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, place, role, text, gone) with the flags blank, duplicate, truncated, illegal, initial, dropped."""
    bare = F.rtrim("text", F.lit(SPACE))
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("place")) > 1
    flags = turns.withColumns({"blank": bare == "", "initial": F.substring("role", 1, 1), "bare_end": F.substring(bare, -1, 1), "seen": seen})
    flags = flags.withColumns({"duplicate": ~F.col("blank") & F.col("seen"), "number": F.row_number().over(order := Window.partitionBy("conv_id", "gone").orderBy("place"))})
    pair = F.concat(F.lag("initial").over(order), "initial")
    return flags.withColumns({"dropped": F.col("blank") | F.col("duplicate"), "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))}).withColumn("truncated", ~F.col("dropped") & ~F.col("bare_end").isin(".", "!", "?"))


def numbered(turns: DataFrame) -> DataFrame:
    """The turns in order: null roles and texts as one space, `place` from 1 on."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and turns (array of role, text, as repaired) of every
    conversation of numbered() rows. Rows with `gone` name a conversation but aren't part of it."""
    rows = flagged(turns if "gone" in turns.columns else turns.withColumn("gone", F.lit(False))).withColumn("block", F.floor((F.col("number") - 1) / BLOCK))
    here, there = ~F.col("gone"), lambda c: F.when(~F.col("gone"), c)
    counts = ("blank", "duplicate", "truncated", "illegal")
    blocks = rows.groupBy("conv_id", "block").agg(
        *(F.count_if(here & F.col(c)).alias(c) for c in counts),
        F.max(there(F.col("turn"))).alias("last"),
        F.min(there(F.col("turn"))).alias("first"),
        F.collect_set(there(F.col("turn"))).alias("numbers"),
        F.sort_array(F.collect_list(there(F.struct("number", "initial", "dropped", "truncated", "role", "text")))).alias("rows"),
    )
    blocks = blocks.withColumns({f"from_{k}": folded(F.col("rows"), k) for k in STATES})
    whole = blocks.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in counts),
        F.max("last").alias("last"),
        F.min("first").alias("first"),
        F.flatten(F.collect_list("numbers")).alias("numbers"),
        F.sort_array(F.collect_list(F.struct("block", "rows", *(f"from_{k}" for k in STATES)))).alias("blocks"),
    )
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.coalesce(wide("last") - wide("first") + 1 - F.size(F.array_distinct("numbers")), F.lit(0)).try_cast("long")
    done = whole.withColumns({"gaps": gaps, "end": joined(F.col("blocks")), "rows": F.flatten(F.transform("blocks", lambda b: b["rows"]))})
    done = done.withColumn("best", F.least(F.col("end.nothing"), F.col("end.assistant")))
    said = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    inserts = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: said(F.when(x == "I", "user").otherwise("assistant"), F.lit("")))

    def edit(turn: Column, chunk: Column) -> Column:
        letter = F.substring(chunk, -1, 1)
        role = F.when(letter == "K", turn["role"]).when(letter == "R", "user").otherwise("assistant")
        kept = F.when(letter == "D", F.slice(F.array(said(turn["role"], turn["text"])), 1, 0)).otherwise(F.array(said(role, turn["text"])))
        return F.concat(inserts(F.regexp_replace(chunk, "[DKRS]", "")), kept)

    audit = F.col("best.audit")
    chunks = F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]"), F.lit(0))
    turns_now = F.concat(F.flatten(F.zip_with("rows", chunks, edit)), inserts(F.regexp_extract(audit, "[IJ]*$", 0)))
    return done.select("conv_id", "gaps", *counts, F.col("best.cost").alias("cost"), F.translate(audit, "JS", "IR").alias("audit"), turns_now.alias("turns"))


def damaged(turns: DataFrame) -> DataFrame:
    """numbered() rows, damaged by the checksum of `conv_id:turn` modulo 20: 0 gone, 1 without text, 2 without `.!?`, 3 twice, 4 said by a user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = numbered(turns).withColumn("kind", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copy = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "place", copy.alias("copy"))
    return rows.withColumn("place", F.col("place") * 2 + F.col("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repaired(damaged(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))


def _sql() -> str:
    """The same in DuckDB: a recursive query takes one turn of every conversation a round. It carries the repaired text too."""

    def turned(s: str, cost: str, letter: str, said: str) -> str:
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {s}.t || {said}}}"

    never, more = f"{{'c': {NEVER}::BIGINT, 'a': '', 't': ''}}", "(CASE WHEN r.truncated THEN 3 ELSE 0 END)"
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    kept, u, a = "r.role || ':' || r.text || chr(10)", "'user:' || r.text || chr(10)", "'assistant:' || r.text || chr(10)"
    only = lambda when, what: f"CASE WHEN NOT r.dropped AND {when} THEN {what} END"
    first = "list_min([f.s0, f.s1, f.s3])"
    best = lambda *of: f"list_min(list_filter([{', '.join(of)}], lambda x: x IS NOT NULL))"
    return f"""
WITH RECURSIVE {common.CRC_TABLE_SQL}, n AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ' '), coalesce(text, ' ')) AS place
  FROM conversations
), k AS (
  SELECT n.*, {common.crc_sql("name")} % 20 AS kind
  FROM n, crc
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, place * 2 + copy AS place,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k JOIN range(2) g(copy) ON copy = 0 OR kind = 3 WHERE kind <> 0
), b AS (
  SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY place) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen
  FROM d
), r AS (
  SELECT *, bare = '' AS blank, bare <> '' AND seen AS duplicate, bare <> '' AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated, bare = '' OR seen AS dropped,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM b
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal, count(*) AS n
  FROM r GROUP BY conv_id
), f AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {never} AS s1,
    {{'c': 3::BIGINT, 'a': 'I', 't': {user}}} AS s2, {{'c': 6::BIGINT, 'a': 'II', 't': {user} || {assistant}}} AS s3
  FROM conversations
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, list_min([s3, {turned("s2", "3", "I", assistant)}]) FROM (
    SELECT conv_id, i, s0, s1, list_min([s2, {turned("s0", "3", "I", user)}, {turned("s1", "3", "I", user)}, {turned("s3", "3", "I", user)}]) AS s2, s3 FROM (
      SELECT f.conv_id, r.i, {turned("f.s0", "4", "D", "''")} AS s0,
        {best(turned("f.s1", "4", "D", "''"), only("r.initial = 's'", turned("f.s0", more, "K", kept)))} AS s1,
        {best(turned("f.s2", "4", "D", "''"), only("r.initial = 'u'", turned(first, more, "K", kept)), only("true", turned(first, "3 + " + more, "R", u)))} AS s2,
        {best(turned("f.s3", "4", "D", "''"), only("r.initial = 'a'", turned("f.s2", more, "K", kept)), only("true", turned("f.s2", "3 + " + more, "R", a)))} AS s3
      FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1))
), done AS (
  SELECT f.conv_id, counted.* EXCLUDE (conv_id), list_min([s0, s3]) AS best
  FROM f LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM f.conv_id WHERE f.i = coalesce(counted.n, 0)
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit, sha256(CASE WHEN best.t = '' THEN '' ELSE left(best.t, length(best.t) - 1) END) AS repaired_sha256
FROM done
"""


SQL = _sql()
