"""Chat formatting by quotation linking.

Quote levels of each message are parsed (``>`` marks, however nested or spaced, and the attribution line before them).
Quoted passages are normalised and hashed, and joined to the messages whose own text holds them: the latest
earlier message of the same conversation, or else the first message of the first other conversation. Quotes are then
taken out, and each conversation is ordered by reply: a message that answers an earlier one than its predecessor opens
a branch, which stands right after the message it answers.

A passage of any length is linked within its conversation. In others only passages of ``least_chars`` normalised
characters or more are looked up, since "yes, agreed" says nothing about where it comes from.

Passages are joined by hash to one or two originals each (minima and maxima are taken before the shuffle), so a passage
that very many messages share makes no pairs. Running values over a conversation are taken in stretches of TURNS and
then over the stretches, so a conversation of any length is never handled whole. Places in the reply order come from
list ranking by pointer jumping over pieces of branches: the rounds grow with the logarithm of the pieces.

Defined results: a null text is an empty message; a null turn counts as turn -1, which may be negative or of any
size; a row without conversation is a message that is linked with nothing and has no place; rows that repeat a
conversation and turn are all kept, share a place, and answer and are answered alike; a quote without original leaves
the message's place as it is.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, map_rows, shared_dir, stored

TURNS = 1000  # turns of a stretch
LEAST_CHARS = 12  # default of ``least_chars``

_MARK = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)(.*)$")
_WROTE = re.compile(r"^\s*(?:On\b.{0,200}\bwrote|Am\b.{0,200}\bschrieb.{0,80}|Le\b.{0,200}\ba écrit|El\b.{0,200}\bescribió|.{1,80}\b(?:wrote|schrieb|a écrit|escribió))\s*:\s*$", re.IGNORECASE)


def levels(text: str) -> list[tuple[int, str]]:
    """Passages of a message in order, as (quote level, text): lines of one level that follow each other."""
    out: list[tuple[int, list[str]]] = []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        m = _MARK.match(line)
        level, rest = (m[1].count(">"), m[2]) if m else (0, line)
        if not level and _WROTE.match(line):
            following = next((x for x in lines[i + 1 :] if x.strip()), "")
            if _MARK.match(following):  # the attribution belongs to the quote
                continue
        if out and out[-1][0] == level:
            out[-1][1].append(rest)
        else:
            out.append((level, [rest]))
    return [(level, "\n".join(found).strip()) for level, found in out if any(x.strip() for x in found)]


def normal(text: str) -> str:
    """Letters and digits of a passage, case-folded, words apart by one space."""
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text).casefold()))


def passage_hashes(text: str) -> dict[int, int]:
    """Hashes of a passage, of its paragraphs and of its lines, with their normalised lengths."""
    parts = {normal(text), *(normal(x) for x in re.split(r"\n\s*\n", text)), *(normal(x) for x in text.split("\n"))}
    return {int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big", signed=True): len(p) for p in sorted(parts) if p}


def parse(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, own, hashes, quotes): the text without quotes, the hashes of its passages, and the quoted
    passages as (level, hash, chars)."""

    def rows(parts):
        for part in parts:
            own, hashes, quotes = [], [], []
            for t in part["text"]:
                found = levels(t or "")
                mine = "\n".join(x for level, x in found if level == 0)
                own.append(mine)
                hashes.append(sorted({h for level, x in found if level == 0 for h in passage_hashes(x)}))
                quotes.append([{"level": level, "hash": h, "chars": n} for level, x in found if level for h, n in passage_hashes(x).items()])
            yield [part["conv"], part["turn"], part["role"], own, hashes, quotes]

    columns = df.select(df[conversation].cast("string").alias("conv"), F.coalesce(df[turn].cast("long"), F.lit(-1)).alias("turn"), df[role].alias("role"), df[text].alias("text"))
    return map_rows(columns, "conv string, turn long, role string, own string, hashes array<long>, quotes array<struct<level int, hash long, chars int>>", rows)


def links(messages: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(conv, turn, to_conv, to_turn, level): the message that each quoting message answers, from its
    outermost quotes that have an original."""
    quoted = messages.where("size(quotes) > 0 and conv is not null").select("conv", "turn", F.explode("quotes").alias("q")).select("conv", "turn", "q.level", "q.hash", "q.chars").distinct()
    wanted = quoted.select("hash").distinct()
    held = messages.where("conv is not null").select("conv", "turn", F.explode("hashes").alias("hash")).join(wanted, "hash", "left_semi")
    # The two first conversations that hold a passage, so that there is one beside the quoting conversation itself.
    holders = held.groupBy("hash", "conv").agg(F.min("turn").alias("turn")).withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy("conv"))).where("n <= 2")
    first = holders.groupBy("hash").agg(F.min(F.struct("conv", "turn")).alias("f"), F.max(F.struct("conv", "turn")).alias("g"))
    # The latest earlier turn that holds a passage is a running maximum, so a passage that recurs makes no pairs.
    events = held.select("conv", "hash", "turn", F.lit(True).alias("holds")).unionByName(quoted.select("conv", "hash", "turn", F.lit(False).alias("holds")))
    near = _running(events.groupBy("conv", "hash", "turn").agg(F.max("holds").alias("holds")), F.when(F.col("holds"), F.col("turn")), "to_turn", strict=True, keys=("conv", "hash")).where("to_turn is not null").select("conv", "hash", "turn", "to_turn")
    placed = quoted.join(near, ["conv", "hash", "turn"], "left").join(first, "hash", "left")
    own = F.col("to_turn").isNotNull()
    other = F.when(F.col("f.conv") != F.col("conv"), F.col("f")).otherwise(F.col("g"))
    elsewhere = (other["conv"] != F.col("conv")) & (F.col("chars") >= least_chars)
    found = placed.where(own | elsewhere).select("conv", "turn", "level", own.alias("own"), F.when(own, F.col("conv")).otherwise(other["conv"]).alias("to_conv"), F.when(own, F.col("to_turn")).otherwise(other["turn"]).alias("to_turn"))
    # Originals in the conversation before others; then the outermost level; then the latest.
    best = found.groupBy("conv", "turn").agg(F.min(F.struct((~F.col("own")).alias("other"), "level", (-F.col("to_turn")).alias("minus"), "to_conv")).alias("b"))
    return best.select("conv", "turn", F.col("b.to_conv").alias("to_conv"), (-F.col("b.minus")).alias("to_turn"), F.col("b.level").alias("level"))


def _running(df: DataFrame, value: Column, name: str, strict: bool, keys: tuple[str, ...] = ("conv",)) -> DataFrame:
    """``df`` (keys and turn, unique) with the running maximum of ``value`` over the turns of its keys, up to the row, or
    before it where ``strict``."""
    cut = df.withColumn("_v", value).withColumn("_c", F.floor(F.col("turn") / TURNS))
    tops = cut.groupBy(*keys, "_c").agg(F.max("_v").alias("_m"))
    carried = tops.withColumn("_carry", F.max("_m").over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "_c", "_carry")
    inside = F.max("_v").over(Window.partitionBy(*keys, "_c").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    return cut.withColumn("_in", inside).join(carried, [*keys, "_c"]).withColumn(name, F.greatest("_in", "_carry")).drop("_v", "_c", "_in", "_carry")


def _numbered(turns: DataFrame) -> DataFrame:
    """(conv, turn, previous, number): the turn before and the number of turns before, stretch by stretch."""
    cut = turns.withColumn("_c", F.floor(F.col("turn") / TURNS))
    sizes = cut.groupBy("conv", "_c").agg(F.count("*").alias("_n"), F.max("turn").alias("_m"))
    before = Window.partitionBy("conv").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select("conv", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.max("_m").over(before).alias("_last"))
    inside = Window.partitionBy("conv", "_c").orderBy("turn")
    marked = cut.withColumn("_in", F.row_number().over(inside) - 1).withColumn("_lag", F.lag("turn").over(inside)).join(carried, ["conv", "_c"])
    return marked.select("conv", "turn", F.coalesce("_lag", "_last").alias("previous"), (F.col("_before") + F.col("_in")).alias("number"))


def _ranks(pieces: DataFrame) -> DataFrame:
    """(conv, piece, start): the place of the first message of each piece. A piece is a run of messages of one branch that is
    cut only after messages which are answered by branches; (conv, piece, last, previous, opens, branch, p, answered, n).

    The reply order is a list of tokens: a piece is entered (kind 0), then, if branches answer its last message, left
    (kind 1) after them. Every token knows its follower; pointer jumping sums the messages from a token to the end."""
    pieces = stored(pieces, "chat-list")
    openers = pieces.where("opens").select("conv", F.col("piece").alias("turn"), "p")
    siblings = _running(openers, F.col("turn"), "prior", strict=True, keys=("conv", "p")).select("conv", "p", F.col("turn").alias("b"), "prior").checkpoint()
    ends = pieces.where("answered").select("conv", F.col("last").alias("p"), F.col("piece").alias("out"))
    following = pieces.where("not opens and previous is not null").select("conv", F.col("previous").alias("last"), F.col("piece").alias("next"))
    sibling = siblings.where("prior is not null").select("conv", F.col("prior").alias("branch"), F.col("b").alias("sibling"))
    answered = siblings.select("conv", F.col("b").alias("branch"), "p").join(ends, ["conv", "p"]).select("conv", "branch", "out")
    down = siblings.where("prior is null").select("conv", F.col("p").alias("last"), F.col("b").alias("down"))
    known = pieces.join(following, ["conv", "last"], "left").join(sibling, ["conv", "branch"], "left").join(answered, ["conv", "branch"], "left").join(down, ["conv", "last"], "left")
    token = lambda turn, kind: F.when(turn.isNotNull(), F.struct(turn.alias("turn"), F.lit(kind).alias("kind")))
    after = F.coalesce(token(F.col("next"), 0), token(F.col("sibling"), 0), token(F.col("out"), 1))
    enter = known.select("conv", token(F.col("piece"), 0).alias("token"), F.coalesce(token(F.col("down"), 0), after).alias("to"), F.col("n").cast("long").alias("rest"))
    leave = known.where("answered").select("conv", token(F.col("piece"), 1).alias("token"), after.alias("to"), F.lit(0).cast("long").alias("rest"))
    # Stored, not checkpointed: a checkpoint keeps the estimated size, which a join with itself squares each round.
    tokens = stored(enter.unionByName(leave), "chat-tokens")
    while tokens.where("to is not null").limit(1).count():
        before = tokens
        ahead = tokens.select("conv", F.col("token").alias("to"), F.col("to").alias("beyond"), F.col("rest").alias("more"))
        tokens = tokens.join(ahead, ["conv", "to"], "left").select("conv", "token", F.col("beyond").alias("to"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest"))
        tokens = stored(tokens, "chat-tokens")
        drop_stored(before)
    total = pieces.groupBy("conv").agg(F.sum("n").alias("total"))
    return tokens.where("token.kind = 0").join(total, "conv").select("conv", F.col("token.turn").alias("piece"), (F.col("total") - F.col("rest")).alias("start"))


def conversations(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per message: conversation, turn, role, its text without quotes, ``reply_to`` (turn) and
    ``reply_to_conv``, the number of quoted passages and the level that was linked, ``branch`` (the turn that opened its
    branch, null on the main line), ``place`` (number of the message in the reply order of its conversation, from 0) and
    ``formatted``, the message in chat markup."""
    shared_dir(df.sparkSession)
    messages = stored(parse(df, conversation, turn, role, text), "chat-messages")
    found = stored(links(messages, least_chars), "chat-links")
    turns = _numbered(messages.where("conv is not null").select("conv", "turn").distinct())
    placed = turns.join(found, ["conv", "turn"], "left")
    opens = F.coalesce((F.col("to_conv") == F.col("conv")) & (F.col("to_turn") < F.col("previous")), F.lit(False))
    marked = stored(_running(placed.withColumn("opens", opens), F.when(opens, F.col("turn")), "branch", strict=False), "chat-branches")

    if marked.where("opens").limit(1).count():
        answered = marked.where("opens").select("conv", F.col("to_turn").alias("turn")).distinct()
        mine = marked.join(answered.withColumn("answered", F.lit(True)), ["conv", "turn"], "left")
        cut = mine.join(answered.select("conv", F.col("turn").alias("previous"), F.lit(True).alias("after")), ["conv", "previous"], "left")
        begins = F.col("opens") | F.col("previous").isNull() | F.col("after")
        cut = stored(_running(cut, F.when(begins, F.col("turn")), "piece", strict=False), "chat-pieces")
        whole = F.struct("previous", "opens", "to_turn", "branch")
        pieces = cut.groupBy("conv", "piece").agg(
            F.max("turn").alias("last"), F.count("*").alias("n"), F.min("number").alias("number"), F.max(F.coalesce("answered", F.lit(False))).alias("answered"), F.min_by(whole, "turn").alias("w"),
        ).select("conv", "piece", "last", "n", "number", "answered", "w.previous", "w.opens", F.when(F.col("w.opens"), F.col("w.to_turn")).alias("p"), "w.branch")
        shift = _ranks(pieces).join(pieces.select("conv", "piece", "number"), ["conv", "piece"]).select("conv", "piece", (F.col("start") - F.col("number")).alias("shift"))
        ordered = cut.join(shift, ["conv", "piece"]).withColumn("place", F.col("number") + F.col("shift"))
    else:
        cut, ordered = None, marked.withColumn("place", F.col("number"))
    order = ordered.select("conv", "turn", F.coalesce("to_turn", "previous").alias("reply_to"), F.coalesce("to_conv", F.when(F.col("previous").isNotNull(), F.col("conv"))).alias("reply_to_conv"), "level", "branch", "place")
    full = messages.join(order, ["conv", "turn"], "left")
    kind = df.schema[conversation].dataType
    out = stored(full.select(
        F.col("conv").cast(kind).alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), F.col("own").alias(text), "reply_to", F.col("reply_to_conv").cast(kind).alias("reply_to_conv"),
        F.size("quotes").alias("quoted"), F.col("level").alias("linked_level"), "branch", "place",
        F.concat(F.lit("<|"), F.coalesce(F.col("role"), F.lit("unknown")), F.lit("|>\n"), "own", F.lit("\n<|end|>\n")).alias("formatted"),
    ), "chat-conversations")
    for done in (messages, found, marked, cut):
        if done is not None:
            drop_stored(done)
    return out
