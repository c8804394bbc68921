"""Quotation linking: messages in reply order, without the passages they quote.

A line's quote level is the number of '>' before its text.  Blocks of one
level are quoted passages; the rest, without lines that only announce a quote
("... wrote:"), is the message's own text.  Own texts and quoted passages are
normalised (case, white space) and hashed as a whole, and by paragraph and
line of three words at least.  A quoted passage belongs to the first message of its conversation whose
own text has that hash and that comes before the quoting one; a message
replies to the message of its least nested linked quote, the latest if there
are several.  A message that links to none starts a branch.  Branches follow
one another by their first turn, and a branch's messages by turn, so replies
stand behind what they answer.

Positions are counted within blocks of turns and summed over blocks, so a
conversation may be of any length.

Defined cases: a null text is empty and quotes nothing; empty own texts stay
as empty messages; quotes that match nothing are removed all the same and
counted; rows of equal conversation and turn are ordered by role and text, and
a quote of either links to their turn; a null conversation is one of its own;
a null turn comes first, replies to nothing and is not replied to; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import drop, staged

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_ANNOUNCE = re.compile(r".*\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)
LEAST_WORDS = 3
_MESSAGE = "conv_id {conv}, turn {turn}, role string, text string, own array<long>, quoted array<struct<level: int, width: int, hash: long>>, n_quotes long"


def parse_message(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The own text, and the quoted blocks with their levels, in order."""
    own: list[str] = []
    blocks: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        m = _QUOTE.match(line)
        level = m[1].count(">") if m else 0
        if level:
            if last == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and _ANNOUNCE.match(own[-1]):
                    own.pop()
            if level != last:
                blocks.append((level, []))
            blocks[-1][1].append(line[m.end() :])
        else:
            own.append(line)
        last = level
    return "\n".join(own).strip(), [(k, "\n".join(b)) for k, b in blocks if any(x.strip() for x in b)]


def passage_hashes(text: str) -> list[tuple[int, int]]:
    """(width, hash) of the normalised text: 0 the whole, 1 its paragraphs, 2 its lines; parts of fewer than LEAST_WORDS words say too little to link by."""
    seen: dict[int, int] = {}
    for width, parts in enumerate(([text], re.split(r"\n[ \t]*\n", text), text.split("\n"))):
        for p in parts:
            norm = " ".join(p.lower().split())
            if norm and (width == 0 or norm.count(" ") >= LEAST_WORDS - 1):
                seen.setdefault(xxhash.xxh3_64_intdigest(norm.encode("utf-8", "surrogatepass")) - (1 << 63), width)
    return [(w, h) for h, w in seen.items()]


def parsed_messages(messages: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    conv, at = (messages.schema[c].dataType.simpleString() for c in (conv_id, turn))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quote = pa.list_(pa.struct([("level", pa.int32()), ("width", pa.int32()), ("hash", pa.int64())]))
        for b in batches:
            texts, own, quoted, n = [], [], [], []
            for t in b.column(3):
                mine, blocks = parse_message(t.as_py())
                texts.append(mine)
                own.append([h for _, h in passage_hashes(mine)])
                quoted.append([{"level": k, "width": w, "hash": h} for k, x in blocks for w, h in passage_hashes(x)])
                n.append(len(blocks))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(texts, pa.string()), pa.array(own, pa.list_(pa.int64())), pa.array(quoted, quote), pa.array(n, pa.int64())], names=["conv_id", "turn", "role", "text", "own", "quoted", "n_quotes"])

    own = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(parse, _MESSAGE.format(conv=conv, turn=at))


def _same(x, y, *names):
    out = x[names[0]].eqNullSafe(y[names[0]])
    for n in names[1:]:
        out = out & x[n].eqNullSafe(y[n])
    return out


def reply_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked) of the messages with a linked quote."""
    quotes = parsed.where("n_quotes > 0 and turn is not null").select("conv_id", "turn", F.inline("quoted"))
    wanted = quotes.select("conv_id", "hash").distinct()
    owners = parsed.where("turn is not null").select("conv_id", F.col("turn").alias("owner"), F.explode("own").alias("hash"))
    owners = owners.join(wanted, _same(owners, wanted, "conv_id", "hash"), "left_semi").groupBy("conv_id", "hash").agg(F.min("owner").alias("owner"))
    linked = quotes.join(owners, _same(quotes, owners, "conv_id", "hash")).where(F.col("owner") < F.col("turn")).select(quotes["conv_id"], "turn", "level", "width", "owner")
    best = F.min(F.struct("level", (-F.col("owner")).alias("late"), "width"))
    return linked.groupBy("conv_id", "turn").agg((-best.getField("late")).alias("parent_turn"), F.count_distinct("owner").alias("n_linked"))


def branch_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root): the first ancestor of each replying message, by doubling the links."""
    now = staged(links.select("conv_id", "turn", F.col("parent_turn").alias("root")), "roots")
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("above"))
        after = now.join(up, now["conv_id"].eqNullSafe(up["c"]) & (now["root"] == up["t"]), "left").select("conv_id", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        after = staged(after, "roots")
        drop(now)
        now = after.drop("moved")
        now._factloom_path = after._factloom_path
        if after.where("moved").isEmpty():
            return now


def reply_ordered(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 4096) -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, branch, position, n_quotes, n_linked, chat): chat is the message as a line of a transcript."""
    parsed = staged(parsed_messages(messages, conv_id, turn, role, text), "messages")
    links = staged(reply_links(parsed), "replies")
    roots = branch_roots(links)
    out = parsed.drop("own", "quoted")
    full = links.join(roots, _same(links, roots, "conv_id", "turn")).select(links["conv_id"].alias("c"), links["turn"].alias("t"), "parent_turn", "n_linked", "root")
    out = out.join(full, out["conv_id"].eqNullSafe(full["c"]) & (out["turn"] == full["t"]), "left").withColumn("branch", F.coalesce("root", "turn"))
    out = out.withColumn("_block", F.floor(F.coalesce(F.col("branch"), F.lit(0)) / block))
    counts = out.groupBy(F.col("conv_id").alias("c2"), F.col("_block").alias("b2")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("c2").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("c2", "b2", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inner = Window.partitionBy("conv_id", "_block").orderBy("branch", "turn", "role", "text")
    out = out.withColumn("_place", F.row_number().over(inner)).join(counts, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("_block") == F.col("b2")))
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    return out.select("conv_id", "turn", "role", "text", "parent_turn", "branch", (F.col("first") + F.col("_place") - 1).cast("long").alias("position"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), chat.alias("chat"))
