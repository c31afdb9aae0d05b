"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels: the number of ``>`` in front, each with blanks around it. A run of lines
of one level above 0 is a quoted passage, level 0 is the message's own text. Passages and own paragraphs are
normalised (A-Z lower-cased, words of letters, digits and bytes past ASCII, single spaces) and hashed with XXH64 and their word
count; a passage is linked to the latest earlier message of the same conversation that holds the same text: as a line,
as its whole own text, or as a run of consecutive lines. Runs skip lines without words, and are known by a 127-bit
rolling hash of their lines: of the originals, runs of those lengths are hashed that the conversation's quotes have. A message answers the one that its shallowest
passage links to; without a link it answers the message before it. Own text without quotes is kept.

Messages carry the hashes of their own text; those hashes that some quote of the conversation has bring the normalised
text with them, and texts are compared by it (but for runs), so a hash collision links nothing. Equal passages are
counted once a message, and of a conversation's equal originals only the latest one before the quote is taken by a
window over the numbers, so no pairs within a group are made. Conversations are ordered by reply: ``position`` is a
message's place in depth-first order of the reply tree, found by ranking the tour of its chains.

Edge cases: a quote without words is no passage; a null text is an empty message; a message of nothing but quotes stays,
with empty text. Turns that repeat are ordered by role and text, and equal rows are one message. Null conversation ids
form one conversation, null turns come first. Very long texts are read whole; further columns are left out, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamcover.llm.common import add_columns, alnum_words, checkpointed, emit, quoted, read_table

#: Of the hash of runs of lines.
PRIME, BASE = (1 << 127) - 1, 0x5BD1E9955BD1E9955BD1E995
#: Turns that one task numbers at once.
RANGE = 1024
FIELDS = {"body": "string", "quotes": "array<struct<level:int,hash:long,norm:string,run:string,lines:int>>", "held": "array<long>"}
#: Rows of 16 bytes that are broadcast at most.
SMALL = 1 << 18


def parse(text: str) -> list[tuple[int, list[str]]]:
    """Runs of lines of equal quote level, without their marks."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        level, rest = 0, line
        while (cut := rest.lstrip(" \t")).startswith(">"):
            level, rest = level + 1, cut[1:]
        rest = rest.removeprefix(" ") if level else line
        if runs and runs[-1][0] == level:
            runs[-1][1].append(rest)
        else:
            runs.append((level, [rest]))
    return runs


def normalised(text: str) -> str:
    return b" ".join(alnum_words(text.encode("utf-8", "replace"))).decode("utf-8", "replace")


def line_digests(lines: list[str]) -> list[int]:
    """Of the lines that have words."""
    return [xxhash.xxh3_128_intdigest(x) % PRIME for x in map(normalised, lines) if x]


def line_runs(digests: list[int], size: int) -> list[str]:
    """Keys of all runs of ``size`` lines; no normalised text begins with a line feed."""
    out, h, top = [], 0, pow(BASE, size, PRIME)
    for i, x in enumerate(digests):
        h = (h * BASE + x - (digests[i - size] * top if i >= size else 0)) % PRIME
        if i >= size - 1:
            out.append(f"\n{size}:{h:032x}")
    return out


def text_hash(norm: str) -> int:
    return xxhash.xxh64_intdigest(norm) - (1 << 63)


def _quote(level: int, text: str) -> dict | None:
    norm, lines = normalised(text), line_digests(text.split("\n"))
    run = line_runs(lines, len(lines))[0] if len(lines) > 1 else None
    return {"level": level, "hash": text_hash(norm), "norm": norm, "run": run, "lines": len(lines)} if norm else None


def own_texts(body: str) -> set[str]:
    """The normalised own text of a message, as a whole and line by line."""
    return {normalised(body), *map(normalised, body.split("\n"))} - {""}


def quotes(text: bytes | None) -> tuple[str, list[dict], list[int]]:
    """A message without its quotes, its quoted passages, and the hashes of its own texts."""
    runs = parse((text or b"").decode("utf-8", "replace"))
    body = "\n".join(line for level, lines in runs if not level for line in lines).strip("\n")
    found = {(level, q["norm"], q["run"]): q for level, lines in runs if level and (q := _quote(level, "\n".join(lines)))}
    return body, list(found.values()), sorted(map(text_hash, own_texts(body)))


def link(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages with ``number`` (0-based in the conversation), ``body``, ``reply_to`` (number, null for the first),
    ``n_quotes`` and ``n_linked`` passages, ``depth`` and ``position`` in reply order."""

    def run(texts):
        body, found, held = zip(*map(quotes, texts), strict=True) if texts else ((), (), ())
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("norm", pa.string()), ("run", pa.string()), ("lines", pa.int32())]))
        return {"body": list(body), "quotes": pa.array(found, kind), "held": pa.array(held, pa.list_(pa.int64()))}

    rows = df.select(quoted(conversation).alias("c"), quoted(turn).alias("t"), quoted(role).alias("r"), quoted(text).alias("x")).distinct()
    rows = checkpointed(rows.withColumn("b", F.floor(F.col("t") / F.lit(RANGE))))
    first = rows.groupBy("c", "b").agg(F.count("*").alias("n"))
    first = first.select(F.col("c").alias("fc"), F.col("b").alias("fb"), (F.sum("n").over(Window.partitionBy("c").orderBy("b")) - F.col("n")).alias("before"))
    order = Window.partitionBy("c", "b").orderBy("t", "r", F.xxhash64("x"), "x")
    numbered = rows.join(first, F.col("c").eqNullSafe(F.col("fc")) & F.col("b").eqNullSafe(F.col("fb")))
    numbered = numbered.select("c", "t", "r", "x", (F.col("before") + F.row_number().over(order) - 1).cast("long").alias("number"))
    messages = checkpointed(add_columns(numbered, "x", run, FIELDS, ["c", "t", "r", "number"]))
    passages = messages.where(F.size("quotes") > 0).select("c", "number", F.explode("quotes").alias("p")).select("c", "number", "p.*")
    none = F.lit(0).cast("long")
    before = F.when(F.col("number") > 0, F.col("number") - 1)
    if passages.isEmpty():
        return _reply_order(messages.select("c", "t", "r", "number", "body", before.alias("reply_to"), none.alias("n_quotes"), none.alias("n_linked"))).select(*_names(conversation, turn, role))
    parts = passages.unionByName(_originals(messages, passages))
    sizes = parts.where("lines > 1").groupBy("c").agg(F.collect_set("lines").alias("sizes")).select(F.col("c").alias("sc"), "sizes")
    sized = messages.join(sizes, F.col("c").eqNullSafe(F.col("sc"))).select("c", "number", "body", "sizes")

    def runs(batches):
        for batch in batches:
            for c, number, body, sizes in zip(*batch.columns, strict=True):
                lines = line_digests(body.as_py().split("\n"))
                found = sorted({r for size in sizes.as_py() for r in line_runs(lines, size)})
                for a in range(0, len(found), 1 << 12):
                    k = len(found[a : a + (1 << 12)])
                    yield {"c": pa.array([c.as_py()] * k, batch.schema.field(0).type), "number": pa.array([number.as_py()] * k, pa.int64()), "norm": found[a : a + (1 << 12)]}

    held = emit(sized.withColumn("number", F.col("number").cast("long")), runs, f"c {parts.schema['c'].dataType.simpleString()}, number long, norm string")
    texts = parts.select("c", "number", "level", "hash", "norm", F.col("norm").alias("passage"))
    asked = parts.where("lines > 1").select("c", "number", "level", none.alias("hash"), F.col("run").alias("norm"), F.col("norm").alias("passage"))
    held = held.select("c", "number", F.lit(0).alias("level"), none.alias("hash"), "norm", F.lit(None).cast("string").alias("passage"))
    parts = texts.unionByName(asked).unionByName(held)
    # One sort by (passage, number) brings each quote behind the originals before it.
    same = Window.partitionBy("c", "hash", "norm").orderBy("number").rangeBetween(Window.unboundedPreceding, -1)
    seen = parts.withColumn("origin", F.max(F.when(F.col("level") == 0, F.col("number"))).over(same)).where("level > 0").groupBy("c", "number", "level", "passage").agg(F.max("origin").alias("origin"))
    replies = seen.groupBy("c", "number").agg(
        F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"), F.min(F.when(F.col("origin").isNotNull(), F.struct("level", (-F.col("origin")).alias("o")))).alias("first")
    )
    joined = messages.alias("m").join(replies.alias("q"), F.col("m.c").eqNullSafe(F.col("q.c")) & (F.col("m.number") == F.col("q.number")), "left")
    known = joined.select(
        "m.c", "m.t", "m.r", "m.number", "m.body",
        F.when(F.col("m.number") > 0, F.coalesce(-F.col("q.first.o"), F.col("m.number") - 1)).alias("reply_to"),
        F.coalesce("q.n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("q.n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    return _reply_order(known).select(*_names(conversation, turn, role))


def _names(conversation: str, turn: str, role: str) -> list:
    return [F.col("c").alias(conversation), F.col("t").alias(turn), F.col("r").alias(role), "number", "body", "reply_to", "n_quotes", "n_linked", "depth", "position"]


def _originals(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """Own texts of messages as passages of level 0: those whose hash a quote of the same conversation has."""
    asked = checkpointed(passages.select(F.col("c").alias("ac"), F.col("hash").alias("ah")).distinct())
    side = F.broadcast(asked) if asked.limit(SMALL + 1).count() <= SMALL else asked
    met = messages.select("c", "number", F.explode("held").alias("h")).join(side, F.col("c").eqNullSafe(F.col("ac")) & (F.col("h") == F.col("ah")), "left_semi")
    met = met.groupBy("c", "number").agg(F.collect_set("h").alias("hashes")).select(F.col("c").alias("mc"), F.col("number").alias("mn"), "hashes")
    named = messages.join(met, F.col("c").eqNullSafe(F.col("mc")) & (F.col("number") == F.col("mn"))).select("c", "number", "body", "hashes")

    def texts(batches):
        for batch in batches:
            for c, number, body, hashes in zip(*batch.columns, strict=True):
                wanted = set(hashes.as_py())
                norms = sorted(x for x in own_texts(body.as_py()) if text_hash(x) in wanted)
                k = len(norms)
                yield {"c": pa.array([c.as_py()] * k, batch.schema.field(0).type), "number": [number.as_py()] * k, "level": [0] * k, "hash": list(map(text_hash, norms)), "norm": norms, "run": [None] * k, "lines": [0] * k}

    return emit(named, texts, f"c {messages.schema['c'].dataType.simpleString()}, number long, level int, hash long, norm string, run string, lines int")


def _reply_order(messages: DataFrame) -> DataFrame:
    """Adds depth and position: depth-first order of the reply tree, replies to a message by number.

    Messages that each answer the one before form a chain, and are neighbours in that order. Behind a chain come the
    chains that answer its messages, those of the last message first. A tour of the chains goes into each and out
    again; the places along it are found by pointer doubling, with rows of fixed size however deep the tree is.
    """
    part = F.floor(F.col("number") / F.lit(RANGE))
    start = F.when(F.col("reply_to").isNull() | (F.col("reply_to") < F.col("number") - 1), F.col("number"))
    rows = messages.withColumn("b", part).withColumn("start", start)
    before = rows.groupBy("c", "b").agg(F.max("start").alias("m"))
    before = before.select(F.col("c").alias("fc"), F.col("b").alias("fb"), F.max("m").over(Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    here = F.max("start").over(Window.partitionBy("c", "b").orderBy("number"))
    chained = rows.join(before, F.col("c").eqNullSafe(F.col("fc")) & (F.col("b") == F.col("fb"))).withColumn("chain", F.coalesce(here, F.col("open")))
    chained = chained.drop("fc", "fb", "open", "b", "start")
    answers = rows.where("start > 0").select("c", F.col("start").alias("chain"), F.col("reply_to").alias("parent"))
    inside = F.col("number") - F.col("chain")
    if answers.isEmpty():  # one chain a conversation
        return chained.withColumn("depth", inside).withColumn("position", inside)
    chained = checkpointed(chained)
    tree = checkpointed(_toured(chained))
    placed = chained.join(tree, F.col("c").eqNullSafe(F.col("tc")) & (F.col("chain") == F.col("tn")))
    return placed.withColumn("depth", F.col("tdepth") + inside).withColumn("position", F.col("begin") + inside)


def _toured(chained: DataFrame) -> DataFrame:
    """(tc, tn, tdepth, begin) of the chains: depth and place of their first messages."""
    sizes = chained.groupBy("c", "chain").agg(F.count("*").alias("n"), F.max(F.when(F.col("number") == F.col("chain"), F.col("reply_to"))).alias("parent"))
    member = chained.select(F.col("c").alias("pc"), F.col("number").alias("pn"), F.col("chain").alias("up"))
    tree = sizes.join(member, F.col("c").eqNullSafe(F.col("pc")) & (F.col("parent") == F.col("pn")), "left").select("c", "chain", "n", "parent", "up")
    siblings = Window.partitionBy("c", "up").orderBy(F.desc("parent"), "chain")
    tree = checkpointed(tree.withColumn("next", F.when(F.col("up").isNotNull(), F.lead("chain").over(siblings))).withColumn("rank", F.when(F.col("up").isNotNull(), F.row_number().over(siblings))))
    child = tree.where("rank = 1").select(F.col("c").alias("cc"), F.col("up").alias("cu"), F.col("chain").alias("child"))
    tree = tree.join(child, F.col("c").eqNullSafe(F.col("cc")) & (F.col("chain") == F.col("cu")), "left")
    # step 2 * chain goes in, step 2 * chain + 1 out; going in passes n messages and parent + 1 - up levels
    levels = F.coalesce(F.col("parent") + 1 - F.col("up"), F.lit(0))
    into = F.struct((2 * F.col("chain")).alias("step"), F.coalesce(2 * F.col("child"), 2 * F.col("chain") + 1).alias("to"), F.col("n").alias("left"), levels.alias("down"))
    out = F.struct((2 * F.col("chain") + 1).alias("step"), F.coalesce(2 * F.col("next"), 2 * F.col("up") + 1).alias("to"), F.lit(0).cast("long").alias("left"), (-levels).alias("down"))
    tour = checkpointed(tree.select("c", F.explode(F.array(into, out)).alias("s")).select("c", "s.*"))
    while not tour.where("to IS NOT NULL").isEmpty():  # left, down: sums over the steps from this one up to ``to``
        ahead = tour.select(F.col("c").alias("ac"), F.col("step").alias("as"), F.col("to").alias("ato"), F.col("left").alias("aleft"), F.col("down").alias("adown"))
        tour = checkpointed(tour.join(ahead, F.col("c").eqNullSafe(F.col("ac")) & (F.col("to") == F.col("as")), "left").select(
            "c", "step", F.col("ato").alias("to"), (F.col("left") + F.coalesce("aleft", F.lit(0))).alias("left"), (F.col("down") + F.coalesce("adown", F.lit(0))).alias("down"),
        ))
    whole = tour.where("step = 0").select(F.col("c").alias("wc"), F.col("left").alias("all"))
    places = tour.where("step % 2 = 0").join(whole, F.col("c").eqNullSafe(F.col("wc")))
    # what is left from a step on tells what came before it; going in and out cancel, so -down is the depth outside
    own = tree.select(F.col("c").alias("oc"), F.col("chain").alias("on"), levels.alias("levels"))
    found = places.join(own, F.col("c").eqNullSafe(F.col("oc")) & (F.col("step") == 2 * F.col("on")))
    return found.select(F.col("c").alias("tc"), F.col("on").alias("tn"), (F.col("levels") - F.col("down")).cast("long").alias("tdepth"), (F.col("all") - F.col("left")).alias("begin"))


def formatted(linked: DataFrame, conversation: str = "conv_id", role: str = "role", part: int = RANGE) -> DataFrame:
    """Conversations as ``messages`` (role, content) in reply order, those without own text left out.

    A row holds ``part`` places of a conversation; longer ones go on in rows of the next part numbers.
    """
    spoken = linked.where(F.col("body") != "").withColumn("part", F.floor(F.col("position") / F.lit(part)))
    lists = spoken.groupBy(conversation, "part").agg(F.array_sort(F.collect_list(F.struct("position", F.col(role).alias("role"), F.col("body").alias("content")))).alias("m"))
    return lists.select(conversation, "part", F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("messages"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "conversations"))
