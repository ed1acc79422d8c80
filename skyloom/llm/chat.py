"""Chat formatting by quotation linking. DataFrame functions only.

A message's lines have a quote level: the number of `>` before them. Lines of one level that follow one another
without a blank one are a passage. Every passage gives three kinds of units: itself with its line breaks as spaces,
its sentences, and its lines; so a quotation is found when it was wrapped anew and when it repeats only a part. Units
are normalised and hashed; the message of a conversation that first wrote a unit as its own is its original. A message
replies to the original of most of the words that it quotes at the shallowest level found, else to the message before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .store import written

CHUNK = 1024
#: A quote mark, lines that introduce a quotation, ends of sentences.
_MARK = "^[ \\t]*((>[ \\t]?)+)"
_INTRO = "(^|[^\\p{L}])(wrote|schrieb|a écrit|escribió)([^\\p{L}].*)?:[ \\t]*$"
_STOP = "([.!?])[ \\t]+"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, units, content, quote_level): units are structs (passage, level, kind, hash, words), kind 0 for passages, 1 for sentences, 2 for lines; content has neither quotes nor their introductions."""
    m = messages.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\x01\x02", "  "), "\\r?\\n", -1).alias("raw"))
    m = m.withColumn("levels", F.expr(f"transform(raw, x -> char_length(regexp_replace(regexp_extract(x, {_lit(_MARK)}, 1), '[^>]', '')))"))
    m = m.withColumn("bare", F.expr(f"transform(raw, (x, i) -> IF(levels[i] > 0, regexp_replace(x, {_lit(_MARK)}, ''), x))"))
    own = f"filter(transform(raw, (x, i) -> IF(levels[i] = 0 AND NOT (coalesce(get(levels, i + 1), 0) > 0 AND x RLIKE {_lit(_INTRO)}), x, NULL)), x -> x IS NOT NULL)"
    # A line that goes on with its passage is put after \x01, one that starts another after \x02 and its level.
    joined = "array_join(transform(bare, (x, i) -> IF(i > 0 AND levels[i] = levels[i - 1] AND trim(x) <> '' AND trim(bare[i - 1]) <> '', concat('\\u0001', x), concat('\\u0002', levels[i], ' ', x))), '')"
    m = m.withColumn("passages", F.expr(f"transform(filter(split({joined}, '\\u0002', -1), p -> p <> ''), p -> named_struct('level', cast(substring_index(p, ' ', 1) AS int), 'x', substring(p, char_length(substring_index(p, ' ', 1)) + 2)))"))
    plain = "lower(trim(regexp_replace({}, '[\\\\s\\\\p{{Punct}}]+', ' ')))"
    whole = "translate(p.x, '\\u0001', ' ')"
    kinds = (("0", f"array({whole})"), ("1", f"split(regexp_replace({whole}, {_lit(_STOP)}, '$1\\u0001'), '\\u0001', -1)"), ("2", "split(p.x, '\\u0001', -1)"))
    each = ", ".join(f"transform({parts}, u -> element_at(transform(array({plain.format('u')}), n -> named_struct('passage', i, 'level', p.level, 'kind', {k}, 'hash', xxhash64(n), 'words', size(split(n, ' ')), 'some', n <> '')), 1))" for k, parts in kinds)
    units = f"filter(flatten(transform(passages, (p, i) -> concat({each}))), u -> u.some)"
    return m.select("conv_id", "turn", "role", F.expr(units).alias("units"), F.trim(F.array_join(F.expr(own), "\n"), F.lit(" \t\n")).alias("content"), F.coalesce(F.array_max("levels"), F.lit(0)).alias("quote_level"))


def _placed(rows: DataFrame, turns: DataFrame, starts: DataFrame) -> DataFrame:
    """`rows` with `at`, the last of starts (conv_id, start, root) at or before the turn: within chunks of turns, then over chunks, so that one long conversation is many groups."""
    starts = starts.select("conv_id", F.floor(F.col("start") / CHUNK).alias("chunk"), F.struct("start", "root").alias("s"))
    chunks = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk")).distinct()
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.join(starts.groupBy("conv_id", "chunk").agg(F.max("s").alias("last"), F.collect_set("s").alias("starts")), ["conv_id", "chunk"], "left")
    none = F.expr("named_struct('start', 0L, 'root', 0L)")
    chunks = chunks.select("conv_id", "chunk", F.coalesce(F.max("last").over(before), none).alias("earlier"), "starts")
    out = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK)).join(chunks, ["conv_id", "chunk"], "left")
    return out.withColumn("at", F.coalesce(F.expr("array_max(filter(starts, s -> s.start <= turn))"), "earlier")).drop("chunk", "starts", "earlier")


def _rooted(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """(conv_id, start, root): the thread of each section of starts (conv_id, start, original), by pointer jumping."""
    alone = starts.select("conv_id", "start", F.col("start").alias("root"))
    if starts.isEmpty():
        return alone
    turns = rows.select("conv_id", "turn")
    tips = _placed(turns, turns, alone).where("at IS NOT NULL").groupBy("conv_id", F.col("at.start").alias("up")).agg(F.max("turn").alias("original"))
    opened = starts.join(starts.select("conv_id", F.col("start").alias("original")), ["conv_id", "original"], "left_semi").select("conv_id", "start", F.col("original").alias("up"))
    ended = starts.groupBy("conv_id", "original").agg(F.min("start").alias("start")).join(tips, ["conv_id", "original"]).select("conv_id", "start", "up")
    up = written(opened.unionByName(ended).distinct(), "up")
    while True:
        further = up.select("conv_id", F.col("start").alias("up"), F.col("up").alias("up2"))
        after = written(up.join(further, ["conv_id", "up"], "left").select("conv_id", "start", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")), "up")
        up = after.select("conv_id", "start", "up")
        if after.where("moved").isEmpty():
            return starts.join(up, ["conv_id", "start"], "left").select("conv_id", "start", F.coalesce("up", "start").alias("root"))


def _with_previous(rows: DataFrame) -> DataFrame:
    """`rows` with `previous`, the conversation's last turn before this one: within chunks of turns, then over chunks, so that one long conversation is many groups."""
    turns = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct().withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    ends = turns.groupBy("conv_id", "chunk").agg(F.max("turn").alias("end"))
    ends = ends.select("conv_id", "chunk", F.lag("end").over(Window.partitionBy("conv_id").orderBy("chunk")).alias("earlier"))
    within = F.lag("turn").over(Window.partitionBy("conv_id", "chunk").orderBy("turn"))
    turns = turns.withColumn("within", within).join(ends, ["conv_id", "chunk"], "left").select("conv_id", "turn", F.coalesce("within", "earlier").alias("previous"))
    return rows.join(written(turns, "previous"), ["conv_id", "turn"], "left")


def link_quotations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, content, reply_to, linked, thread, quote_level, n_quoted, n_found, formatted) for each row.

    n_quoted and n_found: quoted passages, and those of which a unit has an earlier message as its original.
    reply_to: the original of most words at the shallowest quote level that has one (then the later one), by the kind of
    unit that finds most (linked); else the conversation's last turn before; null for its first. A linked message that
    doesn't answer the turn before starts a section, which reaches to the next such message. The section belongs to
    the thread of the message answered if that one starts a section itself or ends one and is answered here first;
    else it starts a thread, whose number is its turn. Missing turns are passed over. A passage that several messages
    wrote counts as the first one's. A null text is empty; rows with a null conversation or turn are linked with
    nothing and have a null thread. Rows that repeat get the same answer each. Other columns are not read; an empty
    table gives no rows.
    """
    rows = written(_with_previous(parsed(messages, conv, turn, role, text)), "messages")
    unit = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "previous", F.explode("units").alias("x")).select("conv_id", "turn", "previous", "x.*")
    first = unit.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quoted = unit.where("level > 0").select("conv_id", "turn", "previous", "passage", "level", "kind", "hash", "words").distinct()
    met = quoted.join(first, ["conv_id", "hash"]).where("original < turn")
    votes = met.groupBy("conv_id", "turn", "previous", "original", "level", "kind").agg(F.sum("words").alias("w"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "w", "original"))["original"]
    found = met.groupBy("conv_id", "turn").agg(F.count_distinct("passage").alias("n_found"))
    links = written(votes.groupBy("conv_id", "turn", "previous").agg(best.alias("original")).join(found, ["conv_id", "turn"]), "links")
    starts = links.where("original <> previous").select("conv_id", F.col("turn").alias("start"), "original")
    out = _placed(rows, rows, _rooted(rows, starts)).join(links.drop("previous"), ["conv_id", "turn"], "left")
    quotes = F.expr("size(array_distinct(transform(filter(units, x -> x.level > 0), x -> x.passage)))").cast("long")
    return out.select(
        "conv_id", "turn", "role", "content", F.coalesce("original", "previous").alias("reply_to"), F.col("original").isNotNull().alias("linked"), F.col("at.root").alias("thread"), F.col("quote_level").cast("int").alias("quote_level"), quotes.alias("n_quoted"),
        F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "content").alias("formatted"),
    )


def in_reply_order(linked: DataFrame) -> DataFrame:
    """The conversations, one after another, each by thread and turn, with `position`: a row's place in its conversation, from 0.

    Ranges of rows, so a long conversation may span partitions. Positions are those within a range; for conversations
    that span several, which are no more than there are ranges, the rows of earlier ranges are added. Rows without a
    conversation have no position.
    """
    order = ["conv_id", "thread", "turn", F.xxhash64("role", "content")]
    ranged = linked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ordered")
    parts = written(ranged.where("conv_id IS NOT NULL").groupBy("conv_id", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")), "parts")
    wide = parts.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.join(wide, "conv_id", "left_semi").select("conv_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = ranged.join(parts.select("conv_id", "_part", "_first"), ["conv_id", "_part"], "left").join(moved, ["conv_id", "_part"], "left")
    placed = placed.withColumn("position", (F.col("_id") - F.col("_first") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_id", "_part", "_first", "_before")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)
