"""Chat formatting by quotation linking.

A message's lines are parsed for their quote level (the number of > in front). Runs of lines of one level
between blank lines are passages; passages and their single lines are normalised and hashed. A hash's
original is the first message of its conversation that says it itself (level 0), so quoted hashes join
to at most one message each, however often a phrase is repeated. A message answers the message that most of
the text it quotes at level 1 comes from, and otherwise the one before it. A message's path are the turns from its
thread's root along the quotations down to itself, so the order of paths is the thread's reply order: each
message is followed by what answers it. The texts come without quotes and attribution lines.

A conversation may be of any size: only SPAN turns of it are ever handled together. A text is looked through a
fixed number of times, whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverflux.llm.common import discard, let, materialize

#: The marks in front of a quoted line: one class of characters, so that no run of them is tried twice.
QUOTE = r"^[ \t]*+>[> \t]*+"
BREAK = r"\r\n|\r|\n"
#: How the line ends with which mail programs announce a quotation, in a few languages.
ATTRIBUTION = r"(?i)\b(?:wrote|writes|said|schrieb|schreibt|a écrit|escribió)\s*+:$"
BLANK = " \t\n\r\f\v "
EDGE = BLANK + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Turns of a conversation that are handled together.
SPAN = 1024
MOST_ROUNDS = 64


def normal(text: Column) -> Column:
    """Lower case, single spaces, no punctuation at either end."""
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "), F.lit(EDGE))


def with_lines(text: Column, body) -> Column:
    """body(lines) of a text's lines: a struct of the arrays raw, level (of quotation) and body (what follows the marks).

    What the lambdas below refer to is bound by let(), so it is computed once a row wherever the optimizer moves the
    expression; a column of its own may be put in its place inside of a lambda and be computed for each line."""
    mark = lambda x: F.when(F.contains(x, F.lit(">")), F.regexp_extract(x, QUOTE, 0)).otherwise("")
    level = lambda m: F.length(m) - F.length(F.replace(m, F.lit(">"), F.lit("")))
    rest = lambda x, m: F.btrim(F.substring(x, F.length(m) + 1, F.length(x)), F.lit(BLANK))
    lines = lambda raw: let(F.transform(raw, mark), lambda m: F.struct(raw.alias("raw"), F.transform(m, level).alias("level"), F.zip_with(raw, m, rest).alias("body")))
    return let(let(F.split(F.coalesce(text, F.lit("")), BREAK), lines), body)


def units(lines: Column) -> Column:
    """The distinct passages and lines as texts level:size:hash."""
    raw, level, body = lines["raw"], (lambda i: F.get(lines["level"], i)), (lambda i: F.get(lines["body"], i))
    begins = lambda i: (body(i) != "") & ((i == 0) | (level(i - 1) != level(i)) | (body(i - 1) == ""))

    def of(starts: Column) -> Column:
        ends = lambda k: F.coalesce(F.get(starts, k + 1), F.size(raw))
        passages = F.transform(starts, lambda s, k: F.struct(level(s).alias("level"), normal(F.array_join(F.slice(lines["body"], s + 1, ends(k) - s), " ")).alias("body")))
        single = F.zip_with(lines["level"], lines["body"], lambda n, b: F.struct(n.alias("level"), normal(b).alias("body")))
        found = F.filter(F.concat(passages, single), lambda u: u["body"] != "")
        return F.array_distinct(F.transform(found, lambda u: F.concat_ws(":", u["level"].cast("string"), F.length(u["body"]).cast("string"), F.md5(u["body"]))))

    return let(F.filter(F.sequence(F.lit(0), F.size(raw) - 1), begins), of)


def without_quotes(lines: Column) -> Column:
    """The lines of level 0 but for those that announce a quotation, runs of blank lines as one."""
    raw, level, body = lines["raw"], lines["level"], lines["body"]
    announces = lambda i: F.coalesce(F.get(level, i + 1) > 0, F.lit(False)) & F.get(body, i).rlike(ATTRIBUTION)
    own = F.filter(F.sequence(F.lit(0), F.size(raw) - 1), lambda i: (F.get(level, i) == 0) & ~announces(i))
    blank = lambda at, k: F.coalesce(F.get(body, F.get(at, k)) == "", F.lit(True))
    kept = let(own, lambda at: F.filter(at, lambda i, k: (F.get(body, i) != "") | ~blank(at, k - 1)))
    return F.btrim(F.array_join(F.transform(kept, lambda i: F.get(raw, i)), "\n"), F.lit(BLANK))


def exploded(rows: DataFrame) -> DataFrame:
    """conv, turn, level, size, hash of each unit of messages."""
    u = F.split("u", ":")
    out = rows.select("conv", "turn", F.explode(with_lines(F.col("text"), units)).alias("u"))
    return out.select("conv", "turn", u[0].cast("int").alias("level"), u[1].cast("int").alias("size"), u[2].alias("hash"))


def before_each(turns: DataFrame) -> DataFrame:
    """conv, span, turn, previous: the turn before, found in spans so that no conversation is ordered at once."""
    spans = turns.withColumn("span", F.floor(F.col("turn") / SPAN))
    inside = spans.withColumn("p", F.lag("turn").over(Window.partitionBy("conv", "span").orderBy("turn")))
    ends = spans.groupBy("conv", "span").agg(F.max("turn").alias("end"))
    ends = ends.select(F.col("conv").alias("c"), F.col("span").alias("s"), F.lag("end").over(Window.partitionBy("conv").orderBy("span")).alias("end"))
    return inside.join(ends, (F.col("conv") == F.col("c")) & (F.col("span") == F.col("s")), "left").select("conv", "span", "turn", F.coalesce("p", "end").alias("previous"))


def paths_of(parents: DataFrame) -> DataFrame:
    """conv, turn, path (root to turn) of turns with a parent, by pointer doubling: after k rounds a row knows 2**k links."""
    known = materialize(parents.select("conv", "turn", F.col("parent").alias("top"), F.array("parent", "turn").alias("path")))
    for _ in range(MOST_ROUNDS):
        up = known.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("top").alias("higher"), F.col("path").alias("above"))
        cond = (F.col("conv") == F.col("c")) & (F.col("top") == F.col("t"))
        if known.join(up, cond, "left_semi").isEmpty():
            break
        longer = F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", F.slice("path", 2, F.size("path"))))
        further = materialize(known.join(up, cond, "left").select("conv", "turn", F.coalesce("higher", "top").alias("top"), longer.alias("path")))
        discard(known)
        known = further
    return known.drop("top")


def link_quotes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, text (without quotes), n_quoted and n_linked (distinct quoted
    passages and lines, and those whose original was found), reply_to (a turn), linked (whether by a
    quotation), depth (quotation links up to the thread's root), root_turn and path (the turns from the root to the
    message, by which a conversation is in reply order). The rows of up to SPAN turns of a conversation stand
    together in that order.

    Only earlier turns are answered. Null and empty texts quote nothing and stay, empty. Messages
    without a conversation or turn are kept and link with nothing; they have no path. Several messages with one turn
    are one node: what any of them quotes links that turn; repeated rows stay repeated. Original passages
    are looked for in the same conversation only. Other columns are not read.
    """
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    placed = rows.where("conv is not null and turn is not null")
    quoted = materialize(exploded(placed.where(F.contains("text", F.lit(">")))).where("level > 0"))
    # only hashes that are quoted somewhere are looked up, and each has one original in a conversation
    keys = materialize(quoted.select("conv", "hash").distinct())
    originals = exploded(placed).where("level = 0").join(keys, ["conv", "hash"], "left_semi") if not keys.isEmpty() else quoted
    originals = originals.groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    met = quoted.join(originals, ["conv", "hash"]).where("origin < turn")
    by_turn = met.groupBy("conv", "turn", "origin").agg(F.sum(F.when(F.col("level") == 1, F.col("size")).otherwise(0)).alias("direct"), F.count("*").alias("n"))
    best = by_turn.groupBy("conv", "turn").agg(F.max_by(F.when(F.col("direct") > 0, F.col("origin")), F.struct("direct", "origin")).alias("parent"), F.sum("n").alias("n_linked"))
    best = materialize(best)
    paths = paths_of(best.where("parent is not null"))

    nodes = before_each(placed.select("conv", "turn").distinct()).join(best, ["conv", "turn"], "left").join(paths, ["conv", "turn"], "left")
    info = F.struct(F.coalesce("parent", "previous").alias("reply_to"), F.col("parent").isNotNull().alias("linked"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("path", F.array("turn")).alias("path"))
    spans = nodes.groupBy(F.col("conv").alias("c"), F.col("span").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("turn", info.alias("info")))).alias("infos"))  # SPAN turns at most
    spans = materialize(spans)

    n_quoted = lambda lines: F.when(F.exists(lines["level"], lambda n: n > 0), F.size(F.filter(units(lines), lambda u: ~F.startswith(u, F.lit("0:"))))).otherwise(0)
    found = with_lines(F.col("text"), lambda lines: F.struct(without_quotes(lines).alias("clean"), n_quoted(lines).alias("n_quoted")))
    final = rows.select("conv", "turn", F.floor(F.col("turn") / SPAN).alias("span"), "role", found.alias("found")).select("conv", "turn", "span", "role", "found.*")
    # a merge join deals the texts by span once, whichever side is small, so that a span's messages stand together
    out = final.join(spans.hint("merge"), (F.col("conv") == F.col("c")) & (F.col("span") == F.col("s")), "left").withColumn("info", F.try_element_at("infos", F.col("turn")))
    path = F.col("info.path")
    out = out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("clean").alias(text_col), F.col("n_quoted").cast("long").alias("n_quoted"),
        F.coalesce("info.n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("info.reply_to").alias("reply_to"), F.coalesce("info.linked", F.lit(False)).alias("linked"),
        F.coalesce(F.size(path) - 1, F.lit(0)).cast("long").alias("depth"), F.coalesce(F.get(path, 0), F.col("turn")).alias("root_turn"), path.alias("path"),
    )
    return out.sortWithinPartitions(conv_col, "path", role_col)


def as_conversations(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each SPAN turns of a conversation: conversation, piece, messages (array of role, content) in
    reply order, from rows of link_quotes. Repeated messages count once, empty ones are left out."""
    rows = linked.where(F.col(conv_col).isNotNull() & F.col("path").isNotNull() & (F.col(text_col) != ""))
    message = F.struct("path", F.col(role_col).alias("role"), F.col(text_col).alias("content"))
    some = rows.groupBy(conv_col, F.floor(F.col(turn_col) / SPAN).alias("piece")).agg(F.array_sort(F.collect_set(message)).alias("m"))
    return some.select(conv_col, "piece", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def op3_quote_links(spark, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
