"""Reply trees formatted as training conversations, in DataFrame functions only.

Messages name the message they reply to. Iterated self-joins double the step of every reply's
link to an ancestor, so that a tree of depth d takes log2(d) rounds; the same tables, applied to
the leaves, enumerate the messages of every root-to-leaf path. Replies to one message are ranked
by score, and only paths whose every branch ranks among the first ``keep`` are chosen. Each
chosen path is formatted as one conversation.

In the template every turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside
texts, those of other common templates too, get one backslash after their first character, and
so do those that have backslashes there already; taking one away gives the text back. Roles are
percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.llm.quality import let
from evigrid.plans.lineage import written

START, END = "<|im_start|>", "<|im_end|>\n"
_REST = r"(?=\|im_(?:start|end)\|>|/?s>|</?SYS>>|/?INST\])"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2")


def _row(df: DataFrame, *names: str | None) -> Column:
    return F.struct(*(df[f"`{c}`"] for c in names if c)).alias("row")


def numbered(messages: DataFrame, id_col: str = "msg_id", parent_col: str = "parent_id", score_col: str | None = "score") -> tuple[DataFrame, DataFrame]:
    """``(contents, nodes)``: the rows with a number each (``node``), and ``(node, parent, score, tie)``.

    Every row is a node, repeated ones too. A parent is the first row (by role and text) that has
    the id; a null parent and one that no row has make a root. A null id has no replies.
    """
    contents = written(messages.select(F.monotonically_increasing_id().alias("node"), _row(messages, id_col, parent_col, score_col, "role", "text")), "messages")
    ident, parent = F.col(f"row.`{id_col}`"), F.col(f"row.`{parent_col}`")
    score = F.col(f"row.`{score_col}`").cast("double") if score_col else F.lit(0.0)
    order = F.struct(F.col("row.role").alias("a"), F.xxhash64("row.text").alias("b"), F.col("node").alias("node"))
    ids = contents.where(ident.isNotNull()).groupBy(ident.alias("parent_id")).agg(F.min(order)["node"].alias("parent"))
    nodes = contents.select("node", parent.alias("parent_id"), score.alias("score"), ident.alias("tie")).join(ids, "parent_id", "left")
    return contents, nodes.select("node", "parent", "score", "tie")


def chained(rows: DataFrame, group_col: str = "conv_id", turn_col: str = "turn") -> tuple[DataFrame, DataFrame]:
    """``(contents, nodes)`` of plain conversations: each turn replies to the one before it.

    Null turns come first, equal turns go by role and text; rows with a null conversation are one
    conversation. The texts take no part in the sort.
    """
    contents = written(rows.select(F.monotonically_increasing_id().alias("node"), _row(rows, group_col, turn_col, "role", "text")), "turns")
    light = contents.select("node", F.col(f"row.`{group_col}`").alias("g"), F.col(f"row.`{turn_col}`").alias("t"), F.col("row.role").alias("r"), F.xxhash64("row.text").alias("h"))
    before = F.lag("node").over(Window.partitionBy("g").orderBy(F.asc_nulls_first("t"), "r", "h", "node"))
    return contents, light.select("node", before.alias("parent"), F.lit(0.0).alias("score"), F.col("node").alias("tie"))


def paths(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """``(leaf, node, up, rank)``: the messages of every chosen root-to-leaf path, ``up`` steps above
    its leaf; ``rank`` is a message's place among the replies to its parent (roots: 1).

    ``keep=None`` chooses all paths. Replies go by score, highest first, null scores last, equal
    ones by id. A message that replies to itself, however indirectly, and what hangs on it
    have no root and are in no path. No replies are ever gathered: a message that a third of
    all others answer is one row on one side of a join.
    """
    replies = nodes.where("parent IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc_nulls_last("score"), "tie", "node"))
    ranked = replies.select("node", "parent", place.alias("rank"))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)  # taken before the shuffle as well
    ranked = written(ranked, "replies")
    steps = [ranked.select("node", F.col("parent").alias("above"))]
    left = last = steps[0].count()
    while last:
        if 2 ** len(steps) > 2 * left:
            break  # all that is left goes round in circles
        a, b = steps[-1].alias("a"), steps[-1].alias("b")
        further = written(a.join(b, F.col("a.above") == F.col("b.node")).select("a.node", "b.above"), "jumps")
        last = further.count()
        if last:
            steps.append(further)
    roots = nodes.where("parent IS NULL").select("node", F.lit(1).alias("rank"))
    chosen = roots.unionByName(ranked.select("node", "rank"))
    leaves = chosen.select("node").join(ranked.select(F.col("parent").alias("node")), "node", "left_anti")
    if last:
        leaves = leaves.join(steps.pop().select("node"), "node", "left_anti")
    found = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    for k, step in enumerate(steps):
        above = found.join(step, "node").select("leaf", F.col("above").alias("node"), (F.col("up") + 2**k).alias("up"))
        found = written(found.unionByName(above), "paths")
    whole = found.join(chosen, "node").select("leaf", "node", "up", "rank")
    if keep is None:
        return whole
    # What hangs on a reply that was not taken has no root left.
    return whole.join(found.join(roots, "node").select("leaf"), "leaf", "left_semi")


def formatted(contents: DataFrame, chosen: DataFrame, first: str | None = None) -> DataFrame:
    """``(leaf, first, formatted, loss, ranks)`` for each chosen path.

    ``loss`` has the spans (``start``, ``end``, in UTF-8 bytes of ``formatted``) of the assistant's
    texts, which alone are learned; ``ranks`` those of the path's branches; ``first`` the named
    column of its root. Null roles and texts are empty. A path is one string, so its messages meet
    in the task that makes it.
    """
    role, text = (F.coalesce(F.col(f"row.{c}"), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), F.url_encode(role), F.lit("\n"))
    given = F.col(f"row.`{first}`") if first else F.lit(None).cast("string")
    parts = contents.select("node", head.alias("head"), escaped(text).alias("body"), (role == LEARNED).alias("learned"), given.alias("first"))
    rows = chosen.join(parts, "node")
    order = Window.partitionBy("leaf").orderBy(F.desc("up"))
    size = F.octet_length("head") + F.octet_length("body") + len(END)
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END)
    rows = rows.select("leaf", (-F.col("up")).alias("at"), "rank", "first", "learned", F.concat("head", "body", F.lit(END)).alias("piece"), F.octet_length("body").alias("n"), end.alias("end"))
    turn = F.struct("at", "rank", "first", "learned", "piece", (F.col("end") - F.col("n")).alias("start"), "end")
    whole = rows.groupBy("leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    t = F.col("turns")
    return whole.select(
        "leaf",
        t[0]["first"].alias("first"),
        F.array_join(t["piece"], "").alias("formatted"),
        F.transform(F.filter(t, lambda x: x["learned"]), lambda x: F.struct(x["start"], x["end"])).alias("loss"),
        t["rank"].alias("ranks"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """``(first, roles, texts, learned, formatted)`` from the formatted string and its spans alone."""
    pieces = F.split(F.col("formatted"), r"<\|im_end\|>\n", -1)
    whole = F.struct(pieces.alias("p"), F.col("formatted").cast("binary").alias("raw"))
    held = made.select("first", "formatted", "loss", F.explode(F.array(whole)).alias("h"))  # holds it fixed
    turns = F.slice(F.col("h.p"), 1, F.size("h.p") - 1)
    head = lambda x: F.substring_index(x, "\n", 1)
    cut = lambda s: F.substr(F.col("h.raw"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string")
    return held.select(
        "first",
        F.transform(turns, lambda x: F.url_decode(F.substr(head(x), F.lit(len(START) + 1)))).alias("roles"),
        F.transform(turns, lambda x: let(F.length(head(x)), lambda n: unescaped(F.substr(x, n + 2)))).alias("texts"),
        F.transform("loss", lambda s: unescaped(cut(s))).alias("learned"),
        "formatted",
    )


def digests(made: DataFrame, name: str = "conv_id") -> DataFrame:
    """Digests of what ``read_back`` finds: ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``."""
    found = read_back(made)
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    learned = F.array_join("learned", "")
    return found.select(
        F.col("first").alias(name),
        F.size("texts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def reply_trees(messages: DataFrame, keep: int | None = 1, id_col: str = "msg_id", parent_col: str = "parent_id", score_col: str | None = "score") -> DataFrame:
    """``(leaf, first, formatted, loss, ranks)`` of the chosen paths of all trees; ``leaf`` and ``first``
    are the ids of a path's last and first message.

    Needs the id, parent and score columns named, ``role`` and ``text``; others are not looked at,
    whatever their names. An empty table gives none. See ``numbered`` for repeated and null ids,
    ``paths`` for ties and circles, ``formatted`` for nulls; very long texts are kept whole.
    """
    contents, nodes = numbered(messages, id_col, parent_col, score_col)
    made = formatted(contents, paths(nodes, keep), id_col)
    ends = contents.select(F.col("node").alias("leaf"), F.col(f"row.`{id_col}`").alias("_id"))
    return made.join(ends, "leaf").select(F.col("_id").alias("leaf"), "first", "formatted", "loss", "ranks")


def conversations(rows: DataFrame) -> DataFrame:
    """``(leaf, first, formatted, loss, ranks)`` of plain conversations ``(conv_id, turn, role, text)``;
    ``first`` is the conversation. Nulls, ties and repeated rows as in ``chained``; an empty table gives none."""
    contents, nodes = chained(rows)
    return formatted(contents, paths(nodes), "conv_id")
