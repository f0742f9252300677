"""Chat formatting of reply trees, with DataFrame functions only.

A message names the message that it answers. Root-to-leaf paths come from iterative
self-joins: a table of ancestors 1, 2, 4, ... replies up is joined with itself, and each
round doubles the part of every leaf's path that is known. Branches are ranked by score,
and each chosen path becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts a
backslash becomes ``\\e``, ``<`` becomes ``\\l``, ``[`` becomes ``\\b`` and, in roles, a line
feed becomes ``\\n``: no control string of this or of ``<s>``/``[INST]`` templates is left in
them, and every backslash starts one of these four, so that the text can be had back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

START, END = "<|im_start|>", "<|im_end|>\n"
#: Roles whose texts are learned from.
OWN = ("assistant",)
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, line_feed: bool = False) -> Column:
    for old, new in ESCAPES:
        c = _replace(c, old, new)
    return _replace(c, "\n", "\\n") if line_feed else c


def unescape(c: Column, line_feed: bool = False) -> Column:
    c = _replace(c, "\\n", "\n") if line_feed else c
    for old, new in reversed(ESCAPES):
        c = _replace(c, new, old)
    return c


def chain(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of linear conversations: each answers the one before it.

    Order: turn (nulls first), then role and text, so that repeated turns all stay.
    """
    w = Window.partitionBy("tree").orderBy(F.col("at").asc_nulls_first(), "role", "text")
    return (
        turns.select(F.col(conv).alias("tree"), F.col(turn).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("node", F.row_number().over(w).cast("long"))
        .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
    )


def paths(nodes: DataFrame) -> DataFrame:
    """``tree, leaf, node, up`` for every message of every root-to-leaf path; ``up`` counts replies from the leaf.

    ``nodes``: tree, node, parent (each node once in its tree). A parent that isn't there
    makes a root. Messages that answer each other in a circle have no root: paths that
    run into them aren't conversations and are left out.
    """
    own = nodes.select("tree", "node")
    have = own.alias("p")
    jump = nodes.where("parent is not null").select("tree", "node", "parent").alias("n")
    jump = jump.join(have, F.expr("n.tree <=> p.tree and n.parent = p.node")).select("n.tree", "n.node", F.col("n.parent").alias("anc"))
    jump, at = materialise(jump, "chat-jump")
    old = [at]
    leaves = own.alias("n").join(jump.alias("j"), F.expr("n.tree <=> j.tree and n.node = j.anc"), "left_anti")
    found, at = materialise(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "chat-paths")
    old.append(at)
    hops, most = 1, own.count()
    while live := jump.count():
        if hops > most:
            break
        more = found.alias("f").join(jump.alias("j"), F.expr("f.tree <=> j.tree and f.node = j.node")).select("f.tree", "f.leaf", F.col("j.anc").alias("node"), (F.col("f.up") + hops).alias("up"))
        found, f_at = materialise(found.unionByName(more), "chat-paths")
        twice = jump.alias("a").join(jump.alias("b"), F.expr("a.tree <=> b.tree and a.anc = b.node")).select("a.tree", "a.node", "b.anc")
        jump, j_at = materialise(twice, "chat-jump")
        release(nodes.sparkSession, *old)
        old = [f_at, j_at]
        hops *= 2
    if live:
        found = found.alias("f").join(jump.alias("j"), F.expr("f.tree <=> j.tree and f.leaf = j.node"), "left_anti")
    return found


def format_trees(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """One conversation for each chosen path: ``tree, leaf, score, rank, formatted, loss``.

    ``nodes``: tree, node, parent, score, role, text; more columns don't matter. A path's
    score is the sum of its messages' scores (null: 0); the ``best`` paths of a tree are
    kept (None: all), ties to the smaller leaf. ``loss`` lists the spans (first code point
    from 1, length) of the assistant's texts. Texts of any length are formatted whole; a path's texts
    meet in one row, as they are one conversation, those of other paths don't move. A null role or text counts as empty; of rows
    with the same tree and node the one with the highest score, then the smallest role and
    text stays; a null node can't be answered and stands for itself only if it is a tree's
    only one. No rows in, no rows out.
    """
    nodes = nodes.select("tree", F.coalesce("node", F.lit(-1).cast("long")).alias("node"), "parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.min_by(F.struct("parent", "score", "role", "text"), F.struct(-F.col("score"), "role", "text", "parent"))
    nodes, _ = materialise(nodes.groupBy("tree", "node").agg(first.alias("m")).select("tree", "node", "m.*"), "chat-nodes")
    at = paths(nodes)
    # branches are ranked before any text moves
    same = F.expr("p.tree <=> n.tree and p.node = n.node")
    ranked = at.alias("p").join(nodes.select("tree", "node", "score").alias("n"), same).groupBy("p.tree", "p.leaf").agg(F.sum("n.score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    ranked, _ = materialise(ranked, "chat-ranked")
    chosen = at.alias("p").join(ranked.alias("r"), F.expr("p.tree <=> r.tree and p.leaf = r.leaf")).select("p.tree", "p.leaf", "p.node", "p.up", F.col("r.score").alias("sum"), "r.rank")
    turns = chosen.alias("p").join(nodes.alias("n"), same).select("p.tree", "p.leaf", "p.up", "p.sum", "p.rank", F.col("n.role").isin(*OWN).alias("own"), escape(F.col("n.role"), True).alias("role"), escape(F.col("n.text")).alias("text"))
    turns = turns.withColumn("head", F.concat(F.lit(START), "role", F.lit("\n")))
    w = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    whole = F.length("head") + F.length("text") + len(END)
    turns = turns.withColumn("from", (F.sum(whole).over(w) - F.length("text") - len(END) + 1).cast("int"))
    piece = F.struct((-F.col("up")).alias("k"), F.concat("head", "text", F.lit(END)).alias("s"), "own", "from", F.length("text").alias("n"))
    out = turns.groupBy("tree", "leaf").agg(F.first("sum").alias("score"), F.first("rank").alias("rank"), F.array_sort(F.collect_list(piece)).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["own"]), lambda x: F.struct(x["from"].alias("from"), x["n"].alias("n")))
    return out.select("tree", "leaf", "score", "rank", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"), spans.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        n = F.length(role)
        text = F.substring(p, n + 2, F.length(p) - n - 1 - len(END))
        return F.struct(unescape(role, True).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def under_mask(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["from"], s["n"]))), "")


def digests(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back from the output."""
    out = format_trees(chain(conversations)).withColumn("turns", parse(F.col("formatted"))).withColumn("masked", under_mask(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b'), chr(10), '\n') AS er,
    replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b') AS et,
    role = 'assistant' AS own
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN own THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS masked,
    CAST(sum(24 + length(er) + length(et)) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(masked) AS loss_chars, sha256(masked) AS loss_sha256, formatted_chars FROM g
"""
