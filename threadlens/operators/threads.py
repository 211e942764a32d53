"""Rebuild support threads from a flat table of messages.

Graph model. Messages are nodes; each has at most one parent pointer
(``in_response_to_tweet_id``) and a list of responses (``response_tweet_id``).
Walking starts from the support account's messages and follows

* listed responses, forward only,
* the parent pointer, upward,
* replies to the current message (reverse parent), downward,

always only to messages present in the table.

Plan. Parent and reverse-parent edges make every weakly connected component of
the parent graph mutually reachable, so the walk never has to cross a tree one
message at a time. Instead:

0. ``graph_rows``: one row per id. Of repeated ids the last row in the input counts (parent,
   listed responses, author, text); its older rows still are replies to their parents,
   which the walk follows downward only, and any of them may be a seed.
1. ``resolve_roots`` (C5) labels every message with the end of its parent chain
   by pointer doubling: O(log depth) rounds of one join each, only over the
   messages not yet resolved. Messages on or leading into a parent cycle keep
   their own id (the original's rule) and stay separate units.
2. The root is the unit id. Listed responses that cross units, plus the parent
   edges of cycle members, form a unit graph that is tiny next to the messages.
3. ``reachable_units`` (C3) walks that unit graph from the seed units. After two plain
   steps the visited units also take the pairs that are exactly 2^r steps apart (the square
   of the relation before), so a path of n units takes about log2(n) rounds.

Hot keys: a message with millions of replies makes its id a hot join key. The
jumps join the unresolved side on ``ptr`` against a side unique on ``id``; hot
pointers are split off and joined by broadcast (``skew.split_hot_join``), and
resolved rows leave the loop, so a hot root is joined once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.rules import SUPPORT_AUTHOR, SUPPORT_HANDLES
from threadlens.functions.text import parse_id_list
from threadlens.operators.ordering import CHUNK_ROWS, ordinal_within
from threadlens.operators.skew import HOT_ROWS, split_hot_join
from threadlens.session import cut_lineage
from threadlens.sources.tables import input_order


def graph_rows(messages: DataFrame, support_author: str = SUPPORT_AUTHOR, handles=SUPPORT_HANDLES,
               order=None) -> DataFrame:
    """One row per message id: ``parent`` (as written) and ``listed`` of its last row by
    ``order`` (default: the order of the input), ``keep`` (that row is written by the support
    account or mentions a handle), ``seed`` (any row is) and ``n`` rows."""
    order = input_order(messages) if order is None else order
    is_support = F.coalesce(F.lower(F.col("author_id")) == F.lit(support_author.lower()), F.lit(False))
    mention = F.lit(False)
    for h in handles:
        mention = mention | F.coalesce(F.col("text").contains(h), F.lit(False))
    rows = (messages.select(F.col("tweet_id").alias("id"), order.alias("_o"), is_support.alias("seed"),
                            F.struct(F.col("in_response_to_tweet_id").alias("parent"), F.col("response_tweet_id").alias("listed"),
                                     (is_support | mention).alias("keep")).alias("_r"))
            .filter(F.col("id").isNotNull()))
    return (rows.groupBy("id").agg(F.max_by("_r", "_o").alias("_r"), F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
            .select("id", "_r.parent", "_r.listed", "_r.keep", "seed", "n"))


def older_reply_edges(messages: DataFrame, graph: DataFrame) -> DataFrame:
    """Edges (src, dst) parent -> id of every row of the ids that have several rows."""
    again = graph.filter(F.col("n") > 1).select("id")
    rows = (messages.filter(F.col("in_response_to_tweet_id").isNotNull())
            .select(F.col("in_response_to_tweet_id").alias("src"), F.col("tweet_id").alias("id")))
    return rows.join(again, "id").select("src", F.col("id").alias("dst")).distinct() \
        .join(graph.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")


def message_nodes(graph: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, parent) of ``graph_rows`` with the parent nulled when it is absent (C5 stops
    there). Messages without a parent stay out of the join, and parents with very many
    replies are split off in it."""
    raw = graph.select("id", "parent")
    having = raw.filter(F.col("parent").isNotNull())
    found = split_hot_join(having, raw.select(F.col("id").alias("parent")), "parent", hot_rows=hot_rows, n_facts=having.count())
    return raw.select("id").join(found, "id", "left").select("id", "parent")


def latest_messages(messages: DataFrame, row_order: str) -> DataFrame:
    """One row per message id: the last by ``row_order`` (equal values: the largest
    row). Rows without an id are dropped, as everywhere here."""
    row = F.struct(*messages.columns)
    key = F.struct(F.col(row_order).alias("_o"), F.xxhash64(*messages.columns).alias("_h"))
    return (messages.filter(F.col("tweet_id").isNotNull()).groupBy("tweet_id")
            .agg(F.max_by(row, key).alias("_r")).select("_r.*"))


def resolve_roots(nodes: DataFrame, max_rounds: int = 64, hot_rows: int = HOT_ROWS,
                  materialized: bool = False) -> DataFrame:
    """(id, parent) -> (id, root).

    root = last message of the parent chain (null parent); a message on or
    leading into a cycle gets its own id. A self-parent is a cycle.

    Round r keeps for each unresolved message the pointer 2^r steps up. A
    message resolves when its pointer reaches a resolved message. If a round
    resolves nothing, no unresolved message can ever reach a chain end (the
    closest one would have resolved), so the rest are cycle members.
    """
    nodes = nodes.select("id", "parent") if materialized else cut_lineage(nodes.select("id", "parent"))
    done_parts = [nodes.filter(F.col("parent").isNull()).select("id", F.col("id").alias("root"))]
    active = nodes.filter(F.col("parent").isNotNull()).select("id", F.col("parent").alias("ptr"))
    n_active = active.count()
    rounds = 0
    while n_active:
        if rounds == max_rounds:
            raise RuntimeError(f"{n_active} messages are unresolved after {max_rounds} rounds")
        rounds += 1
        state = (spark_union(done_parts).select("id", F.lit(None).cast("bigint").alias("s_ptr"),
                                                F.col("root").alias("s_root"))
                 .unionByName(active.select("id", F.col("ptr").alias("s_ptr"),
                                            F.lit(None).cast("bigint").alias("s_root"))))
        # one materialised jump per round; both outcomes are read from it
        # a message with a huge number of replies is a hot pointer: split it off
        j = cut_lineage(split_hot_join(active, state.withColumnRenamed("id", "ptr"), "ptr", hot_rows=hot_rows, n_facts=n_active)
                        .select("id", "s_ptr", "s_root"))
        counts = j.agg(F.count_if(F.col("s_root").isNotNull()).alias("resolved"),
                       F.count_if(F.col("s_root").isNull()).alias("open")).first()
        if counts["resolved"] == 0:
            break
        done_parts.append(j.filter(F.col("s_root").isNotNull()).select("id", F.col("s_root").alias("root")))
        active = j.filter(F.col("s_root").isNull()).select("id", F.col("s_ptr").alias("ptr"))
        n_active = counts["open"]
    cyclic = active.select("id", F.col("id").alias("root"))
    return spark_union(done_parts + [cyclic])


def spark_union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def thread_edges(graph: DataFrame, nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Directed edges (src, dst) between present messages: listed
    responses, parent pointers and reverse parent pointers.

    With ``roots`` given, parent edges are kept only for messages on or leading
    into a cycle (root = own id, parent present): every other parent edge joins
    two messages of the same tree, which the unit graph does not need."""
    ids = nodes.select(F.col("id").alias("dst"))
    listed = (graph.select(F.col("id").alias("src"), F.explode(parse_id_list("listed")).alias("dst"))
              .join(ids, "dst", "left_semi"))
    with_parent = nodes.filter(F.col("parent").isNotNull())
    if roots is not None:
        cyc = roots.filter(F.col("root") == F.col("id")).select("id")
        with_parent = with_parent.join(cyc, "id", "left_semi")
    up = with_parent.select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return listed.select("src", "dst").unionByName(up).unionByName(down).distinct()


PLAIN_ROUNDS = 2      # most closures end here, before any shortcut is built
SHORTCUT_GROWTH = 4   # shortcuts may outnumber the edges by this factor


def reachable_units(seed_units: DataFrame, unit_edges: DataFrame, max_rounds: int | None = None,
                    rounds: list | None = None) -> DataFrame:
    """C3 on the unit graph: closure of ``seed_units`` (column ``unit``) over ``unit_edges``
    (src, dst). A round joins the visited units with the edges and with the pairs exactly
    2^r steps apart; squaring those pairs gives the next round's. On trees, chains and rings
    they never outnumber the units; where a dense graph makes them outgrow the edges (its
    paths are short), the last ones are kept. Runs until a round finds nothing; with
    ``max_rounds`` it raises where that bound is passed. ``rounds`` collects the units found."""
    edges = cut_lineage(unit_edges.select("src", "dst").distinct())
    n_edges = edges.count()
    visited = cut_lineage(seed_units.select("unit").distinct())
    hop, power, growing, done = None, edges, True, 0
    while n_edges:
        step = edges if hop is None else edges.unionByName(hop)
        found = visited.join(step.withColumnRenamed("src", "unit"), "unit").select(F.col("dst").alias("unit")).distinct()
        found = cut_lineage(found.join(visited, "unit", "left_anti"))
        n = found.count()
        if n == 0:
            break
        done += 1
        if rounds is not None:
            rounds.append(n)
        if max_rounds is not None and done > max_rounds:
            raise RuntimeError(f"the closure is not complete after {max_rounds} rounds")
        visited = cut_lineage(visited.unionByName(found))
        if done >= PLAIN_ROUNDS and growing:
            square = cut_lineage(power.select("src", F.col("dst").alias("mid"))
                                 .join(power.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct())
            pairs = square.count()
            growing = 0 < pairs <= SHORTCUT_GROWTH * n_edges + 1000
            if growing:
                hop = power = square
    return visited


def support_thread_ids(messages: DataFrame, support_author: str = SUPPORT_AUTHOR,
                       handles=SUPPORT_HANDLES, roots: DataFrame | None = None,
                       nodes: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """Ids of messages in the support closure that are written by the
    support account or mention one of ``handles`` (case-sensitive)."""
    graph = graph if graph is not None else cut_lineage(graph_rows(messages, support_author, handles))
    nodes = nodes if nodes is not None else cut_lineage(message_nodes(graph))
    roots = roots if roots is not None else resolve_roots(nodes)
    edges = thread_edges(graph, nodes, roots)
    if graph.filter(F.col("n") > 1).head(1):
        edges = edges.unionByName(older_reply_edges(messages, graph))
    unit = roots.select("id", F.col("root").alias("unit"))
    unit_edges = (edges.join(unit.withColumnRenamed("id", "src").withColumnRenamed("unit", "u_src"), "src")
                  .join(unit.withColumnRenamed("id", "dst").withColumnRenamed("unit", "u_dst"), "dst")
                  .filter(F.col("u_src") != F.col("u_dst"))
                  .select(F.col("u_src").alias("src"), F.col("u_dst").alias("dst")))
    seeds = graph.filter("seed").select("id").join(unit, "id").select("unit")
    reached = reachable_units(seeds, unit_edges)
    return unit.join(reached, "unit", "left_semi").select("id").join(graph.filter("keep").select("id"), "id", "left_semi")


def build_threads(messages: DataFrame, support_author: str = SUPPORT_AUTHOR, handles=SUPPORT_HANDLES,
                  chunk_rows: int = CHUNK_ROWS, hot_rows: int = HOT_ROWS, order_by: str | None = None,
                  row_order: str | None = None) -> DataFrame:
    """The support threads. Every kept message row (duplicates of an id
    included; of such an id the last row of the input gives parent, responses, author and
    text) with ``conversation_id`` = root of its parent chain over the full
    table and ``thread_order`` = position inside the conversation: by id (the
    original rule) or, with ``order_by``, by that column (a timestamp or
    number, e.g. ``created_at``) with the id breaking ties. With ``row_order`` only
    the last row of each id by that column counts, and only it is returned."""
    if row_order is not None:
        messages = cut_lineage(latest_messages(messages, row_order))
    graph = cut_lineage(graph_rows(messages, support_author, handles))
    nodes = cut_lineage(message_nodes(graph, hot_rows))
    roots = cut_lineage(resolve_roots(nodes, hot_rows=hot_rows, materialized=True))
    keep_ids = support_thread_ids(messages, support_author, handles, roots=roots, nodes=nodes, graph=graph)
    kept = keep_ids.join(roots, "id").select(F.col("id").alias("tweet_id"), F.col("root").alias("conversation_id"))
    rows = messages.join(cut_lineage(kept), "tweet_id")
    if order_by is None:
        return ordinal_within(rows, "conversation_id", "tweet_id", "thread_order", chunk_rows)
    key = F.col(order_by).cast("timestamp").cast("double") if dict(rows.dtypes)[order_by] in ("string", "timestamp") \
        else F.col(order_by).cast("double")
    keyed = rows.withColumn("_order", F.coalesce(F.floor(key * 1000).cast("long"), F.lit(0)))
    return ordinal_within(keyed, "conversation_id", "_order", "thread_order", chunk_rows,
                          tie_col="tweet_id").drop("_order")


def thread_metrics(threads: DataFrame, support_author: str = SUPPORT_AUTHOR) -> DataFrame:
    """One row of inspection counts."""
    return threads.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("inbound")).alias("n_inbound"),
        F.count_if(F.lower(F.col("author_id")) == support_author.lower()).alias("n_support"),
        F.count_if(F.col("response_tweet_id").isNull()).alias("n_missing_response"),
        F.count_if(F.col("in_response_to_tweet_id").isNull()).alias("n_missing_parent"),
        F.countDistinct("conversation_id").alias("n_conversations"),
    )
