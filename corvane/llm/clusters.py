"""Clusters of records about the same named thing, by Markov clustering of their similarity graph.

The nodes of the graph are records. A record is a vector of its terms: ``(1 + ln tf) x rarity^POWER x naming``, where *naming*
is the part of a term's occurrences that are written with a capital inside a sentence, counted over all records, and *rarity* is the inverse document
frequency, but not less than HOT of the largest possible one for a term that records which hold it repeat: what very many records are about
stays as telling as what few are about. No term is left out by a rule; a rare term that is a commoner one with a slip of the pen counts as that one. The *telling* terms of a record are the heaviest ones that hold MASS of its squared weight. Records whose
telling terms are the same, and nearly all they have, are one node, so copies and a thing treated in very many records stay few nodes.

Two nodes are linked by the cosine of their telling terms, less as far as their subject areas differ, where these are given: different things may share a
name. All nodes of a term meet, block by block; telling terms are rare, and records with
the same ones are one node, so these pairs stay few, though their number is quadratic in the nodes of a term.

Markov clustering alternates squaring of the flow matrix (columns packed in arrays; a join and a sum), inflation and pruning
of small entries until the flow no longer changes; attractor rows define the clusters. Clusters are then nodes of a smaller
graph, with the mean of their records as vector, and are clustered again until none join: a cluster of any size arises from small ones.
A record's strength is the flow that enters it from the records of its cluster in the first matrix.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.reading import folded, read
from corvane.runtime import forget, keep

#: Exponent of the inverse document frequency; part of a record's squared weight that its telling terms hold; part of it that they hold where records with the same terms are one node.
POWER, MASS, SAME = 4.0, 0.95, 0.6
#: Smallest cosine of a link between records, and between clusters.
LINK, JOIN = 0.15, 0.55
#: Rarity of a term that the records which hold it repeat, as a part of the largest; once more on average counts in full.
HOT = 0.8
#: Terms lighter than this part of the heaviest possible term only add to the length of a vector.
FAINT = 0.01
#: A term is misspelt if a term of so many times its records differs by a slip; letters of a term that can be misspelt.
SURER, SPELT = 3, 5
#: What is left of a link between records of different areas, and the part in common that is enough for all of it.
APART, ENOUGH = 0.2, 0.5
#: Terms in more than 1/FREQUENT of all records are broadcast: at most FREQUENT x mean size of a record.
FREQUENT = 512
#: Inflation, smallest flow kept (so at most 1/PRUNE entries to a column), smallest mean change that counts, and a guard of the rounds.
INFLATION, PRUNE, STILL, ROUNDS = 1.6, 2e-3, 1e-3, 40
#: None: all nodes of a term are compared. A number: only with so many, and pairs of such a node and a task's share of a term's nodes.
PIVOTS, SALT = None, 4096
#: Flow that attractors of one system hold of one another.
SYSTEM = 0.1
#: Columns that are more than 1/HUBS of all entries are broadcast in the squaring: at most HUBS columns of at most 1/PRUNE entries.
HUBS = 1024
#: Passes of clustering clusters.
LEVELS = 4
#: Members of a block: larger clusters, and the nodes of commoner terms, are paired block by block, so that no task has more than the square of it to a key.
BLOCK = 256

_TOKENS = re.compile('[A-Za-z0-9]+|[.:?!;"“”„»«\n\r]')


def _counted(b: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for i, text in zip(b["doc_id"], b["text"]):
        count, inside, begins = Counter(), Counter(), True
        for w in _TOKENS.findall(folded(text)):
            if not w.isalnum():
                begins = True
                continue
            low = w.lower()
            count[low] += 1
            if not begins and w[0].isupper():
                inside[low] += 1
            begins = False
        if count:
            terms = sorted(count)
            rows.append((i, terms, [count[t] for t in terms], [inside[t] for t in terms]))
    return pd.DataFrame(rows, columns=["doc_id", "terms", "tf", "inside"])


def read_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, terms, tf, inside) of the texts as they read: terms, their number, and how many of them are written with a capital
    inside a sentence. One row for each id; none for null ids, null texts and texts without a term."""
    return read(docs, ["doc_id"], _counted, "doc_id bigint, terms array<string>, tf array<int>, inside array<int>").dropDuplicates(["doc_id"])


def misspelt(stats: DataFrame) -> DataFrame:
    """(term, meant) of (term, df): rare terms that are a commoner one with a letter left out or doubled, or with two neighbouring letters swapped.

    A term counts as misspelt if exactly one term, held by at least SURER times as many records, becomes it by such a slip. One letter written for another
    is no slip here: invented names often differ in one letter. Each term meets the slips of others by equality, so the work is linear in the terms.
    """
    long = stats.where(F.length("term") >= SPELT).select("term", "df")
    places = F.sequence(F.lit(1), F.length("term"))
    without = F.expr("concat(substring(term, 1, k - 1), substring(term, k + 1))")
    at = long.select("term", "df", F.explode(places).alias("k"))
    same = F.expr("k > 1 and substring(term, k, 1) = substring(term, k - 1, 1)")
    left_out = at.where(F.col("df") >= SURER).select(F.col("term").alias("meant"), F.col("df").alias("often"), without.alias("key")).distinct()
    doubled = at.where(same).select("term", "df", without.alias("meant"))
    swapped = at.where(F.expr("k > 1") & ~same).select("term", "df", F.expr("concat(substring(term, 1, k - 2), substring(term, k, 1), substring(term, k - 1, 1), substring(term, k + 1))").alias("meant"))
    known = long.where(F.col("df") >= SURER).select(F.col("term").alias("meant"), F.col("df").alias("often"))
    slips = long.join(left_out, F.col("term") == F.col("key")).select("term", "df", "meant", "often").unionByName(doubled.unionByName(swapped).join(known, "meant").select("term", "df", "meant", "often"))
    surer = slips.where(F.col("often") >= SURER * F.col("df")).groupBy("term").agg(F.min("meant").alias("meant"), F.max("meant").alias("other"))
    return surer.where("meant = other").select("term", "meant")


def respelt(found: DataFrame) -> DataFrame:
    """(doc_id, term, tf, inside) of :func:`read_documents`, misspelt terms counted as the terms that are meant."""
    rows = found.select("doc_id", F.inline(F.arrays_zip("terms", "tf", "inside"))).withColumnRenamed("terms", "term")
    slips = keep(misspelt(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))), "slips")
    meant = rows.join(slips, "term", "left").select("doc_id", F.coalesce("meant", "term").alias("term"), "tf", "inside")
    return meant.groupBy("doc_id", "term").agg(F.sum("tf").cast("int").alias("tf"), F.sum("inside").cast("int").alias("inside"))


def term_weights(rows: DataFrame, n: int) -> DataFrame:
    """(term, df, w) of (doc_id, term, tf, inside)."""
    stats = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.sum("inside").alias("inside"))
    naming = (F.col("inside") + 0.3) / (F.col("cf") + 0.6)
    repeated = F.least(F.lit(1.0), F.col("cf") / F.col("df") - 1)
    rarity = F.when(F.col("df") == 1, F.log(F.lit(n + 1.0))).otherwise(F.greatest(F.log(F.lit(n + 1.0) / F.col("df")), HOT * float(np.log(n + 1.0)) * repeated))
    return stats.select("term", "df", (F.pow(rarity, F.lit(POWER)) * naming).alias("w"))


def vectors(found: DataFrame) -> DataFrame:
    """(doc_id, terms array of (term, x)): the telling terms that other records hold as well, with their part x of the length of
    the record's vector, heaviest first. Each record of :func:`read_documents` has a row."""
    n = found.count()
    rows = keep(respelt(found), "respelt")
    weights = keep(term_weights(rows, n), "weights")
    top = float(np.log(n + 1.0) ** POWER)
    often = weights.where(F.col("df") * FREQUENT > n)
    rows = rows.select("doc_id", "term", (1 + F.log(F.col("tf").cast("double"))).alias("often"))
    at_once = rows.join(F.broadcast(often), "term")
    moved = rows.join(F.broadcast(often.select("term")), "term", "left_anti").join(weights.where(F.col("df") * FREQUENT <= n), "term")
    each = at_once.unionByName(moved).select("doc_id", (F.col("often") * F.col("w")).alias("x"), "df", "w", F.xxhash64("term").alias("term"))
    telling = F.when(F.col("w") >= FAINT * top, F.struct((-F.col("x")).alias("x"), "term", "df"))
    vector = each.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sort_array(F.collect_list(telling)).alias("t"))
    return vector.select("doc_id", _telling(F.transform("t", lambda e: F.struct((-e["x"] / F.col("norm")).alias("x"), e["term"].alias("term"), (e["df"] > 1).alias("shared"))), F.lit(1.0)).alias("t")).select(
        "doc_id", F.transform(F.filter("t", lambda e: e["shared"]), lambda e: F.struct(e["term"].alias("term"), e["x"].alias("x"))).alias("terms")
    )


def _telling(ordered, whole):
    """The first entries of an array ordered by descending x that hold MASS of the squared length ``whole``."""
    before = F.aggregate(
        ordered, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda a, e: F.struct((a["sum"] + e["x"] * e["x"]).alias("sum"), (a["n"] + F.when(a["sum"] < MASS * whole, 1).otherwise(0)).alias("n")),
        lambda a: a["n"],
    )
    return F.slice(ordered, F.lit(1), before)


def nodes_of(vector: DataFrame) -> DataFrame:
    """(doc_id, node, terms, areas) of (doc_id, terms, areas): records with the same telling terms and the same largest area are one node, named by the
    smallest id, if the terms hold SAME of the squared length of each; its vector and areas are those of the smallest id."""
    mass = F.aggregate("terms", F.lit(0.0), lambda a, e: a + e["x"] * e["x"])
    names = F.array_sort(F.transform("terms", lambda e: e["term"]))
    alone = F.when((mass < SAME) | (F.size("terms") == 0), F.col("doc_id"))
    largest = F.array_max(F.transform(F.map_entries("areas"), lambda e: F.struct(e["value"].alias("share"), e["key"].alias("area"))))["area"]
    key = F.struct(F.xxhash64(names), F.hash(names), alone.alias("alone"), largest.alias("area"))
    keyed = vector.select("doc_id", "terms", "areas", key.alias("key"))
    first = keyed.groupBy("key").agg(F.min_by("terms", "doc_id").alias("terms"), F.min_by("areas", "doc_id").alias("areas"), F.min("doc_id").alias("node"))
    return keyed.select("doc_id", "key").join(first, "key").select("doc_id", "node", "terms", "areas")


def similarity(nodes: DataFrame, link: float) -> DataFrame:
    """(i, j, s), i < j: the cosine of nodes (node, terms), if at least ``link``. One shuffle by term, one by pair."""
    post = keep(nodes.select("node", F.inline("terms")).select("term", "node", "x"), "postings")
    if PIVOTS is not None:
        return _by_pivots(post, link)
    sizes = post.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    sized = post.join(sizes, "term")
    own, every = F.pmod(F.xxhash64("node"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = sized.select("term", own.alias("block_a"), every.alias("block_b"), F.col("node").alias("i"), F.col("x").alias("xi"))
    b = sized.select("term", every.alias("block_a"), own.alias("block_b"), F.col("node").alias("j"), F.col("x").alias("xj"))
    pairs = a.join(b, ["term", "block_a", "block_b"]).where("i < j").select("i", "j", (F.col("xi") * F.col("xj")).alias("c"))
    return pairs.groupBy("i", "j").agg(F.sum("c").alias("s")).where(F.col("s") >= link).withColumn("s", F.least("s", F.lit(1.0)))


def _by_pivots(post: DataFrame, link: float) -> DataFrame:
    """As :func:`similarity`, but each node of a term meets only the term's PIVOTS purest ones: an approximation, used only where PIVOTS is set."""
    sizes = post.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    order = Window.partitionBy("term").orderBy(F.desc("x"), "node")
    pivots = post.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS)
    last = F.last(F.struct("x", "node")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pivots = pivots.select("term", F.col("node").alias("p"), F.col("x").alias("px"), "r", last.alias("last"))
    sizes = sizes.withColumn("salts", F.ceil(F.col("n") * F.least(F.col("n"), F.lit(PIVOTS)) / F.lit(SALT * PIVOTS)).cast("int"))
    large = F.broadcast(sizes.where("salts > 1").select("term", F.col("salts").alias("s")))
    salted = post.join(large, "term", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("s", F.lit(1))).cast("int")).drop("s")
    spread_out = pivots.join(large, "term", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1))).drop("s")
    # a member that is a pivot itself meets each other pivot once
    pivot = (F.col("x") > F.col("last.x")) | ((F.col("x") == F.col("last.x")) & (F.col("node") <= F.col("last.node")))
    met = salted.join(spread_out, ["term", "salt"]).where((F.col("p") != F.col("node")) & (~pivot | (F.col("p") < F.col("node"))))
    pairs = met.select(F.least("p", "node").alias("i"), F.greatest("p", "node").alias("j"), (F.col("px") * F.col("x")).alias("c"))
    return pairs.groupBy("i", "j").agg(F.sum("c").alias("s")).where(F.col("s") >= link).withColumn("s", F.least("s", F.lit(1.0)))


def told_apart(edges: DataFrame, areas: DataFrame, link: float) -> DataFrame:
    """Links (i, j, s) weakened to APART of their strength as far as the areas of their nodes differ, if still at least ``link``.

    ``areas`` (node, areas) has the share of each area as a map, null where nothing is known, which weakens nothing. Half of a
    record in common is enough for a link to keep all its strength: a record may treat its thing beside another subject.
    """
    one, other = (areas.where("areas is not null").select(F.col("node").alias(k), F.col("areas").alias(f"a{k}")) for k in "ij")
    shared = F.aggregate(F.map_entries("ai"), F.lit(0.0), lambda a, e: a + F.least(e["value"], F.coalesce(F.element_at("aj", e["key"]), F.lit(0.0))))
    agreed = F.coalesce(F.least(F.lit(1.0), shared / ENOUGH), F.lit(1.0))
    return edges.join(one, "i", "left").join(other, "j", "left").select("i", "j", (F.col("s") * (APART + (1 - APART) * agreed)).alias("s")).where(F.col("s") >= link)


def _columns(entries: DataFrame, inflation: float, prune: float) -> DataFrame:
    """(j, e, change) of (i, j, v): packed columns, inflated, scaled to one, entries under ``prune`` left out (never the largest), scaled again.

    ``change`` is the largest entry less the sum of squares: zero where the flow of a column no longer changes.
    """
    packed = entries.withColumn("v", F.pow("v", F.lit(inflation))).groupBy("j").agg(F.collect_list(F.struct("i", "v")).alias("e"), F.sum("v").alias("sum"), F.max("v").alias("top"))
    kept = packed.select("j", F.filter("e", lambda x: (x["v"] >= prune * F.col("sum")) | (x["v"] >= F.col("top"))).alias("e"))
    total = kept.withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, x: a + x["v"]))
    scaled = total.select("j", F.transform("e", lambda x: F.struct(x["i"].alias("i"), (x["v"] / F.col("sum")).alias("v"))).alias("e"))
    return scaled.withColumn("change", F.aggregate("e", F.lit(0.0), lambda a, x: F.greatest(a, x["v"])) - F.aggregate("e", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))


def first_flow(edges: DataFrame, prune: float = PRUNE) -> DataFrame:
    """The flow matrix of a graph (i, j, s), each edge once: both directions and a loop as strong as the strongest edge of the node."""
    both = edges.select("i", "j", F.col("s").alias("v")).unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("s").alias("v")))
    loops = both.groupBy("j").agg(F.max("v").alias("v")).select(F.col("j").alias("i"), "j", "v")
    return keep(_columns(both.unionByName(loops), 1.0, prune), "flow")


def squared(flow: DataFrame) -> DataFrame:
    """(i, j, v): the flow matrix times itself. Entries of the columns that very many others hold (hubs) meet them by broadcast."""
    entries = flow.select("j", F.inline("e")).select("j", F.col("i").alias("k"), F.col("v").alias("a"))
    right = flow.select(F.col("j").alias("k"), "e")
    total = flow.agg(F.sum(F.size("e"))).first()[0] or 0
    hubs = [r.k for r in entries.groupBy("k").count().where(F.col("count") * HUBS > max(total, HUBS * HUBS)).select("k").collect()]
    if hubs:
        hub = F.col("k").isin(hubs)
        met = entries.where(~hub).join(right.where(~hub), "k").unionByName(entries.where(hub).join(F.broadcast(right.where(hub)), "k"))
    else:
        met = entries.join(right, "k")
    return met.select("j", "a", "e").repartition("j").select("j", "a", F.inline("e")).groupBy("j", "i").agg(F.sum(F.col("a") * F.col("v")).alias("v"))


def markov_clusters(first: DataFrame, inflation: float = INFLATION, prune: float = PRUNE, rounds: int = ROUNDS, still: float = STILL) -> DataFrame:
    """(node, cluster): the attractor that each node's flow ends in, for the matrix of :func:`first_flow`.

    Each round is written to the shared folder and the one before it deleted. Rounds end when the columns change by less
    than ``still`` on average. A node that holds SYSTEM of its own flow is an attractor; attractors that hold as much
    of one another's are one system, named by its smallest. Every other node belongs where most of its flow ends, ties to the smaller attractor.
    """
    flow = first
    for _ in range(rounds):
        after = keep(_columns(squared(flow), inflation, prune), "flow")
        if flow is not first:
            forget(flow)
        flow = after
        if (flow.agg(F.avg("change")).first()[0] or 0.0) < still:
            break
    best = F.array_max(F.transform("e", lambda x: F.struct(F.round(x["v"], 6).alias("v"), (-x["i"]).alias("i"))))
    system = F.transform(F.filter("e", lambda x: x["v"] >= SYSTEM), lambda x: x["i"])
    end = F.when(F.array_contains(system, F.col("j")), F.array_min(system)).otherwise(-best["i"])
    end = keep(flow.select(F.col("j").alias("node"), end.alias("cluster")), "ends")
    for _ in range(2):
        to = end.select(F.col("node").alias("cluster"), F.col("cluster").alias("next"))
        end = end.join(to, "cluster").select("node", F.least("cluster", "next").alias("cluster"))
    return end


def _joined(members: DataFrame) -> DataFrame | None:
    """(old, cluster) for clusters that join others: Markov clustering of clusters (node, cluster, terms, areas, size), whose vectors and areas are the
    means of their nodes."""
    sizes = members.groupBy("cluster").agg(F.sum("size").alias("all"))
    rows = members.select("cluster", "size", F.inline("terms")).groupBy("cluster", "term").agg(F.sum(F.col("x") * F.col("size")).alias("x"))
    mean = rows.join(sizes, "cluster").select("cluster", "term", (F.col("x") / F.col("all")).alias("x"))
    packed = mean.groupBy("cluster").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sort_array(F.collect_list(F.struct((-F.col("x")).alias("x"), "term"))).alias("t"))
    unit = packed.select("cluster", F.transform("t", lambda e: F.struct(e["term"].alias("term"), (-e["x"] / F.col("norm")).alias("x"))).alias("t"))
    nodes = keep(unit.select(F.col("cluster").alias("node"), _telling(F.col("t"), F.lit(1.0)).alias("terms")), "means")
    areas = members.where("areas is not null").select("cluster", "size", F.explode("areas").alias("area", "share")).groupBy("cluster", "area").agg(F.sum(F.col("share") * F.col("size")).alias("share"))
    areas = areas.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("area", "share"))).alias("areas"), F.sum("share").alias("all"))
    areas = areas.select(F.col("cluster").alias("node"), F.transform_values("areas", lambda _, v: v / F.col("all")).alias("areas"))
    edges = keep(told_apart(similarity(nodes, JOIN), areas, JOIN), "links")
    if edges.isEmpty():
        return None
    return markov_clusters(first_flow(edges)).where("node != cluster").withColumnRenamed("node", "old")


def thing_clusters(docs: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """(doc_id, cluster, strength): the cluster of each record that has a term, named after an attractor, and the flow that enters the
    record from its cluster. ``areas`` (doc_id, subject, share), as of :func:`corvane.llm.subjects.subject_mixtures`, tell different things of one name apart.

    Null ids, null texts and texts without a term have no row; repeated rows of a document count once. A record that resembles no
    other is a cluster of its own, of strength 1.
    """
    found = keep(read_documents(docs), "words")
    if areas is None:
        vector = vectors(found).withColumn("areas", F.lit(None).cast("map<string,double>"))
    else:
        packed = areas.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("subject", "share"))).alias("areas"))
        vector = vectors(found).join(packed, "doc_id", "left")
    nodes = keep(nodes_of(vector), "nodes")
    unique = keep(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min_by("terms", "doc_id").alias("terms"), F.min_by("areas", "doc_id").alias("areas")), "unique")
    edges = keep(told_apart(similarity(unique.select("node", "terms"), LINK), unique, LINK), "links")
    first = first_flow(edges)
    placed = unique.join(markov_clusters(first), "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"), "size", "terms", "areas")
    placed = keep(placed, "placed")
    for _ in range(LEVELS):
        to = _joined(placed)
        if to is None or to.isEmpty():
            break
        placed = keep(placed.join(to.withColumnRenamed("cluster", "next"), placed["cluster"] == to["old"], "left").select("node", F.coalesce("next", "cluster").alias("cluster"), "size", "terms", "areas"), "placed")
    into = first.select("j", F.inline("e")).join(placed.select(F.col("node").alias("j"), F.col("cluster").alias("cj")), "j")
    into = into.join(placed.select(F.col("node").alias("i"), F.col("cluster").alias("ci")), "i").where("ci = cj")
    strength = into.groupBy(F.col("i").alias("node")).agg(F.round(F.sum("v"), 6).alias("strength"))
    placed = placed.select("node", "cluster").join(strength, "node", "left")
    return nodes.select("doc_id", "node").join(placed, "node").select("doc_id", "cluster", F.coalesce("strength", F.lit(1.0)).alias("strength"))


def cluster_pairs(members: DataFrame, expand: int | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first, of documents in one cluster: every pair, whatever the size of the cluster.

    Members are dealt to blocks by their id, and each two blocks meet under a key of their own, so a huge cluster is
    spread over many tasks; its pairs are true ones, and their number is inherently quadratic. With ``expand``, clusters of more
    members are written as a star around the member of greatest strength instead, for callers that only need them linked.
    """
    whole = Window.partitionBy("cluster")
    sized = members.select("doc_id", "cluster", "strength").withColumn("n", F.count(F.lit(1)).over(whole)).where("n > 1")
    star = None
    if expand is not None:
        best = sized.where(F.col("n") > expand).groupBy("cluster").agg(F.min_by("doc_id", F.struct(-F.col("strength"), "doc_id")).alias("hub"))
        star = sized.join(best, "cluster").where("doc_id != hub").select(F.least("doc_id", "hub").alias("doc_id_a"), F.greatest("doc_id", "hub").alias("doc_id_b"))
        sized = sized.where(F.col("n") <= expand)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own, every = F.pmod(F.xxhash64("doc_id"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    a = sized.select("cluster", own.alias("block_a"), every.alias("block_b"), F.col("doc_id").alias("doc_id_a"))
    b = sized.select("cluster", every.alias("block_a"), own.alias("block_b"), F.col("doc_id").alias("doc_id_b"))
    pairs = a.join(b, ["cluster", "block_a", "block_b"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    return pairs if star is None else pairs.unionByName(star)


def describe_clusters(members: DataFrame, docs: DataFrame, terms: int = 6, typical: int = 3) -> DataFrame:
    """(cluster, size, top_terms, typical): size, the terms most particular to the cluster, and its strongest members."""
    found = read_documents(docs)
    every = found.select("doc_id", F.explode(F.filter("terms", lambda w: F.length(w) > 2)).alias("term"))
    df = every.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    inside = every.join(members.select("doc_id", "cluster"), "doc_id").groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n")).join(df, "term")
    n = found.count()
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round(F.col("n") * F.log(F.lit(n + 1.0) / F.col("df")), 6)), "term")
    top = inside.withColumn("r", F.row_number().over(order)).where(F.col("r") <= terms)
    top = top.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", "term"))).alias("t")).select("cluster", F.col("t.term").alias("top_terms"))
    by_strength = Window.partitionBy("cluster").orderBy(F.desc("strength"), "doc_id")
    best = members.withColumn("r", F.row_number().over(by_strength)).where(F.col("r") <= typical)
    best = best.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("r", "doc_id"))).alias("t")).select("cluster", F.col("t.doc_id").alias("typical"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(top, "cluster", "left").join(best, "cluster").select("cluster", "size", "top_terms", "typical")
