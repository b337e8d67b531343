"""Near-duplicate records by a chosen-path similarity join.

Two records are similar when they share at least ``share`` of the words of the longer one, counted with repetition
and in any order. A record is the set of its word occurrences (a word, and which occurrence of it), so the
overlap of sets is the overlap of word bags.

Each run starts all records at one node. At a node, a record follows every one of its tokens whose hash with the node
lies under a threshold, on average ``BRANCH`` of them; records that share a chosen token meet again at the
child. Rare tokens split best, so tokens held by much of the corpus get a smaller share of the choice. A path ends as
soon as the product of its token frequencies predicts a small bucket; the whole path is computed within the record,
without a shuffle for each level. A bucket that comes out larger than predicted is split by further tokens, round by
round; one that does not get smaller holds records that are alike, and is compared in blocks, never in one task.
Runs are repeated until further ones find less than ``1 - target`` of the pairs anew, which is observed and so holds for whatever
depth the paths have, or until the planned probability of missing a pair at the threshold falls below ``1 - target``.
Candidates must agree on a sketch of 128 one-bit minimum hashes; an exact check of the overlap follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.reading import hashed, read, words_of
from corvane.runtime import keep

MIN_WORDS, SHARE, TARGET = 60, 0.8, 0.995
#: Runs made at first, and added at a time while they still find new pairs.
FIRST, MORE = 6, 3
#: Tokens followed on average at a node.
BRANCH = 1.5
#: Levels of a path, records of a bucket that is compared at once, further rounds of one level for larger ones, and their branching.
LEVELS, BUCKET, ROUNDS, FURTHER = 6, 48, 2, 2.5
#: Tokens in more than 1/COMMON of the records have their frequency sent to all tasks: at most COMMON x mean length.
COMMON = 2048
#: Of 128 sketch bits, so many may differ: at the threshold a pair differs in 21 on average, 3.5 deviations below 38.
BITS, DIFFER = 128, 38
#: Documents of a block: larger classes of equal word bags are paired block by block.
BLOCK = 256
_U = np.uint64


def planned_runs(share: float = SHARE, branch: float = BRANCH, depth: int = LEVELS, target: float = TARGET, rounds: int = ROUNDS, further: float = FURTHER) -> int:
    """Runs after which a pair at the threshold is missed with probability below ``1 - target``.

    The tokens a pair follows together form a branching process with mean ``share * branch`` on each of the ``depth``
    levels of a path and ``share * further`` in each of the ``rounds`` after it; all that may be needed are planned for.
    ``share`` is of the weight by which tokens are chosen.
    """
    lost = 0.0
    for mean in [share * further] * rounds + [share * branch] * depth:
        lost = math.exp(-mean * (1 - lost))
    return math.ceil(math.log(1 - target) / math.log(lost))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.concatenate([*map(np.asarray, lists)]).astype(np.int64).view(np.uint64), sizes


def _occurrences(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Word hashes, sorted within each record, to tokens: a word and the number of its occurrence."""
    at = np.arange(len(flat))
    new = np.r_[True, flat[1:] != flat[:-1]]
    new[np.r_[0, np.cumsum(sizes)[:-1]]] = True
    start = np.maximum.accumulate(np.where(new, at, 0))
    return _mix(flat + (at - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def word_sets(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, toks) of the documents with at least ``min_words`` words; null ids are left out, they can't be paired."""

    def emit(b: pd.DataFrame) -> pd.DataFrame:
        found = [words_of(t) for t in b["text"]]
        kept = [i for i, w in enumerate(found) if len(w) >= min_words]
        if not kept:
            return pd.DataFrame()
        sizes = np.array([len(found[i]) for i in kept])
        flat = hashed([w for i in kept for w in found[i]])
        owner = np.repeat(np.arange(len(kept)), sizes)
        flat = flat[np.lexsort((flat, owner))]
        return pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[kept], "toks": np.split(_occurrences(flat, sizes), np.cumsum(sizes)[:-1])})

    return read(docs, ["doc_id"], emit, "doc_id bigint, toks array<bigint>")


def _sketch(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of one-bit minimum hashes of each set."""
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    out = np.zeros((2, len(sizes)), np.uint64)
    seeds = _mix(np.arange(1, BITS + 1, dtype=np.uint64) * _U(0x632BE59BD9B4E019)) | _U(1)
    for i, seed in enumerate(seeds):
        least = np.minimum.reduceat((flat * seed) >> _U(8), starts)
        out[i // 64] |= (_mix(least) & _U(1)) << _U(i % 64)
    return out[0].view(np.int64), out[1].view(np.int64)


def _weights(common_share: np.ndarray) -> np.ndarray:
    """Weights by which tokens of such shares of the records are chosen; all others have 1."""
    return np.where(common_share >= 0.1, 0.25, np.where(common_share >= 0.01, 0.6, 1.0))


def weighted_share(sets: DataFrame, common_tokens: np.ndarray, common_share: np.ndarray, share: float) -> float:
    """The part of its weight that a record shares at least with one at the threshold, if the edits hit its heaviest (rarest)
    tokens: the smallest such part but for one record in a hundred."""
    weight_of = _weights(common_share)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for toks in b["toks"]:
                toks = np.asarray(toks, np.int64).view(np.uint64)
                weight = np.ones(len(toks))
                if len(common_tokens):
                    at = np.searchsorted(common_tokens.view(np.uint64), toks) % len(common_tokens)
                    weight = np.where(common_tokens.view(np.uint64)[at] == toks, weight_of[at], 1.0)
                found.append(np.sort(weight)[: math.ceil(share * len(toks))].sum() / weight.sum())
            yield pd.DataFrame({"part": found})

    got = sets.select("toks").mapInPandas(least, "part double").agg(F.percentile_approx("part", 0.01, 10_000)).first()[0]
    return share if got is None else min(share, got)


def _paths(common_tokens: np.ndarray, common_share: np.ndarray, branch: float, most: float, runs: int, levels: int, begin: int = 0):
    """A function of batches with (rep, toks, node, size): each row's ends of paths below its node, with its sketch.

    A null node is the root, with one start for each run. No path is longer than ``levels``: among records that share
    nearly all their tokens no token predicts a smaller bucket, and paths would only multiply.
    """
    weight_of = _weights(common_share)
    rows_at_once = max(100, 16_000 // runs)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), rows_at_once):
                part = b.iloc[lo : lo + rows_at_once]
                flat, sizes = _flat(part["toks"])
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                known = common_tokens.view(np.uint64)
                at = np.searchsorted(known, flat)
                at[at == len(known)] = 0
                hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
                logf = np.where(hit, np.log(common_share[at]) if len(known) else 0.0, -math.log(COMMON))
                weight = np.where(hit, weight_of[at] if len(known) else 1.0, 1.0)
                limit = branch * weight / np.repeat(np.add.reduceat(weight, starts), sizes)
                limit = (np.minimum(limit, 1.0) * float(1 << 53)).astype(np.uint64)
                s1, s2 = _sketch(flat, sizes)
                rep, size = part["rep"].to_numpy(), np.log(np.maximum(part["size"].to_numpy(float), 1.0))
                root = part["node"].isna().to_numpy().any()
                if root:
                    row = np.repeat(np.arange(len(part)), runs)
                    node = _mix(np.tile(np.arange(begin + 1, begin + runs + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93), len(part)))
                else:
                    row, node = np.arange(len(part)), part["node"].to_numpy(np.int64).view(np.uint64)
                est = size[row]
                ends = []
                for level in range(levels + 1):
                    done = (est <= most) & (level > 0) | (level == levels)
                    if done.any():
                        ends.append((row[done], node[done]))
                    row, node, est = row[~done], node[~done], est[~done]
                    if not len(row):
                        break
                    n = sizes[row]
                    owner = np.repeat(np.arange(len(row)), n)
                    tok = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[row], n)
                    child = _mix(node[owner] ^ flat[tok])
                    take = (_mix(child + _U(0x2545F4914F6CDD1D)) >> _U(11)) < limit[tok]
                    owner, tok = owner[take], tok[take]
                    row, node, est = row[owner], _mix(child[take] + _U(1)), est[owner] + logf[tok]
                if ends:
                    r = np.concatenate([x for x, _ in ends])
                    yield pd.DataFrame({"node": np.concatenate([x for _, x in ends]).view(np.int64), "rep": rep[r], "s1": s1[r], "s2": s2[r]})

    return emit


_LEAF = "node bigint, rep bigint, s1 bigint, s2 bigint"


def similar_sets(sets: DataFrame, share: float = SHARE, target: float = TARGET) -> DataFrame:
    """(rep_a, rep_b, shared): pairs of distinct sets (rep, toks) with at least ``share`` of the longer one in common.

    FIRST runs, then MORE at a time until they add less than ``1 - target`` of all pairs: of what is missed then, the same runs would
    find most, so less is missing than they found. Never more runs than :func:`planned_runs`.
    """
    n = sets.count()
    held = sets.select(F.explode("toks").alias("tok")).groupBy("tok").count().where(F.col("count") * COMMON > n).toPandas()
    held = held.assign(u=held["tok"].to_numpy(np.int64).view(np.uint64)).sort_values("u") if len(held) else held
    tokens, shares = held["tok"].to_numpy(np.int64), held["count"].to_numpy(float) / max(n, 1)
    planned = planned_runs(weighted_share(sets, tokens, shares, share), target=target)
    found, total, done, add = None, 0, 0, min(FIRST, planned)
    while add:
        fresh = _checked(_candidates(sets, tokens, shares, n, add, done), sets, share)
        if found is not None:
            fresh = fresh.join(found, ["rep_a", "rep_b"], "left_anti")
        fresh = keep(fresh, "pairs")
        new = fresh.count()
        found, total, done = fresh if found is None else found.unionByName(fresh), total + new, done + add
        add = min(MORE, planned - done) if done == add or new > (1 - target) * total else 0
    return found


def exact_pairs(sets: DataFrame, share: float = SHARE) -> DataFrame:
    """The result of :func:`similar_sets` with nothing missed, for measuring it and for collections of rare tokens.

    Two sets with ``share`` of the longer one in common share one of the rarest tokens of both, as many as the rest and one more. Sets
    meet on these; a token in the prefix of very many sets makes this slow where the chosen paths are not.
    """
    df = sets.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    rows = sets.select("rep", F.size("toks").alias("n"), F.explode("toks").alias("tok")).join(df, "tok")
    order = Window.partitionBy("rep").orderBy("df", "tok")
    prefix = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1).select("rep", "n", "tok")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = F.least("a.n", "b.n") >= F.lit(share) * F.greatest("a.n", "b.n") - 1e-9
    met = a.join(b, (F.col("a.tok") == F.col("b.tok")) & (F.col("a.rep") < F.col("b.rep")) & near)
    return _checked(met.select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b")).distinct(), sets, share)


def _checked(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Candidate pairs that do share as much, with what they share."""
    left = sets.select(F.col("rep").alias("rep_a"), F.col("toks").alias("ta"))
    right = sets.select(F.col("rep").alias("rep_b"), F.col("toks").alias("tb"))
    checked = pairs.join(left, "rep_a").join(right, "rep_b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    return checked.where(F.col("shared") >= F.lit(share) * F.greatest(F.size("ta"), F.size("tb")) - 1e-9).select("rep_a", "rep_b", "shared")


def _candidates(sets: DataFrame, tokens: np.ndarray, shares: np.ndarray, n: int, runs: int, begin: int) -> DataFrame:
    """(rep_a, rep_b): pairs that meet in a bucket of one of ``runs`` runs and agree on the sketch, each once."""
    most = math.log(BUCKET / 4)
    rows = sets.select("rep", "toks", F.lit(None).cast("bigint").alias("node"), F.lit(n).alias("size")).mapInPandas(_paths(tokens, shares, BRANCH, most, runs, LEVELS, begin), _LEAF)
    ready, rest = [], None
    for turn in range(ROUNDS + 1):
        leaves = keep(rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("node"))).where("size > 1"), "leaves")
        ready.append(leaves.where(F.col("size") <= BUCKET))
        rest = leaves.where(F.col("size") > BUCKET)
        if turn == ROUNDS or rest.isEmpty():
            break
        below = rest.select("rep", "node", "size").join(sets, "rep").select("rep", "toks", "node", "size")
        rows = below.mapInPandas(_paths(tokens, shares, FURTHER, most, 1, 1), _LEAF)
    near = (F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))) + F.bit_count(F.col("a.s2").bitwiseXOR(F.col("b.s2")))) <= DIFFER
    # buckets that no round made smaller: of those with the same members, one is enough
    each = rest.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep") % (1 << 40)).alias("sum"), F.bit_xor(F.xxhash64("rep")).alias("xor"))
    rest = rest.join(each.groupBy("n", "sum", "xor").agg(F.min("node").alias("node")).select("node"), "node", "left_semi")
    pairs = None
    for part in [*ready, rest]:
        blocked = part.withColumn("blocks", F.ceil(F.col("size") / BUCKET).cast("int"))
        a = blocked.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).alias("a")
        b = blocked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("b") if part is rest else a.alias("b")
        met = a.join(b, (F.col("a.node") == F.col("b.node")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.rep") < F.col("b.rep")) & near)
        met = met.select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b"))
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.distinct()


def near_duplicates(docs: DataFrame, min_words: int = MIN_WORDS, share: float = SHARE, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the documents: members (doc_id, rep) name the class of each document with the same word
    bag, by its smallest id; pairs (rep_a, rep_b, shared) link classes. Documents under ``min_words`` words, null texts and
    null ids belong to none. Repeated rows of a document count once.
    """
    sets = keep(word_sets(docs, min_words).withColumn("bag", F.struct(F.xxhash64("toks"), F.hash("toks"))), "sets")
    members = keep(sets.select("doc_id", F.min("doc_id").over(Window.partitionBy("bag")).alias("rep")).distinct(), "members")
    reps = members.select(F.col("rep").alias("doc_id")).distinct()
    unique = keep(sets.dropDuplicates(["doc_id"]).join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "toks"), "reps")
    return members, similar_sets(unique, share, target)


def document_pairs(members: DataFrame, pairs: DataFrame, expand: int | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: the links between classes and within them, for all documents of each.

    The texts of a class may differ in order, case and punctuation, and equal ones are copies as well, so every pair is
    written. Classes are dealt to blocks by id, and each two blocks meet under a key of their own, so a large class
    is spread over many tasks; the number of its pairs is inherently quadratic. With ``expand``, a class of more documents has
    only its representative linked to other classes and is a star around it, for callers that only need them linked.
    """
    sized = members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("rep")))
    star = None
    if expand is not None:
        small, first = F.col("n") <= expand, F.col("doc_id") == F.col("rep")
        star = sized.where(~small & ~first).select(F.col("rep").alias("x"), F.col("doc_id").alias("y"))
        sized = sized.where(small | first).withColumn("n", F.when(small, F.col("n")).otherwise(1))
    shown = sized.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    own_a = shown.select(F.col("rep").alias("rep_a"), F.col("block").alias("block_a"), F.col("doc_id").alias("x"))
    own_b = shown.select(F.col("rep").alias("rep_b"), F.col("block").alias("block_b"), F.col("doc_id").alias("y"))
    many = shown.where("blocks > 1 and doc_id = rep").select("rep", "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    met = pairs.select("rep_a", "rep_b").join(many.select(F.col("rep").alias("rep_a"), F.col("blocks").alias("na")), "rep_a", "left")
    met = met.join(many.select(F.col("rep").alias("rep_b"), F.col("blocks").alias("nb")), "rep_b", "left")
    met = met.select("rep_a", "rep_b", "nb", every(F.col("na")).alias("block_a")).select("rep_a", "rep_b", "block_a", every(F.col("nb")).alias("block_b"))
    across = met.join(own_a, ["rep_a", "block_a"]).join(own_b, ["rep_b", "block_b"]).select("x", "y")
    both = shown.where("n > 1").withColumn("every", every(F.col("blocks")))
    a = both.select("rep", F.col("block").alias("block_a"), F.col("every").alias("block_b"), F.col("doc_id").alias("x"))
    b = both.select("rep", F.col("every").alias("block_a"), F.col("block").alias("block_b"), F.col("doc_id").alias("y"))
    found = across.unionByName(a.join(b, ["rep", "block_a", "block_b"]).where("x < y").select("x", "y"))
    found = found if star is None else found.unionByName(star)
    return found.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
