"""The trie of all conversations' prefixes, with totals of every subtree by parallel tree contraction.

A node is known by a 128-bit sum of hashes of its turns and their places, so a prefix's name is a running sum: a scan
finds those of one conversation however long it is, and a node's parent is its own sum less its last turn. Contraction
works on all nodes at once: a round rakes the leaves into their parents and compresses unary chains by splicing out
nodes of which no two are neighbours, so O(log nodes) rounds of joins leave the root. The rounds are then gone through
backwards: a node that was spliced out gets its total from that of the child it was spliced onto.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, bounded_batches
from tessera.operators import scan

#: A conversation's base is the one at the last multiple of GROUP; it lends less than LENT turns.
GROUP, LENT = 5, 9
#: Parts of a node's name, 32 bits each: sums of 2**31 turns fit.
WORDS = ("w0", "w1", "w2", "w3")
NODE = "struct<a:bigint,b:bigint>"
OUT = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def numbered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str, scratch: Scratch) -> DataFrame:
    """(conv, pos, turn_hash, bytes): turns by place from 1, without their texts."""
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        role_.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"))).alias("turn_hash"),
        F.octet_length(text_).cast("bigint").alias("bytes"),
    )
    placed = scan.numbered(rows, ["conv"], ["turn", "role", "turn_hash"], "pos", store=scratch.stored)
    return scratch.stored(placed.select("conv", F.col("pos").cast("bigint").alias("pos"), "turn_hash", "bytes"), "turns")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations with `last`, (conv, length) of all of them).

    The first h turns of a conversation are its base's, h from a hash of its number; its own follow after its first h.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % LENT
    sizes = scratch.stored(turns.groupBy("conv").agg(F.max("pos").alias("n")).select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base")), "sizes")
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    per = sizes.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    per = scratch.stored(per.withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv", "base", "h", "lent", "length"), "lengths")
    own = turns.join(per.select("conv", "h", "lent", "length"), "conv").where(F.col("pos") > F.col("h"))
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "turn_hash", "bytes", "length")
    first = turns.where(F.col("pos") < LENT).select(F.col("conv").alias("base"), "pos", "turn_hash", "bytes")
    lent = per.where(F.col("lent") > 0).join(first, "base").where(F.col("pos") <= F.col("lent")).select("conv", "pos", "turn_hash", "bytes", "length")
    both = own.unionByName(lent)
    return both.withColumn("last", F.col("pos") == F.col("length")).drop("length"), per.select("conv", "length")


def prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, parent, depth, conv, bytes, last): the node of every rebuilt conversation at every depth from 1."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    one, two = F.xxhash64("turn_hash", "pos"), F.xxhash64("pos", "turn_hash")
    words = dict(zip(WORDS, (one.bitwiseAND(mask), F.shiftrightunsigned(one, 32), two.bitwiseAND(mask), F.shiftrightunsigned(two, 32)), strict=True))
    sums = {f"s{w}": c for w, c in words.items()}
    rows = scan.summed(turns.withColumns(words), ["conv"], ["pos"], sums, store=scratch.stored)
    half = lambda x, y: F.shiftleft(x.bitwiseAND(mask), 32).bitwiseOR(y.bitwiseAND(mask))
    name = lambda s: F.struct(half(s[0], s[1]).alias("a"), half(s[2], s[3]).alias("b"))
    here, above = [F.col(f"s{w}") for w in WORDS], [F.col(f"s{w}") - F.col(w) for w in WORDS]
    return rows.select(name(here).alias("node"), name(above).alias("parent"), F.col("pos").alias("depth"), "conv", "bytes", "last")


def ends(ended: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, ends_sha256) of (node, conv): hashes of the numbers that end at a node, in order, however many.

    Ranges of the numbers become strings; a node's strings run through one hash, which can't be split, a row each.
    """
    spread = scan.cut(ended.select("node", "conv"), ["node"], ["conv"], store=scratch.stored)
    texts = spread.groupBy("node", scan.SEGMENT).agg(F.array_sort(F.collect_list("conv")).alias("c"))  # of one node in one range
    texts = texts.select("node", scan.SEGMENT, F.array_join(F.transform("c", lambda c: c.cast("string")), ",").alias("c"))
    ordered = texts.repartition("node").sortWithinPartitions("node", scan.SEGMENT)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("node", pa.struct([("a", pa.int64()), ("b", pa.int64())])), ("ends_sha256", pa.string())])
        held, state = None, None
        for batch in batches:
            out = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node == held:
                    state.update(b",")
                else:
                    if held:
                        out.append((held, state.hexdigest()))
                    held, state = node, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((held, state.hexdigest()), kind, strict=True)], schema=kind)

    return ordered.mapInArrow(hashed, f"node {NODE}, ends_sha256 string")


def _raked(active: DataFrame) -> DataFrame:
    """A round's rake: leaves marked `raked`, the others with what their leaves hand up, and who is left below them."""
    leaf = F.col("live") == 0
    below = active.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("of")).agg(
        *[F.coalesce(F.sum(F.when(leaf, F.col(c) + F.col(f"edge_{c}"))), F.lit(0)).alias(f"up_{c}") for c in ("leaves", "saved")],
        F.count_if(~leaf).alias("left"),
        F.min(F.when(~leaf, F.col("node"))).alias("child"),
    )
    joined = active.join(below, active["node"] == below["of"], "left")
    more = {c: F.col(c) + F.coalesce(f"up_{c}", F.lit(0)) for c in ("leaves", "saved")}
    joined = joined.withColumn("raked", leaf & F.col("parent").isNotNull()).withColumns(more)
    return joined.withColumns({"live": F.coalesce("left", F.lit(0)), "only": F.col("child")}).drop("of", "up_leaves", "up_saved", "left", "child")


def _spliced(rest: DataFrame, number: int) -> DataFrame:
    """The unary nodes of a round that go: those whose hash is above both neighbours', so no two are neighbours."""
    order = lambda c: F.struct(F.xxhash64(c, F.lit(number)), F.col(c))
    taken = F.coalesce((F.col("live") == 1) & (order("node") > order("parent")) & (order("node") > order("only")), F.lit(False))
    return rest.withColumn("gone", taken & F.col("parent").isNotNull())


def _compressed(state: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """(what is left after the round, (node, child, leaves, saved) of those spliced out: their total less the child's)."""
    rest = _spliced(state.where(~F.col("raked")).drop("raked"), number)
    gone = rest.where("gone").select(F.col("only").alias("below"), F.col("node").alias("v"), F.col("parent").alias("v_parent"), *[F.col(c).alias(f"v_{c}") for c in ("leaves", "saved", "edge_leaves", "edge_saved")])
    joined = rest.where("not gone").drop("gone").join(gone, F.col("node") == F.col("below"), "left")
    records = joined.where(F.col("v").isNotNull()).select(F.col("v").alias("node"), F.col("node").alias("child"), *[(F.col(f"v_{c}") + F.col(f"edge_{c}")).alias(c) for c in ("leaves", "saved")])
    handed = {f"edge_{c}": F.col(f"edge_{c}") + F.coalesce(f"v_{c}", F.lit(0)) + F.coalesce(f"v_edge_{c}", F.lit(0)) for c in ("leaves", "saved")}
    left = joined.withColumns({"parent": F.coalesce("v_parent", "parent"), **handed})
    return left.select("node", "parent", "leaves", "saved", "edge_leaves", "edge_saved", "live", "only"), records


def subtree_totals(tree: DataFrame, scratch: Scratch, most: int = 400) -> DataFrame:
    """(node, leaves, saved): sums over every subtree of tree (node, parent, n_children, weight); the root has no parent.

    Raises if `most` rounds don't leave the root alone, which takes a table that isn't one tree.
    """
    none = F.lit(0).cast("bigint")
    active = tree.select(
        "node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), F.col("weight").alias("saved"),
        none.alias("edge_leaves"), none.alias("edge_saved"), F.col("n_children").alias("live"), F.lit(None).cast(NODE).alias("only"),
    )
    rounds = []
    for number in range(most):
        state = scratch.stored(_raked(active), "raked")
        rounds.append(state)
        if not state.where(~F.col("raked") & F.col("parent").isNotNull()).limit(1).count():
            break
        active, _ = _compressed(state, number)
    else:
        raise RuntimeError(f"the tree isn't contracted after {most} rounds")

    totals = lambda rows: rows.select("node", "leaves", "saved")
    known = [totals(rounds[-1])]  # the root and the leaves of the last round
    for number in range(len(rounds) - 2, -1, -1):
        _, records = _compressed(rounds[number], number)
        later = reduce(DataFrame.unionByName, known).withColumnsRenamed({"node": "child", "leaves": "below_leaves", "saved": "below_saved"})
        back = records.join(later, "child").select("node", *[(F.col(c) + F.col(f"below_{c}")).alias(c) for c in ("leaves", "saved")])
        known += [scratch.stored(back, "expanded"), totals(rounds[number].where("raked"))]
    return reduce(DataFrame.unionByName, known)


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per node of the trie of rebuilt conversations: see OUT.

    Rows without a conversation have no part. Turns go by `turn`, nulls first, then by role and by a hash of both role
    and text, so that ties have an order; null roles and texts are empty, repeated rows are turns of their own. The
    base of a negative number is the one nearer to zero, as `%` has it. The root is there unless there is no
    conversation: an empty table gives an empty result. Prefixes are told apart by 128-bit hashes. Other columns are
    not read.
    """
    spark, scratch = conversations.sparkSession, Scratch(conversations.sparkSession)
    bounded_batches(spark)
    turns = numbered_turns(conversations, conv, turn, role, text, scratch)
    both, lengths = rebuilt(turns, scratch)
    rows = scratch.stored(prefixes(both, scratch), "prefixes")
    top = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    root = lengths.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(top.alias("node"), F.lit(None).cast(NODE).alias("parent"), F.lit(0).cast("bigint").alias("depth"), "conv", "n_convs", F.lit(0).cast("bigint").alias("bytes"))
    nodes = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    nodes = scratch.stored(nodes.unionByName(root), "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    tree = nodes.join(children, nodes["node"] == children["of"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("of")
    tree = scratch.stored(tree.withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes")), "tree")
    ended = rows.where("last").select("node", "conv").unionByName(lengths.where("length = 0").select(top.alias("node"), "conv"))
    hashes = scratch.stored(ends(ended, scratch), "ends")
    totals = scratch.stored(subtree_totals(tree, scratch) if not tree.isEmpty() else spark.createDataFrame([], f"node {NODE}, leaves bigint, saved bigint"), "totals")

    above = nodes.select(F.col("node").alias("of"), F.col("conv").alias("parent_conv_id"))
    whole = scratch.stored(tree.join(totals, "node").join(hashes, "node", "left"), "whole")
    out = whole.join(above, whole["parent"] == above["of"], "left")
    named = {"conv_id": "conv", "n_leaves": "leaves", "saved_tokens": "saved"}
    names = [c.split()[0] for c in OUT.split(", ")]
    out = out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    return scratch.result(out.select(*[F.col(named.get(c, c)).alias(c) for c in names]), "trie")
