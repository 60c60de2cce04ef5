"""Prefix trie of conversations by partition refinement.

All conversations start in one class.  A turn splits a class by what is said, so
a class is named by the chain of its turns' digests, and a node of the trie is a
class with its depth.  A round takes the next turns of the conversations that
still share a class (``FIRST_TURNS`` at first, then ``TURNS``), names the classes
of all of them and sizes them in one aggregation.  A conversation that is alone
in its class is retired: the rest of it is a unary chain, which is written down
turn by turn and neither hashed nor shuffled again.

Sums over subtrees are folded back over the shared classes only, by doubling:
a class first holds its own value, then in step ``i`` takes what the classes
``2**i`` levels below it hold, so a trie of any depth takes a logarithmic number
of steps.  Lookups of classes that hold over a thousandth of the rows, at most a
thousand of them, are broadcast; all others are shuffled.

Defined results: a null role or text is empty; turns are ordered by ``turn``
(null first), then by the digest of role and text; rows without a conversation
id belong to none; repeated rows are turns of their own; an empty table has no
nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import token_count
from .runtime import free, saved

#: Turns of the first round, which holds all that are shared by position, and of every later one.
FIRST_TURNS, TURNS = 4, 64
#: Conversations of a block share the turns that their first one begins with; fixed values of the task.
BLOCK, MOST_SHARED = 20, 3
#: Logarithm of the range of ids whose decimal forms are joined before they are hashed.
ID_RANGE_BITS = 12
#: A class with a larger share of the rows than one in so many is looked up by broadcast.
HOT_SHARE = 1000
ROOT = b""
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """What is said, as 32 bytes; the length of the role tells where the text begins."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, words``: the turns of each conversation, numbered from 0.

    Rows are sorted as a whole by ranges, so a conversation of any length is
    spread over tasks; one that goes on in another range is counted on from
    where it was left, which concerns at most two conversations of each range.
    """
    said = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), token_count(F.col("text")).alias("words")
    )
    parts = said.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = said.repartitionByRange(int(parts), "conv_id", F.col("turn").asc_nulls_first(), "digest").withColumn("part", F.spark_partition_id())
    here = Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    numbered = saved(placed.select("part", "conv_id", "digest", "words", (F.row_number().over(here) - 1).cast("long").alias("at")))
    sizes = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("shift", F.sum("n").over(before)).where("shift is not null").select("conv_id", "part", "shift")
    # One conversation at most reaches into a range from the range before it.
    joined = numbered.join(F.broadcast(shifts), ["conv_id", "part"], "left")
    return joined.select("conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("pos"), "digest", "words")


def _round_of(pos: Column) -> Column:
    return F.when(pos < FIRST_TURNS, F.lit(0)).otherwise(F.floor((pos - FIRST_TURNS) / TURNS) + 1).cast("int")


def round_start(number: Column) -> Column:
    """Place of the first turn of a round."""
    return F.when(number == 0, F.lit(0)).otherwise(FIRST_TURNS + (number - 1) * TURNS).cast("long")


def _packed(turns: DataFrame, *keys: str) -> DataFrame:
    """The turns of each round of a conversation in order; a round has a bounded number of them."""
    packed = turns.groupBy("conv_id", _round_of(F.col("pos")).alias("round")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"), *(F.first(k).alias(k) for k in keys)
    )
    return packed


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with the first turns of its block's first one in place of its own.

    ``conv_id, round, size, turns`` for every round of turns, and ``conv_id,
    size`` for every conversation, turnless ones included.
    """
    own = saved(_packed(turns))
    head = F.transform(F.slice("turns", 1, MOST_SHARED), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    heads = own.where((F.col("conv_id") % BLOCK == 0) & (F.col("round") == 0)).select(F.col("conv_id").alias("block"), head.alias("head"))
    sizes = own.groupBy("conv_id").agg(F.sum(F.size("turns")).alias("n"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    plan = sizes.withColumns({"block": F.col("conv_id") - F.col("conv_id") % BLOCK, "h": shared}).join(heads, "block", "left")
    plan = plan.withColumn("head", F.when(F.col("head").isNull() | (F.col("h") == 0), F.filter("head", lambda t: F.lit(False))).otherwise(F.slice("head", 1, F.greatest("h", F.lit(1)))))
    taken = F.greatest(F.coalesce(F.size("head"), F.lit(0)), F.lit(0))
    plan = saved(plan.withColumn("p", taken).select("conv_id", "h", "p", "head", (F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    later = own.join(plan.drop("head"), "conv_id").select("conv_id", "h", "p", "size", F.inline("turns")).where("pos >= h")
    later = later.select("conv_id", (F.col("pos") - F.col("h") + F.col("p")).alias("pos"), "digest", "words", "size")
    first = plan.select("conv_id", "size", F.posexplode("head").alias("pos", "t")).select("conv_id", F.col("pos").cast("long"), "t.digest", "t.words", "size")
    return saved(_packed(later.unionByName(first), "size")), plan.select("conv_id", "size")


def lookup(rows: DataFrame, classes: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a table of unique ``key``; ``weight`` is at least the number of rows that look for it.

    Keys of a large share of all rows are few, and are broadcast.
    """
    total = classes.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE > total
    heavy = F.broadcast(classes.where(hot).drop(weight))
    light = classes.where(~hot).drop(weight)
    marked = rows.join(heavy.withColumn("_hot", F.lit(True)), key, "left")
    new = [c for c in heavy.columns if c != key]
    easy = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot is null").drop("_hot", *new).join(light, key, how)
    return easy.unionByName(rest)


def _levels(active: DataFrame) -> DataFrame:
    """One row for each turn of the active conversations: its class, the class it splits, and whether the conversation ends with it."""
    empty = F.filter(F.array(F.struct(F.col("cls"), F.col("cls").alias("parent"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("words"))), lambda x: F.lit(False))

    def split(made: Column, t: Column) -> Column:
        parent = F.coalesce(F.try_element_at(made, F.lit(-1))["cls"], F.col("cls"))
        name = F.unhex(F.sha2(F.concat(parent, t["digest"]), 256))
        return F.concat(made, F.array(F.struct(name.alias("cls"), parent.alias("parent"), t["pos"].alias("pos"), t["words"].alias("words"))))

    named = active.select("conv_id", "size", F.aggregate("turns", empty, split).alias("levels"))
    each = named.select("conv_id", "size", F.inline("levels"))
    return each.select("conv_id", "cls", "parent", (F.col("pos") + 1).alias("depth"), "words", (F.col("pos") + 1 == F.col("size")).alias("ends"), "size")


def refine(packed: DataFrame, everyone: DataFrame) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """``nodes`` of the rounds, ``conv_id, round`` of the conversations retired with turns left, and ``cls, conv_id`` of the ends."""
    spark = packed.sparkSession
    nodes, retired, ends = [], [], [everyone.where("size = 0").select(F.lit(ROOT).alias("cls"), "conv_id")]
    active = everyone.where("size > 0").select("conv_id", F.lit(ROOT).alias("cls"))
    if everyone.limit(2).count() < 2:
        # A single conversation is alone from the start.
        active, single = active.where("false"), active
        retired.append(single.select("conv_id", F.lit(-1).alias("round")))
    number = 0
    while not active.isEmpty():
        levels = saved(_levels(packed.where(F.col("round") == number).join(active, "conv_id")))
        sized = levels.groupBy("cls").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"), F.first("words").alias("words"), F.count_if("ends").alias("n_ends"),
        )
        sized = saved(sized)
        nodes.append(sized)
        ends.append(levels.where("ends").select("cls", "conv_id"))
        border = FIRST_TURNS + number * TURNS
        going_on = levels.where((F.col("depth") == border) & ~F.col("ends")).select("conv_id", "cls")
        at_border = sized.where((F.col("depth") == border) & (F.col("n_convs") > F.col("n_ends"))).select("cls", "n_convs", F.col("n_convs").alias("members"))
        placed = saved(lookup(going_on, at_border, "cls", "members"))
        retired.append(placed.where("n_convs = 1").select("conv_id", F.lit(number).alias("round")))
        active = placed.where("n_convs > 1").select("conv_id", "cls")
        number += 1
    gone = retired[0] if retired else spark.createDataFrame([], "conv_id long, round int")
    for more in retired[1:]:
        gone = gone.unionByName(more)
    return nodes, gone, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """``cls, ends_sha256``: the digest of the ids in order, comma-joined.

    Ids are joined by ranges first, so a class of any size is a sorted stream of
    its ranges, and the task that digests it holds one range at a time.
    """
    span = F.col("conv_id").cast("long")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    ranges = ends.groupBy("cls", F.shiftright(span, ID_RANGE_BITS).alias("range")).agg(ids.alias("ids"))
    arrow = pa.schema([("cls", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = state = None
        for batch in batches:
            done = []
            for name, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is not None and name == cls:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((cls, state.hexdigest()))
                    cls, state = name, hashlib.sha256()
                state.update(joined.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([cls], pa.binary()), pa.array([state.hexdigest()])], schema=arrow)

    ordered = ranges.repartition("cls").sortWithinPartitions("cls", "range").select("cls", "ids")
    return ordered.mapInArrow(run, "cls binary, ends_sha256 string")


def fold_back(shared: DataFrame, depth: int) -> DataFrame:
    """``cls, n_leaves, saved_tokens`` over the subtrees of the shared classes.

    ``shared`` has ``cls, parent, leaves, saved, kids``; the root is its own
    total and has no pointer.
    """
    state = saved(shared.select("cls", F.col("parent").alias("up"), "leaves", "saved"))
    for _ in range(max(depth - 1, 0).bit_length()):
        pointed = state.where(F.col("up") != F.lit(ROOT))
        given = pointed.groupBy(F.col("up").alias("cls")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("pointers"))
        given = saved(given)
        jumps = given.select("cls", "pointers").join(state.select("cls", F.col("up").alias("next")), "cls")
        moved = lookup(pointed.select("cls", F.col("up")).withColumnRenamed("cls", "own").withColumnRenamed("up", "cls"), jumps, "cls", "pointers")
        moved = moved.select(F.col("own").alias("cls"), "next")
        took = state.drop("up").join(given.drop("pointers"), "cls", "left").join(moved, "cls", "left")
        after = saved(took.select(
            "cls", F.coalesce("next", F.lit(ROOT)).alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        ))
        free(state, given)
        state = after
    return state.select("cls", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; ``conv_id`` is the smallest member.
    """
    packed, everyone = rebuilt(ordered_turns(conversations))
    rounds, retired, ended = refine(packed, everyone)
    top = everyone.agg(F.min("conv_id").alias("low"), F.count("*").alias("n")).first()
    spark = conversations.sparkSession
    nodes = spark.createDataFrame([], "cls binary, parent binary, depth long, conv_id long, n_convs long, words long, n_ends long")
    for sized in rounds:
        nodes = nodes.unionByName(sized)
    # The root has members but no text; it is the parent of the first level.
    root_row = [(ROOT, None, 0, top["low"], top["n"], 0, everyone.where("size = 0").count())] if top["n"] else []
    root = spark.createDataFrame(root_row, nodes.schema)
    kids = nodes.groupBy(F.col("parent").alias("cls")).agg(F.count("*").alias("kids"), F.count_if(F.col("n_convs") == 1).alias("single_kids"))
    is_shared = (F.col("n_convs") > 1) | (F.col("cls") == F.lit(ROOT))
    # Of a single conversation not even the first turns are refined.
    chain_kids = F.lit(1 if top["n"] == 1 and root_row[0][-1] == 0 else 0)
    known = nodes.where(is_shared).unionByName(root).join(kids, "cls", "left").withColumn("is_root", F.col("cls") == F.lit(ROOT))
    known = known.withColumns({
        "kids": F.coalesce("kids", F.lit(0)) + F.when(F.col("is_root"), chain_kids).otherwise(0),
        "saved": (F.col("n_convs") - 1) * F.col("words"),
    })
    own_leaf = F.when(F.col("kids") == F.when(F.col("is_root"), chain_kids).otherwise(0), 1).otherwise(0)
    known = saved(known.withColumn("leaves", F.coalesce("single_kids", F.lit(0)) + own_leaf))
    inner = known.where(~F.col("is_root"))
    deepest = inner.agg(F.max("depth")).first()[0] or 0
    # What all classes hold by themselves is what the root holds in all.
    whole = known.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).first()
    folded = fold_back(inner, deepest).unionByName(
        spark.createDataFrame([(ROOT, whole["leaves"], whole["saved"])] if top["n"] else [], "cls binary, n_leaves long, saved_tokens long")
    )
    digests = ended[0]
    for more in ended[1:]:
        digests = digests.unionByName(more)
    digests = saved(end_digests(digests))
    shared_rows = known.select("cls", "parent", "depth", "conv_id", "n_convs", F.col("kids").alias("n_children")).join(folded, "cls")
    single_rows = nodes.where("n_convs = 1").select(
        "cls", "parent", "depth", "conv_id", "n_convs", (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens")
    )
    refined = shared_rows.unionByName(single_rows).join(digests, "cls", "left")
    owners = known.select(F.col("cls").alias("parent"), F.col("conv_id").alias("owner"), F.col("kids"))
    # The parent of a class of one is a class of one as well, unless it is known.
    hung = lookup(refined.where("depth > 0"), owners, "parent", "kids", "left").withColumn("parent_conv_id", F.coalesce("owner", "conv_id"))
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    hung = hung.unionByName(refined.where("depth = 0").withColumns({"owner": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")}))
    return hung.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(*names).unionByName(_chains(packed, retired).select(*names))


def _chains(packed: DataFrame, retired: DataFrame) -> DataFrame:
    """The nodes of what is left of the retired conversations: one for each turn."""
    rest = packed.join(retired.withColumnRenamed("round", "gone"), "conv_id").where("round > gone")
    each = rest.select("conv_id", "size", F.explode(F.transform("turns", lambda t: t["pos"] + 1)).alias("depth"))
    last = F.col("depth") == F.col("size")
    return each.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NO_ENDS).alias("ends_sha256"),
    )
