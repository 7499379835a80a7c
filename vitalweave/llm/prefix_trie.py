"""Prefix trie of conversations, measured along an Euler tour.

Turns lie in sorted ranges, so that a long conversation is spread over many tasks; running
sums take the totals of its earlier ranges along. A node is a depth with the sum of the hashes
of the turns so far; it is named by its smallest member and its depth.

Each node has an arc into it and an arc out of it. The arcs follow each other as the tour of
the trie, children by their smallest member. The tour is ranked as a linked list: every task
ranks the pieces of it that lie in its own range of nodes and leaves one link of each, the
list of those links is ranked, and the ranks go back to the pieces. A rank is the number of
arcs up to the end of the tour with the leaves and savings on them; what lies in a subtree is
the difference between the sums at its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalweave.llm.common import stored

#: Nodes whose arcs a task ranks at once, about.
TASK_NODES = 100_000
#: Links that one task ranks; if there are more, each is doubled by joins until it reaches the end.
TASK_LINKS = 500_000
#: Turns that a conversation shares with its base are fewer than this.
SHARED = 9
#: The hash of a turn, as four numbers of 32 bits whose sums stay below 2**63.
LANES = ("lane0", "lane1", "lane2", "lane3")
ENDED = hashlib.sha256().hexdigest()


def turn_rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, digest (of role and text) and size (UTF-8 bytes of the text) of each row that has an id."""
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said)
    rows = conversations.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        F.octet_length(said).cast("long").alias("size"),
    )
    return rows.filter("conv IS NOT NULL")


def _ranges(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """The rows stored in ranges of ``keys``, sorted, with the number of the range as ``part``."""
    dealt = df.repartitionByRange(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys)
    return stored(dealt.withColumn("part", F.spark_partition_id()))


def _running(rows: DataFrame, order: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """``rows`` of (conv, part, ...) with the running sum of each value in its conversation.

    Sums run within a range; the totals of a conversation's earlier ranges, at most one row
    for each range, are added.
    """
    inside = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "part").agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    earlier = totals.withColumns({f"_{n}": F.sum(f"_{n}").over(before) for n in values})
    earlier = earlier.filter(F.col(f"_{next(iter(values))}").isNotNull())
    summed = rows.withColumns({n: F.sum(v).over(inside) for n, v in values.items()})
    whole = summed.join(earlier, ["conv", "part"], "left")
    return whole.select(*rows.columns, *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in values])


def shared_turns() -> Column:
    """Number of first turns that a conversation takes from its base: crc32 of its decimal id, modulo 9."""
    return F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED


def rebuild(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, size) of all rebuilt turns, in ranges, and (conv) of all conversations.

    A conversation begins with the first turns of its base, the one whose id is the next
    multiple of five downwards; its own turns after as many follow.
    """
    listed = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = _running(_ranges(listed, ["conv", "turn", "digest", "tie"]), ["turn", "digest", "tie"], {"place": F.lit(1).cast("long")})
    placed = stored(placed.select("conv", "place", "digest", "size"))
    convs = placed.filter("place = 1").select("conv")
    first = placed.filter(F.col("place") < SHARED).withColumnRenamed("conv", "base")
    taken = convs.select("conv", (F.col("conv") - F.col("conv") % 5).alias("base"), shared_turns().alias("shared")).join(first, "base")
    taken = taken.filter("place <= shared").select(placed.columns)
    own = placed.filter(F.col("place") > shared_turns())
    ranged = _ranges(taken.unionByName(own), ["conv", "place"])
    return _running(ranged, ["place"], {"depth": F.lit(1).cast("long")}), convs


def _key(depth: Column, lanes: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in lanes]).cast("binary"), 256))


ROOT = hashlib.sha256(",".join("0" * (1 + len(LANES))).encode()).digest()


def member_nodes(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, key, up, size) of each conversation's nodes below the root; ``up`` is the key of the node above."""
    hashes = [F.xxhash64(F.lit(seed), F.col("digest"), F.col("depth")) for seed in (1, 2)]
    low = F.lit(0xFFFFFFFF).cast("long")
    parts = [p for h in hashes for p in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]
    marked = rebuilt.withColumns({f"own{i}": p for i, p in enumerate(parts)})
    summed = _running(marked, ["place"], {n: F.col(f"own{i}") for i, n in enumerate(LANES)})
    lanes = [F.col(n) for n in LANES]
    above = [F.col(n) - F.col(f"own{i}") for i, n in enumerate(LANES)]
    return summed.select("conv", "depth", _key(F.col("depth"), lanes).alias("key"), _key(F.col("depth") - 1, above).alias("up"), "size")


def _named(members: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, n_convs, worth) of all nodes: by smallest member, with that of the node above."""
    grouped = members.groupBy("key").agg(
        F.min("conv").alias("conv"), F.any_value("depth").alias("depth"), F.any_value("up").alias("up"),
        F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"),
    )
    nodes = stored(grouped.select("conv", "depth", "key", "up", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("worth")))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("worth"))
    # All nodes of depth 1 have the root above, so the one key that most nodes may share needs no join.
    top = F.lit(convs.agg(F.min("conv")).first()[0]).cast("long")
    first = nodes.filter("depth = 1").withColumn("parent", top)
    above = nodes.select(F.col("key").alias("up"), F.col("conv").alias("parent"))
    deeper = nodes.filter("depth > 1").join(above, "up")
    whole = first.select(root.columns).unionByName(deeper.select(root.columns)).unionByName(root)
    return stored(whole)


def _neighbours(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the number, first and last of their children, and the sibling on either side."""
    children = nodes.filter("depth > 0").groupBy("parent", "depth").agg(
        F.count(F.lit(1)).alias("n_children"), F.min("conv").alias("first_child"), F.max("conv").alias("last_child")
    )
    children = children.select(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth"), "n_children", "first_child", "last_child")
    ranged = _ranges(nodes, ["depth", "parent", "conv"])
    inside = Window.partitionBy("depth", "parent", "part").orderBy("conv")
    across = Window.partitionBy("depth", "parent").orderBy("part")
    edges = ranged.groupBy("depth", "parent", "part").agg(F.min("conv").alias("least"), F.max("conv").alias("most"))
    edges = edges.withColumns({"left": F.lag("most").over(across), "right": F.lead("least").over(across)})
    # Only siblings that lie in several ranges have neighbours elsewhere.
    edges = edges.filter("left IS NOT NULL OR right IS NOT NULL").drop("least", "most")
    beside = ranged.withColumns({"before": F.lag("conv").over(inside), "after": F.lead("conv").over(inside)})
    beside = beside.join(edges, ["depth", "parent", "part"], "left").select(
        *nodes.columns, F.coalesce("before", "left").alias("before"), F.coalesce("after", "right").alias("after")
    )
    return beside.join(children, ["conv", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


PLACES = ("conv", "depth", "parent", "worth", "before", "after", "first_child", "last_child")


class Arcs:
    """The arcs of a range of nodes sorted by (conv, depth): 2 i leads into node i and 2 i + 1 out of it.

    An arc is named by its node's conv and by 2 * depth, plus one for the arc out.
    """

    def __init__(self, columns: Sequence[np.ndarray], known: Sequence[np.ndarray]):
        """``columns`` are those of PLACES, ``known`` says where they are not null."""
        conv, depth, parent, worth, before, after, first, last = columns
        has = dict(zip(PLACES, known))
        self.conv, self.depth = conv, depth
        self.begins = np.concatenate(([0], np.flatnonzero(np.diff(conv)) + 1)) if len(conv) else np.zeros(0, np.int64)
        self.size = 2 * len(conv)
        leaf, root = ~has["first_child"], depth == 0
        # Where each arc leads to, and where the one before it comes from.
        into = np.where(leaf, conv, first), np.where(leaf, 2 * depth + 1, 2 * depth + 2)
        out = np.where(has["after"], after, np.where(root, 0, parent)), np.where(has["after"], 2 * depth, 2 * depth - 1)
        self.to = [self._woven(a, b) for a, b in zip(into, out)]
        self.ends = self._woven(np.zeros(len(conv), bool), root & ~has["after"])
        above = np.where(has["before"], before, np.where(root, 0, parent)), np.where(has["before"], 2 * depth + 1, 2 * depth - 2)
        under = np.where(leaf, conv, last), np.where(leaf, 2 * depth, 2 * depth + 3)
        self.next = np.where(self.ends, -1, self.find(*self.to))
        self.head = np.where(self._woven(root & ~has["before"], np.zeros(len(conv), bool)), -1, self.find(*[self._woven(a, b) for a, b in zip(above, under)])) < 0
        zero = np.zeros(len(conv), np.int64)
        weights = np.stack([np.ones(self.size, np.int64), self._woven(leaf.astype(np.int64), zero), self._woven(worth, zero)])
        self.sums, self.tail = ranked(self.next, weights)

    @staticmethod
    def _woven(into: np.ndarray, out: np.ndarray) -> np.ndarray:
        return np.stack([into, out], 1).reshape(-1)

    def find(self, conv: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Places of arcs in this range, -1 of others. The nodes of a conversation are neighbours here, depth by depth."""
        if not len(self.conv):
            return np.zeros(0, np.int64)
        run = np.searchsorted(self.conv[self.begins], conv)
        node = self.begins[np.minimum(run, len(self.begins) - 1)]
        node = node + name // 2 - self.depth[node]
        inside = (node >= 0) & (node < len(self.conv))
        node = np.where(inside, node, 0)
        return np.where(inside & (self.conv[node] == conv) & (self.depth[node] == name // 2), 2 * node + name % 2, -1)


def ranked(follows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``weights`` from each element to the end of its list, and that end; ``follows`` is -1 at the ends."""
    sums, tail, follows = weights.copy(), np.arange(len(follows)), follows.copy()
    at = np.flatnonzero(follows >= 0)
    while len(at):
        to = follows[at]
        sums[:, at] += sums[:, to]
        tail[at], follows[at] = tail[to], follows[to]
        at = at[follows[at] >= 0]
    return sums, tail


def _arcs_of(rows: pa.Table) -> Arcs:
    columns = [rows.column(n).combine_chunks() for n in PLACES]
    return Arcs([c.fill_null(0).to_numpy(zero_copy_only=False) for c in columns], [c.is_valid().to_numpy(zero_copy_only=False) for c in columns])


LINK = "part long, conv long, name long, to_conv long, to_name long, arcs long, leaves long, saved long"
LINK_NAMES = [x.split()[0] for x in LINK.split(", ")]


def _links(places: DataFrame) -> DataFrame:
    """For each piece of the tour that lies in one range: its first arc, the arc after its last one (null at the end), its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        arcs = _arcs_of(rows)
        head = np.flatnonzero(arcs.head)
        tail = arcs.tail[head]
        over = arcs.ends[tail]
        found = [np.full(len(head), rows.column("part")[0].as_py()), arcs.conv[head // 2], 2 * arcs.depth[head // 2] + head % 2]
        after = [pa.array(t[tail], pa.int64(), mask=over) for t in arcs.to]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found), *after, *(pa.array(s[head], pa.int64()) for s in arcs.sums)], names=LINK_NAMES)

    return places.mapInArrow(run, LINK)


def _whole_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a list that one task holds."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    get = lambda n: rows.column(n).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    keys, targets = (np.stack([get(a), get(b)], 1) for a, b in (("conv", "name"), ("to_conv", "to_name")))
    _, number = np.unique(np.concatenate([keys, targets]), axis=0, return_inverse=True)
    number = number.reshape(-1)
    place = np.full(number.max() + 1, -1)
    place[number[: len(keys)]] = np.arange(len(keys))
    follows = np.where(rows.column("to_conv").is_valid().to_numpy(), place[number[len(keys) :]], -1)
    sums, _ = ranked(follows, np.stack([get(n) for n in ("arcs", "leaves", "saved")]))
    yield pa.RecordBatch.from_arrays([pa.array(get(n), pa.int64()) for n in ("part", "conv", "name")] + [pa.array(s, pa.int64()) for s in sums], names=["part", "conv", "name", "arcs", "leaves", "saved"])


RANK = "part long, conv long, name long, arcs long, leaves long, saved long"


def _ranks(links: DataFrame, task_links: int) -> DataFrame:
    """The sums from each link to the end of the tour."""
    links = stored(links)
    if links.count() <= task_links:
        return links.coalesce(1).mapInArrow(_whole_list, RANK)
    sums = ["arcs", "leaves", "saved"]
    while not links.filter("to_conv IS NOT NULL").isEmpty():
        ahead = links.select(F.col("conv").alias("to_conv"), F.col("name").alias("to_name"), F.col("to_conv").alias("on_conv"), F.col("to_name").alias("on_name"), *[F.col(s).alias(f"on_{s}") for s in sums])
        # Every link is the next of one other at most, so no key has more than a row on either side.
        moved = links.filter("to_conv IS NOT NULL").join(ahead, ["to_conv", "to_name"])
        moved = moved.select("part", "conv", "name", F.col("on_conv").alias("to_conv"), F.col("on_name").alias("to_name"), *[(F.col(s) + F.col(f"on_{s}")).alias(s) for s in sums])
        links = stored(links.filter("to_conv IS NULL").unionByName(moved))
    return links.select(RANK.replace(" long", "").split(", "))


TOUR = "conv long, depth long, enter long, exit long, n_leaves long, saved_tokens long"


def _finished(rows: pa.Table, ranks: pa.Table) -> pa.Table:
    """The nodes of one range with the arcs left on the tour at their own two arcs, and the sums of their subtrees."""
    if not rows.num_rows:
        return pa.table({x.split()[0]: pa.array([], pa.int64()) for x in TOUR.split(", ")})
    arcs = _arcs_of(rows.sort_by([("conv", "ascending"), ("depth", "ascending")]))
    get = lambda n: ranks.column(n).to_numpy()
    head = arcs.find(get("conv"), get("name"))
    # What comes after a piece is the same for all of its arcs.
    after = np.zeros_like(arcs.sums)
    after[:, arcs.tail[head]] = np.stack([get("arcs"), get("leaves"), get("saved")]) - arcs.sums[:, head]
    sums = arcs.sums + after[:, arcs.tail]
    into, out = sums[:, ::2], sums[:, 1::2]
    made = [arcs.conv, arcs.depth, into[0], out[0], into[1] - out[1], into[2] - out[2]]
    return pa.table([pa.array(x, pa.int64()) for x in made], names=[x.split()[0] for x in TOUR.split(", ")])


def tour(nodes: DataFrame, task_nodes: int = TASK_NODES, task_links: int = TASK_LINKS) -> DataFrame:
    """(conv, depth, enter, exit, n_leaves, saved_tokens): the ranks of the two arcs of each node, and its subtree's sums.

    ``nodes`` has the columns of PLACES. ``enter`` and ``exit`` count arcs from the end of the
    tour, the arc itself included.
    """
    tasks = max(1, -(-nodes.count() // task_nodes))
    places = _ranges(nodes.select(*PLACES), ["conv", "depth"], tasks)
    ranks = _ranks(_links(places), task_links)
    both = places.withColumn("part", F.col("part").cast("long")).groupBy("part").cogroup(ranks.groupBy("part"))
    return both.applyInArrow(_finished, TOUR)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of the ascending ids (conv) of each key, comma-joined.

    Ids are sorted in ranges and joined to one piece for each key and range; a key's pieces
    go through one task as a stream, which holds none but the present one.
    """
    ranged = _ranges(ends.select("key", "conv"), ["key", "conv"])
    listed = F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",")
    pieces = ranged.groupBy("key", "part").agg(listed.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, hashes = [], []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != key:
                    if key is not None:
                        keys.append(key)
                        hashes.append(digest.hexdigest())
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    dealt = pieces.select("key", "part", "ids").repartition("key").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    task_nodes: int = TASK_NODES,
    task_links: int = TASK_LINKS,
) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations, see :func:`rebuild`.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null at the root),
    ``n_convs`` (members), ``n_children``, ``n_leaves``, ``saved_tokens`` (in the subtree, each
    node's other members times the bytes of its last text), ``ends_sha256`` (hash of the members
    with as many turns as the node), and ``enter`` and ``exit``, the node's place on the tour.

    A null role or text is the empty one. Turns go by number, null first; rows of one number
    by the hash of role and text, equal rows are turns of their own. Rows with a null id
    belong to no conversation and are left out. Texts are hashed whole where they are read and
    go no further; other columns are not read, so their names cannot clash. Without conversations
    there is no node, not even the root.
    """
    rebuilt, convs = rebuild(turn_rows(conversations, conv_id, turn, role, text))
    members = stored(member_nodes(rebuilt))
    nodes = stored(_neighbours(_named(members, convs)))
    toured = tour(nodes, task_nodes, task_links)

    lengths = members.groupBy("conv").agg(F.max("depth").alias("depth"), F.max_by("key", "depth").alias("key"))
    turnless = convs.join(lengths, "conv", "left_anti").select(F.lit(ROOT).alias("key"), "conv")
    ends = _end_hashes(lengths.select("key", "conv").unionByName(turnless))
    whole = nodes.join(toured, ["conv", "depth"]).join(ends, "key", "left")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(ENDED)).alias("ends_sha256"), "enter", "exit",
    )
