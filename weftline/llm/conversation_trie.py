"""Prefix trie of conversations: which turns do conversations share from their beginning?

A turn is known by a number of ``WIDTH`` bytes, the first of the SHA-256 of its role and text; a conversation is the
bytes of its turns' numbers, big end first, so that byte order is turn order.  Equal conversations become one key.  Keys are
range-partitioned and sorted, and each stretch of at most ``RUN_BYTES`` of them goes into an adaptive radix tree: nodes
of 4, 16, 48 or 256 places that grow as they fill, and compressed paths where nothing branches.  Only byte depths
that are whole turns are nodes of the trie; the rest is the tree's own.

All figures of a node are sums or minima over stretches.  Nodes whose members can lie in two stretches are the prefixes of a
stretch's first and last key; those few are emitted as parts, with their names, and added up.  Where two stretches meet,
a node in both is counted as child, as text and maybe as leaf twice; one row for each depth in common takes that back.

Texts are not moved: a turn is its number and its length.  One task holds the numbers of one conversation, 16 bytes a turn.
The ids of a node's ends are hashed in order as they stream by, in one task for one node, as a hash of
an ordered list needs; they are not held.

Defined results: a null role or text is an empty one; null turns come first; turns of one number are ordered by
their hash, and repeated rows are turns of their own; rows without a conversation id belong to none; an empty table gives an
empty table, without a root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.llm.common import text_or_empty
from weftline.session import stored

#: bytes of a turn's number
WIDTH = 16
#: bytes of keys that one tree holds, about; a key counts for ``KEY_COST`` bytes more than it has
RUN_BYTES = 16 << 20
KEY_COST = 512
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- the tree --------------------------------------------------------------------------


class Sorted:
    """Up to 4 or 16 children: their bytes in order, beside them the nodes."""

    __slots__ = ("room", "marks", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.marks, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = self.marks.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node: Node):
        at = bisect_left(self.marks, byte)
        if at < len(self.marks) and self.marks[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.marks) == self.room:
            larger = Sorted(16) if self.room == 4 else Indexed()
            for mark, own in zip(self.marks, self.nodes):
                larger.put(mark, own)
            return larger.put(byte, node)
        self.marks.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def ordered(self) -> list[Node]:
        return self.nodes


class Indexed:
    """Up to 48 children: for every byte its place, counted from 1."""

    __slots__ = ("places", "nodes")

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def get(self, byte: int):
        place = self.places[byte]
        return self.nodes[place - 1] if place else None

    def put(self, byte: int, node: Node):
        if self.places[byte]:
            self.nodes[self.places[byte] - 1] = node
            return self
        if len(self.nodes) == 48:
            full = Full()
            for mark, place in enumerate(self.places):
                if place:
                    full.put(mark, self.nodes[place - 1])
            return full.put(byte, node)
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return self

    def ordered(self) -> list[Node]:
        return [self.nodes[place - 1] for place in self.places if place]


class Full:
    """A place for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node: Node):
        self.nodes[byte] = node
        return self

    def ordered(self) -> list[Node]:
        return [n for n in self.nodes if n is not None]


class Node:
    """``path`` leads here from the byte under which the node hangs; ``entry`` is the key that ends here, or -1."""

    __slots__ = ("path", "entry", "kids", "sums")

    def __init__(self, path: bytes, entry: int = -1):
        self.path, self.entry, self.kids, self.sums = path, entry, None, None

    def hang(self, byte: int, node: Node) -> None:
        self.kids = (self.kids or Sorted()).put(byte, node)

    def below(self) -> list[Node]:
        return self.kids.ordered() if self.kids is not None else []


def common(a: bytes, b: bytes) -> int:
    """Number of equal bytes at the beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:  # a[:low] agrees, a[:high] does not
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def insert(root: Node, key: bytes, entry: int) -> None:
    """Hang ``key`` into the tree; a path that it leaves halfway is split."""
    node, at = root, 0
    while at < len(key):
        child = node.kids.get(key[at]) if node.kids is not None else None
        if child is None:
            node.hang(key[at], Node(key[at + 1 :], entry))
            return
        rest = key[at + 1 : at + 1 + len(child.path)]
        same = common(child.path, rest)
        if same < len(child.path):
            upper = Node(child.path[:same])
            upper.hang(child.path[same], child)
            child.path = child.path[same + 1 :]
            node.kids = node.kids.put(key[at], upper)
            child = upper
        node, at = child, at + 1 + same
    node.entry = entry


# --- figures of one stretch of keys ----------------------------------------------------

NODES = (
    "part boolean, node_id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved_tokens long, ends_sha256 string,"
    " first binary, last binary, last_sizes array<int>"
)
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]


def prefix_names(key: bytes) -> list[bytes]:
    """Names of all prefixes of a key that are whole turns, from the empty one on."""
    names, state = [], hashlib.blake2b(digest_size=WIDTH)
    names.append(state.digest())
    for at in range(0, len(key), WIDTH):
        state.update(key[at : at + WIDTH])
        names.append(state.digest())
    return names


def order_of(root: Node) -> list[tuple]:
    """All nodes, parents first: ``(node, byte depth above, byte depth, on the first key's path, on the last key's)``."""
    out, todo = [], [(root, -1, 0, True, True)]
    while todo:
        node, _, depth, first, last = item = todo.pop()
        out.append(item)
        below = node.below()
        for i, kid in enumerate(below):
            own_first = first and i == 0 and node.entry < 0
            todo.append((kid, depth, depth + 1 + len(kid.path), own_first, last and i == len(below) - 1))
    return out


def figures(root: Node, keys: list, sizes: list, convs: list, counts: list, ends: list) -> list[tuple]:
    """Rows ``NODES`` of all turn-aligned depths in a tree over one stretch of keys."""
    ordered = order_of(root)
    # from the leaves up: members, smallest member, an entry below, topmost turns, leaves, saved, saved at each own depth
    for node, above, depth, _, _ in reversed(ordered):
        n = heads = leaves = saved = 0
        least = some = None
        for kid in node.below():
            own = kid.sums
            n, heads, leaves, saved = n + own[0], heads + own[3], leaves + own[4], saved + own[5]
            least, some = own[1] if least is None else min(least, own[1]), own[2]
        if node.entry >= 0:
            e = node.entry
            n, some = n + counts[e], e
            least = convs[e] if least is None else min(least, convs[e])
        children, by_depth = heads, []
        top, bottom = above // WIDTH + 1, depth // WIDTH
        if bottom >= top:
            heads, leaves = 1, leaves or 1
            for d in range(bottom, top - 1, -1):
                saved += (n - 1) * int(sizes[some][d - 1]) if d else 0
                by_depth.append(saved)
        node.sums = (n, least, some, heads, leaves, saved, children, by_depth)
    names = {True: prefix_names(keys[0]), False: prefix_names(keys[-1])}
    rows, over = [], {}
    for node, above, depth, first, last in ordered:
        n, least, _, _, leaves, _, children, by_depth = node.sums
        # the turn above: its smallest member, and its name where it is a part
        parent, parent_name = over.pop(id(node), (None, None))
        top, bottom = above // WIDTH + 1, depth // WIDTH
        part = first or last
        for d in range(top, bottom + 1):
            own_name = names[first][d] if part else None
            own_ends = ends[node.entry] if d == bottom and node.entry >= 0 else None
            rows.append(
                (
                    part,
                    own_name,
                    parent_name,
                    least,
                    d,
                    parent,
                    n,
                    children if d == bottom else 1,
                    leaves,
                    by_depth[bottom - d],
                    own_ends,
                    None,
                    None,
                    None,
                )
            )
            parent, parent_name = least, own_name
        for kid in node.below():
            over[id(kid)] = (parent, parent_name)
    rows[0] = (*rows[0][:-3], keys[0], keys[-1], sizes[-1])
    return rows


def stretch_nodes(run_bytes: int):
    """Function over sorted keys: the nodes of every stretch of them."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done() -> pd.DataFrame:
            out = pd.DataFrame(figures(root, *run), columns=_COLUMNS)
            numbers = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
            return out.astype(dict.fromkeys(numbers, "Int64"))

        root, run, held = Node(b""), [[] for _ in range(5)], 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                insert(root, row.key, len(run[0]))
                for own, value in zip(run, (row.key, row.sizes, row.conv_id, row.n, row.ends)):
                    own.append(value)
                held += len(row.key) + KEY_COST
                if held >= run_bytes:
                    yield done()
                    root, run, held = Node(b""), [[] for _ in range(5)], 0
        if held:
            yield done()

    return over


def corrections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What two stretches count twice, for each depth at which the last key of one and the first of the next agree."""
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            same = common(row.last, row.following) // WIDTH
            names = prefix_names(row.last[: same * WIDTH])
            leaf = same * WIDTH == len(row.last)  # the last key goes on in the next stretch
            twice = 0
            for d in range(same, -1, -1):
                twice += int(row.last_sizes[d - 1]) if d else 0
                rows.append((names[d], names[d - 1] if d else None, d, 0, -int(d < same), -int(leaf), twice))
        columns = ["node_id", "parent_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        yield pd.DataFrame(rows, columns=columns)


# --- tables ----------------------------------------------------------------------------


def turn_lists(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, turns)``: every conversation's turns in order, each its number (hexadecimal) and its code points."""
    own_role, own_text = text_or_empty(role), text_or_empty(text)
    whole = F.concat(F.length(own_role).cast("string"), F.lit(":"), own_role, own_text)
    narrow = df.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).isNotNull().alias("numbered"),
            F.col(turn).alias("turn"),
            F.substring(F.sha2(whole, 256), 1, 2 * WIDTH).alias("id"),
            F.length(own_text).alias("size"),
        ).alias("t"),
    )
    lists = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size")))
    return lists.select("conv_id", turns.alias("turns"))


def with_openings(lists: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """``lists`` where each conversation's first ``h`` turns are those of the first of its ``every``.

    ``h`` is the CRC-32 of the id modulo ``most``; where that conversation is missing, only the own turns
    after the first ``h`` are left.
    """
    start = F.col("conv_id") - F.col("conv_id") % every
    heads = lists.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("_start"), F.slice("turns", 1, most - 1).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    joined = lists.withColumns({"_start": start, "_h": h}).join(heads, "_start", "left")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    own = F.filter("turns", lambda t, i: i >= F.col("_h"))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def ends_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids sorted by key and id: for each key its smallest id, their number, and the hash of the list."""
    now, least, n, state = None, 0, 0, None
    for batch in batches:
        rows = []
        for key, own in batch.groupby("key_id", sort=False)["conv_id"]:
            ids = own.tolist()
            if key != now:
                if now is not None:
                    rows.append((now, least, n, state.hexdigest()))
                now, least, n, state = key, ids[0], 0, hashlib.sha256()
            state.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
            n += len(ids)
        yield pd.DataFrame(rows, columns=["key_id", "conv_id", "n", "ends"])
    if now is not None:
        yield pd.DataFrame([(now, least, n, state.hexdigest())], columns=["key_id", "conv_id", "n", "ends"])


def nodes(lists: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The trie over ``(conv_id, turns)``: one row for each node.

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (null for the root); ``n_convs`` counts members,
    ``n_children`` children, ``n_leaves`` the nodes without children in the subtree; ``saved_tokens`` sums over the
    subtree (members - 1) times the code points of a node's last text; ``ends_sha256`` is of the ids that end here.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    keys = lists.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    keys = stored(keys.withColumn("key_id", F.sha2("key", 256)), "conversation-keys")
    ends = keys.select("key_id", "conv_id").repartition("key_id").sortWithinPartitions("key_id", "conv_id")
    ends = stored(ends.mapInPandas(ends_of, "key_id string, conv_id long, n long, ends string"), "conversation-ends")
    one = keys.select("conv_id", "key", "sizes").join(ends.drop("key_id"), "conv_id")
    ordered = one.repartitionByRange("key").sortWithinPartitions("key")
    found = ordered.select("key", "sizes", "conv_id", "n", "ends").mapInPandas(stretch_nodes(run_bytes), NODES)
    found = stored(found, "trie-stretches")

    # one row for each stretch: a narrow window puts them in order
    meeting = found.filter(F.col("first").isNotNull()).select(
        "last", "last_sizes", F.lead("first").over(W.orderBy("first")).alias("following")
    )
    meeting = meeting.filter(F.col("following").isNotNull())
    twice = meeting.mapInPandas(
        corrections,
        "node_id binary, parent_id binary, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long",
    )
    own = ["node_id", "parent_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    parts = found.filter("part").select(*own, "conv_id", "ends_sha256")
    parts = parts.unionByName(twice, allowMissingColumns=True)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = parts.groupBy("node_id", "parent_id", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"), *sums
    )
    whole = stored(whole, "trie-shared-nodes")
    above = whole.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", *own[3:], "ends_sha256"]
    single = found.filter("NOT part")
    known = single.filter(F.col("parent_id").isNull()).select(*columns)
    under = single.filter(F.col("parent_id").isNotNull()).drop("parent_conv_id").join(above, "parent_id")
    shared = whole.join(above, "parent_id", "left")
    out = known.unionByName(under.select(*columns)).unionByName(shared.select(*columns))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
