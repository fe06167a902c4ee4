"""Operator 13: the prefix trie of conversations, by peeling truncated conversations.

A conversation is the sequence of its turns; every distinct sequence of first turns is a node of
the trie. Peeling takes the deepest ends off: a node whose conversations have all been seen gives
its counts to the node that lacks its last turn, where they meet those of the conversations that
end there and of its other branches.

Here the conversations are sorted by their turns and cut into ranges, and each task peels its range
in one pass: from one conversation to the next, what the two do not share is peeled turn by turn.
A task holds one path of the trie, however many conversations share it. Only the nodes on the first
and the last path of a range can go on in another one; these, at most two paths a range, are
peeled once more together. So the work follows the turns, and the number of jobs does not follow
the length of the longest conversation, as a regrouping for each depth would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import scratch

RECORD = 20         # bytes of a turn: 128 bits of a digest of role and text, 32 bits of the text's length
ROOT = bytes(16)    # key of the node without turns
IDS_PER_PIECE = 200  # ids of one row of a long list
OUT_ROWS = 20_000

_NODES = ("kind string, node binary, parent binary, depth long, last_length long, conv_id long, n_convs long, n_children long, "
          "n_leaves long, saved_tokens long, ends_sha256 string, first_id long, ids string")
_COLUMNS = [part.split()[0] for part in _NODES.split(", ")]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_chains(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """``conv_id, chain``: a record of ``RECORD`` bytes for each turn of a conversation, in order.

    Turns are ordered by their number, NULL first; equal numbers by the digest of role and text.
    NULL role or text counts as empty. Rows without a conversation id are in no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    record = F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0")).alias("record")
    turns = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), record).alias("t"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select("conv_id", F.unhex(F.array_join(F.transform("ts", lambda t: t["record"]), "")).alias("chain"))


def shared_openings(chains: DataFrame, group: Column, n_turns: Column) -> DataFrame:
    """Each conversation with its first ``n_turns`` replaced by those of the conversation ``group`` (none if it is absent).

    ``n_turns`` must not exceed 5; a conversation with fewer turns keeps none of its own.
    """
    dealt = chains.select("conv_id", "chain", group.cast("long").alias("opener"), n_turns.cast("int").alias("h"))
    heads = dealt.filter("conv_id = opener").select(
        F.col("conv_id").alias("head_id"), F.substring("chain", 1, 5 * RECORD).alias("head"))
    joined = dealt.join(heads, dealt.opener == heads.head_id, "left")
    start = F.col("h") * RECORD
    opening = F.substring(F.coalesce("head", F.unhex(F.lit(""))), F.lit(1), start)
    rest = F.substring(F.col("chain"), start + 1, F.greatest(F.length("chain") - start, F.lit(0)))
    return joined.select("conv_id", F.concat(opening, rest).alias("chain"))


class Path:
    """The nodes from the root to the current conversation's last turn, each with its counts so far."""

    def __init__(self):
        self.nodes: list[Node] = [Node(ROOT, ROOT, 0)]
        self.chain = b""

    def go_to(self, chain: bytes) -> Iterator[Node]:
        """Peel the nodes that the new conversation does not go through, then add its own ones."""
        depth, most = 0, min(len(chain), len(self.chain)) // RECORD
        if chain == self.chain:
            depth = most
        else:
            while depth < most and chain[depth * RECORD:(depth + 1) * RECORD] == self.chain[depth * RECORD:(depth + 1) * RECORD]:
                depth += 1
        yield from self.peel(depth)
        for at in range(depth * RECORD, len(chain), RECORD):
            record, above = chain[at:at + RECORD], self.nodes[-1].key
            key = hashlib.blake2b(above + record, digest_size=16).digest()
            self.nodes.append(Node(key, above, int.from_bytes(record[16:], "big")))
        self.chain = chain

    def peel(self, depth: int) -> Iterator[Node]:
        while len(self.nodes) > depth + 1:
            node = self.nodes.pop()
            node.depth = len(self.nodes)
            if not node.open:
                node.close()
                self.nodes[-1].add(node)
            yield node


class Node:
    __slots__ = ("key", "parent", "length", "depth", "conv", "convs", "children", "leaves", "saved", "ends", "open")

    def __init__(self, key: bytes, parent: bytes, length: int):
        self.key, self.parent, self.length, self.depth = key, parent, length, 0
        self.conv = None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends: str | None | object = NO_ENDS  # digest of the ended conversations, running or done; None if pieces tell it
        self.open = False  # other ranges may hold conversations of this node

    def seen(self, conv: int | None, convs: int) -> None:
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.convs += convs

    def add(self, child: Node) -> None:
        """What a peeled node gives to the one without its last turn."""
        self.seen(child.conv, child.convs)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved

    def close(self) -> None:
        if not self.children:
            self.leaves = 1
        if self.key != ROOT:
            self.saved += (self.convs - 1) * self.length

    def row(self, kind: str, ends: str | None) -> tuple:
        return (kind, self.key, self.parent, self.depth, self.length, self.conv, self.convs, self.children, self.leaves,
                self.saved, ends, None, None)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({"conv_id": "Int64", "first_id": "Int64"})


def _peeled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of one range of conversations sorted by chain and id.

    Kinds of rows: ``node``, complete; ``part``, counts of a node on the first or last path, without
    those of such nodes below it; ``ids``, pieces of the ended conversations of the first and the
    last chain, whose list may go on in another range; other lists are complete here.
    """
    path, out = Path(), []
    started, first, run = False, True, []  # run: ids of the current chain that are in no piece yet

    def emit(node: Node) -> None:
        ends = node.ends if node.ends is None or isinstance(node.ends, str) else node.ends.hexdigest()
        out.append(node.row("part" if node.open else "node", ends))

    def piece() -> None:
        if run:
            out.append(("ids", path.nodes[-1].key, *[None] * 3, None, *[0] * 4, None, run[0], ",".join(map(str, run))))
            run.clear()

    for batch in batches:
        for conv, chain in zip(batch["conv_id"].tolist(), batch["chain"].tolist()):
            if not started or chain != path.chain:
                if started and first:
                    piece()
                    path.nodes[-1].ends = None
                    first = False
                run.clear()
                for node in path.go_to(chain):
                    emit(node)
                if not started:
                    started = True
                    for node in path.nodes:
                        node.open = True
            top = path.nodes[-1]
            top.seen(conv, 1)
            if isinstance(top.ends, str):
                top.ends = hashlib.sha256(str(conv).encode())
            else:
                top.ends.update(f",{conv}".encode())
            run.append(conv)
            if len(run) == IDS_PER_PIECE:
                piece()
            if len(out) >= OUT_ROWS:
                yield _frame(out)
                out.clear()
    if started:
        piece()
        path.nodes[-1].ends = None
        for node in path.nodes:
            node.open = True
        for node in path.peel(0):
            emit(node)
        emit(path.nodes[0])
    if out:
        yield _frame(out)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes that lie in several ranges: their parts added up, deepest first, each peeled into its parent."""
    nodes: dict[bytes, Node] = {}
    for batch in batches:
        for r in batch.itertuples(index=False):
            node = nodes.setdefault(r.node, Node(r.node, r.parent, int(r.last_length)))
            node.depth = int(r.depth)
            node.seen(None if pd.isna(r.conv_id) else int(r.conv_id), int(r.n_convs))
            node.children += int(r.n_children)
            node.leaves += int(r.n_leaves)
            node.saved += int(r.saved_tokens)
            if r.ends_sha256 != NO_ENDS:
                node.ends = r.ends_sha256 if isinstance(r.ends_sha256, str) else None
    rows = []
    for node in sorted(nodes.values(), key=lambda n: -n.depth):
        node.close()
        if node.depth:
            nodes[node.parent].add(node)
        rows.append(node.row("node", node.ends))
    if rows:
        yield _frame(rows)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's list of ids, whose pieces come in order."""
    key, digest = None, None
    for batch in batches:
        done = []
        for node, ids in zip(batch["node"], batch["ids"]):
            if node == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((key, digest.hexdigest()))
            key, digest = node, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["node", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["node", "ends"])


def prefix_trie(chains: DataFrame) -> DataFrame:
    """The trie of ``chains`` (``conv_id, chain`` as from ``turn_chains``), a row per node.

    ``node`` and ``parent`` are 128-bit keys. Members are the conversations that go through a node;
    ``conv_id`` is their least id, ``n_convs`` their number, ``parent_conv_id`` the ``conv_id`` of the
    node without the last turn (NULL for the root). ``n_leaves`` counts the nodes without children of the
    subtree, ``saved_tokens`` sums its (n_convs - 1) x code points of the last text, and ``ends_sha256``
    is the SHA-256 of the members that end at the node, ascending, joined by commas (of an empty text if
    there is none). A conversation without turns ends at the root. An empty table has no node.

    A task holds one path and 200 ids; the last merge holds two paths for each range. A conversation
    is one value of 20 bytes a turn. All ids that end at one node are hashed one after the other, as
    SHA-256 demands, in pieces that were joined before.
    """
    spark = chains.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_chains = scratch(chains, "chains").repartitionByRange(ranges, "chain", "conv_id").sortWithinPartitions("chain", "conv_id")
    found = scratch(sorted_chains.mapInPandas(_peeled, _NODES), "peeled")
    merged = found.filter("kind = 'part'").repartition(1).mapInPandas(_merged, _NODES)
    nodes = scratch(found.filter("kind = 'node'").unionByName(merged).drop("kind", "last_length", "first_id", "ids"), "nodes")
    # Pieces tell the lists of the nodes without a digest; those of other nodes are not needed.
    split = nodes.filter("ends_sha256 IS NULL").select("node")
    pieces = found.filter("kind = 'ids'").select("node", "first_id", "ids").join(split, "node", "left_semi")
    ends = pieces.repartition("node").sortWithinPartitions("node", "first_id").mapInPandas(_digests, "node binary, ends string")
    above = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent")))
    return below.join(above, "parent", "left").join(ends, "node", "left").select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", "ends").alias("ends_sha256"))
