"""Chat formatting over a prefix tree of conversations.

A turn is written as <s>[role]text</s>, with "\\", "<", "[" and "]" of roles and texts escaped, so no control
string of a text is taken for the template's, and reading gives the text back. Conversations that share initial
turns share the nodes of a tree: a node is a turn behind the same turns, known by a polynomial hash of them, which is
carried along a conversation from one range partition to the next, so no conversation has to fit in one task. Nodes
link to their parents. Those that follow each other without branching are a chain, and a node's path is the chains
that lead to it. Nodes are emitted once, depth first (in the order of paths, then depth, dealt out by range), with
their offsets in the whole stream, the position at which they begin in any conversation through them, and the
stream intervals of their ancestors, one for each chain above them, which attention is limited to. The loss mask
covers the text of assistant turns.

Edge cases: a null text or role is an empty one; a null conv_id is an id; turns are in order of turn (null first), and
repeated ones stay, in order of role and text; copies of a conversation share all nodes; an empty table gives an empty
tree. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import by_heat, discard, mapped, stored

#: Fixed by the template: what stands for each character that is escaped.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\o", "]": "\\c"}
BACK = {"\\": "\\", "l": "<", "o": "[", "c": "]"}
TURN = re.compile(r"<s>\[([^\]]*)\]([^<]*)</s>")
#: Modulus and bases of the two hashes of a node's turns.
PRIME, BASES = (1 << 61) - 1, (1_000_003_000_121, 777_767_777_003)
ROOT = bytes(16)


def escaped(c: Column) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in ESCAPES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m.group(1)], s, flags=re.S)


def written(conversations: DataFrame) -> DataFrame:
    """(conv_id, conv, turn, role, text, segment, mask_from, mask_to): turns as written, and where their loss masks are."""
    head, body = F.concat(F.lit("<s>["), escaped(F.col("role")), F.lit("]")), escaped(F.col("text"))
    own = F.col("role").eqNullSafe("assistant")
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    end = F.when(own, F.char_length(head) + F.char_length(body)).otherwise(0)
    return conversations.select("conv_id", conv.alias("conv"), "turn", "role", "text", F.concat(head, body, F.lit("</s>")).alias("segment"), F.when(own, F.char_length(head)).otherwise(0).alias("mask_from"), end.alias("mask_to"))


def more(df: DataFrame, fields: str) -> StructType:
    return StructType(df.schema.fields + _parse_datatype_string(fields).fields)


def _packed(h: tuple[int, int]) -> bytes:
    return h[0].to_bytes(8, "big") + h[1].to_bytes(8, "big")


def _unpacked(b: bytes) -> tuple[int, int]:
    return int.from_bytes(b[:8], "big"), int.from_bytes(b[8:], "big")


def _further(h: tuple[int, int], more: tuple[int, int], n: int) -> tuple[int, int]:
    """Hashes of turns with hashes h, followed by n turns with hashes `more`."""
    return (h[0] * pow(BASES[0], n, PRIME) + more[0]) % PRIME, (h[1] * pow(BASES[1], n, PRIME) + more[1]) % PRIME


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows, counted from where their conversation begins in this partition: depth, position, hash before and at each turn."""
    conv, depth, position, h = None, 0, 0, (0, 0)
    for b in batches:
        depths, positions, before, own = [], [], [], []
        for c, segment in zip(b.column("conv").to_pylist(), b.column("segment").to_pylist(), strict=True):
            if c != conv:
                conv, depth, position, h = c, 0, 0, (0, 0)
            digest = hashlib.blake2b(segment.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            depth += 1
            before.append(_packed(h))
            h = _further(h, tuple(x % (PRIME - 1) + 1 for x in _unpacked(digest)), 1)
            own.append(_packed(h))
            depths.append(depth)
            positions.append(position)
            position += len(segment)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(depths, pa.int64()), pa.array(positions, pa.int64()), pa.array(before, pa.binary()), pa.array(own, pa.binary())], names=[*b.schema.names, "depth", "position", "parent", "id"])


def nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, conv, segment, mask_from, mask_to, depth, position, parent, id): a row for each turn of each conversation."""
    order = ("conv", "turn", "role", "text")
    dealt = written(conversations).repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "role", "text").withColumn("part", F.spark_partition_id())
    local = stored(dealt.mapInArrow(_chained, more(dealt, "depth long, position long, parent binary, id binary")))
    # What each partition's last conversation hands on to the next partition: a row for each partition.
    whole = F.struct("conv", "depth", (F.col("position") + F.char_length("segment")).alias("chars"), "id")
    ends = local.groupBy("part").agg(F.max(whole).alias("last"), F.min("conv").alias("first")).orderBy("part").collect()
    carry: dict[int, tuple[str, int, int, tuple[int, int]]] = {}
    held = None
    for part, last, first in ends:
        h = _unpacked(bytes(last.id))
        if held and held[0] == first:
            carry[part] = held
            if last.conv == first:
                held = (first, held[1] + last.depth, held[2] + last.chars, _further(held[3], h, last.depth))
                continue
        held = (last.conv, last.depth, last.chars, h)

    def carried(b: pa.RecordBatch) -> pa.RecordBatch:
        names = ("depth", "position", "parent", "id")
        made = {n: b.column(n).to_pylist() for n in names}
        for i, (part, conv) in enumerate(zip(b.column("part").to_pylist(), b.column("conv").to_pylist(), strict=True)):
            got = carry.get(part)
            if got and got[0] == conv:
                n = made["depth"][i]
                made["parent"][i] = _packed(_further(got[3], _unpacked(made["parent"][i]), n - 1))
                made["id"][i] = _packed(_further(got[3], _unpacked(made["id"][i]), n))
                made["depth"][i] += got[1]
                made["position"][i] += got[2]
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else b.column(f.name) for f in b.schema], schema=b.schema)

    return (mapped(local, local.schema, carried) if carry else local).drop("part")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `before`, the characters before each row in this partition."""
    total = 0
    for b in batches:
        before = []
        for n in b.column("chars").to_pylist():
            before.append(total)
            total += n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64())], names=[*b.schema.names, "before"])


def tree(turns: DataFrame) -> DataFrame:
    """The emitted stream: (id, parent, path, depth, segment, mask_from, mask_to, position, n_conversations, start, end)."""
    n_turns = turns.count()
    facts = [F.first(c).alias(c) for c in ("parent", "depth", "segment", "mask_from", "mask_to", "position")]
    once = stored(turns.groupBy("id").agg(*facts, F.min("conv").alias("conv"), F.count("*").alias("n_conversations")))
    n_nodes = once.count()
    forks = stored(once.groupBy("parent").agg(F.count("*").alias("kids")).where("kids > 1"))
    under_fork = by_heat(once.select("parent", "id", "depth", "n_conversations"), forks.select("parent", F.col("kids").alias("n")), "parent", "n", n_nodes)
    heads = stored(under_fork.unionByName(once.where("depth = 1").select("parent", "id", "depth", "n_conversations")).select("id", "n_conversations").distinct())
    # The heads of chains along each conversation; a node takes those of one conversation through it.
    along = by_heat(turns.select("conv", "id", "depth"), heads, "id", "n_conversations", n_turns)
    of = along.groupBy("conv").agg(F.sort_array(F.collect_set(F.struct("depth", "id"))).alias("heads"))
    of = stored(once.groupBy("conv").agg(F.count("*").alias("n")).join(of, "conv"))
    path = F.transform(F.filter("heads", lambda h: h["depth"] <= F.col("depth")), lambda h: h["id"])
    placed = by_heat(once, of, "conv", "n", n_nodes).withColumn("path", path).drop("conv", "heads").withColumn("chars", F.char_length("segment").cast("long"))
    order = ("path", "depth")
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    local = stored(dealt.mapInArrow(_summed, more(dealt, "before long")))
    total, at = 0, {}
    for part, chars in local.groupBy("part").agg(F.sum("chars")).orderBy("part").collect():  # a row for each partition
        at[part] = total
        total += chars
    discard(once, forks, heads, of)
    offsets = local.sparkSession.createDataFrame(list(at.items()), "part int, offset long")
    start = F.col("offset") + F.col("before")
    return local.join(F.broadcast(offsets), "part").select("id", "parent", "path", "depth", "segment", "mask_from", "mask_to", "position", "n_conversations", start.alias("start"), (start + F.col("chars")).alias("end"))


def with_ancestors(stream: DataFrame) -> DataFrame:
    """Adds `ancestors`: the stream intervals of the chains above each node, from the root, its own chain's up to itself."""
    chains = stored(stream.groupBy("path").agg(F.min("start").alias("from"), F.max("end").alias("to"), F.count("*").alias("n")))
    up = stored(chains.where(F.size("path") > 1).select(F.col("path").alias("chain"), F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("path")))
    below = stored(up.groupBy("path").agg(F.count("*").alias("n_below")).join(chains.select("path", "from", "to"), "path"))
    above = by_heat(up, below, "path", "n_below", up.count()).groupBy("chain").agg(F.sort_array(F.collect_list(F.struct(F.col("from").alias("start"), F.col("to").alias("end")))).alias("above"))
    facts = stored(chains.join(above.withColumnRenamed("chain", "path"), "path", "left").select("path", "from", "above", "n"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    own = F.when(F.col("start") > F.col("from"), F.array(F.struct(F.col("from").alias("start"), F.col("start").alias("end")))).otherwise(none)
    made = by_heat(stream, facts, "path", "n", stream.count())
    return made.withColumn("ancestors", F.concat(F.coalesce("above", none), own)).drop("above", "from")


def format_chats(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stream with ancestors, and (conv_id, conv, id, depth): which nodes make up each conversation."""
    turns = stored(nodes(conversations.select("conv_id", "turn", "role", "text")))
    stream = stored(tree(turns))
    made = stored(with_ancestors(stream))
    discard(stream)
    return made, turns.select("conv_id", "conv", "id", "depth")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations from their nodes in order; one conversation's digests are held at a time."""
    conv, state = None, None

    def row(s: list) -> tuple:
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    for b in batches:
        kinds = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names, rows = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], []
        for c, i, segment, a, e in zip(*(b.column(n).to_pylist() for n in ("conv", "conv_id", "segment", "mask_from", "mask_to")), strict=True):
            if state is None or c != conv:
                if state is not None:
                    rows.append(row(state))
                conv, state = c, [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in TURN.findall(segment):
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            under = unescape(segment[a:e])
            state[3] += len(under)
            state[4].update(under.encode())
            state[5] += len(segment)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(state), kinds, strict=True)], names=names)


def read_back(stream: DataFrame, members: DataFrame) -> DataFrame:
    """Digests of each conversation as its nodes in the stream say it; a digest takes its turns one after the other."""
    facts = stream.select("id", "segment", "mask_from", "mask_to", "n_conversations")
    parts = by_heat(members, facts, "id", "n_conversations", members.count()).repartition("conv").sortWithinPartitions("conv", "depth")
    kind = members.schema["conv_id"].dataType.simpleString()
    return parts.mapInArrow(_parsed, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
