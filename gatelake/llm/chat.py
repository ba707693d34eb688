"""Chat formatting into prefix trees.

A turn is written ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts are escaped reversibly: a
backslash is put before the bar of each ``<`` + backslashes + ``|``, so no escaped string holds ``<|``.

Conversations are sorted by the hashes of their turns, so those that share initial turns stand together, in depth-first
order. Each task walks its range and packs trees of at most PACK_TOKENS tokens or PACK_LEAVES conversations (one longer
conversation is a pack of its own): a turn that a conversation shares with the one before it is emitted once a pack. The
sort has the conversation's id as its last key, so the copies of a very common first turn or conversation are dealt to many
tasks; each pack then repeats the turns that lead to it.

A pack holds ``ids`` (token ids in depth-first order), ``position_ids`` (place of each token in its own conversation),
``loss`` (true on the tokens of assistant texts), ``nodes`` (start, stop, parent of each turn), ``attend`` (for each
turn the token intervals of its ancestors, first to last; within a turn attention is causal) and ``leaves`` (a
conversation and its last turn).

Defined results: a null text or role is empty; turns are ordered by turn (null first), then role, then text, and
repeated rows are repeated turns; rows without a conv_id are one conversation; an empty table gives no packs; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm import shared, vocab

PACK_TOKENS = 1 << 16
PACK_LEAVES = 4096
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

_TO_ESCAPE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_FORMATTED = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


PACK = "ids array<int>, position_ids array<int>, loss array<boolean>, nodes array<struct<start:int,stop:int,parent:int>>, attend array<array<struct<start:int,stop:int>>>, leaves array<struct<conv_id:long,node:int>>"


class Packer:
    """One tree pack as it grows."""

    def __init__(self, encode):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.ids, self.positions, self.loss, self.nodes, self.attend, self.leaves = [], [], [], [], [], []
        #: (role, text), node and tokens up to its end, of the turns that lead to the last conversation.
        self.path: list[tuple[tuple[str, str], int, int]] = []

    def full(self) -> bool:
        return len(self.ids) >= PACK_TOKENS or len(self.leaves) >= PACK_LEAVES

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        common = 0
        while common < min(len(self.path), len(turns)) and self.path[common][0] == turns[common]:
            common += 1
        del self.path[common:]
        for turn in turns[common:]:
            role, text = turn
            parts = [self.encode(TURN + escape(role) + TEXT), self.encode(escape(text)), self.encode(END)]
            parent = self.path[-1][1] if self.path else -1
            before = self.path[-1][2] if self.path else 0
            start = len(self.ids)
            for k, part in enumerate(parts):
                self.ids += part
                self.loss += [k == 1 and role == "assistant"] * len(part)
            size = len(self.ids) - start
            self.positions += range(before, before + size)
            self.attend.append([*self.attend[parent], {"start": self.nodes[parent]["start"], "stop": self.nodes[parent]["stop"]}] if parent >= 0 else [])
            self.nodes.append({"start": start, "stop": start + size, "parent": parent})
            self.path.append((turn, len(self.nodes) - 1, before + size))
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})

    def row(self) -> dict:
        return {"ids": self.ids, "position_ids": self.positions, "loss": self.loss, "nodes": self.nodes, "attend": self.attend, "leaves": self.leaves}


_INTERVAL = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_PACK = pa.schema(
    [
        ("ids", pa.list_(pa.int32())),
        ("position_ids", pa.list_(pa.int32())),
        ("loss", pa.list_(pa.bool_())),
        ("nodes", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("parent", pa.int32())]))),
        ("attend", pa.list_(pa.list_(_INTERVAL))),
        ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())]))),
    ]
)


def packs(conversations: DataFrame, path: str) -> DataFrame:
    """Prefix-tree packs of all conversations, with token ids of the vocabulary at ``path``."""

    def run(batches):
        packer = Packer(vocab.encoder(path).encode_ordinary)
        for batch in batches:
            for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                packer.add(conv_id, [(t["role"], t["text"]) for t in turns])
                if packer.full():
                    yield pa.RecordBatch.from_pylist([packer.row()], _PACK)
                    packer.clear()
        if packer.leaves:
            yield pa.RecordBatch.from_pylist([packer.row()], _PACK)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    keyed = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t.role, t.text)))
    dealt = keyed.repartitionByRange(shared.ranges(conversations), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return dealt.select("conv_id", "turns").transform(shared.arrow, run, PACK)


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(packed: DataFrame, path: str) -> DataFrame:
    """Each conversation as its leaf, its ancestors' intervals and the loss mask give it."""

    def run(batches):
        decode = vocab.encoder(path).decode_bytes
        for batch in batches:
            for row in range(batch.num_rows):
                pack = batch.slice(row, 1).to_pylist()[0]
                texts, masked = {}, {}

                def turn(start: int, stop: int, pack=pack, texts=texts, masked=masked) -> None:
                    texts[start] = decode(pack["ids"][start:stop]).decode("utf-8")
                    under = [i for i, m in zip(pack["ids"][start:stop], pack["loss"][start:stop], strict=True) if m]
                    masked[start] = unescape(decode(under).decode("utf-8"))

                out = []
                for leaf in pack["leaves"]:
                    spans = [(x["start"], x["stop"]) for x in pack["attend"][leaf["node"]]] if leaf["node"] >= 0 else []
                    if leaf["node"] >= 0:
                        own = pack["nodes"][leaf["node"]]
                        spans.append((own["start"], own["stop"]))
                    for start, stop in spans:
                        if start not in texts:
                            turn(start, stop)
                    formatted = "".join(texts[s] for s, _ in spans)
                    turns = [(unescape(r), unescape(t)) for r, t in _FORMATTED.findall(formatted)]
                    loss = "".join(masked[s] for s, _ in spans)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    out.append((leaf["conv_id"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
                names = [x.split()[0] for x in REPORT.split(", ")]
                kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(len(names))], names=names)

    return packed.transform(shared.arrow, run, REPORT)


def report(conversations: DataFrame, path: str) -> DataFrame:
    """Digests of every conversation, read back from packs written to the shared folder."""
    written, _ = shared.written(packs(conversations, path), "chat-packs")
    return read_back(written, path)
