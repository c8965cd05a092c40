"""Fixed-capacity containers filled with texts, by bounded-space online packing (problem 6)."""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.session import cut_lineage, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How that public vocabulary cuts text before merging (fixed value of the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_SCHEMA = "target_id bigint, bin string, position int, doc_id bigint, piece int, n_tokens bigint"
#: Items packed online as one; their number, not the cluster's cores, says in how many slots.
ITEMS_PER_SLOT = 10_000


@lru_cache(maxsize=1)
def load_vocabulary(path: str):
    """The vocabulary, read once per Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of each text in tokens of a public byte-level vocabulary; null and empty texts have 0.

    The vocabulary's file need only lie on the driver's machine; it is sent to every executor.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        encoding = load_vocabulary(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id").mapInArrow(count, "doc_id bigint, n_tokens bigint")


class Windows:
    """A fixed number of open containers of one capacity. Items go where they fit best; the fullest is given up
    when none fits and all are open."""

    def __init__(self, capacity: int, open_windows: int):
        self.capacity, self.most = capacity, open_windows
        self.free: list[tuple[int, int]] = []  # (room left, container), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def put(self, size: int, items: list) -> list | None:
        """Place items that stay together; returns the items of a container that had to be given up, if any."""
        given = None
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, key = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                given = self.held.pop(self.free.pop(0)[1])
            room, key = self.capacity, self.next
            self.next += 1
            self.held[key] = []
        self.held[key] += items
        if room > size:
            insort(self.free, (room - size, key))
        else:
            full = self.held.pop(key)
            return full if given is None else given + [None] + full
        return given

    def rest(self) -> list[list]:
        return [self.held[key] for _, key in self.free]


def _split(given: list | None) -> list[list]:
    """Containers in what put() returned: one, or two parted by None."""
    if given is None:
        return []
    if None in given:
        cut = given.index(None)
        return [given[:cut], given[cut + 1 :]]
    return [given]


def pack(sizes: DataFrame, targets: list[tuple[int, int]], open_windows: int = 64, merge_ways: int = 32, slots: int | None = None) -> DataFrame:
    """Combine items (doc_id, n_tokens) into containers of each target's capacity, with little unused space.

    targets: (target_id, capacity), each at least 1. Every item is whole in one container, unless it alone exceeds
    the capacity: then it is cut into full containers and a last piece, which is placed like an item. One row per
    item and target (more for cut ones): capacity_tokens, container_id, position in it, piece number (0 for whole items).

    Items of 0 tokens take no room and go to some container; null sizes count as 0; rows with the same doc_id are
    items of their own; an empty table gives no rows. Extra columns are ignored.

    Items are spread over `slots` (unless given, one for every ITEMS_PER_SLOT items) by a hash of doc_id and packed there
    online, in order of that hash, with open_windows containers per capacity; so the containers depend on the items alone,
    not on cores or partitions. What is left open at the end (at most open_windows per slot and capacity) is merged in
    rounds: merge_ways slots' leftovers go to one, their items are packed anew and leave at most open_windows open,
    until one slot's are left. So no task gets more than merge_ways * open_windows leftovers, whatever the input.
    """
    spark = sizes.sparkSession
    for _, capacity in targets:
        if capacity < 1:
            raise ValueError("capacities must be at least 1")
    names = "target_id, capacity_tokens, container_id, position, doc_id, piece, n_tokens".split(", ")
    if not targets:
        return spark.createDataFrame([], PIECE_SCHEMA).withColumns({"capacity_tokens": F.lit(0), "container_id": F.col("bin")}).select(*names)
    n = slots or max(1, -(-sizes.count() // ITEMS_PER_SLOT))
    items = sizes.select(F.col("doc_id"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n_tokens"))
    items = items.withColumn("_h", F.xxhash64("doc_id")).withColumn("slot", F.pmod("_h", F.lit(n)))
    ordered = items.repartition("slot").sortWithinPartitions("slot", "_h", "doc_id", "n_tokens").select("slot", "doc_id", "n_tokens")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, slot = _Rows(), None
        windows, closed = {}, {}

        def close(target: int, containers: list[list]) -> None:
            for items in containers:
                out.add(target, f"0-{slot}-{closed[target]}", items, False)
                closed[target] += 1

        def finish() -> None:
            for target, w in windows.items():
                for k, items in enumerate(w.rest()):
                    out.add(target, f"{slot}-{k}", items, True)

        for batch in batches:
            for own, doc_id, size in zip(*(batch[c].to_pylist() for c in ("slot", "doc_id", "n_tokens"))):
                if own != slot:
                    finish()
                    slot, windows, closed = own, {t: Windows(c, open_windows) for t, c in targets}, dict.fromkeys((t for t, _ in targets), 0)
                for target, capacity in targets:
                    piece, left = 0, size
                    while left > capacity:  # alone too long: full containers, then the last piece
                        piece += 1
                        close(target, [[(doc_id, piece, capacity)]])
                        left -= capacity
                    close(target, _split(windows[target].put(left, [(doc_id, piece + 1 if piece else 0, left)])))
            yield from out.flush()
        finish()
        yield from out.flush()

    packed = cut_lineage(ordered.mapInArrow(first, PIECE_SCHEMA + ", open boolean"))
    done = [packed.where("not open").drop("open")]
    left, groups, level = packed.where("open").drop("open").withColumn("slot", F.split("bin", "-")[0].cast("int")), n, 0
    while groups > 1:
        groups, level = -(-groups // merge_ways), level + 1
        merged = left.withColumn("slot", F.floor(F.col("slot") / merge_ways).cast("int")).groupBy("slot").applyInPandas(
            _merger(targets, open_windows, level), PIECE_SCHEMA + ", open boolean, slot int"
        )
        if groups > 1:
            merged = cut_lineage(merged)
            done.append(merged.where("not open").drop("open", "slot"))
            left = merged.where("open").drop("open")
        else:
            left = merged.drop("open")
    done.append(left.drop("slot").withColumn("bin", F.concat(F.lit("last-"), F.col("bin"))))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    capacity = F.create_map(*[F.lit(x).cast("bigint") for target in targets for x in target])
    return out.withColumn("capacity_tokens", capacity[F.col("target_id")]).withColumnRenamed("bin", "container_id").select(*names)


class _Rows:
    names = ("target_id", "bin", "position", "doc_id", "piece", "n_tokens", "open")
    types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, target: int, container: str, items: list, still_open: bool) -> None:
        self.rows += [(target, container, p, d, k, s, still_open) for p, (d, k, s) in enumerate(items)]

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), self.types)], names=list(self.names))
            self.rows = []


def _merger(targets: list[tuple[int, int]], open_windows: int, level: int):
    """Items of several tasks' leftover containers packed anew, largest first, each where it fits best."""

    def merge(left):
        import pandas as pd

        slot, rows = int(left["slot"].iloc[0]), []
        for target, capacity in targets:
            own = left[left["target_id"] == target].sort_values(["bin", "n_tokens", "doc_id", "piece"], ascending=[True, False, True, True])
            units: list[tuple[int, list]] = []
            for _, g in own.groupby("bin", sort=True):
                items = list(zip(g["doc_id"], g["piece"], g["n_tokens"]))
                held = max(1, sum(i[2] > 0 for i in items))  # items without tokens stay with their container's last
                units += [(int(items[k][2]), items[k : k + 1] if k < held - 1 else items[k:]) for k in range(held)]
            units.sort(key=lambda u: (-u[0], u[1][0][0], u[1][0][1]))
            windows, closed = Windows(capacity, len(units) + 1), 0
            for size, items in units:
                for full in _split(windows.put(size, items)):
                    rows += [(target, f"{level}-{slot}-{closed}", p, *i, False, slot) for p, i in enumerate(full)]
                    closed += 1
            rest = windows.rest()  # fullest first: the emptiest stay open for the next round
            for k, items in enumerate(rest):
                still_open = k >= len(rest) - open_windows
                name = f"{slot}-{k}" if still_open else f"{level}-{slot}-{closed}"
                closed += not still_open
                rows += [(target, name, p, *i, still_open, slot) for p, i in enumerate(items)]
        return pd.DataFrame(rows, columns=["target_id", "bin", "position", "doc_id", "piece", "n_tokens", "open", "slot"])

    return merge


def pack_documents(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """The containers of every capacity in `targets` (target_id, capacity_tokens) with the texts in them, in order.

    The targets are few settings, not data; more than 1,000 are refused.
    """
    rows = targets.where("target_id IS NOT NULL AND capacity_tokens IS NOT NULL").select("target_id", "capacity_tokens").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("too many capacities")
    settings = sorted((int(r[0]), int(r[1])) for r in rows)
    slots = max(1, -(-documents.count() // ITEMS_PER_SLOT))
    return pack(token_counts(documents, vocabulary), settings, slots=slots, **options)
