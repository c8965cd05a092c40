from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelane.llm.packing import Windows, _split, pack, pack_documents, token_counts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=80), st.integers(1, 4))
def test_windows_lose_nothing_and_never_overflow(sizes, windows):
    w, closed = Windows(20, windows), []
    for k, size in enumerate(sizes):
        closed += _split(w.put(size, [(k, 0, size)]))
        assert len(w.rest()) <= windows
    everything = closed + w.rest()
    assert sorted(k for c in everything for k, _, _ in c) == list(range(len(sizes)))
    assert all(sum(s for _, _, s in c) <= 20 for c in everything)


def check(rows, sizes, capacity):
    total, bins, places = Counter(), Counter(), defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.n_tokens
        bins[r.container_id] += r.n_tokens
        places[r.container_id].append(r.position)
        assert r.piece > 0 or r.n_tokens <= capacity
    assert total == Counter(sizes) or {k: v for k, v in total.items() if v} == {k: v for k, v in sizes.items() if v}
    assert set(total) == set(sizes)
    assert max(bins.values()) <= capacity
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return len(bins)


def test_every_item_is_whole_and_little_room_is_left(spark):
    sizes = {i: (i * 7919) % 90 + 1 for i in range(3000)} | {5000: 0, 5001: 250, 5002: 100}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint").withColumn("bin", F.lit("clash")).withColumn("open", F.lit(1))
    for slots, windows, over in ((1, 64, 1.03), (5, 64, 1.03), (5, 8, 1.15), (40, 8, 1.15)):  # few windows pack less tightly
        rows = pack(df, [(1, 100), (2, 1000)], open_windows=windows, merge_ways=4, slots=slots).collect()
        for target, capacity in ((1, 100), (2, 1000)):
            assert {r.capacity_tokens for r in rows if r.target_id == target} == {capacity}
            n = check([r for r in rows if r.target_id == target], sizes, capacity)
            assert n <= over * sum(sizes.values()) / capacity + 2, (slots, windows, n)


def test_long_null_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, 250), (2, None), (3, 10), (3, 10)], "doc_id bigint, n_tokens bigint")
    rows = pack(df, [(1, 100)], slots=2).collect()
    assert sorted((r.piece, r.n_tokens) for r in rows if r.doc_id == 1) == [(1, 100), (2, 100), (3, 50)]
    assert sum(r.doc_id == 3 for r in rows) == 2 and sum(r.doc_id == 2 for r in rows) == 1
    assert pack(df.limit(0), [(1, 100)]).count() == 0 and pack(df, []).count() == 0


def test_documents_are_sized_by_the_tokenizer(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(10**6, ""), (10**6 + 1, None), (10**6 + 2, "<|endoftext|> word " * 4000)], "doc_id bigint, text string")
    sizes = {r.doc_id: r.n_tokens for r in token_counts(docs.select("doc_id", "text").union(extra)).collect()}
    assert sizes[10**6] == 0 and sizes[10**6 + 1] == 0 and sizes[10**6 + 2] > 4096
    rows = pack_documents(docs, spark.read.parquet(f"{small}/pack_targets.parquet")).where("target_id = 2").collect()
    check(rows, {k: v for k, v in sizes.items() if k < 10**6}, 512)


def test_containers_don_t_depend_on_the_layout_of_the_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") * 7919 % 90 + 1).alias("n_tokens"))
    rows = lambda d: {(r.container_id, r.position, r.doc_id) for r in pack(d, [(1, 100)], slots=6, merge_ways=3).collect()}
    one = rows(df.coalesce(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert rows(df.repartition(11, F.rand(1))) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
