import random

import pytest
from pyspark.sql import functions as F

from tidelane.llm import leaks
from tidelane.llm.leaks import leaked_passages, longest_needed, words

NAMES = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]


def brute(text, item, least=12, per_edit=6):
    """Any stretch of at least `least` item words, with common words at both ends, within the edits it may have."""
    for i in range(len(item)):
        for p in range(len(text)):
            if text[p] != item[i]:
                continue
            # edit distance of item[i:i+a] and text[p:p+b], row by row
            row = list(range(len(text) - p + 1))
            for a in range(1, len(item) - i + 1):
                new = [a]
                for b in range(1, len(row)):
                    new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (item[i + a - 1] != text[p + b - 1])))
                row = new
                if a >= least and any(e <= a // per_edit and text[p + b - 1] == item[i + a - 1] for b, e in enumerate(row) if b):
                    return True
    return False


def planted(rng, n_docs, item_words, lengths, most_edits):
    """Documents with an altered piece of an item; edits anywhere but at the piece's ends."""
    items = [(k, [rng.choice(NAMES) for _ in range(item_words)]) for k in range(6)]
    docs = []
    for n in range(n_docs):
        _, item = rng.choice(items)
        length = rng.choice(lengths)
        a = rng.randint(0, item_words - length)
        piece = item[a : a + length]
        for _ in range(rng.randint(0, most_edits)):
            at = rng.randrange(1, max(2, len(piece) - 1))
            kind = rng.randint(0, 2)
            piece = piece[:at] + ([] if kind == 0 else [rng.choice(NAMES)]) + piece[at + (kind != 2) :]
        docs.append((n, [rng.choice(NAMES) for _ in range(rng.randint(0, 20))] + piece + [rng.choice(NAMES) for _ in range(5)]))
    return items, docs


def found(spark, docs, items):
    left = spark.createDataFrame([(n, " ".join(d)) for n, d in docs], "doc_id bigint, text string").withColumn("test_id", F.lit("clash"))
    right = spark.createDataFrame([(k, " ".join(i)) for k, i in items], "test_id bigint, text string")
    return {(r.doc_id, r.test_id) for r in leaked_passages(left, right.withColumn("doc_id", F.lit(0)).withColumn("seed", F.lit(0))).collect()}


@pytest.mark.parametrize("item_words, lengths, most_edits", [(30, (5, 8, 10, 12, 13, 15, 18, 20), 3), (48, (12, 24, 30, 36, 40), 6)])
def test_found_exactly_where_brute_force_finds_them(spark, item_words, lengths, most_edits):
    items, docs = planted(random.Random(3), 120, item_words, lengths, most_edits)
    want = {(n, k) for n, d in docs for k, i in items if brute(d, i)}
    assert len(want) > 30 and len({n for n, _ in want}) < 120
    assert found(spark, docs, items) == want


def test_long_texts_are_cut_without_loss_and_many_items_are_joined(spark, monkeypatch):
    items, docs = planted(random.Random(5), 60, 48, (12, 24, 36), 6)
    for name, value in (("SEGMENT_WORDS", 9), ("FEW_SEEDS", 0), ("FEW_BYTES", 0)):
        monkeypatch.setattr(leaks, name, value)
    assert found(spark, docs, items) == {(n, k) for n, d in docs for k, i in items if brute(d, i)}


def test_passages_hold_one_of_bounded_length():
    assert longest_needed(12, 6) == (29, 4)


def test_one_passage_in_most_documents_and_most_items(spark):
    item = [NAMES[k] for k in range(20)]
    docs = [(n, item if n % 3 else ["none"]) for n in range(300)]
    got = found(spark, docs, [(k, item + [NAMES[40 + k]]) for k in range(50)])
    assert got == {(n, k) for n in range(300) if n % 3 for k in range(50)}
    same = [(0, ["x"] * 5000)]
    assert found(spark, same, [(1, ["x"] * 11 + ["y"] * 5), (2, ["x"] * 12), (3, ["x"] * 3000)]) == {(0, 2), (0, 3)}


def test_case_accents_markup_and_damage_don_t_matter(spark):
    item = "Le garçon très déçu répara l'étui près du mélèze avant que sœur Zoé ne rentrât tôt à l'hôtel fermé"
    same = [
        item.upper(), "<p>Avis.</p><br/>" + item.replace(" ", "\n<b>") + "!", item.encode().decode("cp1252", "replace"), item.encode("latin-1", "replace").decode("utf-8", "replace"),
        item.replace("r", "r\u200b"), item.replace(" ", "\u00a0"), "Le garcon tres decu repara l'etui pres du meleze avant que soeur Zoe ne rentrat tot a l'hotel ferme", item.replace("ç", "&ccedil;"),
        "<div title='" + "x" * 500 + "'>" + item.replace("garçon", "garcon").replace("tôt", "t\u00c3\u00b4t"),
    ]
    docs = [(i, t) for i, t in enumerate(same)] + [(100, ""), (101, None), (102, "un garçon très déçu"), (103, "x " * 50_000 + item), (None, item), (0, same[0])]
    schema = "test_id bigint, text string"
    got = leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item), (1, item), (2, None), (3, "trop court"), (None, item)], schema))
    assert sorted(r.doc_id for r in got.collect()) == [0, *range(len(same)), 103]  # a repeated document counts twice
    assert leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], schema)).count() == 0
    assert leaked_passages(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, item)], schema)).count() == 0
    with pytest.raises(ValueError):
        leaked_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], schema), least=6, per_edit=2)


def test_words_and_scripts():
    assert words("Don’t <i>stop</i>&nbsp;now") == [("dont", "dont"), ("stop", "stop"), ("now", "now")]
    assert [b for b, _ in words("Привет, мир")] == ["привет", "мир"]
    assert [b for b, _ in words("a < b and c > d")] == ["a", "b", "and", "c", "d"]
