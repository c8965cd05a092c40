from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelane.llm.encoding import improbable_runs, repair_documents

CLEAN = [
    "Das Päckchen war schön verpackt, die Tür schließt gut und müde Füße gibt es nicht.", "Le vendeur a répondu très vite, c’est agréable à l’été déjà passé.",
    "El envío llegó mañana por la tarde, según mi niño está genial.", "A proteção não é grave, até já usei a ligação três vezes.",
    "Посылка шла полгода, но всё работает прекрасно и держится крепко.", "Μετά από τρεις μέρες δουλεύει άψογα και η μπαταρία είναι γερή.",
    "The café had ½ price tea — unrelated, but I wouldn’t call it “premium”.", "Barva je spíš šedá než černá, příručka chybí úplně všude.",
]


def repaired(spark, texts):
    docs = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, CLEAN[i % len(CLEAN)] + " " + CLEAN[(i * 3 + 1) % len(CLEAN)]) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("pair", F.lit("clash")).withColumn("n", F.lit(0))
    return {r.doc_id: r for r in repair_documents(df).collect()}


def test_wrong_decodings_are_undone(spark):
    wrong = []
    for page in ("cp1252", "latin-1", "mac_roman", "cp437"):
        wrong += [(CLEAN[0], CLEAN[0].encode().decode(page, "ignore")), (CLEAN[3], CLEAN[3].encode().decode(page, "ignore"))]
    wrong += [(CLEAN[4], CLEAN[4].encode("cp1251").decode("latin-1")), (CLEAN[4], CLEAN[4].encode("koi8-r").decode("cp1251")), (CLEAN[5], CLEAN[5].encode("cp1253").decode("latin-1"))]
    wrong += [(CLEAN[2], CLEAN[2].encode().decode("latin-1").encode().decode("latin-1"))]
    whole = [w for o, w in wrong if w.isprintable() or True]
    got = repaired(spark, whole)
    assert set(got) == set(range(len(whole)))
    restored = sum(got[i].restored_text == o for i, (o, _) in enumerate(wrong))
    assert restored >= len(wrong) - 1


def test_part_of_a_text_and_lost_bytes(spark):
    part = CLEAN[4] + " " + CLEAN[0].encode().decode("cp1252", "ignore") + " " + CLEAN[5]
    lost = CLEAN[1].encode("latin-1", "replace").decode("utf-8", "replace")
    got = repaired(spark, [part, lost, "word " * 20_000 + CLEAN[0].encode().decode("latin-1")])
    assert got[0].restored_text == CLEAN[4] + " " + CLEAN[0] + " " + CLEAN[5] and got[0].restorable
    assert not got[1].restorable and set(got) == {0, 1, 2}


def test_copies_of_a_damaged_text_are_all_restored(spark):
    for original, wrong in ((CLEAN[0], CLEAN[0].encode().decode("cp1252", "ignore")), (CLEAN[4], CLEAN[4].encode("cp1251").decode("latin-1"))):
        got = repaired(spark, [wrong] * 200)
        assert len(got) == 200 and {r.restored_text for r in got.values()} == {original}


def test_near_copies_of_a_damaged_text_are_all_restored(spark):
    wrong = CLEAN[0].encode().decode("cp1252", "ignore")
    got = repaired(spark, [f"{wrong} {i}" for i in range(200)])
    assert {i: r.restored_text for i, r in got.items()} == {i: f"{CLEAN[0]} {i}" for i in range(200)}


def seen_as(text, page, times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in text.encode())
    return text


def test_many_fold_damage_is_restored_or_marked(spark):
    wrong = [seen_as(CLEAN[k], page, times) for k in (0, 1, 2) for page in ("latin-1", "cp1252") for times in (2, 3, 4, 5)]
    got = repaired(spark, wrong)
    assert set(got) == set(range(len(wrong)))
    for i, row in got.items():
        assert (row.restored_text == CLEAN[i // 8]) == row.restorable
    assert sum(r.restorable for r in got.values()) >= len(wrong) - 3


def test_frequent_damage_is_not_learnt_as_usual(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("length(text) > 0").select("text").collect()]
    damaged = set(repair_ids(spark, texts))
    whole = [t for i, t in enumerate(texts) if i not in damaged]
    accented = [i for i, t in enumerate(whole) if any("\u00c0" <= c <= "\u024f" for c in t)]
    for every in (5, 2):  # a fifth, then half of the texts that can be damaged
        chosen = set(accented[::every])
        mixed = [seen_as(t, "cp1252") if i in chosen else t for i, t in enumerate(whole)]
        got = repair_ids(spark, mixed)
        assert chosen <= set(got)
        assert sum(got[i].restored_text == whole[i] for i in chosen) >= 0.95 * len(chosen)


def repair_ids(spark, texts):
    return {r.doc_id: r for r in repair_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}


def test_a_small_corpus(spark):
    texts = [f"{CLEAN[k % 4]} {k}" for k in range(300)]
    wrong = {k: texts[k].encode().decode("cp1252", "ignore") for k in (0, 51, 102, 153, 204)}
    got = repair_ids(spark, [wrong.get(k, t) for k, t in enumerate(texts)])
    assert {k: got[k].restored_text for k in got} == {k: texts[k] for k in wrong}


def test_genuine_text_is_no_case(spark):
    genuine = [
        *CLEAN, "Modelo IRMÃ® em preto.", "a versão «MANHÃ» e não a outra", "NÃO GOSTEI DA AVALIAÇÃO", "La taille « Â » est plus étroite que la « Ê ».",
        "Åsa says: på tur, Ärlig vara.", "caf&eacute; 100%25", "zero​width soft­hyphen", "", None, "plain",
    ]
    assert repaired(spark, genuine) == {}
    assert repair_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([-1.0, -0.3, 0.4, 1.0]), max_size=30))
def test_segments_begin_and_end_positive_and_don_t_overlap(scores):
    runs = improbable_runs(list(range(len(scores))), scores, -0.3)
    assert all(scores[a] > 0 and scores[b] > 0 and sum(scores[a : b + 1]) > 0 for a, b in runs)
    assert all(b < c for (_, b), (c, _) in zip(runs, runs[1:]))
    covered = {i for a, b in runs for i in range(a, b + 1)}
    assert all(i in covered for i, s in enumerate(scores) if s > 0)
