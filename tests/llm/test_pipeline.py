import random
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from llm.tokens import word_bpe_path

EXTRA = "score double, contamination string, base_spans string, random_spans string, row long, text_2 string, Host string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def changed(text, seed, n=1):
    w = text.split()
    for i in random.Random(seed).sample(range(len(w)), n):
        w[i] = "Other"
    return " ".join(w)


def rows_of(texts):
    return [(i, t, "en", "s", None if t is None else len(t), 0.9, "c", "b", "r", 5, "x", "h") for i, t in texts]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    """Documents, benchmark and labels as tables, and what must become of each document."""
    base, passage = words(120, 1), words(14, 2)
    texts, toxic = {i: words(60, 100 + i) for i in range(100, 260)}, set()
    for i in range(100, 260, 4):
        texts[i] += " grumblefuzz you"
        toxic.add(i)
    texts |= {1: base, 2: base, 3: changed(base, 3), 4: None, 5: "", 6: " \n\t", 7: words(4000, 7), 8: words(30, 8) + " " + passage, 9: 'see password="hunter2secret" and ' + words(20, 9), 10: "one two", 11: "One  TWO", 12: None}
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows_of(texts.items()), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "one two"), (3, words(12, 99))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in texts if i >= 100], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), texts, toxic


def test_every_stage_and_the_whole_against_brute_force(spark, fixture):
    at, texts, toxic = fixture
    docs, left = spark.read.parquet(f"{at}/documents.parquet"), set(texts)
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontaminate", "secrets", "packing"]
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    for name in ("toxicity", "near_dedup", "decontaminate", "secrets"):
        if name == "toxicity":
            left -= toxic
        elif name == "near_dedup":
            sets = {i: shingles(texts[i]) for i in left}
            left -= {j for i in left for j in left if i < j and sets[i] and sets[j] and near(sets[i], sets[j])}
        elif name == "decontaminate":
            left -= {8}
        docs = stages[name](spark, docs, at)
        assert docs.columns == spark.read.parquet(f"{at}/documents.parquet").columns
        got = {r["doc_id"]: r for r in docs.collect()}
        assert set(got) == left and len(got) == docs.count()
        assert all(got[i]["score"] == 0.9 and got[i]["contamination"] == "c" and got[i]["row"] == 5 for i in left)
        docs = spark.createDataFrame([tuple(r) for r in got.values()], SCHEMA)
    assert {2, 3, 8, 11} & left == set() and {1, 4, 5, 6, 7, 9, 10, 12} <= left
    clean = {i: texts[i] for i in left} | {9: texts[9].replace('password="hunter2secret', "[SECRET]")}
    assert {i: r["text"] for i, r in got.items()} == clean
    assert all(r["n_chars"] == (None if clean[i] is None else len(clean[i])) for i, r in got.items())
    t = Tokenizer.from_file(word_bpe_path())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in clean.items()}
    for pieces in (stages["packing"](spark, docs, at).toPandas(), cp.run(spark, at).toPandas()):
        assert set(pieces.doc_id) == left
        for i, g in pieces.sort_values("start").groupby("doc_id"):
            assert [x for raw in g.ids for x in memoryview(raw).cast("I")] == ids[i] and all(zlib.crc32(raw) == c for raw, c in zip(g.ids, g.ids_crc32))
        for _, g in pieces.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and bin(g.length.sum()).count("1") == 1


def test_near_duplicate_stage_takes_rows_apart(spark, tmp_path):
    base, other = words(80, 1), words(80, 2)
    texts = [(3, base), (3, base), (7, other), (7, changed(base, 4)), (None, base), (None, words(50, 5)), (None, None), (9, None), (9, None), (2, changed(base, 6))]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in cp.near_duplicates(spark, docs, str(tmp_path)).collect()), key=str)
    want = [(False, 2, changed(base, 6)), (False, 7, other), (True, None, words(50, 5)), (True, None, ""), (False, 9, ""), (False, 9, "")]
    assert got == sorted(want, key=str)


def test_empty_tables(spark, fixture, tmp_path):
    at = fixture[0]
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    some = spark.createDataFrame(rows_of([(1, "a b c"), (2, None)]), SCHEMA)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, some, str(tmp_path)).count() == 2


def test_bench_times_every_training_data_query():
    import __spark_entry__ as entry
    import bench

    assert {n for n in entry.queries() if n.startswith("op") or n == "pipeline"} == set(bench.EXTRA)
