"""The stages of the corpus pipeline, each on what the one before kept, against brute force."""

import random

import pytest

import corpus_pipeline as P
from test_duplicates import classes_by_hand, grams, split
from test_search import found_by_hand
from turnwise.llm import _spark, decontamination, jaccard_join, substring_dedup
from turnwise.llm import quality_rules as Q


def write(spark, folder, documents, labels, benchmark):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, t string, id int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good and shouted texts, copies, near copies, shared passages, leaks, null and empty texts, repeated rows, clashing columns."""
    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(2, 8))) for _ in range(5000)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(20)) + ". " + " ".join(some(5)) + ".") for k in range(10)]
    passage, texts, labels = some(70), [], []
    for k in range(240):
        good = k % 4 != 0
        w = some(r.randrange(60, 160))
        texts.append((k, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((k, int(good), 0))
    texts += [(1000 + k, texts[4 * k + 1][1]) for k in range(8)]
    texts += [(2000 + k, " ".join(["changed", *texts[4 * k + 2][1].split()[1:]])) for k in range(8)]
    texts += [(3000 + k, " ".join(some(40) + passage + some(50)) + ".") for k in range(6)]
    texts += [(4000 + k, " ".join(some(50)) + " " + items[k][1] + " " + " ".join(some(60)) + ".") for k in range(6)]
    texts += [(5000, None), (5001, ""), (5002, " \n "), (5003, "one."), texts[1], (None, texts[5][1])]
    documents = [(i, t, "en", "s", None if t is None else len(t), "t", 3) for i, t in texts]
    return write(spark, tmp_path_factory.mktemp("tables") / "sf", documents, labels, items), items


def test_stages_equal_brute_force(spark, tables):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    outs = []
    for _, stage in P.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        outs.append([(x.doc_id, x.text) for x in docs.collect()])
    begin = [(x.doc_id, x.text) for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]

    # rejected texts go, by the rules written out over the statistics
    scored = {(x.doc_id, x.score >= 0.3) for x in Q.quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    good = {i for i, ok in scored if ok}
    assert sorted(outs[0], key=str) == sorted((x for x in begin if x[0] in good or x[0] is None), key=str)
    assert sum(i is not None and i < 240 and i % 4 == 0 for i, _ in outs[0]) <= 2 and sum(i is not None and i < 240 and i % 4 != 0 for i, _ in outs[0]) >= 170

    # one of each class stays
    known = [x for x in outs[0] if x[0] is not None]
    assert sorted(i for i, _ in outs[1] if i is not None) == sorted({c for _, c, _ in classes_by_hand(known)})
    assert any(i is None for i, _ in outs[1]) == any(i is None for i, _ in outs[0])

    # of what is left, no passage of 50 words is in two texts, and nothing else is lost
    seen: dict[tuple, int] = {}
    for i, text in outs[2]:
        w = split(text)
        for run in {tuple(w[k : k + 50]) for k in range(len(w) - 49)} if i is not None else ():
            assert seen.setdefault(run, i) == i
    before = dict(outs[1])
    shared: dict[tuple, set] = {}
    for i, text in outs[1]:
        for g in grams(text):
            shared.setdefault(g, set()).add(i)
    for i, text in outs[2]:
        if text != before[i]:
            gone = [g for g in grams(before[i]) - grams(text) if len(shared[g]) > 1]
            assert len(gone) >= 46
    assert {i for i, _ in outs[1]} - {i for i, _ in outs[2]} <= {i for i, t in outs[1] if len(split(t)) >= 50}

    # documents with an item go
    leaks = {i for i, _ in found_by_hand([(i, t or "") for i, t in outs[2]], items)}
    assert leaks and sorted(outs[3], key=str) == sorted((x for x in outs[2] if x[0] not in leaks), key=str)

    # all tokens of what is left are packed, each once
    from tokenizers import Tokenizer

    from turnwise.llm.queries import vocabulary

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = P.STAGES[4][1](spark, docs, folder).collect()
    lengths: dict = {}
    for x in pieces:
        lengths[x.doc_id] = lengths.get(x.doc_id, 0) + x.length
    wanted: dict = {}
    for i, text in outs[3]:
        wanted[i] = wanted.get(i, 0) + len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    assert lengths == wanted
    room: dict = {}
    for x in pieces:
        room[x.sequence_id] = room.get(x.sequence_id, 0) + x.length
    assert max(room.values()) <= 2048

    whole = P.run(spark, folder).collect()
    assert sum(x.length for x in whole) == sum(x.length for x in pieces) and {x.doc_id for x in whole} == {x.doc_id for x in pieces}


def test_empty_tables_pass_through(spark, tmp_path):
    folder = write(spark, tmp_path / "sf", [], [], [])
    assert P.run(spark, folder).count() == 0


def test_stages_hand_texts_to_python_in_small_batches(spark, tables, monkeypatch):
    """Whatever a stage runs, it runs with batches of TEXT_ROWS: no stage leaves workers with larger ones."""
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), module in zip(P.STAGES, (Q, jaccard_join, substring_dedup, decontamination, P)):
        sizes = set()
        with monkeypatch.context() as m:
            m.setattr(module, "kept", lambda df: (sizes.add(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), _spark.kept(df))[1])
            stage(spark, docs, folder)
        assert str(_spark.TEXT_ROWS) in sizes, name
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_a_step_drops_what_others_kept():
    _spark.store("one")["x"] = _spark.store("two")["x"] = "held"
    _spark.give_back("two")
    assert not _spark.store("one") and _spark.store("two").pop("x") == "held"
