import corpus_pipeline as p
from docloom.llm import chat_format, common, decontaminate as de, quality_rules as q, secret_scan as sc, sentence_pieces as sp  # noqa: F401
from tests.llm.test_dedup import groups
from tests.llm.test_secret_scan import brute

D = "/root/testdata/sf0.01"


def test_against_brute_force(spark):
    docs = {r.doc_id: r for r in common.table(spark, D, "documents").collect()}
    ledger = q.apply_policy(q.ledger(common.table(spark, D, "documents")))  # held against SQL in its own test
    good = sorted(r.doc_id for r in ledger.where("kept").collect())
    near = groups([docs[i].text for i in good], 5, 80)
    kept = [i for k, i in enumerate(good) if near[k][1] == k]
    items = [tuple(r.text.encode().translate(de._NORMAL).split()) for r in common.table(spark, D, "benchmark").collect()]
    grams = {w[j : j + 10] for w in items for j in range(len(w) - 9)} | {w for w in items if 0 < len(w) < 10}

    def leaks(text):
        w = tuple(text.encode().translate(de._NORMAL).split())
        return any(w[j : j + n] in grams for n in {len(g) for g in grams} for j in range(len(w) - n + 1))

    clean = [i for i in kept if not leaks(docs[i].text)]
    ratios = sc.train(sc.sample(spark))
    with open(sp.default_model(), "rb") as f:
        model = sp.Model(f.read())
    got = {r.doc_id: r for r in p.run(spark, D).collect()}
    assert sorted(got) == clean
    for i in clean:
        text, out, last = docs[i].text, [], 0
        spans = sorted(tuple(map(int, s.split(":")[1:])) for s in brute(text, ratios)[4].split(",") if s)
        for a, b in spans:
            if a >= last:
                out += [text[last:a], "[SECRET]"]
            last = max(last, b)
        want = "".join([*out, text[last:]])
        assert got[i].text == want and got[i].exact and model.decode(got[i].piece_ids) == want
        assert got[i].n_chars == (len(want) if want != text else docs[i].n_chars)


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = common.table(spark, D, "documents").limit(30)
    taken = ["spans", "n_words", "fail_bits", "kept", "n_hit", "items", "component_id", "__before"]
    odd = docs.withColumns({c: docs.doc_id.cast("string") for c in taken})
    for frame in (odd, odd.drop("n_chars"), odd.limit(0)):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, frame, D)
            assert out.columns == frame.columns, name
            assert all(r[c] == str(r.doc_id) for r in out.collect() for c in taken), name
    last = p.STAGES[-1][1]
    assert last(spark, odd.limit(0), D).count() == 0
    again = last(spark, docs.withColumn("piece_ids", docs.doc_id).withColumn("exact", docs.doc_id), D)
    assert sorted(again.columns) == sorted({*docs.columns, "piece_ids", "n_pieces", "exact"}) and again.where("exact").count() == 30


def test_stages_take_odd_rows(spark):
    long = "Some words of a long text that nobody wrote before, number %d. "
    rows = [(1, None), (2, ""), (3, " \n"), (None, "".join(long % i for i in range(300))), (5, "".join(long % (i * 7) for i in range(300))), (5, "".join(long % (i * 7) for i in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, stage in p.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, D).collect(), stage(spark, docs, D).schema)
        assert docs.count() <= 6, name
    assert docs.where("NOT exact").count() == 0
