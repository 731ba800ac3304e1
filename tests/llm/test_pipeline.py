"""Each stage of the pipeline works on all that its predecessor kept and keeps the columns of documents."""

import corpus_pipeline as P
from evtspark.llm import decontaminate, packing, simhash, toxicity
from tests.conftest import DATA


def edit_part(item, text):
    """Edits between the item and the part of the text that is nearest to it."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_stages(spark, docs, tmp_path):
    inputs, outputs = {}, {}
    now = docs
    for k, (name, stage) in enumerate(P.STAGES):
        inputs[name] = now
        path = f"file://{tmp_path}/{name}"
        stage(spark, now, DATA).write.parquet(path)
        now = outputs[name] = spark.read.parquet(path)
        if k < len(P.STAGES) - 1:
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in outputs.items()}
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    low = {r.id for r in toxicity.score(docs, model).collect() if r.score < 0.3}
    assert ids["toxicity"] == low
    first = {r.id for r in simhash.near_duplicates(inputs["simhash_near_dedup"], width=5, distance=11, similarity=0.8).collect() if r.id == r.component}
    assert ids["simhash_near_dedup"] == first
    texts = {r.doc_id: r.text for r in inputs["decontamination"].collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    # an item's words, with a fifth of them edited at most, leave no less than so many of its words in a stretch of the text
    words = [decontaminate.tokens(x) for x in items]
    for i in texts.keys() - ids["decontamination"]:
        own = decontaminate.tokens(texts[i])
        assert any(any(edit_part(w, own[a : a + 3 * len(w)]) <= len(w) // 5 for a in range(0, len(own), len(w))) for w in words if len(set(w) & set(own)) >= 0.8 * len(set(w)))
    assert not any(x in texts[i] for i in ids["decontamination"] for x in items)
    assert ids["pii"] == ids["decontamination"] == ids["packing"]
    clean = {r.doc_id: r for r in outputs["pii"].collect()}
    assert not any("@mail" in r.text for r in clean.values()) and all(r.n_chars == len(r.text) for r in clean.values())
    total = sum(r.length for r in outputs["packing"].collect())
    assert outputs["packing"].select("sequence_id").distinct().count() <= total // 2048 + 2 and packing is not None


def test_run(spark):
    assert P.run(spark, DATA.replace("0.01", "0.001")).count() > 0


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, further columns, no labels and no benchmark: clean texts all arrive."""
    from tests.llm.conftest import ODD

    rows = [(i, t, "xx", None, len(t or ""), "c") for i, t in ODD]
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash string"),
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = {r.doc_id for r in P.run(spark, f"file://{tmp_path}").collect()}
    assert got == {None, 1, 4, 5, 6, 7, 8, 9}  # of the texts without words, ids 1 to 3, the first stays
    tables["documents"].limit(0).write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0
