"""What training-data operators store and what they send to workers."""

import numpy as np
import pyarrow as pa

from lociweave.llm import token_groups, toxicity_kn

TEXT = "one two three four five six seven eight nine ten eleven twelve"


def test_fit_sends_no_counts_to_workers(spark, monkeypatch):
    sent, context = [], type(spark.sparkContext)
    send = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(type(value)) or send(self, value))
    docs = spark.createDataFrame([(i, f"{TEXT} {'bad' if i % 3 == 0 else 'good'} {i % 5}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    toxicity_kn.fit(docs, labels)
    assert toxicity_kn.Counts not in sent and sent.count(toxicity_kn.NgramModel) == toxicity_kn.FOLDS


def test_token_groups_store_no_keys_and_one_copy_of_tokens(spark, monkeypatch):
    stored, cut = {}, token_groups.cut_lineage

    def noted(df):
        out = cut(df)
        stored[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(token_groups, "cut_lineage", noted)
    # rows that repeat id and text, in several partitions
    docs = spark.createDataFrame([(i % 20, f"{TEXT} {TEXT.replace('o', str(i % 4))}" if i % 20 < 8 else f"{i % 20} {TEXT}") for i in range(60)], "doc_id long, text string").repartition(3)
    rows = token_groups.jaccard_components(docs).collect()
    assert len(rows) == 60 and {r["component_id"] for r in rows if r["doc_id"] in (0, 4)} == {0}
    assert not any("keys" in columns for columns in stored)
    assert "Exchange" not in stored[("node", "hashes")].split("MapInArrow")[0]


def test_toxicity_workers_remember_listed_words_only(spark, monkeypatch):
    gone, context, kind = [], type(spark.sparkContext), type(spark.sparkContext.broadcast(0))
    sent, send, destroy = [], context.broadcast, kind.destroy
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(send(self, value)) or sent[-1])
    monkeypatch.setattr(kind, "destroy", lambda self, blocking=False: gone.append(self) or destroy(self, blocking))
    docs = spark.createDataFrame([(i, f"{TEXT} {'bad' if i % 3 == 0 else 'good'} {i % 5}") for i in range(60)], "doc_id long, text string")
    model = toxicity_kn.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"))
    assert sent and gone == sent  # the driver keeps no broadcast of the fit
    once = [" ".join(f"rare{i}x{j}" for j in range(40)) for i in range(300)]
    words = [*TEXT.split(), *once[0].split()]
    ratios = model.log_ratios(words)
    spelled, init = [], toxicity_kn.Spelling.__init__
    monkeypatch.setattr(toxicity_kn.Spelling, "__init__", lambda self, words: spelled.append(len(words)) or init(self, words))
    mean, n = model.means(pa.array([*once, TEXT, once[0], f"{TEXT} {once[0]}"]))
    assert max(spelled) <= toxicity_kn.SPELLED < 256 * 40 and n.tolist() == [40] * 300 + [12, 40, 52]
    assert set(model.known) == set(TEXT.split()) and all(w in model.words for w in model.known)
    assert np.allclose(mean[[0, -3, -2, -1]], [x.mean() for x in (ratios[12:], ratios[:12], ratios[12:], ratios)])


def test_drop_toxic_returns_a_few_texts_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{TEXT} {'bad' if i % 3 == 0 else 'good'} {i % 5}" if i % 7 else None) for i in range(700)], "doc_id long, text string")
    model = toxicity_kn.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic"))
    whole = pa.RecordBatch.from_pylist([r.asDict() for r in docs.collect()])
    runs, send = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *schema: runs.append(run) or send(self, run, *schema))
    kept = toxicity_kn.drop_toxic(docs, model)
    parts = list(runs[0](iter([whole])))
    assert max(x.num_rows for x in parts) <= toxicity_kn.TOGETHER < whole.num_rows
    ids = [i for x in parts for i in x.column(0).to_pylist()]
    score = model.scores(whole.column(1))[0]
    assert 0 < len(ids) < 700 and ids == np.flatnonzero(score < 0.7).tolist() == sorted(r["doc_id"] for r in kept.collect())
