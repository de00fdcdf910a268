import corpus_pipeline


def test_pipeline_keeps_the_clean(spark, documents, folder):
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt".split()
    text = lambda k: " ".join(words[(i * k + i // 3) % len(words)] + str(i % (k + 2)) for i in range(60))
    item = "a benchmark passage with quite a few words that nobody would write by chance in a text of their own"
    rows = [(i, text(i + 3)) for i in range(12)]
    rows += [(20, rows[0][1]), (21, rows[1][1] + " tail"), (22, text(40) + "\n" + item), (23, None), (24, "")]
    d = folder(documents=documents(rows), benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(range(12)) <= set(out) and 22 not in out and 23 not in out and 24 not in out
    assert all(out[i]["sp_round_trip"] and out[i]["text"] == rows[i][1] for i in range(12))
    assert "text" in out[0].asDict() and [n for n, _ in corpus_pipeline.STAGES][-1] == "piece_segmentation"
