"""Copies leave before block keys are dealt; texts are cut into sets once."""

from askbatch.llm import jaccard


def test_texts_are_not_joined_to_find_representatives(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, near), (4, None), (None, near), (5, " ".join(words[30:])),
            (5, " ".join(words)), (6, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written = {}

    def seen(df, name="cut", real=jaccard.checkpointed):
        out = real(df, name)
        written.setdefault(name, out)
        return out
    monkeypatch.setattr(jaccard, "checkpointed", seen)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"])
           for r in jaccard.jaccard_components(docs, shingle=3, percent=90).collect()}
    assert got == {(1, 58, 1), (2, 58, 1), (3, 58, 1), (4, 0, 4), (None, 58, None), (5, 28, 1), (5, 58, 1), (6, 0, 6)}
    assert written["shingle-sets"].count() == len(rows) and "text" not in written["shingle-sets"].columns
    assert sorted(r["id"] for r in written["shingle-signatures"].select("id").collect()) == [1, 3, 5, 5]
