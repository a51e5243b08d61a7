"""The join's Python workers hold few words and one batch of sets at a time."""

from lexfolio.llm.ngram_join import Shingles, sets_of


def test_few_words_are_held_and_sets_stay_the_same(spark):
    assert Shingles(5).most <= 50_000
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(40)) for i in range(200)]
    tight = Shingles(5, most=10)
    assert all((tight(t) == Shingles(5)(t)).all() for t in texts)
    docs = spark.createDataFrame(list(enumerate([*texts, "x " * 700_000, None])), "doc_id long, text string").coalesce(1)
    sets = sets_of(docs, docs.select("doc_id"), 5).collect()
    assert len(sets) == 202
    assert sorted(len(r["shingles"]) for r in sets)[:2] == [0, 1]
