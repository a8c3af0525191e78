"""The pipeline, each stage against a plain version of it on its own input."""
import pytest

import corpus_pipeline
from moldwatch.llm import langid, packing, quality
from moldwatch.llm.store import written
from tests.conftest import SF_SMALL
from tests.llm import helpers


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        found.append((name, written(stage(spark, found[-1][1], SF_SMALL), name)))
    return dict(found)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_names(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontaminate", "pack"]
    for name in ("language", "quality", "near_duplicates", "decontaminate"):
        assert steps[name].schema == steps["documents"].schema


def test_language(spark, steps):
    tools = langid.Compressors(langid.fit_dictionaries(steps["documents"].filter("crc32(cast(doc_id as string)) % 4 != 2")))
    letters = steps["documents"].select("doc_id", langid.letters(steps["documents"]["text"]).alias("t")).collect()
    want = {r["doc_id"] for r in letters if r["t"].strip() and tools.decide(r["t"])[2] >= langid.MARGIN}
    assert set(texts(steps["language"])) == want and len(want) > 0.95 * len(letters)


def test_quality(steps):
    def kept(t):
        n, chars, symbols, dup, repeat = helpers.quality(t)
        upper = sum("A" <= c <= "Z" for c in t)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n"))
        return (n >= 50 and 100 * repeat <= 50 * n and 100 * symbols <= 10 * n and 2 * n <= chars <= 14 * n and 100 * upper <= 50 * chars
                and 100 * dup <= 60 * lines)
    assert quality.POLICY == "v2"
    assert set(texts(steps["quality"])) == {i for i, t in texts(steps["language"]).items() if kept(t)}


def test_near_duplicates(steps):
    before = sorted(texts(steps["quality"]).items())
    root = helpers.classes([t for _, t in before])
    assert set(texts(steps["near_duplicates"])) == {before[i][0] for i in set(root)}


def test_decontaminate(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {tuple(w[i:i + 10]) for w in (helpers.words(t) for _, t in items) for i in range(max(1, len(w) - 9)) if w}

    def hit(t):
        w = helpers.words(t)
        return any(tuple(w[i:i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    assert set(texts(steps["decontaminate"])) == {i for i, t in texts(steps["near_duplicates"]).items() if not hit(t)}


def test_pack(steps):
    n = {i: helpers.quality(t)[0] for i, t in texts(steps["decontaminate"]).items()}
    rows = steps["pack"].collect()
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == n and all(r["n_tokens"] <= r["bucket_len"] <= packing.MAX_LEN for r in rows)


def test_run_and_odd_input(spark, steps, odd_docs, no_docs, tmp_path):
    assert sorted(corpus_pipeline.run(spark, SF_SMALL).collect()) == sorted(steps["pack"].collect())
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, SF_SMALL), "step")
            assert docs.columns == odd_docs.columns
        corpus_pipeline.pack(spark, docs, SF_SMALL).count()
    one = corpus_pipeline.near_duplicates(spark, odd_docs, SF_SMALL).collect()
    ids = sorted((r["doc_id"] for r in one if r["doc_id"] is not None))
    assert ids == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]  # 12 and the copies in 7 are copies of 1; the other text of 7 stays
