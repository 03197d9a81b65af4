import re

import corpus_pipeline
import public_tokenizers
import pytest
from test_fm_index import words as leak_words
from test_line_dedup import brute as line_brute
from test_tensor_minhash import brute as near_brute
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, from ``documents`` on."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    for _, df in stages[:-1]:
        assert df.columns == stages[0][1].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [n for n, _ in stages[1:]]


def test_quality_rejects_junk_and_keeps_the_rest(spark, stages):
    before, after = texts(stages[0][1]), texts(stages[1][1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(before[k] == v for k, v in after.items())
    good = [k for k, y in labels.items() if y == 1]
    assert sum(k in after for k in good) >= 0.95 * len(good)
    assert len(after) < len(before)


def test_lines_equal_brute_force(stages):
    before, after = texts(stages[1][1]), texts(stages[2][1])
    want = {k: kept for k, (n, gone, kept) in line_brute(before).items() if gone < n}
    assert after == want
    assert all(r.n_chars == len(r.text) for r in stages[2][1].collect())


def test_near_copies_equal_brute_force(stages):
    before, after = texts(stages[2][1]), texts(stages[3][1])
    assert after == {k: before[k] for k, (_, _, kept) in near_brute(before).items() if kept}


def test_no_phrase_is_left_and_nothing_else_goes(spark, stages):
    before, after = texts(stages[3][1]), texts(stages[4][1])
    phrases = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = leak_words(r.text)
        phrases |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    for k, text in before.items():
        joined = f" {' '.join(leak_words(text))} "
        hit = any(f" {p} " in joined for p in phrases)
        if not hit:
            assert after[k] == text
        elif k in after:
            assert len(after[k]) < len(text)


def test_packing_holds_every_token(stages):
    before = texts(stages[4][1])
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    rows = stages[5][1].collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {k: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in before.items()}
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024 and sum(used.values()) >= 0.95 * 1024 * (len(used) - 8)


def test_run_is_the_stages_in_order(spark, stages):
    assert re.fullmatch("quality line_dedup near_dedup decontamination packing", " ".join(n for n, _ in corpus_pipeline.STAGES))
    assert corpus_pipeline.run(spark, SF).agg({"length": "sum"}).first()[0] == stages[5][1].agg({"length": "sum"}).first()[0]


def test_empty_documents(spark, docs_of, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs_of({}).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
