import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """``docs_of({doc_id: text})`` or ``docs_of([(doc_id, text), ...])`` as a table of documents."""

    def build(texts, **more):
        pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
        schema = COLUMNS + "".join(f", {k} {v}" for k, v in more.items())
        rows = [(i, t, "en", "src0", len(t or ""), *[None] * len(more)) for i, t in pairs]
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def corpus(spark):
    """All documents of the smallest tables, as ``{doc_id: text}``."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in sorted(rows)}
