"""Small documents for the tests: nulls, empties, ties, repeated rows and a clashing extra column."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string"


def documents(spark, texts):
    """texts: list of text, or of (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOCS)


def table_dir(tmp_path, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
