"""Every registered query and pipeline stage over odd tables, all rows collected."""

import random

import pytest
from pyspark.sql import functions as F

from ferroflux.llm import queries

#: Names that operators give to columns of their own, and one that needs quoting.
CLASHING = ("score", "held_out", "kept", "n", "h1", "sid", "told", "leaks", "found", "spans", "a.b", "block", "component_id", "mark")
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def stored(spark, folder, tables, extra=()):
    for name, schema in SCHEMAS.items():
        frame = spark.createDataFrame(tables.get(name, []), schema)
        taken = {c.lower() for c in frame.columns}
        frame.select("*", *[F.lit("clash").alias(c) for c in extra if c.lower() not in taken]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in each column, empty and wordless texts, ties, repeated rows and ids, a text of 300,000 characters, clashing columns."""
    texts = [(k, prose(k)) for k in range(30)] + [(40, prose(1)), (41, prose(1)), (40, prose(1)), (40, prose(2)), (None, prose(3)), (None, None), (50, None), (51, ""), (52, " \t\n"), (53, "é\U0001f600"), (54, "one two"), (-5, prose(9))]
    texts += [(60, " ".join(prose(k, 500) for k in range(100))), (61, "x" * 50_000)]
    documents = [(i, t, None if k % 5 == 0 else "en" if k % 2 else "de", None if k % 3 == 0 else "s", None if k % 4 == 0 else len(t or "")) for k, (i, t) in enumerate(texts)]
    labels = [(k, 1, k % 4 == 0 and 1 or 0) for k in range(30)] + [(1, 0, 1), (None, 1, 1), (2, None, None), (999, 0, 0)]
    pages = [(1, "u", "<a>"), (2, None, None), (3, "u", ""), (1, "u", "<b>"), (None, "u", "<c>"), (4, "u", "é" * 70_000), (5, "u", "<a>"), (5, "u", "<a>")]
    vectors = [(k, [float(k % 7), 0.5, -0.25], 1) for k in range(40)] + [(None, [1.0, 1.0, 1.0], 1), (41, None, 1), (42, [None, 1.0, 1.0], 1), (43, [float("nan"), 1.0, 1.0], None), (20, [1.0, 1.0, 1.0], 1)]
    turns = [(1, 0, "user", "a"), (1, None, None, None), (1, 0, "user", "a"), (2, 0, None, "b"), (None, 0, "user", "c"), (7, 3, "user", "")]
    benchmark = [(1, prose(4)), (2, None), (3, ""), (None, prose(5)), (1, prose(6))]
    tables = {"documents": documents, "labels": labels, "pages": pages, "embeddings": vectors, "conversations": turns, "benchmark": benchmark}
    return stored(spark, tmp_path_factory.mktemp("odd"), tables, CLASHING), len(documents)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_over_odd_rows(spark, odd, name):
    folder, n = odd
    rows = queries.queries()[name](spark, folder).collect()
    assert rows
    if name.split("_")[0] in ("op1", "op2", "op5", "op6", "op7", "op9", "op11", "op12"):  # a row for each row
        assert len(rows) == n
    held_out = [r for r in rows if "held_out" in r.asDict()]
    assert all(r.held_out is not None and 0 <= r.score <= 1 for r in held_out if name.split("_")[0] in ("op5", "op6"))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_over_empty_tables(spark, tmp_path, name):
    assert queries.queries()[name](spark, stored(spark, tmp_path, {})).collect() == []


def test_stages_over_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as pipeline

    folder, n = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        kept[name] = out.collect()
        assert out.columns == docs.columns and len(kept[name]) <= n
    assert len(kept["secrets"]) == n
    names = [[r.doc_id for r in kept[k]] for k in ("near_dedup", "decontamination")]
    assert names[0].count(None) == 2 and 41 not in names[0] and 50 in names[0] and 60 in names[0]
    # Both 4 and the long text 60 hold the words of benchmark item 1.
    assert not {4, 60} & set(names[1]) and {50, 51, 61, None} <= set(names[1])
    pieces = pipeline.pack(spark, docs, folder).collect()
    assert sum(r.start == 0 for r in pieces) == n
    none = stored(spark, tmp_path, {})
    for name, stage in pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{none}/documents.parquet"), none).collect() == []


@pytest.mark.parametrize("name", [q for q in sorted(queries.queries()) if q.split("_")[0] not in ("op8", "op10", "op13")])
def test_query_over_a_very_long_text(spark, tmp_path, name):
    """20 million characters (2 million where a worker holds arrays over a whole text: op7, op9) beside short texts."""
    size = 2_000_000 if name in ("op7_substrings", "op9_lm") else 20_000_000
    page = prose(7, 2000) + "\n"
    texts = [page * (size // len(page)), prose(1), prose(2), prose(3)]
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    labels = [(k, 1, k % 2) for k in range(4)]
    folder = stored(spark, tmp_path, {"documents": docs, "labels": labels, "benchmark": [(1, prose(2))]})
    rows = queries.queries()[name](spark, folder).collect()
    assert {r.doc_id for r in rows} == ({0, 1, 2, 3} if name != "op3_decontamination" else {2})
    if name == "op4_packing":
        assert sum(r.length for r in rows if r.doc_id == 0) == max(r.doc_tokens for r in rows) > size // 10
