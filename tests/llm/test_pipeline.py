"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import public_tokenizers as P
import pytest

import corpus_pipeline
from stampcard.llm import quality
from stampcard.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.test_bpe import LIBRARY
from tests.llm.test_contamination import ITEM, plain_leak
from tests.llm.test_lines import meets, plain_lines
from tests.llm.test_simhash import plain_groups, plain_print


def plain_run(docs, items):
    """Rows (id, text) through all stages; ids are unique or null here."""
    good = [(i, t) for i, t in docs if quality_keeps(t)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0))
    lined = [(i, t) for (i, _), t in zip(good, plain_lines(good, lambda a, b: any(meets(a, b))))]
    label = plain_groups([plain_print(t) for _, t in lined])
    one = [r for k, r in enumerate(lined) if label[k] == k]
    clean = [(i, t) for i, t in one if not any(plain_leak(t, x) for x in items)]
    return {i: LIBRARY.encode_ordinary(t or "") for i, t in clean}


def quality_keeps(text):
    words, chars, symbols, dups, repeats, n_lines, letters, capitals, exclaims = quality._measure(text or "")
    return not (
        words < 50 or 100 * repeats > 50 * words or 10 * symbols > words or 10 * dups > 3 * n_lines or chars < 2 * words or chars > 20 * words
        or 2 * capitals > letters or 5 * exclaims > words
    )


def found(rows):
    assert all(r.intact and r.n_tokens == len(r.ids) for r in rows)
    return {r.doc_id: r.ids for r in rows}


def test_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF_SMALL, "documents").collect()]
    items = [r.text for r in table(spark, SF_SMALL, "benchmark").collect()]
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    wanted = plain_run(docs, items)
    assert found(rows) == wanted and len(rows) == len(wanted) and 50 < len(rows) < len(docs)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF_SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).columns == docs.columns


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_rows_and_empty_tables(spark, docs, odd_rows, rows, tmp_path):
    long = " ".join(f"word{k} of{k}" for k in range(60))
    extra = [(50, long), (50, long), (51, long.replace("word", "item") + "\n" + ITEM), (None, long + " more"), (52, "\n".join([long, long]))]
    docs([*odd_rows, *extra] if rows == "odd" else []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if rows == "empty":
        assert got == []
    else:
        ids = [r.doc_id for r in got]
        assert len(ids) == len(set(ids)) and 50 in ids and 51 not in ids and not {1, 2, 3, 4} & set(ids)
