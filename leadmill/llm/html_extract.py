"""Main text of web pages: a conditional random field over leaf blocks, decoded by Viterbi.

The model is trained on ``TRAINING_PAGES`` labelled pages (``html_pages``) once per process of the
driver and broadcast; pages are read in place, nothing is shuffled.

Defined results: null, empty and text-less pages give an empty text; a page with broken mark-up
is read as far as it goes; repeated rows are read each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm import html_crf, html_pages
from leadmill.llm.html_blocks import leaf_blocks

TRAINING_PAGES = 600
_MODELS: dict[int, html_crf.Model] = {}


def trained_model(seed: int = 7) -> html_crf.Model:
    if seed not in _MODELS:
        _MODELS[seed] = html_crf.train(html_pages.labelled(TRAINING_PAGES, seed))
    return _MODELS[seed]


def main_text(page: str | None, model: html_crf.Model, memo: dict) -> str:
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, label in zip(blocks, html_crf.decode(blocks, model, memo), strict=True) if label)


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, {}
        for batch in batches:
            texts = []
            for page in batch.column(2).to_pylist():
                texts.append(main_text(page, model, memo))
                if len(memo) > 100_000:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: html_crf.Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model or trained_model())
    return rows.mapInArrow(_extract(shared), "page_id long, url string, text string, n_chars long")
