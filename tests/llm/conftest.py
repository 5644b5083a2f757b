import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts or (doc_id, text[, source]) tuples."""
    def make(rows):
        full = []
        for k, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (k, r)
            source = r[2] if len(r) > 2 else f"src{k % 3}"
            full.append((r[0], r[1], "en", source, len(r[1]) if r[1] is not None else None))
        return spark.createDataFrame(full, DOCUMENTS)
    return make


@pytest.fixture
def table_dir(spark, tmp_path):
    """Writes tables as a data folder; returns its path."""
    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return make


def read_rows(df):
    return [r.asDict() for r in df.collect()]


def files_left(spark):
    from askorpus.sources.staging import shared_dir
    return glob.glob(f"{shared_dir(spark).removeprefix('file://')}/*")
