import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def tokenizer_path():
    from shelfspark.llm.queries import tokenizer_path as path

    return path()


@pytest.fixture(scope="session")
def tokenizer(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


#: Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names.
ODD_TEXTS = [
    (5, "The first text, with words."), (3, None), (None, "A row without an id"), (7, ""), (1, "  \n\t "),
    (9, "x" * 30_000), (4, "Été à la plage: naïve façade, Straße, İstanbul ΑΣ <|endoftext|> it's 2024!"), (4, "same id, other text"),
    (5, "The first text, with words."), (11, "word " * 20_000), (12, "日本語のテキスト 한국어 😀 ½"), (13, "!!! ... ---"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en" if t else None, "src0", len(t or ""), "clash", 1, 2) for i, t in ODD_TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, part string, start int, h1 int").coalesce(2)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
