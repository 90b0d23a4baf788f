import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest  # noqa: E402

from tessera.llm.common import prepare  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " \n\t", "x", "Ünï çödé wörds", "a" * 5000, "same line\nsame line\n", "A b c d e f g h i j k l m n o p"]


@pytest.fixture(scope="session")
def sp(spark):
    return prepare(spark)


@pytest.fixture
def odd(sp):
    """Documents with nulls, empty, very long and repeated texts, a repeated row and clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, "s", "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [(20, "word " * 3000, "en", None, None), (21, "word " * 3000, "de", "s", "y"), (None, "no id here", "en", "s", "z")]
    rows += [rows[7], rows[0]]
    return sp.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


@pytest.fixture
def none(sp):
    return sp.createDataFrame([], "doc_id long, text string, lang string, source string")
